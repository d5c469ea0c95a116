"""Values to and from rows of the objects table: (kind, dtype, shape, data, text, nbytes)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .digests import digest_of

#: Spark element types and their widths in bytes for the decoded view.
NATIVE = {"int8": ("tinyint", 1), "int16": ("smallint", 2), "int32": ("int", 4), "int64": ("bigint", 8)}


def to_row(value: object) -> tuple:
    """(digest, kind, dtype, shape, data, text, nbytes) of a value."""
    if isinstance(value, str):
        raw = value.encode("utf-8", "surrogatepass")
        return digest_of("str", raw), "str", None, None, None, value, len(raw)
    if isinstance(value, bytes):
        return digest_of("bytes", value), "bytes", None, None, bytearray(value), None, len(value)
    name = "longdouble" if value.dtype == np.longdouble and value.dtype != np.float64 else str(value.dtype)
    raw = value.astype(value.dtype.newbyteorder("<"), copy=False).tobytes(order="C")
    return digest_of("ndarray", raw, value.shape, name), "ndarray", name, list(value.shape), bytearray(raw), None, len(raw)


def from_row(kind: str, dtype: str | None, shape, data, text: str | None) -> object:
    if kind == "str":
        return text
    if kind == "bytes":
        return bytes(data)
    return np.frombuffer(bytes(data), dtype=np.dtype(dtype)).reshape([int(n) for n in shape]).copy()


def from_array(values: Column, dtype: str = "float32") -> list[Column]:
    """kind, dtype, shape, data, text of a column of Spark arrays of that element type, through one Arrow pass."""
    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, dtype=np.dtype(dtype).newbyteorder("<")).tobytes())

    return [F.lit("ndarray").alias("kind"), F.lit(dtype).alias("dtype"), F.array(F.size(values)).alias("shape"), packed(values).alias("data"), F.lit(None).cast("string").alias("text")]


def to_array(dtype: str, spark_type: str = "array<float>"):
    """Arrow UDF from a tensor's bytes to a flat Spark array."""
    @F.pandas_udf(spark_type)
    def opened(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else np.frombuffer(bytes(x), dtype=dtype))

    return opened
