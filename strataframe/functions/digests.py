"""Content digests, ``<type code>=<hex>``: 0 tensors, 1 schemas, 2 texts, 3 bytes, a commits.

SHA-256 is built into Spark, so digests of columns stay inside code generation. ``blake2b_udf`` gives 160-bit BLAKE2b
digests instead, through Arrow, where stores must agree with other software.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TENSOR, SCHEMA, TEXT, BYTES, COMMIT = "0", "1", "2", "3", "a"
CODES = {"ndarray": TENSOR, "str": TEXT, "bytes": BYTES}


def type_code(digest: Column | str) -> Column | str:
    return digest[0] if isinstance(digest, str) else F.substr(digest, F.lit(1), F.lit(1))


def text_digest(text: Column) -> Column:
    return F.concat(F.lit(f"{TEXT}="), F.sha2(text.cast("binary"), 256))


def bytes_digest(data: Column) -> Column:
    return F.concat(F.lit(f"{BYTES}="), F.sha2(data, 256))


def _frame(shape: Column, dtype: Column) -> Column:
    return F.encode(F.concat(F.lit("|"), dtype, F.lit("|"), F.array_join(F.transform(shape, lambda x: x.cast("string")), "x")), "utf-8")


def tensor_digest(data: Column, shape: Column, dtype: Column) -> Column:
    """Of the C-ordered little-endian bytes with shape and type folded in, so equal bytes of other shapes differ."""
    return F.concat(F.lit(f"{TENSOR}="), F.sha2(F.concat(data, _frame(shape, dtype)), 256))


def object_digest(kind: Column) -> Column:
    """Digest of a row of the objects table (kind, dtype, shape, data, text)."""
    return F.when(kind == "str", text_digest(F.col("text"))).when(kind == "bytes", bytes_digest(F.col("data"))).otherwise(tensor_digest(F.col("data"), F.col("shape"), F.col("dtype")))


def digest_of(kind: str, data: bytes, shape: tuple[int, ...] = (), dtype: str = "") -> str:
    """The same digests for one value on the driver."""
    if kind == "ndarray":
        data = data + f"|{dtype}|{'x'.join(map(str, shape))}".encode()
    return f"{CODES[kind]}={hashlib.sha256(data).hexdigest()}"


def schema_digest(spec: dict) -> str:
    """Of the schema's fields, whatever their order."""
    return f"{SCHEMA}={hashlib.blake2b(json.dumps(spec, sort_keys=True, separators=(',', ':')).encode(), digest_size=6).hexdigest()}"


def commit_digest(parents: list[str], spec: dict, refs: str) -> str:
    parts = [hashlib.sha256(json.dumps(x, sort_keys=True).encode()).hexdigest() for x in (parents, spec)]
    return f"{COMMIT}={hashlib.blake2b(''.join(sorted([*parts, refs])).encode(), digest_size=20).hexdigest()}"


def record_hash(df: DataFrame) -> Column:
    """One hash for each record of a snapshot."""
    return F.sha2(F.concat_ws("|", "kind", "col", "sample_key", F.coalesce("subsample_key", F.lit("")), "digest"), 256)


#: Digest of a snapshot without records.
EMPTY_REFS = hashlib.sha256(b"").hexdigest()


def refs_digest(records: Column, df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Digest of a set of record hashes, in two levels: first by their leading four hex digits, then of those digests.

    The upper level has at most 65,536 rows whatever the snapshot's size. refs_digest and n_records: one row, or one for
    each value of ``by``.
    """
    by = by or []
    parts = df.select(*by, records.alias("h")).groupBy(*by, F.substr("h", F.lit(1), F.lit(4)).alias("part")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d"), F.count("*").alias("n"))
    top = F.sort_array(F.collect_list(F.struct("part", "d")))
    return parts.groupBy(*by).agg(F.sha2(F.array_join(F.transform(top, lambda x: x["d"]), ""), 256).alias("refs_digest"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_records"))


def blake2b_udf(code: str):
    """Arrow UDF: ``code=`` and the 160-bit BLAKE2b of binary values."""

    @F.pandas_udf("string")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else f"{code}={hashlib.blake2b(bytes(x), digest_size=20).hexdigest()}")

    return run
