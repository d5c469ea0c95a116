"""Column schemas: what a column's values must be, checked before anything is written.

There is no null and no cast: a value fits its column or is refused with a reason, on the driver for one value
(``why_not``) and as a column expression for many (``violation``).
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .digests import CODES, schema_digest

#: Element types, the largest rank and the largest text and bytes values.
DTYPES = ["bool", "int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64", "float16", "float32", "float64", "longdouble"]
MAX_RANK, MAX_BYTES = 31, 2_000_000
#: Storage codes by type of column, and the least and greatest sizes by which tensors are dealt out.
STORAGE = {"fixed": ["00", "01", "10", "50"], "variable": ["00", "01", "10", "50"], "str": ["30", "50"], "bytes": ["31", "50"]}
SMALL, LARGE = 400, 10_000_000
CODECS = ["snappy", "zstd", "gzip", "lz4", "none"]


def default_storage(kind: str, shape: tuple[int, ...], variable: bool) -> str:
    """Storage code by the values' shape: short vectors 10, longer ones 00, higher ranks 01 if fixed and 00 if variable."""
    if kind != "ndarray":
        return {"str": "30", "bytes": "31"}[kind]
    if len(shape) == 1 and shape[0] < SMALL:
        return "10"
    if len(shape) == 1 and shape[0] <= LARGE:
        return "00"
    return "00" if variable else "01"


@dataclass(frozen=True)
class ColumnSchema:
    """kind: ndarray, str or bytes; layout: flat or nested; variable: any shape up to ``shape`` in each dimension."""

    kind: str
    layout: str = "flat"
    variable: bool = True
    dtype: str = ""
    shape: tuple[int, ...] = ()
    storage: str = ""
    storage_options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in CODES:
            raise ValueError(f"column type {self.kind!r} is none of {sorted(CODES)}")
        if self.layout not in ("flat", "nested"):
            raise ValueError(f"layout {self.layout!r} is neither flat nor nested")
        if self.kind == "ndarray":
            name = "longdouble" if self.dtype in ("longdouble", "float128") else str(np.dtype(self.dtype))
            if name not in DTYPES:
                raise ValueError(f"element type {self.dtype!r} is none of {DTYPES}")
            if len(self.shape) > MAX_RANK or not all(isinstance(n, int) and n > 0 for n in self.shape):
                raise ValueError(f"shape {self.shape} must have at most {MAX_RANK} dimensions, each above 0")
            object.__setattr__(self, "dtype", name)
        elif not self.variable:
            raise ValueError(f"a {self.kind} column has values of variable size")
        object.__setattr__(self, "shape", tuple(int(n) for n in self.shape))
        if not self.storage:
            object.__setattr__(self, "storage", default_storage(self.kind, self.shape, self.variable))
        allowed = STORAGE[self.kind if self.kind != "ndarray" else "variable" if self.variable else "fixed"]
        if self.storage not in allowed:
            raise ValueError(f"storage {self.storage!r} of a {self.kind} column is none of {allowed}")
        if unknown := set(self.storage_options) - {"compression", "level", "shuffle"}:
            raise ValueError(f"unknown storage options {sorted(unknown)}")
        if (codec := self.storage_options.get("compression")) is not None and codec not in CODECS:
            raise ValueError(f"compression {codec!r} is none of {CODECS}")

    def spec(self) -> dict:
        return asdict(self) | {"shape": list(self.shape), "data_hasher": CODES[self.kind], "schema_hasher": "1"}

    @property
    def digest(self) -> str:
        return schema_digest(self.spec())

    def to_json(self) -> str:
        return json.dumps(self.spec(), sort_keys=True)

    @classmethod
    def from_spec(cls, spec: dict) -> ColumnSchema:
        return cls(**{k: tuple(v) if k == "shape" else v for k, v in spec.items() if k in cls.__dataclass_fields__})

    @classmethod
    def like(cls, prototype: np.ndarray, **more) -> ColumnSchema:
        return cls(kind="ndarray", dtype=str(prototype.dtype), shape=tuple(prototype.shape), **more)

    def why_not(self, value: object) -> str | None:
        """Why the value does not fit the column; None if it does."""
        if self.kind == "str":
            if not isinstance(value, str):
                return f"a str column takes text, not {type(value).__name__}"
            n = len(value.encode("utf-8", "surrogatepass"))
            return f"{n} bytes of text are over {MAX_BYTES}" if n > MAX_BYTES else None
        if self.kind == "bytes":
            if not isinstance(value, bytes):
                return f"a bytes column takes bytes, not {type(value).__name__}"
            return f"{len(value)} bytes are over {MAX_BYTES}" if len(value) > MAX_BYTES else None
        if not isinstance(value, np.ndarray):
            return f"an ndarray column takes arrays, not {type(value).__name__}"
        name = "longdouble" if value.dtype == np.longdouble and value.dtype != np.float64 else str(value.dtype)
        if name != self.dtype:
            return f"element type {name} is not {self.dtype}"
        if not value.flags.c_contiguous:
            return "the array is not C-contiguous"
        if self.variable:
            if value.ndim != len(self.shape):
                return f"rank {value.ndim} is not {len(self.shape)}"
            if any(a > b for a, b in zip(value.shape, self.shape, strict=True)):
                return f"shape {value.shape} is over {self.shape}"
        elif value.shape != self.shape:
            return f"shape {value.shape} is not {self.shape}"
        return None

    def violation(self) -> Column:
        """Reason why a row (kind, dtype, shape, data, text) does not fit; null if it does."""
        out = F.when(F.col("kind") != self.kind, F.concat(F.lit("kind "), F.col("kind"), F.lit(f" is not {self.kind}")))
        if self.kind == "str":
            return out.when(F.col("text").isNull(), "no value").when(F.octet_length("text") > MAX_BYTES, "text too long")
        out = out.when(F.col("data").isNull(), "no value")
        if self.kind == "bytes":
            return out.when(F.octet_length("data") > MAX_BYTES, "bytes too long")
        want = F.array(*[F.lit(n) for n in self.shape]) if self.shape else F.array().cast("array<int>")
        out = out.when(F.col("dtype") != self.dtype, "element type")
        if self.variable:
            over = F.exists(F.zip_with("shape", want, lambda a, b: a > b), lambda x: x)
            return out.when(F.size("shape") != len(self.shape), "rank").when(over, "shape over the largest")
        return out.when(F.col("shape") != want, "shape")
