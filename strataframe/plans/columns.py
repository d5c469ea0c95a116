"""Column accessors of a checkout: dictionaries of samples over DataFrames.

Single lookups filter records and read one object; whole columns are DataFrames (``dataframe``). In a write checkout
values are checked when set, gathered on the driver and written in batches.
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import Key, decode_key, encode_key
from ..functions.schemas import ColumnSchema
from ..functions.tensors import from_row, to_row
from ..operators import access

if TYPE_CHECKING:
    from .checkout import Checkout

_MISSING = object()


def _away(column: str, stored: str) -> FileNotFoundError:
    return FileNotFoundError(f"the value of {column!r} {decode_key(stored)!r} is on a remote; fetch its data first")


def _decoded(keys: DataFrame) -> Iterator[Key]:
    return (decode_key(r[0]) for r in keys.toLocalIterator())


class Streamed:
    """A view that is worked out anew each time it is iterated, streamed from the cluster; equal to a list of the same."""

    def __init__(self, size: Callable[[], int], items: Callable[[], Iterator]):
        self._size, self._items = size, items

    def __iter__(self) -> Iterator:
        return self._items()

    def __len__(self) -> int:
        return self._size()

    def __eq__(self, other: object) -> bool:
        return list(self) == list(other) if isinstance(other, (list, tuple, Streamed)) else NotImplemented

    __hash__ = None


class Column:
    """What flat and nested columns share."""

    kind = "f"

    def __init__(self, checkout: Checkout, name: str, schema: ColumnSchema):
        self._co, self.column, self.schema = checkout, name, schema

    # Introspection.

    @property
    def column_type(self) -> str:
        return self.schema.kind

    @property
    def column_layout(self) -> str:
        return self.schema.layout

    @property
    def schema_type(self) -> str:
        return "variable_shape" if self.schema.variable else "fixed_shape"

    @property
    def dtype(self):
        return {"str": str, "bytes": bytes}.get(self.schema.kind, self.schema.dtype)

    @property
    def shape(self) -> tuple[int, ...] | None:
        return self.schema.shape if self.schema.kind == "ndarray" else None

    @property
    def backend(self) -> str:
        return self.schema.storage

    @property
    def backend_options(self) -> dict:
        return dict(self.schema.storage_options)

    @property
    def iswriteable(self) -> bool:
        return self._co.writable

    @property
    def contains_subsamples(self) -> bool:
        return self.schema.layout == "nested"

    # Records and values.

    def records(self) -> DataFrame:
        """sample_key, subsample_key, digest; filters on commit and column reach the scan."""
        return self._co.records().where((F.col("kind") == self.kind) & (F.col("col") == self.column))

    def dataframe(self) -> DataFrame:
        """Records with their values; remote ones have nulls."""
        return self.records().join(self._co.store.objects().withColumnRenamed("kind", "value_kind"), "digest", "left")

    def _values(self, records: DataFrame) -> list[tuple[str, str, object]]:
        """Values of a few records, by one filter on their digests."""
        rows = records.select("sample_key", "subsample_key", "digest").orderBy("sample_key", "subsample_key").collect()
        found = self._co.load(sorted({r["digest"] for r in rows}))
        for r in rows:
            if r["digest"] not in found:
                raise _away(self.column, r["sample_key"])
        return [(r["sample_key"], r["subsample_key"], found[r["digest"]]) for r in rows]

    def _streamed(self, records: DataFrame) -> Iterator[tuple[str, str, object]]:
        """Any number of records with their values in key order: one join and sort, of which the driver holds one range at a time."""
        objects = self._co.store.objects().withColumnRenamed("kind", "value_kind").drop("nbytes")
        rows = records.select("sample_key", "subsample_key", "digest").join(objects, "digest", "left").orderBy("sample_key", "subsample_key")
        for r in rows.toLocalIterator(prefetchPartitions=True):
            if r["value_kind"] is None:
                raise _away(self.column, r["sample_key"])
            yield r["sample_key"], r["subsample_key"], from_row(r["value_kind"], r["dtype"], r["shape"], r["data"], r["text"])

    def _asked(self, local: bool) -> DataFrame:
        return access.local_only(self.records(), self._co.store.objects()) if local else self.records()

    @property
    def contains_remote_references(self) -> bool:
        return not access.remote_only(self.records(), self._co.store.objects()).isEmpty()

    @property
    def remote_reference_keys(self) -> list[Key]:
        rows = access.remote_only(self.records(), self._co.store.objects()).select("sample_key").distinct().orderBy("sample_key").collect()
        return [decode_key(r[0]) for r in rows]

    def __iter__(self) -> Iterator[Key]:
        return iter(self.keys())

    def __contains__(self, key: object) -> bool:
        try:
            return not self.records().where(F.col("sample_key") == encode_key(key)).limit(1).isEmpty()
        except ValueError:
            return False

    def __enter__(self):
        self._co._context += 1
        return self

    def __exit__(self, *exc) -> None:
        self._co._context -= 1
        self._co.flush()

    # Writing, shared.

    def _check(self, pairs: list[tuple[tuple[str, str], object]]) -> None:
        self._co.must_write()
        for (_, _), value in pairs:
            if reason := self.schema.why_not(value):
                raise ValueError(f"column {self.column!r}: {reason}")

    def _put(self, pairs: list[tuple[tuple[str, str], object]]) -> None:
        """All values are checked before any is taken."""
        self._check(pairs)
        for (s, u), value in pairs:
            self._co.put(self.kind, self.column, s, u, to_row(value))

    def change_backend(self, backend: str, backend_options: dict | None = None) -> None:
        """Storage of values from now on; the schema's digest changes with it."""
        self._co.must_write()
        if self._co._context:
            raise PermissionError("a column's storage can't be changed inside a context manager")
        spec = self.schema.spec() | {"storage": backend, "storage_options": backend_options or {}}
        self.schema = ColumnSchema.from_spec(spec)
        self._co.put_schema(self.column, self.schema)

    def update_dataframe(self, rows: DataFrame) -> None:
        """Upsert many samples at once: sample_key and subsample_key in stored form, kind, dtype, shape, data, text.

        The rows are worked out once and checked first; one that does not fit, or a key given twice, stops the whole update.
        One pass over hashes of the keys tells that all is well, or that rows must be looked at.
        """
        self._co.must_write()
        self._co.flush()
        given = ["sample_key", "subsample_key", "kind", "dtype", "shape", "data", "text"]
        with self._co.store.work(rows.select(*given)) as written:
            doubtful = written.groupBy(F.xxhash64("sample_key", "subsample_key")).agg(F.count("*").alias("n"), F.max(self.schema.violation().isNotNull()).alias("bad")).where("n > 1 OR bad")
            checked = not doubtful.count()
            bad = [] if checked else written.select("sample_key", self.schema.violation().alias("reason")).where("reason IS NOT NULL").take(1)
            if bad:
                raise ValueError(f"column {self.column!r}, {bad[0]['sample_key']!r}: {bad[0]['reason']}")
            twice = [] if checked else written.groupBy("sample_key", "subsample_key").count().where("count > 1").take(1)
            if twice:
                raise ValueError(f"column {self.column!r}: {twice[0]['count']} rows for {twice[0]['sample_key']!r} {twice[0]['subsample_key']!r}; rows have no order, so give one a key")
            self._co.put_dataframe(self.kind, self.column, written)

    def delete_dataframe(self, gone: DataFrame) -> None:
        """Delete many samples at once: sample_key and subsample_key in stored form. Keys that are not there don't matter."""
        self._co.must_write()
        self._co.flush()
        self._co.store.stage(gone.select(F.lit(self.kind).alias("kind"), F.lit(self.column).alias("col"), "sample_key", "subsample_key", F.lit(None).cast("string").alias("digest"), F.lit("del").alias("op")))


def _drawn() -> str:
    return "".join(random.choices(string.ascii_lowercase + string.digits, k=16))


class FlatColumn(Column):
    """sample key -> value."""

    def __len__(self) -> int:
        return self.records().count()

    def __getitem__(self, key: Key) -> object:
        out = self.get(key, _MISSING)
        if out is _MISSING:
            raise KeyError(key)
        return out

    def get(self, key: Key, default: object = None) -> object:
        found = self._values(access.point(self.records(), encode_key(key)))
        return found[0][2] if found else default

    def keys(self, local: bool = False) -> Streamed:
        rows = self._asked(local)
        return Streamed(rows.count, lambda: _decoded(rows.select("sample_key").orderBy("sample_key")))

    def values(self, local: bool = False) -> Streamed:
        rows = self._asked(local)
        return Streamed(rows.count, lambda: (v for _, _, v in self._streamed(rows)))

    def items(self, local: bool = False) -> Streamed:
        rows = self._asked(local)
        return Streamed(rows.count, lambda: ((decode_key(s), v) for s, _, v in self._streamed(rows)))

    def __setitem__(self, key: Key, value: object) -> None:
        self.update({key: value})

    def update(self, other: Mapping | Iterable[tuple] | None = None, **more: object) -> None:
        pairs = [*dict(other or {}).items(), *more.items()]
        self._put([((encode_key(k), ""), v) for k, v in pairs])

    def append(self, value: object) -> str:
        key = _drawn()
        self[key] = value
        return key

    def __delitem__(self, key: Key) -> None:
        self._co.must_write()
        self._co.flush()
        if key not in self:
            raise KeyError(key)
        self._co.remove(self.kind, self.column, [(encode_key(key), "")])

    def pop(self, key: Key) -> object:
        self._co.must_write()
        value = self[key]
        del self[key]
        return value


class Subsamples:
    """subsample key -> value, of one sample."""

    def __init__(self, parent: NestedColumn, sample: Key):
        self._of, self.sample, self.column = parent, sample, parent.column
        self._key = encode_key(sample)

    def records(self) -> DataFrame:
        return access.point(self._of.records(), self._key)

    def _items(self, records: DataFrame) -> dict[Key, object]:
        return {decode_key(u): v for _, u, v in self._of._values(records)}

    def __len__(self) -> int:
        return self.records().count()

    def __iter__(self) -> Iterator[Key]:
        return iter(self.keys())

    def __contains__(self, key: object) -> bool:
        try:
            return not access.point(self._of.records(), self._key, encode_key(key)).limit(1).isEmpty()
        except ValueError:
            return False

    def __getitem__(self, key: object) -> object:
        if key is ...:
            return self._items(self.records())
        if isinstance(key, slice):
            return self._items(access.subsample_slice(self.records(), key.start, key.stop, key.step))
        if not isinstance(key, (str, int)):
            raise TypeError(f"{key!r} is no subsample key")
        found = self._items(access.point(self._of.records(), self._key, encode_key(key)))
        if not found:
            raise KeyError(key)
        return found[key]

    def get(self, key: object, default: object = None) -> object:
        try:
            return self[key]
        except KeyError:
            return default

    @property
    def data(self) -> dict[Key, object]:
        return self[...]

    def _asked(self, local: bool) -> DataFrame:
        return access.local_only(self.records(), self._of._co.store.objects()) if local else self.records()

    def keys(self, local: bool = False) -> list[Key]:
        return [decode_key(r[0]) for r in self._asked(local).select("subsample_key").orderBy("subsample_key").collect()]

    def values(self, local: bool = False) -> list[object]:
        return list(self._items(self._asked(local)).values())

    def items(self, local: bool = False) -> list[tuple[Key, object]]:
        return list(self._items(self._asked(local)).items())

    @property
    def contains_remote_references(self) -> bool:
        return not access.remote_only(self.records(), self._of._co.store.objects()).isEmpty()

    @property
    def remote_reference_keys(self) -> list[Key]:
        rows = access.remote_only(self.records(), self._of._co.store.objects()).select("subsample_key").orderBy("subsample_key").collect()
        return [decode_key(r[0]) for r in rows]

    def __setitem__(self, key: Key, value: object) -> None:
        self.update({key: value})

    def update(self, other: Mapping | Iterable[tuple] | None = None, **more: object) -> None:
        self._of.update({self.sample: {**dict(other or {}), **more}})

    def append(self, value: object) -> str:
        key = _drawn()
        self[key] = value
        return key

    def __delitem__(self, key: Key) -> None:
        self._of._co.must_write()
        if key not in self:
            raise KeyError(key)
        self._of._co.remove(self._of.kind, self.column, [(self._key, encode_key(key))])

    def pop(self, key: Key) -> object:
        self._of._co.must_write()
        value = self[key]
        del self[key]
        return value


class NestedColumn(Column):
    """sample key -> subsample key -> value."""

    kind = "n"

    def __len__(self) -> int:
        return self.records().select("sample_key").distinct().count()

    @property
    def num_subsamples(self) -> int:
        return self.records().count()

    def __getitem__(self, key: object) -> object:
        sample, *rest = key if isinstance(key, tuple) else (key,)
        if sample not in self:
            raise KeyError(sample)
        out: object = Subsamples(self, sample)
        for k in rest:
            out = out[k]
        return out

    def get(self, key: object, default: object = None) -> object:
        try:
            return self[key]
        except KeyError:
            return default

    def keys(self, local: bool = False) -> Streamed:
        rows = access.local_samples(self.records(), self._co.store.objects()) if local else self.records().select("sample_key").distinct()
        return Streamed(rows.count, lambda: _decoded(rows.orderBy("sample_key")))

    def values(self, local: bool = False) -> Streamed:
        keys = self.keys(local)
        return Streamed(lambda: len(keys), lambda: (Subsamples(self, k) for k in keys))

    def items(self, local: bool = False) -> Streamed:
        keys = self.keys(local)
        return Streamed(lambda: len(keys), lambda: ((k, Subsamples(self, k)) for k in keys))

    def __setitem__(self, sample: Key, value: Mapping | Iterable[tuple]) -> None:
        self.update({sample: value})

    def update(self, other: Mapping | Iterable[tuple] | None = None, **more: object) -> None:
        """Subsamples are added to samples that are there, not put in place of theirs."""
        given = {**dict(other or {}), **more}
        self._put([((encode_key(s), encode_key(u)), v) for s, subs in given.items() for u, v in dict(subs).items()])

    def __delitem__(self, sample: Key) -> None:
        self._co.must_write()
        if sample not in self:
            raise KeyError(sample)
        gone = [(encode_key(sample), r[0]) for r in access.point(self.records(), encode_key(sample)).select("subsample_key").collect()]
        self._co.remove(self.kind, self.column, gone)

    def pop(self, sample: Key) -> dict[Key, object]:
        self._co.must_write()
        value = self[sample].data
        del self[sample]
        return value


def column_of(checkout: Checkout, name: str, schema: ColumnSchema) -> FlatColumn | NestedColumn:
    return (NestedColumn if schema.layout == "nested" else FlatColumn)(checkout, name, schema)


__all__ = ["FlatColumn", "NestedColumn", "Subsamples", "column_of", "from_row"]
