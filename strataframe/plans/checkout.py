"""Read and write checkouts: a snapshot's columns, and one transaction over the staging area."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digests
from ..functions.keys import check_name, encode_key
from ..functions.schemas import ColumnSchema
from ..functions.tensors import from_row
from ..operators import algebra
from ..sources.store import OBJECTS, Store
from .columns import FlatColumn, NestedColumn, column_of
from .differ import Differ

#: Values gathered on the driver before they are written.
FLUSH_ROWS, FLUSH_BYTES = 5_000, 64_000_000


class Checkout:
    """A dictionary of columns at a commit, or over staging."""

    writable = False

    def __init__(self, store: Store, commit: str):
        self.store, self._commit, self._open, self._context = store, commit, True, 0
        self._schemas: dict[str, ColumnSchema] | None = None

    # Life.

    def _alive(self) -> None:
        if not self._open:
            raise PermissionError("this checkout is closed")

    def must_write(self) -> None:
        self._alive()
        if not self.writable:
            raise PermissionError("a read checkout can't be written to")

    def close(self) -> None:
        self._alive()
        self._open = False

    def __enter__(self):
        self._alive()
        self._context += 1
        return self

    def __exit__(self, *exc) -> None:
        self._context -= 1
        self.flush()

    def flush(self) -> None:
        self._alive()

    # Data.

    def records(self) -> DataFrame:
        self._alive()
        return self.store.refs(self._commit)

    def load(self, wanted: list[str]) -> dict[str, object]:
        """Values by digest, of those that are here. A few digests become a filter that reaches the scan, many a join."""
        objects = self.store.objects()
        if len(wanted) <= 200:
            found = objects.where(F.col("digest").isin(wanted)) if wanted else objects.limit(0)
        else:
            found = objects.join(self.store.spark.createDataFrame([(d,) for d in wanted], "digest string"), "digest", "left_semi")
        return {r["digest"]: from_row(r["kind"], r["dtype"], r["shape"], r["data"], r["text"]) for r in found.toLocalIterator()}

    def schemas(self) -> dict[str, ColumnSchema]:
        self._alive()
        if self._schemas is None:
            known = self.store.schemas()
            rows = self.records().where("kind = 's'").select("col", "sample_key", "digest").orderBy("col", "sample_key").collect()
            self._schemas = {r["col"]: known[r["digest"]] for r in rows}
        return self._schemas

    @property
    def commit_hash(self) -> str:
        self._alive()
        return self._commit

    # A dictionary of columns.

    @property
    def columns(self) -> Columns:
        self._alive()
        return Columns(self)

    def column(self, name: str) -> FlatColumn | NestedColumn:
        schemas = self.schemas()
        if name not in schemas:
            raise KeyError(name)
        return column_of(self, name, schemas[name])

    def __len__(self) -> int:
        return len(self.schemas())

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())

    def __contains__(self, name: object) -> bool:
        return name in self.schemas()

    def keys(self) -> list[str]:
        return sorted(self.schemas())

    def values(self) -> list[FlatColumn | NestedColumn]:
        return [self.column(n) for n in self.keys()]

    def items(self) -> list[tuple[str, FlatColumn | NestedColumn]]:
        return [(n, self.column(n)) for n in self.keys()]

    def __getitem__(self, asked):
        """A column by name; values by (column, sample[, subsample]), or a list of them for a list of such paths."""
        if isinstance(asked, str):
            return self.column(asked)
        return self._many(asked, None, strict=True)

    def get(self, asked, default=None, except_missing: bool = False):
        """As ``[]``, with the default in place of what is missing."""
        if isinstance(asked, str):
            return self.column(asked)
        return self._many(asked, default, strict=except_missing)

    def _many(self, asked, default, strict: bool):
        one = isinstance(asked, tuple) and len(asked) > 1 and isinstance(asked[0], str) and not isinstance(asked[1], (tuple, list))
        paths = [asked] if one else list(asked)
        out = self._batched(paths, default, strict)
        return out[0] if one else out

    def _batched(self, paths: list, default, strict: bool) -> list:
        """Paths to single values are looked up in one join; paths to samples, slices and columns one by one."""
        plain: dict[int, tuple[str, str, str]] = {}
        out: list[object] = [default] * len(paths)
        for i, p in enumerate(paths):
            p = (p,) if isinstance(p, str) else tuple(p)
            try:
                col = self.column(p[0])
                depth = 3 if col.contains_subsamples else 2
                if len(p) == depth and all(isinstance(k, (str, int)) for k in p[1:]):
                    plain[i] = (p[0], encode_key(p[1]), encode_key(p[2]) if depth == 3 else "")
                else:
                    value: object = col
                    for k in p[1:]:
                        value = value[k]
                    out[i] = value
            except (KeyError, IndexError, TypeError, ValueError) as e:
                if strict:
                    raise e if isinstance(e, (KeyError, TypeError)) else KeyError(p) from e
        if plain:
            asked = self.store.spark.createDataFrame([(i, *k) for i, k in plain.items()], "pos int, col string, sample_key string, subsample_key string")
            rows = {r["pos"]: r["digest"] for r in asked.join(self.records().where("kind <> 's'"), ["col", "sample_key", "subsample_key"]).select("pos", "digest").collect()}
            values = self.load(sorted(set(rows.values())))
            for i in plain:
                if i in rows and rows[i] in values:
                    out[i] = values[rows[i]]
                elif i in rows:
                    raise FileNotFoundError(f"the value of {paths[i]!r} is on a remote; fetch its data first")
                elif strict:
                    raise KeyError(paths[i])
        return out

    @property
    def diff(self) -> Differ:
        self._alive()
        return Differ(self.store, self._commit, lambda: self.records(), staged=self.writable)

    def log(self, branch: str | None = None, commit: str | None = None, *, return_contents: bool = False, show_time: bool = False, show_user: bool = False):
        from .reports import log

        return log(self.store, commit or (self.store.heads()[branch] if branch else self._commit), return_contents, show_time, show_user)


class Columns:
    """The columns of a checkout, as a dictionary; in a write checkout columns can be deleted here."""

    def __init__(self, checkout: Checkout):
        self._co = checkout

    def __getitem__(self, name: str):
        return self._co.column(name)

    get = __getitem__

    def __contains__(self, name: object) -> bool:
        return name in self._co

    def __len__(self) -> int:
        return len(self._co)

    def __iter__(self) -> Iterator[str]:
        return iter(self._co)

    def keys(self) -> list[str]:
        return self._co.keys()

    def values(self) -> list:
        return self._co.values()

    def items(self) -> list:
        return self._co.items()

    @property
    def iswriteable(self) -> bool:
        return self._co.writable

    @property
    def contains_remote_references(self) -> dict[str, bool]:
        return {n: c.contains_remote_references for n, c in self._co.items()}

    @property
    def remote_sample_keys(self) -> dict[str, list]:
        return {n: c.remote_reference_keys for n, c in self._co.items()}

    def __delitem__(self, name: str) -> None:
        self.delete(name)

    def delete(self, name: str) -> str:
        self._co.must_write()
        if self._co._context:
            raise PermissionError("a column can't be deleted inside a context manager")
        if name not in self._co:
            raise KeyError(name)
        self._co.drop_column(name)
        return name


class WriterCheckout(Checkout):
    """The one transaction of a repository; it holds the writer lock until closed, and staged changes outlive it."""

    writable = True

    def __init__(self, repo, branch: str, lock: str):
        self._repo, self.branch_name, self._lock = repo, branch, lock
        self._pending: list[tuple] = []
        self._objects: dict[str, tuple] = {}
        self._bytes = 0
        super().__init__(repo.store, repo.store.heads().get(branch, ""))

    # Staging.

    def records(self) -> DataFrame:
        self.flush()
        return self.store.overlay(self._commit)

    def put(self, kind: str, col: str, sample: str, subsample: str, row: tuple) -> None:
        self._pending.append((kind, col, sample, subsample, row[0], "put"))
        if row[0] not in self._objects:
            self._objects[row[0]] = row
            self._bytes += row[-1]
        if len(self._pending) >= FLUSH_ROWS or self._bytes >= FLUSH_BYTES:
            self.flush()

    def remove(self, kind: str, col: str, gone: list[tuple[str, str]]) -> None:
        self.flush()
        self._pending += [(kind, col, s, u, None, "del") for s, u in gone]
        self.flush()

    def drop_column(self, name: str) -> None:
        self.flush()
        self.store.stage([("s", name, "", "", None, "drop")])
        self._schemas = None

    def put_schema(self, name: str, schema: ColumnSchema) -> None:
        digest, known = self.store.put_schema(schema), self.schemas()
        self.flush()
        self._pending.append(("s", name, schema.layout, "", digest, "put"))
        self.flush()
        self._schemas = known | {name: schema}

    def put_dataframe(self, kind: str, col: str, rows: DataFrame) -> None:
        """Stage prepared values in bulk, no key of them twice; digests are worked out where the rows are."""
        made = rows.withColumn("digest", digests.object_digest(F.col("kind"))).withColumn("nbytes", F.coalesce(F.octet_length("data"), F.octet_length("text")).cast("long"))
        self.store.append_objects(made, self._options(col))
        self.store.stage(made.select(F.lit(kind).alias("kind"), F.lit(col).alias("col"), "sample_key", "subsample_key", "digest", F.lit("put").alias("op")))

    def _options(self, col: str) -> dict:
        schema = self.schemas().get(col)
        return schema.storage_options if schema else {}

    def flush(self) -> None:
        """Write what was gathered: new objects first, then the operations, the last of a key only."""
        self._alive()
        if not self._pending:
            return
        pending, objects = self._pending, list(self._objects.values())
        self._pending, self._objects, self._bytes = [], {}, 0
        if objects:
            self.store.append_objects(self.store.spark.createDataFrame(objects, OBJECTS))
        last = {r[:4]: r for r in pending}
        self.store.stage(list(last.values()))

    # Columns.

    def _new_column(self, name: str, schema: ColumnSchema):
        self.must_write()
        if self._context:
            raise PermissionError("a column can't be made inside a context manager")
        check_name(name, "column")
        if name in self.schemas():
            raise LookupError(f"column {name!r} is there already")
        self.put_schema(name, schema)
        return self.column(name)

    def add_str_column(self, name: str, contains_subsamples: bool = False, *, backend: str | None = None, backend_options: dict | None = None):
        return self._new_column(name, ColumnSchema("str", _layout(contains_subsamples), storage=backend or "", storage_options=backend_options or {}))

    def add_bytes_column(self, name: str, contains_subsamples: bool = False, *, backend: str | None = None, backend_options: dict | None = None):
        return self._new_column(name, ColumnSchema("bytes", _layout(contains_subsamples), storage=backend or "", storage_options=backend_options or {}))

    def add_ndarray_column(self, name: str, shape: int | tuple[int, ...] | None = None, dtype=None, prototype: np.ndarray | None = None, variable_shape: bool = False, contains_subsamples: bool = False, *, backend: str | None = None, backend_options: dict | None = None):
        if (prototype is None) == (shape is None and dtype is None) or (prototype is None and (shape is None or dtype is None)):
            raise ValueError("give a prototype, or both shape and dtype")
        if prototype is not None:
            shape, dtype = prototype.shape, prototype.dtype
        shape = (shape,) if isinstance(shape, int) else tuple(shape)
        made = ColumnSchema("ndarray", _layout(contains_subsamples), variable_shape, "longdouble" if dtype == "longdouble" else str(np.dtype(dtype)), shape, backend or "", backend_options or {})
        return self._new_column(name, made)

    # Commits.

    def commit(self, commit_message: str) -> str:
        """Make staging the branch's next commit; RuntimeError if nothing changed, which the snapshots' digests tell."""
        self.must_write()
        self.flush()
        if not self.store.files.exists("staging"):
            raise RuntimeError("there is nothing to commit")
        with self.store.work(self.records().select(*algebra.KEYS, "digest")) as records:
            before = self.store.commits()[self._commit]["refs_digest"] if self._commit else digests.EMPTY_REFS
            after = snapshot_digest(records)
            if before == after:
                raise RuntimeError("there is nothing to commit")
            digest = make_commit(self.store, records, [self._commit] if self._commit else [], commit_message, after)
        self._land(digest)
        return digest

    def _land(self, digest: str) -> None:
        self.store.set_heads(self.store.heads() | {self.branch_name: digest})
        self.store.clear_staging()
        self._commit, self._schemas = digest, None

    def merge(self, message: str, dev_branch: str) -> str:
        from .merger import merge_into

        self.must_write()
        digest = merge_into(self.store, message, self.branch_name, dev_branch)
        self.store.clear_staging()
        self._commit, self._schemas = digest, None
        return digest

    def reset_staging_area(self, *, force: bool = False) -> str:
        """Drop what is staged; RuntimeError if nothing is, unless forced."""
        self.must_write()
        self._pending, self._objects, self._bytes = [], {}, 0
        if self.diff.status() == "CLEAN" and not force:
            raise RuntimeError("there is nothing to reset")
        self.store.clear_staging()
        self._schemas = None
        return self._commit

    def close(self) -> None:
        self.flush()
        super().close()
        self._repo.release_lock(self._lock)


def _layout(nested: bool) -> str:
    return "nested" if nested else "flat"


def snapshot_digest(records: DataFrame) -> str:
    return digests.refs_digest(digests.record_hash(records), records).first()["refs_digest"]


def make_commit(store: Store, records: DataFrame, parents: list[str], message: str, refs_digest: str | None = None) -> str:
    """Put a snapshot (a table of ``work``) in its place and write its commit; the caller moves the head last."""
    state = store.state()
    refs_digest = refs_digest or snapshot_digest(records)
    spec = {"commit_time": time.time(), "message": message, "user": state.get("user", ""), "email": state.get("email", "")}
    digest = digests.commit_digest(parents, spec, refs_digest)
    store.write_refs(digest, records)
    store.put_commit(digest, spec | {"parents": parents, "is_merge": len(parents) > 1, "refs_digest": refs_digest})
    return digest


__all__ = ["Checkout", "WriterCheckout", "make_commit"]
