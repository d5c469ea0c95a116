"""Rows across columns for training loops: NumPy batches, and map-style or generator datasets for other libraries."""

from __future__ import annotations

import contextlib
import itertools
import random
import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column as Col
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import decode_key, encode_key
from ..functions.sizes import BoundedDict
from ..functions.tensors import from_row
from ..operators import access, algebra
from .columns import Column


class RowDataset:
    """Rows of columns with equal keys, or of explicit keys (one, or one for each column).

    On first use the rows are joined once and written in order to a folder of the repository, which goes with the
    dataset; iterations stream it, one job each, and rows by number come in blocks of BLOCK, the last few of which are kept.
    """

    BLOCK, KEPT, ROWS_PER_FILE = 1024, 8, 50_000

    def __init__(self, columns: Sequence[Column] | Column, keys: Sequence | None = None):
        self.columns = [columns] if isinstance(columns, Column) else list(columns)
        if not self.columns:
            raise TypeError("name one column at least")
        self._store, self._written, self._blocks = self.columns[0]._co.store, None, BoundedDict(maxsize=self.KEPT)
        names = [f"{x}{i}" for i in range(len(self.columns)) for x in ("s", "u")]
        if keys is None:
            first = self.columns[0].records().select("sample_key").distinct()
            for other in self.columns[1:]:
                if access.key_mismatch(first, other.records().select("sample_key").distinct(), ["sample_key"]).take(1):
                    raise KeyError(f"columns {self.columns[0].column!r} and {other.column!r} have different keys")
            rows = algebra.numbered(first, ["sample_key"])
            self._asked = rows.select("position", *[F.col("sample_key").alias(n) if n[0] == "s" else F.lit(None).cast("string").alias(n) for n in names])
            self._n = first.count()
        else:
            many = len(self.columns) > 1
            paths = [k if many and isinstance(k, tuple) and len(k) == len(self.columns) else (k,) * len(self.columns) for k in keys]
            rows = [(i, *(x for k in p for x in self._path(k))) for i, p in enumerate(paths)]
            self._asked = self._store.spark.createDataFrame(rows, "position long, " + ", ".join(f"{n} string" for n in names))
            self._n = len(rows)

    @staticmethod
    def _path(key) -> tuple[str, str | None]:
        """Stored sample and subsample key; the latter None for a flat column or a whole sample."""
        return (encode_key(key[0]), encode_key(key[1])) if isinstance(key, tuple) else (encode_key(key), None)

    def __len__(self) -> int:
        return self._n

    def table(self) -> DataFrame:
        """position and, for each column i, its keys s<i>, u<i> and values v<i>: (subsample_key, kind, dtype, shape, data, text) each."""
        if self._written is None:
            out = self._asked
            for i, col in enumerate(self.columns):
                value = F.struct("subsample_key", F.col("value_kind").alias("kind"), "dtype", "shape", "data", "text")
                values = col.dataframe()
                if col.contains_subsamples:
                    own = values.groupBy(F.col("sample_key").alias(f"s{i}")).agg(F.array_sort(F.collect_list(value)).alias(f"v{i}"))
                else:
                    own = values.select(F.col("sample_key").alias(f"s{i}"), F.array(value).alias(f"v{i}"))
                out = out.join(own, f"s{i}", "left")
                if col.contains_subsamples:
                    out = out.withColumn(f"v{i}", F.when(F.col(f"u{i}").isNull(), F.col(f"v{i}")).otherwise(_only(f"v{i}", F.col(f"u{i}"))))
            name = f"work/dataset-{uuid.uuid4().hex}"
            out.repartitionByRange(max(1, self._n // self.ROWS_PER_FILE), "position").sortWithinPartitions("position").write.parquet(self._store.files.at(name))
            self._gone = weakref.finalize(self, _forget, self._store.files, name)
            written = self._store.spark.read.schema(out.schema).parquet(self._store.files.at(name))
            for i, col in enumerate(self.columns):
                if bad := written.where(F.coalesce(F.size(f"v{i}"), F.lit(0)) < 1).select(f"s{i}", f"u{i}").take(1):
                    raise KeyError(tuple(decode_key(k) for k in bad[0] if k))
                if bad := written.where(F.exists(f"v{i}", lambda v: v["kind"].isNull())).select(f"s{i}").take(1):
                    raise FileNotFoundError(f"the value of {col.column!r} {decode_key(bad[0][0])!r} is on a remote; fetch its data first")
            self._written = written
        return self._written

    def _row(self, r) -> tuple:
        out = []
        for i, col in enumerate(self.columns):
            values = {decode_key(v["subsample_key"]) if v["subsample_key"] else "": from_row(v["kind"], v["dtype"], v["shape"], v["data"], v["text"]) for v in r[f"v{i}"]}
            out.append(values if col.contains_subsamples and r[f"u{i}"] is None else next(iter(values.values())))
        return tuple(out)

    def stream(self, seed: int | None = None) -> Iterator[tuple]:
        """All rows in order, or in one drawn by the seed; the driver holds one range of them at a time."""
        order = [F.col("position")] if seed is None else [F.xxhash64("position", F.lit(seed)), F.col("position")]
        return map(self._row, self.table().orderBy(*order).toLocalIterator(prefetchPartitions=True))

    def index_get(self, index: int) -> tuple:
        if not -self._n <= index < self._n:
            raise IndexError(index)
        index %= self._n
        low = index - index % self.BLOCK
        if low not in self._blocks:
            rows = self.table().where(F.col("position").between(low, low + self.BLOCK - 1)).collect()
            self._blocks[low] = {r["position"]: self._row(r) for r in rows}
        return self._blocks[low][index]


def _only(values: str, subsample: Col) -> Col:
    return F.filter(values, lambda v: v["subsample_key"] == subsample)


def _forget(files, name: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before the dataset
        files.delete(name)


def default_collate(batch: list) -> object:
    """Arrays stacked, texts, bytes and dictionaries as a list, tuples column by column."""
    if isinstance(batch[0], np.ndarray):
        return np.stack(batch)
    if isinstance(batch[0], tuple):
        return tuple(default_collate(list(part)) for part in zip(*batch, strict=True))
    return list(batch)


class NumpyDataset:
    """Iterates rows, or batches of ``batch_size``; each iteration shuffles anew unless told not to."""

    def __init__(self, dataset: RowDataset, batch_size: int | None, drop_last: bool, shuffle: bool, collate_fn: Callable | None):
        if batch_size is None and collate_fn is not None:
            raise RuntimeError("a collate function needs a batch size")
        if batch_size is not None and not 0 < batch_size <= len(dataset):
            raise RuntimeError(f"batches of {batch_size} from {len(dataset)} rows")
        self.dataset, self.batch_size, self._drop, self.shuffle, self._collate = dataset, batch_size, drop_last, shuffle, collate_fn or default_collate

    @property
    def num_batches(self) -> int | None:
        if self.batch_size is None:
            return None
        return len(self.dataset) // self.batch_size if self._drop else -(-len(self.dataset) // self.batch_size)

    def __len__(self) -> int:
        return len(self.dataset)

    def __iter__(self) -> Iterator:
        rows = (r[0] if len(r) == 1 else r for r in self.dataset.stream(random.getrandbits(31) if self.shuffle else None))
        if self.batch_size is None:
            yield from rows
            return
        for batch in itertools.batched(rows, self.batch_size):
            if len(batch) == self.batch_size or not self._drop:
                yield self._collate(list(batch))


def make_numpy_dataset(columns, keys=None, batch_size: int | None = None, drop_last: bool = False, shuffle: bool = True, collate_fn: Callable | None = None) -> NumpyDataset:
    return NumpyDataset(RowDataset(columns, keys), batch_size, drop_last, shuffle, collate_fn)


def make_torch_dataset(columns, keys=None, as_dict: bool = False):
    """A map-style dataset of tuples or dictionaries; needs torch."""
    try:
        from torch.utils.data import Dataset
    except ImportError as e:
        raise ImportError("torch is not installed") from e
    rows = RowDataset(columns, keys)

    class Rows(Dataset):
        def __len__(self) -> int:
            return len(rows)

        def __getitem__(self, index: int):
            got = rows.index_get(index)
            return {c.column: v for c, v in zip(rows.columns, got, strict=True)} if as_dict else got[0] if len(got) == 1 else got

    return Rows()


def make_tensorflow_dataset(columns, keys=None, shuffle: bool = False):
    """A dataset from a generator; dimensions of variable shapes are None. Needs tensorflow."""
    try:
        import tensorflow as tf
    except ImportError as e:
        raise ImportError("tensorflow is not installed") from e
    rows = RowDataset(columns, keys)
    kinds = {"str": tf.string, "bytes": tf.string}
    signature = tuple(tf.TensorSpec(() if c.schema.kind != "ndarray" else tuple(None for _ in c.shape) if c.schema.variable else c.shape, kinds.get(c.schema.kind) or c.dtype) for c in rows.columns)
    return tf.data.Dataset.from_generator(lambda: iter(NumpyDataset(rows, None, False, shuffle, None)), output_signature=signature if len(signature) > 1 else signature[0])
