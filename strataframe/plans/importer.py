"""Bulk imports: a user's generator runs where the data is, in one pass, and its outputs become samples.

``udf(**kwargs)`` yields ``Output`` tuples. Outputs are checked against their columns, digested in the JVM, written
once by digest, and staged in one batch; where two outputs have one key, the later by (input, output) number wins.
"""

from __future__ import annotations

import inspect
import io
import pickle
import random
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import Key, decode_key, encode_key
from ..functions.tensors import from_row, to_row
from ..operators import algebra
from ..sources.store import OBJECTS


class Output(NamedTuple):
    """One value for a column: key is a sample key, or (sample, subsample) in a nested column."""

    column: str
    key: Key | tuple[Key, Key]
    data: object

    def same(self, other: Output) -> bool:
        if isinstance(self.data, np.ndarray) and isinstance(other.data, np.ndarray):
            equal = self.data.dtype == other.data.dtype and np.array_equal(self.data, other.data)
        else:
            equal = self.data == other.data
        return self.column == other.column and self.key == other.key and bool(equal)


STEPS = "task long, step long, col string, sample_key string, subsample_key string, problem string, " + OBJECTS


def check_udf(udf: Callable, kwargs: list[dict], columns: set[str]) -> None:
    """A generator function that pickles, takes the arguments, and gives equal outputs twice on a few inputs."""
    if not inspect.isgeneratorfunction(udf):
        raise TypeError("the import function must be a generator function")
    cloudpickle.dumps(udf)
    signature = inspect.signature(udf)
    for k in kwargs:
        if not isinstance(k, dict):
            raise TypeError("each input is a dictionary of arguments")
        signature.bind(**k)
    n = max(2, min(100, len(kwargs) // 50))
    for k in random.Random(0).sample(kwargs, min(n, len(kwargs))):
        first, second = list(udf(**k)), list(udf(**k))
        if len(first) != len(second) or not all(Output(*a).same(Output(*b)) for a, b in zip(first, second, strict=True)):
            raise ValueError("the import function gives different outputs for equal inputs")
        if unknown := {Output(*o).column for o in first} - columns:
            raise ValueError(f"outputs for columns that were not named: {sorted(unknown)}")


def outputs(spark, udf: Callable, kwargs: list[dict], schemas: dict, partitions: int | None = None) -> DataFrame:
    """Rows of STEPS: each output with its digest, or the problem with it."""
    pickled = cloudpickle.dumps(udf)
    rows = spark.createDataFrame([(i, bytearray(pickle.dumps(k))) for i, k in enumerate(kwargs)], "task long, kwargs binary")
    rows = rows.repartition(partitions or max(1, min(len(kwargs), spark.sparkContext.defaultParallelism * 4)), "task")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pickle.loads(pickled)
        names = [c.strip().split(" ")[0] for c in STEPS.split(",")]
        for b in batches:
            out = []
            for task, packed in zip(b["task"], b["kwargs"], strict=True):
                for step, got in enumerate(f(**pickle.loads(packed))):
                    o = Output(*got)
                    key = o.key if isinstance(o.key, tuple) else (o.key,)
                    schema = schemas.get(o.column)
                    problem = f"no column {o.column!r}" if schema is None else schema.why_not(o.data)
                    if problem is None and len(key) != (2 if schema.layout == "nested" else 1):
                        problem = f"{o.key!r} is no key of a {schema.layout} column"
                    try:
                        stored = [encode_key(k) for k in key]
                    except ValueError as e:
                        problem, stored = str(e), [""]
                    value = to_row(o.data) if problem is None else (None,) * 7
                    out.append((task, step, o.column, stored[0], stored[1] if len(stored) > 1 else "", problem, *value))
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, STEPS)


def run_bulk_import(repo, branch_name: str, column_names: list[str], udf: Callable, udf_kwargs: list[dict], *, ncpus: int = 0, autocommit: bool = True) -> dict[str, int]:
    """Import all outputs into the named columns of a branch, or nothing. Counts of outputs, keys and new values."""
    co = repo.checkout(write=True, branch=branch_name)
    try:
        schemas = co.schemas()
        if unknown := set(column_names) - set(schemas):
            raise KeyError(f"no columns {sorted(unknown)}")
        check_udf(udf, udf_kwargs, set(column_names))
        with repo.store.work(outputs(repo.spark, udf, udf_kwargs, {n: schemas[n] for n in column_names}, ncpus or None)) as steps:
            if bad := steps.where("problem IS NOT NULL").take(1):
                raise ValueError(f"column {bad[0]['col']!r}, {bad[0]['sample_key']!r}: {bad[0]['problem']}")
            kinds = {n: ("n" if schemas[n].layout == "nested" else "f") for n in column_names}
            kind = F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("col"))
            new = repo.store.append_objects(steps.select(*[c.split(" ")[0] for c in OBJECTS.split(", ")]))
            keyed = algebra.last_write(steps.select("col", "sample_key", "subsample_key", "task", "step", "digest"), ["col", "sample_key", "subsample_key"], ["task", "step"])
            repo.store.stage(keyed.select(kind.alias("kind"), "col", "sample_key", "subsample_key", "digest", F.lit("put").alias("op")))
            counts = {"outputs": steps.count(), "keys": keyed.count(), "new_values": new}
        if autocommit and co.diff.status() == "DIRTY":
            co.commit(f"Import into {', '.join(sorted(column_names))}")
        return counts
    finally:
        co.close()


def import_files(repo, branch_name: str, column: str, path: str, load: Callable[[str, bytes], Iterator[tuple[object, Key]]], *, overwrite: bool = False, pattern: str = "*") -> int:
    """Each file of a folder goes through ``load(path, content)``, which yields (value, key), in a nested column (value, (sample, subsample)).

    Keys that are there are skipped unless overwritten; where two outputs have one key, the later by (path, number) wins.
    """
    co = repo.checkout(write=True, branch=branch_name)
    try:
        schema = co.schemas()[column]
        depth, kind = (2, "n") if schema.layout == "nested" else (1, "f")
        found = repo.spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = ["path", "step", "sample_key", "subsample_key", "problem", *[c.split(" ")[0] for c in OBJECTS.split(", ")]]
            for b in batches:
                out = []
                for p, content in zip(b["path"], b["content"], strict=True):
                    for step, (value, key) in enumerate(load(p, bytes(content))):
                        key = key if isinstance(key, tuple) else (key,)
                        problem = schema.why_not(value) if len(key) == depth else f"{key!r} is no key of a {schema.layout} column"
                        stored = [encode_key(k) for k in key] if problem is None else ["", ""]
                        out.append((p, step, stored[0], stored[1] if depth == 2 else "", problem, *(to_row(value) if problem is None else (None,) * 7)))
                yield pd.DataFrame(out, columns=names)

        keys = ["sample_key", "subsample_key"]
        rows = found.mapInPandas(run, "path string, step long, sample_key string, subsample_key string, problem string, " + OBJECTS)
        with repo.store.work(rows) as rows:
            if bad := rows.where("problem IS NOT NULL").take(1):
                raise ValueError(f"column {column!r}, {bad[0]['path']!r}: {bad[0]['problem']}")
            if not overwrite:
                rows = rows.join(co.column(column).records().select(*keys), keys, "left_anti")
            repo.store.append_objects(rows)
            once = algebra.last_write(rows.select(*keys, "path", "step", "digest"), keys, ["path", "step"])
            repo.store.stage(once.select(F.lit(kind).alias("kind"), F.lit(column).alias("col"), *keys, "digest", F.lit("put").alias("op")))
            return once.count()
    finally:
        co.close()


def load_numpy(path: str, content: bytes) -> Iterator[tuple[object, Key]]:
    """A loader for ``import_files``: an ``.npy`` file is one sample named as the file, an ``.npz`` archive one for each array."""
    name, _, kind = path.rsplit("/", 1)[-1].rpartition(".")
    got = np.load(io.BytesIO(content), allow_pickle=False)
    if kind == "npy":
        yield np.ascontiguousarray(got), name
    else:
        for k in got.files:
            yield np.ascontiguousarray(got[k]), k


def export_files(checkout, column: str, save: Callable[[object, str, Key], None], outdir: str, sample: Key | None = None) -> int:
    """Each sample, or one, through ``save(value, path, key)``; files are named by type and key, in a nested column by both keys.

    A single sample is saved here. All samples are saved by the executors, each its part, so ``outdir`` must be a folder
    that they share; a task that runs again saves its files again.
    """
    col = checkout.column(column)

    def name(key: Key) -> str:
        return f"{'int' if isinstance(key, int) else 'str'}:{key}"

    def path(*keys: Key) -> str:
        return f"{outdir}/{'-'.join(map(name, keys))}"

    if sample is not None:
        value = col[sample]
        pairs = [((sample, k), v) for k, v in value.data.items()] if col.contains_subsamples else [((sample,), value)]
        for keys, v in pairs:
            save(v, path(*keys), keys[-1])
        return len(pairs)
    rows = col.dataframe()
    if col.contains_remote_references:
        raise FileNotFoundError(f"values of {column!r} are on a remote; fetch their data first")
    nested = col.contains_subsamples

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                keys = [decode_key(r.sample_key), *([decode_key(r.subsample_key)] if nested else [])]
                save(from_row(r.value_kind, r.dtype, r.shape, r.data, r.text), path(*keys), keys[-1])
            yield pd.DataFrame({"n": [len(b)]})

    return rows.select("sample_key", "subsample_key", "value_kind", "dtype", "shape", "data", "text").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0
