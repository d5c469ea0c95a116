"""Lookups, slices, local filters, columns zipped to rows, and batches.

``values`` is a column's records with ``sample_key``, ``subsample_key`` and whatever goes with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .algebra import numbered


def point(values: DataFrame, sample: str, subsample: str | None = None) -> DataFrame:
    """Rows of one encoded key; both filters reach the scan."""
    out = values.where(F.col("sample_key") == sample)
    return out if subsample is None else out.where(F.col("subsample_key") == subsample)


def multi_get(requested: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Requested rows (pos and keys) with their values, null where there are none; ordered by pos is up to the caller."""
    return requested.join(values.withColumn("_there", F.lit(True)), keys, "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there")


def fetch_selection(requested: DataFrame, values: DataFrame) -> DataFrame:
    """Values of requested (col, sample_key, subsample_key); a null subsample_key asks for all of the sample."""
    r = requested.select(F.col("col").alias("_c"), F.col("sample_key").alias("_s"), F.col("subsample_key").alias("_u")).distinct()
    on = (F.col("col") == F.col("_c")) & (F.col("sample_key") == F.col("_s")) & (F.col("_u").isNull() | (F.col("_u") == F.col("subsample_key")))
    return values.join(r, on, "left_semi")


def subsample_map(values: DataFrame, value: str) -> DataFrame:
    """Of each sample the map from subsample key to value."""
    return values.groupBy("sample_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("subsample_key", F.col(value).alias("value"))))).alias("subsamples"))


def subsample_slice(values: DataFrame, start: int | None, stop: int | None, step: int | None = None) -> DataFrame:
    """Subsamples of each sample at positions start, start + step, ... before stop, in key order; bounds as in Python.

    Window partitions are samples, so a sample's subsamples meet in one task and samples spread.
    """
    if step is not None and step < 1:
        raise ValueError("a step must be 1 or more")
    own = Window.partitionBy("sample_key")
    out = values.withColumn("_p", F.row_number().over(own.orderBy("subsample_key")) - 1).withColumn("_n", F.count("*").over(own))
    edge = lambda v, default: F.lit(default) if v is None else F.lit(v) if v >= 0 else F.greatest(F.col("_n") + v, F.lit(0))
    low, high = edge(start, 0), F.col("_n") if stop is None else edge(stop, 0)
    return out.where((F.col("_p") >= low) & (F.col("_p") < high) & ((F.col("_p") - low) % (step or 1) == 0)).drop("_p", "_n")


def local_only(records: DataFrame, objects: DataFrame) -> DataFrame:
    """Records whose payload is in the objects table."""
    return records.join(objects.select("digest"), "digest", "left_semi")


def remote_only(records: DataFrame, objects: DataFrame) -> DataFrame:
    """Records known only by digest."""
    return records.join(objects.select("digest"), "digest", "left_anti")


def local_samples(records: DataFrame, objects: DataFrame) -> DataFrame:
    """Sample keys of a nested column none of whose subsamples is remote."""
    marked = records.join(objects.select("digest").distinct().withColumn("_local", F.lit(True)), "digest", "left")
    return marked.groupBy("sample_key").agg(F.bool_and(F.col("_local").isNotNull()).alias("_all")).where("_all").select("sample_key")


def contains_remote(records: DataFrame, objects: DataFrame) -> DataFrame:
    """Of each column whether any record is remote."""
    marked = records.join(objects.select("digest").distinct().withColumn("_local", F.lit(True)), "digest", "left")
    return marked.groupBy("col").agg(F.bool_or(F.col("_local").isNull()).alias("contains_remote"))


def zip_columns(columns: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Rows of equal keys across columns (each with ``value``), as columns named by the dictionary."""
    out = None
    for name, df in columns.items():
        own = df.select(*keys, F.col("value").alias(name))
        out = own if out is None else out.join(own, keys)
    return out


def key_mismatch(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two columns has, and which: ``left`` or ``right``."""
    both = a.select(*keys, F.lit(1).alias("_a")).join(b.select(*keys, F.lit(1).alias("_b")), keys, "full_outer").where("_a IS NULL OR _b IS NULL")
    return both.select(*keys, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))


def batches(rows: DataFrame, order: list[str], size: int, drop_last: bool = False) -> DataFrame:
    """Rows with their batch number, ``size`` in each but the last, which may be dropped if short."""
    if size < 1:
        raise ValueError("a batch has one row at least")
    out = numbered(rows, order).withColumn("batch", F.floor(F.col("position") / size).cast("long"))
    if drop_last:
        whole = rows.count() // size
        out = out.where(F.col("batch") < whole)
    return out


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Rows in an order drawn by seed."""
    return rows.orderBy(F.rand(seed))
