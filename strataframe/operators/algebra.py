"""Diffs, conflicts, merges and updates of snapshots.

A snapshot is a DataFrame of records: key columns (``keys``) and ``digest``. Equality is equality of digests, never of
values. Absent subsample keys are stored as ``''`` so that all joins are plain equi-joins, which Spark can hash, sort
or bucket; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["kind", "col", "sample_key", "subsample_key"]
ADDED, DELETED, MUTATED = "added", "deleted", "mutated"


def _side(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.select(*keys, F.col("digest").alias(name))


def diff(base: DataFrame, head: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys, change, digest: what turns base into head. A deleted record carries base's digest, others head's."""
    both = _side(base, keys, "_b").join(_side(head, keys, "_h"), keys, "full_outer").where(~F.col("_b").eqNullSafe(F.col("_h")))
    change = F.when(F.col("_b").isNull(), ADDED).when(F.col("_h").isNull(), DELETED).otherwise(MUTATED)
    return both.select(*keys, change.alias("change"), F.coalesce("_h", "_b").alias("digest"))


def diff_counts(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of changes of each kind, by the given columns too."""
    return changes.groupBy(*(by or []), "change").agg(F.count("*").alias("n"))


def three_way(base: DataFrame, mine: DataFrame, theirs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row a key with digests base, mine, theirs (null where absent): the join from which conflicts and merges come."""
    return _side(base, keys, "base").join(_side(mine, keys, "mine"), keys, "full_outer").join(_side(theirs, keys, "theirs"), keys, "full_outer")


def conflict_type() -> Column:
    """Of a row of ``three_way``: t1 both added, t21 deleted here and changed there, t22 the reverse, t3 both changed; null if none.

    The same change on both sides is no conflict.
    """
    b, m, t = F.col("base"), F.col("mine"), F.col("theirs")
    clash = ~m.eqNullSafe(b) & ~t.eqNullSafe(b) & ~m.eqNullSafe(t)
    return F.when(clash, F.when(b.isNull(), "t1").when(m.isNull(), "t21").when(t.isNull(), "t22").otherwise("t3"))


def conflicts(base: DataFrame, mine: DataFrame, theirs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys and conflict type, of keys in conflict."""
    return three_way(base, mine, theirs, keys).select(*keys, conflict_type().alias("conflict")).where(F.col("conflict").isNotNull())


def merged_rows(base: DataFrame, mine: DataFrame, theirs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys, digest, conflict of all keys from one join: the merged digest (null where the key is gone) and the conflict's type (null if none)."""
    rows = three_way(base, mine, theirs, keys).withColumn("conflict", conflict_type())
    theirs_won = ~F.col("theirs").eqNullSafe(F.col("base")) & F.col("conflict").isNull()
    return rows.select(*keys, F.when(theirs_won, F.col("theirs")).otherwise(F.col("mine")).alias("digest"), "conflict")


def merge(base: DataFrame, mine: DataFrame, theirs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The merged snapshot where nothing is in conflict: theirs where they changed a key, else mine. Conflicting keys keep mine."""
    return merged_rows(base, mine, theirs, keys).select(*keys, "digest").where(F.col("digest").isNotNull())


def apply_changes(base: DataFrame, changes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Base with the changes made: every changed key goes, then all but deleted ones come back with their new digest."""
    kept = base.join(changes.select(*keys), keys, "left_anti").select(*keys, "digest")
    return kept.unionByName(changes.where(F.col("change") != DELETED).select(*keys, "digest"))


def last_write(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Of each key the last row by ``order``: one aggregate, merged on the map side, so no key is sorted in one place."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]))
    return rows.groupBy(*keys).agg(best.alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def first_occurrence(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key its least ``order``: (key, order)."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def new_only(rows: DataFrame, known: DataFrame, key: str = "digest") -> DataFrame:
    """One row of each key that ``known`` lacks."""
    return rows.join(known.select(key), key, "left_anti").dropDuplicates([key])


def missing(wanted: DataFrame, have: DataFrame, key: str = "digest") -> DataFrame:
    """Distinct keys wanted that ``have`` lacks."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


def present(wanted: DataFrame, have: DataFrame, key: str = "digest") -> DataFrame:
    """Distinct keys wanted that ``have`` holds."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_semi")


def layout_conflicts(base: DataFrame, mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Columns that both sides created with different layouts: (col). Records are schema records, sample_key the layout."""
    new = lambda side: side.where("kind = 's'").select("col", "sample_key").join(base.where("kind = 's'").select("col"), "col", "left_anti")
    return new(mine).withColumnRenamed("sample_key", "a").join(new(theirs).withColumnRenamed("sample_key", "b"), "col").where("a <> b").select("col").distinct()


#: Rows of a part that one task numbers, and rows sampled for each part's bound.
ROWS_PER_PART, SAMPLED = 1_000_000, 20


def range_bounds(rows: DataFrame, order: list[str], parts: int, n: int) -> list[tuple]:
    """Ascending rows of ``order`` that cut ``rows`` (n of them) into about equal parts, from a sample of SAMPLED rows a part."""
    if parts < 2:
        return []
    sample = rows.select(*order).sample(min(1.0, SAMPLED * parts / n), seed=1).orderBy(*order).collect()
    picked = [tuple(sample[k * len(sample) // parts]) for k in range(1, parts)] if sample else []
    return [b for k, b in enumerate(picked) if not k or b != picked[k - 1]]


def range_part(rows: DataFrame, order: list[str], bounds: list[tuple]) -> Column:
    """How many of the ascending bounds are at or before a row in ``order``, by binary search."""
    if not bounds:
        return F.lit(0)
    kinds = dict(rows.dtypes)
    own = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    listed = F.array(*[F.struct(*[F.lit(v).cast(kinds[c]).alias(f"o{i}") for i, (c, v) in enumerate(zip(order, b, strict=True))]) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(listed, at + step - 1) <= own), at + step).otherwise(at))


def numbered(rows: DataFrame, order: list[str], name: str = "position", parts: int | None = None) -> DataFrame:
    """Rows numbered from 0 by ``order`` without one task seeing all: counts of range parts shift numbers within parts.

    Parts have about ROWS_PER_PART rows, however many that makes, and are cut by all columns of ``order``, so equal first
    columns are split too; ``order`` must be unique for a defined result.
    """
    n = rows.count()
    bounds = range_bounds(rows, order, parts or -(-n // ROWS_PER_PART), n)
    dealt = rows.withColumn("_part", range_part(rows, order, bounds))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return within.join(F.broadcast(shifts), "_part").withColumn(name, (F.col("_k") + F.col("_shift")).cast("long")).drop("_part", "_k", "_shift")
