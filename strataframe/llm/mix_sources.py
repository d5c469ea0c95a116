"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training progress t from 0 to 1, linear between knots. Its integral is the
source's weight; the words to share out are split by these weights, a source's target stopping at ``max_repeats``
times its size and the excess going to the others by weight. A source's cumulative demand at t is its target times
the share of its schedule's integral up to t. Documents of a source stand in an order drawn by hashing ids; the words
before a document, through as many passes as the target needs, are the demand at which training reaches it, and
inverting the demand gives its training position. ``by_position`` range-sorts documents by that.

A source may hold any share of the rows: each is dealt by hash into ``BUCKETS`` parts, part sums are merged on the
map side, and words before a document are those of the parts before its own (one small row a part) and those before
it within the part. Only the columns to keep travel. The targets are worked out in one task on one small row a source, so the
source must be a column of up to some millions of values, such as a crawl, a site or a kind of text.

The document at a target's end is taken up to the target's word, so what a source gives is its target, rounded;
``mixed_documents``, whose texts stay whole, takes it in full or not at all, whichever is nearer.

Edge cases: a null text has size 0 and is taken 0 times; a null source is a source, last in order; null ids and ties
of the hash are ordered by id, size and a hash of the text; repeated rows are documents of their own; a very long text
is a size like others; with no words at all all targets
are 0; an empty table gives an empty result; equally named columns give way to the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words

#: Hash parts of each source: three hex digits.
BUCKETS = 4096
#: Weights by the order of sources, repeating, and the schedules whose integrals they are, as (t, weight) knots.
WEIGHTS = [5, 2, 1]
SCHEDULES = [[(0.0, 7.5), (1.0, 2.5)], [(0.0, 2.0), (1.0, 2.0)], [(0.0, 0.5), (1.0, 1.5)]]
SHARE, MAX_REPEATS = 1.5, 2
MADE = ["size", "source_size", "target", "taken", "position", "positions"]


def _integrals(knots: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """Pieces of a schedule: start, length, weights at both ends, integral before."""
    out, before = [], 0.0
    for (a, wa), (b, wb) in zip(knots, knots[1:], strict=False):
        out.append((a, b - a, wa, wb, before))
        before += (wa + wb) / 2 * (b - a)
    return [*out, (knots[-1][0], 0.0, knots[-1][1], knots[-1][1], before)]


def targets(sizes: DataFrame, schedules=SCHEDULES, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From (source, source_size), one row a source: schedule number k, target.

    Sources sorted by the level at which they fill up: the first whose fair share, once those before it are full,
    lies below its limit gives the level for all.
    """
    all_rows = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(_integrals(s)[-1][4]) for s in schedules]), F.col("k") + 1)
    out = sizes.withColumn("k", ((F.row_number().over(all_rows.orderBy(F.asc_nulls_last("source"))) - 1) % len(schedules)).cast("int"))
    out = out.withColumn("w", weight).withColumn("cap", (F.lit(max_repeats) * F.col("source_size")).cast("double"))
    before = all_rows.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("all", F.lit(share) * F.sum(F.col("source_size").cast("double")).over(all_rows)).withColumn("all_w", F.sum("w").over(all_rows))
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    out = out.withColumn("level", level)
    level = F.min_by(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level")), F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "source"))).over(all_rows)
    return out.select("source", "source_size", "k", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def position(demand: Column, target: Column, k: Column, schedules=SCHEDULES) -> Column:
    """Training progress at which the source's cumulative demand reaches ``demand``."""

    def inverse(knots: list[tuple[float, float]]) -> Column:
        pieces = _integrals(knots)
        area = demand / target * F.lit(pieces[-1][4])
        out = None
        for a, h, wa, wb, before in reversed(pieces[:-1]):
            rest = area - before
            x = 2.0 * rest / (wa + F.sqrt(F.greatest(wa * wa + 2.0 * ((wb - wa) / h) * rest, F.lit(0.0))))
            out = a + x if out is None else F.when(area < pieces[pieces.index((a, h, wa, wb, before)) + 1][4], a + x).otherwise(out)
        return out

    out = inverse(schedules[0])
    for i, knots in enumerate(schedules[1:], 1):
        out = F.when(k == i, inverse(knots)).otherwise(out)
    return F.when(target > 0, out)


def mix(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", source: str = "source", text: str = "text", schedules=SCHEDULES, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Columns ``keep`` of ``docs`` with size, source_size, target, taken, position (of the first copy), positions."""
    draw = F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("keep"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source"), n_words(F.col(f"`{text}`")).alias("size"), F.xxhash64(F.col(f"`{text}`")).alias("tie"), draw.alias("draw"))
    base = base.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("bucket", F.substr("draw", F.lit(1), F.lit(3)))
    parts = base.groupBy("key", "source", "bucket").agg(F.sum("size").alias("part"))
    plan = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), schedules, share, max_repeats)
    plan = plan.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "source_size", "k", "target")
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "bucket", F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("before")).join(plan, "key")
    within = Window.partitionBy("key", "bucket").orderBy("draw", F.asc_nulls_first("id"), "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    out = base.join(parts, ["key", "bucket"]).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    budget = F.round("target").cast("long")
    copies = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: F.struct((F.col("start") + e * F.col("source_size")).alias("at")))
    copies = F.transform(copies, lambda c: F.struct(c["at"].alias("at"), F.greatest(F.least(budget - c["at"], F.col("size")), F.lit(0)).alias("words")))
    out = out.withColumn("copies", F.filter(copies, lambda c: c["words"] > 0))
    positions = F.transform("copies", lambda c: F.struct(position(c["at"].cast("double"), F.col("target"), F.col("k"), schedules).alias("position"), c["words"].alias("words")))
    out = out.withColumn("positions", positions)
    taken = F.aggregate("positions", F.lit(0).cast("long"), lambda s, p: s + p["words"])
    return out.select(*[F.col("keep")[c].alias(c) for c in keep if c.lower() not in MADE], "size", "source_size", "target", taken.alias("taken"), F.get("positions", F.lit(0))["position"].alias("position"), "positions")


def by_position(df: DataFrame, *ties: str) -> DataFrame:
    """``df`` range-sorted by position; ``ties`` also keep rows without a position from meeting in one range."""
    order = [F.asc_nulls_last("position"), *ties]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents of the mix with the columns of ``docs``, in training order, one row a copy.

    Texts stay whole: the copy at a source's target is in if half of its words or more are within the target. Null,
    empty and blank texts have no words and are in no mix; repeated rows are documents of their own; an empty table
    gives an empty result; columns of any name are returned as they are.
    """
    out = mix(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text")), keep=["whole", "doc_id"])
    out = out.select("whole", "doc_id", "size", F.explode("positions").alias("copy")).where(2 * F.col("copy")["words"] >= F.col("size"))
    out = by_position(out.select("whole", "doc_id", F.col("copy")["position"].alias("position")), "doc_id")
    return out.select(*[F.col("whole")[c].alias(c) for c in docs.columns])
