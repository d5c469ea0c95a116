import random

import pytest
from pyspark.sql import functions as F

from strataframe.operators import access, algebra, history, integrity

K = ["k"]


def snap(spark, d):
    return spark.createDataFrame(list(d.items()), "k string, digest string")


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


#: base, mine, theirs -> merged digest, or the conflict's type.
TABLE = [
    (None, None, "B", "B"), (None, "B", None, "B"), (None, "B", "B", "B"), (None, "B", "C", "t1"),
    ("A", "A", "A", "A"), ("A", None, "A", None), ("A", "A", None, None), ("A", "B", "A", "B"), ("A", "A", "B", "B"),
    ("A", "B", "B", "B"), ("A", "B", "C", "t3"), ("A", None, "B", "t21"), ("A", "B", None, "t22"), ("A", None, None, None),
]


def test_truth_table_of_merges(spark):
    sides = [snap(spark, {f"k{i}": row[s] for i, row in enumerate(TABLE) if row[s]}) for s in range(3)]
    clash = dict(rows(algebra.conflicts(*sides, K), "k", "conflict"))
    merged = dict(rows(algebra.merge(*sides, K), "k", "digest"))
    for i, (_, mine, _, want) in enumerate(TABLE):
        if want in ("t1", "t21", "t22", "t3"):
            assert clash.get(f"k{i}") == want and merged.get(f"k{i}") == mine
        else:
            assert f"k{i}" not in clash and merged.get(f"k{i}") == want


@pytest.mark.parametrize("seed", range(4))
def test_random_changes(spark, seed):
    r = random.Random(seed)
    base = {f"k{i}": r.choice("AB") for i in range(40)}

    def changed():
        out = dict(base)
        for k in r.sample(sorted(base), 12):
            if r.random() < 0.4:
                out.pop(k)
            else:
                out[k] = r.choice("ABC")
        out.update({f"n{r.randrange(9)}": r.choice("ABC") for _ in range(4)})
        return out

    mine, theirs = changed(), changed()
    b, m, t = (snap(spark, x) for x in (base, mine, theirs))
    d = algebra.diff(b, m, K)
    assert rows(algebra.apply_changes(b, d, K), "k", "digest") == set(mine.items())
    assert algebra.diff(m, m, K).isEmpty()
    clash, merged = dict(rows(algebra.conflicts(b, m, t, K), "k", "conflict")), dict(rows(algebra.merge(b, m, t, K), "k", "digest"))
    for k in {*base, *mine, *theirs}:
        x, y, z = base.get(k), mine.get(k), theirs.get(k)
        if y != x and z != x and y != z:
            assert k in clash
        else:
            assert k not in clash and merged.get(k) == (z if z != x else y)


def test_diff_direction(spark):
    a, b = snap(spark, {"x": "1", "y": "1"}), snap(spark, {"y": "2", "z": "1"})
    assert rows(algebra.diff(a, b, K), "k", "change", "digest") == {("x", "deleted", "1"), ("y", "mutated", "2"), ("z", "added", "1")}
    assert rows(algebra.diff(b, a, K), "k", "change", "digest") == {("x", "added", "1"), ("y", "mutated", "1"), ("z", "deleted", "1")}


def test_last_and_first(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert rows(algebra.last_write(df, K, ["n"]), "k", "v") == {("a", "y"), ("b", "z")}
    assert rows(algebra.first_occurrence(df, "k", "n"), "k", "n") == {("a", 1), ("b", 1)}


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_numbered(spark, n):
    df = spark.range(n).select((F.col("id") * 3).alias("k"))
    got = algebra.numbered(df, ["k"]).orderBy("k").collect()
    assert [r.position for r in got] == list(range(n))
    text = spark.range(n).select(F.format_string("%06d", "id").alias("k"))
    assert [r.position for r in algebra.numbered(text, ["k"]).orderBy("k").collect()] == list(range(n))


def test_batches(spark):
    df = spark.range(20)
    sizes = lambda out: sorted(r["count"] for r in out.groupBy("batch").count().collect())
    assert sizes(access.batches(df, ["id"], 6)) == [2, 6, 6, 6]
    assert sizes(access.batches(df, ["id"], 6, drop_last=True)) == [6, 6, 6]


@pytest.mark.parametrize("cut", [(None, None, None), (1, 3, None), (-2, None, None), (0, -1, 2), (5, 1, None)])
def test_slices_are_pythons(spark, cut):
    subs = [f"u{i}" for i in range(5)]
    df = spark.createDataFrame([("s", u) for u in subs], "sample_key string, subsample_key string")
    assert sorted(r.subsample_key for r in access.subsample_slice(df, *cut).collect()) == subs[slice(*cut)]


def test_zip_and_mismatch(spark):
    a, b = spark.createDataFrame([("1", 1), ("2", 2)], "k string, value int"), spark.createDataFrame([("2", 20), ("3", 30)], "k string, value int")
    assert rows(access.zip_columns({"a": a, "b": b}, K), "k", "a", "b") == {("2", 2, 20)}
    assert rows(access.key_mismatch(a, b, K), "k", "side") == {("1", "left"), ("3", "right")}


DAG = {"r": [], "a": ["r"], "b": ["r"], "m": ["a", "b"], "c": ["b"]}
TIMES = {"r": 0.0, "a": 1.0, "b": 2.0, "m": 3.0, "c": 4.0}


def test_history(spark):
    assert set(history.ancestors(DAG, "m")) == {"m", "a", "b", "r"}
    assert history.common_ancestor(DAG, TIMES, "m", "c") == "b"
    assert history.log_order(DAG, TIMES, "m") == ["m", "b", "a", "r"]
    with pytest.raises(KeyError):
        history.expand_digest(["ab", "ac"], "a")
    with pytest.raises(KeyError):
        history.expand_digest(["ab", "ac"], "aa")
    assert history.expand_digest(["ab", "ac"], "ab") == "ab"


def test_integrity(spark):
    commits = spark.createDataFrame([("a", []), ("b", ["a", "x"])], "digest string, parents array<string>")
    assert rows(integrity.parents_missing(commits), "digest", "parent") == {("b", "x")}
    assert rows(integrity.roots(commits), "digest") == {("a",)}


def test_parts_are_even_on_a_hot_first_column(spark):
    """Half of the rows have one first key, text keys many duplicates: no part holds much more than its share."""
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), "id")
    bounds = algebra.range_bounds(df, ["k", "id"], 16, 40_000)
    sizes = [r["count"] for r in df.groupBy(algebra.range_part(df, ["k", "id"], bounds).alias("p")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 40_000 / 16
    got = algebra.numbered(df, ["k", "id"], parts=16).orderBy("k", "id").select("position").collect()
    assert [r.position for r in got] == list(range(40_000))
    nulls = spark.range(100).select(F.when(F.col("id") > 50, F.col("id")).alias("a"), "id")
    assert sorted(r.position for r in algebra.numbered(nulls, ["a", "id"], parts=4).collect()) == list(range(100))


def test_long_and_wide_graphs(spark):
    line = spark.range(1, 3000).select(F.col("id").cast("string").alias("digest"), (F.col("id") - 1).cast("string").alias("parent"))
    assert history.ancestors_table(spark, line, "2999").count() == 3000
    ladder = line.unionByName(spark.range(2, 3000).select(F.col("id").cast("string").alias("digest"), (F.col("id") - 2).cast("string").alias("parent")))
    assert history.ancestors_table(spark, ladder, "2999").count() == 3000
