"""Queries of the dataset engine over test tables, each with its SQL twin.

Snapshots are derived from a table by rules, so that Spark and any SQL engine build the same ones.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, keys, tensors
from ..functions.schemas import ColumnSchema
from ..operators import access, algebra, history, integrity
from ..session import ship
from .repository import Repository

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_own: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- versions of orders -----------------------------------------------------------------------------------------

_BASE = "o_orderkey % 10 <> 0"
_MINE = "(o_orderkey % 10 <> 0 OR o_orderkey % 20 = 0) AND o_orderkey % 13 <> 0"
_THEIRS = "(o_orderkey % 10 <> 0 OR o_orderkey % 30 = 0) AND o_orderkey % 17 <> 0"
_MARKS = {"base": "''", "mine": "CASE WHEN o_orderkey % 7 = 0 THEN 'm' ELSE '' END", "theirs": "CASE WHEN o_orderkey % 11 = 0 THEN 'd' ELSE '' END"}
_PICKS = {"base": _BASE, "mine": _MINE, "theirs": _THEIRS}
_SQL_VERSIONS = "WITH " + ", ".join(
    f"{v} AS (SELECT o_orderkey AS k, sha256(o_orderstatus || '|' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '|' || {_MARKS[v]}) AS d FROM orders WHERE {_PICKS[v]})" for v in ("base", "mine", "theirs")
)


def version(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Records of orders at a version: base, mine or theirs."""
    o = _t(spark, sf_dir, "orders").where(_PICKS[name])
    body = F.concat_ws("|", "o_orderstatus", F.expr("CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"), F.expr(_MARKS[name]))
    return o.select(F.col("o_orderkey").alias("k"), F.sha2(body, 256).alias("digest"))


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.diff(version(spark, sf_dir, "base"), version(spark, sf_dir, "mine"), ["k"])


_SQL_DIFF = _SQL_VERSIONS + """, changes AS (
  SELECT coalesce(b.k, h.k) AS k, CASE WHEN b.k IS NULL THEN 'added' WHEN h.k IS NULL THEN 'deleted' ELSE 'mutated' END AS change, coalesce(h.d, b.d) AS digest
  FROM base b FULL OUTER JOIN mine h ON b.k = h.k WHERE b.d IS DISTINCT FROM h.d)
"""
for _change in ("added", "deleted", "mutated"):
    query(f"diff_{_change}", _SQL_DIFF + f"SELECT k, digest FROM changes WHERE change = '{_change}'")(lambda s, d, c=_change: _two(s, d).where(F.col("change") == c).select("k", "digest"))


@query("diff_all", _SQL_DIFF + "SELECT k, change, digest FROM changes")
def diff_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir)


@query("diff_counts", _SQL_DIFF + "SELECT change, count(*) AS n FROM changes GROUP BY change")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.diff_counts(_two(spark, sf_dir))


_FF = """SELECT '{0}' AS direction, CASE WHEN b.k IS NULL THEN 'added' WHEN h.k IS NULL THEN 'deleted' ELSE 'mutated' END AS change, count(*) AS n
FROM {1} b FULL OUTER JOIN {2} h ON b.k = h.k WHERE b.d IS DISTINCT FROM h.d GROUP BY ALL"""


@query("diff_ff_vs_diverged", _SQL_VERSIONS + _FF.format("fast-forward", "mine", "theirs") + " UNION ALL " + _FF.format("diverged", "theirs", "mine"))
def diff_ff_vs_diverged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fast-forward diff goes from here to there, a diverged one from there to here."""
    mine, theirs = version(spark, sf_dir, "mine"), version(spark, sf_dir, "theirs")
    one = algebra.diff_counts(algebra.diff(mine, theirs, ["k"])).select(F.lit("fast-forward").alias("direction"), "change", "n")
    return one.unionByName(algebra.diff_counts(algebra.diff(theirs, mine, ["k"])).select(F.lit("diverged").alias("direction"), "change", "n"))


_SQL_SCHEMAS = """WITH base AS (SELECT p_type AS col, '1=' || sha256(min(p_brand)) AS d FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_type),
head AS (SELECT p_type AS col, '1=' || sha256(min(p_brand)) AS d FROM part WHERE p_partkey % 5 <> 0 GROUP BY p_type)
SELECT coalesce(b.col, h.col) AS col, CASE WHEN b.col IS NULL THEN 'added' WHEN h.col IS NULL THEN 'deleted' ELSE 'mutated' END AS change, coalesce(h.d, b.d) AS digest
FROM base b FULL OUTER JOIN head h ON b.col = h.col WHERE b.d IS DISTINCT FROM h.d"""


@query("diff_schema_changes", _SQL_SCHEMAS)
def diff_schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema records, one for each type of part, are diffed as all others."""
    p = _t(spark, sf_dir, "part")
    schemas = lambda rows: rows.groupBy(F.col("p_type").alias("col")).agg(F.concat(F.lit("1="), F.sha2(F.min("p_brand"), 256)).alias("digest"))
    return algebra.diff(schemas(p.where("p_partkey % 3 <> 0")), schemas(p.where("p_partkey % 5 <> 0")), ["col"])


_SQL_THREE = _SQL_VERSIONS + """, three AS (
  SELECT coalesce(b.k, m.k, t.k) AS k, b.d AS b, m.d AS m, t.d AS t FROM base b FULL OUTER JOIN mine m ON b.k = m.k FULL OUTER JOIN theirs t ON t.k = coalesce(b.k, m.k)
), clash AS (
  SELECT k, CASE WHEN b IS NULL THEN 't1' WHEN m IS NULL THEN 't21' WHEN t IS NULL THEN 't22' ELSE 't3' END AS conflict FROM three
  WHERE m IS DISTINCT FROM b AND t IS DISTINCT FROM b AND m IS DISTINCT FROM t)
"""


def _three(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [version(spark, sf_dir, v) for v in ("base", "mine", "theirs")]


@query("conflicts_all", _SQL_THREE + "SELECT k, conflict FROM clash")
def conflicts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.conflicts(*_three(spark, sf_dir), ["k"])


@query("conflict_counts", _SQL_THREE + "SELECT conflict, count(*) AS n FROM clash GROUP BY conflict")
def conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.conflicts(*_three(spark, sf_dir), ["k"]).groupBy("conflict").agg(F.count("*").alias("n"))


@query("merge_three_way", _SQL_THREE + "SELECT k, digest FROM (SELECT k, CASE WHEN t IS DISTINCT FROM b AND (m IS NOT DISTINCT FROM b OR m IS NOT DISTINCT FROM t) THEN t ELSE m END AS digest FROM three) WHERE digest IS NOT NULL")
def merge_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theirs where only they changed a key, else mine; keys in conflict keep mine here, where a repository would refuse."""
    return algebra.merge(*_three(spark, sf_dir), ["k"])


# --- changes of customer ----------------------------------------------------------------------------------------

_SQL_CUSTOMER = """WITH base AS (SELECT c_custkey AS k, sha256(c_name || '|' || c_mktsegment) AS d FROM customer WHERE c_custkey % 3 <> 0),
changes AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'added' WHEN c_custkey % 5 = 0 THEN 'deleted' ELSE 'mutated' END AS change, sha256(c_name || '|changed') AS d FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0)
"""


def _customer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = _t(spark, sf_dir, "customer")
    base = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("digest"))
    change = F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'added' WHEN c_custkey % 5 = 0 THEN 'deleted' ELSE 'mutated' END").alias("change")
    return base, c.where("c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0").select(F.col("c_custkey").alias("k"), change, F.sha2(F.concat(F.col("c_name"), F.lit("|changed")), 256).alias("digest"))


@query("apply_changes", _SQL_CUSTOMER + "SELECT k, d AS digest FROM base WHERE k NOT IN (SELECT k FROM changes) UNION ALL SELECT k, d FROM changes WHERE change <> 'deleted'")
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.apply_changes(*_customer(spark, sf_dir), ["k"])


@query("staged_status", _SQL_CUSTOMER + "SELECT change, count(*) AS n FROM changes GROUP BY change")
def staged_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, changes = _customer(spark, sf_dir)
    return algebra.diff_counts(algebra.diff(base, algebra.apply_changes(base, changes, ["k"]), ["k"]))


_SQL_RECORDS = "WITH r AS (SELECT sha256('f|customer|#' || CAST(c_custkey AS VARCHAR) || '||' || sha256(c_name || '|' || c_mktsegment)) AS h FROM customer), p AS (SELECT substring(h, 1, 4) AS part, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM r GROUP BY 1) SELECT sha256(string_agg(d, '' ORDER BY part)) AS refs_digest, CAST(sum(n) AS BIGINT) AS n_records FROM p"


@query("commit_refs_digest", _SQL_RECORDS)
def commit_refs_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a snapshot, in two levels."""
    c = _t(spark, sf_dir, "customer").select(F.lit("f").alias("kind"), F.lit("customer").alias("col"), keys.encoded(F.col("c_custkey"), True).alias("sample_key"), F.lit("").alias("subsample_key"), F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("digest"))
    return digests.refs_digest(digests.record_hash(c), c)


# --- content ----------------------------------------------------------------------------------------------------


@query("content_digest_str", "SELECT doc_id, '2=' || sha256(text) AS digest FROM documents")
def content_digest_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", digests.text_digest(F.col("text")).alias("digest"))


@query("content_digest_bytes", "SELECT page_id, '3=' || sha256(html) AS digest FROM pages")
def content_digest_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", digests.bytes_digest(F.encode("html", "utf-8")).alias("digest"))


@query("dedup_objects", "SELECT DISTINCT '2=' || sha256(text) AS digest FROM documents")
def dedup_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_digest_str(spark, sf_dir).select("digest").distinct()


@query("dedup_ratio", "SELECT count(*) AS n, count(DISTINCT sha256(text)) AS n_objects FROM documents")
def dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted in two steps, so that the distinct digests spread instead of meeting in one task."""
    per = content_digest_str(spark, sf_dir).groupBy("digest").agg(F.count("*").alias("c"))
    return per.agg(F.sum("c").cast("long").alias("n"), F.count("*").alias("n_objects"))


@query("first_occurrence", "SELECT '2=' || sha256(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.first_occurrence(content_digest_str(spark, sf_dir), "digest", "doc_id")


@query("import_new_only", "SELECT DISTINCT '2=' || sha256(text) AS digest FROM benchmark WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents)")
def import_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _t(spark, sf_dir, "benchmark").select("item_id", digests.text_digest(F.col("text")).alias("digest"))
    return algebra.new_only(steps, content_digest_str(spark, sf_dir)).select("digest")


@query("intersect_digests", "SELECT sha256(c_mktsegment) AS digest FROM customer INTERSECT SELECT sha256(c_mktsegment) FROM customer WHERE c_custkey % 2 = 0")
def intersect_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").withColumn("digest", F.sha2("c_mktsegment", 256))
    return algebra.present(c, c.where("c_custkey % 2 = 0"))


@query("missing_digests_push", "SELECT DISTINCT sha256(text) AS digest FROM documents WHERE doc_id % 2 = 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1)")
def missing_digests_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return algebra.missing(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"))


@query("missing_digests_fetch", "SELECT DISTINCT sha256(text) AS digest FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def missing_digests_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return algebra.missing(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"))


# --- keys and schemas -------------------------------------------------------------------------------------------


@query("key_encode_order", "SELECT '#' || CAST(p_partkey AS VARCHAR) AS sample_key, p_partkey AS key, row_number() OVER (ORDER BY '#' || CAST(p_partkey AS VARCHAR)) - 1 AS position FROM part")
def key_encode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer keys order as their stored form."""
    p = _t(spark, sf_dir, "part").select(keys.encoded(F.col("p_partkey"), True).alias("sample_key"))
    return algebra.numbered(p, ["sample_key"]).select("sample_key", keys.decoded_int(F.col("sample_key")).alias("key"), "position")


@query("key_valid_filter", "SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z0-9_.\\-]{1,64}') AS name_legal, regexp_full_match(p_brand, '[A-Za-z0-9_.\\-]{1,64}') AS brand_legal FROM part")
def key_valid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", keys.legal(F.col("p_name")).alias("name_legal"), keys.legal(F.col("p_brand")).alias("brand_legal"))


@query("schema_violations", """SELECT 'text ' || CAST(doc_id AS VARCHAR) AS row, CASE WHEN n_chars % 7 = 0 THEN 'no value' END AS violation FROM documents
UNION ALL SELECT 'vector ' || CAST(vec_id AS VARCHAR), CASE WHEN vec_id % 5 = 0 THEN 'element type' WHEN vec_id % 3 = 0 THEN 'shape over the largest' END FROM embeddings""")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of a text column and of a tensor column on rows some of which lack a value, are too long or of another type."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("dtype", "string"), ("shape", "array<int>"), ("data", "binary"))]
    d = _t(spark, sf_dir, "documents").select(F.concat(F.lit("text "), "doc_id").alias("row"), F.lit("str").alias("kind"), *none, F.when(F.col("n_chars") % 7 != 0, F.col("text")).alias("text"))
    e = _t(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("vector "), "vec_id").alias("row"), F.lit("ndarray").alias("kind"), F.when(F.col("vec_id") % 5 == 0, "float64").otherwise("float32").alias("dtype"),
        F.when(F.col("vec_id") % 3 == 0, F.array(F.lit(65))).otherwise(F.array(F.lit(64))).alias("shape"), F.lit(b"").alias("data"), F.lit(None).cast("string").alias("text"))
    texts, vectors = ColumnSchema("str"), ColumnSchema("ndarray", dtype="float32", shape=(64,))
    return d.select("row", texts.violation().alias("violation")).unionByName(e.select("row", vectors.violation().alias("violation")))


# --- lookups ----------------------------------------------------------------------------------------------------

_ASKED = [(0, 7), (1, 3), (2, 999_999_999), (3, 7), (4, 32)]
_VALUES = ", ".join(f"({p}, {k})" for p, k in _ASKED)


@query("point_lookup", "SELECT '#' || CAST(o_orderkey AS VARCHAR) AS sample_key, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _t(spark, sf_dir, "orders").select(keys.encoded(F.col("o_orderkey"), True).alias("sample_key"), "o_custkey", "o_orderstatus")
    return access.point(values, keys.encode_key(7))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.createDataFrame(_ASKED, "pos int, o_orderkey long")
    return access.multi_get(r, _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"])


@query("multi_get_strict", f"SELECT pos, r.k AS o_orderkey, o_orderpriority FROM (VALUES {_VALUES}) r(pos, k) JOIN orders ON o_orderkey = r.k")
def multi_get_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).where("found").select("pos", "o_orderkey", "o_orderpriority")


@query("multi_get_default", f"SELECT pos, CAST(r.k AS BIGINT) AS o_orderkey, coalesce(o_orderpriority, 'none') AS o_orderpriority FROM (VALUES {_VALUES}) r(pos, k) LEFT JOIN orders ON o_orderkey = r.k")
def multi_get_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("pos", "o_orderkey", F.coalesce("o_orderpriority", F.lit("none")).alias("o_orderpriority"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a nested text column: conv_id -> turn -> text."""
    c = _t(spark, sf_dir, "conversations")
    return c.select(F.lit("conversations").alias("col"), keys.encoded(F.col("conv_id"), True).alias("sample_key"), keys.encoded(F.col("turn"), True).alias("subsample_key"), F.sha2("text", 256).alias("digest"), "text")


_SQL_NESTED = "WITH v AS (SELECT '#' || CAST(conv_id AS VARCHAR) AS sample_key, '#' || CAST(turn AS VARCHAR) AS subsample_key, text, sha256(text) AS digest, conv_id FROM conversations) "


@query("nested_counts", "SELECT count(*) AS n_subsamples, count(DISTINCT conv_id) AS n_samples FROM conversations")
def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _nested(spark, sf_dir).groupBy("sample_key").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").cast("long").alias("n_subsamples"), F.count("*").alias("n_samples"))


@query("nested_sample_len", _SQL_NESTED + "SELECT sample_key, count(*) AS n FROM v GROUP BY sample_key")
def nested_sample_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).groupBy("sample_key").agg(F.count("*").alias("n"))


@query("nested_ellipsis", _SQL_NESTED + "SELECT sample_key, string_agg(subsample_key || '=' || substring(digest, 1, 8), ',' ORDER BY subsample_key) AS subsamples FROM v GROUP BY sample_key")
def nested_ellipsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All subsamples of each sample, as a map, shown as text."""
    m = access.subsample_map(_nested(spark, sf_dir).withColumn("short", F.substr("digest", F.lit(1), F.lit(8))), "short")
    return m.select("sample_key", F.array_join(F.transform(F.map_entries("subsamples"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("subsamples"))


@query("nested_slice", _SQL_NESTED + "SELECT sample_key, subsample_key, digest FROM (SELECT *, row_number() OVER (PARTITION BY sample_key ORDER BY subsample_key) - 1 AS p FROM v) WHERE p >= 1 AND p < 4 AND (p - 1) % 2 = 0")
def nested_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.subsample_slice(_nested(spark, sf_dir), 1, 4, 2).select("sample_key", "subsample_key", "digest")


@query("fetch_samples_wildcard", _SQL_NESTED + "SELECT sample_key, subsample_key, digest FROM v WHERE sample_key IN ('#1', '#3') OR (sample_key = '#2' AND subsample_key = '#0')")
def fetch_samples_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.createDataFrame([("conversations", "#1", None), ("conversations", "#3", None), ("conversations", "#2", "#0"), ("other", "#4", None)], "col string, sample_key string, subsample_key string")
    return access.fetch_selection(r, _nested(spark, sf_dir)).select("sample_key", "subsample_key", "digest")


_SQL_LOCAL = "WITH r AS (SELECT doc_id, source AS col, sha256(text) AS digest FROM documents), o AS (SELECT DISTINCT sha256(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) "


def _partial(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records of documents, and the payloads of those that have labels as the only local ones."""
    r = _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("col"), F.sha2("text", 256).alias("digest"))
    return r, r.join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("digest").distinct()


@query("local_keys", _SQL_LOCAL + "SELECT doc_id FROM r WHERE digest IN (SELECT digest FROM o)")
def local_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.local_only(*_partial(spark, sf_dir)).select("doc_id")


@query("remote_keys", _SQL_LOCAL + "SELECT doc_id FROM r WHERE digest NOT IN (SELECT digest FROM o)")
def remote_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.remote_only(*_partial(spark, sf_dir)).select("doc_id")


@query("contains_remote", _SQL_LOCAL + "SELECT col, bool_or(digest NOT IN (SELECT digest FROM o)) AS contains_remote FROM r GROUP BY col")
def contains_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.contains_remote(*_partial(spark, sf_dir))


@query("nested_local_samples", _SQL_NESTED + ", o AS (SELECT DISTINCT digest FROM v WHERE conv_id % 3 <> 0 OR subsample_key = '#0') SELECT sample_key FROM v GROUP BY sample_key HAVING bool_and(digest IN (SELECT digest FROM o))")
def nested_local_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _nested(spark, sf_dir)
    number = keys.decoded_int(F.col("sample_key"))
    return access.local_samples(v, v.where((number % 3 != 0) | (F.col("subsample_key") == "#0")).select("digest").distinct())


# --- rows and batches -------------------------------------------------------------------------------------------


@query("last_write_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return algebra.last_write(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("zip_columns", "SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def zip_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = _t(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("value")), _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("value"))
    return access.zip_columns({"n_chars": d, "quality": q}, ["doc_id"])


@query("zip_key_mismatch", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'right' END AS side FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def zip_key_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.key_mismatch(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), ["doc_id"])


_SQL_BATCH = "SELECT vec_id, CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / 64) AS BIGINT) AS batch FROM embeddings"


@query("batches", _SQL_BATCH)
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.batches(_t(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"], 64).select("vec_id", "batch")


@query("batches_drop_last", f"SELECT vec_id, batch FROM ({_SQL_BATCH}) WHERE batch < (SELECT floor(count(*) / 64) FROM embeddings)")
def batches_drop_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.batches(_t(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"], 64, drop_last=True).select("vec_id", "batch")


# --- history ----------------------------------------------------------------------------------------------------

# Parts as commits: part k was made from parts k / 2 and k / 3, at time k.
_SQL_EDGES = "e(c, p) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey >= 2 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 3)"
_SQL_WALK = "{0}(k) AS (SELECT (SELECT max(p_partkey) FROM part) - {1} UNION SELECT e.p FROM {0} JOIN e ON e.c = {0}.k)"


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    p = _t(spark, sf_dir, "part")
    parents = F.array_distinct(F.filter(F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 3)), lambda x: x >= 1))
    edges = p.select(F.col("p_partkey").cast("string").alias("digest"), F.explode_outer(F.transform(parents, lambda x: x.cast("string"))).alias("parent"))
    return edges, p.agg(F.max("p_partkey")).first()[0]


@query("ancestors", f"WITH RECURSIVE {_SQL_EDGES}, {_SQL_WALK.format('w', 0)} SELECT CAST(k AS VARCHAR) AS digest FROM w")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, last = _edges(spark, sf_dir)
    return history.ancestors_table(spark, edges, str(last))


@query("common_ancestor", f"WITH RECURSIVE {_SQL_EDGES}, {_SQL_WALK.format('a', 0)}, {_SQL_WALK.format('b', 1)} SELECT CAST(max(k) AS VARCHAR) AS digest FROM (SELECT k FROM a INTERSECT SELECT k FROM b)")
def common_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, last = _edges(spark, sf_dir)
    graph = history.parents_of(edges)
    return spark.createDataFrame([(history.common_ancestor(graph, {c: float(c) for c in graph}, str(last), str(last - 1)),)], "digest string")


@query("log_order", f"WITH RECURSIVE {_SQL_EDGES}, {_SQL_WALK.format('w', 1)} SELECT row_number() OVER (ORDER BY k DESC) - 1 AS position, CAST(k AS VARCHAR) AS digest FROM w")
def log_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, last = _edges(spark, sf_dir)
    graph = history.parents_of(edges)
    return spark.createDataFrame(list(enumerate(history.log_order(graph, {c: float(c) for c in graph}, str(last - 1)))), "position long, digest string")


@query("head_branch_map", "SELECT 'c' || CAST(c_nationkey AS VARCHAR) AS digest, string_agg(c_name, ',' ORDER BY c_name) AS names FROM customer GROUP BY c_nationkey")
def head_branch_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as branches, their nations as commits."""
    return history.head_names(_t(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.concat(F.lit("c"), "c_nationkey").alias("digest")))


# --- integrity and reports --------------------------------------------------------------------------------------


@query("verify_refs_exist", "SELECT DISTINCT '2=' || sha256(text) AS digest FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 50 <> 0)")
def verify_refs_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose payload was lost: every fiftieth row was not stored."""
    refs = content_digest_str(spark, sf_dir).withColumn("kind", F.lit("f"))
    return integrity.refs_without_object(refs, refs.where("doc_id % 50 <> 0"))


@query("verify_parents_exist", f"WITH {_SQL_EDGES} SELECT CAST(c AS VARCHAR) AS digest, CAST(p AS VARCHAR) AS parent FROM e WHERE p % 17 = 0 AND c % 17 <> 0")
def verify_parents_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventeenth commit was lost."""
    edges, _ = _edges(spark, sf_dir)
    commits = edges.groupBy("digest").agg(F.collect_list("parent").alias("parents")).where("CAST(digest AS BIGINT) % 17 <> 0")
    return integrity.parents_missing(commits)


@query("verify_digest_mismatch", "SELECT '2=' || sha256(text) AS digest, '2=' || sha256(text || ' ') AS found FROM documents WHERE doc_id % 97 = 0")
def verify_digest_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninety-seventh payload was damaged."""
    d = _t(spark, sf_dir, "documents")
    stored = F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("text")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("dtype", "string"), ("shape", "array<int>"), ("data", "binary"))]
    return integrity.objects_changed(d.select(digests.text_digest(F.col("text")).alias("digest"), F.lit("str").alias("kind"), stored, *none))


_COLUMNS = {"customer": "c_custkey", "documents": "doc_id", "embeddings": "vec_id", "orders": "o_orderkey", "pages": "page_id", "part": "p_partkey"}


@query("summary_counts", " UNION ALL ".join(f"SELECT '{t}' AS col, count(*) AS n FROM {t}" for t in _COLUMNS))
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by column, as the summary shows them."""
    out = None
    for t, k in _COLUMNS.items():
        own = _t(spark, sf_dir, t).select(F.lit(t).alias("col"), F.col(k).cast("string").alias("sample_key"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("col").agg(F.count("*").alias("n"))


# --- repositories -----------------------------------------------------------------------------------------------


def _repository(spark: SparkSession) -> Repository:
    repo = Repository(ship(spark), _place(spark))
    repo.init("catalogue", "catalogue@example.org")
    return repo


def _place(spark: SparkSession, what: str = "repository") -> str:
    """A new path in the folder that driver and executors share; of this machine only if all runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="strataframe-"))
    return f"{folder}/{what}-{uuid.uuid4().hex}"


def _texts(rows: DataFrame, key: str, text: F.Column) -> DataFrame:
    none = [F.lit(None).cast(t).alias(n) for n, t in (("dtype", "string"), ("shape", "array<int>"), ("data", "binary"))]
    return rows.select(keys.encoded(F.col(key), True).alias("sample_key"), F.lit("").alias("subsample_key"), F.lit("str").alias("kind"), *none, text.alias("text"))


@query("repo_checkout_scan", "SELECT '#' || CAST(doc_id AS VARCHAR) AS sample_key, '2=' || sha256(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS nbytes FROM documents")
def repo_checkout_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to a column, committed, checked out and read with their values."""
    repo = _repository(spark)
    co = repo.checkout(write=True)
    co.add_str_column("documents").update_dataframe(_texts(_t(spark, sf_dir, "documents"), "doc_id", F.col("text")))
    co.commit("documents")
    co.close()
    return repo.checkout()["documents"].dataframe().select("sample_key", "digest", F.octet_length("text").cast("long").alias("nbytes"))


@query("repo_import_tensors", "SELECT '#' || CAST(vec_id AS VARCHAR) AS sample_key, 64 AS n_values, CAST(label AS BIGINT) AS label FROM embeddings")
def repo_import_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as float32 tensors, digested in bulk, read back decoded and zipped with a second column."""
    repo = _repository(spark)
    e = _t(spark, sf_dir, "embeddings")
    key = [keys.encoded(F.col("vec_id"), True).alias("sample_key"), F.lit("").alias("subsample_key")]
    co = repo.checkout(write=True)
    co.add_ndarray_column("vectors", shape=64, dtype="float32").update_dataframe(e.select(*key, *tensors.from_array(F.col("embedding"))))
    co.add_str_column("labels").update_dataframe(_texts(e, "vec_id", F.col("label").cast("string")))
    co.commit("embeddings")
    co.close()
    now = repo.checkout()
    vectors = now["vectors"].dataframe().select("sample_key", F.size(tensors.to_array("<f4")("data")).alias("value"))
    labels = now["labels"].dataframe().select("sample_key", F.col("text").cast("long").alias("value"))
    return access.zip_columns({"n_values": vectors, "label": labels}, ["sample_key"])


_BODY = "o_orderstatus || '|' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {text})"


@query("repo_merge_orders", f"""WITH o AS (SELECT o_orderkey AS k, {_BODY.format(text='VARCHAR')} AS b FROM orders)
SELECT '#' || CAST(k AS VARCHAR) AS sample_key, '2=' || sha256(CASE WHEN k % 2 = 0 AND k % 7 = 0 AND k % 10 <> 0 THEN b || 'm' WHEN k % 2 = 1 AND k % 11 = 0 THEN b || 'd' ELSE b END) AS digest
FROM o WHERE (k % 10 <> 0 OR k % 20 = 10) AND NOT (k % 26 = 0 AND k % 10 <> 0)""")
def repo_merge_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on two branches that change, delete and add different keys, merged three ways and read at the merge."""
    repo = _repository(spark)
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr(_BODY.format(text="STRING")).alias("b"))

    def land(branch: str, put: DataFrame, gone: DataFrame | None = None) -> None:
        co = repo.checkout(write=True, branch=branch)
        if "orders" not in co:
            co.add_str_column("orders")
        co.column("orders").update_dataframe(put)
        if gone is not None:
            co.column("orders").delete_dataframe(gone)
        co.commit(branch)
        co.close()

    land("master", _texts(o.where("k % 10 <> 0"), "k", F.col("b")))
    repo.create_branch("dev")
    land("master", _texts(o.where("k % 2 = 0 AND k % 7 = 0 AND k % 10 <> 0"), "k", F.concat("b", F.lit("m"))), _texts(o.where("k % 26 = 0 AND k % 10 <> 0"), "k", F.col("b")))
    added = o.where("k % 20 = 10").unionByName(o.where("k % 2 = 1 AND k % 11 = 0").withColumn("b", F.concat("b", F.lit("d"))))
    land("dev", _texts(added, "k", F.col("b")))
    return repo.checkout(commit=repo.merge("both", "master", "dev"))["orders"].records().select("sample_key", "digest")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between two versions of orders, by kind."""
    return diff_counts(spark, sf_dir)
