"""Queries through whole repositories, each with its SQL twin: what a user of ``Repository`` does, over the test tables.

One library repository is built for each session and folder of tables; queries that write work on copies of it. It has

    master  orders: all but every tenth, base bodies; then even multiples of 7 changed, multiples of 26 deleted
    dev     from the first commit: odd multiples of 11 changed, k % 20 = 10 added
            documents (text), pages (bytes), vectors (float32 tensors), talks (nested text) are the same on both
"""

from __future__ import annotations

import hashlib
import itertools
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, tensors
from ..operators import access
from . import reports
from .catalogue import Query, _place, _t, _texts
from .datasets import RowDataset, make_numpy_dataset
from .importer import Output, export_files, import_files, run_bulk_import
from .repository import Repository
from ..session import ship

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_libraries: dict[tuple[str, str], str] = {}
#: Rows that a loop on the driver holds before they are written.
_SEEN = 50_000


def scenario(name: str, sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


# --- the library ------------------------------------------------------------------------------------------------

_BODY = "o_orderstatus || '|' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {0})"
_SQL_ORDERS = f"WITH o AS (SELECT o_orderkey AS k, {_BODY.format('VARCHAR')} AS b FROM orders) "
_BASE, _MINE_PUT, _MINE_GONE = "k % 10 <> 0", "k % 2 = 0 AND k % 7 = 0 AND k % 10 <> 0", "k % 26 = 0 AND k % 10 <> 0"
_DEV_PUT, _DEV_NEW = "k % 2 = 1 AND k % 11 = 0", "k % 20 = 10"
_SQL_VERSIONS = _SQL_ORDERS + f""", base AS (SELECT k, b AS t FROM o WHERE {_BASE}),
mine AS (SELECT k, CASE WHEN {_MINE_PUT} THEN b || 'm' ELSE b END AS t FROM o WHERE {_BASE} AND NOT ({_MINE_GONE})),
dev AS (SELECT k, CASE WHEN {_DEV_PUT} THEN b || 'd' ELSE b END AS t FROM o WHERE {_BASE} OR {_DEV_NEW}) """


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr(_BODY.format("STRING")).alias("b"))


def _nested(rows: DataFrame, sample: str, subsample: str, text) -> DataFrame:
    none = [F.lit(None).cast(t).alias(n) for n, t in (("dtype", "string"), ("shape", "array<int>"), ("data", "binary"))]
    return rows.select(keys.encoded(F.col(sample), True).alias("sample_key"), keys.encoded(F.col(subsample), True).alias("subsample_key"), F.lit("str").alias("kind"), *none, text.alias("text"))


def _land(repo: Repository, branch: str, message: str, put: DataFrame, gone: DataFrame | None = None) -> str:
    co = repo.checkout(write=True, branch=branch)
    try:
        co.column("orders").update_dataframe(put)
        if gone is not None:
            co.column("orders").delete_dataframe(gone)
        return co.commit(message)
    finally:
        co.close()


def _build(spark: SparkSession, sf_dir: str, path: str) -> None:
    repo = Repository(spark, path)
    repo.init("library", "library@example.org")
    o, e, p = _orders(spark, sf_dir), _t(spark, sf_dir, "embeddings"), _t(spark, sf_dir, "pages")
    none = lambda *names: [F.lit(None).cast({"shape": "array<int>", "data": "binary"}.get(n, "string")).alias(n) for n in names]
    co = repo.checkout(write=True)
    co.add_str_column("documents").update_dataframe(_texts(_t(spark, sf_dir, "documents"), "doc_id", F.col("text")))
    co.add_bytes_column("pages").update_dataframe(p.select(keys.encoded(F.col("page_id"), True).alias("sample_key"), F.lit("").alias("subsample_key"), F.lit("bytes").alias("kind"), *none("dtype", "shape"), F.encode("html", "utf-8").alias("data"), *none("text")))
    co.add_ndarray_column("vectors", shape=64, dtype="float32").update_dataframe(e.select(keys.encoded(F.col("vec_id"), True).alias("sample_key"), F.lit("").alias("subsample_key"), *tensors.from_array(F.col("embedding"))))
    co.add_str_column("talks", contains_subsamples=True).update_dataframe(_nested(_t(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("text")))
    co.add_str_column("orders").update_dataframe(_texts(o.where(_BASE), "k", F.col("b")))
    co.commit("base")
    co.close()
    repo.create_branch("dev")
    _land(repo, "master", "mine", _texts(o.where(_MINE_PUT), "k", F.concat("b", F.lit("m"))), _texts(o.where(_MINE_GONE), "k", F.col("b")))
    added = o.where(_DEV_NEW).unionByName(o.where(_DEV_PUT).withColumn("b", F.concat("b", F.lit("d"))))
    _land(repo, "dev", "theirs", _texts(added, "k", F.col("b")))
    repo.checkout(write=True, branch="master").close()


def _library(spark: SparkSession, sf_dir: str) -> Repository:
    ship(spark)
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _libraries or not Repository(spark, _libraries[key]).initialized:
        path = _place(spark, "library")
        _build(spark, sf_dir, path)
        _libraries[key] = path
    return Repository(spark, _libraries[key])


def _copy(spark: SparkSession, sf_dir: str) -> Repository:
    """A copy of the library to write to."""
    source, path = _library(spark, sf_dir), _place(spark, "copy")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source.path), jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
    return Repository(spark, path)


def _clone(spark: SparkSession, sf_dir: str) -> tuple[Repository, Repository]:
    """A copy of the library, and a clone of that with no values yet."""
    origin = _copy(spark, sf_dir)
    mine = Repository(spark, _place(spark, "clone"))
    mine.clone("me", "me@example.org", origin.path)
    return origin, mine


# --- reading ----------------------------------------------------------------------------------------------------


@scenario("repo_flat_texts", "SELECT '#' || CAST(doc_id AS VARCHAR) AS sample_key, sha256(text) AS content, CAST(octet_length(encode(text)) AS BIGINT) AS nbytes FROM documents")
def repo_flat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values themselves, read back through the column."""
    return _library(spark, sf_dir).checkout()["documents"].dataframe().select("sample_key", F.sha2("text", 256).alias("content"), "nbytes")


@scenario("repo_flat_bytes", "SELECT '#' || CAST(page_id AS VARCHAR) AS sample_key, '3=' || sha256(html) AS digest, html AS page FROM pages")
def repo_flat_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _library(spark, sf_dir).checkout()["pages"].dataframe().select("sample_key", "digest", F.decode("data", "utf-8").alias("page"))


@scenario("repo_flat_tensors", "SELECT '#' || CAST(vec_id AS VARCHAR) AS sample_key, CAST(i AS INTEGER) - 1 AS place, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) r(i)")
def repo_flat_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of every tensor, decoded from the stored bytes."""
    rows = _library(spark, sf_dir).checkout()["vectors"].dataframe().select("sample_key", tensors.to_array("<f4")("data").alias("v"))
    return rows.select("sample_key", F.posexplode("v").alias("place", "value")).select("sample_key", "place", F.col("value").cast("double").alias("value"))


@scenario("repo_tensor_digests", "SELECT count(*) AS n, count(DISTINCT embedding) AS n_digests, 'float32' AS dtype, 64 AS length, 256 AS nbytes FROM embeddings")
def repo_tensor_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _library(spark, sf_dir).checkout()["vectors"].dataframe()
    per = rows.groupBy("digest").agg(F.count("*").alias("c"), F.min("dtype").alias("dtype"), F.min(F.element_at("shape", 1)).alias("length"), F.max(F.octet_length("data")).alias("nbytes"))
    return per.agg(F.sum("c").cast("long").alias("n"), F.count("*").alias("n_digests"), F.min("dtype").alias("dtype"), F.max("length").alias("length"), F.max("nbytes").alias("nbytes"))


_SQL_TALKS = "WITH v AS (SELECT '#' || CAST(conv_id AS VARCHAR) AS sample_key, '#' || CAST(turn AS VARCHAR) AS subsample_key, text, conv_id, turn FROM conversations) "


@scenario("repo_nested_texts", _SQL_TALKS + "SELECT sample_key, subsample_key, text FROM v")
def repo_nested_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _library(spark, sf_dir).checkout()["talks"].dataframe().select("sample_key", "subsample_key", "text")


@scenario("repo_nested_sizes", "SELECT count(DISTINCT conv_id) AS n_samples, count(*) AS n_subsamples FROM conversations")
def repo_nested_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _library(spark, sf_dir).checkout()["talks"]
    return spark.createDataFrame([(len(talks), talks.num_subsamples)], "n_samples long, n_subsamples long")


@scenario("repo_column_specs", "SELECT * FROM (VALUES ('documents', 'str', 'flat', 'variable_shape', '30', (SELECT count(*) FROM documents)), ('orders', 'str', 'flat', 'variable_shape', '30', (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0 AND NOT (o_orderkey % 26 = 0))), ('pages', 'bytes', 'flat', 'variable_shape', '31', (SELECT count(*) FROM pages)), ('talks', 'str', 'nested', 'variable_shape', '30', (SELECT count(DISTINCT conv_id) FROM conversations)), ('vectors', 'ndarray', 'flat', 'fixed_shape', '10', (SELECT count(*) FROM embeddings))) t(col, kind, layout, shapes, storage, n)")
def repo_column_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by name with their schema and number of samples."""
    co = _library(spark, sf_dir).checkout()
    return spark.createDataFrame([(n, c.column_type, c.column_layout, c.schema_type, c.backend, len(c)) for n, c in co.items()], "col string, kind string, layout string, shapes string, storage string, n long")


@scenario("repo_schema_records", "SELECT * FROM (VALUES ('documents', 'flat', '1='), ('orders', 'flat', '1='), ('pages', 'flat', '1='), ('talks', 'nested', '1='), ('vectors', 'flat', '1=')) t(col, layout, code)")
def repo_schema_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema records of a commit, each of which has its schema."""
    store = _library(spark, sf_dir).store
    specs = store.schemas_table().select(F.col("schema_digest").alias("digest"), "layout")
    return store.refs(store.heads()["master"]).where("kind = 's'").join(specs, "digest").select("col", "layout", F.substr("digest", F.lit(1), F.lit(2)).alias("code"))


@scenario("repo_all_records", _SQL_VERSIONS + """SELECT 'documents' AS col, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'talks', count(*) FROM conversations
UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'orders', count(*) FROM dev""")
def repo_all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of another branch's head by column."""
    return _library(spark, sf_dir).checkout(branch="dev").records().where("kind <> 's'").groupBy("col").agg(F.count("*").alias("n"))


@scenario("repo_key_range", "SELECT '#' || CAST(doc_id AS VARCHAR) AS sample_key FROM documents WHERE '#' || CAST(doc_id AS VARCHAR) >= '#2' AND '#' || CAST(doc_id AS VARCHAR) < '#3'")
def repo_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a column between two stored keys: a range of strings that the scan can prune."""
    return _library(spark, sf_dir).checkout()["documents"].records().where((F.col("sample_key") >= "#2") & (F.col("sample_key") < "#3")).select("sample_key")


@scenario("repo_objects", _SQL_VERSIONS + """SELECT kind, count(DISTINCT h) AS n FROM (SELECT 'str' AS kind, sha256(text) AS h FROM documents UNION ALL SELECT 'str', sha256(text) FROM conversations
UNION ALL SELECT 'str', sha256(t) FROM base UNION ALL SELECT 'str', sha256(t) FROM mine UNION ALL SELECT 'str', sha256(t) FROM dev
UNION ALL SELECT 'str', sha256(b || 'm') FROM o WHERE """ + _MINE_PUT + """
UNION ALL SELECT 'bytes', sha256(html) FROM pages UNION ALL SELECT 'ndarray', CAST(embedding AS VARCHAR) FROM embeddings) GROUP BY kind""")
def repo_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values stored, each once, over all commits and branches, also those that were deleted before they were committed."""
    return _library(spark, sf_dir).store.objects().groupBy("kind").agg(F.count("*").alias("n"))


@scenario("repo_data_hashes", _SQL_VERSIONS + "SELECT DISTINCT '2=' || sha256(t) AS digest FROM mine")
def repo_data_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _library(spark, sf_dir).checkout()["orders"].records().select("digest").distinct()


@scenario("repo_point_lookups", "SELECT 'documents' AS col, sha256(text) AS content FROM documents WHERE doc_id = 7 UNION ALL SELECT 'talks', sha256(text) FROM conversations WHERE conv_id = 1 AND turn = 0 UNION ALL SELECT 'none', NULL")
def repo_point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat, one nested and one missing value."""
    co = _library(spark, sf_dir).checkout()
    got = [("documents", co["documents"][7]), ("talks", co["talks"][1][0]), ("none", co["documents"].get(-7 if -7 in co["documents"] else 999_999_999))]
    return spark.createDataFrame(got, "col string, text string").select("col", F.sha2("text", 256).alias("content"))


@scenario("repo_subsamples", "SELECT turn AS subsample, text FROM conversations WHERE conv_id = 1")
def repo_subsamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in _library(spark, sf_dir).checkout()["talks"][1].data.items()], "subsample long, text string")


@scenario("repo_subsample_slice", "SELECT turn AS subsample, text FROM (SELECT *, row_number() OVER (ORDER BY '#' || CAST(turn AS VARCHAR)) - 1 AS p FROM conversations WHERE conv_id = 2) WHERE p < 2")
def repo_subsample_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in _library(spark, sf_dir).checkout()["talks"][2][0:2].items()], "subsample long, text string")


@scenario("repo_multi_get", "SELECT CAST(0 AS BIGINT) AS pos, sha256(text) AS content FROM documents WHERE doc_id = 3 UNION ALL SELECT 1, sha256(text) FROM conversations WHERE conv_id = 1 AND turn = 1 UNION ALL SELECT 2, sha256('absent') UNION ALL SELECT 3, sha256(html) FROM pages WHERE page_id = 5")
def repo_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of several columns in one lookup, with a default for what is missing."""
    got = _library(spark, sf_dir).checkout().get([("documents", 3), ("talks", 1, 1), ("documents", 999_999_999), ("pages", 5)], default="absent")
    rows = [(i, bytearray(v if isinstance(v, bytes) else v.encode())) for i, v in enumerate(got)]
    return spark.createDataFrame(rows, "pos long, data binary").select("pos", F.sha2("data", 256).alias("content"))


@scenario("repo_membership", "SELECT * FROM (VALUES ('documents', '7', true), ('documents', 'text 7', false), ('orders', '10', false), ('orders', '11', true), ('talks', '1', true)) t(col, key, there)")
def repo_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    co = _library(spark, sf_dir).checkout()
    asked = [("documents", 7), ("documents", "text 7"), ("orders", 10), ("orders", 11), ("talks", 1)]
    return spark.createDataFrame([(c, str(k), k in co[c]) for c, k in asked], "col string, key string, there boolean")


@scenario("repo_streamed_values", "SELECT row_number() OVER (ORDER BY '#' || CAST(page_id AS VARCHAR)) - 1 AS position, page_id, sha256(html) AS content FROM pages")
def repo_streamed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of a column in the order of its keys, as a loop over them sees them; it keeps a digest of each, some thousands at a time."""
    repo, out = _library(spark, sf_dir), _place(spark, "streamed")
    seen = ((i, k, hashlib.sha256(v).hexdigest()) for i, (k, v) in enumerate(repo.checkout()["pages"].items()))
    rows, batches = "position long, page_id long, content string", itertools.batched(seen, _SEEN)
    for some in itertools.chain([next(batches, ())], batches):
        spark.createDataFrame(some, rows).coalesce(1).write.mode("append").parquet(out)
    return spark.read.schema(rows).parquet(out)


@scenario("repo_dataset_rows", "SELECT row_number() OVER (ORDER BY '#' || CAST(vec_id AS VARCHAR)) - 1 AS position, vec_id, CAST(embedding[1] AS DOUBLE) AS lead FROM embeddings")
def repo_dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a dataset of tensors, as it streams them."""
    co = _library(spark, sf_dir).checkout()
    rows = RowDataset(co["vectors"])
    order = [r[0] for r in co["vectors"].records().select("sample_key").orderBy("sample_key").collect()]
    return spark.createDataFrame([(i, keys.decode_key(order[i]), float(r[0][0])) for i, r in enumerate(rows.stream())], "position long, vec_id long, lead double")


@scenario("repo_dataset_batches", "SELECT b AS batch, CAST(count(*) AS BIGINT) AS n, CAST(max(embedding[1]) AS DOUBLE) AS top FROM (SELECT embedding, (row_number() OVER (ORDER BY '#' || CAST(vec_id AS VARCHAR)) - 1) // 48 AS b FROM embeddings) WHERE b < (SELECT count(*) // 48 FROM embeddings) GROUP BY b")
def repo_dataset_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collated batches of 48, the short last one dropped."""
    data = make_numpy_dataset(_library(spark, sf_dir).checkout()["vectors"], batch_size=48, drop_last=True, shuffle=False)
    return spark.createDataFrame([(i, len(b), float(b[:, 0].max())) for i, b in enumerate(data)], "batch long, n long, top double")


@scenario("repo_dataset_keys", "SELECT v.vec_id, CAST(v.embedding[2] AS DOUBLE) AS second, sha256(d.text) AS content FROM embeddings v JOIN documents d ON d.doc_id = 20 - v.vec_id WHERE v.vec_id BETWEEN 3 AND 9")
def repo_dataset_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of explicit keys, another one for each column."""
    co = _library(spark, sf_dir).checkout()
    rows = RowDataset([co["vectors"], co["documents"]], keys=[(k, 20 - k) for k in range(3, 10)])
    return spark.createDataFrame([(k, float(v[1]), t) for k, (v, t) in zip(range(3, 10), rows.stream(), strict=True)], "vec_id long, second double, text string").select("vec_id", "second", F.sha2("text", 256).alias("content"))


@scenario("repo_dataset_shuffled", "SELECT count(*) AS n, count(*) AS n_seen, true AS moved, true AS same_again FROM embeddings")
def repo_dataset_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawn order has every row once, differs from the keys' order, and is the same for the same seed."""
    rows = RowDataset(_library(spark, sf_dir).checkout()["vectors"])
    plain, one, two = ([r[0].tobytes() for r in rows.stream(s)] for s in (None, 5, 5))
    return spark.createDataFrame([(len(one), len(plain) if sorted(one) == sorted(plain) else 0, one != plain, one == two)], "n long, n_seen long, moved boolean, same_again boolean")


# --- diffs, history, merges -------------------------------------------------------------------------------------

_SQL_CHANGES = """SELECT CASE WHEN x.k IS NULL THEN 'added' WHEN y.k IS NULL THEN 'deleted' ELSE 'mutated' END AS change, '#' || CAST(coalesce(x.k, y.k) AS VARCHAR) AS sample_key
FROM {0} x FULL OUTER JOIN {1} y ON x.k = y.k WHERE x.t IS DISTINCT FROM y.t"""


def _changes(diff) -> DataFrame:
    return diff.changes.where("kind <> 's'").select("change", "sample_key")


@scenario("repo_diff_diverged", _SQL_VERSIONS + _SQL_CHANGES.format("dev", "mine"))
def repo_diff_diverged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(_library(spark, sf_dir).diff("master", "dev"))


@scenario("repo_diff_fast_forward", _SQL_VERSIONS + _SQL_CHANGES.format("base", "dev"))
def repo_diff_fast_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first commit to the branch that descends from it."""
    repo = _library(spark, sf_dir)
    first = next(d for d, c in repo.store.commits().items() if not c["parents"])
    return _changes(repo.diff(first, "dev"))


@scenario("repo_reader_diff", _SQL_VERSIONS + "SELECT change, count(*) AS n FROM (" + _SQL_CHANGES.format("base", "mine") + ") GROUP BY change")
def repo_reader_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read checkout of the first commit against a branch."""
    repo = _library(spark, sf_dir)
    first = next(d for d, c in repo.store.commits().items() if not c["parents"])
    return _changes(repo.checkout(commit=first).diff.branch("master")).groupBy("change").agg(F.count("*").alias("n"))


@scenario("repo_conflicts", _SQL_ORDERS + "SELECT 't3' AS conflict, '#' || CAST(k AS VARCHAR) AS sample_key FROM o WHERE k % 2 = 0 AND k % 7 = 0 AND k % 10 <> 0 AND k % 26 <> 0 AND k % 4 = 0 UNION ALL SELECT 't21', '#' || CAST(k AS VARCHAR) FROM o WHERE k % 26 = 0 AND k % 10 <> 0 AND k % 4 = 0")
def repo_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other branch changes keys that this one has changed or deleted."""
    repo = _copy(spark, sf_dir)
    o = _orders(spark, sf_dir).where(f"({_MINE_PUT} OR {_MINE_GONE}) AND k % 4 = 0")
    _land(repo, "dev", "clash", _texts(o, "k", F.concat("b", F.lit("x"))))
    return repo.diff("master", "dev").conflicts.select("conflict", "sample_key")


@scenario("repo_merge_refused", "SELECT 'ValueError' AS error, true AS heads_stay, false AS lock_held")
def repo_merge_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _copy(spark, sf_dir)
    _land(repo, "dev", "clash", _texts(_orders(spark, sf_dir).where(_MINE_PUT), "k", F.concat("b", F.lit("x"))))
    heads, error = repo.store.heads(), ""
    try:
        repo.merge("no", "master", "dev")
    except ValueError as e:
        error = type(e).__name__
    return spark.createDataFrame([(error, repo.store.heads() == heads, repo.writer_lock_held)], "error string, heads_stay boolean, lock_held boolean")


@scenario("repo_merge_three_way", _SQL_VERSIONS + """SELECT '#' || CAST(coalesce(b.k, m.k, d.k) AS VARCHAR) AS sample_key, '2=' || sha256(CASE WHEN d.t IS DISTINCT FROM b.t THEN d.t ELSE m.t END) AS digest
FROM base b FULL OUTER JOIN mine m ON b.k = m.k FULL OUTER JOIN dev d ON d.k = coalesce(b.k, m.k) WHERE CASE WHEN d.t IS DISTINCT FROM b.t THEN d.t ELSE m.t END IS NOT NULL""")
def repo_merge_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _copy(spark, sf_dir)
    return repo.checkout(commit=repo.merge("both", "master", "dev"))["orders"].records().select("sample_key", "digest")


@scenario("repo_merge_fast_forward", _SQL_VERSIONS + "SELECT true AS same_head, CAST(3 AS BIGINT) AS n_commits, (SELECT count(*) FROM dev) AS n")
def repo_merge_fast_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch at the first commit moves to dev's head; no commit is made."""
    repo = _copy(spark, sf_dir)
    first = next(d for d, c in repo.store.commits().items() if not c["parents"])
    repo.create_branch("late", first)
    head = repo.merge("forward", "late", "dev")
    return spark.createDataFrame([(head == repo.store.heads()["dev"], len(repo.store.commits()), len(repo.checkout(branch="late")["orders"]))], "same_head boolean, n_commits long, n long")


@scenario("repo_commit_list", "SELECT * FROM (VALUES ('base', 0, false, 'library'), ('mine', 1, false, 'library'), ('theirs', 1, false, 'library'), ('both', 2, true, 'library')) t(message, n_parents, is_merge, user_name)")
def repo_commit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _copy(spark, sf_dir)
    repo.merge("both", "master", "dev")
    return repo.store.commits_table().select("message", F.size("parents").alias("n_parents"), "is_merge", F.col("user").alias("user_name"))


@scenario("repo_log", "SELECT * FROM (VALUES (0, 'both'), (1, 'theirs'), (2, 'mine'), (3, 'base')) t(position, message)")
def repo_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _copy(spark, sf_dir)
    repo.merge("both", "master", "dev")
    log = repo.log("master", return_contents=True)
    return spark.createDataFrame([(i, log["specs"][d]["message"]) for i, d in enumerate(log["order"])], "position int, message string")


@scenario("repo_branches", "SELECT * FROM (VALUES ('dev', 'theirs'), ('kept', 'mine'), ('master', 'mine')) t(name, message)")
def repo_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches made and removed, with the commits they name; a commit is given by the start of its digest."""
    repo = _copy(spark, sf_dir)
    repo.create_branch("kept")
    repo.create_branch("gone", repo.store.heads()["dev"][:14])
    repo.remove_branch("gone")
    messages = repo.store.commits_table().select("digest", "message")
    return repo.store.heads_table().join(messages, "digest").select("name", "message")


@scenario("repo_verify", _SQL_VERSIONS + "SELECT true AS sound, CAST(3 AS BIGINT) AS n_commits, (SELECT count(DISTINCT h) FROM (SELECT sha256(t) AS h FROM base UNION ALL SELECT sha256(t) FROM mine UNION ALL SELECT sha256(t) FROM dev)) AS n_values")
def repo_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks pass; and the distinct values of one column's records over all commits."""
    repo = _library(spark, sf_dir)
    n = repo.store.all_refs().where("kind <> 's' AND col = 'orders'").select("digest").distinct().count()
    return spark.createDataFrame([(repo.verify_repo_integrity(), len(repo.store.commits()), n)], "sound boolean, n_commits long, n_values long")


@scenario("repo_verify_damage", "SELECT 'values without their digest' AS found, 'OSError' AS verified_read")
def repo_verify_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored value that was changed is named by the check; records that were lost stop a verified checkout."""
    repo, other, found, error = _copy(spark, sf_dir), _copy(spark, sf_dir), "", ""
    objects = repo.store.objects().withColumn("text", F.when(F.col("digest").endswith("0"), F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    with repo.store.work(objects) as written:
        repo.store.files.delete("objects")
        written.write.parquet(repo.store.files.at("objects"))
    try:
        repo.verify_repo_integrity()
    except RuntimeError as e:
        found = str(e).split(":")[0]
    head = other.store.heads()["master"]
    with other.store.work(other.store.refs(head).where("col <> 'pages'")) as rows:
        other.store.write_refs(head, rows)
    try:
        other.checkout(verify=True)
    except OSError as e:
        error = type(e).__name__
    return spark.createDataFrame([(found, error)], "found string, verified_read string")


# --- writing ----------------------------------------------------------------------------------------------------


@scenario("repo_staged_diff", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'deleted' ELSE 'mutated' END AS change, '#' || CAST(doc_id AS VARCHAR) AS sample_key FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def repo_staged_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes staged on a write checkout against its head."""
    d = _t(spark, sf_dir, "documents")
    co = _copy(spark, sf_dir).checkout(write=True)
    co["documents"].update_dataframe(_texts(d.where("doc_id % 5 = 0"), "doc_id", F.concat("text", F.lit("!"))))
    co["documents"].delete_dataframe(_texts(d.where("doc_id % 3 = 0"), "doc_id", F.col("text")))
    return _changes(co.diff.staged())


@scenario("repo_writer_diff", _SQL_VERSIONS + "SELECT change, count(*) AS n FROM (SELECT 'added' AS change, '#x' AS sample_key UNION ALL " + _SQL_CHANGES.format("dev", "mine") + ") GROUP BY change")
def repo_writer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged changes are part of a writer's diff against another branch: a new document here."""
    co = _copy(spark, sf_dir).checkout(write=True, branch="master")
    co["documents"]["new"] = "a new document"
    return _changes(co.diff.branch("dev")).groupBy("change").agg(F.count("*").alias("n"))


@scenario("repo_reset", "SELECT 'DIRTY' AS before, 'CLEAN' AS after, (SELECT count(*) FROM documents) AS n")
def repo_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    co = _copy(spark, sf_dir).checkout(write=True)
    co["documents"].delete_dataframe(_texts(_t(spark, sf_dir, "documents"), "doc_id", F.col("text")))
    before = co.diff.status()
    co.reset_staging_area()
    return spark.createDataFrame([(before, co.diff.status(), len(co["documents"]))], "before string, after string, n long")


@scenario("repo_status_text", "SELECT * FROM (VALUES (0, 'Branch: master'), (1, 'Added'), (2, '  schemas: 0'), (3, '  samples: 1'), (4, '    documents: 1'), (5, 'Deleted'), (6, '  schemas: 1'), (7, '    vectors'), (8, '  samples: ' || CAST((SELECT count(*) FROM embeddings) AS VARCHAR)), (9, '    vectors: ' || CAST((SELECT count(*) FROM embeddings) AS VARCHAR)), (10, 'Mutated'), (11, '  schemas: 0'), (12, '  samples: 1'), (13, '    pages: 1')) t(line, said)")
def repo_status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status report after one sample was added, one changed and a column dropped."""
    co = _copy(spark, sf_dir).checkout(write=True)
    co["documents"]["new"] = "a new document"
    co["pages"][5] = b"a new page"
    co.columns.delete("vectors")
    return spark.createDataFrame(list(enumerate(reports.status_text(co.branch_name, co.diff.staged()).split("\n"))), "line int, said string")


@scenario("repo_drop_column", "SELECT * FROM (VALUES ('documents', (SELECT count(*) FROM documents)), ('orders', (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0 AND NOT o_orderkey % 26 = 0)), ('pages', (SELECT count(*) FROM pages)), ('talks', (SELECT count(*) FROM conversations))) t(col, n)")
def repo_drop_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _copy(spark, sf_dir)
    co = repo.checkout(write=True)
    co.columns.delete("vectors")
    co.commit("no vectors")
    co.close()
    return repo.checkout().records().where("kind <> 's'").groupBy("col").agg(F.count("*").alias("n"))


@scenario("repo_create_columns", "SELECT * FROM (VALUES ('a', 'str', 'flat', '30', 2), ('b', 'bytes', 'nested', '31', 1), ('c', 'ndarray', 'flat', '01', 1), ('d', 'ndarray', 'flat', '00', 2)) t(col, kind, layout, storage, n)")
def repo_create_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of each type and layout, a value or two in each, committed and read back."""
    repo = _copy(spark, sf_dir)
    co = repo.checkout(write=True)
    a, b = co.add_str_column("a"), co.add_bytes_column("b", contains_subsamples=True)
    c, d = co.add_ndarray_column("c", prototype=np.zeros((2, 3), np.int16)), co.add_ndarray_column("d", shape=(4, 5), dtype="float64", variable_shape=True)
    a["x"], b["s"], c[1] = "text", {1: b"bytes"}, np.ones((2, 3), np.int16)
    a.append("drawn key")
    d.update({"small": np.zeros((1, 1)), "large": np.zeros((4, 5))})
    co.commit("columns")
    co.close()
    now = repo.checkout()
    return spark.createDataFrame([(n, now[n].column_type, now[n].column_layout, now[n].backend, len(now[n])) for n in "abcd"], "col string, kind string, layout string, storage string, n int")


@scenario("repo_flat_writes", "SELECT '#' || CAST(page_id AS VARCHAR) AS sample_key, '3=' || sha256(CASE WHEN page_id = 2 THEN 'two' WHEN page_id = 3 THEN 'three' ELSE html END) AS digest FROM pages WHERE page_id NOT IN (4, 5) UNION ALL SELECT 'new', '3=' || sha256('new')")
def repo_flat_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, overwrite, update, delete and pop by key."""
    repo = _copy(spark, sf_dir)
    co = repo.checkout(write=True)
    pages = co["pages"]
    pages["new"] = b"new"
    pages.update({2: b"2", 3: b"three"})
    pages[2] = b"two"
    del pages[4]
    pages.pop(5)
    co.commit("writes")
    co.close()
    return repo.checkout()["pages"].records().select("sample_key", "digest")


@scenario("repo_nested_writes", _SQL_TALKS + "SELECT sample_key, subsample_key, sha256(CASE WHEN conv_id = 3 AND turn = 0 THEN 'changed' ELSE text END) AS content FROM v WHERE conv_id <> 2 AND NOT (conv_id = 1 AND turn = 1) AND conv_id <> 4 UNION ALL SELECT '#1', 'x', sha256('added') UNION ALL SELECT 'fresh', '#1', sha256('one') UNION ALL SELECT 'fresh', '#2', sha256('two')")
def repo_nested_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, add to, change and delete samples and subsamples by key."""
    repo = _copy(spark, sf_dir)
    co = repo.checkout(write=True)
    talks = co["talks"]
    talks["fresh"] = {1: "one", 2: "two"}
    talks.update({1: {"x": "added"}, 3: {0: "changed"}})
    del talks[1][1]
    del talks[2]
    talks.pop(4)
    co.commit("writes")
    co.close()
    return repo.checkout()["talks"].dataframe().select("sample_key", "subsample_key", F.sha2("text", 256).alias("content"))


@scenario("repo_bulk_writes", _SQL_TALKS + "SELECT sample_key, subsample_key, sha256(CASE WHEN turn = 0 THEN text || '!' ELSE text END) AS content FROM v WHERE conv_id % 4 <> 1")
def repo_bulk_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested column changed and deleted from by DataFrames."""
    repo, c = _copy(spark, sf_dir), _t(spark, sf_dir, "conversations")
    co = repo.checkout(write=True)
    co["talks"].update_dataframe(_nested(c.where("turn = 0"), "conv_id", "turn", F.concat("text", F.lit("!"))))
    co["talks"].delete_dataframe(_nested(c.where("conv_id % 4 = 1"), "conv_id", "turn", F.col("text")))
    co.commit("bulk")
    co.close()
    return repo.checkout()["talks"].dataframe().select("sample_key", "subsample_key", F.sha2("text", 256).alias("content"))


@scenario("repo_change_backend", "SELECT true AS schema_changed, '50' AS storage, (SELECT count(*) FROM documents) + 1 AS n")
def repo_change_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage of values from now on: the schema's digest changes, old values stay readable."""
    repo = _copy(spark, sf_dir)
    before = repo.checkout()["documents"].schema.digest
    co = repo.checkout(write=True)
    co["documents"].change_backend("50", {"compression": "zstd", "level": 9})
    co["documents"]["new"] = "stored anew"
    co.commit("storage")
    co.close()
    d = repo.checkout()["documents"]
    return spark.createDataFrame([(d.schema.digest != before, d.backend, d.dataframe().where("text IS NOT NULL").count())], "schema_changed boolean, storage string, n long")


# --- imports, exports, streams ----------------------------------------------------------------------------------


def _nations(region: int, rows: list[tuple[int, str]]):
    """An import function: a text for each nation, and one tensor a region."""
    for k, name in rows:
        yield Output("names", k, name)
        yield Output("shared", region, f"nations of {region}")
    yield Output("sizes", region, np.array([len(rows), sum(k for k, _ in rows)], dtype=np.int64))


@scenario("repo_bulk_import", """SELECT 'names' AS col, '#' || CAST(n_nationkey AS VARCHAR) AS sample_key, n_name AS shown FROM nation
UNION ALL SELECT 'sizes', '#' || CAST(n_regionkey AS VARCHAR), CAST(count(*) AS VARCHAR) || ',' || CAST(sum(n_nationkey) AS VARCHAR) FROM nation GROUP BY n_regionkey
UNION ALL SELECT DISTINCT 'shared', '#' || CAST(n_regionkey AS VARCHAR), 'nations of ' || CAST(n_regionkey AS VARCHAR) FROM nation""")
def repo_bulk_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator run for each region on the executors; equal outputs are stored once."""
    repo = _copy(spark, sf_dir)
    co = repo.checkout(write=True)
    co.add_str_column("names")
    co.add_str_column("shared")
    co.add_ndarray_column("sizes", shape=2, dtype="int64")
    co.commit("columns")
    co.close()
    regions: dict[int, list] = {}
    for r in _t(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        regions.setdefault(r["n_regionkey"], []).append((r["n_nationkey"], r["n_name"]))
    run_bulk_import(repo, "master", ["names", "shared", "sizes"], _nations, [{"region": k, "rows": v} for k, v in regions.items()])
    now = repo.checkout()
    texts = [now[c].dataframe().select(F.lit(c).alias("col"), "sample_key", F.col("text").alias("shown")) for c in ("names", "shared")]
    sizes = now["sizes"].dataframe().select(F.lit("sizes").alias("col"), "sample_key", F.concat_ws(",", tensors.to_array("<i8", "array<bigint>")("data").cast("array<string>")).alias("shown"))
    return texts[0].unionByName(texts[1]).unionByName(sizes)


@scenario("repo_bulk_import_counts", "SELECT (SELECT 2 * count(*) + count(DISTINCT n_regionkey) FROM nation) AS outputs, (SELECT count(*) + 2 * count(DISTINCT n_regionkey) FROM nation) AS keys")
def repo_bulk_import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _copy(spark, sf_dir)
    co = repo.checkout(write=True)
    co.add_str_column("names")
    co.add_str_column("shared")
    co.add_ndarray_column("sizes", shape=2, dtype="int64")
    co.commit("columns")
    co.close()
    regions: dict[int, list] = {}
    for r in _t(spark, sf_dir, "nation").collect():
        regions.setdefault(r["n_regionkey"], []).append((r["n_nationkey"], r["n_name"]))
    got = run_bulk_import(repo, "master", ["names", "shared", "sizes"], _nations, [{"region": k, "rows": v} for k, v in regions.items()], ncpus=3)
    return spark.createDataFrame([(got["outputs"], got["keys"])], "outputs long, keys long")


def _lines(path: str, content: bytes):
    for line in content.decode().splitlines():
        key, _, text = line.partition(" ")
        yield text, int(key)


@scenario("repo_import_files", "SELECT '#' || CAST(page_id AS VARCHAR) AS sample_key, sha256(CASE WHEN page_id = 1 THEN 'kept' ELSE url END) AS content FROM pages")
def repo_import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of text files, one sample a line; a key that is there already is skipped."""
    repo, folder = _copy(spark, sf_dir), _place(spark, "files")
    _t(spark, sf_dir, "pages").select(F.concat_ws(" ", F.col("page_id").cast("string"), "url")).repartition(3).write.text(folder)
    co = repo.checkout(write=True)
    co.add_str_column("urls")[1] = "kept"
    co.commit("column")
    co.close()
    import_files(repo, "master", "urls", folder, _lines, pattern="*.txt")
    co = repo.checkout(write=True)
    co.commit("import")
    co.close()
    return repo.checkout()["urls"].dataframe().select("sample_key", F.sha2("text", 256).alias("content"))


def _save_page(value: bytes, path: str, key: object) -> None:
    with open(path.replace(":", "_"), "wb") as f:  # Hadoop can't read names with colons
        f.write(value)


@scenario("repo_export_files", "SELECT 'int_' || CAST(page_id AS VARCHAR) AS file, sha256(html) AS content FROM pages")
def repo_export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples of a column written as files by the executors, read back as files."""
    folder = _place(spark, "export")
    local = folder.removeprefix("file://")
    co = _library(spark, sf_dir).checkout()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    export_files(co, "pages", _save_page, local)
    read = spark.read.format("binaryFile").load(folder)
    return read.select(F.substring_index("path", "/", -1).alias("file"), F.sha2("content", 256).alias("content"))


@scenario("repo_stream", "SELECT '#' || CAST(user_id AS VARCHAR) AS sample_key, max(event_type || '|' || CAST(event_id AS VARCHAR)) FILTER (WHERE r = 1) AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) GROUP BY user_id")
def repo_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed into a column, one commit a micro-batch, the last event of a user counting."""
    from ..streaming.commits import commit_batches

    repo = _copy(spark, sf_dir)
    co = repo.checkout(write=True)
    co.add_str_column("last")
    co.commit("column")
    co.close()
    source = _place(spark, "events")
    e = _t(spark, sf_dir, "events")
    rows = _texts(e, "user_id", F.concat_ws("|", "event_type", F.col("event_id").cast("string"))).withColumn("order", F.lit(0).cast("long"))
    rows = rows.withColumn("order", F.substring_index("text", "|", -1).cast("long"))
    rows.repartition(2).write.parquet(source)
    commit_batches(repo, "master", "last", spark.readStream.schema(rows.schema).parquet(source), _place(spark, "stream")).awaitTermination()
    return repo.checkout()["last"].dataframe().select("sample_key", F.col("text").alias("last"))


# --- remotes ----------------------------------------------------------------------------------------------------


@scenario("repo_clone", _SQL_VERSIONS + "SELECT 'master' AS branch, (SELECT count(*) FROM mine) AS n, (SELECT count(*) FROM mine) AS n_remote")
def repo_clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clone has the records; values are known by digest and stay where they are."""
    _, mine = _clone(spark, sf_dir)
    orders = mine.checkout()["orders"]
    remote = access.remote_only(orders.records(), mine.store.objects()).count()
    return spark.createDataFrame([(mine.checkout(write=False, branch="master") and "master", len(orders), remote)], "branch string, n long, n_remote long")


@scenario("repo_fetch_samples", _SQL_TALKS + "SELECT sample_key, subsample_key, text FROM v WHERE conv_id = 1 OR (conv_id = 2 AND turn = 0)")
def repo_fetch_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of named samples only: a whole sample and one subsample of another."""
    _, mine = _clone(spark, sf_dir)
    mine.remote.fetch_data_sample("origin", "talks", [(1, ...), (2, 0)], branch="master")
    return mine.checkout()["talks"].dataframe().where("text IS NOT NULL").join(_t(spark, sf_dir, "conversations").select(keys.encoded(F.col("conv_id"), True).alias("sample_key")).where("sample_key IN ('#1', '#2')").distinct(), "sample_key").select("sample_key", "subsample_key", "text")


@scenario("repo_fetch_column", _SQL_TALKS + "SELECT 'pages' AS col, false AS any_remote UNION ALL SELECT 'vectors', true UNION ALL SELECT 'talks', true")
def repo_fetch_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of one column; those of others stay remote."""
    _, mine = _clone(spark, sf_dir)
    mine.remote.fetch_data("origin", branch="master", column_names=["pages"])
    co = mine.checkout()
    return spark.createDataFrame([(c, co[c].contains_remote_references) for c in ("pages", "vectors", "talks")], "col string, any_remote boolean")


@scenario("repo_fetch_all", "SELECT count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS content FROM (SELECT sha256(text) AS h FROM documents)")
def repo_fetch_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, mine = _clone(spark, sf_dir)
    mine.remote.fetch_data("origin", branch="master")
    d = mine.checkout()["documents"].dataframe().select(F.sha2("text", 256).alias("h"))
    return d.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("content"))


@scenario("repo_push", "SELECT '#' || CAST(p_partkey AS VARCHAR) AS sample_key, p_name AS text FROM part")
def repo_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column made in a clone and pushed, read at the origin."""
    origin, mine = _clone(spark, sf_dir)
    co = mine.checkout(write=True)
    co.add_str_column("parts").update_dataframe(_texts(_t(spark, sf_dir, "part"), "p_partkey", F.col("p_name")))
    co.commit("parts")
    co.close()
    mine.remote.push("origin", "master")
    return Repository(spark, origin.path).checkout()["parts"].dataframe().select("sample_key", "text")


@scenario("repo_push_refused", "SELECT 'REJECTED' AS said, true AS head_stays")
def repo_push_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The origin has moved on; a push leaves it as it is."""
    origin, mine = _clone(spark, sf_dir)
    for repo, text in ((origin, "theirs"), (mine, "mine")):
        co = repo.checkout(write=True)
        co["documents"]["new"] = text
        co.commit(text)
        co.close()
    head = origin.store.heads()["master"]
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        mine.remote.push("origin", "master")
    return spark.createDataFrame([(next(str(w.message).split(":")[0] for w in said if "origin" in str(w.message)), origin.store.heads()["master"] == head)], "said string, head_stays boolean")


@scenario("repo_served", "SELECT '#' || CAST(c_custkey AS VARCHAR) AS sample_key, c_name AS text FROM customer")
def repo_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository behind a server: cloned, and a column pushed with username and password, read at the origin.

    The server runs on the driver for as long as the query's own jobs do.
    """
    import socket
    import threading

    from ..service.server import serve

    origin = Repository(spark, _place(spark, "served"))
    origin.init("origin", "origin@example.org")
    co = origin.checkout(write=True)
    co.add_str_column("nations").update_dataframe(_texts(_t(spark, sf_dir, "nation"), "n_nationkey", F.col("n_name")))
    co.commit("nations")
    co.close()
    local = spark.sparkContext.master.startswith("local")
    host = "127.0.0.1" if local else socket.gethostbyname(socket.gethostname())
    server = serve(origin.path.removeprefix("file://"), host=host, username="user", password="secret")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        mine = Repository(spark, _place(spark, "clone"))
        mine.clone("me", "me@example.org", f"http://{host}:{server.server_address[1]}")
        mine.remote.fetch_data("origin", branch="master")
        co = mine.checkout(write=True)
        co.add_str_column("customers").update_dataframe(_texts(_t(spark, sf_dir, "customer"), "c_custkey", F.col("c_name")))
        co.commit("customers")
        co.close()
        mine.remote.push("origin", "master", username="user", password="secret")
    finally:
        server.shutdown()
        server.server_close()
    return Repository(spark, origin.path).checkout()["customers"].dataframe().select("sample_key", "text")


__all__ = ["QUERIES", "SQL"]
