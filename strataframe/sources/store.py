"""The tables of a repository.

``objects`` holds each value once, by digest, and is only appended to. ``refs/commit=<digest>`` holds a commit's
snapshot; reading a commit lists one folder. Commits, schemas, heads and state are small JSON files. Writes go
objects, refs, commit, head: a crash before the last step leaves files that nothing points to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import object_digest
from ..functions.schemas import ColumnSchema
from ..operators import algebra
from .files import Files

OBJECTS = "digest string, kind string, dtype string, shape array<int>, data binary, text string, nbytes long"
REFS = "kind string, col string, sample_key string, subsample_key string, digest string"
REMOTE_REFS = "digest string, schema_digest string, remote string"
COMMITS = "digest string, parents array<string>, is_merge boolean, commit_time double, message string, user string, email string, refs_digest string"
FORMAT = 1
LOCK = "writer.lock"
#: Staged operations of a shuffle partition, up to which they are hashed in place of sorting the snapshot.
HASHED = 100_000


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self._commits: dict[str, dict] = {}
        self._schemas: dict[str, ColumnSchema] = {}

    # Tables.

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.files.at(name)) if self.files.exists(name) else self.spark.createDataFrame([], schema)

    def objects(self) -> DataFrame:
        return self._read("objects", OBJECTS)

    def remote_refs(self) -> DataFrame:
        return self._read("remote_refs", REMOTE_REFS)

    def refs(self, commit: str) -> DataFrame:
        """Records of a commit; none for the empty digest, the root of a new repository."""
        return self._read(f"refs/commit={commit}", REFS) if commit else self.spark.createDataFrame([], REFS)

    def all_refs(self) -> DataFrame:
        return self._read("refs", REFS + ", commit string")

    @contextmanager
    def work(self, df: DataFrame) -> Iterator[DataFrame]:
        """``df`` written once to a folder of the repository and read from there until the block ends.

        What is built on it sees one evaluation, also after executors were lost, and whoever reads it can be anywhere.
        """
        name = f"work/{uuid.uuid4().hex}"
        df.write.parquet(self.files.at(name))
        try:
            out = self.spark.read.schema(df.schema).parquet(self.files.at(name))
            out._strataframe_work = name
            yield out
        finally:
            self.files.delete(name)

    def _adopt(self, name: str, to: str) -> None:
        """Move the part files of a written folder into a table."""
        for file in self.files.names(name):
            if file.startswith("part-"):
                self.files.rename(f"{name}/{file}", f"{to}/{file}")

    def append_objects(self, rows: DataFrame, options: dict | None = None, check: bool = False) -> int:
        """Append the rows whose digest is new, one of each; how many they were.

        They are written aside and then moved, so a reader never sees part of them. ``check`` compares the values with
        their digests on the way; RuntimeError, and nothing is appended, if one differs.
        """
        options = options or {}
        new = algebra.new_only(rows.select("digest", "kind", "dtype", "shape", "data", "text", "nbytes"), self.objects())
        name = f"work/{uuid.uuid4().hex}"
        writer = new.withColumn("sound", object_digest(F.col("kind")) == F.col("digest") if check else F.lit(True)).write.option("compression", options.get("compression") or "zstd")
        if options.get("level") is not None:
            writer = writer.option("parquet.compression.codec.zstd.level", str(options["level"]))
        try:
            writer.parquet(self.files.at(name))
            made = self.spark.read.schema("digest string, sound boolean").parquet(self.files.at(name))
            if check and (bad := made.where("NOT coalesce(sound, false)").select("digest").take(1)):
                raise RuntimeError(f"value {bad[0][0]} arrived damaged")
            n = made.count()
            self._adopt(name, "objects")
            return n
        finally:
            self.files.delete(name)

    def append_remote_refs(self, rows: DataFrame) -> None:
        algebra.new_only(rows, self.remote_refs()).write.mode("append").parquet(self.files.at("remote_refs"))

    def write_refs(self, commit: str, rows: DataFrame) -> None:
        """A commit's snapshot; a table of ``work`` that holds it already is moved into place."""
        name, to = getattr(rows, "_strataframe_work", None), f"refs/commit={commit}"
        if name:
            self.files.delete(to)
            self.files.rename(name, to)
        else:
            rows.select("kind", "col", "sample_key", "subsample_key", "digest").write.mode("overwrite").parquet(self.files.at(to))

    def add_refs(self, rows: DataFrame) -> None:
        """Snapshots of many commits (the columns of REFS and commit), written in one job and moved into their places."""
        name = f"work/{uuid.uuid4().hex}"
        try:
            rows.select("kind", "col", "sample_key", "subsample_key", "digest", "commit").write.partitionBy("commit").parquet(self.files.at(name))
            for folder in self.files.names(name):
                if folder.startswith("commit="):
                    to = f"refs/{unquote(folder)}"
                    self.files.delete(to)
                    self.files.rename(f"{name}/{folder}", to)
        finally:
            self.files.delete(name)

    # The writer's lock.

    def lock(self, holder: str) -> str:
        """One holder at a time; the same holder may ask again."""
        if not self.files.create(LOCK, holder) and self.files.read(LOCK) != holder:
            raise PermissionError("another writer holds the lock")
        return holder

    def unlock(self, holder: str) -> None:
        if self.files.exists(LOCK):
            if self.files.read(LOCK) != holder:
                raise RuntimeError("another writer holds the lock")
            self.files.delete(LOCK)

    @contextmanager
    def locked(self, what: str) -> Iterator[None]:
        holder = self.lock(f"{what}-{uuid.uuid4().hex}")
        try:
            yield
        finally:
            self.unlock(holder)

    # Small metadata.

    def commits(self) -> dict[str, dict]:
        """All commits by digest; files seen before are not read again."""
        for name in self.files.names("commits"):
            digest = name.removesuffix(".json")
            if name.endswith(".json") and digest not in self._commits:
                self._commits[digest] = json.loads(self.files.read(f"commits/{name}"))
        return self._commits

    def commits_table(self) -> DataFrame:
        rows = [(d, c["parents"], c["is_merge"], c["commit_time"], c["message"], c["user"], c["email"], c["refs_digest"]) for d, c in self.commits().items()]
        return self.spark.createDataFrame(rows, COMMITS)

    def put_commit(self, digest: str, commit: dict) -> None:
        self.files.create(f"commits/{digest}.json", json.dumps(commit, sort_keys=True))

    def parents(self) -> dict[str, list[str]]:
        return {d: c["parents"] for d, c in self.commits().items()}

    def times(self) -> dict[str, float]:
        return {d: c["commit_time"] for d, c in self.commits().items()}

    def schemas(self) -> dict[str, ColumnSchema]:
        for name in self.files.names("schemas"):
            digest = name.removesuffix(".json")
            if name.endswith(".json") and digest not in self._schemas:
                self._schemas[digest] = ColumnSchema.from_spec(json.loads(self.files.read(f"schemas/{name}")))
        return self._schemas

    def put_schema(self, schema: ColumnSchema) -> str:
        if schema.digest not in self.schemas():
            self.files.create(f"schemas/{schema.digest}.json", schema.to_json())
        return schema.digest

    def schemas_table(self) -> DataFrame:
        rows = [(d, s.kind, s.layout, s.variable, s.dtype, list(s.shape), s.storage, json.dumps(s.storage_options)) for d, s in self.schemas().items()]
        return self.spark.createDataFrame(rows, "schema_digest string, column_type string, layout string, variable boolean, dtype string, shape array<int>, storage string, storage_options string")

    def heads(self) -> dict[str, str]:
        return self.files.read_json("heads.json", {})

    def set_heads(self, heads: dict[str, str]) -> None:
        self.files.write_json("heads.json", heads)

    def heads_table(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.heads().items()), "name string, digest string")

    def state(self) -> dict:
        return self.files.read_json("state.json", {})

    def set_state(self, **changes) -> dict:
        state = self.state() | changes
        self.files.write_json("state.json", state)
        return state

    # Staging: numbered batches of operations over the staging branch's head.

    def staged(self) -> DataFrame:
        return self._read("staging", REFS + ", op string, seq long")

    def stage(self, rows: list[tuple] | DataFrame) -> None:
        """Append operations (kind, col, sample_key, subsample_key, digest, op): put, del, or drop for a whole column.

        Of one key all operations of a batch are the same.
        """
        seq = self.state().get("seq", 0) + 1
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, REFS + ", op string").coalesce(1)
        df.withColumn("seq", F.lit(seq).cast("long")).write.mode("append").parquet(self.files.at("staging"))
        self.set_state(seq=seq)

    def clear_staging(self) -> None:
        self.files.delete("staging")
        self.set_state(seq=0)

    def overlay(self, commit: str) -> DataFrame:
        """The commit's records with the staged operations made, the last one of a key counting.

        Only columns that several batches wrote to need the last one looked for.
        """
        base = self.refs(commit)
        if not self.files.exists("staging"):
            return base
        ops = self.staged()
        made = F.col("op") != "drop"
        seen = ops.groupBy("kind", "col").agg(F.max(F.when(~made, F.col("seq"))).alias("dropped"), F.min(F.when(made, F.col("seq"))).alias("first"), F.max(F.when(made, F.col("seq"))).alias("last"), F.count("*").alias("n")).collect()
        alive = made
        for r in seen:
            if r["dropped"] is not None:
                base = base.where(F.col("col") != r["col"])
                alive = alive & ~((F.col("col") == r["col"]) & (F.col("seq") <= r["dropped"]))
        last, again = ops.where(alive), [f"{r['kind']}|{r['col']}" for r in seen if r["first"] != r["last"]]
        if again:
            several = F.concat_ws("|", "kind", "col").isin(again)
            last = last.where(~several).unionByName(algebra.last_write(last.where(several), algebra.KEYS, ["seq", "op"]))
        few = sum(r["n"] for r in seen) <= HASHED * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        gone = last.select(*algebra.KEYS)
        kept = base.join(gone.hint("shuffle_hash") if few else gone, algebra.KEYS, "left_anti")
        return kept.select(*algebra.KEYS, "digest").unionByName(last.where("op = 'put'").select(*algebra.KEYS, "digest"))
