"""The other side of a fetch or push: a repository on storage that Spark reaches, or one behind a server.

Both are asked the same things. Records and values move between the executors and the other side; the driver sees commits,
schemas and heads.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import ColumnSchema
from ..operators import algebra
from ..sources.store import OBJECTS, REFS, Store
from . import wire


class StoragePeer:
    def __init__(self, store: Store):
        self.store = store
        self.heads, self.commits, self.parents, self.schemas, self.put_schema, self.put_commit = store.heads, store.commits, store.parents, store.schemas, store.put_schema, store.put_commit

    def locked(self, what: str):
        return self.store.locked(what)

    def records(self, commits: list[str]) -> DataFrame:
        return self.store.all_refs().where(F.col("commit").isin(commits))

    def values(self, wanted: DataFrame) -> DataFrame:
        return self.store.objects().join(wanted, "digest", "left_semi")

    def missing(self, wanted: DataFrame) -> DataFrame:
        return algebra.missing(wanted, self.store.objects())

    def take_values(self, rows: DataFrame) -> int:
        return self.store.append_objects(rows, check=True)

    def take_records(self, rows: DataFrame) -> None:
        self.store.add_refs(rows)

    def move_head(self, branch: str, seen: str, to: str) -> None:
        heads = self.store.heads()
        if (heads.get(branch) or "") != seen:
            raise ConnectionError(f"{branch!r} has moved to {heads.get(branch)}")
        self.store.set_heads(heads | {branch: to})


def call(address: str, method: str, path: str, body: bytes | None = None, secret: str = "") -> bytes:
    request = urllib.request.Request(f"{address}/{path}", data=body, method=method, headers={"Authorization": secret} if secret else {})
    try:
        with urllib.request.urlopen(request, timeout=300) as reply:
            return reply.read()
    except urllib.error.HTTPError as e:
        reason = json.loads(e.read() or b"{}").get("error", str(e))
        raise {401: PermissionError, 422: RuntimeError}.get(e.code, ConnectionError)(reason) from None
    except urllib.error.URLError as e:
        raise ConnectionError(f"no server at {address}: {e.reason}") from None


class ServerPeer:
    def __init__(self, spark: SparkSession, address: str, username: str = "", password: str = ""):
        self.spark, self.address = spark, address.rstrip("/")
        self.secret = wire.credentials(username, password) if username or password else ""
        self._get("ping")

    def _get(self, path: str):
        return json.loads(call(self.address, "GET", path, secret=self.secret))

    def _put(self, path: str, value) -> None:
        call(self.address, "PUT", path, json.dumps(value).encode(), self.secret)

    @contextmanager
    def locked(self, what: str) -> Iterator[None]:
        """Asks whether this side may write. The server puts writes in order and moves a head only from where it was seen, so nothing is held."""
        self._put("begin", what)
        yield

    def heads(self) -> dict[str, str]:
        return self._get("heads")

    def commits(self) -> dict[str, dict]:
        return self._get("commits")

    def parents(self) -> dict[str, list[str]]:
        return {d: c["parents"] for d, c in self.commits().items()}

    def schemas(self) -> dict[str, ColumnSchema]:
        return {d: ColumnSchema.from_spec(s) for d, s in self._get("schemas").items()}

    def put_schema(self, schema: ColumnSchema) -> None:
        self._put(f"schemas/{quote(schema.digest, safe='')}", schema.spec())

    def put_commit(self, digest: str, commit: dict) -> None:
        self._put(f"commits/{quote(digest, safe='')}", commit)

    def move_head(self, branch: str, seen: str, to: str) -> None:
        self._put(f"heads/{quote(branch, safe='')}", {"seen": seen, "to": to})

    def _asked(self, rows: DataFrame, path: str, schema: pa.Schema, result: str) -> DataFrame:
        """Each task sends its digests in bounded messages and gives what comes back."""
        address, secret = self.address, self.secret

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in wire.messages(batches, wire.DIGESTS):
                yield from wire.unpack(call(address, "POST", path, wire.pack(table), secret)).cast(schema).to_batches()

        return rows.select("digest").mapInArrow(run, result)

    def records(self, commits: list[str]) -> DataFrame:
        address, secret = self.address, self.secret

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for c in b["commit"].to_pylist():
                    yield from wire.unpack(call(address, "GET", f"records/{quote(c, safe='')}", secret=secret)).cast(wire.RECORDS).to_batches()

        asked = self.spark.createDataFrame([(c,) for c in commits], "commit string")
        return asked.repartition(max(1, min(len(commits), self.spark.sparkContext.defaultParallelism))).mapInArrow(run, REFS + ", commit string")

    def values(self, wanted: DataFrame) -> DataFrame:
        return self._asked(wanted, "values", wire.VALUES, OBJECTS)

    def missing(self, wanted: DataFrame) -> DataFrame:
        return self._asked(wanted.select("digest").distinct(), "missing", wire.DIGESTS, "digest string")

    def _sent(self, rows: DataFrame, path: str, schema: pa.Schema) -> int:
        address, secret = self.address, self.secret

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in wire.messages(batches, schema):
                taken = json.loads(call(address, "PUT", path, wire.pack(table), secret))
                yield pa.RecordBatch.from_pydict({"n": pa.array([taken], pa.int64())})

        return rows.select(*schema.names).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0

    def take_values(self, rows: DataFrame) -> int:
        return self._sent(rows, "values", wire.VALUES)

    def take_records(self, rows: DataFrame) -> None:
        self._sent(rows, "records", wire.RECORDS)


def peer(spark: SparkSession, address: str, username: str = "", password: str = "") -> StoragePeer | ServerPeer:
    """By the address: ``http://`` or ``https://`` is a server, all else a folder."""
    if address.startswith(("http://", "https://")):
        return ServerPeer(spark, address, username, password)
    store = Store(spark, address)
    if not store.files.exists("state.json"):
        raise ConnectionError(f"no repository at {address}")
    return StoragePeer(store)
