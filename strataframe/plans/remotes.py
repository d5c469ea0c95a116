"""Remotes: other repositories' folders or servers. Fetch and push are anti-joins and appends between two sides; the head moves last.

Both hold the writer's lock of the side they write to, so no value is stored twice beside a commit.
"""

from __future__ import annotations

import time
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import check_name, encode_key
from ..operators import access, algebra, history
from ..service.peers import ServerPeer, StoragePeer, peer


class Remotes:
    def __init__(self, repo):
        self._repo, self.store = repo, repo.store

    # The registry.

    def _all(self) -> dict[str, str]:
        return self.store.files.read_json("remotes.json", {})

    def add(self, name: str, address: str) -> tuple[str, str]:
        check_name(name, "remote")
        if name in self._all():
            raise ValueError(f"remote {name!r} is there already")
        self.store.files.write_json("remotes.json", self._all() | {name: address})
        return name, address

    def remove(self, name: str) -> tuple[str, str]:
        remotes = self._all()
        if name not in remotes:
            raise ValueError(f"no remote {name!r}")
        self.store.files.write_json("remotes.json", {k: v for k, v in remotes.items() if k != name})
        return name, remotes[name]

    def list_all(self) -> list[tuple[str, str]]:
        return sorted(self._all().items())

    def _open(self, name: str, username: str = "", password: str = "") -> StoragePeer | ServerPeer:
        remotes = self._all()
        if name not in remotes:
            raise ValueError(f"no remote {name!r}")
        return peer(self.store.spark, remotes[name], username, password)

    def ping(self, name: str) -> float:
        began = time.perf_counter()
        self._open(name)
        return time.perf_counter() - began

    # Fetch.

    def fetch(self, remote: str, branch: str) -> str:
        """The branch's history and records as ``remote/branch``; values stay there, known by digest."""
        other = self._open(remote)
        heads = other.heads()
        if branch not in heads:
            raise ValueError(f"no branch {branch!r} at {remote!r}")
        name, theirs = f"{remote}/{branch}", heads[branch]
        mine = self.store.heads().get(name) or ""
        if mine == theirs:
            warnings.warn(f"NoOp: {name} is at {theirs} already", UserWarning, stacklevel=2)
            return name
        parents = other.parents()
        if mine and mine not in history.ancestors(parents, theirs) and theirs in history.ancestors(self.store.parents(), mine):
            warnings.warn(f"REJECTED: {name} is ahead of the remote", UserWarning, stacklevel=2)
            return name
        with self.store.locked("fetch"):
            wanted = [c for c in history.ancestors(parents, theirs) if c not in self.store.commits()]
            for digest, schema in other.schemas().items():
                if digest not in self.store.schemas():
                    self.store.put_schema(schema)
            if wanted:
                with self.store.work(other.records(wanted)) as records:
                    schema_of = records.where("kind = 's'").groupBy("commit", "col").agg(F.max("digest").alias("schema_digest"))
                    known = records.where("kind <> 's'").join(schema_of, ["commit", "col"]).groupBy("digest").agg(F.max_by("schema_digest", "col").alias("schema_digest"))
                    away = known.join(self.store.objects().select("digest"), "digest", "left_anti")
                    self.store.append_remote_refs(away.withColumn("remote", F.lit(remote)))
                    self.store.add_refs(records)
                commits = other.commits()
                for c in reversed(wanted):
                    self.store.put_commit(c, commits[c])
            self.store.set_heads(self.store.heads() | {name: theirs})
        return name

    def _commit(self, remote: str, branch: str | None, commit: str | None) -> str:
        if commit:
            return history.expand_digest(list(self.store.commits()), commit)
        heads = self.store.heads()
        for name in (f"{remote}/{branch}", branch):
            if name in heads:
                return heads[name]
        raise ValueError(f"no branch {branch!r}; fetch it first")

    def _get(self, remote: str, records: DataFrame) -> int:
        """Copy the values of records that are not here, each checked against its digest; how many they were."""
        other = self._open(remote)
        with self.store.locked("fetch"):
            wanted = algebra.missing(records.where("kind <> 's'"), self.store.objects())
            return self.store.append_objects(other.values(wanted), check=True)

    def fetch_data(self, remote: str, branch: str | None = None, commit: str | None = None, *, column_names: list[str] | None = None, retrieve_all_history: bool = False) -> list[str]:
        """Values of a commit, or of all it descends from; of all columns or those named. Unknown names are left out."""
        at = self._commit(remote, branch, commit)
        commits = list(history.ancestors(self.store.parents(), at)) if retrieve_all_history else [at]
        records = self.store.all_refs().where(F.col("commit").isin(commits))
        if column_names is not None:
            records = records.where(F.col("col").isin(column_names))
        self._get(remote, records)
        return commits

    def fetch_data_sample(self, remote: str, column: str, samples, branch: str | None = None, commit: str | None = None) -> str:
        """Values of named samples: a key, or for nested columns a key, (key,), (key, ...) for all subsamples, or (key, subsample)."""
        at = self._commit(remote, branch, commit)
        records = self.store.refs(at)
        found = records.where((F.col("kind") == "s") & (F.col("col") == column)).select("sample_key").take(1)
        if not found:
            raise KeyError(column)
        nested = found[0][0] == "nested"
        asked = []
        for s in samples if isinstance(samples, list) else [samples]:
            if not nested:
                if isinstance(s, tuple):
                    raise TypeError(f"{s!r}: samples of a flat column are named by one key")
                asked.append((column, encode_key(s), ""))
                continue
            path = s if isinstance(s, tuple) else (s,)
            if len(path) not in (1, 2):
                raise ValueError(f"{s!r} is no sample of a nested column")
            asked.append((column, encode_key(path[0]), None if len(path) == 1 or path[1] is ... else encode_key(path[1])))
        requested = self.store.spark.createDataFrame(asked, "col string, sample_key string, subsample_key string")
        chosen = access.fetch_selection(requested, records.where("kind <> 's'"))
        there = chosen.select("sample_key").distinct()
        if lost := requested.select("sample_key").distinct().join(there, "sample_key", "left_anti").take(1):
            raise KeyError(lost[0][0])
        self._get(remote, chosen)
        return at

    # Push.

    def push(self, remote: str, branch: str, *, username: str = "", password: str = "") -> str:
        """Schemas, values, commits, then the head. Refused where the remote has commits that are not here; a server may ask for credentials."""
        other = self._open(remote, username, password)
        heads = self.store.heads()
        if branch not in heads:
            raise ValueError(f"no branch {branch!r}")
        mine, theirs = heads[branch], other.heads().get(branch) or ""
        if mine == theirs:
            warnings.warn(f"NoOp: {branch!r} is at {mine} there already", UserWarning, stacklevel=2)
            return branch
        own = history.ancestors(self.store.parents(), mine)
        if theirs and theirs not in own:
            warnings.warn(f"REJECTED: {remote!r} has commits of {branch!r} that are not here", UserWarning, stacklevel=2)
            return branch
        with other.locked("push"):
            there, known = other.commits(), other.schemas()
            new = [c for c in own if c not in there]
            for digest, schema in self.store.schemas().items():
                if digest not in known:
                    other.put_schema(schema)
            if new:
                records = StoragePeer(self.store).records(new)
                with self.store.work(other.missing(records.where("kind <> 's'").select("digest"))) as wanted:
                    if lost := wanted.join(self.store.objects().select("digest"), "digest", "left_anti").take(1):
                        raise FileNotFoundError(f"value {lost[0][0]} is neither here nor at {remote!r}; fetch its data first")
                    other.take_values(self.store.objects().join(wanted, "digest", "left_semi"))
                other.take_records(records)
                for c in reversed(new):
                    other.put_commit(c, self.store.commits()[c])
            other.move_head(branch, theirs, mine)
        self.store.set_heads(self.store.heads() | {f"{remote}/{branch}": mine})
        return branch
