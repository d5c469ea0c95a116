"""Diffs between checkouts, branches and commits, as DataFrames with readable views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import decode_key
from ..operators import algebra, history
from ..sources.store import Store


def record_key(row) -> tuple:
    """(column,) of a schema record, else (column, sample[, subsample]) with typed keys."""
    if row["kind"] == "s":
        return (row["col"],)
    return (row["col"], decode_key(row["sample_key"]), *([decode_key(row["subsample_key"])] if row["kind"] == "n" else []))


@dataclass(frozen=True)
class Changes:
    """Of one kind of change: schemas by column, and keys of samples."""

    schema: dict[str, str]
    samples: tuple[tuple, ...]


class Diff:
    """``changes`` and ``conflicts`` are DataFrames; the properties collect them for reading."""

    def __init__(self, changes: DataFrame, conflicts: DataFrame | None = None):
        self.changes, self.conflicts = changes, conflicts

    @cached_property
    def _rows(self) -> list:
        return self.changes.orderBy("kind", "col", "sample_key", "subsample_key").collect()

    def _of(self, change: str) -> Changes:
        rows = [r for r in self._rows if r["change"] == change]
        return Changes({r["col"]: r["digest"] for r in rows if r["kind"] == "s"}, tuple(record_key(r) for r in rows if r["kind"] != "s"))

    @property
    def added(self) -> Changes:
        return self._of(algebra.ADDED)

    @property
    def deleted(self) -> Changes:
        return self._of(algebra.DELETED)

    @property
    def mutated(self) -> Changes:
        return self._of(algebra.MUTATED)

    @cached_property
    def conflict(self) -> dict[str, list[tuple]]:
        """Keys by conflict type: t1, t21, t22, t3."""
        out: dict[str, list[tuple]] = {t: [] for t in ("t1", "t21", "t22", "t3")}
        if self.conflicts is not None:
            for r in self.conflicts.orderBy("kind", "col", "sample_key", "subsample_key").collect():
                out[r["conflict"]].append(record_key(r))
        return out

    @property
    def has_conflict(self) -> bool:
        return self.conflicts is not None and not self.conflicts.isEmpty()


def all_conflicts(base: DataFrame, mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Conflicts by key, and columns that both sides made with different layouts, as t1."""
    layouts = algebra.layout_conflicts(base, mine, theirs).select(F.lit("s").alias("kind"), "col", F.lit("").alias("sample_key"), F.lit("").alias("subsample_key"), F.lit("t1").alias("conflict"))
    return algebra.conflicts(base, mine, theirs).unionByName(layouts)


def compare(store: Store, mine_commit: str, mine: DataFrame, theirs_commit: str) -> Diff:
    """Where the other side descends from this one, what leads there; where they diverged, what this side has beyond the other, and conflicts."""
    parents, times = store.parents(), store.times()
    theirs = store.refs(theirs_commit)
    if mine_commit in history.ancestors(parents, theirs_commit):
        return Diff(algebra.diff(mine, theirs))
    base = store.refs(history.common_ancestor(parents, times, mine_commit, theirs_commit) or "")
    return Diff(algebra.diff(theirs, mine), all_conflicts(base, mine, theirs))


class Differ:
    """``checkout.diff``."""

    def __init__(self, store: Store, commit: str, records: Callable[[], DataFrame], staged: bool):
        self._store, self._commit, self._records, self._staged = store, commit, records, staged

    def commit(self, digest: str) -> Diff:
        if digest not in self._store.commits():
            raise ValueError(f"no commit {digest!r}")
        return compare(self._store, self._commit, self._records(), digest)

    def branch(self, name: str) -> Diff:
        heads = self._store.heads()
        if name not in heads:
            raise ValueError(f"no branch {name!r}")
        return compare(self._store, self._commit, self._records(), heads[name])

    def staged(self) -> Diff:
        if not self._staged:
            raise PermissionError("a read checkout has no staging area")
        return Diff(algebra.diff(self._store.refs(self._commit), self._records()))

    def status(self) -> str:
        """CLEAN or DIRTY."""
        if not self._staged:
            raise PermissionError("a read checkout has no staging area")
        records = self._records()
        return "CLEAN" if not self._store.files.exists("staging") or algebra.diff(self._store.refs(self._commit), records).isEmpty() else "DIRTY"
