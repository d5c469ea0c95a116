"""The commit graph. It is small (one row a commit), so walks run on the driver over its edges."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Parents = Mapping[str, Sequence[str]]


def ancestors(parents: Parents, start: str) -> dict[str, list[str]]:
    """The start and all it descends from, with their parents, nearest first."""
    out: dict[str, list[str]] = {}
    queue = deque([start])
    while queue:
        c = queue.popleft()
        if c and c not in out:
            out[c] = list(parents.get(c, []))
            queue.extend(out[c])
    return out


def common_ancestor(parents: Parents, times: Mapping[str, float], a: str, b: str) -> str | None:
    """The common ancestor committed last; of equal times the least digest."""
    both = set(ancestors(parents, a)) & set(ancestors(parents, b))
    return min(both, key=lambda c: (-times[c], c), default=None)


def log_order(parents: Parents, times: Mapping[str, float], start: str) -> list[str]:
    """Start and ancestors, latest first."""
    return sorted(ancestors(parents, start), key=lambda c: (-times[c], c))


def expand_digest(digests: Sequence[str], prefix: str) -> str:
    """The one digest that starts with the prefix; KeyError if none or several do."""
    found = [d for d in digests if d.startswith(prefix)]
    if len(found) != 1:
        raise KeyError(f"{len(found)} commits start with {prefix!r}")
    return found[0]


def head_names(heads: DataFrame) -> DataFrame:
    """digest -> branch names, sorted."""
    return heads.groupBy("digest").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def parents_of(edges: DataFrame) -> dict[str, list[str]]:
    """The graph's parents from its edges (digest, parent); a null parent marks a first commit. One small row an edge comes to the driver."""
    out: dict[str, list[str]] = {}
    for r in edges.select("digest", "parent").toLocalIterator():
        own = out.setdefault(r["digest"], [])
        if r["parent"]:
            own.append(r["parent"])
    return out


def ancestors_table(spark: SparkSession, edges: DataFrame, start: str) -> DataFrame:
    """(digest): the start and all it descends from, by the walk that logs and merges use, whatever the depth and number of merges."""
    return spark.createDataFrame([(c,) for c in ancestors(parents_of(edges), start)], "digest string")
