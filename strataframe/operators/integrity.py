"""Checks of a store as anti-joins; each gives the rows at fault, none if all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import object_digest


def heads_without_commit(heads: DataFrame, commits: DataFrame) -> DataFrame:
    return heads.join(commits.select("digest"), "digest", "left_anti")


def parents_missing(commits: DataFrame) -> DataFrame:
    """(digest, parent) of parents that are no commits."""
    edges = commits.select("digest", F.explode("parents").alias("parent"))
    return edges.join(commits.select(F.col("digest").alias("parent")), "parent", "left_anti").select("digest", "parent")


def roots(commits: DataFrame) -> DataFrame:
    return commits.where(F.size("parents") == 0).select("digest")


def refs_without_object(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct digests of data records that are neither stored nor known as remote."""
    return refs.where("kind <> 's'").select("digest").distinct().join(known.select("digest"), "digest", "left_anti")


def refs_without_schema(refs: DataFrame, schemas: DataFrame) -> DataFrame:
    return refs.where("kind = 's'").select("digest").distinct().join(schemas.select(F.col("schema_digest").alias("digest")), "digest", "left_anti")


def orphan_samples(refs: DataFrame) -> DataFrame:
    """(commit, col, n): samples of columns that have no schema record in their commit; readers don't see them."""
    have = refs.where("kind = 's'").select("commit", "col").distinct()
    return refs.where("kind <> 's'").join(have, ["commit", "col"], "left_anti").groupBy("commit", "col").agg(F.count("*").alias("n"))


def objects_changed(objects: DataFrame) -> DataFrame:
    """(digest, found) of stored values whose bytes no longer have their digest."""
    return objects.select("digest", object_digest(F.col("kind")).alias("found")).where("digest <> found")
