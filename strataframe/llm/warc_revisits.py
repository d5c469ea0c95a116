"""WARC not-modified revisits, resolved to the full response they stand for.

A revisit record of the server-not-modified profile has no payload: the server said 304. It stands for the latest
earlier response with status 200 for the same canonical url. ``resolve`` finds that response by an as-of join,
compares validators (the entity tag by weak comparison; without tags on both sides the last-modified time) and, where they
agree, merges headers: of the 304's own headers only those that a 304 may update replace the stored ones.

The join is two window passes over narrow rows. All captures are cut into chunks at quantiles of their times, about
``ROWS_PER_CHUNK`` in each and ``CHUNKS`` at least; within a chunk a url's latest response so far is a running value, and
the last one of each chunk is carried into the later chunks by a second pass over one small row for each url and chunk.
So a url with most of the captures is many window partitions, not one, however its times lie (captures of one tick stay
together). Records without url are dealt by a hash of their ids and meet nothing. Payloads don't travel: the result
names the record referred to.

Outcomes: ``response`` (a full response), ``resolved``, ``stale`` (validators differ), ``unverified`` (a validator is
missing on one side), ``orphan`` (no earlier response). Rows at one time: responses come before revisits, then by
record id.

Edge cases: null urls have no canonical url and their revisits are orphans; null times come first; null headers
are empty; header names of any case are one name; very long urls are keys as they are; repeated rows are resolved one
by one; an empty table gives an empty result; other columns
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a 304 that update the stored response; all others of the stored response stay.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
CHUNKS, ROWS_PER_CHUNK = 64, 1_000_000
TRACKING = r"(utm_[a-z]+|ref|gclid|fbclid)=[^&]*"


def canonical_url(url: Column) -> Column:
    """Scheme and fragment gone, host lower-cased without ``www.`` and default ports, tracking parameters, index pages, ``.html`` and last slashes gone."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    rest = F.substr(bare, F.length(host) + 1)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/index\.html?$", "/"), r"(\.html?|/+)$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}$"))), "&")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def merged_headers(stored: Column, own: Column) -> Column:
    """The stored headers with the permitted ones of the 304 in place of theirs; names are compared in lower case."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    stored, new = F.coalesce(stored, empty), F.map_filter(F.coalesce(own, empty), lambda k, v: F.lower(k).isin(*PERMITTED) & v.isNotNull())
    names = F.transform(F.map_keys(new), lambda k: F.lower(k))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(names, F.lower(k))), new)


def chunk_bounds(captures: DataFrame, chunks: int) -> list[int]:
    """Ascending times that cut all captures into about equal parts: ``chunks``, or more beyond ROWS_PER_CHUNK each."""
    n = max(chunks, -(-captures.count() // ROWS_PER_CHUNK))
    if n < 2:
        return []
    found = captures.agg(F.percentile_approx("time", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0]
    return sorted(set(found or []))


def chunk_of(time: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` lie at or before ``time``, by binary search; -1 without a time."""
    if not bounds:
        return F.when(time.isNull(), -1).otherwise(0)
    listed = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) <= time, at + step).otherwise(at))
    return F.when(time.isNull(), -1).otherwise(place)


def resolve(captures: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """From (record_id, url, time long, kind 'response' or 'revisit', status, etag, last_modified, headers map): record_id, canonical, outcome, refers_to, age, headers."""
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    rows = captures.select("record_id", canonical_url(F.col("url")).alias("canonical"), "time", F.coalesce(full, F.lit(False)).alias("full"), "etag", "last_modified", "headers")
    alone = F.concat(F.lit("~"), F.pmod(F.xxhash64("record_id"), F.lit(1 << 20)).cast("string"))
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "canonical"), alone)).withColumn("chunk", chunk_of(F.col("time"), chunk_bounds(captures, chunks)))
    held = F.struct("record_id", "time", "etag", "last_modified", "headers")
    order = [F.asc_nulls_first("time"), F.desc("full"), F.asc_nulls_first("record_id")]
    so_far = Window.partitionBy("key", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    order_of = F.struct(F.coalesce("time", F.lit(-(1 << 62))), "record_id")
    known = rows.where(F.col("canonical").isNotNull())
    marks = known.groupBy("key", "chunk").agg(F.max_by(F.when(F.col("full"), held), F.when(F.col("full"), order_of)).alias("own_last"))
    earlier = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select("key", "chunk", F.last("own_last", ignorenulls=True).over(earlier).alias("carried"))
    here = F.last(F.when(F.col("full"), held), ignorenulls=True).over(so_far)
    got = rows.withColumn("here", here).join(marks, ["key", "chunk"], "left").withColumn("found", F.when(F.col("canonical").isNotNull(), F.coalesce("here", "carried")))
    f = F.col("found")
    tags = _weak(F.col("etag")) == _weak(f["etag"])
    agreed = F.when(F.col("etag").isNotNull() & f["etag"].isNotNull(), tags).otherwise(F.col("last_modified") == f["last_modified"])
    outcome = F.when(F.col("full"), "response").when(f.isNull(), "orphan").when(agreed, "resolved").when(~agreed, "stale").otherwise("unverified")
    out = got.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    return out.select(
        "record_id",
        "canonical",
        "outcome",
        F.when(~F.col("full"), f["record_id"]).alias("refers_to"),
        F.when(~F.col("full"), F.col("time") - f["time"]).alias("age"),
        F.when(F.col("full"), F.col("headers")).when(done, merged_headers(f["headers"], F.col("headers"))).alias("headers"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl log of the pages: each is fetched in full and visited again later, answered 304.

    The draw is the md5 of the page's id. Of revisits, one in eight carries another entity tag and one in eight no
    validator but the time; full responses are dated by page id and revisits up to 255 ticks later.
    """
    draw = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    digit = F.conv(F.substr(draw, F.lit(1), F.lit(2)), 16, 10).cast("long")
    base = pages.select("page_id", "url", draw.alias("draw"), digit.alias("digit"), F.md5(F.coalesce("html", F.lit(""))).alias("body"))
    base = base.withColumn("tag", F.concat(F.lit('"'), F.substr("body", F.lit(1), F.lit(12)), F.lit('"')))
    modified = F.concat(F.lit("day "), F.floor(F.col("page_id") / 10).cast("string"))
    response = base.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 4).alias("time"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.col("tag").alias("etag"), modified.alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.col("tag"), F.lit("Date"), (F.col("page_id") * 4).cast("string")).alias("headers"),
    )
    tag = F.when(F.col("digit") % 8 == 0, F.lit('"changed"')).when(F.col("digit") % 8 != 1, F.concat(F.lit("W/"), F.col("tag")))
    revisit = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 4 + 1 + F.col("digit")).alias("time"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), tag.alias("etag"), F.when(F.col("digit") % 16 != 1, modified).alias("last_modified"),
        F.create_map(F.lit("date"), (F.col("page_id") * 4 + 1 + F.col("digit")).cast("string"), F.lit("Content-Type"), F.lit("text/plain"), F.lit("Cache-Control"), F.concat(F.lit("max-age="), F.col("digit").cast("string"))).alias("headers"),
    )
    return response.unionByName(revisit)
