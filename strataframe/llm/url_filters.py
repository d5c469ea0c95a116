"""URL filters: host-suffix and path-prefix expressions, equi-joined with rules on short hash prefixes.

A url's expressions are each suffix of its host (by labels) with each prefix of its path (of the lengths that rules
have). Their SHA-256 digests meet the rules' on the first eight hex digits, the full digest confirms a hit, and
the longest rule of those that fit wins. Both sides are narrow; equal (host, path) pairs are judged once, merged on
the map side, and the pairs that some rule fits go back to their rows in ``SALTS`` copies, each to a share of the rows,
so a host or url with most of the rows does not make a hot key. Rules are broadcast only when a count
shows at most ``BROADCAST_RULES``; above that the same join shuffles.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; ties of
length go to the longer host, then to block; a very long host or path is tried with the rules' numbers of labels and
lengths only; repeated rows are each judged; empty tables give empty results; other
columns stay out of the result unless named in ``keep``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000
SALTS = 16
SHORT = 8

#: The rules that bind first: verdict, host, path.
BASE_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: The method's own list, for urls that no base rule fits: hosts of advertising and tracking, and adult sections.
OWN_RULES = [
    ("block", "ads-track.example.com", ""),
    ("block", "ads-track.example.net", ""),
    ("block", "ads-track.example.org", ""),
    ("block", "doubleclick.net", ""),
    ("block", "example.com", "/adult/"),
    ("block", "example.net", "/adult/"),
    ("block", "example.org", "/adult/"),
]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^([^?#]*)", 1)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def expressions(host: Column, path: Column, max_labels: int, lengths: list[int]) -> Column:
    """Suffixes of the host with up to ``max_labels`` labels, each with the path's prefixes of the given lengths."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max_labels))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length(path)), lambda k: F.substr(path, F.lit(1), k))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def rules_table(spark, base=BASE_RULES, own=OWN_RULES) -> DataFrame:
    rows = [(v, h, p, True) for v, h, p in base] + [(v, h, p, False) for v, h, p in own]
    return spark.createDataFrame(rows, "verdict string, host string, path string, base boolean")


def judge(urls: DataFrame, rules: DataFrame, keep: list[str], url: str = "url") -> DataFrame:
    """Columns ``keep`` of ``urls`` with host, path, rule (the base rule that wins), own_rule and verdict."""
    bounds = rules.agg(F.max(F.size(F.split("host", r"\.", -1))), F.collect_set(F.length("path")), F.count("*")).first()
    max_labels, lengths, n = bounds[0] or 0, sorted(bounds[1]), bounds[2]
    host, path = split_url(F.col(f"`{url}`"))
    judged = urls.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("keep"), host.alias("host"), path.alias("path"))
    if not n:
        best = None
    else:
        digest = F.sha2(F.concat("host", "path"), 256)
        listed = rules.select(F.substr(digest, F.lit(1), F.lit(SHORT)).alias("short"), digest.alias("full"), "verdict", "base", F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"))
        pairs = judged.select("host", "path").distinct()
        tried = pairs.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), max_labels, lengths)).alias("e"))
        tried = tried.select("host", "path", F.sha2("e", 256).alias("digest")).withColumn("short", F.substr("digest", F.lit(1), F.lit(SHORT)))
        hits = tried.join(F.broadcast(listed) if n <= BROADCAST_RULES else listed, "short").where(F.col("digest") == F.col("full"))
        order = F.struct(F.length("rule"), "host_length", F.col("verdict") == "block")
        won = F.struct("rule", "verdict")
        best = hits.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(
            F.max_by(F.when(F.col("base"), won), F.when(F.col("base"), order)).alias("first"),
            F.max_by(F.when(~F.col("base"), won), F.when(~F.col("base"), order)).alias("second"),
        )
    if best is None:
        out = judged.select("*", F.lit(None).cast("struct<rule:string,verdict:string>").alias("first"), F.lit(None).cast("struct<rule:string,verdict:string>").alias("second"))
    else:
        best = best.withColumn("s", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        salted = judged.withColumn("salt", F.pmod(F.xxhash64("keep"), F.lit(SALTS)).cast("int"))
        out = salted.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")) & (F.col("salt") == F.col("s")), "left")
    names = {"host", "path", "rule", "own_rule", "verdict"}
    return out.select(
        *[F.col("keep")[c].alias(c) for c in keep if c.lower() not in names],
        "host",
        "path",
        F.col("first")["rule"].alias("rule"),
        F.col("second")["rule"].alias("own_rule"),
        F.coalesce(F.col("first")["verdict"], F.col("second")["verdict"], F.lit("allow")).alias("verdict"),
    )
