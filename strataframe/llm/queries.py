"""One production query for each training-data operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import best_fit_packing, chat_format, license_scan, mix_sources, ngram_jaccard, order_minhash, quality_rules, toxicity, url_filters, warc_revisits
from .common import spread, table


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: counts of words, symbols, repeated lines and words, distances from the language's references, verdict."""
    out = quality_rules.judge(spread(table(spark, sf_dir, "documents")), keep=["doc_id"])
    return out.withColumns({c: F.round(c, 9) for c in ("class_distance", "word_distance")})


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each and the training position of the first copy, in that order."""
    mixed = mix_sources.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    ordered = mix_sources.by_position(mixed, "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenized and packed into sequences of 1024 tokens: one row a piece."""
    ship(spark)
    return best_fit_packing.pack_documents(spread(table(spark, sf_dir, "documents")), best_fit_packing.tokenizer_file())


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: places of the base phrases, labels of all rules, score."""
    return license_scan.scan(spread(table(spark, sf_dir, "documents")), keep=["doc_id"])


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl log of all pages, fetched and visited again: each record's outcome and, for a revisit, what it stands for."""
    out = warc_revisits.resolve(warc_revisits.captures_of_pages(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.withColumn("headers", headers)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: fingerprints of the text and of the text edited with its successor, and their likenesses."""
    return order_minhash.with_next(table(ship(spark), sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says the template's own control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_conversations(rows.unionByName(own)))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: class of five-word shingle similarity 0.8 or more, and numbers of links."""
    return ngram_jaccard.join(spread(table(ship(spark), sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: fold, score and prediction of a factorization machine trained on the labels outside the fold."""
    return toxicity.scored_documents(spread(table(ship(spark), sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url: host, path, the base rule that wins and the verdict."""
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rules_table(spark), keep=["page_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_license_scan": op3_license_scan,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_order_minhash": op5_order_minhash,
    "op6_chat_format": op6_chat_format,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_toxicity": op8_toxicity,
    "op9_url_filters": op9_url_filters,
    "op10_quality_rules": op10_quality_rules,
}



def _common_sql() -> str:
    """Counts of each language's common words, in their plain, capitalized and upper-case forms, then of all other words."""
    cases = []
    for lang, listed in quality_rules.COMMON_WORDS.items():
        forms = [sorted({w, w.capitalize(), *([w.upper()] if len(w) > 1 else [])}) for w in listed]
        counts = ", ".join("len(list_filter(words, lambda x: x IN ({})))".format(", ".join(f"'{f}'" for f in own)) for own in forms)
        cases.append(f"WHEN '{lang}' THEN [{counts}]")
    return f"CASE language {' '.join(cases)} ELSE [] END"


_LIMITS = quality_rules.LIMITS
_QUALITY_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang ELSE '' END AS language,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT *, array_to_string(words, '') AS solid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, {_common_sql()} AS listed FROM d
), g AS (
  SELECT doc_id, unnest([{{'i': i, 'g': words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]}} FOR i IN range(1, len(words) - 1)], recursive := true) FROM d
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id
), f AS (
  SELECT s.doc_id, language, CAST(len(words) AS BIGINT) AS n_words, CAST(length(solid) AS BIGINT) AS word_chars, length(t) AS n_chars,
    CAST(length(regexp_replace(solid, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    length(t) - length(solid) AS c0, length(regexp_replace(solid, '[^a-z]+', '', 'g')) AS c1, length(regexp_replace(solid, '[^A-Z]+', '', 'g')) AS c2,
    length(regexp_replace(solid, '[^0-9]+', '', 'g')) AS c3, length(regexp_replace(solid, '[^.,;:!?''"()\-]+', '', 'g')) AS c4, length(regexp_replace(solid, '[^\x00-\x7F]+', '', 'g')) AS ascii,
    listed || [len(words) - coalesce(list_sum(listed), 0)] AS common
  FROM s LEFT JOIN r ON s.doc_id = r.doc_id
), b AS (
  SELECT *, [c0, c1, c2, c3, c4, ascii - c1 - c2 - c3 - c4, word_chars - ascii] AS classes,
    n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f
), x AS (
  SELECT doc_id, language, 'c' AS kind, n_chars >= {_LIMITS["min_chars"]} AND NOT base_failed AS usable, list_sum(classes) AS whole, unnest(classes) AS n, generate_subscripts(classes, 1) AS pos FROM b
  UNION ALL SELECT doc_id, language, 'w', n_chars >= {_LIMITS["min_chars"]} AND NOT base_failed, list_sum(common), unnest(common), generate_subscripts(common, 1) FROM b WHERE language <> ''
), p AS (
  SELECT doc_id, language, kind, usable, pos, CASE WHEN whole > 0 THEN CAST(n AS DOUBLE) / whole ELSE 0 END AS p FROM x
), one AS (
  SELECT language, kind, pos, avg(p) AS q FROM p WHERE usable GROUP BY ALL
), far AS (
  SELECT doc_id, language, kind, any_value(usable) AS usable, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS distance
  FROM p JOIN one USING (language, kind, pos) GROUP BY doc_id, language, kind
), cuts AS (
  SELECT language, kind, {quality_rules.TRIM} * avg(distance) AS cut FROM far WHERE usable GROUP BY language, kind
), near AS (
  SELECT doc_id FROM far JOIN cuts USING (language, kind) WHERE usable GROUP BY doc_id HAVING bool_and(distance <= cut)
), two AS (
  SELECT language, kind, pos, avg(p) AS q FROM p WHERE doc_id IN (SELECT doc_id FROM near) GROUP BY ALL
), e AS (
  SELECT doc_id, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS distance
  FROM p JOIN two USING (language, kind, pos) GROUP BY doc_id, kind
), z AS (
  SELECT b.*, c.distance AS cd, w.distance AS wd FROM b LEFT JOIN e c ON c.doc_id = b.doc_id AND c.kind = 'c' LEFT JOIN e w ON w.doc_id = b.doc_id AND w.kind = 'w'
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 9) AS class_distance, round(wd, 9) AS word_distance,
  NOT base_failed AND NOT (n_chars >= {_LIMITS["min_chars"]} AND coalesce(cd, 0) > {_LIMITS["class_distance"]} OR n_words >= {_LIMITS["min_words"]} AND coalesce(wd, 0) > {_LIMITS["word_distance"]}) AS kept
FROM z
"""

ORACLE_SQL: dict[str, str] = {
    "op10_quality_rules": _QUALITY_SQL,
    "op1_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents
), n AS (
  SELECT source, sum(size) AS source_size FROM d GROUP BY source
), k AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM n
), w AS (
  SELECT *, CASE k WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM k
), b AS (
  SELECT *, cap / w AS ratio,
    (1.5::DOUBLE * sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT level FROM b WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, k, least(cap, coalesce((SELECT level FROM l) * w, cap)) AS target FROM b
), s AS (
  SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, k,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), a AS (
  SELECT *, CAST(round(target) AS BIGINT) AS budget FROM s
), c AS (
  SELECT *, greatest(least(budget - start, size), 0) AS one, greatest(least(budget - start - source_size, size), 0) AS two,
    CASE k WHEN 0 THEN CAST(start AS DOUBLE) / target * 5.0::DOUBLE WHEN 1 THEN CAST(start AS DOUBLE) / target * 2.0::DOUBLE ELSE CAST(start AS DOUBLE) / target END AS area
  FROM a
)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
  CASE WHEN one > 0 THEN round(CASE k
    WHEN 0 THEN 2.0::DOUBLE * area / (7.5::DOUBLE + sqrt(greatest(56.25::DOUBLE - 10.0::DOUBLE * area, 0)))
    WHEN 1 THEN area / 2.0::DOUBLE
    ELSE 2.0::DOUBLE * area / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * area)) END, 9) END AS position
FROM c
""",
    "op4_warc_revisits": r"""
WITH p AS (
  SELECT page_id, url, md5(CAST(page_id AS VARCHAR)) AS draw, '"' || substring(md5(coalesce(html, '')), 1, 12) || '"' AS tag FROM pages
), g AS (
  SELECT *, (position(substring(draw, 1, 1) IN '0123456789abcdef') - 1) * 16 + position(substring(draw, 2, 1) IN '0123456789abcdef') - 1 AS digit,
    'day ' || CAST(CAST(floor(page_id / 10.0) AS BIGINT) AS VARCHAR) AS modified FROM p
), c AS (
  SELECT 2 * page_id AS record_id, url, 4 * page_id AS time, true AS fulls, tag AS etag, modified AS last_modified, digit, tag FROM g
  UNION ALL
  SELECT 2 * page_id + 1, url, 4 * page_id + 1 + digit, false, CASE WHEN digit % 8 = 0 THEN '"changed"' WHEN digit % 8 <> 1 THEN tag END, CASE WHEN digit % 16 <> 1 THEN modified END, digit, tag FROM g
), b AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '#.*$', '') AS bare FROM c
), h AS (
  SELECT *, lower(regexp_extract(bare, '^([^/?]*)', 1)) AS host, substring(bare, length(regexp_extract(bare, '^([^/?]*)', 1)) + 1) AS rest FROM b
), q AS (
  SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/index\.html?$', '/'), '(\.html?|/+)$', '') AS base,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)=[^&]*$'))) AS params FROM h
), k AS (
  SELECT *, CASE WHEN url IS NOT NULL THEN base || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical FROM q
), r AS (
  SELECT *, max(CASE WHEN fulls THEN time END) OVER w AS found_time FROM k
  WINDOW w AS (PARTITION BY canonical ORDER BY time, CASE WHEN fulls THEN 0 ELSE 1 END, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), j AS (
  SELECT r.*, f.record_id AS f_id, f.time AS f_time, f.etag AS f_etag, f.last_modified AS f_modified
  FROM r LEFT JOIN k f ON f.fulls AND f.canonical = r.canonical AND f.time = r.found_time AND NOT r.fulls
), o AS (
  SELECT *, CASE WHEN etag IS NOT NULL AND f_etag IS NOT NULL THEN etag = f_etag ELSE last_modified = f_modified END AS agreed FROM j
), z AS (
  SELECT *, CASE WHEN fulls THEN 'response' WHEN f_id IS NULL THEN 'orphan' WHEN agreed THEN 'resolved' WHEN NOT agreed THEN 'stale' ELSE 'unverified' END AS outcome FROM o
)
SELECT record_id, canonical, outcome, f_id AS refers_to, time - f_time AS age,
  CASE WHEN fulls THEN 'Content-Type: text/html' || chr(10) || 'Date: ' || CAST(time AS VARCHAR) || chr(10) || 'ETag: ' || tag
    WHEN outcome = 'resolved' THEN 'Cache-Control: max-age=' || CAST(digit AS VARCHAR) || chr(10) || 'Content-Type: text/html' || chr(10) || 'ETag: ' || f_etag || chr(10) || 'date: ' || CAST(time AS VARCHAR) END AS headers
FROM z
""",
    "op6_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), m AS (
  SELECT *, CASE WHEN contains(text, '###') OR contains(text, '</turn>') THEN 1 ELSE 0 END AS clash,
    replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '###', '\h') AS safe FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns, max(clash) AS level,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(length(role) + length(text)) AS plain, sum(length(role) + length(safe)) AS escaped
  FROM m GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(9 + 15 * n_turns + CASE WHEN level = 1 THEN escaped ELSE plain END AS BIGINT) AS formatted_chars, CAST(level AS INTEGER) AS level, true AS identical
FROM g
""",
    "op7_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_sort(list_distinct([array_to_string(words[i : i + 4], ' ') FOR i IN range(1, len(words) - 3)])) END AS found FROM w
), t AS (
  SELECT sha256(array_to_string(found, chr(10))) AS t, any_value(found) AS found, min(doc_id) AS least, count(*) AS n_copies FROM s GROUP BY 1
), e AS (
  SELECT t, len(found) AS n, unnest(found) AS g FROM t
), j AS (
  SELECT a.t AS a, b.t AS b FROM e a JOIN e b ON a.g = b.g AND a.t <> b.t AND a.n <= 1.25 * b.n AND b.n <= 1.25 * a.n
  GROUP BY a.t, b.t, a.n, b.n HAVING 10 * count(*) >= 8 * (a.n + b.n - count(*))
), r(t, u) AS (
  SELECT t, t FROM t UNION SELECT r.t, j.b FROM r JOIN j ON r.u = j.a
), c AS (
  SELECT r.t, min(t.least) AS class_id FROM r JOIN t ON t.t = r.u GROUP BY r.t
), l AS (
  SELECT j.a AS t, count(*) AS texts, sum(t.n_copies) AS docs FROM j JOIN t ON t.t = j.b GROUP BY j.a
)
SELECT s.doc_id, c.class_id, CAST(coalesce(l.docs, 0) + t.n_copies - 1 AS BIGINT) AS n_links, CAST(coalesce(l.texts, 0) AS BIGINT) AS n_text_links, CAST(t.n_copies AS BIGINT) AS n_copies
FROM s JOIN t ON t.t = sha256(array_to_string(s.found, chr(10))) JOIN c ON c.t = t.t LEFT JOIN l ON l.t = t.t
""",
    "op9_url_filters": """
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM u
), p AS (
  SELECT page_id, lower(raw) AS host, regexp_extract(substring(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM h
), r AS (
  SELECT page_id, host, path,
    CASE
      WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7'
      WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
      WHEN ('.' || host) LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/'
      WHEN ('.' || host) LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
      WHEN ('.' || host) LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/'
    END AS rule,
    CASE
      WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/adult/%' THEN 'example.com/adult/'
      WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/adult/%' THEN 'example.net/adult/'
      WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/adult/%' THEN 'example.org/adult/'
      WHEN ('.' || host) LIKE '%.ads-track.example.com' THEN 'ads-track.example.com'
      WHEN ('.' || host) LIKE '%.ads-track.example.net' THEN 'ads-track.example.net'
      WHEN ('.' || host) LIKE '%.ads-track.example.org' THEN 'ads-track.example.org'
      WHEN ('.' || host) LIKE '%.doubleclick.net' THEN 'doubleclick.net'
    END AS own_rule
  FROM p
)
SELECT page_id, host, path, rule, own_rule,
  CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL OR own_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r
""",
}
