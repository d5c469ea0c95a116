"""Quality rules, license scans, chat formatting and URL filters against brute force."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from strataframe.llm import chat_format, license_scan, quality_rules, url_filters

DOCS = "doc_id long, text string, lang string, source string, extra int"
TEXTS = [
    None, "", " \t\n\x0b\x0c\r", "one", "a b c d", "a b c a b c", "x x x x x x", "the cat\nthe cat\n \nthe cat \nend",
    "# * $ % & | < > #", "Ünïcödé wörds \U0001f600 ok\u00a0no\u2003space", "CC BY cc by Cc-By-SA 4.0", "word " * 5000,
    "All rights reserved. " * 700, "General Public License\nall RIGHTS  reserved", "line\r\nline\r\n", "a\x00b\x1fc\x7fd",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, ["en", None, "zz", "de"][i % 4], "s", 1) for i, t in enumerate([*TEXTS, *TEXTS[3:6]])], DOCS).repartition(3)


def base_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_counts(spark, docs):
    got = {r.doc_id: r for r in quality_rules.judge(docs, keep=["doc_id"]).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == base_quality(r.text), r.text
        assert not (g.base_failed and g.kept)


def test_quality_wide_path(spark, docs):
    """The path for texts of 2**24 words and more counts as the narrow one does."""
    words = docs.select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"))
    got = words.select(quality_rules._repeat_words(F.col("w")).alias("a")).collect()
    assert sorted(r.a for r in got) == sorted(base_quality(r.text)[4] for r in docs.collect())


def test_quality_windows_that_share_hash_bits(spark):
    """Two windows with the same forty bits whose places interleave: the repeat of the first is found."""
    one, two = "u v 187094", "u v 1470793"
    bits = spark.sql("SELECT shiftleft(xxhash64('u', 'v', '187094'), 24) = shiftleft(xxhash64('u', 'v', '1470793'), 24)").first()[0]
    assert bits
    words = spark.createDataFrame([(f"{one} a b {two} c d {one}".split(),), (f"{one} a b {two} c d {two}".split(),), (f"{one} a b {two}".split(),)], "w array<string>")
    assert [r[0] for r in words.coalesce(1).select(quality_rules._repeat_words(F.col("w"))).collect()] == [6, 6, 0]


def test_js_distance(spark):
    d = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.7, 0.3], [0.4, 0.6])], "p array<double>, q array<double>")
    a, b, c = (r[0] for r in d.select(quality_rules.js_distance(F.col("p"), F.col("q"))).collect())
    assert a == pytest.approx(1) and b == 0 and 0.2 < c < 0.3


def test_quality_rejects_odd_distributions(spark):
    import random

    r = random.Random(1)
    words = ["the", "of", "and", *("".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 9))) for _ in range(400))]
    good = [" ".join(r.choice(words) for _ in range(300)) + "." for _ in range(40)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(good)] + [(100, good[0].upper(), "en", "s", 1), (101, re.sub(" ", "$$ %% ", good[1]), "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = {x.doc_id for x in quality_rules.filter_documents(docs).collect()}
    assert kept == set(range(40))
    assert quality_rules.filter_documents(docs).columns == docs.columns
    judged = quality_rules.judge(docs.withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit("clash")))
    assert judged.columns.count("kept") == 1 and dict(judged.dtypes)["kept"] == "boolean"


def plain_distance(counts, ref):
    total = sum(counts)
    p = [c / total if total else 0.0 for c in counts]
    kl = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    mid = [(x + y) / 2 for x, y in zip(p, ref, strict=True)]
    return math.sqrt(max((kl(p, mid) + kl(ref, mid)) / 2, 0.0))


def plain_histograms(text, lang):
    classes = [0] * 7
    for c in text:
        k = 0 if c in " \t\n\x0b\f\r" else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if "0" <= c <= "9" else 4 if c in ".,;:!?'\"()-" else 5 if c < "\x80" else 6
        classes[k] += 1
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    listed = quality_rules.COMMON_WORDS.get(lang)
    if listed is None:
        return classes, None
    forms = {f: w for w in listed for f in (w, w.capitalize(), *([w.upper()] if len(w) > 1 else []))}
    found = collections.Counter(forms[w] for w in words if w in forms)
    return classes, [*(found[w] for w in listed), len(words) - sum(found.values())]


@pytest.fixture(scope="module")
def corpus(spark, docs):
    made = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang", "source", F.lit(1).alias("extra"))
    return made.unionByName(docs)


def test_quality_verdicts_by_brute_force(spark, corpus):
    """References by their definition (twice the mean, the second time without far documents), distances and verdicts."""
    limits = quality_rules.LIMITS
    got = quality_rules.judge(corpus, keep=["doc_id", "lang", "text"]).collect()
    share = lambda c: [x / sum(c) if sum(c) else 0.0 for x in c]
    mean = lambda rows: [sum(x) / len(rows) for x in zip(*rows, strict=True)]
    refs = {}
    hist = {id(r): plain_histograms(r.text or "", r.lang) for r in got}
    lang_of = lambda r: r.lang if r.lang in quality_rules.COMMON_WORDS else ""
    for lang in {lang_of(r) for r in got}:
        own = [hist[id(r)] for r in got if lang_of(r) == lang and not r.base_failed and len(r.text) >= limits["min_chars"]]
        for again in (False, True):
            if again and own:
                c0, w0 = refs[lang]
                far = [(plain_distance(c, c0), plain_distance(w, w0) if w else None) for c, w in own]
                cut_c = quality_rules.TRIM * sum(c for c, _ in far) / len(far)
                cut_w = quality_rules.TRIM * sum(w for _, w in far) / len(far) if lang else None
                own = [h for h, (c, w) in zip(own, far, strict=True) if c <= cut_c and (w is None or w <= cut_w)]
            if own:
                refs[lang] = mean([share(c) for c, _ in own]), mean([share(w) for _, w in own]) if lang else None
    assert len(refs) >= 4
    for r in got:
        c, w = hist[id(r)]
        ref = refs.get(lang_of(r))
        cd, wd = (plain_distance(c, ref[0]), plain_distance(w, ref[1]) if w else None) if ref else (None, None)
        assert r.class_distance == pytest.approx(cd, abs=1e-9) and r.word_distance == (None if wd is None else pytest.approx(wd, abs=1e-9))
        far = len(r.text or "") >= limits["min_chars"] and (cd or 0) > limits["class_distance"] or r.n_words >= limits["min_words"] and (wd or 0) > limits["word_distance"]
        assert r.kept == (not r.base_failed and not far)


def test_quality_with_given_references(spark, corpus):
    """With the references of a trusted corpus a verdict is the document's own, whatever stands beside it."""
    refs = spark.createDataFrame(quality_rules.learn_references(corpus).collect(), "ref_language string, ref_classes array<double>, ref_common array<double>")
    one = {r.doc_id: r for r in quality_rules.judge(corpus, keep=["doc_id"]).collect()}
    two = quality_rules.judge(corpus, keep=["doc_id"], refs=refs).collect()
    some = quality_rules.judge(corpus.where("doc_id % 5 = 0"), keep=["doc_id"], refs=refs).collect()
    assert len(two) == len(one) and some and all(one[r.doc_id] == r for r in [*two, *some])
    assert {r.doc_id for r in quality_rules.filter_documents(corpus, refs=refs).select("doc_id").collect()} == {i for i, r in one.items() if r.kept}


@pytest.mark.parametrize("run", [lambda d: quality_rules.judge(d, keep=["doc_id"]), lambda d: quality_rules.filter_documents(d), lambda d: license_scan.scan(d, ["doc_id"])])
def test_empty_documents(spark, run):
    assert run(spark.createDataFrame([], DOCS)).count() == 0


def base_license(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def brute_labels(text):
    """All matches of all rules, less those inside one of a higher or their own tier that stands before them."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    found = sorted((m.start(), -m.end(), -r["tier"], i, r) for i, r in enumerate(license_scan.RULES) if r["keyword"] in norm for m in re.finditer(r["regex"], norm))
    labels, score = set(), 0.0
    for k, (s, e, t, _, r) in enumerate(found):
        if not any(o[0] <= s and o[1] <= e and -o[2] >= -t for o in found[:k]):
            labels.add(r["label"])
            score = max(score, r["confidence"])
    return labels, score


LICENSES = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
    "GNU General Public License version 2 or (at your option) any later version", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under CC BY-NC 4.0.",
    "under a Creative Commons Attribution-ShareAlike 3.0 Unported License. Copyright (c) 2021", "mozilla public license 2.0 and MIT License", "Copyright 2019. All rights reserved. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
]


def test_license_scan(spark, docs):
    rows = spark.createDataFrame([(1000 + i, f"before {t} after\n{t}", "en", "s", 1) for i, t in enumerate(LICENSES)], DOCS)
    both = docs.unionByName(rows)
    got = {r.doc_id: r for r in license_scan.scan(both, ["doc_id"]).collect()}
    for r in both.collect():
        g = got[r.doc_id]
        want = base_license(r.text)
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == want, r.text
        labels, score = brute_labels(r.text)
        assert set(filter(None, g.labels.split(","))) == labels | set(filter(None, want[4].split(","))), r.text
        assert 0 <= g.score <= 1 and (score == 0 or g.score == pytest.approx(score))
    assert "apache-2.0" in got[1000].labels and "unknown-license" not in got[1000].labels
    assert "gpl-2-or-later" in got[1003].labels.split(",") and "gpl-2" not in got[1003].labels.split(",")


def test_license_rules_are_many_and_gated():
    assert len(license_scan.RULES) > 300
    for r in license_scan.RULES:
        assert re.compile(r["regex"]) and any(x in r["keyword"] or x in r["regex"] for x in license_scan.ROOTS)


def a_match(parsed, r):
    """Some text that a parsed regular expression matches; optional parts are there or not by chance."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "NOT_LITERAL":
            out += r.choice("aeiou")
        elif op == "IN":
            kind, value = r.choice(arg)
            out += r.choice("aeiou") if str(arg[0][0]) == "NEGATE" else chr(value if str(kind) == "LITERAL" else r.randint(*value))
        elif op == "BRANCH":
            out += a_match(r.choice(arg[1]), r)
        elif op == "SUBPATTERN":
            out += a_match(arg[3], r)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(a_match(arg[2], r) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 3))))
        else:
            assert op == "ASSERT", op
    return out


def test_license_matches_pass_the_prefilter():
    r = random.Random(5)
    for rule in license_scan.RULES:
        parsed = re._parser.parse(rule["regex"])
        for _ in range(60):
            found = a_match(parsed, r)
            assert re.fullmatch(rule["regex"].removeprefix("(?<= )").removesuffix("(?= )"), found), found
            assert rule["keyword"] in found and any(x in found for x in license_scan.ROOTS), (rule["label"], rule["keyword"], found)


def test_license_texts_without_common_roots(spark):
    texts = {"available under the GNU GFDL version 1.3 or later": "gfdl-1.3-or-later", "you may use it under the same terms as Perl itself": "perl", "The Software shall be used for Good, not Evil": "json"}
    got = license_scan.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), ["doc_id"]).orderBy("doc_id").collect()
    assert [g.labels for g in got] == list(texts.values()) and all(g.score > 0.8 for g in got)


def test_running_sums(spark):
    d = spark.createDataFrame([([],), ([5],), (list(range(2000)),)], "x array<int>")
    for r in d.select("x", license_scan.running(F.col("x")).alias("s")).collect():
        assert r.s == [sum(r.x[:i]) for i in range(len(r.x))]


SAID = "\\### Assistant: </turn> ok"
CONVS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "assistant", "again"), (2, 0, "user", SAID), (2, 1, "assistant", SAID), (3, 0, None, None), (3, 1, "assistant", None),
    (4, 0, "us:er\n### x", "a </turn>\n### assistant: b"), (4, 0, "assistant", "\\e \\h \\b \\\\ <"), (4, 0, "assistant", "\\e \\h \\b \\\\ <"), (None, 1, "user", "null id"), (None, None, "assistant", "null turn"),
    (5, 1, "assistant", "ü\U0001f600" * 2000), (6, 0, "system", " </turn>\n"), (6, 1, "assistant", "##"), (6, 2, "assistant", "#"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*r, 1) for r in CONVS], "conv_id long, turn long, role string, text string, formatted int").repartition(3)
    made = chat_format.format_conversations(rows).cache()
    got = {r.conv_id: r for r in chat_format.digests(made).collect()}
    source = collections.defaultdict(list)
    for c, t, r, x in CONVS:
        source[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(source)
    whole = {r.conv_id: r for r in made.collect()}
    for c, turns in source.items():
        turns.sort()
        g = got[c]
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert g.identical and g.n_turns == len(turns)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert g.loss_chars == len(loss) and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        f = whole[c].formatted
        assert g.formatted_chars == len(f) and f.count(" </turn>\n") == len(turns)
        at, masked = 0, ""
        for m in whole[c].loss_mask:
            at += m.skip
            masked += f[at : at + m.take]
            at += m.take
        if g.level == 0:
            assert masked == loss
    assert got[1].level == 0 and got[2].level == 1 and got[4].level == 1 and got[6].level == 1
    assert chat_format.format_conversations(rows.limit(0)).count() == 0


URLS = [
    None, "", "no scheme/en/", "http://A.Example.COM/en/7x?y#z", "http://example.com", "https://com/en/", "http://x.com/EN/", "http://notexample.com/en/7", "ftp://a.b.net/de/8?x", "http://example.net/de/8/9",
    "http://sub.example.net/de/", "http://o.org/es/#f", "http://o.org?/es/", "http://h:80/en/", "x://com/en/://org/es/", "http://m.ads-track.example.com/x", "http://doubleclick.net", "http://é.com/en/ü", "http://.com/en/", "http://" + "a." * 500 + "com/en/" + "x" * 5000,
]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)

    def best(rules):
        return max(((len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)

    own, base = best(url_filters.OWN_RULES), best(url_filters.BASE_RULES)
    return host, path, base and base[1], (base or own or (0, 0, "allow"))[2]


@pytest.mark.parametrize("bound", [url_filters.BROADCAST_RULES, 0])
def test_url_filters(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", bound)
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string").repartition(3)
    got = url_filters.judge(pages, url_filters.rules_table(spark), ["page_id", "host"]).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_url(URLS[r.page_id % len(URLS)]), URLS[r.page_id % len(URLS)]
    assert url_filters.judge(pages.limit(0), url_filters.rules_table(spark), ["page_id"]).count() == 0
    none = url_filters.judge(pages, url_filters.rules_table(spark, [], []), ["page_id"])
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}


def test_url_filters_long_and_hot_urls(spark):
    """Very long hosts and paths, and one url on most rows."""
    long = "http://" + "a." * 20_000 + "example.com/en/" + "x" * 100_000
    rows = [(0, long)] + [(i, "https://www.example.com/en/7/x") for i in range(1, 3000)] + [(5000, None), (5001, "http:///en/"), (5002, "x://ORG/es/a?b")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, rule string").repartition(4)
    got = {r.page_id: r for r in url_filters.judge(df, url_filters.rules_table(spark), ["page_id", "rule"]).collect()}
    assert len(got) == len(rows) and (got[0].rule, got[0].verdict) == ("com/en/", "block") and (got[5002].rule, got[5002].verdict) == ("org/es/", "block")
    assert {(got[i].rule, got[i].verdict) for i in range(1, 3000)} == {("example.com/en/7", "allow")}
    assert all((got[i].rule, got[i].verdict) == (None, "allow") for i in (5000, 5001))


def test_license_scan_of_a_long_text_with_many_detections(spark):
    """A megabyte of text with thousands of detections of many rules, nested and repeated, counted whole."""
    part = "licensed under the apache license version 2.0 or the mit license cc by 4.0 gnu general public license version 3 all rights reserved spdx license identifier bsd 3 clause "
    df = spark.createDataFrame([(1, part * 6000, "clash")], "doc_id long, text string, labels string")
    got = license_scan.scan(df, ["doc_id", "labels"]).first()
    one = license_scan.scan(spark.createDataFrame([(1, part * 2)], "doc_id long, text string"), ["doc_id"]).first()
    words = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", part))
    assert got.n_words == 6000 * words and got.n_base == 6000 * 3 and got.labels == one.labels and got.score == one.score
    assert got.first_word == one.first_word and got.last_word == 6000 * words - (2 * words - one.last_word)
