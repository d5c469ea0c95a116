"""License scans: ordered signature rules behind a keyword prefilter.

A text is lower-cased (A-Z only) and reduced to its words, single spaces between. Hundreds of rules, each a regular
expression over such text with a keyword, a tier and a confidence, are built from families below. A text that holds
none of the few root words is done; else only rules whose keyword it holds run. Each detection is an interval of
characters. Detections are swept in order of start: one that lies inside a detection of a higher tier, or of its own
tier, is suppressed, so "gnu general public license version 2" hides the bare "general public license" in it.
What is left gives the labels; the score is the highest confidence among them.

Only DataFrame functions run, on each row by itself: no shuffle, no Python. Work is linear in the text for each rule
that runs (interval sums are made in two levels), and in the number of detections after a sort.

Edge cases: a null or empty text has no words, no labels and score 0; a text may be of any length; repeated rows are
scanned one by one; an empty table gives no rows; other columns stay out unless named in ``keep``.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Phrases and labels of the base scan.
BASE_PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Bytes that separate words, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Every rule's keyword holds one of these.
ROOTS = ["licen", "copyright", "rights reserved", "cc by", "cc0", "creative commons", "gpl", "public domain", "permission", "redistribution", "warrant", "beerware", "confidential", "all bugs", "gfdl", "same terms as perl", "good not evil"]
#: Tiers: texts of licences, names with version, names, general notices.
TEXT, VERSIONED, NAMED, NOTICE = 3, 2, 1, 0


def _spaced(version: str) -> str:
    return " ".join(version.split("."))


def _named(names: str) -> str:
    return f"(?:licensed |released |distributed |available |provided |issued |published )?(?:under )?(?:the )?(?:terms of )?(?:the )?{names}"


def _literal(pattern: str) -> str:
    """The longest stretch of plain text that every match of the pattern holds."""
    plain = re.split(r"\(\?:.*?\)\??|\[.*?\]|.\?", pattern)
    return max((x.strip() for x in plain), key=len)


def build_rules() -> list[dict]:
    """The rules in order. A later rule of one tier loses to an earlier one on the same words."""
    rules: list[dict] = []

    def add(label: str, tier: int, keyword: str, regex: str, confidence: float) -> None:
        rules.append({"label": label, "tier": tier, "keyword": keyword, "regex": f"(?<= )(?:{regex})(?= )", "confidence": confidence})

    # Licence texts.
    add("mit", TEXT, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0)
    add("isc", TEXT, "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0)
    add("hpnd", TEXT, "permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted", 1.0)
    add("0bsd", TEXT, "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 1.0)
    add("bsd-3-clause", TEXT, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided (?:[^ ]+ ){1,120}?neither the name", 1.0)
    add("bsd-2-clause", TEXT, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.9)
    add("zlib", TEXT, "warrant", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 1.0)
    add("bsl-1.0", TEXT, "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 1.0)
    add("unlicense", TEXT, "public domain", "this is free and unencumbered software released into the public domain", 1.0)
    add("wtfpl", TEXT, "public license", "do what the fuck you want to public license", 1.0)
    add("beerware", TEXT, "beerware", "(?:the )?beerware license(?: revision 42)?", 1.0)
    add("json", TEXT, "good not evil", "the software shall be used for good not evil", 1.0)
    # The GNU family.
    gnu = [("gpl", r"(?:gnu )?general public license", "gpl", ["1", "2", "3"]), ("lgpl", r"(?:gnu )?(?:lesser|library) general public license", "lgpl", ["2", "2.1", "3"]), ("agpl", r"(?:gnu )?affero general public license", "agpl", ["1", "3"]), ("gfdl", r"(?:gnu )?free documentation license", "gfdl", ["1.1", "1.2", "1.3"])]
    for label, long, short, versions in gnu:
        keyword = _literal(long)
        for v in versions:
            number = _spaced(v) + ("" if "." in v else "(?: 0)?")
            for form, key in ((long, keyword), (f"(?:gnu )?{short}", short)):
                whole = _named(form) + r"(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?v?" + number
                add(f"{label}-{v}-or-later", VERSIONED, key, f"{whole}(?: of the license)? or (?:at your option )?(?:any )?later(?: version)?", 0.98)
                add(f"{label}-{v}-only", VERSIONED, key, f"{whole}(?: of the license)? only", 0.98)
                add(f"{label}-{v}", VERSIONED, key, whole, 0.95)
        add(label, NAMED, keyword, _named(long), 0.85)
        add(label, NAMED, short, _named(f"(?:gnu )?{short}(?: license| licence)?"), 0.6)
    # Creative Commons.
    parts = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
    for kind in ["by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by"]:
        label, long = "cc-" + "-".join(kind.split()), " ".join(parts[k] for k in kind.split())
        for v in ["1.0", "2.0", "2.5", "3.0", "4.0"]:
            major, minor = v.split(".")
            number = rf"(?:version |v)?{major}(?: {minor})?" if minor == "0" else rf"(?:version |v)?{major} {minor}"
            add(f"{label}-{v}", VERSIONED, "cc by", _named(f"(?:a )?cc {kind} {number}(?: international| unported| generic)?(?: license| licence)?"), 0.95)
            add(f"{label}-{v}", VERSIONED, "creative commons", _named(f"(?:a )?creative commons {long}(?: license| licence)? {number}(?: international| unported| generic)?(?: license| licence)?"), 0.95)
        add(label, NAMED, "cc by", _named(f"(?:a )?cc {kind}(?: license| licence)?"), 0.8)
        add(label, NAMED, "creative commons", _named(f"(?:a )?creative commons {long}(?: license| licence)?"), 0.85)
    add("cc0-1.0", VERSIONED, "cc0", _named("(?:creative commons )?cc0 1 0(?: universal)?(?: public domain dedication)?"), 0.95)
    add("cc0", NAMED, "cc0", _named("(?:creative commons )?cc0"), 0.8)
    add("creative-commons", NOTICE, "creative commons", _named("(?:a )?creative commons(?: license| licence)?"), 0.6)
    # Names with versions: label, name, versions.
    versioned = [
        ("apache", "apache(?: software)? license", ["1.0", "1.1", "2.0"]),
        ("mpl", "mozilla public license", ["1.0", "1.1", "2.0"]),
        ("epl", "eclipse public license", ["1.0", "2.0"]),
        ("cddl", "common development and distribution license", ["1.0", "1.1"]),
        ("cpl", "common public license", ["1.0"]),
        ("ipl", "ibm public license", ["1.0"]),
        ("eupl", "european union public licen[cs]e", ["1.0", "1.1", "1.2"]),
        ("osl", "open software license", ["1.0", "1.1", "2.0", "2.1", "3.0"]),
        ("afl", "academic free license", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
        ("artistic", "artistic license", ["1.0", "2.0"]),
        ("bsl", "boost software license", ["1.0"]),
        ("ofl", "(?:sil )?open font license", ["1.0", "1.1"]),
        ("odbl", "open (?:data commons open )?database license", ["1.0"]),
        ("odc-by", "open data commons attribution license", ["1.0"]),
        ("pddl", "public domain dedication(?: and| &)? license", ["1.0"]),
        ("php", "php license", ["3.0", "3.01"]),
        ("zpl", "zope public license", ["1.1", "2.0", "2.1"]),
        ("lppl", "latex project public license", ["1.0", "1.1", "1.2", "1.3"]),
        ("psf", "python software foundation license", ["2.0"]),
        ("psf", "psf license", ["2.0"]),
        ("upl", "universal permissive license", ["1.0"]),
        ("blueoak", "blue oak model license", ["1.0"]),
        ("apsl", "apple public source license", ["1.0", "1.1", "1.2", "2.0"]),
        ("qpl", "q public license", ["1.0"]),
        ("rpl", "reciprocal public license", ["1.1", "1.5"]),
        ("spl", "sun public license", ["1.0"]),
        ("npl", "netscape public license", ["1.0", "1.1"]),
        ("nposl", "non profit open software license", ["3.0"]),
        ("ecl", "educational community license", ["1.0", "2.0"]),
        ("efl", "eiffel forum license", ["1.0", "2.0"]),
        ("cecill", "cecill(?: free software)? license(?: agreement)?", ["1.0", "2.0", "2.1"]),
        ("mulan", "mulan permissive software license", ["1.0", "2.0"]),
        ("openrail", "(?:bigscience |creativeml )?open ?rail(?: m)? license", ["1.0"]),
        ("bigcode-openrail", "bigcode open ?rail(?: m)? license", ["1.0"]),
        ("busl", "business source license", ["1.0", "1.1"]),
        ("sspl", "server side public license", ["1.0"]),
        ("elastic", "elastic license", ["1.0", "2.0"]),
        ("polyform", "polyform (?:noncommercial|small business|strict|shield) license", ["1.0"]),
        ("w3c", "w3c (?:software (?:and document )?)?license", ["1.0", "2.0"]),
        ("oldap", "openldap public license", ["1.4", "2.0", "2.7", "2.8"]),
        ("cpal", "common public attribution license", ["1.0"]),
        ("ms-pl", "microsoft public license", ["1.0"]),
        ("ms-rl", "microsoft reciprocal license", ["1.0"]),
    ]
    for label, name, versions in versioned:
        for v in versions:
            number = _spaced(v) if not v.endswith(".0") else v.split(".")[0] + "(?: 0)?"
            add(f"{label}-{v}", VERSIONED, _literal(name), _named(rf"{name}(?: version| v)? v?{number}"), 0.95)
        add(label, NAMED, _literal(name), _named(name), 0.85)
    # Names without versions.
    for label, name in [
        ("mit", "mit licen[cs]e"),
        ("mit", "mit x11 licen[cs]e"),
        ("mit", "expat licen[cs]e"),
        ("x11", "x11 licen[cs]e"),
        ("isc", "isc licen[cs]e"),
        *[("bsd-0-clause", f"{x} licen[cs]e") for x in ("0bsd", "zero clause bsd", "bsd zero clause")],
        *[("bsd-2-clause", f"{x} licen[cs]e") for x in ("simplified bsd", "freebsd", "2 clause bsd", "bsd 2 clause", "two clause bsd")],
        *[("bsd-3-clause", f"{x} licen[cs]e") for x in ("new bsd", "revised bsd", "modified bsd", "3 clause bsd", "bsd 3 clause", "three clause bsd")],
        *[("bsd-4-clause", f"{x} licen[cs]e") for x in ("original bsd", "4 clause bsd", "bsd 4 clause", "four clause bsd")],
        ("bsd", "bsd(?: style)? licen[cs]e"),
        ("bsd", "berkeley(?: software distribution)?(?: style)? licen[cs]e"),
        ("zlib", "zlib(?: libpng)? licen[cs]e"),
        ("ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
        ("ruby", "ruby licen[cs]e"),
        ("vim", "vim licen[cs]e"),
        ("openssl", "openssl licen[cs]e"),
        ("sleepycat", "sleepycat licen[cs]e"),
        ("curl", "curl licen[cs]e"),
        ("unicode", "unicode(?: terms of use| data files and software)? licen[cs]e"),
        ("perl", "same terms as perl(?: itself)?(?: licen[cs]e)?"),
        ("fair", "fair licen[cs]e"),
        ("naumen", "naumen public licen[cs]e"),
        ("postgresql", "postgresql licen[cs]e"),
        ("intel", "intel open source licen[cs]e"),
        ("nist", "nist software licen[cs]e"),
        ("llama", "llama (?:2 |3 )?community licen[cs]e(?: agreement)?"),
        ("gemma", "gemma(?: terms of use)? licen[cs]e"),
    ]:
        add(label, NAMED, _literal(name), _named(name), 0.85)
    # SPDX tags, for which ids are given as words.
    for v in ["mit", "isc", "zlib", "apache 2 0", "apache 1 1", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 only", "lgpl 3 0 or later", "agpl 3 0 only", "agpl 3 0 or later", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "0bsd", "mpl 2 0", "epl 1 0", "epl 2 0", "cddl 1 0", "bsl 1 0", "unlicense", "cc0 1 0", "cc by 3 0", "cc by 4 0", "cc by sa 3 0", "cc by sa 4 0", "cc by nc 4 0", "cc by nd 4 0", "cc by nc sa 4 0", "cc by nc nd 4 0", "artistic 2 0", "ofl 1 1", "wtfpl", "ms pl", "eupl 1 2", "upl 1 0", "postgresql", "ncsa", "psf 2 0", "blueoak 1 0 0", "mulanpsl 2 0"]:
        label = v.replace(" ", "-") if not any(c.isdigit() for c in v) or "clause" in v or v == "0bsd" else _spdx(v)
        add(label, TEXT, "spdx license identifier", f"spdx license identifier {v}", 1.0)
    # General notices.
    add("copyright", NOTICE, "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}", 0.4)
    add("copyright", NOTICE, "copyright", "copyright(?:ed)? by", 0.35)
    add("reserved", NOTICE, "rights reserved", "all rights reserved", 0.5)
    add("reserved", NOTICE, "rights reserved", "some rights reserved", 0.45)
    add("public-domain", NOTICE, "public domain", "(?:in|into|to) the public domain", 0.5)
    add("proprietary", NOTICE, "confidential", "(?:proprietary and confidential|confidential and proprietary)", 0.6)
    add("proprietary", NOTICE, "permission", "may not be (?:reproduced|copied|distributed)(?: [^ ]+){0,12} without (?:the )?(?:prior )?(?:express )?(?:written )?permission", 0.6)
    add("no-warranty", NOTICE, "warrant", "without warrant(?:y|ies) (?:or conditions )?of any kind", 0.4)
    add("unknown-license", NOTICE, "licen", "(?:licensed|licenced|released) under (?:the )?(?:[^ ]+ ){1,4}licen[cs]e", 0.3)
    return rules


def _spdx(words: str) -> str:
    out, last = "", ""
    for w in words.split():
        out += ("." if w.isdigit() and last.isdigit() else "-" if out else "") + w
        last = w
    return out


RULES = build_rules()


def normal_text(text: Column) -> Column:
    """Words of the text with one space before, between and after."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, SEPARATORS, " ")), F.lit(" "))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def running(lengths: Column, chunk: int = 512) -> Column:
    """Sums of all numbers before each, in two levels so that long arrays stay cheap."""

    def before(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a"))
        return F.aggregate(xs, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")))["a"]

    def whole(chunks: Column) -> Column:
        offsets = before(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)))
        return let(offsets, lambda o: F.flatten(F.transform(chunks, lambda c, k: F.transform(before(c), lambda v: v + F.get(o, k)))))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / chunk).cast("int")), lambda k: F.slice(lengths, k * chunk + 1, F.lit(chunk)))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(let(parts, whole))


def _rule_groups() -> Column:
    """The rules by keyword, as one constant."""
    groups: dict[str, list[Column]] = {}
    for i, r in enumerate(RULES):
        groups.setdefault(r["keyword"], []).append(F.struct(F.lit(i).alias("i"), F.lit(r["tier"]).alias("tier"), F.lit(r["label"]).alias("label"), F.lit(r["regex"]).alias("regex"), F.lit(r["confidence"]).alias("confidence")))
    return F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*v).alias("rules")) for k, v in groups.items()])


def detections(norm: Column) -> Column:
    """All detections: array of (start, minus_end, minus_tier, i, label, confidence), sorted so that what holds an interval stands before it."""

    def of(r: Column) -> Column:
        found = F.regexp_extract_all(norm, r["regex"], F.lit(0))

        def placed(m: Column) -> Column:
            gaps = F.transform(F.split(norm, r["regex"], -1), lambda g: F.length(g))
            steps = F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, x: g + F.length(x))
            starts = F.zip_with(running(steps), gaps, lambda s, g: s + g)
            return F.transform(F.slice(F.arrays_zip(starts.alias("s"), m.alias("m")), 1, F.size(m)), lambda z: F.struct(z["s"].alias("start"), (-(z["s"] + F.length(z["m"]))).alias("minus_end"), (-r["tier"]).alias("minus_tier"), r["i"].alias("i"), r["label"].alias("label"), r["confidence"].alias("confidence")))

        empty = F.array().cast("array<struct<start:int,minus_end:int,minus_tier:int,i:int,label:string,confidence:double>>")
        return let(found, lambda m: F.when(F.size(m) == 0, empty).otherwise(placed(m)))

    rules = F.flatten(F.transform(F.filter(_rule_groups(), lambda g: F.contains(norm, g["keyword"])), lambda g: g["rules"]))
    return F.sort_array(F.flatten(F.transform(rules, of)))


def kept(sorted_detections: Column) -> Column:
    """Labels and score of the detections that no detection of their own or a higher tier holds."""
    start = F.struct(F.array(*[F.lit(-1)] * 4).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc: Column, d: Column) -> Column:
        end, tier = -d["minus_end"], -d["minus_tier"]
        inside = F.exists(F.slice(acc["ends"], tier + 1, 4 - tier), lambda e: e >= end)
        ends = F.transform(acc["ends"], lambda e, t: F.when(t == tier, F.greatest(e, end)).otherwise(e))
        labels = F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"])))
        return F.struct(ends.alias("ends"), labels.alias("labels"), F.when(inside, acc["score"]).otherwise(F.greatest(acc["score"], d["confidence"])).alias("score"))

    return F.aggregate(sorted_detections, start, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["score"].alias("score")))


def _base(norm: Column) -> Column:
    """(n, first, last, labels) of the base phrases: all places, word numbers of the first and last, labels found."""
    found = []
    for phrase, label in BASE_PHRASES:
        spaced = f" {phrase} "
        n = F.size(F.split(norm, f"(?<= ){phrase}(?= )", -1)) - 1
        first = _spaces(F.substr(norm, F.lit(1), F.instr(norm, spaced))) - 1
        back = F.instr(F.reverse(norm), spaced[::-1])
        last = _spaces(F.substr(norm, F.lit(1), F.length(norm) - back - len(spaced) + 2)) - 1
        found.append(F.when(F.contains(norm, F.lit(spaced)), F.struct(n.alias("n"), first.alias("first"), last.alias("last"), F.lit(label).alias("label"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    own = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("keep"), normal_text(F.col(f"`{text}`")).alias("norm"))
    norm = F.col("norm")
    rooted = F.lit(False)
    for root in ROOTS:
        rooted = rooted | F.contains(norm, F.lit(root))
    none = F.array().cast("array<struct<start:int,minus_end:int,minus_tier:int,i:int,label:string,confidence:double>>")
    out = out.select("*", rooted.alias("rooted"))
    out = out.select(
        "keep",
        F.when(norm == "  ", 0).otherwise(_spaces(norm) - 1).cast("long").alias("n_words"),
        F.when(F.col("rooted"), _base(norm)).otherwise(F.array().cast("array<struct<n:int,first:int,last:int,label:string>>")).alias("base"),
        F.when(F.col("rooted"), detections(norm)).otherwise(none).alias("found"),
    )
    base = F.col("base")
    out = out.select("keep", "n_words", "base", F.transform(base, lambda b: b["label"]).alias("base_labels"), kept(F.col("found")).alias("kept"))

    def joined(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(labels)), ",")

    return out.select(
        *[F.col("keep")[c].alias(c) for c in keep if c.lower() not in own],
        "n_words",
        F.aggregate(base, F.lit(0), lambda s, b: s + b["n"]).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda b: b["last"])).cast("long").alias("last_word"),
        joined(F.col("base_labels")).alias("base_labels"),
        joined(F.concat("base_labels", F.col("kept")["labels"])).alias("labels"),
        F.when((F.size("base_labels") > 0) & (F.col("kept")["score"] == 0), 0.5).otherwise(F.col("kept")["score"]).alias("score"),
    )
