"""Quality rules: word and line heuristics, then distribution divergence from the document's language.

Every document gets two histograms, over character classes and over its language's common words. Each is
compared to the language's reference (the mean histogram of all documents of that language that the base rules
keep, the far ones left out in a second pass) by the Jensen-Shannon distance. A document goes when the base rules fail it, or when a distance is over its
limit and the document is long enough for that histogram to mean something (the minimum-length guards).

References are learned from the documents that are judged, or given: ``learn_references`` makes the table of a trusted
corpus once, and with it a verdict depends on the document alone.

Only DataFrame functions run. The references are one row for each language of ``COMMON_WORDS`` and one for all
other languages, five rows at most, so they are broadcast. No text is shuffled; the features are written once,
with the columns to return, so that references and verdicts don't scan the texts twice. With references given nothing is written.

Edge cases: a null or empty text has no words, all counts are 0 and it fails the base rules; null or unknown
languages share one reference and have no common words; an empty table gives an empty result; repeated rows are
judged one by one; very long texts are counted whole (windows of more than 2^24 words by the words themselves, with the
same result); other columns of the input are ignored, or returned as they are by ``filter_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, let

#: Frequent function words by language code.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a"],
}
OTHER = ""
#: Largest distances that pass, and the least characters or words for the distance to count.
LIMITS = {"class_distance": 0.19, "word_distance": 0.32, "min_chars": 200, "min_words": 50}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Times the mean distance beyond which a document does not shape its language's reference.
TRIM = 1.5
#: Columns that ``judge`` adds.
VERDICT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]


def _gone(t: Column, pattern: str) -> Column:
    return F.regexp_replace(t, pattern, "")


def _class_counts(solid: Column, n_space: Column) -> Column:
    """Characters by class: white space, small letters, capitals, digits, sentence marks, other ASCII, beyond ASCII.

    ``solid`` is the text without white space. Each step deletes a class and counts what is gone, so later steps scan little.
    """

    def step(t: Column, patterns: list[str], counts: list[Column]) -> Column:
        if not patterns:
            return F.array(*counts, F.length(t))
        return let(_gone(t, patterns[0]), lambda rest: step(rest, patterns[1:], [*counts, F.length(t) - F.length(rest)]))

    return step(solid, ["[a-z]+", "[A-Z]+", "[0-9]+", "[.,;:!?'\"()\\-]+", "[\\x00-\\x7F]+"], [n_space])


def _word_counts(words: Column, language: Column) -> Column:
    """Occurrences of each common word of the language, then of all other words."""

    def counts(listed: list[str]) -> Column:
        forms = [*listed, *[w.capitalize() for w in listed], *[w.upper() for w in listed if len(w) > 1]]
        found = F.transform(F.filter(words, lambda w: w.isin(*forms)), lambda w: F.lower(w))
        each = let(found, lambda f: F.concat(F.array(*[F.size(F.filter(f, same(w))) for w in listed]), F.array(F.size(words) - F.size(f))))
        return each

    def same(listed: str):
        return lambda w: w == F.lit(listed)

    out = F.array(F.size(words))
    for lang, listed in COMMON_WORDS.items():
        out = F.when(language == lang, counts(listed)).otherwise(out)
    return out


def _repeat_words(words: Column) -> Column:
    """Words that stand in a window of three words which the text holds twice or more.

    Forty bits of each window's hash and its place are packed in one number and sorted; neighbours with the same
    bits are compared word by word, and the words that equal windows cover are counted once. A text in which different
    windows share the bits is sorted by the windows themselves.
    """
    n = F.size(words)
    place = F.lit((1 << 24) - 1).cast("long")

    def packed(w: Column) -> Column:
        return F.sort_array(F.transform(F.slice(w, 1, n - 2), lambda x, i: F.shiftleft(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), 24).bitwiseOR(i.cast("long"))))

    def same(w: Column, a: Column, b: Column) -> Column:
        def at(x: Column, k: int) -> Column:
            return F.get(w, x.bitwiseAND(place).cast("int") + k)

        return F.when(F.shiftright(a, 24) != F.shiftright(b, 24), False).otherwise((at(a, 0) == at(b, 0)) & (at(a, 1) == at(b, 1)) & (at(a, 2) == at(b, 2)))

    def covered(w: Column, s: Column) -> Column:
        again = F.filter(s, lambda x, k: F.coalesce(same(w, x, F.get(s, k + 1)), F.lit(False)) | F.coalesce(F.when(k > 0, same(w, F.get(s, k - 1), x)), F.lit(False)))
        at = F.transform(again, lambda x: x.bitwiseAND(place).cast("int"))
        return let(at, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)))))

    def mixed(w: Column, s: Column) -> Column:
        """Whether neighbours share the bits but not the words; so do some of any windows that share the bits unless all are equal."""
        return F.size(F.filter(s, lambda x, k: F.coalesce((F.shiftright(x, 24) == F.shiftright(F.get(s, k + 1), 24)) & ~same(w, x, F.get(s, k + 1)), F.lit(False)))) > 0

    def wide(w: Column) -> Column:
        sorted_ = F.sort_array(F.transform(F.slice(w, 1, n - 2), lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))))

        def count(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (F.get(s, k + 1)["g"] == x["g"]) | (F.when(k > 0, F.get(s, k - 1)["g"]) == x["g"]))
            return let(F.transform(again, lambda x: x["i"]), lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)))))

        return let(sorted_, count)

    narrow = let(words, lambda w: let(packed(w), lambda s: F.when(~mixed(w, s), covered(w, s))))
    return F.when(n < 4, F.lit(0)).otherwise(F.coalesce(F.when(n < (1 << 24), narrow), wide(words)))


#: Columns that ``features`` adds.
FEATURES = ["language", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "classes", "common"]


def features(docs: DataFrame) -> DataFrame:
    """From columns keep, text, lang: keep and FEATURES.

    The words are a column of their own, used many times, so Catalyst works them out once a row.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    language = F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit(OTHER))
    bare = F.btrim(t, F.lit(" \t\n\x0b\f\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))
    out = docs.select("keep", t.alias("t"), language.alias("language"), words.alias("words"))
    out = out.select("*", F.array_join("words", "").alias("solid"))
    words, t, solid = F.col("words"), F.col("t"), F.col("solid")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    return out.select(
        "keep",
        "language",
        F.size(words).cast("long").alias("n_words"),
        F.length(solid).cast("long").alias("word_chars"),
        F.length(_gone(solid, "[^#*$%&|<>]+")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).cast("long").alias("n_repeat_words"),
        F.length(t).alias("n_chars"),
        _class_counts(solid, F.length(t) - F.length(solid)).alias("classes"),
        _word_counts(words, F.col("language")).alias("common"),
    )


def _share(counts: Column) -> Column:
    return let(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(counts, lambda x: F.when(s > 0, x / s).otherwise(F.lit(0.0))))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence to base 2, from 0 to 1; arrays of shares of one length."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _means(found: DataFrame) -> DataFrame:
    """Mean histograms by language: ref_language, ref_classes, ref_common. Merged on the map side: one small row a task and language."""
    shares = found.select("language", _share(F.col("classes")).alias("c"), _share(F.col("common")).alias("m"))
    n_c, n_m = 7, 1 + max(map(len, COMMON_WORDS.values()))
    means = shares.groupBy("language").agg(*[F.avg(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(n_c)], *[F.avg(F.get("m", F.lit(i))).alias(f"m{i}") for i in range(n_m)])
    common = F.filter(F.array(*[f"m{i}" for i in range(n_m)]), lambda x: x.isNotNull())
    return means.select(F.col("language").alias("ref_language"), F.array(*[f"c{i}" for i in range(n_c)]).alias("ref_classes"), common.alias("ref_common"))


def _with_distances(found: DataFrame, refs: DataFrame) -> DataFrame:
    got = found.join(F.broadcast(refs), F.col("language") == F.col("ref_language"), "left")
    cd = F.when(F.col("ref_classes").isNotNull(), js_distance(_share(F.col("classes")), F.col("ref_classes")))
    wd = F.when(F.col("ref_common").isNotNull() & (F.col("language") != OTHER), js_distance(_share(F.col("common")), F.col("ref_common")))
    return got.select("*", cd.alias("class_distance"), wd.alias("word_distance")).drop("ref_language", "ref_classes", "ref_common")


def references(found: DataFrame, min_chars: int) -> DataFrame:
    """From FEATURES, over all documents of a language that are long enough and pass the base rules: ref_language, ref_classes, ref_common.

    The mean is taken twice: the second time without those farther from the first mean than TRIM times the mean
    distance, so that odd documents don't pull the reference towards themselves.
    """
    usable = found.where((F.col("n_chars") >= min_chars) & ~_base_failed()).select(*FEATURES)
    first = _with_distances(usable, _means(usable))
    cuts = first.groupBy(F.col("language").alias("cut_language")).agg((TRIM * F.avg("class_distance")).alias("cut_c"), (TRIM * F.avg("word_distance")).alias("cut_w"))
    near = first.join(F.broadcast(cuts), F.col("language") == F.col("cut_language"))
    return _means(near.where((F.col("class_distance") <= F.col("cut_c")) & F.coalesce(F.col("word_distance") <= F.col("cut_w"), F.lit(True))))


def _packed(docs: DataFrame, keep: list[str], text: str, lang: str) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("keep"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))


def learn_references(docs: DataFrame, text: str = "text", lang: str = "lang", limits: dict | None = None) -> DataFrame:
    """The references of a corpus, to be written and given to later runs: ref_language, ref_classes, ref_common; five rows at most."""
    return references(cut(features(_packed(docs, [text], text, lang)).drop("keep")), (LIMITS | (limits or {}))["min_chars"])


def _judged(docs: DataFrame, keep: list[str], text: str, lang: str, limits: dict | None, refs: DataFrame | None = None) -> DataFrame:
    """Without references given, the features are worked out once and written: the references and the verdicts both read them."""
    limits = LIMITS | (limits or {})
    found = features(_packed(docs, keep, text, lang))
    if refs is None:
        found = cut(found)
        refs = references(found, limits["min_chars"])
    got = _with_distances(found, refs)
    far = (F.col("n_chars") >= limits["min_chars"]) & (F.coalesce("class_distance", F.lit(0.0)) > limits["class_distance"])
    far = far | (F.col("n_words") >= limits["min_words"]) & (F.coalesce("word_distance", F.lit(0.0)) > limits["word_distance"])
    failed = _base_failed()
    return got.select("*", failed.alias("base_failed"), F.when(failed, False).otherwise(~far).alias("kept"))


def judge(docs: DataFrame, keep: list[str] | None = None, text: str = "text", lang: str = "lang", limits: dict | None = None, refs: DataFrame | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with those of VERDICT, to which equally named ones give way."""
    keep = docs.columns if keep is None else keep
    got = _judged(docs, keep, text, lang, limits, refs)
    return got.select(*[F.col("keep")[c].alias(c) for c in keep if c.lower() not in VERDICT], *VERDICT)


def filter_documents(docs: DataFrame, text: str = "text", lang: str = "lang", limits: dict | None = None, refs: DataFrame | None = None) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``."""
    return _judged(docs, docs.columns, text, lang, limits, refs).where("kept").select(*[F.col("keep")[c].alias(c) for c in docs.columns])
