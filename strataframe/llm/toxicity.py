"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its lower-cased words and the words' first three to six letters, each hashed to 32 bits; a
document has a term or not. The machine's score is a bias, a weight for each term and, through a short vector for
each term, a weight for each pair, so that two terms that are harmless alone can be toxic together.

Training takes a bounded sample of labelled rows: the first ``SAMPLE`` / 2 of each class in the order of a hash of
their ids, one row an id. Their terms are a table that stays with the executors, which also count in how many
documents of each class a term is. The ``TERMS`` terms that tell the classes apart most (by a chi-squared statistic,
in at least ``MIN_DOCS`` documents) are collected; then each sampled document comes as the numbers of those terms it
has, two bytes each, so the driver holds at most 2 * ``SAMPLE`` * ``TERMS`` bytes whatever texts or repeats there are.
It learns by Adam on the logistic loss; the bias is then set to the classes' shares among all training labels. Every
document is scored on its whole text, on the executors; the model is a few hundred kilobytes.

Edge cases: null and empty texts have no terms and get the bias; without labels of both classes all scores are the
share of toxic labels (0 without any); an id labelled twice is toxic if any label says so; of rows that share a
labelled id, that of least text hash trains, and each is scored; rows whose label or id is null train nothing;
repeated rows are scored one by one; a very long text is one set of terms; an empty table gives an empty result;
columns named as the result's give way to them in ``score``, and ``filter_documents`` returns all columns as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

SAMPLE, TERMS, MIN_DOCS, MIN_CHI = 8_000, 4_096, 4, 12.0
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 8, 12, 256, 0.05, 1e-4, 7
FOLDS = 5
#: Lengths of the word beginnings that are terms, for inflected and compounded words.
PREFIXES = (3, 4, 5, 6)
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text divides by FOLDS."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _of_word(word: str) -> tuple[int, ...]:
    raw = [word, *[f"{word[:k]}*" for k in PREFIXES if len(word) >= k]]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in raw)


def terms(text: str | None) -> np.ndarray:
    """Distinct hashed terms of a text, sorted."""
    found = {h for w in set(_WORD.findall((text or "").lower())) for h in _of_word(w)}
    return np.array(sorted(found), dtype=np.uint32)


@dataclass
class Machine:
    """ids: hashed terms, sorted; bias, weights and vectors of the factorization machine."""

    ids: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def __post_init__(self) -> None:
        self.place = {int(h): i for i, h in enumerate(self.ids)}

    def rows(self, text: str | None, cache: dict[str, tuple[int, ...]]) -> np.ndarray:
        """Numbers of the model's terms that the text has."""
        out: set[int] = set()
        for w in set(_WORD.findall((text or "").lower())):
            got = cache.get(w)
            if got is None:
                if len(cache) > 200_000:
                    cache.clear()
                got = cache[w] = tuple(self.place[h] for h in _of_word(w) if h in self.place)
            out.update(got)
        return np.fromiter(out, dtype=np.int64, count=len(out))

    def score(self, rows: np.ndarray) -> float:
        if not len(rows):
            return _sigmoid(self.bias)
        rows = np.sort(rows)
        v = self.vectors[rows]
        return _sigmoid(self.bias + self.weights[rows].sum() + 0.5 * (np.square(v.sum(0)) - np.square(v).sum(0)).sum())


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def chi_squared(ones: Column, docs: Column, n1: int, n0: int) -> Column:
    """The statistic of a term that ``docs`` documents have, ``ones`` of them toxic, among n1 toxic and n0 other ones."""
    zeros, n = docs - ones, n1 + n0
    gap = ones * (n0 - zeros) - zeros * (n1 - ones)
    return gap * gap * float(n) / F.greatest(F.lit(float(n1) * n0) * docs * (n - docs), F.lit(1e-9))


def select_terms(docs: DataFrame) -> np.ndarray:
    """From (y, terms array<long>): the TERMS terms with the largest chi-squared statistic, sorted."""
    sizes = docs.agg(F.sum("y"), F.count("*")).first()
    n1, n = int(sizes[0] or 0), int(sizes[1])
    if not 0 < n1 < n:
        return np.zeros(0, np.uint32)
    counts = docs.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").cast("double").alias("ones"), F.count("*").cast("double").alias("docs"))
    told = counts.where(F.col("docs") >= MIN_DOCS).select("term", chi_squared(F.col("ones"), F.col("docs"), n1, n - n1).alias("chi")).where(F.col("chi") > MIN_CHI)
    return np.sort(np.array([r["term"] for r in told.orderBy(F.desc("chi"), "term").limit(TERMS).select("term").collect()], dtype=np.uint32))


def fit(docs: list[np.ndarray], y: np.ndarray, share: float, ids: np.ndarray | None = None) -> Machine:
    """Train on sorted term arrays and 0/1 labels, by the terms ``ids`` (all by default); ``share`` is the share of ones among all labels."""
    y = y.astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        p = min(max(share, 1e-9), 1 - 1e-9)
        return Machine(np.zeros(0, np.uint32), float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, FACTORS)))
    ids = np.unique(np.concatenate(docs)) if ids is None else ids
    rows = [np.flatnonzero(np.isin(ids, d, assume_unique=True)) for d in docs]
    rng = np.random.default_rng(SEED)
    n = len(ids)
    params = [np.zeros(1), np.zeros(n), rng.normal(0, 0.01, (n, FACTORS))]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            picked = order[at : at + BATCH]
            sizes = np.array([len(rows[i]) for i in picked])
            flat = np.concatenate([rows[i] for i in picked]) if sizes.sum() else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(picked)), sizes)
            v = params[2][flat]
            sums = np.stack([np.bincount(doc, v[:, f], len(picked)) for f in range(FACTORS)], 1)
            squares = np.bincount(doc, np.square(v).sum(1), len(picked))
            z = params[0][0] + np.bincount(doc, params[1][flat], len(picked)) + 0.5 * (np.square(sums).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[picked]) / len(picked)
            pull = g[doc][:, None] * (sums[doc] - v)
            grads = [np.array([g.sum()]), np.bincount(flat, g[doc], n) + DECAY * params[1], np.stack([np.bincount(flat, pull[:, f], n) for f in range(FACTORS)], 1) + DECAY * params[2]]
            step += 1
            for p, d, m, s in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                s += 0.001 * (np.square(d) - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    sampled, p = y.mean(), min(max(share, 1e-6), 1 - 1e-6)
    bias = params[0][0] + np.log(p / (1 - p)) - np.log(sampled / (1 - sampled))
    return Machine(ids, float(bias), params[1], params[2])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """A machine from the training fold of ``labels`` (doc_id and a 0/1 column), on a bounded sample."""
    known = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull() & ~held_out(F.col(f"`{doc_id}`")))
    known = known.groupBy(F.col(f"`{doc_id}`").alias("_id")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("_y"))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    total = sum(counts.values())
    order = [F.xxhash64("_id"), F.col("_id")]
    sample = known.where("_y = 1").orderBy(*order).limit(SAMPLE // 2).unionByName(known.where("_y = 0").orderBy(*order).limit(SAMPLE // 2))
    texts = docs.select(F.col(f"`{doc_id}`").alias("_doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    found = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    found = found.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_text").alias("draw"), "_text")).alias("_first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["_id"].astype("int64"), "y": b["_y"].astype("int32"), "terms": [terms(t).astype(np.int64) for t in b["_text"]]})

    sampled = cut(found.select("_id", "_y", F.col("_first")["_text"].alias("_text")).mapInPandas(run, "id long, y int, terms array<long>"))
    ids = select_terms(sampled)

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "rows": [np.flatnonzero(np.isin(ids, np.asarray(t, np.uint32))).astype("<u2").tobytes() for t in b["terms"]]})

    got = sampled.mapInPandas(numbers, "id long, y int, rows binary").toPandas().sort_values("id", kind="stable")
    drop(sampled)
    return fit([ids[np.frombuffer(r, "<u2")] for r in got["rows"]], got["y"].to_numpy(), counts.get(1, 0) / total if total else 0.0, ids)


def score(docs: DataFrame, machine: Machine, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with score and predicted (1 from 0.5)."""
    made = ["score", "predicted"]
    names = [c for c in keep if c.lower() not in made]
    inner = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("_tox_text"))
    fields = [f for f in inner.schema.fields if f.name != "_tox_text"]
    whole = docs.sparkSession.sparkContext.broadcast((machine.ids, machine.bias, machine.weights, machine.vectors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, cache = Machine(*whole.value), {}
        for b in batches:
            scores = np.array([m.score(m.rows(t, cache)) for t in b["_tox_text"]], dtype=np.float64)
            yield b.drop(columns="_tox_text").assign(score=scores, predicted=(scores >= 0.5).astype("int32"))

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "score double, predicted int"
    return inner.mapInPandas(run, schema)


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    machine = train(docs, labels)
    return score(docs.select("doc_id", "text"), machine, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, with the columns of ``docs``."""
    machine = train(docs, labels)
    tagged = score(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("text").alias("the_text")), machine, [f"c{i}" for i in range(len(docs.columns))], "the_text")
    return tagged.where("predicted = 0").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
