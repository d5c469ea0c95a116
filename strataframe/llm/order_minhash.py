"""Document fingerprints by Order MinHash, sensitive to edit distance.

A text's k-mers of code points are numbered by occurrence (the second "abcdefghij" differs from the first). For each
of ``SLOTS`` hash functions the ``TUPLE`` k-mers of least hash are selected, put back in the order of the text and
hashed together; that gives sixteen bits of the fingerprint. Two texts agree in a slot when they share the selected
k-mers in the same order, so the share of equal slots (``likeness``) falls with edits and with reordering, which plain
MinHash does not see. Equal texts have equal fingerprints.

``with_next`` pairs each document with the one that follows by descending id without a global window: rows are
range-partitioned by (id, hash of the text) into ranges of about ``RANGE_BYTES`` of text, however many that makes, and
each range is sorted and streamed. Texts are shuffled once. A range can't see the next one, so the last document of
each waits, with the first, in the table of results; the two or so rows a range are then joined with one another.
The driver holds one row a range at most; for tens of terabytes give ``range_bytes`` of some hundred megabytes, which
changes the length of tasks but not their memory.

Edge cases: null texts are empty; an empty text has a fixed fingerprint; a text shorter than k is one k-mer; very long
texts are hashed in blocks; null ids come last; equal ids are ordered by a hash of the text, and may be split between
ranges; repeated rows follow one another in one range, streamed; a single document follows itself; an empty table
gives an empty result; columns named as the result's are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K, SLOTS, TUPLE = 10, 64, 2
BLOCK = 4096
ROWS_PER_RANGE, RANGE_BYTES = 20_000, 8_000_000
SEED = 20_240_601

_rng = np.random.default_rng(SEED)
_ODD = _rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32)
_SLOT = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmer_hashes(text: str, k: int = K) -> np.ndarray:
    """A 64-bit hash of each k-mer with its occurrence number, in text order; one of the whole text if it is shorter than k."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    if 0 < len(c) < k:
        k = len(c)
    out, done, power, size = None, 0, c, 1  # hashes of the first ``done`` code points of each k-mer; of ``size`` from each place
    while True:
        shift = np.uint64(pow(base, size, 1 << 64))
        if k & size:
            n = len(c) - done - size + 1
            out = power[:n] if out is None else out[:n] * shift + power[done : done + n]
            done += size
        if done == k:
            break
        n = len(power) - size
        power = power[:n] * shift + power[size : size + n]
        size *= 2
    h = _mix(out)
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice):
        at = np.flatnonzero(np.isin(h, np.unique(twice)))
        order = at[np.argsort(h[at], kind="stable")]
        v = h[order]
        first = np.maximum.accumulate(np.where(np.r_[True, v[1:] != v[:-1]], np.arange(len(v)), 0))
        h[order] = _mix(v + (np.arange(len(v)) - first).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return h


def signature(text: str | None) -> np.ndarray:
    """SLOTS 16-bit numbers."""
    if not text:
        return np.zeros(SLOTS, dtype=np.uint16)
    h = kmer_hashes(text)
    x = (h >> np.uint64(32)).astype(np.uint32)
    rows = np.arange(SLOTS)
    values, places = [], []
    for at in range(0, len(x), BLOCK):
        v = (x[None, at : at + BLOCK] ^ _XOR[:, None]) * _ODD[:, None]
        for _ in range(min(TUPLE, v.shape[1])):
            i = v.argmin(axis=1)
            values.append(v[rows, i])
            places.append(i + at)
            v[rows, i] = 0xFFFFFFFF
    values, places = np.stack(values, 1).astype(np.uint64), np.stack(places, 1)
    best = np.sort((values << np.uint64(31)) | places.astype(np.uint64), axis=1)[:, :TUPLE] & np.uint64((1 << 31) - 1)
    best = np.sort(best, axis=1)
    out = _SLOT.copy()
    for j in range(best.shape[1]):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[best[:, j].astype(np.int64)])
    return (out >> np.uint64(48)).astype(np.uint16)


def to_bytes(sig: np.ndarray) -> bytes:
    return sig.astype(">u2").tobytes()


def to_text(sig: np.ndarray) -> str:
    return to_bytes(sig).hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots, 0 to 1."""
    return float(np.mean(a == b))


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and a fingerprint of each text."""
    inner = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_omh_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="_omh_text").assign(fingerprint=[to_text(signature(t)) for t in b["_omh_text"]])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.drop("_omh_text").schema.fields)
    return inner.mapInPandas(run, f"{kept}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many code points of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Rows of a range's results: pairs, and its first and last document with their texts.
PAIR, FIRST, LAST = 0, 1, 2
_RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_PAIRS = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _pair(own: int | None, text: str, following: str, mine: np.ndarray, theirs: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = signature(changed)
    return own, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(), to_bytes(mine), to_bytes(other), likeness(mine, other), likeness(mine, theirs)


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A sorted range's pairs, its first and its last document."""
    part, held = TaskContext.get().partitionId(), None
    nothing = (None,) * (len(_RESULT) - 1)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["kind", "part", *_RESULT, "text"]).astype({"doc_id": "Int64", "n_chars": "Int64"})

    for b in batches:
        out = []
        for i, t in zip(b["doc_id"], b["text"], strict=True):
            sig = signature(t)
            out.append((PAIR, part, *_pair(held[0], held[1], t, held[2], sig), None) if held else (FIRST, part, i, *nothing, t))
            held = (i, t, sig)
        yield frame(out)
    if held:
        yield frame([(LAST, part, held[0], *nothing, held[1])])


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of the last document of a range and the first of the next."""
    for b in batches:
        rows = [_pair(i, t, f, signature(t), signature(f)) for i, t, f in zip(b["doc_id"], b["text"], b["following"], strict=True)]
        yield pd.DataFrame(rows, columns=_RESULT).astype({"doc_id": "Int64"})


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int | None = None) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows, size = base.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(1, -(-rows // ROWS_PER_RANGE), -(-(size or 0) // (range_bytes or RANGE_BYTES)))
    order = [F.desc_nulls_last("doc_id"), F.desc("draw")]
    ranged = base.withColumn("draw", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    done = cut(ranged.select("doc_id", "text").mapInPandas(_streamed, f"kind int, part int, {_PAIRS}, text string"))
    firsts, lasts = (done.where(F.col("kind") == k).select("part", "doc_id", "text") for k in (FIRST, LAST))
    in_turn = Window.partitionBy(F.lit(0)).orderBy("part")
    turns = firsts.select("part", F.coalesce(F.lead("part").over(in_turn), F.first("part").over(in_turn)).alias("next"))
    met = lasts.join(turns, "part").join(firsts.select(F.col("part").alias("next"), F.col("text").alias("following")), "next")
    pairs = done.where(F.col("kind") == PAIR).select(*_RESULT).unionByName(met.select("doc_id", "text", "following").mapInPandas(_across, _PAIRS))
    shown = {c: F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return pairs.select(*[shown.get(c, F.col(c)) for c in _RESULT])
