"""Best-fit packing of token sequences, improved by swap-based local search.

Documents are tokenized where they are read, an end token is added, and only those longer than the capacity are cut:
full pieces, after a first one of what is left over. Pieces (a few numbers each) are written as a table, so that a task
that runs again deals them alike. Full pieces are sequences as they are and never meet; the others are dealt by hash of
what they are and of their number in their task into shards of about ``PIECES_PER_SHARD``, so that no document, source
or group of copies or repeated rows makes a hot one. Within a shard pieces go best fit, largest first: each to the bin
with the least room that holds it; then bins with room are improved. The emptiest bin gives its pieces away: a piece moves to
the fullest bin with room for it, or changes places with one smaller piece, or with two, of a fuller bin. Each step
makes the sum of squared fills grow, so it ends; a bin that has given all away is gone. Bins with room are held by
what they may give back and by fill, so a step looks at sizes, not at bins, and the search runs until no step is left.

Edge cases: a null text is empty and is its end token alone; texts of any length, also of millions of spaces (which
the tokenizers library encodes, see ``LONG_SPACE``); repeated rows are packed one by one; ties of length go by id,
piece and content; an empty table gives an empty result; equally named columns of the input give way to the result's.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITY, END = 1024, 2
PIECES_PER_SHARD = 32_768
#: A run of white space from which on a text is encoded by the tokenizers library, as tiktoken's pattern engine runs
#: out of stack on a run of a million. The ids are the same.
LONG_SPACE = 65_536
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
#: The word pattern of byte-level BPE files whose pre-tokenizer is ByteLevel.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, object] = {}


def _byte_of() -> dict[str, int]:
    """The bytes for which the characters of a byte-level vocabulary stand."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """Function text -> ids for a byte-level BPE file of the tokenizers library, with the ids that library gives.

    The file's merges are read as ranks by tiktoken, which is several times as fast; a file of another kind is run by
    the tokenizers library itself. One for each process and path.
    """
    if path not in _encoders:
        spec = json.loads(open(path, encoding="utf-8").read())
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        ordinary = {k: v for k, v in model["vocab"].items() if k not in special} if model["type"] == "BPE" else {}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer") and sorted(ordinary.values()) == list(range(len(ordinary)))
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        whole: list = []

        def library(text: str) -> list[int]:
            from tokenizers import Tokenizer

            if not whole:
                whole.append(Tokenizer.from_file(path))
            return whole[0].encode(text, add_special_tokens=False).ids

        if plain:
            import tiktoken

            of = _byte_of()
            ranks = {bytes(of[c] for c in k): v for k, v in ordinary.items()}
            made = tiktoken.Encoding("bpe", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
            names, long_space = set(special), re.compile(rf"\s{{{LONG_SPACE}}}")

            def fast(text: str) -> list[int]:
                if len(text) >= LONG_SPACE and long_space.search(text):
                    return library(text)
                return made.encode(text, allowed_special=names, disallowed_special=()) if any(n in text for n in names) else made.encode_ordinary(text)

            _encoders[path] = fast
        else:
            _encoders[path] = library
    return _encoders[path]


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit). salt numbers the pieces of a task."""

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        salt = 0
        for batch in batches:
            rows = []
            for i, t in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode(t or ""), END], dtype="<u4")
                n = len(ids)
                start, end, k = 0, n if n <= capacity else n % capacity or capacity, 0
                while start < n:
                    raw = ids[start:end].tobytes()
                    rows.append((i, k, start, end - start, zlib.crc32(raw), salt, raw) if with_ids else (i, k, start, end - start, zlib.crc32(raw), salt))
                    start, end, k, salt = end, end + capacity, k + 1, salt + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "salt", *["ids"] * with_ids]).astype({"doc_id": "Int64"})

    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return narrow.mapInPandas(encoded, PIECES + ", ids binary" * with_ids)


def fill_bins(lengths: np.ndarray, capacity: int = CAPACITY, steps: int | None = None) -> list[list[int]]:
    """Item numbers by bin: best fit, largest first, then local search. Deterministic."""
    bins: list[list[int]] = []
    room: list[int] = []
    by_room: dict[int, list[int]] = {}
    there = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        k = int(lengths[i])
        fits = there >> k
        if fits:
            left = k + (fits & -fits).bit_length() - 1
            b = by_room[left].pop()
            if not by_room[left]:
                there ^= 1 << left
            bins[b].append(i)
        else:
            left, b = max(capacity, k), len(bins)
            bins.append([i])
            room.append(0)
        room[b] = left - k
        if room[b]:
            by_room.setdefault(room[b], []).append(b)
            there |= 1 << room[b]
    full = [own for own, r in zip(bins, room, strict=True) if not r]
    return full + improve([own for own, r in zip(bins, room, strict=True) if r], lengths, capacity, steps)


class _Takers:
    """Bins with room by (sum they may give back, fill). A sum is 0, one piece or two, below that of the largest piece.

    ``highest[s, t]`` is the greatest fill up to t of a bin that may give back s, or -1, so the best exchange for a
    piece is looked up on one diagonal, whatever the number of bins. It takes two bytes for each (sum, fill).
    """

    def __init__(self, capacity: int, largest: int) -> None:
        self.capacity, self.largest = capacity, largest
        self.highest = np.full((largest, capacity), -1, np.int16 if capacity < 1 << 15 else np.int32)
        self.bins: dict[tuple[int, int], dict[int, None]] = {}

    def _sums(self, sizes: list[int]) -> set[int]:
        small = [k for k in sizes if k < self.largest]
        twos = {a + b for n, a in enumerate(small) for b in small[:n]}
        return {0, *small, *(k for k in twos if k < self.largest)}

    def add(self, b: int, fill: int, sizes: list[int]) -> None:
        if fill >= self.capacity:
            return
        for s in self._sums(sizes):
            held = self.bins.setdefault((s, fill), {})
            if not held:
                row = self.highest[s, fill:]
                np.maximum(row, fill, out=row)
            held[b] = None

    def remove(self, b: int, fill: int, sizes: list[int]) -> None:
        if fill >= self.capacity:
            return
        for s in self._sums(sizes):
            held = self.bins[s, fill]
            del held[b]
            if not held:
                row = self.highest[s, fill:]
                row[row == fill] = self.highest[s, fill - 1] if fill else -1

    def best(self, x: int, fill: int) -> tuple[int, int, int] | None:
        """(growth of squared fills, sum given back, bin) of the best exchange for a piece of size x of a bin of this fill."""
        f = self.highest.diagonal(self.capacity - x).astype(np.int64)  # the fill may be capacity - x + s at most
        moved = np.arange(x, x - len(f), -1)
        grown = np.where(f >= 0, 2 * moved * (f - fill + moved), 0)
        s = int(grown.argmax())
        return (int(grown[s]), s, next(iter(self.bins[s, int(f[s])]))) if grown[s] > 0 else None


def improve(open_bins: list[list[int]], lengths: np.ndarray, capacity: int, steps: int | None = None) -> list[list[int]]:
    """Local search over bins with room: moves, one-for-one and two-for-one exchanges, each raising the squared fills.

    Bins give in order of fill, again and again until none of them has a step left, or there are as few bins as the
    sum of their pieces needs. ``steps`` is for callers that want to stop before.
    """
    size = {i: int(lengths[i]) for b in open_bins for i in b}
    fill = [sum(size[i] for i in b) for b in open_bins]
    bound = -(-sum(fill) // capacity)
    takers = _Takers(capacity, max(size.values(), default=0))
    order = sorted(range(len(open_bins)), key=lambda b: (fill[b], b))
    for b in order:
        takers.add(b, fill[b], [size[i] for i in open_bins[b]])
    alive, made, again = len(open_bins), 0, True
    while again:
        again = False
        for giver in sorted((b for b in order if open_bins[b] and fill[b] < capacity), key=lambda b: (fill[b], b)):
            if alive <= bound or made == steps:
                return [open_bins[b] for b in order if open_bins[b]]
            if fill[giver] >= capacity:
                continue
            takers.remove(giver, fill[giver], [size[i] for i in open_bins[giver]])
            while open_bins[giver] and made != steps:
                found = [(*got, k) for k in sorted({size[i] for i in open_bins[giver]}, reverse=True) if (got := takers.best(k, fill[giver]))]
                if not found:
                    break
                _, s, b, k = max(found, key=lambda f: f[0])
                takers.remove(b, fill[b], [size[i] for i in open_bins[b]])
                x, back = next(i for i in open_bins[giver] if size[i] == k), _of_sum(s, open_bins[b], size)
                open_bins[giver] = [i for i in open_bins[giver] if i != x] + back
                open_bins[b] = [i for i in open_bins[b] if i not in back] + [x]
                fill[giver] -= k - s
                fill[b] += k - s
                takers.add(b, fill[b], [size[i] for i in open_bins[b]])
                made, again = made + 1, True
            if open_bins[giver]:
                takers.add(giver, fill[giver], [size[i] for i in open_bins[giver]])
            else:
                alive -= 1
    return [open_bins[b] for b in order if open_bins[b]]


def _of_sum(s: int, items: list[int], size: dict[int, int]) -> list[int]:
    """No piece, one or two of this sum, one before two."""
    if not s:
        return []
    one = next((i for i in items if size[i] == s), None)
    if one is not None:
        return [one]
    return next([i, j] for n, i in enumerate(items) for j in items[:n] if size[i] + size[j] == s)


def pack(parts: DataFrame, shards: int, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` with sequence_id and offset. A sequence's number holds its shard's; those of full pieces are below 0. ``parts`` must be a table."""

    def bins(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32", "salt"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        seq, off = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        for k, own in enumerate(fill_bins(lengths, capacity)):
            at = 0
            for i in own:
                seq[i], off[i] = (int(key[0]) << 32) + k, at
                at += int(lengths[i])
        return pdf.assign(sequence_id=seq, offset=off).drop(columns=["salt", "shard"])

    made = parts.where(F.col("length") < capacity).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(shards)).cast("int"))
    kept = [f for f in made.schema.fields if f.name not in ("salt", "shard")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    alone = parts.where(F.col("length") >= capacity).select(*[f.name for f in kept], (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return made.groupBy("shard").applyInPandas(bins, schema).unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    parts = cut(pieces(docs, tokenizer, doc_id, text, capacity, with_ids))
    short = parts.where(F.col("length") < capacity).count()
    return pack(parts, max(1, -(-short // PIECES_PER_SHARD)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Token sequences of pieces packed with ids: sequence_id, ids binary."""
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
