"""N-gram Jaccard join by chosen paths: which documents share at least ``THRESHOLD`` of their five-word shingles.

1. Each text becomes the set of its shingles' hashes. Equal sets are one *text*, merged on the map side, so a group
   of exact copies of any size is one row from here on. A MinHash sketch of ``SKETCH`` numbers stands for the set.
2. Chosen paths: at the root, sketch places are drawn, and texts fall into nodes by (place, number). A node of at most
   ``LIMIT`` texts is compared in full. A larger one is first held against one of its texts, the pivot: texts near it
   are linked through it, and if few others are left, those are compared with all, in pairs of blocks; else the node
   draws places anew and splits, down to ``DEPTH``, where whatever is left is compared with all, in pairs of blocks of
   about ``LIMIT`` texts. So no comparison is larger than two blocks, whatever is left, and none is dropped. A pair at the threshold follows a common path of one
   run with the probability of a branching process; runs are repeated until ``RECALL`` is reached for the deepest
   path, which gives the number of root places.
3. Nodes emit a star for each set of near texts, not pairs. Connected stars are candidate groups.
4. Exact check: texts of a candidate group meet with their full sets, in blocks of bounded texts and shingles (pairs of
   blocks for large groups); intersections are matrix products over shared shingles. This counts every link of the
   group, also those that no path found, and links that hold give the classes. A group larger than a block is first
   split by classes of size: sets at the threshold differ in size by 1 / ``THRESHOLD`` at most, so only blocks of one class or
   of neighbouring ones meet, and texts that shared passages have chained into one group are mostly kept apart.

Everything kept on the way is a table in the shared folder; labels, links and sketches never meet on the driver.

Result: one row a document with class_id (the least doc_id of its class), n_links (other documents at the threshold,
copies included), n_text_links (different texts among them) and n_copies (documents of the same set, its own too).

Edge cases: texts of one to four words are one shingle; null texts are empty, and texts without words are copies of
each other; null ids stay documents of their own, and a class of such alone has a null class_id; equal ids with
different texts are different documents, repeated rows are copies of one another; a very long text is one set, dealt
to blocks by its shingles; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

N, THRESHOLD = 5, 0.8
SKETCH, LIMIT, DEPTH, RECALL = 64, 1024, 4, 0.99
#: Sketches agree in this share of places at least for a pair to be a candidate: four standard deviations below the threshold.
NEAR = 0.6
BLOCK_TEXTS, BLOCK_SHINGLES = 500, 500_000
SEED = 11

_rng = np.random.default_rng(SEED)
_ODD = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint32)
_PLACES = [int(i) for i in _rng.permutation(SKETCH)]
_SPACE = " \t\n\x0b\x0c\r"
_TO_SPACE = str.maketrans({c: " " for c in _SPACE})


def root_places() -> list[int]:
    """Sketch places that the runs draw at the root, enough for RECALL at DEPTH."""
    follows = 1.0
    for _ in range(DEPTH):
        follows = 1 - math.exp(-follows)
    runs = math.ceil(math.log(1 - RECALL) / math.log(1 - follows))
    return _PLACES[: min(SKETCH, round(runs / THRESHOLD))]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = [w for w in (text or "").translate(_TO_SPACE).split(" ") if w]
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    n = min(N, len(words))
    x = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(x)]
        x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(x ^ (x >> np.uint64(32)))


def key_of(found: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(found.tobytes())


def sketch(found: np.ndarray) -> np.ndarray:
    """Least value of each of SKETCH hash functions over the set."""
    out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    x = found.astype(np.uint32)
    for at in range(0, len(x), 4096):
        out = np.minimum(out, ((x[None, at : at + 4096] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
    return out


def _sketched(docs: DataFrame) -> DataFrame:
    """From unknown, rid, draw, text: unknown, rid, draw, key, n_shingles, sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(key_of(s), len(s), sketch(s).view(np.int32)) for s in map(shingles, b["text"])]  # one set at a time
            keys, sizes, sketches = zip(*made, strict=True) if made else ((), (), ())
            yield pd.DataFrame({"unknown": b["unknown"], "rid": b["rid"], "draw": b["draw"], "key": keys, "n_shingles": np.array(sizes, np.int32), "sketch": sketches})

    return docs.mapInPandas(run, "unknown boolean, rid long, draw long, key binary, n_shingles int, sketch array<int>")


def _stars(keys: list[bytes], near: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(least key, key) for each text of the connected sets of a symmetric boolean matrix, but the least itself."""
    order = np.array(sorted(range(len(keys)), key=lambda i: keys[i]), dtype=np.int64)
    near = near[np.ix_(order, order)] | np.eye(len(keys), dtype=bool)
    label = np.arange(len(keys), dtype=np.int32)
    while True:
        new = np.array([label[r].min() for r in near], dtype=np.int32)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return [(keys[order[label[i]]], keys[order[i]]) for i in range(len(keys)) if label[i] != i]


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of a and rows of b are equal in a share of NEAR of their places at least."""
    out = np.zeros((len(a), len(b)), np.int8 if a.shape[1] < 128 else np.int32)
    for i in range(a.shape[1]):
        out += a[:, i][:, None] == b[:, i][None, :]
    return out >= NEAR * a.shape[1]


def _near_in_group(keys: list[bytes], s: np.ndarray, side: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Stars of a node (``side`` 0) or block, or of the pairs across two blocks (sides 1 and 2)."""
    if not side.any():
        return _stars(keys, _agree(s, s))
    one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    if not len(one) or not len(two):
        return []
    near = np.zeros((len(keys), len(keys)), dtype=bool)
    near[np.ix_(one, two)] = _agree(s[one], s[two])
    return _stars(keys, near | near.T)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of all groups (node, block) of a partition sorted by group: groups of two at once, larger ones each.

    The last group of a batch waits for the next one, so a group is never split.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([*waiting, *([batch] if batch is not None else [])]).combine_chunks() if waiting or batch is not None else None
        if rows is None or not rows.num_rows:
            continue
        node, block = rows["node"].to_numpy(), rows["block"].to_numpy()
        starts = np.r_[0, np.flatnonzero((node[1:] != node[:-1]) | (block[1:] != block[:-1])) + 1]
        end = len(node) if batch is None else starts[-1]
        waiting = [] if batch is None else rows.slice(end).to_batches()
        if not end:
            continue
        rows, starts = rows.slice(0, end), starts[starts < end]
        sizes = np.diff(np.r_[starts, end])
        s = rows["sketch"].combine_chunks().flatten().to_numpy().reshape(-1, SKETCH)
        side, keys = rows["side"].to_numpy(), rows["key"].to_pylist()
        out: list[tuple[bytes, bytes]] = []
        two = starts[sizes == 2]
        near = ((s[two] == s[two + 1]).mean(axis=1) >= NEAR) & ((side[two] == 0) | (side[two] != side[two + 1]))
        out += [(min(keys[i], keys[i + 1]), max(keys[i], keys[i + 1])) for i in two[near].tolist()]
        for i, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            out += _near_in_group(keys[i : i + n], s[i : i + n], side[i : i + n])
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})


def _compared(groups: DataFrame) -> DataFrame:
    """Edges of groups (node, block, key, sketch, side), which meet by a shuffle and a sort of sketches."""
    return groups.repartition("node", "block").sortWithinPartitions("node", "block").mapInArrow(_compare, EDGES)


EDGES = "a binary, b binary"


def candidates(texts: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Edges (a, b) between near texts, from (key, sketch): stars found along chosen paths."""
    spark = texts.sparkSession
    places = F.array(*[F.xxhash64(F.lit(SEED), F.lit(i), F.get("sketch", F.lit(i))) for i in root_places()])
    rows = texts.select("key", F.explode(places).alias("node"))
    edges = spark.createDataFrame([], EDGES)
    for depth in range(1, DEPTH + 1):
        counts = rows.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
        live = rows.join(counts, "node").join(texts, "key").select("node", "m", "key", "sketch")
        live = cut(live)
        made.append(live)
        small = live.where(F.col("m") <= LIMIT).select("node", F.lit(0).cast("long").alias("block"), "key", "sketch", F.lit(0).alias("side"))
        edges = edges.unionByName(_compared(small))
        large = live.where(F.col("m") > LIMIT)
        if large.isEmpty():
            break
        pivots = large.groupBy("node").agg(F.min_by(F.struct("key", "sketch"), F.xxhash64("node", "key")).alias("pivot"))
        agree = F.aggregate(F.zip_with("sketch", F.col("pivot")["sketch"], lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
        held = large.join(pivots, "node").select("node", "m", "key", "sketch", F.col("pivot")["key"].alias("pivot"), (agree < NEAR * SKETCH).alias("left"))
        edges = edges.unionByName(held.where(~F.col("left") & (F.col("key") != F.col("pivot"))).select(F.least("pivot", "key").alias("a"), F.greatest("pivot", "key").alias("b")))
        rest = held.groupBy("node").agg(F.sum(F.col("left").cast("long")).alias("u")).where("u > 0")
        held = held.join(rest, "node")
        now = F.lit(True) if depth == DEPTH else F.col("u") * F.col("m") <= 4 * LIMIT * LIMIT
        edges = edges.unionByName(_compared(_in_blocks(held.where(now))))
        if depth < DEPTH:
            chance = int((1 << 62) / (THRESHOLD * SKETCH))
            drawn = F.filter(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda i: F.shiftrightunsigned(F.xxhash64("node", i), 2) < chance)
            split = held.where(~now).select("key", F.explode(F.transform(drawn, lambda i: F.xxhash64("node", i, F.get("sketch", i)))).alias("node"))
            rows = cut(split)
            made.append(rows)
    return edges


def _in_blocks(held: DataFrame) -> DataFrame:
    """Pairs of blocks of about LIMIT texts of each node: those in which a text still left meets another, once each.

    Texts left are dealt to the first blocks, the others to those after them; pairs of two later blocks are not made.
    """
    first, n = F.ceil(F.col("u") / LIMIT).cast("int"), F.ceil(F.col("u") / LIMIT).cast("int") + F.ceil((F.col("m") - F.col("u")) / LIMIT).cast("int")
    draw = F.xxhash64("key")
    own = F.when(F.col("left"), F.pmod(draw, first)).otherwise(first + F.pmod(draw, n - first)).cast("int")
    dealt = held.select("node", "key", "sketch", "left", own.alias("own"), first.alias("first"), n.alias("n"))
    others = F.sequence(F.lit(0), F.when(F.col("left"), F.col("n")).otherwise(F.col("first")) - 1)
    dealt = dealt.select("node", "key", "sketch", "own", "n", F.explode(others).alias("other"))
    block = F.least("own", "other").cast("long") * F.col("n") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return dealt.select("node", block.alias("block"), "key", "sketch", side.alias("side"))


def components(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    """(key, label): each text of the edges and the least key connected with it. Alternating stars, each round a table.

    A round that leaves number, sum and exclusive or of the edges' hashes as they were is the last.
    """

    def state(df: DataFrame) -> tuple:
        draw = F.xxhash64("u", "v")
        return tuple(df.agg(F.count("*"), F.sum(draw.cast("decimal(38,0)")), F.bit_xor(draw)).first())

    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("w"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("w"))
        joined = large.join(low, "u")
        small = joined.where("v != w").select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(low.select("u", F.col("w").alias("v"))).where("u != v").distinct()
        after = cut(small)
        drop(now)
        now, held = after, state(after)
        if held == before:
            break
        before = held
    made.append(now)
    return now.select(F.col("u").alias("key"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("key"), F.col("v").alias("label")).distinct())


def _links(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Exact links of a block, or across two blocks: counts by text, and stars of the links."""
    _, _, i, j = key
    pdf = pdf.drop_duplicates("key").reset_index(drop=True)
    keys, copies, places = list(pdf["key"]), pdf["n_copies"].to_numpy(np.int64), pdf["place"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in pdf["found"]]
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    row, col = _shared(sets)
    del sets, pdf
    both = np.zeros((n, n), np.float32)
    m = np.zeros((n, COLUMNS), np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        a, b = np.searchsorted(col, (at, at + COLUMNS))
        m[row[a:b], col[a:b] - at] = 1
        both += m @ m.T
        m[row[a:b], col[a:b] - at] = 0
    del m, row, col
    linked, docs = np.zeros((n, n), dtype=bool), np.zeros(n, np.int64)
    for at in range(0, n, ROWS):
        part = slice(at, min(at + ROWS, n))
        near = (1 + THRESHOLD) * both[part].astype(np.float64) >= THRESHOLD * (sizes[part, None] + sizes[None, :]) - 1e-6
        near[np.arange(near.shape[0]), np.arange(part.start, part.stop)] = False
        if i != j:
            near &= places[part, None] != places[None, :]
        linked[part], docs[part] = near, near @ copies
    del both
    out = pd.DataFrame({"key": keys, "texts": linked.sum(1), "docs": docs, "a": None})
    out = out[out["texts"] > 0]
    stars = _stars(keys, linked)
    return pd.concat([out, pd.DataFrame({"key": [b for _, b in stars], "texts": 0, "docs": 0, "a": [a for a, _ in stars]})]).astype({"texts": "int64", "docs": "int64"})


#: Columns of a piece of the matrix of texts and shingles, and rows of a piece of the comparison: they bound a task's memory.
COLUMNS, ROWS = 2048, 256


def _shared(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each shingle that two sets or more have, by column; columns number such shingles."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(flat)
    flat, row = flat[order], row[order]
    del order
    again = flat[1:] == flat[:-1]
    shared = np.r_[again, False] | np.r_[False, again]
    flat, row = flat[shared], row[shared]
    if not len(flat):
        return row, row
    return row, np.cumsum(np.r_[False, flat[1:] != flat[:-1]], dtype=np.int32)


#: Texts whose sets leave a task together.
SETS = 500
#: Of a text to check: its class of size, the blocks of that class, and of those above and below.
PLAN = ["size", "blocks", "above", "below"]


def _checked(docs: DataFrame, texts: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, texts, docs, a): partial link counts, and star edges where ``a`` is set, of all candidate groups."""
    members = groups.join(texts.select("key", "unknown", "rid", "draw", "n_copies", "n_shingles"), "key")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    wholes = members.groupBy("label").agg(F.count("*").alias("m"), blocks.alias("all_blocks")).where("m > 1").drop("m")
    size = F.when(F.col("all_blocks") > 1, F.floor(F.log("n_shingles") / F.lit(math.log(1 / THRESHOLD + 1e-7)))).otherwise(0).cast("int")
    members = members.join(wholes, "label").withColumn("size", size)
    here = members.groupBy("label", "size").agg(blocks.alias("blocks"))
    above = here.select("label", (F.col("size") - 1).alias("size"), F.col("blocks").alias("above"))
    below = here.select("label", (F.col("size") + 1).alias("size"), F.col("blocks").alias("below"))
    here = here.join(above, ["label", "size"], "left").join(below, ["label", "size"], "left").na.fill(0, ["above", "below"])
    plan = F.struct("size", "blocks", "above", "below")
    members = members.join(here, ["label", "size"]).select("unknown", "rid", "draw", F.col("key").alias("wanted"), "label", "n_copies", plan.alias("plan"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b.pop("text")
            for at in range(0, len(b), SETS):
                part = b.iloc[at : at + SETS]
                found = [shingles(t) for t in texts.iloc[at : at + SETS]]
                part = part.assign(key=[key_of(s) for s in found], found=[s.tobytes() for s in found])
                yield part[part["key"] == part["wanted"]][["key", "label", "n_copies", *PLAN, "found"]]

    found = docs.join(members.hint("shuffle_hash"), ["unknown", "rid", "draw"]).select("text", "wanted", "label", "n_copies", *[F.col("plan")[c].alias(c) for c in PLAN])
    found = found.mapInPandas(sets, f"key binary, label binary, n_copies long, {', '.join(f'{c} int' for c in PLAN)}, found binary")
    own: Column = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")

    def meet(low: Column, i: Column, j: Column) -> Column:
        """Classes (low, low) or (low, low + 1) and the blocks that meet; ``i`` below ``j`` marks two blocks of one class."""
        return F.struct(low.alias("low"), i.cast("int").alias("i"), j.cast("int").alias("j"))

    def each(n: Column, body) -> Column:
        return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), body)

    n, block, size = F.col("blocks"), F.col("block"), F.col("size")
    within = each(n, lambda x: meet(size, F.least(x, block), F.greatest(x, block)))
    up = each(F.col("above"), lambda x: meet(size, -1 - block, x))
    down = each(F.col("below"), lambda x: meet(size - 1, -1 - x, block))
    dealt = found.withColumn("block", own).select("label", "key", "n_copies", F.concat_ws(":", "size", "block").alias("place"), "found", F.explode(F.concat(within, up, down)).alias("p"))
    dealt = dealt.select("label", F.col("p")["low"].alias("low"), F.col("p")["i"].alias("i"), F.col("p")["j"].alias("j"), "key", "n_copies", "place", "found")
    return dealt.groupBy("label", "low", "i", "j").applyInPandas(_links, "key binary, texts long, docs long, a binary")


def _identity(doc_id: str, text: str) -> list[Column]:
    """unknown, rid, draw: whether the id is null; the id, or a hash of the text for a null one; a hash of the text."""
    known, draw = F.col(f"`{doc_id}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return [known.isNull().alias("unknown"), F.coalesce(known, draw).alias("rid"), draw.alias("draw")]


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, n_text_links, n_copies for each row of ``docs``."""
    return _joined(docs, doc_id, text).select(F.when(~F.col("unknown"), F.col("rid")).alias("doc_id"), F.when(~F.col("first")["unknown"], F.col("first")["rid"]).alias("class_id"), "n_links", "n_text_links", "n_copies")


def _joined(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """unknown, rid, draw of each row, the same of its class's first, and the counts."""
    made: list[DataFrame] = []
    base = docs.select(*_identity(doc_id, text), F.col(f"`{text}`").alias("text"))
    rows = cut(_sketched(base))
    own = F.struct("unknown", "rid", "draw")
    texts = rows.groupBy("key").agg(F.min(own).alias("rep"), F.count("*").alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    texts = cut(texts.select("key", "rep.*", "n_copies", "n_shingles", "sketch"))
    groups = cut(components(candidates(texts.where("n_shingles > 0").select("key", "sketch"), made), made))
    for d in made:
        drop(d)
    checked = cut(_checked(base, texts, groups))
    classes = components(checked.where(F.col("a").isNotNull()).select("a", F.col("key").alias("b")), [])
    counts = checked.where(F.col("a").isNull()).groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    links = (F.coalesce("docs", F.lit(0)) + F.col("n_copies") - 1).cast("long")
    whole = texts.join(classes, "key", "left").join(counts, "key", "left").select("key", F.coalesce("label", "key").alias("label"), own.alias("own"), "n_copies", F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"), links.alias("n_links"))
    firsts = whole.groupBy("label").agg(F.min("own").alias("first"))
    whole = whole.join(firsts, "label").select("key", "n_copies", "n_text_links", "n_links", "first")
    return rows.select("unknown", "rid", "draw", "key").join(whole, "key")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that of least id, with the columns of ``docs``; of rows alike in id and text one."""
    first = _joined(docs, doc_id, text).where(F.struct("unknown", "rid", "draw") == F.col("first")).select("unknown", "rid", "draw").distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), *_identity(doc_id, text))
    kept = packed.join(first.hint("shuffle_hash"), ["unknown", "rid", "draw"], "left_semi").dropDuplicates(["unknown", "rid", "draw"])
    return kept.select(*[F.col("whole")[c].alias(c) for c in docs.columns])
