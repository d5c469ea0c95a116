"""Mixing, packing, revisits, fingerprints, Jaccard joins, toxicity and the pipeline against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataframe.llm import best_fit_packing as packing
from strataframe.llm import mix_sources, ngram_jaccard, order_minhash, queries, toxicity, warc_revisits
from strataframe.session import ship

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return ship(spark).read.parquet(f"{SF}/documents.parquet").repartition(3)


# Mixing.


def fill(sizes, weights, share=1.5):
    """Targets by resharing the excess until none is above twice its size."""
    total = share * sum(sizes.values())
    full, out = {}, {}
    while True:
        rest = {s: weights[s] for s in sizes if s not in full}
        left = total - sum(full.values())
        out = {s: left * w / sum(rest.values()) for s, w in rest.items()} if rest else {}
        over = [s for s in out if out[s] > 2 * sizes[s]]
        if not over:
            return full | out
        full |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randrange(0, 40)) or None, None, ["b", "a", None, "ü", "z", "A"][min(r.randrange(9), 5)], i) for i in range(400)] + [(7, "x y", None, "a", 1)] * 3 + [(None, "x", None, "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).repartition(4)
    got = mix_sources.mix(docs, ["doc_id", "source", "size"]).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for x in got:
        sizes[x.source] += x["size"]
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = fill(sizes, {s: [5, 2, 1][i % 3] for i, s in enumerate(order)})
    taken = collections.Counter()
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source] and 0 <= x.taken <= 2 * x["size"]
        assert x.taken == sum(p.words for p in x.positions) and all(0 <= p.position <= 1 for p in x.positions)
        taken[x.source] += x.taken
    assert all(taken[s] == round(want[s]) for s in sizes)
    again = mix_sources.mix(docs.repartition(2), ["doc_id"]).select("doc_id", "taken", "position")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(((x.doc_id, x.taken, x.position) for x in got), key=str)


def test_positions_follow_the_schedule(spark):
    """Half-way through training each source has given the share of its target that its schedule's integral says."""
    docs = spark.range(3000).select("id", F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.repeat(F.lit("w "), 5).alias("text"))
    got = mix_sources.mix(docs, ["source"], doc_id="id").select("source", "target", F.explode("positions").alias("p")).collect()
    for k, knots in enumerate(mix_sources.SCHEDULES):
        own = [x for x in got if x.source == f"s{k}"]
        half = sum(x.p.words for x in own if x.p.position < 0.5) / own[0].target
        (_, w0), (_, w1) = knots
        assert half == pytest.approx((w0 + (w0 + w1) / 2) / 2 * 0.5 / ((w0 + w1) / 2), abs=0.01)


def test_mixed_documents(spark, documents):
    out = mix_sources.mixed_documents(documents)
    assert out.dtypes == documents.dtypes
    whole = {r.doc_id: r for r in documents.collect()}
    taken, copies = collections.Counter(), collections.Counter()
    for r in out.collect():
        assert r == whole[r.doc_id]
        copies[r.doc_id] += 1
        taken[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    mixed = mix_sources.mix(documents, ["doc_id", "source"]).collect()
    largest = max(r["size"] for r in mixed)
    for r in mixed:
        assert copies[r.doc_id] <= 2 and abs(taken[r.source] - r.target) <= largest / 2 + 1
        assert r.taken % max(r["size"], 1) or copies[r.doc_id] == r.taken // max(r["size"], 1)
    assert mix_sources.mixed_documents(documents.limit(0)).count() == 0


# Packing.


def test_encoder_is_the_tokenizers_librarys():
    from tokenizers import Tokenizer

    path = packing.tokenizer_file()
    want = Tokenizer.from_file(path)
    for t in ["", "don't  stop\n\n now ", "日本 Ünï \U0001f600 12 3''s'll", "a <|endoftext|> b", "\x00\u200b\r\n\t x" * 50, "a" * 3000]:
        assert packing.encoder(path)(t) == want.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" + " \n\t" * 400_000 + "b", "word " * 300_000, "x" * 1_000_000], ids=["spaces", "lines", "mixed", "words", "letters"])
def test_encoder_takes_texts_of_any_length(text):
    from tokenizers import Tokenizer

    path = packing.tokenizer_file()
    assert packing.encoder(path)(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_packing_long_space_and_repeated_rows(spark):
    rows = [(1, " " * 1_200_000)] + [(2, "same row")] * 5000 + [(3, "y " * 1023), (4, "y " * 1024)]
    got = packing.pack_documents(ship(spark).createDataFrame(rows, "doc_id long, text string").repartition(3), packing.tokenizer_file()).toPandas()
    assert (got["doc_id"] == 2).sum() == 5000 and got.groupby("sequence_id")["length"].sum().max() <= 1024
    alone = got[got["length"] == 1024]
    assert (alone["offset"] == 0).all() and alone["sequence_id"].nunique() == len(alone) and (alone["sequence_id"] < 0).all()
    assert (got[got["length"] < 1024]["sequence_id"] >= 0).all()


def test_start_is_best_fit():
    """Largest first, each to the bin with the least room that holds it: by brute force."""
    r = np.random.default_rng(4)
    lengths = r.integers(1, 101, 500)
    bins = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [b for b in bins if 100 - lengths[b].sum() >= lengths[i]]
        if fits:
            min(fits, key=lambda b: 100 - lengths[b].sum()).append(i)
        else:
            bins.append([i])
    got = packing.fill_bins(lengths, 100, steps=0)
    assert sorted(i for b in got for i in b) == list(range(500)) and sorted(lengths[b].sum() for b in got) == sorted(lengths[b].sum() for b in bins)


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    docs = documents.select("doc_id", "text", F.lit(1).alias("length")).unionByName(spark.createDataFrame([(-1, None, 1), (-1, None, 1), (None, "", 1), (-2, "word " * 4000, 1)], "doc_id long, text string, length int"))
    got = packing.pack_documents(docs, packing.tokenizer_file()).toPandas()
    whole = got.groupby("sequence_id")["length"].sum()
    assert whole.max() <= 1024 and len(whole) <= -(-got["length"].sum() // 1024) + 1
    own = got.sort_values(["sequence_id", "offset"])
    assert (own["offset"] == own.groupby("sequence_id")["length"].cumsum() - own["length"]).all()
    encode = Tokenizer.from_file(packing.tokenizer_file())
    for r in docs.where("doc_id >= 0 OR doc_id = -2").collect():
        ids = np.array([*encode.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        p = got[got["doc_id"] == r.doc_id].sort_values("piece")
        assert list(p["start"]) == [0, *np.cumsum(p["length"])[:-1]] and p["length"].sum() == len(ids)
        assert all(p["length"].iloc[1:] == 1024) and (len(p) == 1) == (len(ids) <= 1024)
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(p["start"], p["length"], strict=True)] == list(p["ids_crc32"])
    assert list(got[got["doc_id"] == -1]["length"]) == [1, 1] and got["doc_id"].isna().sum() == 1
    assert packing.pack_documents(docs.limit(0), packing.tokenizer_file()).count() == 0
    with_ids = packing.sequences(packing.pack_documents(docs.limit(20), packing.tokenizer_file(), with_ids=True))
    assert max(len(r.ids) for r in with_ids.collect()) <= 4096


@pytest.mark.parametrize("seed", range(6))
def test_local_search_keeps_items_and_never_adds_bins(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, [40, 30, 100, 60, 25, 101][seed], 300)
    items = [[i] for i in range(len(lengths))]
    better = packing.improve([list(b) for b in items], lengths, 100, 10**6)
    assert sorted(i for b in better for i in b) == list(range(300)) and max(sum(lengths[b]) for b in better) <= 100
    made = packing.fill_bins(lengths, 100)
    assert sorted(i for b in made for i in b) == list(range(300)) and len(made) <= len(better)
    assert len(made) <= 1.1 * -(-lengths.sum() // 100) + 1


def test_local_search_swaps():
    """60+30 and 55+45 and 10: one exchange makes two full bins."""
    lengths = np.array([60, 30, 70, 40])
    assert len(packing.improve([[0, 1], [2], [3]], lengths, 100, 1000)) == 2


def test_local_search_runs_to_its_end_on_thousands_of_bins():
    """Every giver against every bin by brute force: no move and no exchange for one piece or two is left."""
    r = np.random.default_rng(1)
    lengths = np.sort(r.integers(250, 451, 6000))[::-1].copy()
    made = packing.fill_bins(lengths)
    assert sorted(i for b in made for i in b) == list(range(6000)) and max(lengths[b].sum() for b in made) <= 1024
    assert len(made) < 0.97 * len(packing.fill_bins(lengths, steps=0)) and len(made) > -(-lengths.sum() // 1024)
    sizes = [[int(lengths[i]) for i in b] for b in made]
    for giver in sorted(range(len(made)), key=lambda b: sum(sizes[b]))[:: len(made) // 40]:
        g = sum(sizes[giver])
        for b, own in enumerate(sizes):
            f = sum(own)
            backs = [0, *own, *(own[i] + own[j] for i in range(len(own)) for j in range(i))]
            assert b == giver or not any(0 < x - s <= 1024 - f and f + x - s > g for x in sizes[giver] for s in backs)


# Revisits.


def test_revisits(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        kind = r.choice(["response", "revisit", "revisit"])
        url = r.choice([None, "http://www.A.com/x.html#f", "https://a.com/x/", "http://a.com/x?utm_source=q", "http://a.com/y", "http://b.com:80/"])
        rows.append((i, url, r.randrange(100) if i % 17 else None, kind, 200 if kind == "response" and r.random() < 0.8 else 304, r.choice([None, '"1"', 'W/"1"', '"2"']), r.choice([None, "m1", "m2"]), {"date": str(i), "content-type": f"t{i}"} if i % 5 else None))
    schema = "record_id long, url string, time long, kind string, status int, etag string, last_modified string, headers map<string,string>"
    got = {x.record_id: x for x in warc_revisits.resolve(spark.createDataFrame(rows, schema).repartition(4), chunks=7).collect()}
    canonical = {None: None, "http://a.com/y": "a.com/y", "http://b.com:80/": "b.com"}
    assert len(got) == 300
    weak = lambda t: t and t.removeprefix("W/")
    key = lambda x: (x[2] is not None, x[2] or 0, not (x[3] == "response" and x[4] == 200), x[0])
    for x in rows:
        g, own = got[x[0]], canonical.get(x[1], "a.com/x")
        assert g.canonical == own
        if x[3] == "response" and x[4] == 200:
            assert g.outcome == "response"
            continue
        before = [y for y in rows if own is not None and canonical.get(y[1], "a.com/x") == own and y[3] == "response" and y[4] == 200 and key(y) < key(x)]
        if not before:
            assert g.outcome == "orphan" and g.refers_to is None
            continue
        y = max(before, key=key)
        if x[5] and y[5]:
            want = "resolved" if weak(x[5]) == weak(y[5]) else "stale"
        else:
            want = "unverified" if x[6] is None or y[6] is None else "resolved" if x[6] == y[6] else "stale"
        assert (g.outcome, g.refers_to) == (want, y[0])
        if want == "resolved":
            assert g.headers == {**(y[7] or {}), **({"date": x[7]["date"]} if x[7] else {})}
    assert warc_revisits.resolve(spark.createDataFrame([], schema)).count() == 0


def test_revisits_in_chunks_by_number(spark):
    """One outlying time, one hot url and many rows without url: chunks stay small and answers the same."""
    schema = "record_id long, url string, time long, kind string, status int, etag string, last_modified string, headers map<string,string>, outcome string, key int"
    rows = [(0, "http://a/x", 0, "response", 200, "e0", None, {"ETag": "e0"}, "clash", 1)]
    rows += [(i, "http://a/x", 10**9 + i, "response" if i % 50 == 0 else "revisit", 200 if i % 50 == 0 else 304, f"e{i // 50}", None, {"Date": str(i)}, "clash", 1) for i in range(1, 2000)]
    rows += [(5000 + i, None, 10**9 + i, "revisit", 304, "e", None, None, "clash", 1) for i in range(500)] + [(9000, "http://a/" + "y" * 100_000, 5, "revisit", 304, None, None, None, "clash", 1)] * 2
    df = spark.createDataFrame(rows, schema).repartition(3)
    bounds = warc_revisits.chunk_bounds(df, 16)
    sizes = collections.Counter(r[0] for r in df.select(warc_revisits.chunk_of(F.col("time"), bounds)).collect())
    assert max(sizes.values()) < 2 * len(rows) / 16 and len(sizes) >= 14
    got = warc_revisits.resolve(df, chunks=16).collect()
    assert len(got) == len(rows) and all(r.outcome == "orphan" and r.refers_to is None for r in got if r.record_id >= 5000)
    by = {r.record_id: r for r in got}
    for i in range(1, 2000):
        assert by[i].outcome == ("response" if i % 50 == 0 else "resolved")
        assert i % 50 == 0 or (by[i].refers_to == i // 50 * 50 and by[i].headers["Date"] == str(i))


def test_chunk_of_is_a_count_of_bounds(spark):
    bounds = [3, 5, 8, 13, 21]
    got = spark.range(30).select("id", warc_revisits.chunk_of(F.col("id"), bounds).alias("c"), warc_revisits.chunk_of(F.when(F.col("id") < 0, 1), bounds).alias("none")).collect()
    assert all(r.c == sum(b <= r.id for b in bounds) and r.none == -1 for r in got)


def test_headers_merge_in_any_case(spark):
    headers = spark.createDataFrame([({"Date": "1", "ETag": "a", "Content-Type": "t", "vary": "v"}, {"date": "2", "Cache-Control": "c", "content-type": "x", "ETag": None, "VARY": "w"})], "stored map<string,string>, own map<string,string>")
    got = headers.select(warc_revisits.merged_headers(F.col("stored"), F.col("own"))).first()[0]
    assert got == {"date": "2", "ETag": "a", "Content-Type": "t", "Cache-Control": "c", "VARY": "w"}


# Fingerprints.


def brute_signature(text):
    """Slots from sorting all occurrence-numbered k-mers by each slot's hash."""
    h = order_minhash.kmer_hashes(text)
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = []
    for j in range(order_minhash.SLOTS):
        v = (x ^ order_minhash._XOR[j]) * order_minhash._ODD[j]
        best = sorted(sorted(range(len(v)), key=lambda i: (int(v[i]), i))[: order_minhash.TUPLE])
        s = order_minhash._SLOT[j : j + 1].copy()
        for i in best:
            s = order_minhash._mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + 1])
        out.append(int(s[0] >> np.uint64(48)))
    return out


@pytest.mark.parametrize("text", ["a", "abc", "aaaaaaaaaaaaaaaaaaaaaaaaa", "hello world hello world hello world", "ü\U0001f600" * 30, "xy" * 4500 + "the end of it all"])
def test_signatures(text):
    h = order_minhash.kmer_hashes(text)
    assert len(set(h.tolist())) == len(h) == max(1, len(text) - order_minhash.K + 1)
    assert order_minhash.signature(text).tolist() == brute_signature(text)


def test_signatures_feel_edits_and_order():
    r = random.Random(5)
    text = "".join(r.choice("abcdefgh ") for _ in range(2000))
    one, sig = text[:1000] + "#" + text[1001:], order_minhash.signature(text)
    many = "".join("#" if i % 100 == 0 else c for i, c in enumerate(text))
    moved = "".join(text[i : i + 40] for i in r.sample(range(0, 2000, 40), 50))
    a, b, c = (order_minhash.likeness(sig, order_minhash.signature(t)) for t in (one, many, moved))
    assert a > 0.9 > b > 0.4 and c < 0.6 and order_minhash.likeness(sig, order_minhash.signature(text)) == 1


def test_fingerprint_pairs(spark, documents, monkeypatch):
    monkeypatch.setattr(order_minhash, "ROWS_PER_RANGE", 30)
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(500, None), (501, ""), (502, "ü\U0001f600x"), (None, "no id"), (7, "other seven")], "doc_id long, text string"))
    got = order_minhash.with_next(docs.repartition(5)).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert len(got) == len(rows)
    twice = {7, None}
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    by = {g.doc_id: g for g in got}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)]
        if i in twice or following[0] in twice:
            continue
        e = order_minhash.edited(t, following[1])
        g = by[i]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert g.fingerprint == order_minhash.to_text(order_minhash.signature(t))
        assert g.near_edited == order_minhash.likeness(order_minhash.signature(t), order_minhash.signature(e))
    one = order_minhash.with_next(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert order_minhash.with_next(docs.limit(0)).count() == 0


def test_fingerprint_pairs_of_repeated_ids(spark, monkeypatch):
    """Equal ids, repeated rows and clashing columns; ranges of some rows each."""
    monkeypatch.setattr(order_minhash, "ROWS_PER_RANGE", 7)
    rows = [(1, f"text {i}", "clash", 0) for i in range(40)] + [(2, "same", "clash", 0)] * 30 + [(3, "long " * 60_000, "clash", 0), (None, "none", "clash", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, part int").repartition(4)
    got = order_minhash.with_next(docs).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"}
    prints = {t: order_minhash.to_text(order_minhash.signature(t)) for _, t, _, _ in rows}
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == collections.Counter((i, prints[t]) for i, t, _, _ in rows)
    assert sum(r.near_next == 1 for r in got if r.doc_id == 2) == 29
    one = next(r for r in got if r.doc_id == 3)
    assert one.edited_sha256 == hashlib.sha256(order_minhash.edited("long " * 60_000, "same").encode()).hexdigest()
    last = next(r for r in got if r.doc_id is None)
    assert last.edited_sha256 == hashlib.sha256(order_minhash.edited("none", "long " * 60_000).encode()).hexdigest()


# Jaccard join.


def brute_join(rows):
    sets = [ngram_jaccard.shingles(t).tolist() for _, t in rows]
    sets = [set(s) for s in sets]
    n = len(rows)
    near = [[i != j and (len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for j in range(n)] for i in range(n)]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if near[i][j]:
                parent[find(i)] = find(j)
    classes = collections.defaultdict(list)
    for i in range(n):
        classes[find(i)].append(rows[i][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in classes.items()}
    return [(rows[i][0], least[find(i)], sum(near[i])) for i in range(n)]


def near_copies(seed, groups, size, words=120):
    r = random.Random(seed)
    rows, k = [], 0
    for _ in range(groups):
        base = [f"w{r.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(r.randrange(0, 4)):
                own[r.randrange(words)] = f"x{r.randrange(5000)}"
            rows.append((k, " ".join(own)))
            k += 1
    return rows


@pytest.mark.parametrize("limit", [256, 4])
def test_jaccard_join(spark, monkeypatch, limit):
    """Also with nodes so small that paths split down to the last depth."""
    monkeypatch.setattr(ngram_jaccard, "LIMIT", limit)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_TEXTS", 10 if limit == 4 else 1000)
    shared = " ".join(f"p{i}" for i in range(60))
    rows = near_copies(limit, 6, 14) + [(200 + i, f"{shared} " + " ".join(f"u{i}x{j}" for j in range(60))) for i in range(30)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "a b"), (304, "a  b"), (305, "a b c d e"), (None, "null id text"), (None, rows[0][1]), (306, rows[0][1]), (306, "same id, other text")]
    df = ship(spark).createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, class_id string").repartition(4)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_jaccard.join(df).collect()), key=str)
    assert got == sorted(brute_join(rows), key=str)


def test_texts_left_meet_in_bounded_blocks(spark, monkeypatch):
    """700 of 1,000 texts left with blocks of 64: each pair with one of them meets once, in a group of two blocks at most."""
    monkeypatch.setattr(ngram_jaccard, "LIMIT", 64)
    held = spark.range(1000).select(F.lit(1).cast("long").alias("node"), F.lit(1000).cast("long").alias("m"), F.lit(700).cast("long").alias("u"), F.col("id").cast("string").cast("binary").alias("key"), F.array(F.col("id").cast("int")).alias("sketch"), (F.col("id") >= 300).alias("left"))
    groups = collections.defaultdict(list)
    for r in ngram_jaccard._in_blocks(held).collect():
        groups[r.block].append(r)
    assert max(map(len, groups.values())) < 3 * 64
    met = np.zeros((1000, 1000), int)
    for rows in groups.values():
        ids, side = np.array([r.sketch[0] for r in rows]), np.array([r.side for r in rows])
        one, two = (ids, ids) if not side.any() else (ids[side == 1], ids[side == 2])
        met[np.ix_(one, two)] += 1
        if side.any():
            met[np.ix_(two, one)] += 1
    left = np.arange(1000) >= 300
    assert (met == (left[:, None] | left[None, :])).all()


def test_jaccard_join_at_the_last_depth(spark, monkeypatch):
    """All texts share half their words and hardly one is near the pivot: what is left is compared in pairs of blocks."""
    monkeypatch.setattr(ngram_jaccard, "LIMIT", 8)
    monkeypatch.setattr(ngram_jaccard, "DEPTH", 1)
    shared = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{shared} " + " ".join(f"u{i // 2}x{j}" for j in range(60)) + f" own{i}") for i in range(120)]
    df = ship(spark).createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_jaccard.join(df).collect()) == sorted(brute_join(rows))


def test_one_of_each(spark):
    rows = near_copies(9, 3, 5) + [(2, near_copies(9, 3, 5)[2][1])] * 3 + [(None, "alone with no id")]
    df = ship(spark).createDataFrame([(i, t, "de", "s", 1) for i, t in rows], DOCS)
    out = ngram_jaccard.one_of_each(df)
    assert out.columns == df.columns
    want = {c for _, c, _ in brute_join(rows)}
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(want, key=str)
    assert ngram_jaccard.one_of_each(df.limit(0)).count() == 0 and ngram_jaccard.join(df.limit(0)).count() == 0


def pairs_near(n, low, high, words=150, seed=21):
    """n pairs of texts whose similarity lies in the range, beside a passage that all share."""
    r = random.Random(seed)
    shared = [f"p{i}" for i in range(40)]
    out = []
    while len(out) < 2 * n:
        base = [f"w{r.randrange(100_000)}" for _ in range(words)]
        own = list(base)
        for _ in range(r.randrange(1, 6)):
            own[r.randrange(words)] = f"x{r.randrange(100_000)}"
        a, b = (set(ngram_jaccard.shingles(" ".join([*shared, *t])).tolist()) for t in (base, own))
        if low <= len(a & b) / len(a | b) < high:
            out += [" ".join([*shared, *base]), " ".join([*shared, *own])]
    return out


def test_recall_at_the_threshold(spark, monkeypatch):
    """1,500 pairs of similarity 0.8 to 0.85 in a large family with a shared passage, nodes so small that they split."""
    monkeypatch.setattr(ngram_jaccard, "LIMIT", 64)
    texts = pairs_near(1500, 0.8, 0.85)
    df = ship(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in ngram_jaccard.join(df).collect()}
    found = sum(got[i].class_id == got[i + 1].class_id == i and got[i].n_links == 1 for i in range(0, 3000, 2))
    assert len(got) == 3000 and found >= 0.99 * 1500
    assert all(r.n_links <= 1 for r in got.values())


def test_groups_are_split_by_size(spark, monkeypatch):
    """Texts of 60 to 1,200 words in chains of growing prefixes: blocks of a few texts, and every link counted."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK_TEXTS", 5)
    monkeypatch.setattr(ngram_jaccard, "NEAR", 0.0)
    r = random.Random(8)
    base = [f"w{r.randrange(10_000)}" for _ in range(1200)]
    rows = [(i, " ".join(base[: 60 + 15 * i])) for i in range(77)] + [(100, base[0]), (101, " ".join(base[:5])), (102, " ".join(base[:6]))]
    df = ship(spark).createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((x.doc_id, x.class_id, x.n_links) for x in ngram_jaccard.join(df).collect()) == sorted(brute_join(rows))


def test_jaccard_join_of_very_long_texts(spark):
    r = random.Random(3)
    long = [f"w{r.randrange(100_000)}" for _ in range(200_000)]
    edited = [*long[:1000], "x", *long[1001:]]
    rows = [(1, " ".join(long)), (2, " ".join(edited)), (3, " ".join(long[:150_000])), (4, " ".join(long)), (5, "short text of five words")]
    got = {x.doc_id: (x.class_id, x.n_links, x.n_copies) for x in ngram_jaccard.join(ship(spark).createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 2, 2), 2: (1, 2, 1), 3: (3, 0, 1), 4: (1, 2, 2), 5: (5, 0, 1)}


def test_recall_is_planned():
    places = ngram_jaccard.root_places()
    assert len(set(places)) == len(places) >= 12


# Toxicity.


def test_machine_learns_pairs():
    """Two terms that are harmless alone and toxic together: no additive score can tell."""
    r = np.random.default_rng(0)
    docs, y = [], []
    for _ in range(3000):
        a, b = r.random() < 0.5, r.random() < 0.5
        noise = r.integers(100, 160, 4)
        docs.append(np.array(sorted({*([1] * a), *([2] * b), *noise.tolist()}), np.uint32))
        y.append(int(a and b))
    m = toxicity.fit(docs, np.array(y), float(np.mean(y)))
    rows = [np.flatnonzero(np.isin(m.ids, d)) for d in docs]
    wrong = sum((m.score(x) >= 0.5) != bool(t) for x, t in zip(rows, y, strict=True))
    assert wrong < 0.02 * len(y)


def test_score_is_the_sum_over_pairs():
    r = np.random.default_rng(2)
    m = toxicity.Machine(np.arange(20, dtype=np.uint32), -0.3, r.normal(0, 1, 20), r.normal(0, 1, (20, toxicity.FACTORS)))
    for n in (0, 1, 2, 7, 20):
        rows = r.permutation(20)[:n]
        z = m.bias + sum(m.weights[i] for i in rows) + sum(m.vectors[i] @ m.vectors[j] for k, i in enumerate(rows) for j in rows[:k])
        assert m.score(rows) == pytest.approx(1 / (1 + np.exp(-z)))


def test_terms_are_those_of_largest_chi_squared(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TERMS", 30)
    r = np.random.default_rng(5)
    docs = [np.unique(np.r_[r.integers(0, 200, 30), np.arange(300, 310) if i % 3 == 0 and r.random() < 0.8 else 400]) for i in range(400)]
    y = np.array([int(i % 3 == 0) for i in range(400)])
    n, n1 = len(y), int(y.sum())
    chi = {}
    for t in np.unique(np.concatenate(docs)).tolist():
        has = np.array([t in d for d in docs])
        table = np.array([[(has & (y == k)).sum(), (~has & (y == k)).sum()] for k in (0, 1)], float)
        want = np.outer(table.sum(1), table.sum(0)) / n
        if has.sum() >= toxicity.MIN_DOCS and want.min() > 0:
            chi[t] = ((table - want) ** 2 / want).sum()
    best = sorted((t for t in chi if chi[t] > toxicity.MIN_CHI), key=lambda t: (-chi[t], t))[:30]
    df = spark.createDataFrame([(int(k), [int(t) for t in d]) for k, d in zip(y, docs, strict=True)], "y int, terms array<long>")
    assert toxicity.select_terms(df).tolist() == sorted(best) and 0 < len(best) <= 30 and n1


def test_bias_follows_the_share_of_all_labels():
    """The sample holds both classes alike; a document without terms scores the share of toxic labels in training."""
    docs = [np.array([1 + (i % 2)], np.uint32) for i in range(400)]
    m = toxicity.fit(docs, np.array([i % 2 for i in range(400)]), 0.01)
    even = toxicity.fit(docs, np.array([i % 2 for i in range(400)]), 0.5)
    assert m.bias - even.bias == pytest.approx(np.log(0.01 / 0.99)) and m.score(np.array([1])) > m.score(np.array([0]))


def test_a_labelled_id_repeated_thousands_of_times_is_one_row(spark, monkeypatch):
    """One row an id reaches training, that of least hash, however the rows are dealt."""
    sent = []
    real = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda docs, y, share, ids: sent.append((docs, y)) or real(docs, y, share, ids))
    rows = [(i, f"word{i % 7} insult group" if i % 4 == 0 else f"word{i % 7} calm {i}") for i in range(400)] + [(8, f"repeat {i % 3}") for i in range(5000)]
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    machines = [toxicity.train(docs.repartition(k), labels) for k in (2, 5)]
    trained = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(400))
    assert [len(y) for _, y in sent] == [trained, trained]
    assert machines[0].bias == machines[1].bias and (machines[0].vectors == machines[1].vectors).all()


def test_toxicity_held_out(spark):
    docs, labels = ship(spark).read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.scored_documents(docs, labels).join(labels, "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for h, i in zip(got["held_out"], got["doc_id"], strict=True))
    held = got[got["held_out"]]
    assert held[held["toxic"] == 1]["predicted"].mean() > 0.8 and held[held["toxic"] == 0]["predicted"].mean() < 0.01
    assert ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()


def test_toxicity_edges(spark):
    schema = "doc_id long, text string, score string"
    docs = ship(spark).createDataFrame([(1, None, "clash"), (2, "", "x"), (3, "word " * 50_000, "x"), (None, "no id", "x"), (3, "word", "x")], schema)
    labels = spark.createDataFrame([(1, 0), (3, None), (None, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    got = toxicity.scored_documents(docs, labels).collect()
    assert len(got) == 5 and all(r.score < 0.01 and r.predicted == 0 for r in got)
    assert toxicity.scored_documents(docs.limit(0), labels.limit(0)).count() == 0


# Queries and the pipeline.


def test_each_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_pipeline_edges(spark, documents):
    """Every stage with null, empty and very long texts, null ids and sources, ties, repeated rows, clashing extra columns and no rows."""
    ship(spark)
    odd = [(None, None, None, None, None), (9001, None, "de", "a", 0), (9002, "", "xx", None, 0), (9003, " \n", None, "a", 2), (9004, "word " * 60_000, "en", "a", 300_000)]
    base = documents.limit(60).unionByName(spark.createDataFrame(odd, DOCS))
    base = base.unionByName(documents.where("doc_id < 3")).unionByName(documents.where("doc_id < 3"))
    extra = base.select("*", F.lit("clash").alias("kept"), F.lit("clash").alias("size"), F.lit("clash").alias("score"), F.lit(1).alias("class_id"), F.lit(2).alias("length"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, extra, SF).collect()
        none = stage(spark, extra.limit(0), SF)
        assert none.count() == 0
        if name != "best_fit_packing":
            assert out and list(out[0].asDict()) == extra.columns == none.columns and all(r.kept == "clash" and r["size"] == "clash" for r in out)
        ids = collections.Counter(r.doc_id for r in out)
        if name == "quality_rules":
            assert not {9001, 9002, 9003, 9004} & set(ids)
        elif name == "toxicity":
            assert {9001, 9002, 9003, 9004, None} <= set(ids) and ids[1] == 3 * (1 in ids)
        elif name == "ngram_jaccard":
            assert max(ids.values()) == 1 and len({9001, 9002, 9003, None} & set(ids)) == 1
        elif name == "mix_sources":
            assert not {9001, 9002, 9003, None} & set(ids)
        else:
            assert {9001, 9002, 9003, 9004, None} <= set(ids) and ids[9001] == 1 and ids[1] % 3 == 0


def test_pipeline_keeps_what_brute_force_keeps(spark, documents):
    """Quality, near copies and packing of a small corpus, each stage against a plain computation on its own input."""
    ship(spark)
    good = corpus_pipeline.good_documents(spark, documents, SF)
    kept = {r.doc_id for r in good.collect()}
    for r in documents.collect():
        words = [w for w in (r.text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        seen = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        again = {k + d for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for d in range(3)}
        if len(words) < 50 or 100 * len(again) > 50 * len(words):
            assert r.doc_id not in kept
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in corpus_pipeline.distinct_documents(spark, good, SF).collect()} == {c for _, c, _ in brute_join(rows)}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(good, toxicity.train(good, labels), ["doc_id"]).where("score >= 0.5").collect()}
    assert {r.doc_id for r in corpus_pipeline.harmless_documents(spark, good, SF).collect()} == {i for i, _ in rows} - toxic
    encode, sizes = packing.encoder(packing.tokenizer_file()), collections.Counter()
    for r in corpus_pipeline.packed_pieces(spark, good, SF).collect():
        sizes[r.doc_id] += r.length
    assert sizes == {i: len(encode(t)) + 1 for i, t in rows}


def test_pipeline(spark, documents):
    ship(spark)
    docs = documents
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name != "best_fit_packing":
            assert out.columns == documents.columns and out.dtypes == documents.dtypes
            kept.append({r.doc_id for r in out.select("doc_id").collect()})
            docs = out
    assert len(kept[0]) < documents.count() and kept[0] >= kept[1] >= kept[2] >= kept[3]
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == kept[3]
    assert corpus_pipeline.run(spark, SF).count() == out.count()
