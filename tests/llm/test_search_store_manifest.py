import hashlib
import heapq
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatherline.llm import lexical, manifest, queries, token_store
from gatherline.llm.common import new_path, remainder_of_crc32

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.WORD_VOCABULARY)


def terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def ranking(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    rows = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        rows += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(rows, key=repr)


ITEMS = [(1, "the quick Brown fox, the LAZY dog"), (2, None), (3, "..."), (4, "über straße one x-y 1234"), (4, "nothing hereof"), (5, "the " * 50 + "one"), (None, "b")]


def test_search(spark, odd, no_rows, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = lambda k: sorted(map(tuple, lexical.ranked(odd, items, k).collect()), key=repr)
    assert got(20) == ranking(docs, ITEMS, 20) and got(3) == ranking(docs, ITEMS, 3)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 8)  # several blocks of items
    monkeypatch.setattr(lexical, "BUCKET_DOCS", 2)
    assert got(3) == ranking(docs, ITEMS, 3)
    assert lexical.ranked(no_rows, items).count() == 0 and lexical.ranked(odd, items.limit(0)).count() == 0


def test_search_prunes_exactly(spark, monkeypatch):
    """A third of the documents repeat each other; thresholds rise within tasks and between them."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choice(vocabulary[: r.randint(1, 60)]) for _ in range(r.randint(1, 40)))) for i in range(400)] + [(1000 + i, "w1 w2 w3 w40") for i in range(200)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 8)))) for i in range(25)]
    monkeypatch.setattr(lexical, "BUCKET_DOCS", 16)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = lexical.ranked(table, spark.createDataFrame(items, "item_id long, text string"), 7)
    assert sorted(map(tuple, got.collect()), key=repr) == ranking(docs, items, 7)


def test_bounds_cut_something():
    r = np.random.default_rng(3)
    sizes = np.full(64, 2)
    bucket = lexical.Bucket(np.full(64, 1e6), sizes, r.integers(0, 20, 128).reshape(64, 2).cumsum(1).ravel() % 20, r.integers(1, 700_000, 128), 20)
    docs, scores = lexical.reaching(bucket, np.arange(20), np.arange(1, 21), 1)
    best = sorted(zip(docs.tolist(), scores.tolist()), key=lambda x: -x[1])
    least = best[4][1]
    assert sorted(zip(*map(list, lexical.reaching(bucket, np.arange(20), np.arange(1, 21), least)))) == sorted((d, s) for d, s in best if s >= least)
    assert not len(lexical.reaching(bucket, np.arange(20), np.arange(1, 21), 10**9)[0])


def test_code_lengths():
    r = random.Random(1)
    for n in (1, 2, 3, 50, 500):
        counts = {i * 3: int(r.paretovariate(0.5)) + 1 for i in range(n)}
        free = token_store.code_lengths(counts, 60)
        heap = [(c, 0) for c in counts.values()]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap)[0], heapq.heappop(heap)[0]
            cost += a + b
            heapq.heappush(heap, (a + b, 0))
        assert sum(counts[i] * b for i, b in free.items()) == (cost or counts[0])
        short = token_store.code_lengths(counts, 9)
        assert max(short.values()) <= 9 and sum(2.0**-b for b in short.values()) == (1 if n > 1 else 0.5)
        codes = token_store.Codes(short)
        for size in (0, 1, 127, 128, 129, 5000):
            ids = np.array([r.choice(list(counts)) for _ in range(size)], np.int32)
            payload, points = codes.encode(ids)
            assert len(payload) == (int(codes.bits[ids].sum()) + 7) // 8
            assert codes.decode(payload, points, token_store.stretches(np.array([size]))).tolist() == ids.tolist()
            if size == 5000:  # any stretch by itself
                assert codes.decode(payload, points[7:8], np.array([128])).tolist() == ids[7 * 128 : 8 * 128].tolist()


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids + [1] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_are_encoded_as_whole_texts(monkeypatch):
    r = random.Random(9)
    parts = ["don't", "İstanbul", "ΣΑΣ", "é", "́x", "ﬁ", "<|endoftext|>", "\x1c", "\x85", "\xa0", " ", "\x0b", "\t", "\r\n", " ", "  ", "日本", "42nd", "'s", "...", "한", "하", "Å", "ǅ", "\x00", "x" * 300, "🙂"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(800)]
    texts += ["".join(chr(r.choice([r.randrange(33, 127), r.randrange(128, 0x530), r.randrange(0x300, 0x370), 32])) for _ in range(40)) for _ in range(800)]
    texts += ["".join(map(chr, range(n, n + 64))) for n in range(0, 0xD800, 64)]
    e = token_store.Encoder(PATH)
    for at in range(0, len(texts), 100):
        assert [[*x, 1] for x in e.encode(pa.array(texts[at : at + 100]))] == library(texts[at : at + 100])
    assert all(len(w) <= token_store.KEPT_BYTES for w in e.number)
    monkeypatch.setattr(token_store, "KEPT_WORDS", 50)  # what isn't kept is encoded anew
    monkeypatch.setattr(token_store, "KEPT_PIECES", 20)
    few = token_store.Encoder(PATH)
    for at in range(0, 1600, 100):
        assert [[*x, 1] for x in few.encode(pa.array(texts[at : at + 100]))] == library(texts[at : at + 100])
    assert len(few.number) <= 50 and len(few.piece) <= 20


def test_store(spark, odd, no_rows):
    rows = odd.collect()
    want = dict(zip(range(len(rows)), library([r["text"] for r in rows])))
    for shards, block in ((1, 1 << 17), (4, 50), (9, 1 << 17)):
        folder = new_path(spark)
        token_store.write(odd.repartition(3), PATH, folder, 1, shards=shards, block_ids=block)
        got = sorted(token_store.read(spark, folder, digests=True).collect(), key=lambda r: r["start"])
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((r["doc_id"], tuple(want[i])) for i, r in enumerate(rows))
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
        assert ids == sorted(ids) and [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
        assert all(r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
        blocks = spark.read.parquet(f"{folder}/blocks")
        if shards == 4:
            assert blocks.count() > 4 and blocks.groupBy("shard").count().count() > 1
    folder = new_path(spark)
    token_store.write(no_rows, PATH, folder, 1)
    assert token_store.read(spark, folder).count() == 0


def test_store_spreads_a_hot_id(spark):
    docs = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    sizes = token_store.shard_of(docs, 9).groupBy("shard").count().collect()
    assert max(r["count"] for r in sizes) < 250
    ends = token_store.shard_of(docs, 9).groupBy("shard").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("shard").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(ends, ends[1:]))


def test_op12(spark):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    start, want = 0, []
    for r, ids in zip(rows, library([r["text"] for r in rows])):
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = queries.op12_store(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == want


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    values = [r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"]]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, at):
    """The last node above nodes, and (sibling, whether it is left) from the node at upwards."""
    path = []
    while len(nodes) > 1:
        other = at ^ 1
        path.append((nodes[other] if other < len(nodes) else None, other < at))
        nodes, at = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], at // 2
    return nodes[0], path


def manifest_of(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots = [climb([leaf(r) for r in groups[g]], 0)[0] for g in langs]
    out = []
    for k, g in enumerate(langs):
        root, above = climb(subroots, k)
        for at, r in enumerate(groups[g]):
            path = climb([leaf(x) for x in groups[g]], at)[1] + above
            h = leaf(r, 1) if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 == 0 else leaf(r)
            for sibling, left in path:
                h = H(sibling, h) if left else H(h, sibling or "")
            out.append((r["doc_id"], leaf(r), subroots[k], root, H(*(s for s, _ in path if s)), h, h == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digit", [1, 2, 8])
def test_manifest(spark, odd, no_rows, monkeypatch, digit):
    monkeypatch.setattr(manifest, "DIGIT", digit)
    made = lambda df: sorted(map(tuple, manifest.verified(df, remainder_of_crc32(F.col("doc_id"), 7) == 0, F.col("n_chars") + 1).collect()), key=repr)
    lone = odd.where("doc_id = 3")
    assert made(odd.repartition(3)) == manifest_of(odd.collect()) and made(lone) == manifest_of(lone.collect())
    assert made(no_rows) == []


def test_manifest_of_many_langs_and_a_hot_one(spark):
    rows = spark.range(700).select("*", F.when(F.col("id") % 3 > 0, F.concat(F.lit("l"), (F.col("id") % 40).cast("string"))).otherwise("en").alias("lang"), F.lit(5).alias("n_chars"), F.lit("s").alias("source"))
    rows = rows.select(F.when(F.col("id") % 2 == 0, 9).otherwise(F.col("id")).alias("doc_id"), "lang", "n_chars", "source", F.lit("same").alias("text"), F.lit(1).alias("rank"), F.lit(2).alias("g"))
    got = manifest.verified(rows, F.col("doc_id") % 7 == 0, F.col("n_chars") + 1)
    assert sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256").collect()), key=repr) == sorted((r[:5] for r in manifest_of(rows.collect())), key=repr)
    assert {(r["doc_id"] % 7 == 0, r["verified"]) for r in got.collect()} == {(True, False), (False, True)}
