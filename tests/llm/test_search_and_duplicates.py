import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gatherline.llm import fingerprint, neardup, topk
from gatherline.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, score long"


def brute(rows, ids, k):
    """(query, rank, id, score) by plain integer products of usable rows."""
    ok = [(i, [math.floor(256 * Fraction(float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q in ids:
        mine = min([v for i, v in ok if i == q], default=None)
        if mine is None:
            continue
        best = {}
        for i, v in ok:
            if i != q:
                s = sum(a * b for a, b in zip(mine, v, strict=False))
                best[i] = max(best.get(i, s), s)
        out |= {(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(((s, i) for i, s in best.items()), key=lambda x: (-x[0], x[1]))[:k])}
    return out


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, np.float32(rng.normal(0, 0.2, 9)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(50, None), (2000, [None, 1.0]), (2001, [float("nan")] * 9), (2002, [float("inf")] * 9), (None, rows[0][1]), (7, rows[8][1]), (7, rows[7][1]), (2003, []), (2004, [1.0, -2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    got = {tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), k=5).collect()}
    assert got == brute(rows, range(0, 2050, 50), 5)
    assert topk.top_k(df.limit(0), df, k=5).count() == topk.top_k(df, df.limit(0), k=5).count() == 0
    few = spark.createDataFrame([(0, [0.5], 1), (1, [0.25], 1)], SCHEMA)
    assert [tuple(r) for r in topk.top_k(few, few.where("vec_id = 0"), k=5).collect()] == [(0, 1, 1, 128 * 64)]


def test_top_k_of_large_components(spark):
    """Finite components of any size take part, as candidates and as queries; scores beyond long are ranked by their true value and stated as the nearest long."""
    rows = [(0, [1.0, 1.0]), (1, [3e5, 1.0]), (2, [3e38, 0.0]), (3, [2.9e38, 1.0]), (4, [-3e38, 0.0]), (5, [-2.9e38, 0.0]), (6, [1e30, -1e30]), (50, [3e38, 3e38]), (100, [-1e20, 1e-3])]
    rows += [(200 + i, [i / 100, -i / 50]) for i in range(150)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = {(q, n, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, n, i, s in brute(rows, range(0, 400, 50), 5)}
    assert {tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), k=5).collect()} == want
    assert {(0, 1, 50), (0, 2, 2), (0, 3, 3)} <= {x[:3] for x in want} and any(x[3] == (1 << 63) - 1 for x in want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-600, 600), min_size=3, max_size=3), min_size=1, max_size=90), st.lists(st.integers(-300, 300), min_size=3, max_size=3))
def test_bitmap_sums(rows, query):
    import pandas as pd

    block = topk.index_block(pd.DataFrame({"block": 0, "vec_id": range(len(rows)), "embedding": [np.array(r) / 256 for r in rows]})).iloc[0]
    got = list(topk.search_block(block, np.array([-1]), [np.array(query)], 7))
    want = sorted(((sum(a * b for a, b in zip(r, query, strict=True)), i) for i, r in enumerate(rows)), key=lambda x: (-x[0], x[1]))[:7]
    assert sorted(got, key=lambda x: (-x[2], x[1])) == [(-1, i, s, "") for s, i in want]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in ids}


def test_near_duplicates_against_brute_force(spark, odd, no_rows):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(4))
    rows = [(i, " ".join(word() for _ in range(r.randint(1, 60)))) for i in range(60)]
    for i in range(60, 240):  # copies with edits, of copies too
        w = r.choice(rows)[1].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    star = [word() for _ in range(120)]  # all like one text, few like each other
    for i in range(300, 340):
        w = list(star)
        at = r.randrange(100)
        w[at : at + 8] = [word() for _ in range(8)]
        rows.append((i, " ".join(w)))
    rows.append((999, " ".join(star).upper()))
    rows += [(1001, None), (1002, ""), (1003, " \n")]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, label string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(df).collect()}
    assert got == components(rows)
    found = neardup.near_duplicates(odd).collect()
    assert len(found) == 16 and {x["component_id"] for x in found if x["doc_id"] in (5, 6, 7)} == {5}
    assert neardup.near_duplicates(no_rows).count() == 0


def test_partners_of_a_turn(spark):
    """Members outside the lead label get a partner of the lead and a neighbour; the rest none, so pairs grow with the members."""
    rows = [(1, bytes([0, i]), bytes([i]), bytes([7]) if i < 9 else bytes([i])) for i in range(40)]
    rows += [(2, b"aa", bytes([i]), bytes([7])) for i in range(9)]
    members = spark.createDataFrame(rows, "band long, tail binary, node binary, label binary")
    seen = set()
    for turn in range(3):
        m = members.join(neardup.leads_of(members, turn), "band")
        assert {r["band"] for r in m.select("band").distinct().collect()} == {1}
        pairs = {(bytes(r["a"])[0], bytes(r["b"])[0]) for r in neardup.pairs_of(m.where("label <> lead"), turn).collect()}
        stars = {(a, b) for a, b in pairs if a < 9}
        assert {b for _, b in stars} == set(range(9, 40)) and len({a for a, _ in stars}) == 1
        assert pairs - stars == ({(i, i + 1) for i in range(9, 39)} if turn else set())
        seen |= {a for a, _ in stars}
    assert len(seen) > 1


def test_pairs_of_a_bucket_that_are_no_neighbours(spark, monkeypatch):
    """Texts that share most of a passage, and two of each ten that are alike enough: one bucket a band, wherever neighbours and centres are."""
    r = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    own = lambda i, n: [f"w{i}-{k}" for k in range(n)]
    rows = [(i, " ".join(passage + own(i - 5 if i % 10 == 5 else i, 24) + own(f"x{i}", 6))) for i in range(150)]
    r.shuffle(rows)
    want = components(rows)
    assert sum(i != x for i, (_, x) in want.items()) == 15
    monkeypatch.setattr(neardup, "pairs_of", lambda members, turn: members.select(members["node"].alias("a"), members["node"].alias("b")).limit(0))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(df).collect()} == want


def test_prefix_pairs_against_all_pairs(spark):
    r = random.Random(5)
    sets = [sorted(r.sample(range(40), r.randint(1, 14))) for _ in range(120)]
    sets += [sorted({*s[1:], r.randrange(40)}) for s in sets]
    df = spark.createDataFrame([(i, i % 200, s) for i, s in enumerate(sets)], "node long, label long, shingles array<long>")
    alike = {(a, b) for a in range(240) for b in range(a + 1, 240) if a % 200 != b % 200 and 100 * len({*sets[a]} & {*sets[b]}) >= 75 * len({*sets[a]} | {*sets[b]})}
    got = {(x["a"], x["b"]) for x in neardup.pairs_by_prefix(df, 75, Scratch(spark)).collect()}
    assert alike and alike <= got and len(got) < 240 * 239 // 4


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(100)] + [(200, 250), (250, 210), (300, 300)]
    got = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 210: 200, 250: 200}


def test_fingerprints(spark, odd, no_rows):
    got = fingerprint.fingerprints(odd).collect()
    assert len(got) == 16 and len({x["fingerprint"] for x in got if x["doc_id"] in (5, 6)}) == 1
    empty = [x for x in got if x["doc_id"] in (0, 1, 2)]
    assert {x["fingerprint"] for x in empty} == {"f" * 8 * fingerprint.SAMPLES}
    assert fingerprint.fingerprints(no_rows).count() == 0
    one = fingerprint.fingerprints(odd.where("doc_id = 9")).first()
    assert one["near_next"] == 1.0


def test_fingerprints_against_brute_force(spark):
    """Digests and lengths of edited texts, and likeness to the next document, in descending ids that lie in clumps, repeat or are null."""
    r = random.Random(9)
    ids = [*range(700), *range(10**15, 10**15 + 600), *[5_000] * 300, -(1 << 60), None, None]
    rows = [(i, "".join(r.choice("ab é🔥c ") for _ in range(r.randint(0, 40))) or None) for i in ids]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    alone = {i: t or "" for i, t in rows if ids.count(i) == 1}
    order = sorted({i for i in ids if i is not None}, reverse=True)
    prints = {x["doc_id"]: x for x in got}
    checked = 0
    for i, after in zip(order, order[1:]):
        if i in alone and after in alone:
            n = len(alone[i])
            edited = alone[i][: n - n // 3] + alone[after][: n // 3]
            x = prints[i]
            assert (x["n_chars"], x["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
            pieces = [[prints[k]["fingerprint"][j : j + 8] for j in range(0, 8 * fingerprint.SAMPLES, 8)] for k in (i, after)]
            assert x["near_next"] == sum(a == b for a, b in zip(*pieces)) / fingerprint.SAMPLES
            checked += 1
    assert checked > 1290


def test_buckets_are_even(spark):
    """Also where ids, or ids and texts, repeat in a third of all rows."""
    from pyspark.sql import functions as F

    hot = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") == 1, 10**17).otherwise(F.col("id"))
    for text in (F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string"))):
        docs = spark.range(0, 20_000).select(hot.alias("doc_id"), text.alias("text"))
        found = fingerprint.dealt(docs)
        ends = fingerprint.bounds(found.select("at.*"))
        assert ends == sorted(ends) and 30 <= len(ends) < 20_000 // fingerprint.BUCKET_ROWS
        sizes = found.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("bucket").collect()
        assert len(sizes) > 30 and max(r["n"] for r in sizes) < 4 * fingerprint.BUCKET_ROWS and all(x["b"] <= y["a"] for x, y in zip(sizes, sizes[1:]))


def test_rows_that_repeat_each_other_are_neighbours(spark):
    """6,000 equal rows fill several buckets: all but the last of them are followed by one like them."""
    from pyspark.sql import functions as F

    docs = spark.range(0, 9_000).select(F.when(F.col("id") < 6_000, 5).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 6_000, "one two three").otherwise(F.concat(F.lit("t "), "id")).alias("text")).repartition(5)
    got = fingerprint.fingerprints(docs).groupBy(F.col("doc_id") == 5, "near_next").count().collect()
    assert sorted((r["(doc_id = 5)"], r["count"]) for r in got if r["near_next"] == 1.0) == [(True, 5_999)] and sum(r["count"] for r in got) == 9_000


def test_dealt_texts_are_shuffled_once(spark):
    """One exchange deals texts out; what comes after stays where it is."""
    from pyspark.sql import functions as F

    docs = spark.range(0, 3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text of "), "id").alias("text"))
    plan = fingerprint.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bucket") == 1 and "SortMergeJoin" not in plan


def test_collisions_follow_generalised_jaccard(spark):
    from collections import Counter

    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choice(words[: r.randint(5, 60)]) for _ in range(r.randint(1, 150)))) for i in range(400)]
    got = {x["doc_id"]: x for x in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    errors = []
    for i, t in rows:
        n = len(t)
        after = dict(rows)[i - 1 if i else 399]
        edited = t[: n - n // 3] + after[: n // 3]
        a, b = Counter(t.split()), Counter(edited.split())
        errors.append(got[i]["near_edited"] - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.12
