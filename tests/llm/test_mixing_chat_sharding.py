import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gatherline.llm import chat, mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_fill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_taken(spark):
    rows = [(i, "w " * (1 + i * 37 % 400), [None, "b", "a", "c", "d"][min(i % 9, 4)], "extra") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.taken_words(docs, block_words=16).collect()
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len(WORD.findall(t))
    want, taken = water_fill(sizes), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]])
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 32 for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken_words(docs, block_words=16).collect()), key=str)


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long"))).collect()]
        assert sorted(got) == list(range(n))
        assert n < 1000 or got != list(range(n))


def test_mix_rows_are_a_deal_of_all_slots(spark, odd, no_rows):
    m = mixing.mix(odd.withColumn("key", F.col("text")), block_words=8, shard_slots=64)
    draws = m.rows.select("shard", "slot", "sid", "block").distinct().collect()
    asked = m.sources.agg({"n_draws": "sum"}).first()[0]
    assert len({(r["shard"], r["slot"]) for r in draws}) == len(draws) == asked
    assert {r["shard"] * 64 + r["slot"] for r in draws} == set(range(asked))
    sizes = {(r["doc_id"], r["source"]): r for r in mixing.taken_words(odd).collect()}
    assert sizes[0, None]["size"] == sizes[0, None]["taken"] == 0
    assert mixing.taken_words(no_rows).count() == mixing.mixed_texts(no_rows).count() == 0


def test_mixed_texts_keep_white_space(spark):
    docs = spark.createDataFrame([(1, "  a b\n\nc ", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["text"] for r in mixing.mixed_texts(docs).collect()]
    assert got and set(got) == {"  a b\n\nc "}


@pytest.mark.parametrize("cap", [2.0, 1.0])
def test_mixed_texts_hold_what_is_taken(spark, cap):
    """Word by word, for rows that repeat a document, wholly or with another text, too: none is lost and none comes from elsewhere."""
    text = lambda i, n: " ".join(f"w{i}-{k}" for k in range(n))
    rows = [(1, text("a", 100), "en", "s", 1), (1, text("b", 100), "en", "s", 1), (1, text("a", 100), "en", "s", 1), (None, text("c", 70), None, None, 1), (2, text("d", 30), "de", "t", 1), (2, None, "de", "t", 1), (3, "", "de", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    options = {"block_words": 16, "cap": cap}
    got = [(r["doc_id"], r["source"], r["text"].split()) for r in mixing.mixed_texts(docs, **options).collect()]
    taken = {(r["doc_id"], r["source"]): r["taken"] for r in mixing.taken_words(docs, **options).collect()}
    words = Counter(((i, s), w) for i, s, ws in got for w in ws)
    assert {k: sum(n for (d, _), n in words.items() if d == k) for k in taken} == taken
    have = Counter(((i, s), w) for i, t, _, s, _ in rows for w in (t or "").split())
    assert all(n <= 2 * have[k] for k, n in words.items())
    assert taken[1, "s"] >= 150 and all(len(ws) for _, _, ws in got)
    for _, _, ws in got:  # in order, from one row
        at = [int(w.split("-")[1]) for w in ws]
        assert at == sorted(set(at)) and len({w.split("-")[0] for w in ws}) == 1


CHAT = [
    (1, 0, "system", "be <|im_start|> good"), (1, 1, "user", "a<\\|b <\\\\| <|"), (1, 2, "assistant", "<"), (1, 3, "user", "|"), (1, 4, "assistant", "|im_end|>\n"),
    (1, 4, "assistant", "|im_end|>\n"), (2, None, None, None), (2, 5, "a%0A\nb", ""), (None, 1, "assistant", "é🔥" * 5000), (3, 1, "assistant", None),
]


def test_chat_round_trip(spark):
    c = spark.createDataFrame([(*r, "x", 1) for r in CHAT], "conv_id long, turn long, role string, text string, kind string, seq long")
    formatted = chat.render(chat.reconstruct(chat.log_of(c)))
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    for conv in {r[0] for r in CHAT}:
        turns = sorted(((t if t is not None else -1), r or "", x or "") for k, t, r, x in CHAT if k == conv)
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        g = got[conv]
        assert g["n_turns"] == len(turns)
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (g["loss_chars"], g["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    for r in formatted.collect():
        assert r["formatted"].count("<|im_start|>") == got[r["conv_id"]]["n_turns"] == r["formatted"].count("<|im_end|>\n")


def test_events_fold_by_sequence(spark):
    e = [(1, 5, 1, "user", "delta", "b"), (1, 1, 1, "user", "delta", "a"), (1, 2, 2, "assistant", "delta", "no"), (1, 3, 2, None, "regenerate", "ignored"), (1, 4, 2, None, "delta", "yes"), (1, 9, 1, None, "edit", "E"), (1, 10, 1, None, "delta", "!"), (1, 11, 3, None, None, None)]
    df = spark.createDataFrame(e, "conv_id long, seq long, msg long, role string, kind string, text string")
    got = {r["msg"]: (r["role"], r["text"]) for r in chat.reconstruct(df).collect()}
    assert got == {1: ("user", "E!"), 2: ("assistant", "yes"), 3: ("", "")}
    assert chat.digests(chat.render(chat.reconstruct(df.limit(0)))).count() == 0


@pytest.mark.parametrize("limit", [200, 5000, 1 << 30])
def test_sharding(spark, odd, no_rows, limit):
    got = sharding.shard(odd, limit=limit).collect()
    bits = lambda k: format(int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:12], 16), "048b")
    size = [(bits(r["doc_id"]), r["n_bytes"]) for r in got]
    assert len(got) == 16 and {r["n_bytes"] for r in got if r["doc_id"] in (0, 1)} == {0}
    for r in got:
        b = bits(r["doc_id"])
        sums = [sum(n for x, n in size if x[:d] == b[:d]) for d in range(49)]
        depth = next((d for d in range(49) if sums[d] <= limit), 48)
        assert (r["depth"], r["shard"], r["shard_bytes"]) == (depth, b[:depth], sums[depth])
    assert sharding.shard(no_rows).count() == 0
