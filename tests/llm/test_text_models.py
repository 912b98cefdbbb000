import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gatherline.llm import bpe, langid, lmscore, queries, secret_scan
from gatherline.llm.common import remainder_of_crc32

SF = "/root/testdata/sf0.001"
RANKS = bpe.load_ranks(public_tokenizers.path(queries.VOCABULARY))


def base(text):
    found = []
    kw = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", "password|passwd|secret|token|api_?key")
    for m in re.finditer(rf"({kw})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_base_spans():
    r = random.Random(2)
    parts = ["token", "Secret", "api_key", "APIKEY", "passwd", "=", ":", " ", '"', "'", "abcdefabcdef", "0123456789ab", "AKIA", "ABCDEFGHIJKLMN", "é", "ſecret", "short", "\n", "password"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert secret_scan.spans_of(t) == base(t)


def test_automata_tell_formats_apart(spark, odd, no_rows):
    r = random.Random(7)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(20)) for _ in range(300)]
    ordinary = ["".join(r.choice("etaoin") for _ in range(r.randint(12, 18))) for _ in range(300)]
    s = secret_scan.Model({"hex": Counter(map(secret_scan.format_of, hexes)), "word": Counter(map(secret_scan.format_of, ordinary))})
    new = "".join(r.choice("0123456789abcdef") for _ in range(12)) + "0a1b2c3"
    assert s.likely(secret_scan.format_of(new)) and not s.likely(secret_scan.format_of("etaoinetaointea")) and not s.likely("999.999.99.99")
    assert len(secret_scan.Automaton(Counter(map(secret_scan.format_of, hexes))).out) < 60  # states were merged
    got = secret_scan.scan(odd, secret_scan.fit(odd), redact=True).collect()
    assert len(got) == 16 and [x["n_assign"] for x in got if x["doc_id"] == 12] == [1]
    assert [x["redacted"] for x in got if x["doc_id"] == 12] == ['[secret]"'] and [x["redacted"] for x in got if x["doc_id"] == 0] == [None]
    assert secret_scan.scan(no_rows, secret_scan.fit(no_rows)).count() == 0


def test_every_candidate_is_scored():
    """Runs of letters only are scored, and so is what is left and right of base spans in a run."""
    assert secret_scan.outside(0, 10, [(2, 1, 4), (3, 2, 6), (8, 2, 12)]) == [(0, 2), (6, 8)] and secret_scan.outside(0, 5, []) == [(0, 5)]
    s = secret_scan.Scanner(secret_scan.Model({"hex": {"h" * 20: 1}}))
    seen = []
    s.secret = lambda form: seen.append(form) or form in ("UlUlUlUlUlUl", "U9U9U9U9U9U9-" + "9" * 16 + "-U9U9")
    assert s.scan("see QxQxQxQxQxQx and quiltquiltqu")[1] == [(4, 3, 16)] and len(seen) == 2
    digits = "0123456789012345"
    base, more = s.scan(f"Z1Z1Z1Z1Z1Z1-{digits}-Z1Z1")
    assert base == [(13, 2, 29)] and more == [(0, 3, 13), (29, 3, 34)]
    assert s.scan(f"my_token=abc{digits}")[1] == []


def test_automata_know_whole_formats():
    """Formats of 60 characters have states to their end: one that ends earlier, goes on or breaks off its rule is less likely; unseen symbols lead to the state of all symbols."""
    form = "".join("lU9-"[i % 4] for i in range(60))
    a = secret_scan.Automaton(Counter({form: 300, form[:-4]: 300}))
    at = a.log_likelihood(form)
    assert at == pytest.approx(a.log_likelihood(form[:-4]), abs=0.2)
    assert all(a.log_likelihood(f) < at - 0.02 for f in (form[:50], form[:57], form + "lU9-lU9-lU9-", form[:40] + "9" * 20, form[:30] + "?" + form[31:]))
    none = secret_scan.Automaton(Counter())
    assert none.log_likelihood("abc") == none.log_likelihood("+++") == pytest.approx(-math.log(16))


def test_fit_is_the_same_however_rows_are_dealt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    one, *others = (secret_scan.fit(docs.repartition(n)) for n in (1, 3, 16))
    assert one.keys() >= {"assign", "hex", "word"} and all(x == one for x in others)


def likelihood(formats, form):
    """Of a format under an automaton, by walking the counts of its states again."""
    a = secret_scan.Automaton(Counter(formats))
    total, s = 0.0, 0
    for c in [*form, ""]:
        seen = a.rest if s is None else a.out[s]
        total += math.log((seen[c] + 0.05) / (sum(seen.values()) + 0.8))
        s = None if s is None else a.to[s].get(c)
    return total / (len(form) + 1)


def test_model_spans_against_brute_force(spark):
    """Every run of 12 characters or more outside base spans is a span if and only if its format's likelihoods say so."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    formats = secret_scan.fit(docs)
    least = {k: min(likelihood(formats[k], f) for f in formats[k]) - 0.2 for k in formats if k != "word"}
    known = {}

    def secret(form):
        if form not in known:
            at = [x for k in least if (x := likelihood(formats[k], form)) >= least[k]]
            known[form] = bool(at) and max(at) - likelihood(formats["word"], form) >= secret_scan.LEAST_RATIO
        return known[form]

    got = {x["doc_id"]: x["spans"] for x in secret_scan.scan(docs, formats).collect()}
    n = 0
    for r in docs.collect()[:60]:
        text = r["text"] or ""
        spans = {(int(a), int(b), k) for k, a, b in (x.split(":") for x in got[r["doc_id"]].split(",") if x)}
        taken = base(text)
        assert {(a, b, secret_scan.KINDS[k]) for a, k, b in taken} == {x for x in spans if x[2] != "model"}
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]{12,}", text):
            if not any(a < m.end() and m.start() < b for a, _, b in taken):
                assert ((m.start(), m.end(), "model") in spans) == secret(secret_scan.format_of(m[0]))
                n += 1
    assert n > 100


def test_language_by_brute_force(spark):
    """Predictions, scores and rejections, compressed here piece by piece with the same dictionaries."""
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dictionaries = langid.fit(docs, F.lit(True))
    assert dictionaries == langid.fit(docs.repartition(5), F.lit(True)) and len(dictionaries) >= 2
    got = {x["doc_id"]: x for x in langid.identify(docs, dictionaries).collect()}
    for r in docs.collect()[:50]:
        data = re.sub(r"[\W\d_]+", " ", (r["text"] or "").lower()).encode()
        sizes = []
        for lang, content in dictionaries.items():
            p = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, min_match=langid.MIN_MATCH, dict_size=len(content), source_size=langid.PIECE_BYTES)
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            c = zstandard.ZstdCompressor(compression_params=p, dict_data=d)
            sizes.append((sum(len(c.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)), lang))
        sizes.sort()
        x = got[r["doc_id"]]
        if x["lang_pred"] != "und":
            assert (x["lang_pred"], x["score"]) == (sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0])
            assert x["rejected"] == (x["score"] < langid.MARGIN)


def test_language_accuracy_on_held_out(spark, odd, no_rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op5_langid(spark, "/root/testdata/sf0.01").join(docs, "doc_id")
    held = got.where("held_out AND length(text) >= 200")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()
    one = got.select("doc_id", "held_out").first()
    assert one["held_out"] == (zlib.crc32(str(one["doc_id"]).encode()) % 4 == 2)
    found = {x["doc_id"]: x for x in langid.identify(odd, langid.fit(docs, F.lit(True))).collect()}
    assert {i for i, x in found.items() if x["lang_pred"] == "und"} == {0, 1, 2, 10}
    assert all(0 <= x["score"] <= 1 for x in found.values())
    assert langid.identify(no_rows, langid.fit(no_rows, F.lit(True))).count() == 0
    assert {x["lang_pred"] for x in langid.identify(odd, {}).collect()} == {"und"}


def test_bpe_as_tiktoken(spark, odd, no_rows):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    c = bpe.Coder(RANKS, public_tokenizers.PATTERN)
    r = random.Random(4)
    alphabet = [*map(chr, range(0x250)), *"  　​🔥漢字١", *"  \n\n''sstt"] * 2 + list("etaoin ") * 80
    for k in range(1500):
        t = "".join(r.choice(alphabet) for _ in range(r.choice([2, 9, 60])))
        t = t if k % 10 else r.choice("ab \n漢") * r.randint(60, 900)
        assert c.encode(t) == ",".join(map(str, own.encode_ordinary(t)))
        assert c.decode(c.encode(t)) == t.encode()
    texts = {x["doc_id"]: x["text"] or "" for x in odd.where("doc_id is not null").collect()}
    for x in bpe.encode(odd.where("doc_id is not null"), RANKS, public_tokenizers.PATTERN, digests=True).collect():
        ids = own.encode_ordinary(texts[x["doc_id"]])
        assert list(x["ids"]) == ids and x["n_tokens"] == len(ids) and bytes(x["decoded"]) == texts[x["doc_id"]].encode()
        assert x["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode(no_rows, RANKS, public_tokenizers.PATTERN).count() == 0


def test_folds_merge_as_tasks_do(spark, monkeypatch):
    """The fold of higher-order functions over the literal map, on words of texts and random ones; encoding with few and with many words known beforehand."""
    r = random.Random(6)
    texts = [x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    find = bpe.Coder(RANKS, public_tokenizers.PATTERN).find
    words = {w for t in texts for w in find(t or "")} | {"".join(r.choice("ab é漢🔥\n") for _ in range(r.randint(1, 9))) for _ in range(200)} | {"a", "aaaaaaaaaaaaaaaa", " "}
    words = sorted(w for w in words if len(w.encode()) <= bpe.FOLDED_BYTES)
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", F.get(F.transform(F.array(bpe.rank_map(RANKS)), lambda t: bpe.folded(F.col("w"), t)), F.lit(0)).alias("ids")).collect()
    assert len(got) > 500 and all(list(x["ids"]) == bpe.merged(x["w"].encode(), RANKS) for x in got)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    known = bpe.frequent_words(docs.select("text"), RANKS, public_tokenizers.PATTERN)
    assert len(known) > 500 and all(ids == ",".join(map(str, bpe.merged(w.encode(), RANKS))) for w, ids in known.items())
    monkeypatch.setattr(lmscore, "FREQUENT", 20)
    few = bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert {x["doc_id"]: ",".join(map(str, x["ids"])) for x in few} == {i: bpe.Coder(RANKS, public_tokenizers.PATTERN).encode(t) for i, t in enumerate(texts)}


def ppm(docs, held):
    """(n_tokens, n_known, N, base, score) by row: contexts of all orders over whole texts in one dictionary, symbols coded one by one."""
    words = {i: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] for i, t in docs}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in [*ws, b""])
    trie = {}
    for i, ws in words.items():
        if not held[i]:
            s = b"\n" * 4 + b" ".join(ws) + b"\n"
            for at in range(4, len(s)):
                for k in range(5):
                    trie.setdefault(s[at - k : at], Counter())[s[at]] += 1

    def code(ws):
        s, total = b"\n" * 4 + b" ".join(ws) + b"\n", 0.0
        for at in range(4, len(s)):
            gone = set()
            for k in range(4, -1, -1):
                seen = {x: n for x, n in trie.get(s[at - k : at], {}).items() if x not in gone}
                if not seen:
                    continue
                p = seen.get(s[at], len(seen)) / (sum(seen.values()) + len(seen))
                total += math.log10(p)
                if s[at] in seen:
                    break
                gone |= seen.keys()
            else:
                total -= math.log10(256 - len(gone))
        return total

    n, v = sum(counts.values()), len(counts)
    base_of = lambda ws: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, b""])
    return {i: (len(ws) + 1, sum(counts[w] > 0 for w in [*ws, b""]), n, base_of(ws), code(ws)) for i, ws in words.items()}


@pytest.mark.parametrize("frequent", [3, 1 << 16])
def test_ppm_against_brute_force(spark, odd, no_rows, monkeypatch, frequent):
    monkeypatch.setattr(lmscore, "FREQUENT", frequent)
    monkeypatch.setattr(lmscore, "FREQUENT_GRAMS", frequent)
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").collect()] + [(100, None), (101, "Zebra zebra ZEBRA"), (102, ""), (103, "an-extremely-long-word-" * 9), (104, "é" * 9)]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    want = ppm(docs, held)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n long, key string")
    got = lmscore.score(df, remainder_of_crc32(F.col("doc_id"), 7) == 2).collect()
    assert len(got) == len(docs)
    for x in got:
        w = want[x["doc_id"]]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[x["doc_id"]], *w[:3])
        assert math.isclose(x["base_score"], w[3], rel_tol=1e-9) and math.isclose(x["score"], w[4], rel_tol=1e-9)


def test_grams_in_pieces(monkeypatch):
    """Texts longer than a piece, and many short ones, give each gram of each text once."""
    r = random.Random(1)
    texts = [lmscore.coded("".join(r.choice("ab \né") for _ in range(n))) for n in (0, 1, 3, 50, 400, 1000)]
    want = Counter((i, int.from_bytes(t[k : k + 5], "big")) for i, t in enumerate(texts) for k in range(len(t) - 4))
    for piece in (1, 7, 64, 1 << 19):
        monkeypatch.setattr(lmscore, "PIECE", piece)
        got = Counter((int(i), int(g)) for grams, of in lmscore.grams_of(iter(enumerate(texts))) for g, i in zip(grams, of, strict=True))
        assert got == want


def test_ppm_odd_tables(spark, odd, no_rows):
    got = lmscore.score(odd, F.lit(False)).where("doc_id = 5").collect()  # rows that repeat each other are scored each by itself
    assert lmscore.score(odd, F.lit(False)).count() == 16 and len(got) == 3 and len({tuple(r) for r in got}) == 1 and got[0]["n_tokens"] == 49
    two = spark.createDataFrame([(1, "a b"), (1, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in lmscore.score(two, F.lit(False)).collect()) == [2, 2, 2, 3]
    assert lmscore.score(odd.limit(3), F.lit(True)).agg({"train_tokens": "max"}).first()[0] == 0
    assert lmscore.score(no_rows, F.lit(False)).count() == 0


def test_ppm_runs_through_whole_texts(spark):
    """op10 against a trie over whole texts, walked symbol by symbol: contexts see the words before, so order counts."""
    texts = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    coded = {i: b"\n" * 4 + b" ".join(re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()) + b"\n" for i, t in texts.items()}
    trie = {}
    for i, s in coded.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for at in range(4, len(s)):
                for k in range(5):
                    trie.setdefault(s[at - k : at], Counter())[s[at]] += 1

    def code(s):
        total = 0.0
        for at in range(4, len(s)):
            gone = set()
            for k in range(4, -1, -1):
                seen = {x: n for x, n in trie.get(s[at - k : at], {}).items() if x not in gone}
                if not seen:
                    continue
                total += math.log10(seen.get(s[at], len(seen)) / (sum(seen.values()) + len(seen)))
                if s[at] in seen:
                    break
                gone |= seen.keys()
            else:
                total -= math.log10(256 - len(gone))
        return total

    got = {x["doc_id"]: x["score"] for x in queries.op10_lmscore(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts)[:30]:
        assert math.isclose(got[i], code(coded[i]), rel_tol=1e-9)
    docs = spark.createDataFrame([(i, "the cat sat on the mat") for i in range(5)] + [(9, "the cat sat on the mat"), (10, "mat the on sat the cat")], "doc_id long, text string")
    a, b = (r["score"] for r in lmscore.score(docs, F.col("doc_id") > 8).where("held_out").orderBy("doc_id").collect())
    assert a > b
