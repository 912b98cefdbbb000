"""Language-model scoring by prediction by partial matching (PPM).

The model is a trie of byte contexts of up to ORDER bytes, counted over all training texts; contexts run through the whole text, whose words are
joined by one blank. A byte is coded in its longest context that training has seen; a byte that has not followed there is reached by an escape (method C) to
the next shorter context, without the bytes that the longer ones have offered (symbol exclusion), at last to a uniform choice. A text's code length is the sum over its
bytes and its end, by its distinct grams (a context of ORDER bytes and the byte after it). The trie is never in one place: it is a table of counted grams, and those of
each shorter order; all probabilities are sums over them, grouped and joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, saved, sliced

ORDER = 4
#: The byte that ends a text, and stands for what is before its first byte; no text holds it once its words are joined.
GAP = b"\n"
#: A word that stands for the end of a text. No word is empty.
END = b""
#: Words and grams that all tasks look up by themselves, and distinct words and grams that a task counts before it passes them on.
FREQUENT, FREQUENT_GRAMS, KEPT, KEPT_GRAMS = 1 << 16, 1 << 20, 300_000, 1 << 18
#: Bytes of texts whose grams are in memory at once; longer texts come in pieces.
PIECE = 1 << 19

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # at ASCII white space


def names_of(text: str | None) -> list[bytes]:
    """The items that stand for a text's tokens: its words, the end, and for a word of 16 bytes or more its 128-bit hash."""
    return [*(w if len(w) < 16 else xxhash.xxh3_128_digest(w) for w in words_of(text)), END]


def coded(text: str | None) -> bytes:
    """What is scored of a text: its words, joined by one blank, with gaps before and after."""
    return GAP * ORDER + b" ".join(words_of(text)) + GAP


def grams_of(texts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams (ORDER + 1 bytes as one number) of coded texts and the number that came with each gram's text, some pieces of texts at a time. No piece loses a gram at its ends."""

    def of(pieces: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        b = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
        g = np.zeros(len(b) - ORDER, np.int64)
        for k in range(ORDER + 1):
            g <<= 8
            g |= b[k : len(b) - ORDER + k]
        sizes = np.array([len(p) for _, p in pieces])
        across = (np.cumsum(sizes)[:-1, None] - 1 - np.arange(ORDER)).ravel()  # grams that begin in one piece and end in the next
        inside = np.ones(len(g), bool)
        inside[across] = False
        return g[inside], np.repeat([i for i, _ in pieces], sizes - ORDER)

    pieces, size = [], 0
    for i, text in texts:
        for at in range(0, len(text) - ORDER, PIECE):
            pieces.append((i, text[at : at + PIECE + ORDER]))
            size += len(pieces[-1][1])
            if size >= PIECE:
                yield of(pieces)
                pieces, size = [], 0
    if pieces:
        yield of(pieces)


def counted(docs: DataFrame, items: Callable[[str | None], list[bytes]]) -> DataFrame:
    """item (binary) and c (how often it occurs in training texts, 0 if not at all) of all items of docs (held_out, text); tasks pass on sums, in bounded numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], names=["item", "c"])
            total.clear()
            return out

        for batch in sliced(batches):
            for t, out in zip(batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
                found = items(t.as_py())
                if out:
                    for x in {*found}:
                        total[x] += 0
                else:
                    total.update(found)
            if len(total) > KEPT:
                yield flush()
        yield flush()

    return docs.select("held_out", "text").mapInArrow(run, "item binary, c long").groupBy("item").agg(F.sum("c").alias("c"))


def counted_grams(docs: DataFrame) -> DataFrame:
    """item (a gram) and c (how often it occurs in training texts, 0 if not at all) of all grams of docs (held_out, text); tasks pass on sums, in bounded numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, counts, size = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate([*items, np.zeros(0, np.int64)]), return_inverse=True)
            return every, np.bincount(at, np.concatenate([*counts, np.zeros(0)]), len(every))

        def out(every: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(every), pa.array(c.astype(np.int64))], names=["item", "c"])

        for batch in sliced(batches):
            held = batch.column("held_out").to_pylist()
            for grams, of in grams_of((int(not h), coded(t.as_py())) for h, t in zip(held, batch.column("text"), strict=True)):
                for trained in (0, 1):
                    g, c = np.unique(grams[of == trained], return_counts=True)
                    items.append(g)
                    counts.append(c * float(trained))
                    size += len(g)
            if size > 2 * KEPT_GRAMS:
                every, c = merged()
                items, counts, size = [every], [c], len(every)
                if size > KEPT_GRAMS:
                    yield out(every, c)
                    items, counts, size = [], [], 0
        yield out(*merged())

    return docs.select("held_out", "text").mapInArrow(run, "item long, c long").groupBy("item").agg(F.sum("c").alias("c"))


def most_counted(values: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows of values with the greatest counts: all from a count on that limit (else FREQUENT) of them reach at most (by a histogram of sixteenths of powers of two, so no task or driver sorts them)."""
    size = F.floor(F.log2("c") * 16)
    known = values.where("c > 0")
    least, n = None, 0
    for r in sorted(known.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["size"]):  # 1,008 rows at most
        n += r["n"]
        if n > (limit or FREQUENT):
            break
        least = r["size"]
    return known.where(size >= least) if least is not None else known.limit(0)


def looked_up(docs: DataFrame, items: Callable[[str | None], list[bytes]], values: DataFrame) -> DataFrame:
    """Sums over the items of each row of docs (key, doc_id, held_out, text) of what values (item, c, lp: every item that occurs) has for them: key, doc_id, held_out, copies (rows of that key), n (items), known (those with c > 0) and lp, all for one copy.

    The most counted items (FREQUENT at most) are looked up in the task itself, and the row carries their sums; all others meet their numbers in a join. So a hot
    item isn't shuffled, and what is sent to all tasks has a fixed bound."""
    most = most_counted(values).select("item", "lp").collect()
    shared = docs.sparkSession.sparkContext.broadcast({bytes(r["item"]): r["lp"] for r in most})
    own = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in sliced(batches, 256):
            at, names, counts, parts = [], [], [], []
            for i, t in enumerate(batch.column("text")):
                n = known = 0
                lp = 0.0
                for x, m in Counter(items(t.as_py())).items():
                    n += m
                    if (v := table.get(x)) is None:
                        at.append(i)
                        names.append(x)
                        counts.append(m)
                        parts.append(None)
                    else:
                        known += m
                        lp += m * v
                at.append(i)
                names.append(b"%d" % i)
                counts.append(0)
                parts.append({"n": n, "known": known, "lp": lp})
            take = pa.array(at, pa.int64())
            first = pa.array([p is None for p in parts], pa.bool_())
            part = pa.array(parts, pa.struct([("n", pa.int64()), ("known", pa.int64()), ("lp", pa.float64())]))
            ids = [pa.compute.if_else(first, pa.scalar(None, batch.schema.field(c).type), batch.column(c).take(take)) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(take), *ids, pa.array(names, pa.binary()), first, pa.array(counts, pa.int64()), part], names=["key", "doc_id", "held_out", "item", "rare", "m", "part"])

    found = docs.mapInArrow(run, f"key binary, doc_id {own}, held_out boolean, item binary, rare boolean, m long, part struct<n: long, known: long, lp: double>")
    joined = found.join(values.select("item", F.lit(True).alias("rare"), "c", "lp"), ["item", "rare"], "left")
    known, lp = F.when(F.col("c") > 0, F.col("m")).otherwise(0), F.col("m") * F.col("lp")
    sums = {"n": F.sum("part.n"), "known": F.sum(F.coalesce("part.known", known)), "lp": F.sum(F.coalesce("part.lp", lp))}
    sums = joined.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.count("part").alias("copies"), *[s.alias(c) for c, s in sums.items()])
    return sums.withColumns({c: F.expr(f"{c} div copies") for c in ("n", "known")} | {"lp": F.col("lp") / F.col("copies")})


def suffixes(counts: DataFrame, order: int) -> DataFrame:
    """item (a symbol and the bytes before it, order of them) and n: how often it occurs, of counts (item, n) of longer ones."""
    return counts.groupBy(F.col("item").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("item")).agg(F.sum("n").alias("n"))


def contexts(counts: DataFrame, shorter: DataFrame, order: int) -> DataFrame:
    """context (as many bytes as order says), t (all that follows it), d (the distinct symbols that do) and a (how often these follow the context without its first byte) of counts (item, n) and those of the next shorter order."""
    of = F.col("item").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("shorter")
    joined = counts.select("item", "n", of).join(shorter.select(F.col("item").alias("shorter"), F.col("n").alias("m")), "shorter")
    return joined.groupBy(F.shiftright("item", 8).alias("context")).agg(F.sum("n").alias("t"), F.count("*").alias("d"), F.sum("m").alias("a"))


def tried(n: Column, mass: Column, distinct: Column, otherwise: Column) -> Column:
    """log10 of a symbol's probability in a context of so much mass and so many distinct symbols, excluded ones left out, where it has n; else that of an escape (if any symbol is left), and what comes then."""
    escape = F.when(distinct > 0, F.log10(distinct / (mass + distinct))).otherwise(0.0)
    return F.when(n > 0, F.log10(n / (mass + distinct))).otherwise(escape + otherwise)


def gram_scores(counts: DataFrame) -> DataFrame:
    """item, c and lp (log10 of its last byte's probability after the bytes before) of counted grams (item, c; c 0: not in training).

    As a context's symbols all follow its shorter ones too, what symbol exclusion leaves of an order is a difference of sums: of the mass, what the longer context's symbols have there, of the distinct symbols, their number. Grams are dealt out by
    the three bytes before the last one, so at most 65,536 lie together; those that order 3 doesn't know (few) meet the tables of order 2, and all the lower ones (65,536 rows at most) go to all tasks."""
    trained = counts.where("c > 0").select("item", F.col("c").alias("n"))
    order = {3: saved(suffixes(trained, 3))}
    order[2] = saved(suffixes(order[3], 2))
    order[1] = saved(suffixes(order[2], 1))
    order[0] = suffixes(order[1], 0)
    zero = order[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    t0, d0 = (F.lit(x).cast("long") for x in zero)
    three, symbol, longest = F.shiftright("item", 8).bitwiseAND(F.lit(0xFFFFFF)), F.col("item").bitwiseAND(F.lit(0xFF)), F.shiftright("item", 8)
    after = lambda k: contexts(order[k], order[k - 1], k).select(F.col("context").alias(f"x{k}"), *[F.col(c).alias(f"{c}{k}") for c in "tda"])
    rows = counts.select("item", "c", three.alias("x3"), symbol.alias("symbol"), longest.alias("x4")).repartition("x3").join(after(3), "x3", "left")
    same, in_context = Window.partitionBy("x3", "symbol"), Window.partitionBy("x3", "x4")
    rows = rows.withColumn("n3", F.sum("c").over(same)).withColumns({
        "t4": F.sum("c").over(in_context), "d4": F.count_if(F.col("c") > 0).over(in_context), "a4": F.sum(F.when(F.col("c") > 0, F.col("n3")).otherwise(0)).over(in_context),
    })
    of = {c: F.coalesce(c, F.lit(0)) for c in ("t3", "d3", "a3")}
    rows = saved(rows.select("item", "c", "n3", "t4", "d4", "a4", *[x.alias(c) for c, x in of.items()], ((F.col("c") == 0) & (F.col("n3") == 0)).alias("unknown")))
    to_three = lambda then: tried(F.col("c"), F.col("t4"), F.col("d4"), tried(F.col("n3"), F.col("t3") - F.col("a4"), F.col("d3") - F.col("d4"), then))
    known = rows.where("NOT unknown").select("item", "c", to_three(F.lit(0.0)).alias("lp"))
    rest = rows.where("unknown").withColumns({"x2": F.shiftright("item", 8).bitwiseAND(F.lit(0xFFFF)), "x1": F.shiftright("item", 8).bitwiseAND(F.lit(0xFF))})
    for k in (2, 1, 0):
        n = order[k].select(F.col("item").alias(f"i{k}"), F.col("n").alias(f"n{k}"))
        rest = rest.withColumn(f"i{k}", F.col("item").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))).join(n if k == 2 else F.broadcast(n), f"i{k}", "left")
        if k:
            rest = rest.join(after(k) if k == 2 else F.broadcast(after(k)), f"x{k}", "left")
    v = {c: F.coalesce(c, F.lit(0)) for c in ("n2", "t2", "d2", "a2", "n1", "t1", "d1", "a1", "n0")}
    last = -F.log10(F.greatest(F.lit(1), 256 - d0).cast("double"))
    zeroth = tried(v["n0"], t0 - v["a1"], d0 - v["d1"], last)
    first = tried(v["n1"], v["t1"] - v["a2"], v["d1"] - v["d2"], zeroth)
    second = tried(v["n2"], v["t2"] - F.col("a3"), v["d2"] - F.col("d3"), first)
    return known.unionByName(rest.select("item", "c", to_three(second).alias("lp")))


def gram_sums(docs: DataFrame, values: DataFrame) -> DataFrame:
    """key and lp: the sum over all grams of each row of docs (key, text), rows of one key added up, of what values (item, c, lp: every gram that occurs) has for them.

    The most counted grams (FREQUENT_GRAMS at most) are looked up in the task itself, and the row carries their sum; all others meet their numbers in a join."""
    most = most_counted(values, FREQUENT_GRAMS).select("item", "lp").toArrow()
    item, lp = (np.asarray(most.column(c)) for c in ("item", "lp"))
    order = np.argsort(item)
    shared = docs.sparkSession.sparkContext.broadcast((item[order], lp[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lp = shared.value
        for batch in sliced(batches, 256):
            n = batch.num_rows
            sums = np.zeros(n)
            rare = [np.zeros(0, np.int64)]
            for grams, of in grams_of((i, coded(t.as_py())) for i, t in enumerate(batch.column("text"))):
                every, at = np.unique(grams, return_inverse=True)
                place = np.minimum(np.searchsorted(known, every), max(0, len(known) - 1))
                hit = known[place] == every if len(known) else np.zeros(len(every), bool)
                own = np.where(hit, lp[place], 0.0) if len(known) else np.zeros(len(every))
                sums += np.bincount(of, own[at], n)
                missed = ~hit[at]
                rare.append(of[missed] << 40 | grams[missed])  # a row's place in the batch and a gram of 40 bits
            pairs, m = np.unique(np.concatenate(rare), return_counts=True)
            take = pa.array(np.concatenate([pairs >> 40, np.arange(n)]))
            items = np.concatenate([pairs & ((1 << 40) - 1), -1 - np.arange(n)])  # no gram is negative
            columns = [batch.column("key").take(take), pa.array(items), pa.array(np.concatenate([m, np.zeros(n, np.int64)])), pa.array(np.concatenate([np.zeros(len(pairs)), sums]))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "item", "m", "sum"])

    found = docs.select("key", "text").mapInArrow(run, "key binary, item long, m long, sum double")
    j = found.join(values.select("item", "lp"), "item", "left")
    return j.groupBy("key").agg(F.sum(F.col("sum") + F.coalesce(F.col("m") * F.col("lp"), F.lit(0.0))).alias("lp"))


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text; other columns are ignored).

    Words are lower-cased in A-Z and cut at ASCII white space; a text's tokens are its words and one end. Training texts are those where held_out is
    false (null: false). A null text is empty. base_score: sum over tokens of log10((c + 1) / (N + 1 * (V + 1))), with c the token's count, N all and V
    the distinct tokens in training. score: the PPM's log10 probability of the text as one string of bytes (words joined by one blank, then the end). Rows that repeat a doc_id
    are scored each by itself, and a row for each is returned. With no training text, bytes are as likely as each other. An empty table gives an empty result."""
    docs = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    docs = docs.withColumn("key", row_key(docs))
    words = saved(counted(docs, names_of))
    n, v = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    base = looked_up(docs, names_of, words.withColumn("lp", F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))))
    grams = gram_sums(docs, saved(gram_scores(saved(counted_grams(docs))))).withColumnRenamed("lp", "coded")
    return base.join(grams, "key").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        F.col("lp").alias("base_score"), (F.col("coded") / F.col("copies")).alias("score"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
