"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document's terms are its words, weighted by how often they occur. For each of SAMPLES numbers a term draws r and c from Gamma(2, 1)
and b from [0, 1), all fixed by the term and the number: with k = floor(ln w / r + b) and ln y = r (k - b), the term with the least
ln c - ln y - r is sampled, as (term, k). Two documents share a sample with the probability of their generalised Jaccard
similarity (sum of the lesser weights over sum of the greater). Gamma values come from their inverse distribution over the root of a uniform number, where
it is nearly linear, by interpolation between fixed points.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SAMPLES, AT_ONCE = 32, 4
POINTS = 256
#: Documents that lie together in one bucket of consecutive ones, the most buckets, and rows sampled for each bucket to tell where it ends.
BUCKET_ROWS, MOST_BUCKETS, SAMPLED = 512, 1 << 16, 16
NOTHING = -1


def gamma_at(u: float) -> float:
    """x with 1 - (1 + x) exp(-x) = u, by bisection."""
    low, high = 0.0, 60.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - (1 + mid) * math.exp(-mid) < u else (low, mid)
    return low


def gamma_points() -> list[float]:
    return [max(1e-3, gamma_at(min(i / POINTS, 1 - 2**-12) ** 2)) for i in range(POINTS + 1)]


def marked_terms(text: Column, edited: Column) -> Column:
    """Sorted hashes of all words of both texts; the last bit tells the text."""

    def marked(t: Column, bit: int) -> Column:
        words = F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
        return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(bit)))

    return F.sort_array(F.concat(marked(text, 0), marked(edited, 1)))


#: What a row carries beside its terms: numbers only, so that aggregation stays in hash tables of fixed width.
CARRIED = ["c0", "c1", "c2", "c3", "c4", "c5", "c6"]


def counted_terms(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, n, m and CARRIED of docs (keys, text, edited, CARRIED: longs): the hash of every word of either text and its counts in both; and for each row one more without a term or counts, which alone has what the row carries."""
    d = docs.select(*keys, F.struct(*CARRIED).alias("carried"), marked_terms(F.col("text"), F.col("edited")).alias("hs"))
    new = F.filter(F.when(F.size("hs") > 0, F.sequence(F.lit(0), F.size("hs") - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get("hs", i) != F.get("hs", i - 1)))
    d = d.withColumn("starts", new)
    d = d.select(*keys, "carried", F.transform("starts", lambda p, i: F.struct(F.get("hs", p).alias("h"), (F.coalesce(F.get("starts", i + 1), F.size("hs")) - p).alias("c"))).alias("runs"))
    none = F.lit(None).cast(d.schema["carried"].dataType)

    def both(x: Column, i: Column) -> Column:
        term, edited = x["h"].bitwiseAND(F.lit(-2)), x["h"].bitwiseAND(F.lit(1)) == 1
        after, before = F.get("runs", i + 1), F.get("runs", i - 1)
        m = F.when(edited, x["c"]).when(after["h"] == x["h"] + 1, after["c"]).otherwise(0)
        return F.struct(term.alias("term"), F.when(edited, 0).otherwise(x["c"]).alias("n"), m.alias("m"), (edited & F.coalesce(before["h"] == term, F.lit(False))).alias("again"), none.alias("carried"))

    row = F.struct(F.lit(None).cast("long").alias("term"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("int").alias("m"), F.lit(False).alias("again"), F.col("carried"))
    d = d.select(*keys, F.explode(F.concat(F.array(row), F.filter(F.transform("runs", both), lambda x: ~x["again"]))).alias("t"))
    return d.select(*keys, "t.term", "t.n", "t.m", "t.carried.*")


def sample(term: Column, weight: Column, j: Column, points: Column) -> Column:
    """The term's value and identity for number j, as one long to take the least of (upper bits: ln a; lower 32 bits: term and k)."""
    h = F.xxhash64(term, j)

    def uniform(shift: int, bits: int) -> Column:
        return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) / float(1 << bits)

    def gamma(u: Column) -> Column:
        s = F.sqrt(u) * POINTS
        i = s.cast("int")
        low = F.get(points, i)
        return low + (s - i) * (F.get(points, i + 1) - low)

    r, c, b = gamma(uniform(0, 16)), gamma(uniform(16, 24)), uniform(40, 24)
    k = F.floor(F.log(weight) / r + b)
    ln_a = F.log(c) - r * (k - b) - r
    identity = F.shiftrightunsigned(term, 1).bitwiseXOR(k * 2654435761).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(((ln_a + 256) * float(1 << 21)).cast("long"), 32).bitwiseOR(identity)


def sampled(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, one and two (fingerprints of text and edited: arrays of SAMPLES identities) and CARRIED of docs (keys, text, edited, CARRIED).

    Rows of one document stay where they are if docs is dealt out by some of the keys, so nothing is shuffled."""
    points = F.from_json(F.lit(str(gamma_points())), "array<double>")
    terms = counted_terms(docs, keys).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // AT_ONCE - 1))))
    least = [F.min(sample(F.col("term"), F.col(w), F.col("g") * AT_ONCE + i, points)).alias(f"{w}{i}") for i in range(AT_ONCE) for w in "nm"]
    parts = terms.groupBy(*keys, "g").agg(*least, *[F.max(c).alias(c) for c in CARRIED])

    def identities(w: str) -> Column:
        every = F.struct("g", F.array(*[F.coalesce(F.col(f"{w}{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(NOTHING)) for i in range(AT_ONCE)]).alias("x"))
        return F.flatten(F.transform(F.array_sort(F.collect_list(every)), lambda p: p["x"]))

    return parts.groupBy(*keys).agg(identities("n").alias("one"), identities("m").alias("two"), *[F.max(c).alias(c) for c in CARRIED])


def likeness(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.lit(float(SAMPLES))


def written(ids: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits for every sample (of no word: all f)."""
    return F.array_join(F.transform(ids, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def bounds(docs: DataFrame) -> list:
    """Rows (id, h, u) that cut the rows of docs (id, h, u), by id (null least), then h, then u, into about equal parts: quantiles of a sample of a bounded number of rows; fewer than MOST_BUCKETS. As u tells rows apart that repeat
    each other, they are drawn, and cut, one by one."""
    n = docs.count()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    drawn = docs.where(F.pmod(F.xxhash64("u", "h", "id"), F.lit(max(1, n // (buckets * SAMPLED)))) == 0) if n else docs
    place = drawn.withColumn("place", F.row_number().over(Window.orderBy("id", "h", "u")))  # 2 * MOST_BUCKETS * SAMPLED rows of three longs
    return place.where(F.col("place") % SAMPLED == 0).orderBy("place").select("id", "h", "u").collect()[: buckets - 1]


def bucket_of(key: Column, ends: list) -> Column:
    """How many of the sorted ends are less than key (a struct id, h, u): a binary search."""
    if not ends:
        return F.lit(0).cast("long")
    table = F.from_json(F.lit(json.dumps([{"id": e["id"], "h": e["h"], "u": e["u"]} for e in ends])), "array<struct<id:bigint,h:bigint,u:bigint>>")

    def halve(at: Column, step: Column) -> Column:
        return F.when(F.get(table, at + step - 1) < key, at + step).otherwise(at)

    steps = [1 << i for i in reversed(range(len(ends).bit_length()))]
    return F.aggregate(F.array(*[F.lit(i) for i in steps]), F.lit(0), halve).cast("long")


def dealt(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with at (id, h: a hash of the text, u: a number that tells rows apart) and bucket: consecutive buckets of about BUCKET_ROWS rows, whatever ids and texts repeat."""
    u = F.xxhash64(F.monotonically_increasing_id())
    docs = docs.select("doc_id", "text", F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), u.alias("u")).alias("at"))
    return docs.withColumn("bucket", bucket_of(F.col("at"), bounds(docs.select("at.*"))))


def next_to(docs: DataFrame) -> DataFrame:
    """bucket, place, doc_id, text, following (the next row's text) and borrowed of docs (doc_id, text), by descending doc_id, the last followed by the first.

    Rows are cut into buckets of consecutive ones, at quantiles, so clumps of ids, rows of one id (told apart by a hash of their text) or rows that repeat each other (in any order, as each has the same neighbours) don't fill
    a bucket. Each bucket borrows the text that follows its last row from the next bucket, so that only buckets are dealt out and sorted, once. Rows of one id go by that hash; null ids come last."""
    docs = dealt(docs)
    heads = docs.groupBy("bucket").agg(F.max("at").alias("head"))
    order = Window.orderBy(F.col("bucket").desc())
    last = Window.orderBy("bucket")
    lender = F.coalesce(F.lead("head").over(order), F.last("head").over(last.rowsBetween(0, Window.unboundedFollowing)))
    heads = saved(heads.select("bucket", lender.alias("l")).select("bucket", F.col("l.id").alias("id"), F.col("l.h").alias("h")))  # MOST_BUCKETS rows at most
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    texts = docs.select("at.id", "at.h", "text").alias("d").join(F.broadcast(heads.select("id", "h").distinct()).alias("l"), same("d", "l"), "left_semi").groupBy("id", "h").agg(F.min("text").alias("text"))
    borrowed = heads.alias("l").join(texts.alias("t"), same("l", "t")).select("bucket", "t.id", "t.h", "text")
    none, known = F.lit(None).cast(docs.schema["doc_id"].dataType), F.coalesce("bucket", F.lit(-1).cast("long")).alias("bucket")
    lent = borrowed.select(none.alias("doc_id"), "text", F.struct("id", "h", F.lit(0).cast("long").alias("u")).alias("at"), known, F.lit(True).alias("borrowed"))
    both = docs.withColumn("borrowed", F.lit(False)).unionByName(lent)
    w = Window.partitionBy("bucket").orderBy("borrowed", F.col("at").desc())
    return both.select("bucket", F.row_number().over(w).alias("place"), "doc_id", "text", F.lead("text").over(w).alias("following"), "borrowed")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of docs (doc_id, text; other columns are ignored).

    A null text is empty. The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document in descending
    doc_id (after the last: the first; a sole row: itself). near_edited and near_next are the shares of equal samples with the edited text's and the next
    document's fingerprint. Equal texts have equal fingerprints; texts without words have one of their own and are alike to each other only.
    Rows that repeat an id go by a hash of their text; null ids come last. An empty table gives an empty result."""
    d = next_to(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("following", F.lit("")), F.lit(1), cut))
    keys = ["bucket", "place"]
    digest = F.sha2(edited, 256)
    quarters = [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long") for i in range(4)]  # a digest as four numbers
    carried = [F.col("doc_id").cast("long"), F.col("borrowed").cast("long"), n.cast("long"), *quarters]
    d = d.select(*keys, "text", edited.alias("edited"), *[x.alias(c) for c, x in zip(CARRIED, carried, strict=True)])
    rows = sampled(d, keys).withColumn("next", F.lead("one").over(Window.partitionBy("bucket").orderBy("place")))
    rows = rows.withColumns({"doc_id": F.col("c0").cast(docs.schema["doc_id"].dataType), "borrowed": F.col("c1") == 1, "n_chars": F.col("c2")})
    rows = rows.withColumn("edited_sha256", F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in CARRIED[3:]]))
    return rows.where(~F.col("borrowed")).select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("one")).alias("fingerprint"), written(F.col("two")).alias("edited_fingerprint"),
        likeness(F.col("one"), F.col("two")).alias("near_edited"), likeness(F.col("one"), F.col("next")).alias("near_next"),
    )
