"""Exact top-k search over a bit-sliced index.

Vectors are quantised to integers and kept in blocks of rows. A block's index has one bitmap over its rows for each bit of each
component (a slice), less the component's minimum in the block. A query's inner products with all rows of a block are added up from slices
with bitmap arithmetic: bits of the query's component choose which slices are added with which weight, and slices of
components that the query weighs negatively are complemented, so that all sums are of unsigned numbers. The top rows are
then selected from the most significant slice of the sums downward; among rows that tie at the boundary those with the smallest ids
are taken. Queries come in packs, and each pack is sent to each block: blocks and packs have bounded sizes at any scale. Rows with very large components
have blocks of their own, whose slices and sums are as wide as need be.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Rows of a block, rows of a block with wide components, and queries of a pack.
BLOCK_ROWS, WIDE_ROWS, PACK_QUERIES = 16384, 512, 256
#: Components of so many units (once quantised) or more are wide: their sums may need more than 64 bits.
WIDE = 1 << 24

INDEX_SCHEMA = "block long, n_rows long, dims long, ids binary, lows array<string>, slices binary, n_slices long"


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise sums of bit-sliced numbers: (m, bits, words) and the same give (m, bits + 1, words)."""
    out = np.empty((a.shape[0], a.shape[1] + 1, a.shape[2]), np.uint64)
    carry = None
    for i in range(a.shape[1]):
        x, y = a[:, i], b[:, i]
        half = x ^ y
        if carry is None:
            out[:, i], carry = half, x & y
        else:
            np.bitwise_xor(half, carry, out=out[:, i])
            half &= carry
            carry = (x & y) | half
    out[:, -1] = 0 if carry is None else carry
    return out


def total(numbers: np.ndarray) -> np.ndarray:
    """Bit-sliced sum (bits, words) of bit-sliced numbers (m, bits, words), in a tree."""
    while len(numbers) > 1:
        if len(numbers) % 2:
            numbers = np.concatenate([numbers, np.zeros_like(numbers[:1])])
        numbers = add(numbers[0::2], numbers[1::2])
    return numbers[0]


def scores(query: np.ndarray, slices: np.ndarray, flipped: np.ndarray) -> np.ndarray:
    """Bit-sliced sums of |q| times a component (complemented where q is negative), for all rows of a block: (bits, words)."""
    weight = np.abs(query)
    planes = int(weight.max(initial=0)).bit_length()
    sums = []
    for j in range(planes):
        chosen = (weight >> j) & 1 == 1
        parts = [x for x in (slices[chosen & (query > 0)], flipped[chosen & (query < 0)]) if len(x)]
        sums.append((j, total(np.concatenate(parts))) if parts else None)
    width = max((j + len(s) for j, s in filter(None, sums)), default=0) + planes
    out = np.zeros((1, max(1, width), slices.shape[2]), np.uint64)
    for j, s in filter(None, sums):
        shifted = np.zeros_like(out)
        shifted[0, j : j + len(s)] = s
        out = add(out, shifted)[:, :-1]
    return out[0]


def highest(sums: np.ndarray, take_part: np.ndarray, k: int) -> np.ndarray:
    """Places of the k rows with the highest sums (ties: first places), from the most significant slice downward."""
    sure, open_ = np.zeros_like(take_part), take_part
    for s in sums[::-1]:
        hit = open_ & s
        n = int(np.bitwise_count(sure | hit).sum())
        if n > k:
            open_ = hit
        else:
            sure = sure | hit
            open_ = open_ & ~s
            if n == k:
                break
    n = int(np.bitwise_count(sure).sum())
    places = lambda bits: np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
    return np.concatenate([places(sure), places(open_)[: k - n]])


def value(sums: np.ndarray, places: np.ndarray) -> list[int]:
    bits = (sums[:, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
    if len(sums) < 63:
        return (bits.astype(np.int64) << np.arange(len(sums), dtype=np.int64)[:, None]).sum(axis=0).tolist()
    return [sum(1 << i for i in np.flatnonzero(b).tolist()) for b in bits.T]


def units(vector: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component: of 64 bits, or Python integers where a component is wide."""
    x = np.floor(256 * np.asarray(vector, np.float64))
    if (np.abs(x) < WIDE).all():
        return x.astype(np.int64)
    exact = [math.floor(256 * Fraction(float(v))) for v in vector]  # 256 * x itself may be beyond doubles
    return np.array(exact, object)


def product(q: np.ndarray, x: np.ndarray) -> int:
    return sum(a * b for a, b in zip(q.tolist(), x.tolist(), strict=True))


def as_long(score: int) -> tuple[int, str]:
    """The nearest long, and for scores beyond its range a text that orders them."""
    if -(1 << 63) < score < (1 << 63) - 1:
        return score, ""
    digits = f"{len(str(abs(score))):05d}{abs(score)}"
    if score > 0:
        return (1 << 63) - 1, digits
    return -(1 << 63), "".join(str(9 - int(d)) for d in digits)


def index_block(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of INDEX_SCHEMA for the different rows (block, vec_id, embedding) of a block. Shorter vectors end in zeros; what gives equal units counts once."""
    vectors = [units(v) for v in rows["embedding"]]
    dims = max(map(len, vectors))
    x = np.zeros((len(vectors), dims), object if any(v.dtype == object for v in vectors) else np.int64)
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    order = np.argsort(rows["vec_id"].to_numpy(np.int64), kind="stable")
    ids, x = rows["vec_id"].to_numpy(np.int64)[order], x[order]
    lows = x.min(axis=0) if dims else np.zeros(0, np.int64)
    x = x - lows
    n_slices = int(x.max(initial=0)).bit_length()
    words = -(-len(ids) // 64)
    slices = np.zeros((dims, n_slices, words * 8), np.uint8)
    for b in range(n_slices):
        packed = np.packbits(((x >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
        slices[:, b, : packed.shape[1]] = packed
    one = {"block": rows["block"].iloc[0], "n_rows": len(ids), "dims": dims, "ids": ids.tobytes(), "lows": [*map(str, lows.tolist())], "slices": slices.tobytes(), "n_slices": n_slices}
    return pd.DataFrame([one])


def search_block(index: pd.Series, query_ids: np.ndarray, queries: list[np.ndarray], k: int) -> Iterator[tuple[int, int, int, str]]:
    """(query id, vec_id, score, beyond: see as_long) of the k best ids of a block for every query; the query's own id takes no part."""
    n, dims, n_slices = (int(index[c]) for c in ("n_rows", "dims", "n_slices"))
    words = -(-n // 64)
    ids, lows = np.frombuffer(index["ids"], np.int64), np.array([*map(int, index["lows"])], object)
    slices = np.frombuffer(index["slices"], np.uint64).reshape(dims, n_slices, words)
    flipped = ~slices
    real = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)
    repeated = len(np.unique(ids)) < len(ids)
    for query_id, q in zip(query_ids, queries, strict=True):
        q = np.concatenate([q, np.zeros(max(0, dims - len(q)), q.dtype)])[:dims]
        sums = scores(q, slices, flipped)
        base = product(q, lows) + int(q[q < 0].sum()) * ((1 << n_slices) - 1)
        mine = np.flatnonzero(ids == query_id)
        part = real.copy()
        for i in mine:
            part[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        want = k
        while True:
            places = highest(sums, part, want)
            if not repeated or len(np.unique(ids[places])) >= k or len(places) < want:
                break
            want *= 2
        for i, s in zip(ids[places].tolist(), value(sums, places), strict=True):
            yield int(query_id), i, *as_long(s + base)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5) -> DataFrame:
    """The k rows of vectors with the highest integer inner products for every query: query_id, rank, vec_id, score.

    Both have vec_id and embedding (array of float; other columns are ignored). A component x counts as floor(256 * x). Vectors null or holding null or
    non-finite components take no part, nor do rows without an id; an empty vector scores 0; vectors of other lengths count as if
    padded with zeros. Components of any finite size count in full; a score beyond the range of long is ranked by its true value and stated as the nearest long.
    Ties go to smaller ids. Rows that repeat an id are one candidate with its best score, and as queries the least vector; no row is a candidate for a query of its own id."""
    spark = vectors.sparkSession
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wide = F.exists("embedding", lambda x: F.abs(x.cast("double")) * 256 >= WIDE - 1)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable).distinct().withColumn("wide", wide)
    n_narrow, n_wide = rows.agg(F.count_if(~F.col("wide")), F.count_if("wide")).first()
    n_blocks, n_wide = max(1, -(-n_narrow // BLOCK_ROWS)), -(-n_wide // WIDE_ROWS)
    at = F.xxhash64("vec_id", "embedding")
    block = F.when(F.col("wide"), -1 - F.pmod(at, F.lit(max(1, n_wide)))).otherwise(F.pmod(at, F.lit(n_blocks)))
    index = saved(rows.select(block.alias("block"), "vec_id", "embedding").groupBy("block").applyInPandas(index_block, INDEX_SCHEMA))

    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable)
    asked = saved(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    n_packs = max(1, -(-asked.count() // PACK_QUERIES))
    packs = asked.withColumn("pack", F.pmod(F.xxhash64("vec_id"), F.lit(n_packs))).groupBy("pack").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("asked"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                found = search_block(row, np.array([a["vec_id"] for a in row["asked"]], np.int64), [units(a["embedding"]) for a in row["asked"]], k)
                yield pd.DataFrame(list(found), columns=["query_id", "vec_id", "score", "beyond"])

    # packs go to blocks; where blocks are fewer than cores, each block has a few copies that share its packs
    copies = min(n_packs, -(-2 * spark.sparkContext.defaultParallelism // (n_blocks + n_wide)))
    blocks = F.sequence(F.lit(-n_wide).cast("long"), F.lit(n_blocks - 1).cast("long"))
    sent = packs.select("asked", F.pmod("pack", F.lit(copies)).alias("copy"), F.explode(blocks).alias("block"))
    met = index.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    met = met.repartition(min((n_blocks + n_wide) * copies, 4096), "block", "copy").join(sent.hint("shuffle_hash"), ["block", "copy"])
    found = met.mapInPandas(search, "query_id long, vec_id long, score long, beyond string")
    of = F.struct("score", "beyond")
    found = found.groupBy("query_id", "vec_id").agg(F.max(of).alias("s"))
    best = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("s.score").alias("score"))
