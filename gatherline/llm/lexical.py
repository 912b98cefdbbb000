"""Ranked lexical search: impact vectors in buckets by length, pruned by their length and their largest coordinates, rescored in whole numbers.

A document's vector holds the impact of each of its terms; an item's holds the terms' weights, so a score is their inner product. Only terms
of the items matter, so vectors are short. They are ordered by length once and read in buckets of that order: an item skips a bucket if Cauchy and
Schwarz's bound on the bucket's longest vector, or the sum of its largest coordinates, is below the k-th score that is known for the item. Inside a bucket only
documents that hold one of the item's focus terms (those without which no document can reach that score) are candidates; what remains of
them after the same two bounds on the other terms is scored exactly in 64-bit whole numbers. Bounds never cut a tie.

Items are taken in blocks of a bounded number of terms, each against all documents; a block's terms, weights and k-th scores are all that is sent to tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import portions, saved

#: A block of items ends when it has as many pairs of item and term (an item with more is a block of its own).
BLOCK_TERMS = 1 << 18
#: Documents and pairs of document and term in a bucket, at most (a document with more is a bucket of its own).
BUCKET_DOCS, BUCKET_PAIRS = 4096, 1 << 20
#: The share of longest vectors from which the first k-th scores come.
SEEDS = 0.02
#: Bounds are sums of doubles: this much is added, so that rounding never cuts a document.
SLACK = 1e-9
#: Term bytes: digits, letters in lower case and all of other code points; anything else is a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, with repeats."""
    return text.translate(TABLE).split() if text else []


@dataclass
class Block:
    """Items (their ids, and for all items one after another the term numbers and repeats) and the numbers of their terms."""

    ids: list
    starts: list[int]
    terms: list[int]
    repeats: list[int]
    numbers: dict[bytes, int]


def blocks(items: DataFrame) -> Iterator[Block]:
    """The items (item_id, text) in blocks. Rows come to the driver one partition after another, and only one block is kept."""
    block = Block([], [0], [], [], {})
    for row in items.select("item_id", F.encode("text", "UTF-8").alias("text")).toLocalIterator():
        found = Counter(terms_of(row["text"]))
        if block.ids and len(block.terms) + len(block.ids) + len(found) > BLOCK_TERMS:
            yield block
            block = Block([], [0], [], [], {})
        for term, n in sorted(found.items()):
            block.terms.append(block.numbers.setdefault(term, len(block.numbers)))
            block.repeats.append(n)
        block.ids.append(row["item_id"])
        block.starts.append(len(block.terms))
    if block.ids:
        yield block


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms, tfs (those of the block that the document holds, and how often) of all documents with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)  # as many terms as a block has at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in portions(batches, "text"):
            n, sizes, terms, tfs = [], [], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                found = Counter(filter(held.__contains__, words))
                n.append(len(words))
                sizes.append(len(found))
                terms += map(held.__getitem__, found)
                tfs += found.values()
            offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select("doc_id", F.encode("text", "UTF-8").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tfs array<int>").where("n > 0")


def by_length(held: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, length, terms, impacts: vectors of the documents that hold a term of the block, longest first. Equal lengths may lie in any partition."""
    m = F.expr(f"75 + (25 * n * {n_docs}L) div {n_terms}L")
    rows = held.where(F.size("terms") > 0).withColumn("m", m)
    rows = rows.withColumn("impacts", F.expr("transform(tfs, tf -> (1000000000L * tf) div (1000L * tf + 12L * m))"))
    rows = rows.withColumn("length", F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v)))
    spread = F.xxhash64("doc_id", F.monotonically_increasing_id())  # many vectors of one length don't go to one task
    rows = rows.select("doc_id", "length", "terms", "impacts", spread.alias("spread"))
    return rows.repartitionByRange(F.desc("length"), "spread").sortWithinPartitions(F.desc("length")).drop("spread")


class Bucket:
    """Some vectors, turned into lists of (document, impact) by term."""

    def __init__(self, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        order = np.argsort(terms, kind="stable")
        self.lengths, self.docs, self.impacts = lengths, np.repeat(np.arange(len(sizes)), sizes)[order], impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.largest = np.zeros(n_terms)
        held = np.flatnonzero(np.diff(self.starts))
        self.largest[held] = np.maximum.reduceat(self.impacts, self.starts[held]) if len(held) else 0

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[term], self.starts[term + 1])
        return self.docs[at], self.impacts[at]


def reaching(bucket: Bucket, terms: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a bucket with a score of least or more, and their scores."""
    bounds = weights * bucket.largest[terms]
    order = np.argsort(-bounds, kind="stable")
    order = order[bounds[order] > 0]
    rest = np.cumsum(bounds[order][::-1])[::-1] * (1 + SLACK)  # from this term on
    focus = int(np.count_nonzero(rest >= least))
    if not focus:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    scores, squares = np.zeros(len(bucket.lengths), np.int64), np.zeros(len(bucket.lengths))
    for j in order[:focus]:
        docs, impacts = bucket.of(terms[j])
        scores[docs] += weights[j] * impacts  # a document is in a term's list once
        squares[docs] += impacts.astype(float) ** 2
    candidates = np.flatnonzero(squares)
    left = math.sqrt(float(np.sum(weights[order[focus:]].astype(float) ** 2)))
    by_length = left * np.sqrt(np.maximum(bucket.lengths[candidates] ** 2 * (1 + SLACK) - squares[candidates], 0))
    by_coordinates = rest[focus] if focus < len(rest) else 0.0
    survivors = candidates[scores[candidates] + np.minimum(by_length, by_coordinates) * (1 + SLACK) + 1 >= least]
    if len(survivors):
        for j in order[focus:]:
            docs, impacts = bucket.of(terms[j])
            scores[docs] += weights[j] * impacts
        survivors = survivors[scores[survivors] >= least]
    return survivors, scores[survivors]


def search(vectors: DataFrame, block: Block, weights: list[int], least: list[int], k: int) -> DataFrame:
    """item (its number in the block), doc_id, score: at least the k best documents of each item, of those with its least score or more."""
    n_terms, most_docs, most_pairs = len(block.numbers), BUCKET_DOCS, BUCKET_PAIRS
    shared = vectors.sparkSession.sparkContext.broadcast((np.array(block.starts), np.array(block.terms), np.array(weights, np.int64), least))  # bounded by a block
    kind = vectors.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, terms, weights, bounds = shared.value
        bounds, items = np.array(bounds, np.int64), len(starts) - 1
        some = np.flatnonzero(np.diff(starts))  # an item without terms finds nothing
        norms = np.array([math.sqrt(float(np.sum(weights[a:b].astype(float) ** 2))) for a, b in zip(starts, starts[1:])])
        best: list[list] = [[] for _ in range(items)]
        for batch in batches:
            sizes = np.diff(batch.column("terms").offsets.to_numpy())
            lengths, ids = batch.column("length").to_numpy(), batch.column("doc_id").to_pylist()
            all_terms, all_impacts = batch.column("terms").flatten().to_numpy(), batch.column("impacts").flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            while at < len(sizes):
                to = min(at + most_docs, max(at + 1, int(np.searchsorted(ends, ends[at] + most_pairs, "right")) - 1), len(sizes))
                bucket = Bucket(lengths[at:to], sizes[at:to], all_terms[ends[at] : ends[to]], all_impacts[ends[at] : ends[to]], n_terms)
                by_length = norms * bucket.lengths.max() * (1 + SLACK) + 1
                open_ = some[by_length[some] >= bounds[some]]
                if len(open_):
                    by_coordinates = np.add.reduceat(weights * bucket.largest[terms], starts[some]) * (1 + SLACK) + 1
                    open_ = np.intersect1d(open_, some[by_coordinates >= bounds[some]])
                for q in open_:
                    span = slice(starts[q], starts[q + 1])
                    docs, scores = reaching(bucket, terms[span], weights[span], int(bounds[q]))
                    if len(docs):
                        best[q] += ((-int(s), ids[at + d] is None, ids[at + d] or 0) for d, s in zip(docs.tolist(), scores.tolist()))
                        best[q].sort()
                        del best[q][k:]
                        if len(best[q]) == k:
                            bounds[q] = max(bounds[q], -best[q][-1][0])
                at = to
        rows = [(q, None if null else i, -s) for q, found in enumerate(best) for s, null, i in found]
        kinds = (pa.int32(), pa.int64() if kind == "bigint" else pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["item", "doc_id", "score"])

    return vectors.mapInArrow(run, f"item int, doc_id {kind}, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents with a score above 0 (all, if fewer), ties to the smaller doc_id (null last).

    docs have an integer doc_id and a text (null or without a term: none, and not counted), items an item_id and a text (an item without a term that a document holds gets no row). Rows are
    documents and items of their own: repeated rows all rank, repeated items each have their k. Other columns are ignored; empty tables give no rows."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    for block in blocks(items):
        held = saved(counted(docs, block.numbers))
        n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not block.numbers:
            continue
        dfs = dict(held.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator())  # a number for each of the block's terms
        by_term = [weight(n_docs, dfs.get(t, 0)) for t in range(len(block.numbers))]
        weights = [by_term[t] * r for t, r in zip(block.terms, block.repeats)]
        vectors = saved(by_length(held, n_docs, n_terms))
        bound = vectors.agg(F.percentile_approx("length", 1 - SEEDS, 1000)).first()[0]
        if bound is None:
            continue
        first = search(vectors.where(F.col("length") >= bound), block, weights, [1] * len(block.ids), k)
        least = [1] * len(block.ids)
        for row in best_of(first, k).where(F.col("rank") == k).select("item", "score").toLocalIterator():
            least[row["item"]] = max(1, row["score"])
        found = best_of(search(vectors, block, weights, least, k), k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        out = out.unionByName(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
