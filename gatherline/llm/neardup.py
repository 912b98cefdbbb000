"""MinHash near-duplicate detection.

A document's set of 5-word shingles gets a one-permutation hash signature (one hash a shingle, one bin each, empty
bins filled by optimal densification). Bands of the signature put sets into buckets. In a bucket each set is paired with one
centre, never with all others, so pairs grow with the members. Pairs that sizes or sketches don't rule out are confirmed on the full sets.
In further turns only the members outside a bucket's most frequent component act: each is paired with one member of that component, another one each turn, and with
its neighbour in the order of signatures. What still shares a bucket after these turns and is apart goes through an exact join on the rarest shingles (prefix
filtering), so every pair of a bucket is joined, tried or ruled out by its counts. Rows with equal sets are one node throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ddl, row_key, sliced

SHINGLE = 5
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Share of equal bytes in two sketches below which a pair is not worth confirming: over five deviations below 0.75.
LEAST_ALIKE = 0.55
#: Turns of stars and neighbours before the exact join.
TURNS = 4
#: Distinct words whose hashes a task keeps before it begins anew.
KEPT_WORDS = 400_000

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Sorted arrays of 64-bit hashes of a text's distinct shingles."""

    def __init__(self) -> None:
        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = h = xxhash.xxh3_64_intdigest(word)
                return h

        self.hashes = Words()

    def shingles(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # at ASCII white space
        if len(self.hashes) > KEPT_WORDS:
            self.hashes.clear()
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        n = min(SHINGLE, len(h))
        s = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            s = mix64(s * U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
        return np.unique(s)


#: For each bin the bins it tries, in order, to be filled from.
TRIES = (mix64(np.arange(BINS * 256, dtype=np.uint64) + U(1)) % U(BINS)).astype(np.int64).reshape(BINS, 256)


def signature(s: np.ndarray) -> np.ndarray:
    """BINS values: the least hash in each bin; an empty bin takes the value of the first bin that it tries and that isn't empty."""
    h = mix64(s ^ U(0xA5A5A5A5A5A5A5A5))
    bins = (h >> U(57)).astype(np.int64)
    values = np.full(BINS, U(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(values, bins, h & U((1 << 57) - 1))
    full = np.zeros(BINS, bool)
    full[bins] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        tried = full[TRIES[empty]]
        source = TRIES[empty, tried.argmax(axis=1)]
        values[empty] = values[np.where(tried.any(axis=1), source, np.flatnonzero(full)[0])]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for v in values.reshape(BANDS, ROWS).T:
        key = mix64(key * U(0x9E3779B97F4A7C15) + v)
    return key.view(np.int64)


def sketch(values: np.ndarray) -> bytes:
    return (mix64(values) & U(255)).astype(np.uint8).tobytes()


def signed(docs: DataFrame) -> DataFrame:
    """key, doc_id, n_shingles, set_id (a 128-bit hash of the set, null for an empty one), bands and sketch of every row of docs (key, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in sliced(batches):
            sets = [shingler.shingles(t.as_py()) for t in batch.column("text")]
            values = [signature(s) if len(s) else None for s in sets]
            keys = [np.zeros(0, np.int64) if v is None else band_keys(v) for v in values]
            offsets = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(offsets, np.concatenate([*keys, np.zeros(0, np.int64)])),
                    pa.array([None if v is None else sketch(v) for v in values], pa.binary()),
                ],
                names=["key", "doc_id", "n_shingles", "set_id", "bands", "sketch"],
            )

    return docs.mapInArrow(run, ddl(docs.select("key", "doc_id"), "n_shingles long, set_id binary, bands array<long>, sketch binary"))


def with_sets(docs: DataFrame) -> DataFrame:
    """node and shingles (sorted hashes) of every row (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in sliced(batches):
            sets = [shingler.shingles(t.as_py()) for t in batch.column("text")]
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(offsets, np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "shingles"])

    return docs.mapInArrow(run, ddl(docs.select("node"), "shingles array<long>"))


def alike(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, sketch_a, sketch_b) whose sketches don't rule out a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= LEAST_ALIKE))

    return pairs.mapInArrow(run, ddl(pairs.select("a", "b")))


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes (node, n, sketch) whose full sets have 100 * intersection >= percent * union; sets of too different sizes are never fetched."""
    one, two = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    sized = pairs.join(one, "a").join(two, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    likely = alike(sized.select("a", "b", "sketch_a", "sketch_b"))
    one, two = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = likely.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return both.where(common * 100 >= union * percent).select("a", "b")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (the component's least node) of every node of links (a, b).

    Each round maps a node to the least of itself and its neighbours, twice, and goes on with the links between what is left; stars vanish at once, chains in a number of rounds like the logarithm of their length."""
    links = scratch.saved("edges", links.where("a <> b").distinct())
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.saved("least", both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
        onward = least.select(F.col("node").alias("to"), F.col("to").alias("further"))
        step = scratch.saved("step", least.join(onward, "to").select("node", F.col("further").alias("to")))
        a, b = (step.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        links = scratch.saved("edges", links.join(a, "a").join(b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct())
        if labels is None:
            labels = scratch.saved("roots", step.withColumnRenamed("to", "label"))
        else:
            onward = step.select(F.col("node").alias("label"), F.col("to").alias("further"))
            labels = scratch.saved("roots", labels.join(onward, "label", "left").select("node", F.coalesce("further", "label").alias("label")))
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label"))


def joined(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """labels (node, label) after links (a, b): labels that links join fall to the least of them."""
    a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    between = links.join(a, "a").join(b, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    least = components(between, scratch).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return scratch.saved("labels", labels.join(least, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def leads_of(members: DataFrame, turn: int) -> DataFrame:
    """band, lead (the most frequent label) and centre (one of its nodes, another one each turn) of the buckets that hold several labels, from members (band, node, label).

    In turn 0 each node is its own label, so the centre is the bucket's first node in one order of all nodes."""
    labels = members.groupBy("band", "label").agg(F.count("*").alias("f"), F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("c"))
    lead = labels.groupBy("band").agg(F.max(F.struct("f", "c", "label")).alias("x"), F.count("*").alias("k")).where("k > 1")
    return lead.select("band", F.col("x.label").alias("lead"), F.col("x.c.node").alias("centre"))


def pairs_of(others: DataFrame, turn: int) -> DataFrame:
    """a and b of nodes to try in a turn, from the members (band, tail, node, label, centre) outside their bucket's lead label: stars about the centres, and, once there are
    labels, neighbours in the order of the signature from the band on. Two pairs a member at most; a bucket is dealt out by the first byte of that order."""
    stars = others.select("node", F.col("centre").alias("other"))
    if turn:
        w = Window.partitionBy("band", F.substring("tail", 1, 1)).orderBy("tail", "node")
        near = others.select("node", "label", F.lead(F.struct("node", "label")).over(w).alias("c")).where("label <> c.label")
        stars = stars.unionByName(near.select("node", F.col("c.node").alias("other")))
    return stars.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def pairs_by_prefix(nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a and b of all nodes (node, label, shingles) of different labels whose sets may have 100 * intersection >= percent * union; no such pair is left out.

    Each set is ordered by how many nodes hold a shingle, rarest first. Two sets that are alike enough share one of the first size - ceil(percent * size / 100) + 1
    of either, and at the first one that they share, enough of both is still to come. At each shingle only members outside its most frequent label are joined with all others."""
    items = nodes.select("node", F.explode("shingles").alias("x"))
    shared = items.groupBy("x").agg(F.count("*").alias("f")).where("f > 1")
    order = items.join(shared, "x").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("s"))
    n = F.size("shingles")
    first = nodes.join(order, "node").select("node", "label", n.alias("n"), (n - F.size("s")).alias("alone"), "s")
    length = F.col("n") - F.floor((F.col("n") * percent + 99) / 100).cast("int") + 1 - F.col("alone")
    first = first.where(length > 0).select("node", "label", "n", "alone", F.posexplode(F.slice("s", F.lit(1), length)).alias("i", "c"))
    first = scratch.saved("first", first.select(F.col("c.x").alias("x"), "node", "label", (F.col("n") - F.col("alone") - F.col("i")).alias("rest"), "n"))
    lead = first.groupBy("x", "label").agg(F.count("*").alias("f")).groupBy("x").agg(F.max(F.struct("f", "label"))["label"].alias("lead"), F.count("*").alias("k")).where("k > 1").select("x", "lead")
    first = scratch.saved("first", first.join(lead, "x"))
    one = first.where("label <> lead").select("x", *[F.col(c).alias(f"{c}_a") for c in ("node", "label", "rest", "n")])
    two = first.select("x", "lead", *[F.col(c).alias(f"{c}_b") for c in ("node", "label", "rest", "n")])
    both = one.join(two, "x").where((F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("lead")) | (F.col("node_a") < F.col("node_b"))))
    both = both.where(F.least("rest_a", "rest_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
    return both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def linked(keyed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, doc_id, n_shingles, node: a hash of the set, null if empty) and labels (node, label: the component's least node) of the nodes that share a bucket with others, of keyed rows (key, doc_id, text)."""
    scratch = Scratch(keyed.sparkSession)
    found = scratch.saved("signed", signed(keyed))
    some = [F.first(c).alias(c) for c in ("bands", "sketch")]
    nodes = found.where(F.col("set_id").isNotNull()).groupBy(F.col("set_id").alias("node")).agg(F.min("key").alias("key"), F.max("n_shingles").alias("n"), *some)
    nodes = scratch.saved("nodes", nodes)
    rows = scratch.saved("rows", found.select("key", "doc_id", "n_shingles", F.col("set_id").alias("node")))
    scratch.drop("signed")
    tail = F.expr(f"substring(concat(sketch, sketch), q * {ROWS} + {ROWS + 1}, 12)")
    band = nodes.select("node", "sketch", F.posexplode("bands").alias("q", "band")).select("node", "band", tail.alias("tail"))
    shared = nodes.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = scratch.saved("members", band.join(shared, "band"))
    live = members.select("node").distinct()
    nodes = scratch.saved("nodes", nodes.drop("bands").join(live, "node"))
    labels = scratch.saved("labels", nodes.select("node", F.col("node").alias("label")))
    texts = keyed.select("key", "text").join(nodes.select("key", "node").hint("shuffle_hash"), "key").select("node", "text")
    sets = scratch.saved("sets", with_sets(texts).dropDuplicates(["node"]))

    tested = None
    for turn in range(TURNS + 1):
        m = members.join(labels, "node")
        m = m.join(leads_of(m, turn), "band")
        members = scratch.saved("members", m)
        if members.isEmpty():
            break
        if turn == TURNS:  # all that is left
            pairs = pairs_by_prefix(sets.join(members.select("node", "label").distinct(), "node"), percent, scratch)
        else:
            pairs = pairs_of(members.where("label <> lead"), turn)
        pairs = scratch.saved(f"pairs{turn}", pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        links = scratch.saved("links", confirmed(pairs, nodes, sets, percent))
        labels = joined(labels, links, scratch)
        members = members.select("band", "tail", "node")
        tested = pairs if tested is None else tested.unionByName(pairs)
    scratch.drop("members", "sets", "nodes")
    return rows, labels


def groups(keyed: DataFrame, *, percent: int = 75) -> DataFrame:
    """key, doc_id, n_shingles, component_id (the least doc_id reachable over links, its own included; null if none has an id) and first (the key of the row that stands for the
    component: that of least doc_id, null last, then of least key) of every row of keyed (key, doc_id, text); rows with equal keys must be equal."""
    rows, labels = linked(keyed, percent)
    rows = rows.join(labels, "node", "left").withColumn("component", F.coalesce("label", "node", "key"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))).alias("least")
    of = rows.groupBy("component").agg(least)
    return rows.join(of, "component").select("key", "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("first"))


def near_duplicates(docs: DataFrame, *, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links, its own included) and kept (doc_id = component_id) of every row of docs (doc_id, text; other columns are ignored).

    Documents are linked whose shingle sets have 100 * intersection >= percent * union. A text that is null or has no word has no shingle and is linked with nothing;
    one of fewer words than a shingle has one shingle. Rows with equal sets are linked. Rows that repeat a doc_id are compared each by its own text, and all of them are kept if
    their id is the component's. A row without an id takes part like others; it is kept only where it stands for a component in which no row has an id. An empty table gives an empty result."""
    docs = docs.select("doc_id", "text")
    found = groups(docs.withColumn("key", row_key(docs)), percent=percent)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("key") == F.col("first")))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
