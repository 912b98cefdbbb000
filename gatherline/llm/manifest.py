"""A Merkle manifest of a table: content-addressed records, from which inclusion proofs are found by descent from the root.

Leaves of a group, in order, are hashed two by two, level by level, until one node remains; the groups' last nodes are the leaves of one more
such tree. A tree is made in segments of DIGIT levels, each from 256 consecutive nodes at most, so a round of grouping takes the tree eight levels up. A segment is a
record: the digest of its top, and the digests of all nodes below, level by level. Requests for leaves go the other way: from the root's digest a
join finds the record, each asked child (the next digit of its rank) takes the siblings that it passes by with it, and its own digest is the next request.
Requests for leaves of one segment go down as one row; only at the last digit there is a row a leaf. A proof is the path turned round.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Levels in a segment.
DIGIT = 8
#: A step of a path.
ENTRY = "array<struct<sibling:string,right:boolean>>"


def hashed(*parts: Column) -> Column:
    """H: lower-case hexadecimal SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value as a leaf holds it: `-` if null, else its bytes in UTF-8 by number, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def level_above(nodes: Column) -> Column:
    evens = F.filter(F.sequence(F.lit(0), F.size(nodes) - 1), lambda i: i % 2 == 0)
    return F.transform(evens, lambda i: hashed(F.get(nodes, i), F.coalesce(F.get(nodes, i + 1), F.lit(""))))


def levels_of(nodes: Column, n: Column) -> Column:
    """The nodes and the n levels above them (array of arrays)."""
    steps = F.filter(F.sequence(F.lit(1), F.lit(DIGIT)), lambda j: j <= n)
    return F.aggregate(steps, F.array(nodes), lambda acc, _: F.concat(acc, F.array(level_above(F.element_at(acc, -1)))))


def passed(levels: Column, child: Column) -> Column:
    """What the descent to a child passes by, from the top: at each level the sibling (null: none) and whether the path goes on at its right."""
    heights = F.filter(F.reverse(F.sequence(F.lit(0), F.lit(DIGIT - 1))), lambda j: j < F.size(levels) - 1)

    def entry(j: Column) -> Column:
        i = F.call_function("shiftright", child, j)
        return F.struct(F.get(F.get(levels, j), i.bitwiseXOR(F.lit(1))).alias("sibling"), (i % 2 == 1).alias("right"))

    return F.transform(heights, entry).cast(ENTRY)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with rank (from 0, by order, nulls first) and n (rows) within their group. Rows are dealt by ranges, so that a large group lies in many tasks; rows that are equal in order have some ranks or other."""
    rows = rows.withColumn("_deal", F.monotonically_increasing_id())
    by = [group, *order, "_deal"]
    at = F.monotonically_increasing_id()
    placed = saved(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_deal").withColumn("_at", at).withColumn("_part", F.shiftright(F.col("_at"), 33)))
    runs = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    within = Window.partitionBy(group)
    before = F.sum("_rows").over(within.orderBy("_part")) - F.col("_rows")
    runs = runs.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(within).alias("n"))
    return placed.join(runs, [group, "_part"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


@dataclass
class Tree:
    """rounds: for each, lowest first, the records (digest, levels); asked: the leaves' payload by segment (g, s, rows); roots: g, digest, round (of the record)."""

    rounds: list[DataFrame] = field(default_factory=list)
    asked: DataFrame | None = None
    roots: DataFrame | None = None


def tree(leaves: DataFrame, payload: list[str]) -> Tree:
    """Trees of leaves (g, rank, n, digest, and the columns in payload), one a group."""
    found = Tree()
    left = F.when(F.col("n") <= 1, F.lit(0)).otherwise(F.length(F.bin(F.col("n") - 1)))
    rows = F.struct("rank", "digest", *payload)
    now = leaves.select("g", "rank", left.alias("left"), "digest", rows.alias("row"))
    while True:
        first = found.asked is None
        each = F.struct("rank", "digest", *(["row"] if first else []))
        segments = now.groupBy("g", F.shiftright("rank", DIGIT).alias("s")).agg(F.sort_array(F.collect_list(each)).alias("nodes"), F.first("left").alias("left"))
        segments = segments.withColumn("levels", levels_of(F.col("nodes.digest"), F.least("left", F.lit(DIGIT))))
        segments = segments.withColumn("digest", F.get(F.element_at("levels", -1), F.lit(0))).withColumn("left", F.greatest(F.col("left") - DIGIT, F.lit(0)))
        segments = saved(segments.withColumn("top", F.col("left") == 0).select("g", "s", "digest", "left", "top", "levels", *([F.col("nodes.row").alias("rows")] if first else [])))
        if first:
            found.asked = segments.select("g", "s", "rows")
        roots = segments.where("top").select("g", "digest", F.lit(len(found.rounds)).alias("round"))
        found.roots = roots if found.roots is None else found.roots.unionByName(roots)
        found.rounds.append(segments.select("digest", "levels").dropDuplicates(["digest"]))
        now = segments.where("not top").select("g", F.col("s").alias("rank"), "left", "digest")
        if now.isEmpty():
            return found


def descended(made: Tree, requests: DataFrame) -> DataFrame:
    """requests (g, digest of the group's root, round, path, others) led down to all leaves of their groups: a row a leaf, with the request's columns, row (the leaf's payload) and the path down to it."""
    more = [c for c in requests.columns if c not in ("g", "digest", "round", "path")]
    now = None
    for k in reversed(range(len(made.rounds))):
        begun = requests.where(F.col("round") == k).select("g", F.lit(0).cast("long").alias("s"), "digest", "path", *more)
        now = begun if now is None else now.unionByName(begun)
        met = now.join(made.rounds[k], "digest").drop("digest")
        if k:
            met = met.select("*", F.posexplode(F.get("levels", F.lit(0))).alias("child", "digest"))
            now = met.select("g", (F.col("s") * (1 << DIGIT) + F.col("child")).alias("s"), "digest", F.concat("path", passed(F.col("levels"), F.col("child"))).alias("path"), *more)
        else:
            met = met.join(made.asked, ["g", "s"]).select("path", "levels", *more, F.posexplode("rows").alias("child", "row"))
            return met.select(*more, "row", F.concat("path", passed(F.col("levels"), F.col("child"))).alias("path"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof (siblings from the leaf's upwards) lead to."""
    return F.aggregate(proof, leaf, lambda acc, e: F.when(e["right"], hashed(e["sibling"], acc)).otherwise(hashed(acc, F.coalesce(e["sibling"], F.lit("")))))


def proofs(rows: DataFrame, group: str, order: str, leaf: Column, keep: list[Column]) -> DataFrame:
    """A row per row: the columns in keep, leaf, subroot (its group's), root, proof (array from the leaf upwards: sibling, null if none, and right: whether the path comes from the right child).

    Groups are ordered bytewise, null first; leaves by order (null first), ties by digest. Rows that repeat each other are leaves of their own and share out the proofs of their places. An empty table gives no row."""
    name = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    kept = [c.alias(f"k{i}") for i, c in enumerate(keep)]
    leaves = rows.select(name.alias("g"), F.col(order).alias("o"), leaf.alias("digest"), *kept)
    payload = [f"k{i}" for i in range(len(keep))]
    low = tree(ranked(leaves, "g", ["o", "digest"]), payload)
    subroots = low.roots.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest", "round")
    high = tree(ranked(subroots, "g", ["of"]), ["of", "round"])
    start = high.roots.withColumn("path", F.array().cast(ENTRY)).withColumn("root", F.col("digest"))
    inner = descended(high, start).select(F.col("row.of").alias("g"), F.col("row.digest").alias("digest"), F.col("row.round").alias("round"), "path", "root", F.col("row.digest").alias("subroot"))
    found = descended(low, saved(inner))
    return found.select(*(F.col(f"row.k{i}").alias(c) for i, c in enumerate(rows.select(*keep).columns)), F.col("row.digest").alias("leaf"), "subroot", "root", F.reverse("path").alias("proof"))


def document_leaf(n_chars: Column) -> Column:
    """The leaf of a document: doc_id, source, lang, n_chars, text, each framed."""
    return hashed(framed(F.col("doc_id")), framed(F.col("source")), framed(F.col("lang")), framed(n_chars), framed(F.col("text")))


def verified(docs: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of all documents, leaves grouped by lang and ordered by doc_id: where tampered, the leaf that is folded is that of a row whose n_chars is changed.

    Columns null in any place count as stated in framed; an id that is null comes first. A row per row; other columns are ignored."""
    kept = [F.col("doc_id"), F.when(tampered, document_leaf(changed)).alias("other")]
    found = proofs(docs, "lang", "doc_id", document_leaf(F.col("n_chars")), kept)
    digest = F.sha2(F.array_join(F.col("proof.sibling"), ""), 256)
    found = found.select("doc_id", "leaf", "subroot", "root", digest.alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
