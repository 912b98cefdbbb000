"""Mixing sources to target weights, with DataFrame functions only.

Every source's words form one stream, cut into blocks of fixed length. The mix has as many slots as the targets ask
for; a keyed permutation deals the slots to output shards, so each shard's vector of source counts is a multinomial
draw conditioned on the corpus totals (which is why no source strays from its target by more than a block). The k-th
draw of a source takes the block at the k-th place of that source's own pseudorandom index permutation, over and over,
and slots meet blocks in a join by (source, block) index.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_key, saved

#: Swap-or-not rounds of a permutation.
ROUNDS = 12
#: Rows that share a running sum before sums of groups are added up (the root of all rows, where that is more).
GROUP_ROWS = 2000
#: Slots that one generated row expands to.
CHUNK = 4096


@dataclass
class Mix:
    """documents: key, copy, doc_id, source, sid, size. sources: sid, source, source_size, weight, target, n_blocks, n_draws, first_draw.
    rows: shard, slot, sid, block, again (0 for
    the first pass over a source's blocks), key, copy, doc_id, start_word, n_words (a piece of a row at its place in the mix)."""

    documents: DataFrame
    sources: DataFrame
    rows: DataFrame


def permuted(index: Column, n: Column, key: Column) -> Column:
    """The image of index under a pseudorandom permutation of 0..n-1 chosen by key (swap-or-not: in each round an index and its
    mirror image about a keyed point change places or don't). The rounds are a fold, so the expression stays small."""

    def step(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, mirror)).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), index, step)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Targets of sources (columns source, source_size, one row each), by water filling.

    Sources in code-point order, null last, weigh weights, repeating. They share `share` times all sizes; a target stops at
    cap times its source's size and what it leaves is shared again by weight: every target is min(cap * size, level * weight)
    for the one level that makes the sum right. Two sorts of one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "sid")
    every = Window.partitionBy()
    s = (
        sizes.withColumn("sid", F.row_number().over(by_name).cast("long"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.lit(cap) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
    )
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(every) - before) / weight_left)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(every)
    level = F.coalesce(first["level"], F.max("ratio").over(every))
    return s.withColumn("target", F.least(F.col("most"), level * F.col("weight"))).drop("most", "ratio", "level")


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = 64,
    shard_slots: int = 8192,
    seed: str = "mix",
) -> Mix:
    """Mixes docs (key, doc_id, source, text; other columns are ignored).

    Rows of one key, doc_id, source and size are copies of each other, told apart by copy (from 0), each with words of its own in the mix. A null text has no words
    and is in no block; a null source is a source, last in order; a document of any length spans as many blocks as it needs;
    an empty table gives empty results. Equal inputs give equal mixes."""
    spark = docs.sparkSession
    rows = docs.select("key", "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = rows.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("copies"))
    documents = saved(rows.select("key", "doc_id", "source", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")))
    sources = targets(documents.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    sources = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words)).withColumn(
        "n_draws", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0).cast("long")
    )
    sums = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("first_draw", F.coalesce(F.sum("n_draws").over(sums), F.lit(0)))
    sources = saved(sources.withColumn("all_draws", F.sum("n_draws").over(Window.partitionBy())))

    # where each row begins in its source's stream: running sums in groups, then of the groups
    n_rows = documents.count()
    groups = max(1, n_rows // max(GROUP_ROWS, math.isqrt(n_rows)))
    on_source = documents["source"].eqNullSafe(sources["source"])
    documents = documents.join(sources, on_source).select("key", "copy", "doc_id", documents["source"], "sid", "size")
    placed = documents.where("size > 0").withColumn("grp", F.pmod(F.xxhash64("key", "copy", "doc_id"), F.lit(groups)))
    in_group = Window.partitionBy("sid", "grp").orderBy("doc_id", "key", "size", "copy")
    of_groups = Window.partitionBy("sid").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("sid", "grp").agg(F.sum("size").alias("of_group")).withColumn("start", F.coalesce(F.sum("of_group").over(of_groups), F.lit(0)))
    placed = (
        placed.withColumn("upto", F.sum("size").over(in_group.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts.select("sid", "grp", "start"), ["sid", "grp"])
        .withColumn("begin", F.col("start") + F.col("upto") - F.col("size"))
        .withColumn("end", F.col("begin") + F.col("size"))
    )
    n = F.lit(block_words)
    pieces = (
        placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / n), F.floor((F.col("end") - 1) / n))))
        .withColumn("at", F.greatest("begin", F.col("block") * n))
        .select("sid", "block", "key", "copy", "doc_id", (F.col("at") - F.col("begin")).alias("start_word"), (F.least("end", (F.col("block") + 1) * n) - F.col("at")).alias("n_words"))
    )

    draws = (
        sources.where("n_draws > 0")
        .select("sid", "n_blocks", "n_draws", "first_draw", "all_draws", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_draws") - 1, F.lit(CHUNK).cast("long"))).alias("chunk"))
        .repartition(max(1, spark.sparkContext.defaultParallelism), "sid", "chunk")
        .withColumn("draw", F.explode(F.sequence(F.col("chunk"), F.least(F.col("chunk") + CHUNK, F.col("n_draws")) - 1)))
        .withColumn("slot", F.col("first_draw") + F.col("draw"))
        .withColumn("block", F.col("draw") % F.col("n_blocks"))
        .withColumn("again", F.floor(F.col("draw") / F.col("n_blocks")))
    )
    draws = draws.withColumn("slot", permuted(F.col("slot"), F.col("all_draws"), F.xxhash64(F.lit(f"{seed} slot")))).withColumn(
        "block", permuted(F.col("block"), F.col("n_blocks"), F.xxhash64(F.lit(f"{seed} block"), "sid", "again"))
    )
    # Spark takes generated rows for as few as they are generated from, and would broadcast them
    draws = draws.select(F.floor(F.col("slot") / shard_slots).alias("shard"), (F.col("slot") % shard_slots).alias("slot"), "sid", "block", "again")
    rows = draws.hint("merge").join(pieces, ["sid", "block"])
    return Mix(documents, sources, rows.select("shard", "slot", "sid", "block", "again", "key", "copy", "doc_id", "start_word", "n_words"))


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per (doc_id, source): doc_id, source, size, source_size, target, taken (words of it in the mix, repeats counted). Rows that repeat a (doc_id, source) add up."""
    m = mix(docs.select("doc_id", "source", "text", F.lit("").alias("key")), **options)
    taken = m.rows.groupBy("doc_id", "sid").agg(F.sum("n_words").alias("taken"))
    sizes = m.documents.groupBy("doc_id", "source", "sid").agg(F.sum("size").alias("size"))
    keys = sizes.join(m.sources.select("sid", "source_size", "target"), "sid")
    same = keys["doc_id"].eqNullSafe(taken["doc_id"]) & (keys["sid"] == taken["sid"])
    return keys.join(taken, same, "left").select(
        keys["doc_id"], "source", "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of docs (doc_id, text, lang, source, n_chars; other columns are ignored): a row per row and pass with the words that the mix takes of it in that pass, in order.

    Words keep the white space around them, so a row that is taken whole keeps its text. Rows of which the mix takes nothing go, those with null or empty texts among them. Rows that
    repeat each other are taken each by itself; lang may be null and follows its row; n_chars is counted anew. An empty table gives an empty result. A text is shuffled once, whole:
    the mix takes more words than there are, so its pieces would be more."""
    d = docs.select("doc_id", "text", "lang", "source")
    d = d.withColumn("key", row_key(d))
    m = mix(d, **options)
    taken = m.rows.groupBy("key", "copy", "again").agg(F.array_sort(F.collect_list(F.struct("start_word", "n_words"))).alias("pieces"))
    words = F.regexp_extract_all("text", F.lit(rf"(?:^[\x20\x09-\x0D]+)?{WORD}[\x20\x09-\x0D]*"), F.lit(0))

    def of(w: Column) -> Column:
        return F.array_join(F.transform("pieces", lambda p: F.array_join(F.slice(w, (p["start_word"] + 1).cast("int"), p["n_words"].cast("int")), "")), "")

    text = F.get(F.transform(F.array(words), of), F.lit(0))  # a lambda's variable, so a text is cut once, not once a piece
    d = d.dropDuplicates(["key"]).join(taken.hint("shuffle_hash"), "key").withColumn("taken", text)
    return d.select("doc_id", F.col("taken").alias("text"), "lang", "source", F.length("taken").cast("long").alias("n_chars"))
