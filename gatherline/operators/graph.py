"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import Scratch


def components(edges: DataFrame) -> DataFrame:
    """id and root (the least id reachable) of every end of edges (a, b).

    Large-star and small-star steps by turns: each end's greater neighbours, then its lesser ones, are tied to the least of all, until every end has one root that is tied to none. The rounds grow with the logarithm of the
    ends, not with the length of chains; the table is written each round, and that of the round before is dropped. Joins are by sort-merge: a compressed table's size on disk tells little of what it would take in the driver."""
    scratch = Scratch(edges.sparkSession)
    ends = scratch.saved(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    table = ends.where("v <> m")
    while True:
        both = table.unionByName(table.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.least("v", F.min("m")).alias("least"))
        large = scratch.saved(both.join(least.hint("merge"), "v").where("m > v").select(F.col("m").alias("v"), F.col("least").alias("m")).distinct())
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(least.hint("merge"), "v").select(F.col("m").alias("v"), F.col("least").alias("m")).where("v <> m").unionByName(least.select("v", F.col("least").alias("m")))
        step = scratch.saved(small.distinct())
        twice = step.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
        tied = step.select(F.col("m").alias("v")).join(step.select("v").hint("merge"), "v", "left_semi")
        done = twice.unionByName(tied).isEmpty()
        scratch.drop(table, large)
        table = step
        if done:
            roots = step.select(F.col("v").alias("id"), F.col("m").alias("root"))
            every = ends.select(F.col("v").alias("id")).unionByName(ends.select(F.col("m").alias("id"))).distinct()
            found = scratch.saved(every.join(roots.hint("merge"), "id", "left").select("id", F.coalesce("root", "id").alias("root")))
            scratch.drop(ends, step)
            return found
