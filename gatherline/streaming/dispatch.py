"""Items of many sources, each normalized by its own job: one that fails while it runs takes out only its own source.

A batch writes, under its own number, each source's drafts by themselves, the items of sources whose job failed, and a row of outcome for each source that it met. A failed
source's items are taken up again by the next batch. All of it is written over when a batch runs again, and nothing is read that a batch of the same or a later number has written, so a replay is exact."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .folders import complete, delete

#: A row of outcome: batch and source; ok, error or skipped (no job); rows written; the error; the batches (this one or earlier ones) whose items of the source still wait.
OUTCOME = "batch long, source_key string, status string, n_drafts long, error string, waiting array<long>"
Job = Callable[[DataFrame], DataFrame]


def named(source: str) -> str:
    """A source as the name of a folder."""
    return quote(source, safe="")


def waiting(spark: SparkSession, folder: str, before: int) -> dict[str, list[int]]:
    """By source, the batches whose items wait, as of the last outcomes before a batch."""
    held = [v for v in complete(spark, f"{folder}/outcomes") if v < before]
    if not held:
        return {}
    last = spark.read.schema(OUTCOME).parquet(f"{folder}/outcomes/v{held[-1]}")
    return {r["source_key"]: list(r["waiting"]) for r in last.where(F.size("waiting") > 0).collect()}


def run_batch(batch: DataFrame, number: int, jobs: dict[str, Job], folder: str, threads: int = 8, keep: int = 100) -> None:
    """Normalizes a batch (source_key, item columns): each source's job gets the source's items, with those of earlier batches in which it failed, and its drafts are written by an action of their own.

    Sources without a job are skipped, and so are null ones. Outcomes of the last batches (keep) stay. Jobs of several sources run at once."""
    spark = batch.sparkSession
    batch = batch.persist()
    before = waiting(spark, folder, number)
    found = batch.select("source_key").where("source_key IS NOT NULL").distinct().collect()  # a registry of sources, a few dozen
    met = sorted({r[0] for r in found} | before.keys())

    def run(source: str) -> tuple:
        old = before.get(source, [])
        if source not in jobs:
            return number, source, "skipped", 0, None, old
        try:
            items = batch.where(F.col("source_key") == source)
            for v in old:
                items = items.unionByName(spark.read.schema(batch.schema).parquet(f"{folder}/failed/v{v}").where(F.col("source_key") == source))
            path = f"{folder}/drafts/{named(source)}/v{number}"
            jobs[source](items).write.mode("overwrite").parquet(path)
            return number, source, "ok", spark.read.parquet(path).count(), None, []
        except Exception as e:  # noqa: BLE001  one source's job is not the others' business; its error is a row of the outcome
            delete(spark, f"{folder}/drafts/{named(source)}/v{number}")
            return number, source, "error", 0, str(e)[:500], [*old, number]

    with ThreadPoolExecutor(threads) as pool:
        rows = list(pool.map(run, met))
    failed = [r[1] for r in rows if r[2] == "error"]
    batch.where(F.col("source_key").isin(failed)).write.mode("overwrite").parquet(f"{folder}/failed/v{number}")
    spark.createDataFrame(rows, OUTCOME).coalesce(1).write.mode("overwrite").parquet(f"{folder}/outcomes/v{number}")
    delete(spark, *(f"{folder}/outcomes/v{v}" for v in complete(spark, f"{folder}/outcomes")[:-max(keep, 2)]))
    batch.unpersist()


def dispatched(items: DataFrame, jobs: dict[str, Job], folder: str, checkpoint: str) -> StreamingQuery:
    """Runs the jobs over all available items of a stream."""
    return items.writeStream.foreachBatch(lambda batch, number: run_batch(batch, number, jobs, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """All outcomes that are kept."""
    held = complete(spark, f"{folder}/outcomes")
    return spark.read.schema(OUTCOME).parquet(*(f"{folder}/outcomes/v{v}" for v in held)) if held else spark.createDataFrame([], OUTCOME)


def drafts(spark: SparkSession, folder: str, source: str) -> DataFrame | None:
    """All drafts of a source; null columns where a batch's job gave others. None if it has none."""
    held = complete(spark, f"{folder}/drafts/{named(source)}")
    return spark.read.option("mergeSchema", True).parquet(*(f"{folder}/drafts/{named(source)}/v{v}" for v in held)) if held else None
