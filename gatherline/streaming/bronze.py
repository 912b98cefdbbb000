"""The incremental path: a file stream of items into the bronze table, run health by hour, cadence as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.operations import hourly
from ..sources.pages import upserted
from .folders import complete, delete

RUN = "run_id long, source_key string, started_at timestamp, status string, new_items long"


def stream(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def distinct_items(items: DataFrame, late: str = "1 day") -> DataFrame:
    """Items of a hash once within the watermark; later repeats are caught by the upsert."""
    return items.withWatermark("seen", late).dropDuplicatesWithinWatermark(["item_hash"])


def versions(spark: SparkSession, table_dir: str) -> list[int]:
    """Numbers of the bronze table's manifests that are kept. One listing, of as many entries as are kept."""
    return complete(spark, f"{table_dir}/manifest")


def manifest(spark: SparkSession, table_dir: str, version: int) -> dict[int, str]:
    """The folder of each bucket as of a version: as many rows as there are buckets at most."""
    return {r["bucket"]: f"{table_dir}/{r['folder']}" for r in spark.read.schema("bucket int, folder string").parquet(f"{table_dir}/manifest/v{version}").collect()}


def places(spark: SparkSession, table_dir: str, before: int | None = None) -> dict[int, str]:
    """The folder of each bucket by the last manifest (before a number)."""
    held = [v for v in versions(spark, table_dir) if before is None or v < before]
    return manifest(spark, table_dir, held[-1]) if held else {}


def current(spark: SparkSession, table_dir: str) -> DataFrame | None:
    held = places(spark, table_dir)
    return spark.read.parquet(*held.values()) if held else None


def remove_replaced(spark: SparkSession, table_dir: str, keep: int) -> None:
    """Drops the manifests but for the last ones (keep), and the folders that only dropped ones name: no version in use reads them."""
    held = versions(spark, table_dir)
    if len(held) > keep:
        used = {f for v in held[-keep:] for f in manifest(spark, table_dir, v).values()}
        for v in held[:-keep]:
            delete(spark, *(f for f in manifest(spark, table_dir, v).values() if f not in used))
            delete(spark, f"{table_dir}/manifest/v{v}")


def ingest(items: DataFrame, table_dir: str, checkpoint: str, buckets: int = 256, keep: int = 2) -> StreamingQuery:
    """Upserts all available items into a table of so many buckets by hash. A batch writes, under its own number, the buckets that it touches, from those of the version before, and a manifest that names the
    folder of every bucket: the others stay where they are. A batch that runs again starts from the same manifest and gives the same; replaced folders go once the last manifests (keep, two at least) don't name them."""
    spark = items.sparkSession
    bucket = F.pmod(F.xxhash64("item_hash"), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # as many as there are buckets at most
        before = places(spark, table_dir, number)
        paths = [p for b, p in before.items() if b in touched]
        none = batch.limit(0).selectExpr("item_hash", "source_key", "title", "text", "seen AS first_seen", "seen AS last_seen", "'' AS status")
        held = spark.read.parquet(*paths) if paths else none
        upserted(held, batch).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table_dir}/data/v{number}")
        after = {b: p.removeprefix(f"{table_dir}/") for b, p in before.items()} | {b: f"data/v{number}/bucket={b}" for b in touched}
        spark.createDataFrame(sorted(after.items()), "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{table_dir}/manifest/v{number}")
        remove_replaced(spark, table_dir, max(keep, 2))
        batch.unpersist()

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_health(runs: DataFrame, late: str = "2 hours") -> DataFrame:
    """ok, error and new-item counts by hour and source, final once the watermark has passed the hour."""
    return hourly(runs.withWatermark("started_at", late))


STATE = "fail_count long, unchanged long, last_changed long, gap long"
OUT = "source_key string, run_id long, fail_count long, unchanged long, poll long"


def cadence(runs: DataFrame, low: int = 3600, high: int = 86400) -> DataFrame:
    """The poll interval of each source after each batch of its runs, from counters kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fails, same, last, gap = state.get if state.exists else (0, 0, -1, -1)
        rows = pd.concat(list(batches)).sort_values(["started_at", "run_id"])
        poll = low
        for status, new, at in zip(rows["status"], rows["new_items"], rows["started_at"], strict=True):
            if status == "error":
                fails += 1
                poll = low * 2.0 ** min(fails, 60)
            elif not new:
                fails, same = 0, same + 1
                poll = low * 1.5 ** min(same, 60)
            else:
                now = at.value // 1000
                if last >= 0 and round((now - last) / 1e6) > 0:
                    gap = round((now - last) / 1e6)
                fails, same, last = 0, 0, now
                poll = gap * 0.33 if gap > 0 else low
        state.update((fails, same, last, gap))
        yield pd.DataFrame([(key[0], int(rows["run_id"].iloc[-1]), fails, same, int(min(max(int(poll + 0.5), low), high)))], columns=["source_key", "run_id", "fail_count", "unchanged", "poll"])

    return runs.groupBy("source_key").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
