from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gatherline.operators import operations, shapes
from gatherline.streaming import bronze, dispatch, due, folders

RUN = "source_key string, run_id long, started_at timestamp, status string, new_items long"


@pytest.fixture
def items(spark, tmp_path):
    d = spark.range(60).selectExpr("id", "element_at(array('a', 'b:/x', 'c'), cast(id % 3 + 1 AS int)) AS source_key", "concat('t', cast(id AS string)) AS title")
    return d, str(tmp_path)


def failing(df):
    """A job that fails only when it runs, and on one row only."""
    return df.withColumn("title", F.when(F.col("id") == 4, F.raise_error(F.lit("row 4 is bad"))).otherwise(F.col("title")))


def rows(spark, folder, source):
    d = dispatch.drafts(spark, folder, source)
    return [] if d is None else sorted(r["id"] for r in d.collect())


def test_a_job_that_fails_while_it_runs_takes_out_only_its_source(spark, items):
    batch, base = items
    jobs = {"a": lambda d: d, "b:/x": failing}
    for _ in range(2):  # a batch that runs again gives the same
        dispatch.run_batch(batch, 0, jobs, base)
        assert rows(spark, base, "a") == list(range(0, 60, 3)) and rows(spark, base, "b:/x") == []
        found = {r["source_key"]: r for r in dispatch.outcomes(spark, base).collect()}
        assert {k: (r["status"], r["n_drafts"], r["waiting"]) for k, r in found.items()} == {"a": ("ok", 20, []), "b:/x": ("error", 0, [0]), "c": ("skipped", 0, [])}
        assert "row 4 is bad" in found["b:/x"]["error"]


def test_items_of_a_failed_source_are_taken_up_again_once(spark, items):
    batch, base = items
    jobs = {"a": lambda d: d, "b:/x": failing}
    dispatch.run_batch(batch.where("id < 30"), 0, jobs, base)
    dispatch.run_batch(batch.where("id >= 30 AND source_key = 'a'"), 1, jobs, base)
    assert {r["source_key"]: r["waiting"] for r in dispatch.outcomes(spark, base).where("batch = 1").collect()} == {"a": [], "b:/x": [0, 1]}
    mended = jobs | {"b:/x": lambda d: d}
    for _ in range(2):
        dispatch.run_batch(batch.where("id >= 30 AND source_key <> 'a'"), 2, mended, base)
        assert rows(spark, base, "b:/x") == list(range(1, 60, 3)) and rows(spark, base, "a") == list(range(0, 60, 3))
    dispatch.run_batch(batch.limit(0), 3, mended, base)
    assert rows(spark, base, "b:/x") == list(range(1, 60, 3)) and dispatch.outcomes(spark, base).where("batch = 3").isEmpty()


def test_dispatched_stream_of_registered_sources(spark, tmp_path):
    base = str(tmp_path)
    posts = spark.range(20).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'tg:rutatuta_vlc' WHEN id % 3 = 0 THEN 'web:fever' ELSE 'tg:unknown' END AS source_key", "'telegram_post' AS kind", "CAST(NULL AS string) AS title",
        "concat('5 июня 2026: Прогулка ', id) AS text", "CAST(NULL AS string) AS url", "timestamp'2026-06-01' AS seen")
    posts.coalesce(1).write.parquet(f"{base}/in")
    jobs = shapes.jobs(["tg:rutatuta_vlc", "web:fever"])
    for _ in range(2):
        dispatch.dispatched(bronze.stream(spark, f"{base}/in", posts.schema), jobs, f"{base}/out", f"{base}/ck").awaitTermination()
    got = dispatch.drafts(spark, f"{base}/out", "tg:rutatuta_vlc")
    assert got.count() == 10 and {r["start_date"] for r in got.collect()} == {"2026-06-05"}
    assert {r["source_key"]: r["status"] for r in dispatch.outcomes(spark, f"{base}/out").collect()} == {"tg:rutatuta_vlc": "ok", "tg:unknown": "skipped", "web:fever": "ok"}


def test_bronze_keeps_two_manifests_and_what_they_name(spark, tmp_path):
    base = str(tmp_path)
    batch = spark.range(40).selectExpr("concat('h', cast(id AS string)) AS item_hash", "'s' AS source_key", "concat('t', cast(id AS string)) AS title", "'x' AS text", "timestamp_seconds(id) AS seen")
    for i in range(6):
        changed = batch.where(f"item_hash IN ('h{i}', 'h{i + 1}')" if i else "true").withColumn("title", F.concat("title", F.lit(f"-{i}"))).withColumn("seen", F.timestamp_seconds(F.lit(1000 + i)))
        changed.coalesce(1).write.mode("append").parquet(f"{base}/in")
        bronze.ingest(bronze.stream(spark, f"{base}/in", batch.schema), f"{base}/table", f"{base}/ck", buckets=8).awaitTermination()
        assert len(bronze.versions(spark, f"{base}/table")) <= 2
    got = {r["item_hash"]: r["title"] for r in bronze.current(spark, f"{base}/table").collect()}
    assert len(got) == 40 and got["h5"] == "t5-5" and got["h6"] == "t6-5" and got["h4"] == "t4-4" and got["h30"] == "t30-0"
    fs, path = folders.file_system(spark, f"{base}/table/data")
    held = [b.getPath().toString() for v in fs.listStatus(path) for b in fs.listStatus(v.getPath()) if "bucket=" in b.getPath().getName()]
    named = {f for v in bronze.versions(spark, f"{base}/table") for f in bronze.manifest(spark, f"{base}/table", v).values()}
    assert {h.split("/data/")[1] for h in held} == {n.split("/data/")[1] for n in named} and len(held) <= 8 + 4


def log(spark, first, last):
    """Runs by the hour: two sources that change, idle and fail by turns, and one that was polled once only."""
    at = datetime(2026, 1, 1)
    made = [(f"s{k}", 100 * k + i, at + timedelta(hours=i, minutes=k), "error" if (i + k) % 5 == 0 else "ok", (i * k) % 3) for k in (1, 2) for i in range(12)] + [("lone", 1, at, "ok", 0)]
    return spark.createDataFrame([r for r in made if first <= r[2] < last], RUN)


def test_cadence_with_timers_goes_on_from_a_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", due.PROVIDER)
    base, at = str(tmp_path), datetime(2026, 1, 1)
    begun = operations.cadence(log(spark, at, at + timedelta(hours=6)), F.lit("web"))
    start = due.initial(begun)

    def run(first, last, checkpoint):
        log(spark, first, last).coalesce(1).write.mode("append").parquet(f"{base}/in")
        q = due.cadence_and_due(bronze.stream(spark, f"{base}/in", RUN), start).writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{base}/out")).outputMode("update")
        q.option("checkpointLocation", f"{base}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()

    run(at + timedelta(hours=6), at + timedelta(hours=9), "ck")
    run(at + timedelta(hours=9), at + timedelta(hours=12), "ck")  # a restart: the state is the checkpoint's
    got = spark.read.parquet(f"{base}/out")
    last = got.where("kind = 'run'").groupBy("source_key").agg(F.max_by(F.struct("fail_count", "unchanged", "poll", "due"), "run_id").alias("v")).select("source_key", "v.*")
    want = operations.cadence(log(spark, at, at + timedelta(hours=12)), F.lit("web")).where("source_key <> 'lone'")
    assert sorted(map(tuple, last.collect())) == sorted((r["source_key"], r["fail_count"], r["unchanged"], r["poll"], int((r["next_due"] - datetime(1970, 1, 1)).total_seconds())) for r in want.collect())
    alarms = {r["source_key"]: r["due"] for r in got.where("kind = 'due'").collect()}
    first = {r["source_key"]: r["due"] for r in start.collect()}
    assert alarms["lone"] == first["lone"]  # no run came, so the batch's own alarm went off
