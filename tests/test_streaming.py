from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from gatherline.operators import operations
from gatherline.plans.inputs import runs
from gatherline.sources.pages import upserted
from gatherline.streaming import bronze

SF = "/root/testdata/sf0.001"


@pytest.fixture
def items(spark, tmp_path):
    d = spark.range(60).selectExpr("concat('h', cast(id % 25 AS string)) AS item_hash", "'s' AS source_key", "concat('t', cast(id AS string)) AS title", "'x' AS text", "timestamp_seconds(id) AS seen")
    for i in range(3):
        d.where(f"unix_seconds(seen) % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return d, str(tmp_path)


def test_stream_gives_what_a_batch_gives(spark, items):
    batch, base = items
    s = bronze.stream(spark, f"{base}/in", batch.schema)
    bronze.ingest(s, f"{base}/table", f"{base}/ck").awaitTermination()
    bronze.ingest(s, f"{base}/table", f"{base}/ck").awaitTermination()  # nothing new
    none = batch.limit(0).selectExpr("item_hash", "source_key", "title", "text", "seen AS first_seen", "seen AS last_seen", "'' AS status")
    key = lambda df: sorted(map(tuple, df.select("item_hash", "title", "last_seen", "status").collect()))
    assert key(bronze.current(spark, f"{base}/table")) == key(upserted(none, batch))


def test_a_batch_rewrites_what_it_touches(spark, items):
    batch, base = items
    bronze.ingest(bronze.stream(spark, f"{base}/in", batch.schema), f"{base}/table", f"{base}/ck").awaitTermination()
    before = bronze.places(spark, f"{base}/table")
    batch.where("item_hash = 'h3'").limit(1).withColumn("title", F.lit("anew")).withColumn("seen", F.timestamp_seconds(F.lit(1000))).coalesce(1).write.mode("append").parquet(f"{base}/in")
    bronze.ingest(bronze.stream(spark, f"{base}/in", batch.schema), f"{base}/table", f"{base}/ck").awaitTermination()
    after = bronze.places(spark, f"{base}/table")
    assert before.keys() == after.keys() and sum(after[b] != before[b] for b in before) == 1
    got = {r["item_hash"]: r["title"] for r in bronze.current(spark, f"{base}/table").collect()}
    assert len(got) == 25 and [h for h, t in got.items() if t == "anew"] == ["h3"]


def test_upsert_twice_is_once(spark, items):
    batch, _ = items
    none = batch.limit(0).selectExpr("item_hash", "source_key", "title", "text", "seen AS first_seen", "seen AS last_seen", "'' AS status")
    once = upserted(none, batch)
    assert sorted(map(tuple, upserted(once, batch).collect())) == sorted(map(tuple, once.collect()))


def test_distinct_items(spark, items):
    batch, base = items
    q = bronze.distinct_items(bronze.stream(spark, f"{base}/in", batch.schema)).writeStream.format("memory").queryName("distinct_items").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("distinct_items").count() == 25


def test_hourly_stream(spark, tmp_path):
    r = runs(spark, SF)
    r.write.parquet(str(tmp_path / "runs"))
    q = bronze.run_health(bronze.stream(spark, str(tmp_path / "runs"), r.schema)).writeStream.format("memory").queryName("health").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    last = r.agg(F.max("started_at")).first()[0]
    want = {tuple(x) for x in operations.hourly(r).collect() if x["hour"] + timedelta(hours=3) <= last}  # hours that end two before the last run
    assert want and {tuple(x) for x in spark.table("health").collect()} == want


def test_cadence_state(spark, tmp_path):
    r = runs(spark, SF).where("source_key IN ('src1', 'src2', 'src3')").withColumn("new_items", F.col("new_items").cast("long"))
    r.coalesce(1).write.parquet(str(tmp_path / "runs"))
    q = bronze.cadence(bronze.stream(spark, str(tmp_path / "runs"), r.schema)).writeStream.format("memory").queryName("cadence").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(x["source_key"], x["fail_count"], x["unchanged"], x["poll"]) for x in spark.table("cadence").collect()}
    assert got == {(x["source_key"], x["fail_count"], x["unchanged"], x["poll"]) for x in operations.cadence(r, F.lit("web")).collect()}
