"""Queries: cadence and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import operations as ops
from .inputs import EVENTS_SQL, RUNS_SQL, events, runs
from .registry import query

NOW = "2024-02-01 00:00:00"
STATE_SQL = f"""
r AS ({RUNS_SQL}), k AS (SELECT *, status = 'error' AS e, status = 'ok' AND new_items > 0 AS c FROM r),
f AS (SELECT *, count(*) FILTER (NOT e) OVER w AS okn, count(*) FILTER (c) OVER w AS chn, last_value(CASE WHEN c THEN started_at END IGNORE NULLS) OVER (PARTITION BY source_key ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM k WINDOW w AS (PARTITION BY source_key ORDER BY started_at, run_id)),
l AS (SELECT source_key, max(okn) AS mo, max(chn) AS mc, max_by(e, (started_at, run_id)) AS le, max_by(c, (started_at, run_id)) AS lc, max(started_at) AS la FROM f GROUP BY 1),
s AS (SELECT source_key, le, lc, la, count(*) FILTER (e AND okn = mo) AS fail_count, count(*) FILTER (NOT e AND NOT c AND chn = mc) AS unchanged, max(started_at) FILTER (c) AS last_changed_at,
  max(round((epoch_us(started_at) - epoch_us(prev)) / 1e6)::BIGINT) FILTER (c AND chn = mc) AS observed_gap FROM f JOIN l USING (source_key) GROUP BY ALL),
st AS (SELECT *, CASE WHEN le THEN least(greatest(3600 * 2.0 ** least(fail_count, 60), 3600), 86400) WHEN NOT lc THEN least(greatest(round(3600 * 1.5 ** least(unchanged, 60)), 3600), 86400)
  WHEN observed_gap IS NULL THEN 3600 ELSE least(greatest(round(observed_gap * 0.33), 3600), 86400) END::BIGINT AS poll FROM s),
state AS (SELECT *, la + to_seconds(poll) AS next_due, CASE WHEN le THEN 'error' ELSE 'ok' END AS last_status FROM st)"""


def naive(df: DataFrame) -> DataFrame:
    """Timestamps as the log has them, without a zone."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


@query(f"WITH {STATE_SQL} SELECT source_key, fail_count, unchanged, last_changed_at, observed_gap, poll, next_due, last_status FROM state")
def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(ops.cadence(runs(spark, sf_dir), F.lit("web")))


@query(f"WITH {STATE_SQL} SELECT source_key, next_due FROM state WHERE next_due <= TIMESTAMP '2024-01-31 00:00:00'")
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ops.cadence(runs(spark, sf_dir), F.lit("web")).withColumn("enabled", F.lit(1))
    return naive(ops.due(s, "2024-01-31 00:00:00").select("source_key", "next_due"))


@query(f"WITH {STATE_SQL} SELECT source_key, CASE WHEN last_status = 'error' THEN 'last run errored' ELSE 'overdue ' || printf('%.1f', round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(next_due)) / 3.6e9, 1)) || 'h past next_due_at' END AS reason FROM state WHERE last_status = 'error' OR epoch_us(TIMESTAMP '{NOW}') - epoch_us(next_due) > 21600000000")
def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stale(ops.cadence(runs(spark, sf_dir), F.lit("web")).withColumn("enabled", F.lit(1)), NOW)


@query(f"WITH r AS ({RUNS_SQL}) SELECT source_key, max(run_id) FILTER (n = 1) AS run_id, max(status) FILTER (n = 1) AS status, max(new_items) FILTER (n = 1) AS new_items FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY started_at DESC, run_id DESC) AS n FROM r) GROUP BY 1")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return ops.latest_runs(r.select("source_key").distinct(), r).drop("started_at")


@query(f"WITH r AS ({RUNS_SQL}) SELECT source_key, count(*) AS runs, count(*) FILTER (status = 'error') AS errors, sum(new_items)::BIGINT AS items FROM r GROUP BY ROLLUP (source_key)")
def run_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.breakdown(runs(spark, sf_dir))


@query(f"WITH r AS ({RUNS_SQL}) SELECT date_trunc('hour', started_at) AS hour, source_key, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS errors, sum(new_items)::BIGINT AS items FROM r GROUP BY 1, 2")
def hourly_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(ops.hourly(runs(spark, sf_dir)))


@query(f"WITH e AS ({EVENTS_SQL}), r AS ({RUNS_SQL}) SELECT (SELECT count(*) FROM e WHERE status = 'upcoming') AS upcoming, (SELECT count(*) FROM e WHERE status = 'duplicate') AS duplicates, (SELECT count(*) FROM e WHERE status IS NULL) AS unknown, (SELECT count(*) FROM r WHERE status = 'error') AS failed, (SELECT max(started_at) FROM r WHERE status = 'ok') AS last_ok")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    e = events(spark, sf_dir).agg(n(F.col("status") == "upcoming").alias("upcoming"), n(F.col("status") == "duplicate").alias("duplicates"), n(F.col("status").isNull()).alias("unknown"))
    r = runs(spark, sf_dir).agg(n(F.col("status") == "error").alias("failed"), F.max(F.when(F.col("status") == "ok", F.col("started_at"))).alias("last_ok"))
    return naive(e.join(r))


@query(f"""WITH r AS ({RUNS_SQL}), e AS ({EVENTS_SQL}), x AS (SELECT (SELECT max(started_at) FROM r WHERE status = 'ok') AS last, (SELECT count(*) FROM e WHERE status = 'upcoming') AS n, (SELECT max(started_at) FROM r WHERE run_id % 50 = 0) AS enriched),
a AS (SELECT *, (epoch_us(TIMESTAMP '2024-02-20 00:00:00') - epoch_us(last)) / 1e6 AS age, (epoch_us(TIMESTAMP '2024-02-20 00:00:00') - epoch_us(enriched)) / 1e6 AS stale FROM x)
SELECT concat_ws('; ', CASE WHEN last IS NULL THEN 'no pipeline run yet (info)' WHEN age > 172800 THEN 'no successful pipeline run in 48h (last ' || printf('%.1f', round(age / 3600, 1)) || 'h ago)' END,
  CASE WHEN n = 0 THEN '0 upcoming events' END, CASE WHEN n > 0 AND (enriched IS NULL OR stale > 1209600) THEN 'enrichment stalled (info)' END) AS warnings, NOT (coalesce(age > 172800, false) OR n = 0) AS ok FROM a""")
def health_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a day some weeks after the last run; every fiftieth run enriched something."""
    r = runs(spark, sf_dir)
    e = events(spark, sf_dir).where("status = 'upcoming'")
    w = ops.warnings(r, e, r.where("run_id % 50 = 0").select(F.col("started_at").alias("enriched_at")), "2024-02-20 00:00:00")
    return w.select(F.array_join("warnings", "; ").alias("warnings"), "ok")


@query(f"WITH r AS ({RUNS_SQL}) SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS errors, sum(new_items)::BIGINT AS items FROM r")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summary(runs(spark, sf_dir).withColumnRenamed("new_items", "items"))
