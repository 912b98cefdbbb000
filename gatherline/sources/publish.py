"""What leaves the tables: exports, bakes with integrity guards, site maps and the log of what was sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.read_model import visible

#: Schedules of this source are published as series, not as events.
SERIES_SOURCE = "api:hemisferic"


def bake_events(events: DataFrame, as_of: str, least_id: int = 0) -> DataFrame:
    """Dated, visible events of outside sources from an id on."""
    return events.where(visible(as_of) & F.col("start_date").isNotNull() & (F.coalesce("source", F.lit("")) != SERIES_SOURCE) & (F.col("id") >= least_id))


def bake_series(series: DataFrame, occurrences: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Upcoming series (id, status) whose last occurrence (series_id, day) isn't past, and all their occurrences."""
    alive = occurrences.groupBy("series_id").agg(F.max("day").alias("last")).where(F.col("last") >= as_of).select(F.col("series_id").alias("id"))
    kept = series.where("status IS NULL OR status = 'upcoming'").join(alive, "id", "left_semi")
    return kept, occurrences.join(kept.select(F.col("id").alias("series_id")), "series_id", "left_semi")


def guards(events: DataFrame, series: DataFrame, occurrences: DataFrame) -> DataFrame:
    """One row of counts: leaked, undated, series, orphans (occurrences without a series) and ok."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    e = events.agg(n(F.col("source") == SERIES_SOURCE).alias("leaked"), n(F.col("start_date").isNull()).alias("undated"))
    s = series.agg(F.count("*").alias("series"))
    o = occurrences.join(series.select(F.col("id").alias("series_id")), "series_id", "left_anti").agg(F.count("*").alias("orphans"))
    return e.join(s).join(o).withColumn("ok", (F.col("leaked") == 0) & (F.col("undated") == 0) & (F.col("series") > 0) & (F.col("orphans") == 0))


def checked(report: DataFrame) -> None:
    """Fails a job whose guards don't hold."""
    row = report.first()
    if not row["ok"]:
        raise ValueError(f"nothing is published: {row.asDict()}")


def site_map(events: DataFrame, places: DataFrame, as_of: str) -> DataFrame:
    """url, last_seen, changefreq and priority of fixed pages, upcoming dated events and places that have a page (rows with last_seen; places with url)."""
    none = F.lit(None).cast("string")
    fixed = events.sparkSession.range(1).select(F.explode(F.array(F.lit("/"), F.lit("/places"))).alias("url"), none.alias("last_seen"), F.lit("daily").alias("changefreq"), F.lit(1.0).alias("priority"))
    row = lambda df, folder, often, much: df.select(F.concat(F.lit(folder), "id").alias("url"), F.col("last_seen").cast("string").alias("last_seen"), F.lit(often).alias("changefreq"), F.lit(much).alias("priority"))
    e = events.where(visible(as_of) & F.col("start_date").isNotNull())
    return fixed.unionByName(row(e, "/events/", "weekly", 0.7)).unionByName(row(places.where("url <> ''"), "/places/", "monthly", 0.5))


def sent_log(rows: DataFrame, kind: str, at: str) -> DataFrame:
    """Rows to append to the log of what was sent; the next digest leaves them out by an anti-join."""
    return rows.select(F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id"), F.to_timestamp(F.lit(at)).alias("sent_at"))
