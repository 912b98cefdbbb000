"""Projections of the given tables into the shapes that operators take, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-06-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event drafts: an order is an event, titled by the part of its customer's number, in the customer's nation."""
    o, c, n, p = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "part"))
    j = o.join(c.hint("merge"), o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(p.hint("merge"), o["o_custkey"] == p["p_partkey"])
    return j.selectExpr(
        "o_orderkey AS id",
        "CASE o_orderkey % 6 WHEN 0 THEN concat(p_name, ' | VIP') WHEN 1 THEN concat('Festival ', p_name, ' 28') ELSE p_name END AS title",
        "n_name AS city",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS start_date",
        "CASE WHEN o_orderkey % 4 = 0 THEN date_format(date_add(o_orderdate, cast(o_orderkey % 150 AS int)), 'yyyy-MM-dd') END AS end_date",
        "CASE WHEN o_orderkey % 3 > 0 THEN concat(lpad(cast(o_orderkey % 2 * 20 AS string), 2, '0'), ':00') END AS start_time",
        "p_brand AS venue_name",
        "concat('s', cast(o_orderkey % 5 AS string)) AS source",
        "CASE o_orderkey % 5 WHEN 0 THEN 'gold' WHEN 1 THEN 'good' WHEN 2 THEN 'mine' WHEN 3 THEN 'off' END AS source_weight",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('http://x.org/', cast(o_custkey AS string), '/') END AS url",
        "CASE WHEN o_orderkey % 2 = 0 THEN cast(o_custkey % 1000 AS string) END AS external_ref",
        "concat('http://x.org/', cast(o_orderkey AS string)) AS source_url",
        "CASE WHEN o_orderkey % 9 > 0 THEN cast(o_totalprice % 100 AS int) END AS score",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'Concerts ' WHEN '2-HIGH' THEN 'culture' WHEN '3-MEDIUM' THEN 'festival' WHEN '4-NOT SPECIFIED' THEN 'excursion' ELSE c_mktsegment END AS category",
        "CASE o_orderstatus WHEN 'F' THEN 'duplicate' WHEN 'O' THEN 'upcoming' END AS status",
        "CASE o_orderkey % 4 WHEN 0 THEN 'ru' WHEN 1 THEN 'es' WHEN 2 THEN 'en' END AS language",
        "CASE o_orderkey % 3 WHEN 0 THEN 'family' WHEN 1 THEN 'adult' END AS audience",
        "CAST(o_orderkey % 2 AS int) AS is_free",
        "CAST(NULL AS string) AS description",
        "concat('[\"', replace(p_name, ' ', '\",\"'), '\",\"city-', lower(n_name), '\",\"', cast(o_orderkey % 50 AS string), '\",\"', lower(c_mktsegment), '\"]') AS tags_json",
    )


EVENTS_SQL = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 6 WHEN 0 THEN p_name || ' | VIP' WHEN 1 THEN 'Festival ' || p_name || ' 28' ELSE p_name END AS title,
  n_name AS city, strftime(o_orderdate, '%Y-%m-%d') AS start_date,
  CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate::DATE + (o_orderkey % 150)::INT, '%Y-%m-%d') END AS end_date,
  CASE WHEN o_orderkey % 3 > 0 THEN lpad((o_orderkey % 2 * 20)::VARCHAR, 2, '0') || ':00' END AS start_time,
  p_brand AS venue_name, 's' || (o_orderkey % 5) AS source,
  CASE o_orderkey % 5 WHEN 0 THEN 'gold' WHEN 1 THEN 'good' WHEN 2 THEN 'mine' WHEN 3 THEN 'off' END AS source_weight,
  CASE WHEN o_orderkey % 3 = 0 THEN 'http://x.org/' || o_custkey || '/' END AS url,
  CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 1000)::VARCHAR END AS external_ref,
  'http://x.org/' || o_orderkey AS source_url,
  CASE WHEN o_orderkey % 9 > 0 THEN trunc(o_totalprice % 100)::INT END AS score,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Concerts ' WHEN '2-HIGH' THEN 'culture' WHEN '3-MEDIUM' THEN 'festival' WHEN '4-NOT SPECIFIED' THEN 'excursion' ELSE c_mktsegment END AS category,
  CASE o_orderstatus WHEN 'F' THEN 'duplicate' WHEN 'O' THEN 'upcoming' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN 'ru' WHEN 1 THEN 'es' WHEN 2 THEN 'en' END AS language,
  CASE o_orderkey % 3 WHEN 0 THEN 'family' WHEN 1 THEN 'adult' END AS audience,
  (o_orderkey % 2)::INT AS is_free,
  '["' || replace(p_name, ' ', '","') || '","city-' || lower(n_name) || '","' || (o_orderkey % 50) || '","' || lower(c_mktsegment) || '"]' AS tags_json
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON o_custkey = p_partkey
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of polls: the user is the source, an error an error, a view a poll without news."""
    e = table(spark, sf_dir, "events")
    return e.selectExpr(
        "event_id AS run_id", "concat('src', cast(user_id AS string)) AS source_key", "cast(ts AS timestamp) AS started_at",
        "CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END AS status", "CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 0 ELSE 1 + event_id % 7 END AS new_items",
    )


RUNS_SQL = """
SELECT event_id AS run_id, 'src' || user_id AS source_key, ts AS started_at,
  CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END AS status, CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 0 ELSE 1 + event_id % 7 END AS new_items
FROM events
"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places: a customer is one, near the point of its nation."""
    c = table(spark, sf_dir, "customer")
    return c.selectExpr(
        "c_custkey AS id", "concat('Cafe ', lower(c_mktsegment), ' ', cast(c_custkey % 40 AS string), CASE c_custkey % 3 WHEN 0 THEN 'a' ELSE '' END) AS name",
        "concat('area', cast(c_nationkey AS string)) AS area", "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS category",
        "39.0 + c_nationkey * 0.1 + (c_custkey % 7) * 0.0004 AS lat", "-0.4 + (c_custkey % 5) * 0.0004 AS lng",
        "CASE c_custkey % 2 WHEN 0 THEN 'map_url' ELSE 'address' END AS geo_source",
        "CASE WHEN c_custkey % 11 = 0 THEN concat('https://maps/', cast(c_custkey % 110 AS string)) END AS maps_url",
        "CASE WHEN c_custkey % 13 = 0 THEN cast(c_custkey % 260 AS string) END AS external_ref", "concat('s', cast(c_custkey % 3 AS string)) AS source",
        "cast(c_acctbal AS int) AS score",
    )


PLACES_SQL = """
SELECT c_custkey AS id, 'Cafe ' || lower(c_mktsegment) || ' ' || (c_custkey % 40) || CASE c_custkey % 3 WHEN 0 THEN 'a' ELSE '' END AS name,
  'area' || c_nationkey AS area, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS category,
  39.0::DOUBLE + c_nationkey * 0.1::DOUBLE + (c_custkey % 7) * 0.0004::DOUBLE AS lat, -0.4::DOUBLE + (c_custkey % 5) * 0.0004::DOUBLE AS lng,
  CASE c_custkey % 2 WHEN 0 THEN 'map_url' ELSE 'address' END AS geo_source,
  CASE WHEN c_custkey % 11 = 0 THEN 'https://maps/' || (c_custkey % 110) END AS maps_url,
  CASE WHEN c_custkey % 13 = 0 THEN (c_custkey % 260)::VARCHAR END AS external_ref, 's' || (c_custkey % 3) AS source, trunc(c_acctbal)::INT AS score
FROM customer
"""
