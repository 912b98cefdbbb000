"""Queries: places, coordinates and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import places as pl
from .inputs import EVENTS_SQL, PLACES_SQL, events, places, table
from .registry import query

WEIGHTS = {"s0": "gold", "s1": "good", "s2": "mine"}


def sql_metres(a: str, b: str) -> str:
    return f"2 * 6371000 * asin(least(1.0, sqrt(sin(radians({b}.lat - {a}.lat) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lng - {a}.lng) / 2) ** 2)))"


# names are "cafe", a segment and a number; the number alone leaves the signature
PLACE_PAIRS_SQL = f"""
p0 AS ({PLACES_SQL}), p AS (SELECT *, replace(lower(name), ' ', '-') AS plain, array_to_string(list_sort(list_filter(string_split(lower(name), ' '), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '[0-9]+'))), '-') || '|' || area || '|' || coalesce(lower(category), '') AS block FROM p0),
n AS (SELECT a.id AS a, b.id AS b, jaro_similarity(a.plain, b.plain) AS j, a.plain AS x, b.plain AS y, a.source <> b.source OR (a.geo_source = 'map_url' AND b.geo_source = 'map_url' AND {sql_metres('a', 'b')} <= 100) AS ok
  FROM p a JOIN p b ON a.block = b.block AND a.id < b.id),
pairs AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.maps_url = b.maps_url AND a.id < b.id UNION SELECT a.id, b.id FROM p a JOIN p b ON a.source = b.source AND a.external_ref = b.external_ref AND a.id < b.id
  UNION SELECT a, b FROM n WHERE ok AND j + 0.1 * (1 - j) * CASE WHEN x[1:4] = y[1:4] THEN 4 WHEN x[1:3] = y[1:3] THEN 3 WHEN x[1:2] = y[1:2] THEN 2 WHEN x[1] = y[1] THEN 1 ELSE 0 END >= 0.9)"""


@query(f"WITH {PLACE_PAIRS_SQL} SELECT a, b FROM pairs")
def place_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.pairs(places(spark, sf_dir))


@query(f"""WITH RECURSIVE {PLACE_PAIRS_SQL}, two AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT id AS a, id AS b FROM p UNION SELECT r.a, t.b FROM reach r JOIN two t ON r.b = t.a)
SELECT r.a AS id, arg_min(r.b, (CASE p.source WHEN 's0' THEN -3 WHEN 's1' THEN -2 ELSE -1 END, r.b)) AS root FROM reach r JOIN p ON p.id = r.b GROUP BY 1""")
def resolved_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.resolved(places(spark, sf_dir), WEIGHTS)


@query(f"WITH p AS ({PLACES_SQL}), c AS (SELECT 40.4168::DOUBLE AS lat, (-3.7035)::DOUBLE AS lng) SELECT id, round({sql_metres('p', 'c')}, 1) AS metres FROM p, c")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).select("id", F.round(pl.metres(F.col("lat"), F.col("lng"), F.lit(40.4168), F.lit(-3.7035)), 1).alias("metres"))


# the seventh nation's point is one that geocoders fall back on
GEO_SQL = """g AS (SELECT n_name AS name, 40.0::DOUBLE + n_nationkey AS lat, (-1.0)::DOUBLE * n_nationkey AS lng FROM nation WHERE n_nationkey <> 7),
c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 39.5::DOUBLE END AS url_lat, CASE c_custkey % 3 WHEN 0 THEN 'nowhere' WHEN 1 THEN 'NATION_' || (c_nationkey + 20) ELSE 'NATION_' || c_nationkey END AS q1, CASE WHEN c_custkey % 4 > 0 THEN 'NATION_' || c_nationkey ELSE 'nobody' END AS q2 FROM customer),
found AS (SELECT id, coalesce(url_lat, a.lat, b.lat) AS lat, CASE WHEN url_lat IS NOT NULL THEN -0.5::DOUBLE ELSE coalesce(a.lng, b.lng) END AS lng, CASE WHEN url_lat IS NOT NULL THEN 'map_url' WHEN coalesce(a.lat, b.lat) IS NOT NULL THEN 'gazetteer' END AS geo_source
FROM c LEFT JOIN g a ON a.name = q1 LEFT JOIN g b ON b.name = q2)"""


@query(f"WITH {GEO_SQL} SELECT id, lat, lng, geo_source FROM found")
def geocoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "nation").selectExpr("n_name AS name", "CASE n_nationkey WHEN 7 THEN 40.4169D ELSE 40.0D + n_nationkey END AS lat", "CASE n_nationkey WHEN 7 THEN -3.7036D ELSE -1.0D * n_nationkey END AS lng")
    c = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "CASE WHEN c_custkey % 5 = 0 THEN 'https://maps.x/?q=39.5,-0.5&z=3' END AS url",
        "array(CASE c_custkey % 3 WHEN 0 THEN 'nowhere' WHEN 1 THEN concat('NATION_', c_nationkey + 20) ELSE concat('NATION_', c_nationkey) END, CASE WHEN c_custkey % 4 > 0 THEN concat('NATION_', c_nationkey) ELSE 'nobody' END) AS queries")
    c = c.withColumn("p", pl.point_of(F.col("url"))).selectExpr("id", "queries", "p.lat AS url_lat", "p.lng AS url_lng")
    return pl.geocoded(c, g)


@query(f"WITH {GEO_SQL} SELECT count(*) AS hinted, avg((lat IS NOT NULL)::INT) AS mapped FROM found")
def map_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.coverage(geocoded(spark, sf_dir))


@query(f"""WITH e AS ({EVENTS_SQL}) SELECT id, CASE WHEN id % 3 = 0 THEN 'kino' ELSE category END AS category, CASE WHEN id % 6 = 0 THEN 'Hall' ELSE venue_name END AS venue_name, CASE WHEN id % 3 = 0 THEN (id % 10) / 10.0::DOUBLE END AS confidence,
  id % 3 = 0 AND (id % 6 = 0 OR id % 10 < 6) AS held FROM e""")
def promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    body = F.to_json(F.struct(F.lit("kino").alias("category"), F.when(F.col("id") % 6 == 0, "Hall").otherwise(" ").alias("venue_name"), (F.col("id") % 10 / 10).alias("confidence"), F.lit("x").alias("unknown")))
    return pl.promoted(e, e.where("id % 3 = 0").select("id", body.alias("json"))).select("id", "category", "venue_name", "confidence", "held")


@query(f"WITH e AS ({EVENTS_SQL}) SELECT id, score FROM e WHERE id % 4 > 0 ORDER BY score DESC NULLS LAST, id LIMIT 50")
def enrichment_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"last_seen": F.col("id") % 2, "enriched_at": F.when(F.col("id") % 2 == 0, F.col("id") % 4 / 2 * -1).otherwise(F.when(F.col("id") % 4 == 1, 0))})
    e = e.withColumn("enriched_at", F.when(F.col("id") % 4 == 0, 5).otherwise(F.when(F.col("id") % 4 == 2, -1).otherwise(F.lit(None))))
    return pl.enrichment_queue(e, 50).select("id", "score")


@query("""WITH t AS (SELECT role AS path, lower(coalesce(text, '')) AS a, lower(coalesce(left(text, length(text) - (conv_id % 40)::INT), '')) AS b FROM conversations)
SELECT path, count(*) AS cases, sum(((length(a) - length(b)) * 100 <= length(a) * 15)::INT)::BIGINT AS passed FROM t GROUP BY 1""")
def golden_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without their last 0 to 39 characters; of a text with fewer than those, as many as it lacks go."""
    c = table(spark, sf_dir, "conversations").selectExpr("*", "length(text) - cast(conv_id % 40 AS int) AS n")
    c = c.selectExpr("role AS path", "text AS predicted", "left(text, CASE WHEN n < 0 THEN length(text) + n ELSE n END) AS expected")
    return pl.evaluated(c)


@query(f"""WITH RECURSIVE {PLACE_PAIRS_SQL}, two AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT id AS a, id AS b FROM p UNION SELECT r.a, t.b FROM reach r JOIN two t ON r.b = t.a),
found AS (SELECT r.a AS id, arg_min(r.b, (CASE p.source WHEN 's0' THEN -3 WHEN 's1' THEN -2 ELSE -1 END, '2024-01-' || lpad((r.b % 28 + 1)::VARCHAR, 2, '0'), r.b)) AS root FROM reach r JOIN p ON p.id = r.b GROUP BY 1),
who AS (SELECT root, CASE WHEN found.id % 3 = 0 THEN 'ann' ELSE 'guest' || found.id % 4 END AS w FROM found WHERE found.id % 5 > 0)
SELECT f.root AS id, count(*) AS n_members, coalesce((SELECT string_agg(DISTINCT w, ',' ORDER BY w) FROM who WHERE who.root = f.root), '') AS recommended_by FROM found f GROUP BY 1""")
def merged_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of members alike in weight and pin the one seen first survives; all who recommended a member recommend it."""
    p = places(spark, sf_dir).withColumns({"first_seen": F.expr("concat('2024-01-', lpad(cast(id % 28 + 1 AS string), 2, '0'))"), "recommended_by": F.expr("CASE WHEN id % 5 > 0 THEN array(CASE WHEN id % 3 = 0 THEN 'ann' ELSE concat('guest', id % 4) END) END")})
    return pl.merged_places(p, pl.resolved(p, WEIGHTS)).select("id", "n_members", F.array_join("recommended_by", ",").alias("recommended_by"))


@query(f"""WITH e AS ({EVENTS_SQL}) SELECT id, CASE WHEN id % 4 < 2 THEN 'Кино ' || id WHEN id % 2 = 0 THEN 'held' END AS title_ru, CASE WHEN id % 4 = 1 THEN 'kino' ELSE category END AS category, CASE WHEN id % 4 = 0 THEN 1 ELSE is_free END AS is_free,
  CASE id % 4 WHEN 0 THEN '[{{"label":"https://a.org/' || id || '","url":"https://a.org/' || id || '"}},{{"label":"Google Maps","url":"https://maps/' || id || '"}}]' WHEN 1 THEN 'old' ELSE 'old' END AS links_json, score,
  CASE id % 4 WHEN 0 THEN '{{"title_ru":"Кино ' || id || '","venue_name":"Hall","is_free":true,"maps_url":"https://maps/' || id || '","confidence":1.0,"model":"small","notes":"seen; ungrounded","links":[{{"label":"https://a.org/' || id || '","url":"https://a.org/' || id || '"}}],"citations":[]}}'
    WHEN 1 THEN '{{"title_ru":"Кино ' || id || '","category":"kino","confidence":0.5,"model":"own","notes":"low confidence","links":[],"citations":[{{"url":"https://c.org","supports":"category"}}]}}' ELSE 'before' END AS enrichment_json,
  CASE WHEN id % 4 < 2 THEN '2026-07-01' ELSE '2020-01-01' END AS enriched_at FROM e""")
def written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in full and answers that tell little, one that is no JSON, and events without any."""
    e = events(spark, sf_dir).withColumns({"title_ru": F.expr("CASE WHEN id % 2 = 0 THEN 'held' END"), "links_json": F.lit("old"), "enrichment_json": F.lit("before"), "enriched_at": F.lit("2020-01-01")})
    json = """CASE id % 4 WHEN 0 THEN concat('Here: {"title_ru": " Кино ', id, ' ", "venue_name": "Hall", "is_free": true, "maps_url": "https://maps/', id, '", "confidence": 7, "notes": "seen", "odd": 1, "links": [{"url": "https://a.org/', id, '"}, {"label": "x"}]} done')
        WHEN 1 THEN concat('{"title_ru": "Кино ', id, '", "category": "kino", "venue_name": " ", "confidence": "0.5", "model": "own", "citations": [{"url": "https://c.org", "supports": "category"}]}') WHEN 2 THEN 'no answer' END"""
    answers = e.where("id % 4 < 3").select("id", F.expr(json).alias("json"))
    return pl.written_back(e, answers, F.lit("2026-07-01"), "small").select("id", "title_ru", "category", "is_free", "links_json", "score", "enrichment_json", "enriched_at")
