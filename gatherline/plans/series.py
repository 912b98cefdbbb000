"""Queries: series and occurrences, the feed that unites them with events, digests of series, the catalogue of places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import read_model as rm
from ..operators import series as sr
from ..operators.ranks import numbered
from .inputs import AS_OF, EVENTS_SQL, PLACES_SQL, events, places, table
from .read_model import FEED_SQL, SCORE_SQL, VISIBLE_SQL, feed_rows
from .registry import query

# a part is a series, its orders' customers' numbers tie occurrences to it
SERIES_SQL = f"""
SELECT p_partkey AS id, p_name || ' ' || p_brand AS title, p_brand AS venue_name, NULL::VARCHAR AS district, 'Valencia' AS city, strftime(DATE '1998-01-01' + (p_partkey % 300)::INT, '%Y-%m-%d') AS start_date,
  CASE WHEN p_partkey % 3 > 0 THEN strftime(DATE '1998-01-01' + (p_partkey % 300 + p_size)::INT, '%Y-%m-%d') END AS end_date, CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 100 END AS score,
  CASE p_partkey % 5 WHEN 0 THEN 'duplicate' WHEN 1 THEN NULL ELSE 'upcoming' END AS status, p_partkey % 2 AS notified, CASE WHEN p_partkey % 11 = 0 THEN 'Noticias' ELSE 'show' END AS category,
  CASE WHEN p_partkey % 13 = 0 THEN '1998-06-20' END AS next_occurrence FROM part"""
OCC_SQL = """
SELECT o_orderkey AS id, o_custkey AS series_id, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 4 > 0 THEN lpad((o_orderkey % 12 + 10)::VARCHAR, 2, '0') || ':00' END AS time,
  CASE o_orderkey % 6 WHEN 0 THEN 'cancelled' WHEN 1 THEN NULL ELSE 'upcoming' END AS status FROM orders"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda n: f"date_format(date_add(date'1998-01-01', cast({n} AS int)), 'yyyy-MM-dd')"
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "concat(p_name, ' ', p_brand) AS title", "p_brand AS venue_name", "cast(NULL AS string) AS district", "'Valencia' AS city", f"{day('p_partkey % 300')} AS start_date",
        f"CASE WHEN p_partkey % 3 > 0 THEN {day('p_partkey % 300 + p_size')} END AS end_date", "CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 100 END AS score",
        "CASE p_partkey % 5 WHEN 0 THEN 'duplicate' WHEN 1 THEN NULL ELSE 'upcoming' END AS status", "p_partkey % 2 AS notified", "CASE WHEN p_partkey % 11 = 0 THEN 'Noticias' ELSE 'show' END AS category",
        "CASE WHEN p_partkey % 13 = 0 THEN '1998-06-20' END AS next_occurrence", "cast(NULL AS string) AS tags_json", "cast(NULL AS string) AS enriched_at", "cast(NULL AS string) AS enrichment_json")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS series_id", "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "CASE WHEN o_orderkey % 4 > 0 THEN concat(lpad(cast(o_orderkey % 12 + 10 AS string), 2, '0'), ':00') END AS time",
        "CASE o_orderkey % 6 WHEN 0 THEN 'cancelled' WHEN 1 THEN NULL ELSE 'upcoming' END AS status")


@query(f"""WITH s AS ({SERIES_SQL}) SELECT id::VARCHAR AS hash, CASE WHEN id % 3 < 2 THEN title || '!' ELSE title END AS title, CASE WHEN id % 2 = 0 THEN score END AS score, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS first_seen,
  CASE WHEN id % 3 < 2 THEN 2 ELSE 1 END AS last_seen, CASE WHEN id % 2 = 0 THEN status ELSE 'upcoming' END AS status FROM s WHERE id % 2 = 0 OR id % 3 < 2""")
def series_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the series are held, two thirds come in again, each twice (the later draft counts): titles follow, scores stay."""
    s = series(spark, sf_dir).withColumn("hash", F.col("id").cast("string"))
    held = s.where("id % 2 = 0").select("hash", "title", "score", F.lit(1).alias("first_seen"), F.lit(1).alias("last_seen"), "status")
    new = s.where("id % 3 < 2")
    drafts = new.select("id", "hash", F.concat("title", F.lit("!")).alias("title")).unionByName(new.select((F.col("id") - 1_000_000).alias("id"), "hash", F.lit("old").alias("title")))
    return sr.upserted(held, drafts, F.lit(2))


@query(f"""WITH o AS ({OCC_SQL}), d AS (SELECT DISTINCT series_id AS series, day, time FROM o), h AS (SELECT DISTINCT series_id AS series, day, time FROM o WHERE id % 2 = 0)
SELECT d.series, d.day, d.time, CASE WHEN h.series IS NULL THEN 'upcoming' ELSE 'held' END AS status, 2 AS last_seen FROM d LEFT JOIN h ON d.series = h.series AND d.day = h.day AND d.time IS NOT DISTINCT FROM h.time""")
def occurrence_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule that comes in again adds no row that is held; sessions without a time are rows too."""
    o = occurrences(spark, sf_dir).select("id", F.col("series_id").cast("string").alias("series"), "day", "time", F.lit(None).cast("string").alias("end_time"))
    none = sr.occurrences_upserted(o.limit(0).select(F.lit("").alias("hash"), "series", "day", "time", "end_time", F.lit("held").alias("status"), F.lit(1).alias("last_seen")), o.where("id % 2 = 0"), F.lit(1))
    got = sr.occurrences_upserted(none.withColumn("status", F.lit("held")), o, F.lit(2))
    return got.select(F.col("series").cast("long").alias("series"), "day", "time", "status", "last_seen")


@query(f"""WITH e AS ({EVENTS_SQL}) SELECT id, CASE WHEN id % 3 = 0 THEN 'duplicate' ELSE status END AS status, CASE WHEN id % 3 > 0 THEN CASE WHEN id % 2 = 0 THEN '{{"x":"1","merged_into_series":"9"}}' END
  WHEN id % 2 = 0 THEN '{{"x":"1","merged_into_series":"' || id % 10 || '"}}' ELSE '{{"merged_into_series":"' || id % 10 || '"}}' END AS metadata_json FROM e""")
def superseded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("metadata_json", F.expr("""CASE WHEN id % 2 = 0 THEN '{"x":"1","merged_into_series":"9"}' END"""))
    return sr.superseded(e, e.where("id % 3 = 0").select("id", (F.col("id") % 10).alias("series"))).select("id", "status", "metadata_json")


AHEAD_SQL = f"s AS (SELECT * FROM ({SERIES_SQL}) WHERE {VISIBLE_SQL}), o AS (SELECT o.* FROM ({OCC_SQL}) o JOIN s ON s.id = o.series_id WHERE o.status IS NULL OR o.status = 'upcoming')"


@query(f"""WITH {FEED_SQL}, {AHEAD_SQL},
u AS (SELECT id, title, start_date AS day, start_time AS time, score, 0 AS n_occurrences, false AS calendar_only FROM feed
  UNION ALL SELECT 1000000000 + id, title, start_date, NULL, score, (SELECT count(*) FROM o WHERE series_id = s.id), false FROM s
  UNION ALL SELECT 2000000000 + o.id, title, day, time, score, 0, true FROM s JOIN o ON s.id = o.series_id)
SELECT *, row_number() OVER (ORDER BY coalesce(score, -1) DESC, coalesce(day, '9999-99-99'), title, id) AS place FROM u""")
def united_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, a card for each series ahead and a row for each of its sessions, in the feed's order."""
    rows = sr.feed_rows(series(spark, sf_dir), occurrences(spark, sf_dir), AS_OF)
    u = sr.united(feed_rows(spark, sf_dir), rows)
    order = {"a": -F.coalesce("score", F.lit(-1)), "b": F.coalesce("day", F.lit("9999-99-99")), "c": F.col("title"), "d": F.col("id")}
    return numbered(u.select("id", "title", "day", "time", "score", "n_occurrences", "calendar_only"), order, "place")


FULL_SQL = f"""SELECT id, CASE WHEN id % 4 = 0 THEN 'Шоу ' || id ELSE title END AS title, CASE WHEN id % 3 = 0 THEN 'Текст ' || id WHEN id % 3 = 1 THEN 'About ' || id ELSE '' END AS excerpt, venue_name || ', Valencia' AS location,
  CASE WHEN id % 5 = 0 THEN 'api:hemisferic' ELSE 'web:x' END AS source, CASE WHEN category = 'show' THEN 'развлечения' ELSE 'noticias' END AS category, CASE WHEN id % 5 = 0 THEN 'hemisferic' END AS feature, 'jazz' AS tags,
  '/events/series-' || id || '-' || CASE WHEN id % 4 = 0 THEN id::VARCHAR ELSE trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') END AS page, CASE WHEN id % 2 = 0 THEN 'https://i.org/' || id || '.jpg' END AS image, start_date, end_date, score FROM ({SERIES_SQL})"""


def full_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with descriptions, tags and pictures."""
    return series(spark, sf_dir).selectExpr("*", "CASE WHEN id % 4 = 0 THEN concat('Шоу ', id) END AS title_ru", "CASE WHEN id % 3 = 0 THEN concat('Текст ', id) END AS description_ru", "CASE WHEN id % 3 < 2 THEN concat('About ', id) END AS description",
        "CASE WHEN id % 5 = 0 THEN 'api:hemisferic' ELSE 'web:x' END AS source", "CASE WHEN id % 2 = 0 THEN concat('https://i.org/', id, '.jpg') ELSE 'no address' END AS image_url").withColumn("tags_json", F.lit('["jazz", "tg:x", "2024"]'))


@query(f"""WITH f AS ({FULL_SQL}), {AHEAD_SQL}, x AS (SELECT f.* FROM f JOIN s USING (id)), label AS (SELECT *, strftime(start_date::DATE, '%d.%m.%Y') || CASE WHEN end_date <> start_date THEN '–' || strftime(end_date::DATE, '%d.%m.%Y') ELSE '' END AS span FROM x)
SELECT 1000000000 + id AS id, title, excerpt, location, category, feature, tags, page, image, span AS date_label, start_date AS day, NULL AS time, (SELECT count(*) FROM o WHERE series_id = label.id) AS n_occurrences, false AS calendar_only FROM label
UNION ALL SELECT 2000000000 + o.id, title, excerpt, location, category, feature, tags, page, image, strftime(day::DATE, '%d.%m.%Y') || coalesce(' ' || time, ''), day, time, 0, true FROM x JOIN o ON o.series_id = x.id""")
def series_site_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards and sessions of series with all that a site shows of them."""
    rows = sr.feed_rows(full_series(spark, sf_dir), occurrences(spark, sf_dir), AS_OF)
    return rows.select("id", "title", "excerpt", "location", "category", "feature", F.array_join("tags", ",").alias("tags"), "page", "image", "date_label", "day", "time", "n_occurrences", "calendar_only")


@query(f"""WITH {FEED_SQL}, {AHEAD_SQL}, days AS (SELECT unnest(generate_series(DATE '1998-07-01', DATE '1998-07-31', INTERVAL 1 DAY))::DATE AS d),
r AS (SELECT id, title, start_date AS day, start_time AS time, false AS of_schedule FROM feed WHERE coalesce(feature, '') <> 'exposition' UNION ALL SELECT 2000000000 + o.id, title, day, time, s.id % 5 = 0 FROM s JOIN o ON o.series_id = s.id),
g AS (SELECT day, count(*) AS n, string_agg(id, ',' ORDER BY coalesce(time, '99:99'), title, id) FILTER (of_schedule) AS of_schedule, string_agg(id, ',' ORDER BY coalesce(time, '99:99'), title, id) FILTER (NOT of_schedule) AS others FROM r GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS day, ((dayofweek(d) + 6) % 7)::INT AS weekday, coalesce(n, 0) AS n, coalesce(of_schedule, '') AS of_schedule, coalesce(others, '') AS others FROM days LEFT JOIN g ON g.day = strftime(d, '%Y-%m-%d')""")
def united_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and sessions of a month by day, those of the schedule apart; cards of series and expositions are not in it."""
    s = series(spark, sf_dir).withColumn("source", F.expr("CASE WHEN id % 5 = 0 THEN 'api:hemisferic' ELSE 'web:x' END"))
    u = sr.united(feed_rows(spark, sf_dir), sr.feed_rows(s, occurrences(spark, sf_dir), AS_OF))
    return rm.calendar_split(u, "1998-07").withColumns({c: F.array_join(c, ",") for c in ("of_schedule", "others")})


@query(f"""WITH f AS ({FULL_SQL}), {AHEAD_SQL} SELECT f.id FROM f JOIN s USING (id) WHERE contains(lower(concat_ws(' ', f.title, excerpt, location, f.tags)), 'brand#1') AND contains(lower(location), 'valencia')""")
def place_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that only a place's label holds find the card too."""
    s, _ = sr.ahead(full_series(spark, sf_dir), occurrences(spark, sf_dir), AS_OF)
    return rm.search(rm.search(sr.series_cards(s), "Brand#1"), "Valencia").select("id")


@query(f"""WITH f AS ({FULL_SQL}) SELECT f.id, '{{"@context":"https://schema.org","@type":"Event","name":"' || f.title || '","url":"https://h.org/events/' || f.id || '-' || substr(page, length('/events/series-' || f.id || '-') + 1) || '","startDate":"' || f.start_date || CASE WHEN f.id % 2 = 0 THEN 'T19:30' ELSE '' END || '"'
  || CASE WHEN f.end_date IS NOT NULL THEN ',"endDate":"' || f.end_date || '"' ELSE '' END || CASE WHEN f.id % 3 = 0 THEN ',"description":"' || repeat('palabra ', 19) || 'palabra…"' ELSE '' END || coalesce(',"image":"' || image || '"', '') || ',"location":{{"@type":"Place","name":"' || venue_name || '"}}'
  || CASE f.id % 3 WHEN 0 THEN ',"offers":{{"@type":"Offer","price":"12 €","priceCurrency":"EUR"}}' WHEN 1 THEN ',"offers":{{"@type":"Offer","price":"Free"}}' ELSE '' END || '}}' AS json FROM f JOIN ({SERIES_SQL}) s USING (id)""")
def schema_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers with a currency where the price says so, descriptions cut at a word."""
    s = full_series(spark, sf_dir).withColumns({"description_ru": F.lit(None).cast("string"), "description": F.expr("CASE WHEN id % 3 = 0 THEN repeat('palabra ', 40) END"), "start_time": F.expr("CASE WHEN id % 2 = 0 THEN '19:30' END")})
    s = s.withColumn("price", F.expr("CASE id % 3 WHEN 0 THEN '12 €' WHEN 1 THEN 'Free' END"))
    return rm.described(s, "https://h.org")


@query(f"""WITH {FEED_SQL}, p AS ({PLACES_SQL})
SELECT (SELECT count(*) FROM feed) AS events, (SELECT count(*) FROM feed WHERE id % 3 = 0 AND id % 5 > 0) AS mapped_events, (SELECT count(*) FROM p) AS places, (SELECT count(*) FROM p WHERE lat IS NOT NULL) AS mapped_places,
  (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM feed UNION ALL SELECT lower(category) FROM p WHERE category IS NOT NULL)) AS tags""")
def site_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the events have a latitude, a fifth of those no longitude."""
    e = events(spark, sf_dir).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 39.5D END AS lat", "CASE WHEN id % 5 > 0 THEN -0.4D END AS lng")
    return rm.stats(feed_rows(spark, sf_dir), e, places(spark, sf_dir).withColumn("tags", F.array_compact(F.array(F.lower("category")))))


@query(f"""WITH e AS ({EVENTS_SQL}), s AS (SELECT *, substr(sha1(lower(regexp_replace(title, '[^a-zA-Z0-9 ]', '', 'g')) || '|' || lower(replace(venue_name, '#', '')) || '|' || source), 1, 16) AS series FROM e),
g AS (SELECT series, arg_min(title, id) AS title, min(start_date) AS start_date, max(start_date) AS end_date, max(score) AS score, min(id) FILTER (id % 3 = 0) AS i, min(id) FILTER (id % 2 = 0) AS d FROM s GROUP BY 1),
h AS (SELECT series, series[1] IN ('0', '1', '2', '3') AS held, series[2] < '8' AS scored FROM g)
SELECT series, CASE WHEN held THEN 'held' ELSE title END AS title, start_date, end_date, CASE WHEN held AND scored THEN 7 ELSE score END AS score, CASE WHEN held AND scored THEN 'own.jpg' WHEN i IS NOT NULL THEN i || '.jpg' END AS image_url, CASE WHEN d IS NOT NULL THEN 'About ' || d END AS description FROM g JOIN h USING (series)""")
def folded_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions fold into series of which some are held: days follow, names stay, scores, images and descriptions are filled in where there are none."""
    e = events(spark, sf_dir).withColumns({"image_url": F.expr("CASE WHEN id % 3 = 0 THEN concat(id, '.jpg') ELSE '' END"), "description": F.expr("CASE WHEN id % 2 = 0 THEN concat('About ', id) END")})
    empty = rm.fold_series(e).select("series", F.lit("held").alias("title"), F.lit("1990-01-01").alias("start_date"), F.lit("1990-01-01").alias("end_date"), F.expr("CASE WHEN substring(series, 2, 1) < '8' THEN 7 END").alias("score"),
        F.expr("CASE WHEN substring(series, 2, 1) < '8' THEN 'own.jpg' END").alias("image_url"), F.lit("").alias("description"))
    return rm.folded_into(empty.where("substring(series, 1, 1) IN ('0', '1', '2', '3')"), e)


@query(f"""WITH p AS ({PLACES_SQL}) SELECT id, '["' || array_to_string(list_sort(list_distinct(list_filter(['place', 'area:' || area, lower(category), source, 'mapped', 'coffee'], lambda x: x IS NOT NULL))), '","') || '"]' AS tags_json FROM p""")
def retagged_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.places_retagged(places(spark, sf_dir).withColumn("tags_json", F.lit("old"))).select("id", "tags_json")


DUE_SQL = f"""n AS (SELECT series_id, min(day) AS next_day FROM ({OCC_SQL}) WHERE day >= '{AS_OF}' AND coalesce(status, '') <> 'cancelled' GROUP BY 1),
due AS (SELECT id, coalesce(next_occurrence, next_day, start_date) AS start_date FROM ({SERIES_SQL}) LEFT JOIN n ON series_id = id WHERE notified = 0 AND status = 'upcoming' AND score >= 55 AND category <> 'Noticias')"""


@query(f"WITH {DUE_SQL} SELECT * FROM due WHERE start_date BETWEEN '{AS_OF}' AND strftime(DATE '{AS_OF}' + 21, '%Y-%m-%d')")
def series_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.due_in_digest(series(spark, sf_dir), occurrences(spark, sf_dir), AS_OF, rm.fixed.DIGEST_DAYS, rm.fixed.DIGEST_SCORE).select("id", "start_date")


# a sixth of the events' categories, and a fifth of their tags, hold a stem that keeps them out
OUT_SQL = f"SELECT *, CASE WHEN id % 6 = 0 THEN 'SpainNews' ELSE category END AS cat, id % 5 = 0 AS bad_tag, id % 2 AS notified FROM ({EVENTS_SQL})"


def with_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("notified", F.col("id") % 2)
    return e.withColumns({"category": F.expr("CASE WHEN id % 6 = 0 THEN 'SpainNews' ELSE category END"), "tags_json": F.expr("""CASE WHEN id % 5 = 0 THEN '["fun","Política local"]' ELSE tags_json END"""),
        "enriched_at": F.lit(None).cast("string"), "enrichment_json": F.lit(None).cast("string")})


FIT_SQL = f"fit AS (SELECT * FROM ({OUT_SQL}) WHERE notified = 0 AND status = 'upcoming' AND id % 6 > 0 AND NOT bad_tag)"


@query(f"""WITH {FIT_SQL}, {DUE_SQL}, p AS ({PLACES_SQL})
SELECT 'event' AS kind, id, start_date AS day FROM fit WHERE score >= 55 AND start_date BETWEEN '{AS_OF}' AND strftime(DATE '{AS_OF}' + 21, '%Y-%m-%d')
UNION ALL SELECT 'series', * FROM due WHERE start_date BETWEEN '{AS_OF}' AND strftime(DATE '{AS_OF}' + 21, '%Y-%m-%d') UNION ALL SELECT 'place', id, NULL FROM p WHERE id % 9 = 0""")
def weekly_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir).withColumn("notified", F.expr("cast(id % 9 > 0 AS int)"))
    return sr.payload("weekly", with_news(spark, sf_dir), series(spark, sf_dir), occurrences(spark, sf_dir), p, AS_OF)


@query(f"WITH {FIT_SQL} SELECT 'event' AS kind, id, start_date AS day FROM fit WHERE score >= 85")
def alert_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir).withColumn("notified", F.lit(0))
    return sr.payload("alert", with_news(spark, sf_dir), series(spark, sf_dir), occurrences(spark, sf_dir), p, AS_OF)


@query(f"WITH e AS ({EVENTS_SQL}) SELECT id, CASE WHEN end_date IS NULL OR end_date::DATE - DATE '{AS_OF}' > 365 THEN 'permanent' ELSE 'until ' || strftime(end_date::DATE, '%-d %b') END AS badge FROM e")
def exposition_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("id", sr.badge(F.col("end_date"), AS_OF).alias("badge"))


@query(f"""WITH p AS ({PLACES_SQL}) SELECT id, name, area || ', Old, Valencia' AS location, '/places/' || id || '-' || replace(lower(name), ' ', '-') AS page FROM p
WHERE category = 'MACHINERY' AND area = 'area3' AND contains(lower(name), 'cafe machinery')""")
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a category and an area that hold words."""
    p = places(spark, sf_dir).withColumns({"district": F.lit("Old"), "city": F.lit("Valencia"), "description": F.lit(None).cast("string"), "last_seen": F.col("id") % 5, "tags": F.array(F.lit("place"))})
    return sr.catalogue(p, "MACHINERY", "area3", "place", "Cafe MACHINERY").select("id", "name", "location", "page")


@query(f"WITH e AS ({EVENTS_SQL}) SELECT id, title, score FROM e WHERE id = (SELECT max(o_orderkey) FROM orders WHERE o_custkey IN (SELECT p_partkey FROM part))")
def event_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return sr.by_id(e, e.agg(F.max("id")).first()[0]).select("id", "title", "score")


@query(f"WITH e AS ({EVENTS_SQL}), {SCORE_SQL} SELECT id, CASE WHEN status IS NULL OR status = 'upcoming' THEN points ELSE score END AS score FROM sc")
def rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.rescored(events(spark, sf_dir), AS_OF).select("id", "score")


@query(f"""WITH e AS ({EVENTS_SQL}), slugs AS (SELECT *, regexp_replace(lower(trim(category)), '[^a-z0-9]+', '-', 'g') AS cat FROM e)
SELECT id, '["' || array_to_string(list_sort(list_distinct(list_filter([
  'event', cat, language, audience, source, 'city:' || regexp_replace(lower(city), '[^a-z0-9]+', '-', 'g'), CASE WHEN is_free = 1 THEN 'free' END, CASE WHEN start_time IS NOT NULL THEN 'timed' END,
  CASE WHEN score >= 80 THEN 'top-pick' END, CASE WHEN lower(title) LIKE '%festival%' THEN 'music' END], lambda x: x IS NOT NULL))), '","') || '"]' AS tags_json FROM slugs""")
def retagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.retagged(events(spark, sf_dir)).select("id", "tags_json")
