"""Queries: scores, tags, feed, calendars, facets, series and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import read_model as rm
from .inputs import AS_OF, EVENTS_SQL, PLACES_SQL, events, places
from .registry import query

MONTH = AS_OF[:7]


def synonyms_sql(col: str) -> str:
    rows = ", ".join(f"('{a}', '{b}')" for a, b in fixed.CATEGORY_SYNONYMS.items())
    return f"(SELECT max(b) FROM (VALUES {rows}) s(a, b) WHERE a = {col})"


CATEGORY_SQL = f"""
raw AS (SELECT *, lower(trim(coalesce(category, ''))) AS ckey FROM e),
cats AS (SELECT k, coalesce({synonyms_sql('k')}, CASE WHEN length(k) > 4 THEN {synonyms_sql("regexp_replace(k, '[ыи]$', '')")} END, k) AS canon FROM (SELECT DISTINCT ckey AS k FROM raw)),
ev AS (SELECT raw.*, canon, [w FOR w IN from_json(tags_json, '["VARCHAR"]')] AS tags0 FROM raw JOIN cats ON k = ckey)"""
VISIBLE_SQL = f"(status IS NULL OR status = 'upcoming') AND (start_date IS NULL OR coalesce(end_date, start_date) >= '{AS_OF}')"
EXPO_SQL = "coalesce((end_date::DATE - start_date::DATE) >= 4 AND lower(category) = 'culture', false)"
FEATURE_SQL = f"CASE WHEN lower(category) = 'excursion' THEN 'excursion' WHEN lower(category) = 'festival' THEN 'festival' WHEN {EXPO_SQL} THEN 'exposition' END"
# of the tags that the projection makes, numbers and city names are noise
CLEAN_SQL = "list_filter(tags0, lambda t: NOT regexp_full_match(t, '[0-9]+') AND NOT starts_with(t, 'city-'))"
FEED_SQL = f"e AS ({EVENTS_SQL}), {CATEGORY_SQL}, feed AS (SELECT *, {CLEAN_SQL} AS tags, {FEATURE_SQL} AS feature FROM ev WHERE {VISIBLE_SQL})"
SCORE_SQL = f"""
sc AS (SELECT *, greatest(0, least(100,
  CASE source_weight WHEN 'gold' THEN 18 WHEN 'good' THEN 10 WHEN 'mine' THEN 3 WHEN 'off' THEN -20 ELSE 0 END
  + CASE language WHEN 'ru' THEN 26 WHEN 'es' THEN 6 WHEN 'en' THEN 5 ELSE 0 END + CASE category WHEN 'festival' THEN 18 ELSE 0 END + 1
  + CASE audience WHEN 'family' THEN 10 WHEN 'adult' THEN 4 ELSE 0 END
  + CASE WHEN d < 0 THEN -40 WHEN d <= 7 THEN 20 WHEN d <= 21 THEN 16 WHEN d <= 45 THEN 10 WHEN d <= 90 THEN 4 ELSE -6 END
  - CASE WHEN run >= 120 THEN 26 WHEN run >= 45 THEN 12 ELSE 0 END + CASE WHEN lower(title) LIKE '%festival%' THEN 4 ELSE 0 END + CASE is_free WHEN 1 THEN 4 ELSE 0 END))::INT AS points
  FROM (SELECT *, start_date::DATE - DATE '{AS_OF}' AS d, coalesce(greatest(end_date::DATE - start_date::DATE, 0), 0) AS run FROM e))"""


def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rm.feed(events(spark, sf_dir), AS_OF)


@query(f"WITH e AS ({EVENTS_SQL}), {SCORE_SQL} SELECT id, points AS score FROM sc")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("id", rm.score(AS_OF).alias("score"))


@query(f"""WITH e AS ({EVENTS_SQL}), slugs AS (SELECT *, regexp_replace(lower(trim(category)), '[^a-z0-9]+', '-', 'g') AS cat FROM e)
SELECT id, array_to_string(list_sort(list_distinct(list_filter([
  'event', cat, language, audience, source, 'city:' || regexp_replace(lower(city), '[^a-z0-9]+', '-', 'g'), CASE WHEN is_free = 1 THEN 'free' END, CASE WHEN start_time IS NOT NULL THEN 'timed' END,
  CASE WHEN score >= 80 THEN 'top-pick' END, CASE WHEN lower(title) LIKE '%festival%' THEN 'music' END], lambda x: x IS NOT NULL))), ',') AS tags FROM slugs""")
def event_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("id", F.array_join(rm.event_tags(e), ",").alias("tags"))


@query(f"""WITH p AS ({PLACES_SQL}) SELECT id, array_to_string(list_sort(list_distinct(list_filter(['place', lower(category), source, 'area:' || area, 'mapped', 'coffee'], lambda x: x IS NOT NULL))), ',') AS tags FROM p""")
def place_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    return p.select("id", F.array_join(rm.place_tags(p), ",").alias("tags"))


@query(f"""WITH {FEED_SQL} SELECT id, title, title AS excerpt,
  strftime(start_date::DATE, '%d.%m.%Y') || CASE WHEN end_date <> start_date THEN '–' || strftime(end_date::DATE, '%d.%m.%Y') ELSE '' END || CASE WHEN start_time IS NOT NULL THEN ' ' || start_time ELSE '' END AS date_label,
  canon AS category, feature, array_to_string(tags, ',') AS tags,
  '/events/' || id || '-' || regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS page, start_date AS day, start_time AS time, score FROM feed""")
def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feed_rows(spark, sf_dir)
    return f.select("id", "title", "excerpt", "date_label", "category", "feature", F.array_join("tags", ",").alias("tags"), "page", "day", "time", "score")


@query(f"WITH {FEED_SQL} SELECT id, row_number() OVER (ORDER BY coalesce(score, -1) DESC, start_date, title, id)::INT AS place FROM feed QUALIFY place > 30 AND place <= 60")
def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rm.page(feed_rows(spark, sf_dir), 1).select("id", "place")


@query(f"WITH {FEED_SQL} SELECT id FROM feed WHERE lower(concat_ws(' ', title, title, city, array_to_string(tags, ' '))) LIKE '%widget%' AND list_contains(tags, 'machinery') AND canon = 'фестиваль'")
def feed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rm.search(feed_rows(spark, sf_dir), "Widget", "machinery", "festival").select("id")


@query(f"""WITH {FEED_SQL}, p AS ({PLACES_SQL})
SELECT (SELECT count(*) FROM feed) AS events, (SELECT count(*) FROM p) AS places, (SELECT count(*) FROM p WHERE lat IS NOT NULL) AS mapped_places,
  (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM feed UNION ALL SELECT lower(category) FROM p WHERE category IS NOT NULL)) AS tags""")
def feed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, p = feed_rows(spark, sf_dir), places(spark, sf_dir)
    tags = rm.tag_counts(f, p.select(F.array_compact(F.array(F.lower("category"))).alias("tags"))).agg(F.count("*").alias("tags"))
    one = f.agg(F.count("*").alias("events")).join(p.agg(F.count("*").alias("places"), F.count("lat").alias("mapped_places")))
    return one.join(tags)


@query(f"""WITH {FEED_SQL}, m AS (SELECT DISTINCT start_date[1:7] AS month FROM feed)
SELECT month, month = coalesce((SELECT min(month) FROM m WHERE month >= '{MONTH}'), (SELECT max(month) FROM m)) AS is_default FROM m""")
def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rm.months(feed_rows(spark, sf_dir), AS_OF)


@query(f"WITH {FEED_SQL} SELECT t AS tag, count(*) AS n FROM (SELECT unnest(tags) AS t FROM feed) GROUP BY t ORDER BY n DESC, tag LIMIT 18")
def top_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rm.top(rm.tag_counts(feed_rows(spark, sf_dir)), 18, "tag")


CLOUD_SQL = f"""{FEED_SQL}, p AS ({PLACES_SQL}),
cloud AS (SELECT t AS tag, count(*) AS n FROM (SELECT unnest(tags) AS t FROM feed UNION ALL SELECT lower(category) FROM p WHERE category IS NOT NULL) GROUP BY t ORDER BY n DESC, tag LIMIT 36)"""


@query(f"""WITH {CLOUD_SQL}, w AS (SELECT tag, n, CASE WHEN max(n) OVER () = min(n) OVER () THEN 1.0 ELSE 0.82 + (n - min(n) OVER ())::DOUBLE / (max(n) OVER () - min(n) OVER ()) * 0.38 END AS s FROM cloud)
SELECT tag, n, round(s::DOUBLE, 4) AS size, CASE WHEN round(s::DOUBLE, 4) > 1.08 THEN 800 WHEN round(s::DOUBLE, 4) > 0.95 THEN 700 ELSE 500 END AS weight FROM w""")
def tag_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir).select(F.array_compact(F.array(F.lower("category"))).alias("tags"))
    return rm.weighed(rm.top(rm.tag_counts(feed_rows(spark, sf_dir), p), 36, "tag"))


@query(f"WITH {FEED_SQL} SELECT canon AS category, count(*) AS n FROM feed WHERE canon <> '' GROUP BY 1 ORDER BY n DESC, category LIMIT 14")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = feed_rows(spark, sf_dir).where("category <> ''").groupBy("category").agg(F.count("*").alias("n"))
    return rm.top(counts, 14, "category")


@query(f"""WITH {FEED_SQL}, days AS (SELECT unnest(generate_series(DATE '{MONTH}-01', last_day(DATE '{MONTH}-01'), INTERVAL 1 DAY))::DATE AS d)
SELECT strftime(d, '%Y-%m-%d') AS day, ((dayofweek(d) + 6) % 7)::INT AS weekday, count(id) AS n, coalesce(string_agg(id, ',' ORDER BY coalesce(start_time, '99:99'), title, id), '') AS ids
FROM days LEFT JOIN feed ON start_date = strftime(d, '%Y-%m-%d') AND coalesce(feature, '') <> 'exposition' GROUP BY d""")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rm.calendar(feed_rows(spark, sf_dir), MONTH).withColumn("ids", F.array_join("ids", ","))


@query(f"""WITH {FEED_SQL} SELECT id, title, start_date AS day, end_date, (coalesce(end_date, start_date)::DATE - start_date::DATE)::INT AS span FROM feed
WHERE feature = 'exposition' AND start_date <= strftime(last_day(DATE '{MONTH}-01'), '%Y-%m-%d') AND coalesce(end_date, start_date) >= '{MONTH}-01'""")
def exposition_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rm.strip(feed_rows(spark, sf_dir), MONTH)


@query(f"WITH p AS ({PLACES_SQL}) SELECT 'category' AS facet, category AS value, count(*) AS n FROM p WHERE category IS NOT NULL GROUP BY 2 UNION ALL SELECT 'area', area, count(*) FROM p GROUP BY 2")
def place_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    one = lambda c: p.where(F.col(c).isNotNull()).groupBy(F.lit(c).alias("facet"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return one("category").unionByName(one("area"))


@query(f"""WITH e AS ({EVENTS_SQL}) SELECT id, '{{"@type":"Event","name":"' || title || '","startDate":"' || start_date || '"' || CASE WHEN end_date IS NOT NULL THEN ',"endDate":"' || end_date || '"' ELSE '' END
  || ',"location":{{"name":"' || venue_name || '","address":"' || city || '"}}' || CASE WHEN url IS NOT NULL THEN ',"url":"' || url || '"' ELSE '' END || '}}' AS json FROM e""")
def event_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rm.detail(events(spark, sf_dir))


@query(f"""WITH e AS ({EVENTS_SQL}) SELECT substr(sha1(lower(regexp_replace(title, '[^a-zA-Z0-9 ]', '', 'g')) || '|' || lower(replace(venue_name, '#', '')) || '|' || source), 1, 16) AS series,
  min(title) AS title, min(start_date) AS start_date, max(start_date) AS end_date, max(score) AS score, count(*) AS n FROM e GROUP BY 1""")
def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rm.fold_series(events(spark, sf_dir))


@query(f"""WITH e AS ({EVENTS_SQL}) SELECT substr(sha1(lower(regexp_replace(title, '[^a-zA-Z0-9 ]', '', 'g')) || '|' || lower(replace(venue_name, '#', '')) || '|' || source), 1, 16) AS series,
  min(start_date) AS next_day, count(*) AS n_ahead FROM e WHERE start_date >= '{AS_OF}' GROUP BY 1""")
def next_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rm.next_occurrence(rm.occurrences(events(spark, sf_dir)), AS_OF)


@query(f"""WITH e AS ({EVENTS_SQL}), o AS (SELECT DISTINCT substr(sha1(lower(regexp_replace(title, '[^a-zA-Z0-9 ]', '', 'g')) || '|' || lower(replace(venue_name, '#', '')) || '|' || source), 1, 16) AS series, start_date AS day, start_time AS time FROM e)
SELECT series, count(*)::INT AS n, '[' || string_agg('{{"day":"' || day || '"' || CASE WHEN time IS NOT NULL THEN ',"time":"' || time || '"' ELSE '' END || '}}', ',' ORDER BY day, time NULLS FIRST) || ']' AS slots FROM o GROUP BY 1""")
def series_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rm.schedule(rm.occurrences(events(spark, sf_dir)))
    return s.select("series", F.size("slots").alias("n"), F.to_json("slots").alias("slots"))


ENRICHED = "CASE WHEN id % 3 = 0 THEN '2024-01-01' END AS enriched_at, CASE WHEN id % 3 = 0 THEN '{\"confidence\": ' || (id % 10) / 10.0 || '}' END AS enrichment_json"


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("status IS NULL OR status = 'upcoming'")
    at = F.when(F.col("id") % 3 == 0, "2024-01-01")
    body = F.when(F.col("id") % 3 == 0, F.to_json(F.struct((F.col("id") % 10 / 10).alias("confidence"))))
    return e.withColumn("enriched_at", at).withColumn("enrichment_json", body)


GATE_SQL = "(id % 3 > 0 OR id % 10 >= 6) AND (status IS NULL OR status = 'upcoming')"


@query(f"WITH e AS ({EVENTS_SQL}) SELECT id, score, start_date FROM e WHERE {GATE_SQL} AND score >= 55 AND start_date BETWEEN '{AS_OF}' AND strftime(DATE '{AS_OF}' + 21, '%Y-%m-%d')")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rm.digest(enriched(spark, sf_dir), AS_OF).select("id", "score", "start_date")


@query(f"WITH e AS ({EVENTS_SQL}) SELECT id, score FROM e WHERE {GATE_SQL} AND score >= 85")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rm.alerts(enriched(spark, sf_dir)).select("id", "score")


@query(f"""WITH e AS ({EVENTS_SQL}) SELECT start_date AS day, count(*) AS n, string_agg('• ' || title || ' — ' || city, chr(10) ORDER BY score DESC, id DESC) AS body FROM e
WHERE {GATE_SQL} AND score >= 55 AND start_date BETWEEN '{AS_OF}' AND strftime(DATE '{AS_OF}' + 21, '%Y-%m-%d') GROUP BY 1""")
def digest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rm.rendered(rm.digest(enriched(spark, sf_dir), AS_OF))


@query(f"WITH e AS ({EVENTS_SQL}) SELECT id FROM e WHERE {GATE_SQL} AND score >= 55 AND id % 2 = 1 AND start_date BETWEEN '{AS_OF}' AND strftime(DATE '{AS_OF}' + 21, '%Y-%m-%d')")
def digest_after_sending(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = enriched(spark, sf_dir)
    return rm.digest(e, AS_OF, e.where("id % 2 = 0").select("id")).select("id")


@query(f"WITH e AS ({EVENTS_SQL}), {CATEGORY_SQL} SELECT id, canon AS category FROM ev")
def canonical_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("id", text.category(F.col("category")).alias("category"))
