"""Queries: exports, bakes, site maps, places in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places as place
from ..sources import pages as src
from ..sources import publish
from .bronze import sql_html
from .inputs import AS_OF, EVENTS_SQL, PLACES_SQL, events, places, table
from .registry import query

VISIBLE_SQL = f"(status IS NULL OR status = 'upcoming') AND coalesce(end_date, start_date) >= '{AS_OF}'"


@query(f"WITH e AS ({EVENTS_SQL}) SELECT id, start_date FROM e WHERE {VISIBLE_SQL} AND id >= 100")
def publishable_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.bake_events(events(spark, sf_dir), AS_OF, 100).select("id", "start_date")


def series_and_occurrences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "CASE c_custkey % 3 WHEN 0 THEN 'upcoming' WHEN 1 THEN 'duplicate' END AS status")
    return s, table(spark, sf_dir, "orders").selectExpr("o_custkey AS series_id", "o_orderkey AS id", "date_format(o_orderdate, 'yyyy-MM-dd') AS day")


@query("""WITH last AS (SELECT o_custkey AS id FROM orders GROUP BY 1 HAVING max(o_orderdate) >= DATE '2001-01-01')
SELECT c_custkey AS series_id, count(*) AS n FROM customer JOIN last ON id = c_custkey JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 3 <> 1 GROUP BY 1""")
def baked_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, occ = publish.bake_series(*series_and_occurrences(spark, sf_dir), "2001-01-01")
    return occ.groupBy("series_id").agg(F.count("*").alias("n"))


@query(f"""WITH e AS ({EVENTS_SQL}) SELECT 0::BIGINT AS leaked, 0::BIGINT AS undated, count(*) AS series, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans,
  count(*) > 0 AND (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0 AS ok FROM customer""")
def publish_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, occ = series_and_occurrences(spark, sf_dir)
    return publish.guards(publish.bake_events(events(spark, sf_dir), AS_OF), s, occ)


@query(f"""WITH e AS ({EVENTS_SQL}), p AS ({PLACES_SQL}) SELECT unnest(['/', '/places']) AS url, NULL AS last_seen, 'daily' AS changefreq, 1.0::DOUBLE AS priority
UNION ALL SELECT '/events/' || id, start_date, 'weekly', 0.7 FROM e WHERE {VISIBLE_SQL} UNION ALL SELECT '/places/' || id, '1998-01-0' || id % 9, 'monthly', 0.5 FROM p WHERE id % 4 > 1""")
def site_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir).withColumns({"url": F.expr("CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'https://x.org' END"), "last_seen": F.expr("concat('1998-01-0', id % 9)")})
    return publish.site_map(events(spark, sf_dir).withColumn("last_seen", F.col("start_date")), p, AS_OF)


STEMS = [("tion", "Tiona"), ("the", "Thebes"), ("ung", "Ungarn"), ("ment", "Menton")]


@query("""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents),
f AS (SELECT doc_id, unnest([strpos(t, 'tion'), strpos(t, 'the'), strpos(t, 'ung'), strpos(t, 'ment')]) AS p, unnest([0, 1, 2, 3]) AS i, unnest(['Tiona', 'Thebes', 'Ungarn', 'Menton']) AS city FROM t)
SELECT doc_id, coalesce(arg_min(city, (p, i)) FILTER (p > 0), 'Valencia') AS city FROM f GROUP BY 1""")
def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", place.city(F.col("text"), STEMS, "Valencia").alias("city"))


@query("""WITH t AS (SELECT doc_id, lower(string_split(text, chr(10))[1]) AS a, lower(text) AS b FROM documents)
SELECT doc_id FROM t WHERE regexp_matches(a || ' ' || b, 'tion|ung') AND (NOT regexp_matches(a || ' ' || b, 'eux') OR regexp_matches(a, 'tion|ung'))""")
def country_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.where(place.in_country(F.split("text", "\n")[0], F.col("text"), ["tion", "ung"], ["eux"])).select("doc_id")


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE 'Bar ' || c_name END AS name FROM customer")
def names_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.expr("""CASE c_custkey % 4 WHEN 0 THEN concat('https://g.x/maps/place/Bar+', replace(c_name, '#', '%23'), ',+46001+Valencia/@39.4,-0.3') WHEN 1 THEN concat('https://g.x/?q=Bar%20', replace(c_name, '#', '%23'), ',x&z=1')
        WHEN 2 THEN concat('https://g.x/maps/search/Bar+', replace(c_name, '#', '%23'), '+46001?a=1') ELSE 'https://g.x/?q=39.47,-0.37' END""")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), place.name_of_link(link).alias("name"))


@query("SELECT c_custkey AS id, 'Calle ' || c_mktsegment || ', ' || (c_custkey % 90 + 1) || ', 46001 Valencia, Spain' AS query FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 2 = 1")
def street_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE WHEN c_custkey % 2 = 0 THEN concat(c_name, ', Calle ', c_mktsegment, ', ', c_custkey % 90 + 1, ', 46001 Valencia') ELSE c_name END")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), place.street_query(text).alias("query"))


@query(rf"""WITH p0 AS (SELECT page_id, html, string_split_regex(html, '<p\b[^>]*>')[2:] AS cut FROM pages),
p AS (SELECT page_id, html, list_transform(list_filter(cut, lambda x, i: i < len(cut) OR contains(x, '</p>')), lambda x: string_split(x, '</p>')[1]) AS ps FROM p0),
t AS (SELECT page_id, html, list_filter(list_transform(ps, lambda x: trim(regexp_replace({sql_html('x')}, '\s+', ' ', 'g'))), lambda x: x <> '') AS ts FROM p)
SELECT page_id, trim(regexp_replace({sql_html("regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 'is')")}, '\s+', ' ', 'g')) AS title, length(body)::INT AS n, sha1(body) AS digest
FROM (SELECT *, nullif(array_to_string(ts, chr(10) || chr(10)), '') AS body FROM t)""")
def article_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.article(table(spark, sf_dir, "pages")).select("page_id", "title", F.length("body").alias("n"), F.sha1("body").alias("digest"))
