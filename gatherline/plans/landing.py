"""Queries: pages of chats and listings that are composed from columns, what is new in them, and what readers get of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import operations as ops
from ..operators import read_model as rm
from ..operators import series as sr
from ..sources import pages as src
from ..sources import publish
from .gates import SOURCES, sources
from .inputs import AS_OF, EVENTS_SQL, PLACES_SQL, RUNS_SQL, events, places, runs, table
from .registry import query
from .series import DUE_SQL, OUT_SQL, SERIES_SQL, occurrences, series, with_news

SAID = "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, md5(coalesce(text, '')) AS t FROM conversations"


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n", "md5(coalesce(text, '')) AS t")


@query(f"""WITH s AS ({SAID}) SELECT conv_id * 1000 + n AS page_id, conv_id * 1000 + n AS post_id, 'Post ' || t || chr(10) || '#go #c' || conv_id || ' #go' AS text, 'https://cdn4.telesco.pe/' || n || '.jpg' AS photos,
  CASE WHEN n % 2 = 0 THEN 'https://x.org/?a=1&b=' || n || '|https://maps.app.goo.gl/' || n ELSE 'https://x.org/?a=1&b=' || n END AS links, CASE WHEN n % 2 = 0 THEN 'https://maps.app.goo.gl/' || n END AS maps_url, 'go,c' || conv_id AS hashtags FROM s""")
def embedded_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that embed a post each: text with line breaks and hashtags, photos among emoji, links in and out of the service."""
    html = F.expr("""concat('<a href="https://t.me/chan/', conv_id * 1000 + n, '?embed=1">x</a><i style="background-image:url(\\'https://t.me/emoji/1.png\\')"></i><i style="background-image:url(\\'https://cdn4.telesco.pe/', n, '.jpg\\')"></i><i style="background-image:url(\\'https://cdn4.telesco.pe/', n, '.jpg\\')"></i>',
        '<div class="tgme_widget_message_text js" dir="auto">Post ', t, '<br/>#go #c', conv_id, ' #go<a href="https://x.org/?a=1&amp;b=', n, '"></a></div><div class="tgme_widget_message_footer">', CASE WHEN n % 2 = 0 THEN concat('<a href="https://maps.app.goo.gl/', n, '">map</a>') ELSE '' END, '</div>')""")
    e = src.embedded(said(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("n")).alias("page_id"), html.alias("html")))
    return e.select("page_id", "post_id", "text", F.array_join("photos", "|").alias("photos"), F.array_join("links", "|").alias("links"), "maps_url", F.array_join("hashtags", ",").alias("hashtags"))


CHAT = """'<div class="message" data-post="chan/', conv_id, '-', n, '"><img src="https://cdn.x.org/', n, '.jpg"><img src="https://cdn.x.org/', n, '.jpg"><div class="text" dir="auto">Said ', t, '<br>and &amp; more</div>', CASE WHEN n % 3 = 0 THEN concat('<span class="message_date x"> <a href="https://t.me/own/', n, '?a=1&amp;b=2">') ELSE '<span><a href="https://t.me/else">' END, '<time datetime="1998-01-01T00:00:', lpad(cast(n % 60 AS string), 2, '0'), '"></time></a></span></div>'"""


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each conversation, with a block for each message, and a page of links for each supplier."""
    c = said(spark, sf_dir).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.expr(f"concat({CHAT})").alias("b")))), lambda x: x["b"]), "\n").alias("html"))
    c = c.select(F.col("conv_id").alias("page_id"), F.lit("https://t.me/s/chan").alias("url"), "html")
    s = table(spark, sf_dir, "supplier").selectExpr("-1 - s_suppkey AS page_id", "'https://x.org/list' AS url", "concat('<a href=\"/show-', s_suppkey, '\">A show of the year ', s_suppkey, '</a>') AS html")
    return c.unionByName(s)


@query(f"""WITH s AS ({SAID}) SELECT conv_id AS page_id, 'chan/' || conv_id || '-' || n AS ref, n::INT AS place, 'Said ' || t || chr(10) || 'and & more' AS text, '1998-01-01T00:00:' || lpad((n % 60)::VARCHAR, 2, '0') AS published_at, 'https://cdn.x.org/' || n || '.jpg' AS media,
  'Said ' || t || '<br>and &amp; more' AS html, CASE WHEN n % 3 = 0 THEN 'https://t.me/own/' || n || '?a=1&b=2' ELSE 'https://t.me/chan/' || conv_id || '-' || n END AS url FROM s""")
def page_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.posts(chats(spark, sf_dir)).withColumn("media", F.array_join("media", ","))


@query(f"""WITH s AS ({SAID}) SELECT conv_id AS page_id, 'chan/' || conv_id || '-' || n AS url, 'Said ' || t || chr(10) || 'and & more' AS title FROM s UNION ALL SELECT -1 - s_suppkey, 'https://x.org/show-' || s_suppkey, 'A show of the year ' || s_suppkey FROM supplier""")
def posts_or_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.posts_or_cards(chats(spark, sf_dir))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer: its orders' events by link, among links of navigation and to other hosts."""
    one = F.expr("concat('<a href=\"/agenda\">Agenda</a><a href=\"https://y.org/big-show-here\">Elsewhere</a><a class=\"x\" href=\"/events/big-show-', o_orderkey, '?a=1\"><b>Big show ', o_orderkey, '</b></a><a href=\"/events/big-show-', o_orderkey, '?a=1\">again and again</a>')")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("h")))), lambda x: x["h"]), " ").alias("html"))
    return o.select(F.col("o_custkey").alias("page_id"), F.lit("https://x.org/events").alias("url"), "html")


@query("SELECT o_custkey AS page_id, 'https://x.org/events/big-show-' || o_orderkey || '?a=1' AS url, 'Big show ' || o_orderkey AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS place FROM orders")
def detail_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.detail_links(listings(spark, sf_dir))


@query("""WITH l AS (SELECT 'https://x.org/events/big-show-' || o_orderkey || '?a=1' AS url, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)
SELECT url FROM l WHERE k % 3 > 0 ORDER BY place, url LIMIT 60""")
def new_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work list of a run: the first sixty links that are not held yet (a third is)."""
    held = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").selectExpr("concat('https://x.org/events/big-show-', o_orderkey, '?a=1') AS url")
    return src.new_details(src.detail_links(listings(spark, sf_dir)), held).select("url")


@query("SELECT doc_id, sha1(text || 'a' || chr(9) || 'b') AS digest FROM documents")
def clean_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls and code points that are no characters, put into each text, are gone from it; tabs and line feeds stay."""
    dirty = F.concat(F.lit("\u0001"), "text", F.lit("a\u0000\u0008\u009f\u007f﷐￾\tb"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(text.clean_controls(dirty)).alias("digest"))


@query("""WITH h AS (SELECT o_orderkey AS id, 'h' || o_orderkey AS hash, 'held' AS file FROM orders WHERE o_orderkey % 2 = 0),
s AS (SELECT o_orderkey AS id, 'h' || (CASE WHEN o_orderkey % 10 = 1 THEN o_orderkey + 1 ELSE o_orderkey END) AS hash FROM orders)
SELECT * FROM h UNION ALL SELECT id, hash, 'a' FROM s WHERE id % 2 = 1 AND hash NOT IN (SELECT hash FROM h)""")
def seeded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two files of seeds the first counts; seeds whose id or hash is held stay out."""
    o = table(spark, sf_dir, "orders")
    held = o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS id", "concat('h', o_orderkey) AS hash", "'held' AS file")
    seeds = o.selectExpr("o_orderkey AS id", "concat('h', CASE WHEN o_orderkey % 10 = 1 THEN o_orderkey + 1 ELSE o_orderkey END) AS hash", "explode(array('b', 'a')) AS file")
    return src.seeded(held, seeds)


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderdate::DATE AS d FROM orders)
SELECT id, strftime(CASE id % 4 WHEN 0 THEN d + 30 WHEN 1 THEN CASE WHEN year(d - 20) < year(d) THEN d - 20 + INTERVAL 1 YEAR ELSE d - 20 END WHEN 2 THEN d WHEN 3 THEN DATE '2001-03-05' END, '%Y-%m-%d') AS start_date FROM o""")
def anchored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without a year against the day a post was published, else seen: some weeks ahead, some weeks back (not rolled into the next year; in January, such a day is of December to come), the day itself, and a day with its year."""
    day = "concat(day({0}), ' ', element_at(array('enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'), month({0})))"
    post = f"CASE id % 4 WHEN 0 THEN {day.format('date_add(d, 30)')} WHEN 1 THEN {day.format('date_sub(d, 20)')} WHEN 2 THEN {day.format('d')} ELSE '5 marzo 2001' END"
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "cast(o_orderdate AS date) AS d").withColumn("post", F.expr(post))
    published, first, last = F.expr("CASE WHEN id % 3 = 0 THEN concat(cast(d AS string), 'T10:00:00') END"), F.expr("CASE WHEN id % 3 < 2 THEN cast(d AS string) END"), F.expr("cast(d AS string)")
    return o.select("id", dates.anchored_date(F.col("post"), published, first, last).alias("start_date"))


@query(f"""WITH e AS ({EVENTS_SQL}) SELECT 'event' AS entity_type, id AS entity_id FROM e WHERE id % 3 = 0 UNION ALL SELECT 'place', c_custkey FROM customer""")
def sent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = publish.sent_log(events(spark, sf_dir).where("id % 3 = 0"), "event", "1998-06-15 08:00:00").unionByName(publish.sent_log(places(spark, sf_dir), "place", "1998-06-15 08:00:00"))
    return log.where("sent_at = timestamp'1998-06-15 08:00:00'").select("entity_type", "entity_id")


@query(f"""WITH r AS ({RUNS_SQL}) SELECT source_key, run_id, CASE WHEN run_id % 9 = 0 THEN 304 WHEN status = 'error' THEN 500 ELSE 200 END AS http, CASE WHEN status = 'error' THEN 0 ELSE new_items * 2 END AS n_items,
  CASE WHEN status = 'error' THEN 'error' WHEN run_id % 9 = 0 THEN 'not_modified' WHEN new_items > 0 THEN 'changed' ELSE 'unchanged' END AS status, new_items > 0 AS changed, CASE WHEN status = 'error' THEN repeat('no-', 66) || 'no' END AS notes FROM r""")
def poll_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = runs(spark, sf_dir).selectExpr("source_key", "run_id", "CASE WHEN run_id % 9 = 0 THEN 304 WHEN status = 'error' THEN 500 ELSE 200 END AS http", "CASE WHEN status <> 'error' THEN new_items * 2 END AS n_items", "new_items AS n_new", "CASE WHEN status = 'error' THEN repeat('no-', 100) END AS error")
    return src.polled(p)


@query(f"""WITH e AS ({EVENTS_SQL}) SELECT id, CASE WHEN id % 4 = 0 THEN 'Русское ' || id ELSE title END AS title, CASE id % 3 WHEN 0 THEN 'По-русски' WHEN 1 THEN 'About' ELSE 'Raw' END AS excerpt, venue_name || ', ' || city AS location,
  CASE WHEN id % 2 = 0 THEN 'https://img.x.org/a.jpg' END AS image, coalesce((end_date::DATE - start_date::DATE) >= 4 AND lower(category) = 'culture', false) AS is_exposition FROM e""")
def site_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"title": F.expr("CASE WHEN id % 4 = 0 THEN title ELSE concat('👉 ', title) END"), "title_ru": F.expr("CASE id % 4 WHEN 0 THEN concat('Русское ', id) WHEN 1 THEN ' ' END"), "description_ru": F.expr("CASE WHEN id % 3 = 0 THEN 'По-русски' ELSE '' END"),
        "description": F.expr("CASE WHEN id % 3 = 1 THEN ' About ' END"), "raw_excerpt": F.lit("Raw"), "district": F.lit(""), "image_url": F.expr("CASE WHEN id % 2 = 0 THEN 'https://img.x.org/a.jpg' ELSE 'https://cdn4.telesco.pe/a.jpg' END")})
    return rm.site_cards(e).select("id", "title", "excerpt", "location", "image", "is_exposition")


@query(f"""WITH f AS (SELECT * FROM ({OUT_SQL}) WHERE notified = 0 AND status = 'upcoming' AND id % 6 > 0 AND NOT bad_tag AND score >= 55 AND start_date BETWEEN '{AS_OF}' AND strftime(DATE '{AS_OF}' + 21, '%Y-%m-%d')), {DUE_SQL}, p AS ({PLACES_SQL})
SELECT 1 AS block, row_number() OVER (ORDER BY score DESC, id)::INT AS n, '• ' || title || ' — ' || start_date || ' (' || score || ')' AS line FROM f
UNION ALL SELECT 2, row_number() OVER (ORDER BY due.start_date, due.id)::INT, '↻ ' || title || ' — ' || due.start_date FROM due JOIN ({SERIES_SQL}) s USING (id) WHERE due.start_date BETWEEN '{AS_OF}' AND strftime(DATE '{AS_OF}' + 21, '%Y-%m-%d')
UNION ALL SELECT 3, row_number() OVER (ORDER BY name, id)::INT, '📍 ' || name || ', ' || area FROM p""")
def mail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = sr.due_in_digest(series(spark, sf_dir), occurrences(spark, sf_dir), AS_OF, rm.fixed.DIGEST_DAYS, rm.fixed.DIGEST_SCORE)
    return rm.mail(rm.digest(sr.candidates(with_news(spark, sf_dir)), AS_OF), due, places(spark, sf_dir))


@query(f"""WITH p AS ({PLACES_SQL}), f AS (SELECT *, CASE id % 5 WHEN 0 THEN 'Old Town' ELSE area END AS part FROM p),
t AS (SELECT 't' || t AS value, count(*) AS n FROM (SELECT unnest([id % 30, id % 7]) AS t FROM f) GROUP BY 1 ORDER BY n DESC, value LIMIT 16)
SELECT 'category' AS facet, category AS value, count(*) AS n FROM f WHERE category IS NOT NULL GROUP BY 2 UNION ALL SELECT 'area', part, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'tag', value, n FROM t""")
def catalogue_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir).withColumns({"district": F.lit("Old Town"), "area": F.expr("CASE WHEN id % 5 = 0 THEN '' ELSE area END"), "tags": F.expr("array(concat('t', id % 30), concat('t', id % 7))")})
    return rm.facets(p)


@query(f"""WITH e AS ({EVENTS_SQL}), r AS ({RUNS_SQL}), s AS ({SOURCES}) SELECT (SELECT count(*) FROM e WHERE status = 'upcoming') AS upcoming, (SELECT count(*) FROM documents WHERE doc_id % 3 <> 1) AS pending, (SELECT count(*) FROM s WHERE enabled = 1) AS enabled,
  (SELECT count(*) FROM r WHERE status = 'error') AS failed, (SELECT count(*) FROM r) AS runs""")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").selectExpr("CASE doc_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'normalized' END AS status")
    return ops.status_counts(events(spark, sf_dir), items, sources(spark, sf_dir), runs(spark, sf_dir))
