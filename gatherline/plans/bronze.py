"""Queries: pages, source items and text families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import pages as src
from .inputs import table
from .registry import query


def sql_html(c: str) -> str:
    c = rf"regexp_replace({c}, '<br\s*/?>|</(p|div|li)>', chr(10), 'gi')"
    c = rf"regexp_replace({c}, '(<script\b[^>]*>.*?</script>)|(<style\b[^>]*>.*?</style>)', ' ', 'gis')"
    c = rf"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
        c = f"replace({c}, '{a}', '{b}')"
    c = rf"regexp_replace(regexp_replace(replace({c}, chr(13), ''), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')"
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, length(t)::INT AS n, sha1(t) AS digest FROM (SELECT page_id, {sql_html('html')} AS t FROM pages)")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").alias("n"), F.sha1("t").alias("digest"))


@query(rf"""SELECT page_id, trim(regexp_replace({sql_html("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')")}, '\s+', ' ', 'g')) AS title, length(left({sql_html('html')}, 12000))::INT AS n FROM pages""")
def page_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.snapshots(table(spark, sf_dir, "pages")).select("page_id", "title", F.length("text").alias("n"))


HEAD = """concat('<head><meta property="og:image" content="https://i.org/', page_id, '.jpg"><meta content="x" name="late"><meta name="description" content="First"><META class=x name="Description" lang="es" content=" Last ', page_id, ' "><meta name="viewport" content="w">')"""


@query(rf"""WITH p AS (SELECT page_id, replace(html, '<head>', {HEAD}) AS html FROM pages) SELECT page_id, 'https://i.org/' || page_id || '.jpg' AS image, 'Last ' || page_id AS description, 2 AS n_meta, sha1(left({sql_html('html')}, 12000)) AS digest FROM p""")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta tags of pages: the known ones, the last of a name; the text of the whole page to its limit."""
    pages = table(spark, sf_dir, "pages").withColumn("html", F.expr(f"replace(html, '<head>', {HEAD})"))
    s = src.snapshots(pages)
    return s.select("page_id", F.element_at("meta", "og:image").alias("image"), F.element_at("meta", "description").alias("description"), F.size("meta").alias("n_meta"), F.sha1("text").alias("digest"))


@query(rf"""WITH pages AS (SELECT page_id, url, replace(html, '</a>', ' of the whole town</a>') AS html FROM main.pages), a AS (SELECT page_id, url AS page, unnest(regexp_extract_all(html, '<a\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1, 'is')) AS href,
  unnest(regexp_extract_all(html, '<a\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2, 'is')) AS title, generate_subscripts(regexp_extract_all(html, '<a\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1, 'is'), 1) AS pos FROM pages),
b AS (SELECT page_id, min(pos) AS pos, min_by(title, pos) AS title, regexp_extract(page, '^[a-zA-Z]+://[^/?#]+') || href AS url FROM a
  WHERE length(trim(title)) BETWEEN 18 AND 220 AND NOT lower(title) SIMILAR TO '(more|read more).*' AND starts_with(href, '/') AND NOT regexp_matches(lower(href), '/tag/|/feed|\.jpg|\.png|\.pdf') GROUP BY page_id, page, href, lower(title))
SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INT AS place FROM b QUALIFY place <= 80""")
def link_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose texts are made long enough for a card's."""
    p = table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("</a>"), F.lit(" of the whole town</a>")))
    return src.cards(p).select("page_id", "url", "place")


def sql_norm(c: str) -> str:
    c = rf"regexp_replace(regexp_replace(lower({c}), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
    return rf"regexp_replace({c}, '[^\p{{L}}\p{{N}}\s]', '', 'g')"


@query(rf"""SELECT doc_id, sha1({sql_norm('text')}) AS norm, substr(sha1(source || '|' || doc_id || '||' || {sql_norm('string_split(text, chr(10))[1]')} || '|' || {sql_norm('text')}), 1, 16) AS item_hash,
  substr(sha1({sql_norm('text')} || '|1998-01-01||' || {sql_norm('source')} || '|'), 1, 16) AS event_hash FROM documents""")
def item_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of items (the first line is the title, the whole text the text) and of events (of the whole text as a title)."""
    d, none, t = table(spark, sf_dir, "documents"), F.lit(None).cast("string"), F.col("text")
    item = text.item_hash(F.col("source"), F.col("doc_id").cast("string"), none, F.split("text", "\n")[0], t)
    return d.select("doc_id", F.sha1(text.norm(t)).alias("norm"), item.alias("item_hash"), text.event_hash(t, F.lit("1998-01-01"), none, F.col("source"), none).alias("event_hash"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("""SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE regexp_replace(left(t, 219), ' +$', '') || '…' END AS excerpt FROM (SELECT doc_id, trim(text, ' ') AS t FROM documents)""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


def held_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").selectExpr("concat(source, '-', cast(doc_id % 700 AS string)) AS item_hash", "source AS source_key", "concat('t', cast(doc_id AS string)) AS title", "sha1(text) AS text", "timestamp_seconds(doc_id) AS seen", "doc_id")
    held = d.where("doc_id % 3 <> 1").groupBy("item_hash").agg(F.max_by(F.struct("source_key", "title", "text", "seen"), "doc_id").alias("r")).select("item_hash", "r.source_key", "r.title", "r.text", F.col("r.seen").alias("first_seen"), F.col("r.seen").alias("last_seen"), F.lit("normalized").alias("status"))
    return held, d.where("doc_id % 3 <> 0").drop("doc_id")


@query("""WITH d AS (SELECT source || '-' || (doc_id % 700) AS item_hash, source AS source_key, 't' || doc_id AS title, doc_id FROM documents),
o AS (SELECT item_hash, max(doc_id) AS id FROM d WHERE doc_id % 3 <> 1 GROUP BY 1), n AS (SELECT item_hash, max(doc_id) AS id, min(doc_id) AS first FROM d WHERE doc_id % 3 <> 0 GROUP BY 1)
SELECT item_hash, 't' || coalesce(n.id, o.id) AS title, coalesce(o.id, n.first) AS first_seen, coalesce(n.id, o.id) AS last_seen, CASE WHEN o.id IS NULL THEN 'pending' ELSE 'normalized' END AS status FROM o FULL JOIN n USING (item_hash)""")
def raw_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = src.upserted(*held_and_batch(spark, sf_dir))
    return u.select("item_hash", "title", F.unix_seconds("first_seen").alias("first_seen"), F.unix_seconds("last_seen").alias("last_seen"), "status")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 > 0 AND source NOT IN ('src1', 'src2') THEN 'ignored' WHEN doc_id % 3 = 1 THEN 'pending' WHEN doc_id % 3 = 0 THEN 'normalized' END AS status FROM documents")
def unregistered_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "source AS source_key", "CASE doc_id % 3 WHEN 0 THEN 'normalized' WHEN 1 THEN 'pending' END AS status")
    registry = items.where("source_key IN ('src1', 'src2')").select("source_key").distinct()
    return src.swept(items, registry).select("id", "status")


@query("""SELECT doc_id AS id FROM (SELECT *, max(CASE WHEN doc_id % 4 = 0 THEN doc_id END) OVER (PARTITION BY source) AS last FROM documents) WHERE doc_id % 4 > 0 OR doc_id = last""")
def latest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "source AS source_key", "CASE WHEN doc_id % 4 = 0 THEN 'page_snapshot' ELSE 'link_card' END AS kind")
    return src.latest_snapshots(items).select("id")


@query("""SELECT doc_id AS id FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 2 = 0""")
def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", "CASE doc_id % 5 WHEN 0 THEN 'normalized' WHEN 1 THEN 'pending' END AS status", "timestamp_seconds(100) AS last_seen",
        "CASE WHEN doc_id % 5 > 0 THEN NULL WHEN doc_id % 2 = 0 THEN timestamp_seconds(99) ELSE timestamp_seconds(101) END AS normalized_at")
    return src.pending(items.withColumn("status", F.when(F.col("id") % 5 > 1, F.lit("normalized")).otherwise(F.col("status")))).select("id")


@query("""SELECT source AS source_key, count(*) AS n_items, max(doc_id) AS finished_at, sum((doc_id % 2)::INT)::BIGINT AS n_changed FROM documents GROUP BY 1""")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = table(spark, sf_dir, "documents").selectExpr("source AS source_key", "doc_id AS seen", "doc_id % 2 = 1 AS changed")
    return src.run_log(polls)
