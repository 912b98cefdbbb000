"""Queries: titles, days, labels and categories of posts that are composed from columns; the SQL says what they were composed from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, places, text, titles
from ..operators import gates
from .inputs import table
from .registry import query

SHOWS = "SELECT o_orderkey AS id, o_orderdate::DATE AS d, 'Show ' || p_name || ' n' || o_custkey AS t, o_custkey AS c FROM orders JOIN part ON o_custkey = p_partkey"


def shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    return o.join(p, o["o_custkey"] == p["p_partkey"]).selectExpr("o_orderkey AS id", "cast(o_orderdate AS date) AS d", "concat('Show ', p_name, ' n', o_custkey) AS t", "o_custkey AS c")


@query(f"""WITH s AS ({SHOWS}), l AS (SELECT *, t || ' ' || rtrim(repeat('word ', 20)) AS long FROM s)
SELECT id, CASE WHEN id % 97 = 0 THEN 'Без названия' WHEN id % 6 = 4 THEN t || ' is on.' WHEN id % 6 = 5 THEN regexp_replace(rtrim(left(long, 72)), ' [^ ]*$', '') || '…' ELSE t END AS title FROM l""")
def derived_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = F.expr("""CASE WHEN id % 97 = 0 THEN ' ' WHEN id % 6 = 0 THEN concat('Gatherers pinned «', t, '»') WHEN id % 6 = 1 THEN concat('👉 12 июня 👉 ', t, ' 👉 more') WHEN id % 6 = 2 THEN concat('✨🔥 ', t, ' — ')
        WHEN id % 6 = 3 THEN concat(t, '\n', t, ' again') WHEN id % 6 = 4 THEN concat(t, ' is on. ', repeat('Nobody reads on. ', 5)) ELSE concat(t, ' ', repeat('word ', 20)) END""")
    return shows(spark, sf_dir).select("id", titles.derived_title(post).alias("title"))


@query(f"""WITH s AS (SELECT *, d - ((dayofweek(d) + 6) % 7)::INT AS monday FROM ({SHOWS}))
SELECT id, strftime(CASE id % 7 WHEN 0 THEN monday + 5 WHEN 1 THEN monday + 12 WHEN 2 THEN d WHEN 3 THEN d WHEN 4 THEN d + 1 WHEN 5 THEN d END, '%Y-%m-%d') AS start_date,
  strftime(CASE id % 7 WHEN 0 THEN monday + 6 WHEN 1 THEN monday + 13 WHEN 2 THEN last_day(d) END, '%Y-%m-%d') AS end_date, CASE WHEN id % 3 > 0 THEN strftime(d, '%Y-%m-%d') END AS url_date FROM s""")
def post_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases for days against the day of the post (a morning is no tomorrow; of two phrases the first counts), and days in addresses (none in the thirteenth month)."""
    post = F.expr("""CASE id % 7 WHEN 0 THEN 'Plan para ESTE finde en la sala' WHEN 1 THEN 'Nos vemos el próximo  fin de semana' WHEN 2 THEN 'Todo este mes, y mañana más' WHEN 3 THEN '¡Hoy!'
        WHEN 4 THEN 'Llega mañana, no hoy' WHEN 5 THEN 'Por la mañana no, hoy sí' ELSE 'Abierto por la mañana y esta mañana' END""")
    url = F.expr("concat('https://x.org/event/show-', CASE id % 3 WHEN 0 THEN date_format(d, 'yyyy-13-dd') WHEN 1 THEN concat(date_format(d, 'yyyy-MM-dd'), '/?p=1') ELSE date_format(d, 'yyyy/MM/dd') END)")
    days = titles.relative_days(post, F.col("d"))
    return shows(spark, sf_dir).select("id", days["start"].alias("start_date"), days["end"].alias("end_date"), titles.date_of_url(url).alias("url_date"))


PEOPLE = "SELECT c_custkey AS id, lower(c_mktsegment) AS seg, c_nationkey AS n FROM customer"


@query(f"""WITH p AS ({PEOPLE}), k AS (SELECT *, replace(replace(replace(seg, 'ch', '§'), 'c', 'k'), '§', 'ch') AS s FROM p)
SELECT id, array_to_string(CASE WHEN id % 2 = 0 THEN ['kafe' || s || 'chiko' || n || 'zhuk', 'kafe' || s, 'chiko' || n, 'zhuk'] ELSE ['kafe' || s] END, ',') AS keys,
  CASE id % 3 WHEN 0 THEN 'Hall, City' WHEN 1 THEN 'Hall' ELSE 'Локация уточняется' END AS location, CASE WHEN id % 4 < 2 THEN 'https://img.x.org/' || id || '.jpg' END AS image,
  CASE id % 2 WHEN 0 THEN 'city old ' || seg ELSE 'has ' || seg END AS tag,
  ['Январь', 'Февраль', 'Март', 'Апрель', 'Май', 'Июнь', 'Июль', 'Август', 'Сентябрь', 'Октябрь', 'Ноябрь', 'Декабрь'][(id % 12 + 1)::INT] || ' 1998' AS month FROM k""")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "lower(c_mktsegment) AS seg", "c_nationkey AS n")
    name = F.expr("CASE WHEN id % 2 = 0 THEN concat('Café ', seg, ' (Chico ', n, ') (Жук)') ELSE concat('Café-', seg) END")
    parts = [F.expr("CASE WHEN id % 3 < 2 THEN 'Hall' END"), F.expr("CASE WHEN id % 3 = 1 THEN 'Hall' ELSE '' END"), F.expr("CASE WHEN id % 3 = 0 THEN 'City' END")]
    url = F.expr("CASE id % 4 WHEN 0 THEN concat(' https://img.x.org/', id, '.jpg ') WHEN 1 THEN concat('https://img.x.org/', id, '.jpg') WHEN 2 THEN 'https://cdn4.telesco.pe/file/x.jpg' ELSE 'not an address' END")
    tag = F.expr("CASE id % 2 WHEN 0 THEN concat('city:old-', seg) ELSE concat('has-', seg) END")
    month = F.expr("concat('1998-', lpad(cast(id % 12 + 1 AS string), 2, '0'))")
    return c.select("id", F.array_join(titles.name_keys(name), ",").alias("keys"), titles.location(parts, fixed.NO_LOCATION).alias("location"), titles.image(url).alias("image"), titles.tag_label(tag).alias("tag"), titles.month_label(month).alias("month"))


@query(f"""WITH s AS ({SHOWS}) SELECT id, CASE id % 8 WHEN 0 THEN 'festival' WHEN 1 THEN 'concert' WHEN 2 THEN 'exhibition' WHEN 3 THEN 'theatre' WHEN 4 THEN 'film' WHEN 5 THEN 'market' WHEN 6 THEN 'family' ELSE 'event' END AS category,
  CASE id % 8 WHEN 2 THEN 'ru' WHEN 6 THEN 'ru' ELSE 'es' END AS language, CASE id % 3 WHEN 0 THEN 'Hall ' || c WHEN 1 THEN 'Sala Nueva' END AS venue_name, CASE WHEN id % 3 = 0 THEN 'calle Mayor ' || c % 99 END AS address FROM s""")
def post_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by cue (the first of the list, not of the text), language, venue and street."""
    kind = F.expr("""CASE id % 8 WHEN 0 THEN 'Concierto de la FERIA' WHEN 1 THEN 'Gran Concierto' WHEN 2 THEN 'Большая русская выставка, очень много картин из музея' WHEN 3 THEN 'Noche de ópera' WHEN 4 THEN 'Película al aire libre' WHEN 5 THEN 'Mercado' WHEN 6 THEN 'Мастер-класс для всех и каждого' ELSE 'Charla' END""")
    where = F.expr("CASE id % 3 WHEN 0 THEN concat(' @ Hall ', c, ', calle Mayor ', c % 99) WHEN 1 THEN ' место: Sala Nueva' ELSE ' gratis' END")
    body = F.concat(kind, where)
    return shows(spark, sf_dir).select("id", titles.cued(body, fixed.POST_CATEGORIES, "event").alias("category"), text.language(body).alias("language"), titles.venue(body).alias("venue_name"), titles.address(body).alias("address"))


@query("""SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN '€ A 漢 🔥' WHEN 1 THEN 'ñ & <b>' WHEN 2 THEN 'no &amp entity; &unknown;' ELSE 'é' END AS decoded FROM documents""")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric entities with any number of digits, decimal and hexadecimal; what is none stays."""
    d = table(spark, sf_dir, "documents")
    raw = F.expr("CASE doc_id % 4 WHEN 0 THEN '&#8364; &#0000065; &#x6f22; &#x1F525;' WHEN 1 THEN '&#xF1; &amp; &lt;b&gt;' WHEN 2 THEN 'no &amp entity; &unknown;' ELSE '&#00000000233;' END")
    return d.select(F.col("doc_id").alias("id"), text.decode_entities(raw).alias("decoded"))


@query(f"""WITH p AS ({PEOPLE}) SELECT id, CASE id % 4 WHEN 0 THEN 'c/ Mayor ' || n || ', City|Hall, City|Old Town, City' WHEN 1 THEN 'Hall, City' WHEN 2 THEN 'Hall, City|Old Town, City' ELSE '' END AS queries, id % 5 = 0 AS is_address,
  CASE id % 2 WHEN 0 THEN 'https://x.org/a|https://y.org/' || id ELSE 'https://y.org/' || id END AS links FROM p""")
def place_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries for a geocoder, names that are addresses, and links to ground a card on (social networks left out)."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_nationkey AS n")
    street, hall, part = F.expr("CASE WHEN id % 4 = 0 THEN concat('c/ Mayor  ', n) END"), F.expr("CASE WHEN id % 4 < 3 THEN 'Hall' END"), F.expr("CASE id % 4 WHEN 0 THEN 'Old Town' WHEN 1 THEN 'Hall' WHEN 2 THEN 'Old Town' END")
    name = F.expr("CASE id % 5 WHEN 0 THEN 'HTTPS://maps.app/x' ELSE concat('Bar www ', id) END")
    source = F.expr("CASE id % 2 WHEN 0 THEN 'https://x.org/a' ELSE 'https://t.me/x' END")
    more = F.expr("array(named_struct('url', 'https://www.instagram.com/p'), named_struct('url', concat('https://y.org/', id)), named_struct('url', concat('https://y.org/', id)))")
    return c.select("id", F.array_join(gates.geo_queries(street, hall, part, F.lit("City")), "|").alias("queries"), gates.is_address_as_name(name).alias("is_address"), F.array_join(places.grounding_links(source, more), "|").alias("links"))
