"""Queries: cards composed from columns are read back; the SQL gives the columns that they were composed from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize as nm
from .inputs import EVENTS_SQL, events, table
from .registry import query

MONTHS = "array('января', 'febrero', 'March', 'апреля', 'mayo', 'June', 'июля', 'agosto', 'September', 'октября', 'noviembre', 'December')"
ORDERS = "SELECT o_orderkey AS id, o_orderdate::DATE AS d, o_custkey AS c FROM orders"


@query(f"""WITH o AS ({ORDERS}) SELECT id, 'Party n' || c AS title, CASE id % 5 WHEN 4 THEN strftime(d, '%Y-%m-%d') WHEN 0 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%Y-%m-%d') END AS start_date,
  CASE id % 3 WHEN 0 THEN 'Free' WHEN 1 THEN (c % 90 + 1) || ' €' END AS price, '19:30' AS start_time FROM o""")
def chat_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in five forms, two of which leave the year to the day that the post was seen on."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "cast(o_orderdate AS date) AS d", "o_custkey AS c").withColumn("word", F.expr(f"element_at({MONTHS}, month(d))"))
    day = F.expr("""CASE id % 5 WHEN 0 THEN date_format(d, 'dd/MM/yyyy') WHEN 1 THEN concat(day(d), ' ', word, ' ', year(d)) WHEN 2 THEN concat(day(d), ' de ', word)
        WHEN 3 THEN concat(word, ' ', day(d)) ELSE date_format(d, 'yyyy-MM-dd') END""")
    cost = F.expr("CASE id % 3 WHEN 0 THEN 'вход свободный' WHEN 1 THEN concat('от ', c % 90 + 1, ' €') ELSE 'в кассе' END")
    post = F.concat(F.lit("🎟 Party n"), "c", F.lit("\n"), day, F.lit(" в 19:30, "), cost)
    items = o.select("id", F.lit("tg:x").alias("source_key"), post.alias("text"), F.expr("date_sub(d, cast(id % 20 AS int))").alias("seen"))
    return nm.posts(items).select("id", "title", "start_date", "price", "start_time")


@query(f"""WITH o AS ({ORDERS}) SELECT id, 'Candlelight ' || chr((97 + c % 20)::INT) AS title, strftime(d, '%Y-%m-%d') AS start_date, CASE WHEN id % 2 = 0 THEN strftime(d + (id % 60 + 1)::INT, '%Y-%m-%d') END AS end_date, (c % 90 + 1) || ' €' AS price FROM o""")
def flattened_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = "array('ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'sep', 'oct', 'nov', 'dic')".replace("ene", "enero").replace("abr", "abril").replace("ago", "agosto").replace("dic", "diciembre")
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "cast(o_orderdate AS date) AS d", "date_add(cast(o_orderdate AS date), cast(o_orderkey % 60 + 1 AS int)) AS e", "o_custkey AS c")
    span = F.expr(f"concat(day(d), ' ', element_at({short}, month(d)), CASE WHEN id % 2 = 0 THEN concat(' - ', day(e), ' ', element_at({short}, month(e))) ELSE '' END)")
    card = F.concat(F.lit("Candlelight "), F.expr("char(97 + c % 20)"), F.lit(" 4.5 "), span, F.lit(" Desde "), F.expr("c % 90 + 1"), F.lit(",00 €"))
    items = o.select("id", F.lit("web:f").alias("source_key"), card.alias("text"), F.col("d").alias("seen"))
    return nm.cards(items).select("id", "title", "start_date", "end_date", "price")


@query(f"WITH e AS ({EVENTS_SQL}) SELECT id, title, venue_name, strftime(start_date::DATE + INTERVAL 120 MONTH, '%Y-%m-%d') AS start_date, start_time FROM e WHERE start_time IS NOT NULL")
def ticket_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shows of ten years on, as two digits of a year stand for 2000 and later."""
    day = F.date_format(F.add_months(F.to_date("start_date"), 120), "d/M/yy")
    card = F.concat(F.lit("Entradas "), "title", F.lit(", Valencia "), "venue_name", F.lit(" "), day, F.lit(", "), "start_time")
    items = events(spark, sf_dir).where("start_time IS NOT NULL").select("id", F.lit("web:t").alias("source_key"), card.alias("text"))
    return nm.tickets(items).select("id", "title", "venue_name", "start_date", "start_time")


@query("""SELECT o_custkey AS id, 'Show ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS start_date, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate::DATE + 9, '%Y-%m-%d') END AS end_date,
  CASE WHEN o_orderkey % 3 > 0 THEN 'Hall ' || (o_orderkey % 5) END AS venue_name FROM orders""")
def snapshot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey AS id", "o_orderkey AS k", "cast(o_orderdate AS date) AS d")
    block = F.expr("""concat('Show ', k, '\n: ', date_format(d, 'dd/MM/yyyy'), '\n', CASE WHEN k % 2 = 0 THEN concat('– ', date_format(date_add(d, 9), 'dd/MM/yyyy'), '\n') ELSE '' END,
        CASE WHEN k % 3 > 0 THEN concat('Recinto:\nHall ', k % 5, '\n') ELSE '' END)""")
    snaps = o.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", block.alias("b")))), lambda x: x["b"]), "\n").alias("text"))
    return nm.lines(snaps.withColumn("source_key", F.concat(F.lit("c"), "id"))).select("id", "title", "start_date", "end_date", "venue_name")


@query("""SELECT 'http://s/' || o_custkey AS url, arg_max('Band ' || o_orderkey || repeat('x', (o_orderkey % 4)::INT), (length('Band ' || o_orderkey || repeat('x', (o_orderkey % 4)::INT)), -o_orderkey)) AS title,
  strftime(arg_min(o_orderdate, o_orderkey), '%Y-%m-%d') AS start_date FROM orders GROUP BY o_custkey""")
def paired_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("concat('http://s/', cast(o_custkey AS string)) AS url", "o_orderkey AS id", "date_format(o_orderdate, 'yyyy-MM-dd') AS d")
    both = F.explode(F.array(F.col("d"), F.expr("concat('Band ', cast(id AS string), repeat('x', cast(id % 4 AS int)))")))
    return nm.paired(o.select("url", "id", both.alias("text"))).select("url", "title", "start_date")


@query("""SELECT 'show ' || (o_custkey % 50) AS show, strftime(min(o_orderdate), '%Y-%m-%d') AS start_date, strftime(max(o_orderdate), '%Y-%m-%d') AS end_date, sum(CASE o_orderkey % 3 WHEN 0 THEN 1 ELSE o_orderkey % 3 END)::BIGINT AS sessions FROM orders GROUP BY 1""")
def schedule_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("concat('show ', cast(o_custkey % 50 AS string)) AS show", "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "slice(array('18:00', '20:00'), 1, cast(o_orderkey % 3 AS int)) AS times")
    series, occ = nm.scheduled(o)
    return series.join(occ.groupBy("show").agg(F.count("*").alias("sessions")), "show").select("show", "start_date", "end_date", "sessions")


@query("""WITH p AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS t, p_size FROM part)
SELECT id, CASE WHEN id % 4 < 3 THEN 'http://l/' || id END AS url FROM p""")
def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "concat('s', cast(p_partkey AS string)) AS source_key", "concat(p_name, ' ', p_brand, ' grand') AS title")
    near = F.expr("CASE id % 4 WHEN 0 THEN upper(title) WHEN 1 THEN concat(title, ' hall') WHEN 2 THEN concat('grand ', title) ELSE concat('other ', id, ' grand') END")
    return nm.linked(p, p.select("source_key", F.lit(1).alias("pos"), near.alias("title"), F.concat(F.lit("http://l/"), "id").alias("url"))).select("id", "url")


@query(f"""WITH e AS ({EVENTS_SQL}), h AS (SELECT * FROM e WHERE id % 3 <> 1), n AS (SELECT id, title || '!' AS title, score FROM e WHERE id % 3 <> 0)
SELECT coalesce(h.id, n.id)::VARCHAR AS hash, coalesce(n.title, h.title) AS title, h.score, CASE WHEN n.id IS NULL THEN 1 ELSE 2 END AS last_seen, CASE WHEN h.id IS NULL THEN 'upcoming' ELSE h.status END AS status FROM h FULL JOIN n ON h.id = n.id""")
def event_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("hash", F.col("id").cast("string"))
    held = e.where("id % 3 <> 1").select("hash", "title", "score", F.lit(1).alias("last_seen"), "status")
    drafts = e.where("id % 3 <> 0").select("id", "hash", F.concat("title", F.lit("!")).alias("title"))
    return nm.upserted(held, drafts, F.lit(2))


@query(f"WITH e AS ({EVENTS_SQL}) SELECT id, CASE WHEN source = 's1' AND id % 2 = 1 THEN 'duplicate' ELSE status END AS status FROM e")
def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("hash", F.col("id").cast("string"))
    return nm.reconciled(e, e.where("id % 2 = 0"), "s1").select("id", "status")
