"""Queries: chats, cards that run venue and title together, and pages of cards in capitals, each read in the shape registered for its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.storage import saved
from ..operators import venue_listings as vl
from ..operators.shapes import drafts, shaped
from .inputs import table
from .listings import PAGES, SHOWS, items, pages, shows
from .registry import query

GENITIVE = "array('января', 'февраля', 'марта', 'апреля', 'мая', 'июня', 'июля', 'августа', 'сентября', 'октября', 'ноября', 'декабря')"
FAMILY = fixed.SOURCE_NAMES["tg:vidacultural_Valencia"]
RUSSIAN_MONTH = "['января', 'февраля', 'марта', 'апреля', 'мая', 'июня', 'июля', 'августа', 'сентября', 'октября', 'ноября', 'декабря'][month(d)]"
SPANISH_MONTH = "['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'][month(d)]"


@query(f"""WITH o AS ({SHOWS}) SELECT id, CASE id % 6 WHEN 0 THEN day(d) || ' ' || {RUSSIAN_MONTH} || ' спецпоказ N' || c || ' @ Teatro N' || c % 9 || ', entrada libre' WHEN 1 THEN 'Concierto N' || c || ', ' || (c % 90 + 1) || ' €, calle Mayor ' || c % 9
    ELSE 'Встреча N' || c || ' 📍 Jardín N' || c % 9 || ', вход свободный' END AS title,
  CASE WHEN id % 6 < 2 THEN iso END AS start_date, CASE id % 6 WHEN 0 THEN 'Teatro N' || c % 9 WHEN 4 THEN 'Jardín N' || c % 9 END AS venue_name, CASE WHEN id % 6 = 1 THEN 'calle Mayor ' || c % 9 END AS address,
  CASE id % 6 WHEN 1 THEN (c % 90 + 1) || ' €' ELSE 'Free' END AS price, 'culture/ru/family' AS kind FROM o WHERE id % 6 IN (0, 1, 4)""")
def family_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advertisements and dates before titles go, and so do header cards, cards of pinned posts and posts without day and place."""
    o = shows(spark, sf_dir).withColumn("word", F.expr(f"element_at({GENITIVE}, month(d))"))
    text = f"""CASE id % 6 WHEN 0 THEN concat('Валенсія 🚩 У нас для Вас просто космічні новини 🪐 ', day(d), ' ', word, ' спецпоказ N', c, ' @ Teatro N', c % 9, ', entrada libre') WHEN 1 THEN concat(day(d), ' ', long, ' — Concierto N', c, ',\n', c % 90 + 1, ' €, calle Mayor ', c % 9)
        WHEN 2 THEN '{FAMILY} 499 views 15:28' WHEN 3 THEN concat('{FAMILY} pinned « Concierto ', iso, ' »') WHEN 4 THEN concat('🎈 Встреча N', c, ' 📍 Jardín N', c % 9, ', вход свободный') ELSE concat('Доброго дня, друзья N', c) END"""
    d = shaped(items(o, "tg:vidacultural_Valencia", "NULL", text, "'https://t.me/x/1'", "'telegram_post'"), "tg:vidacultural_Valencia")
    return d.select("id", "title", "start_date", "venue_name", "address", "price", F.concat_ws("/", "category", "language", "audience").alias("kind"))


@query(f"""WITH o AS (SELECT *, d - 100 AS old, d - (id % 9)::INT AS seen FROM ({SHOWS})) SELECT id, CASE WHEN id % 4 = 0 THEN 'Прогулка N' || c ELSE 'Прошла экскурсия N' || c || ' ' || day(old) || ' ' || {RUSSIAN_MONTH.replace("month(d)", "month(old)")} END AS title,
  CASE WHEN id % 4 = 0 THEN iso ELSE year(seen) || strftime(old, '-%m-%d') END AS start_date, 'excursion' AS category FROM o WHERE id % 4 IN (0, 3)""")
def excursion_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only dated ones; a day without a year that lies far ahead is of the year of the post."""
    o = shows(spark, sf_dir).selectExpr("*", "date_sub(d, 100) AS old").selectExpr("*", f"element_at({GENITIVE}, month(d)) AS word", f"element_at({GENITIVE}, month(old)) AS was")
    text = f"""CASE id % 4 WHEN 0 THEN concat(day(d), ' ', word, ' ', year(d), ': Прогулка N', c) WHEN 1 THEN concat('Сохраняйте расписание N', c, ' 📍 Парк') WHEN 2 THEN concat('{fixed.SOURCE_NAMES["tg:rutatuta_vlc"]} pinned « Прогулка ', day(d), ' ', word, ' »')
        ELSE concat('Прошла экскурсия N', c, ' ', day(old), ' ', was) END"""
    return shaped(items(o, "tg:rutatuta_vlc", "NULL", text, "'https://t.me/x/1'", "'telegram_post'"), "tg:rutatuta_vlc").select("id", "title", "start_date", "category")


@query(f"""WITH o AS ({SHOWS}) SELECT id, CASE id % 5 WHEN 0 THEN strftime(d - (isodow(d) - 1)::INT + 5, '%Y-%m-%d') WHEN 3 THEN strftime(d + 1, '%Y-%m-%d') ELSE iso END AS start_date, CASE WHEN id % 5 = 0 THEN strftime(d - (isodow(d) - 1)::INT + 6, '%Y-%m-%d') END AS end_date,
  CASE id % 5 WHEN 0 THEN 'market' WHEN 1 THEN 'concert' WHEN 2 THEN 'exhibition' ELSE 'theatre' END AS category, CASE WHEN id % 5 = 2 THEN 'ru' ELSE 'es' END AS language FROM o WHERE id % 5 < 4""")
def relative_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanish phrases for days are read against the day published, not the day seen on; a morning is no day."""
    o = shows(spark, sf_dir).withColumn("word", F.expr(f"element_at({GENITIVE}, month(d))"))
    text = """CASE id % 5 WHEN 0 THEN concat('Este fin de semana: mercado N', c) WHEN 1 THEN concat('¡Hoy, concierto N', c, '!') WHEN 2 THEN concat('Большая выставка картин N', c, ' ', day(d), ' ', word, ' ', year(d)) WHEN 3 THEN concat('Mañana: danza N', c)
        ELSE concat('Por la mañana, charla vecinal N', c) END"""
    rows = items(o, "tg:valenciabonitatelegram", "NULL", text, "'https://t.me/x/1'", "'telegram_post'", "date_add(d, 3)").join(o.select("id", F.concat("iso", F.lit("T10:00:00Z")).alias("published")), "id")
    return shaped(rows, "tg:valenciabonitatelegram").select("id", "start_date", "end_date", "category", "language")


@query(f"""WITH o AS ({SHOWS}) SELECT id, CASE id % 5 WHEN 0 THEN 'Концерт N' || c || ' в Мадриде, ' || day(d) || ' ' || {RUSSIAN_MONTH} WHEN 3 THEN 'Berlin ' || iso || ' и Аликанте' ELSE 'Тур Валенсия N' || c || ' ' || iso END AS title, iso AS start_date,
  CASE id % 5 WHEN 0 THEN 'Madrid' WHEN 3 THEN 'Alicante' ELSE 'Valencia' END AS city FROM o WHERE id % 5 IN (0, 3, 4)""")
def tour_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of the country; where they name a place abroad, the title must name the country."""
    o = shows(spark, sf_dir).withColumn("word", F.expr(f"element_at({GENITIVE}, month(d))"))
    title = "CASE id % 5 WHEN 2 THEN concat('Тур N', c) WHEN 3 THEN concat('Тур Испания N', c) WHEN 4 THEN concat('Тур Валенсия N', c, ' ', iso) END"
    text = "CASE id % 5 WHEN 0 THEN concat('Концерт N', c, ' в Мадриде, ', day(d), ' ', word) WHEN 1 THEN concat('Berlin, Praha ', iso) WHEN 2 THEN concat('Madrid · Berlin ', iso) WHEN 3 THEN concat('Berlin ', iso, ' и Аликанте') END"
    return shaped(items(o, "tg:concerten", title, text, "'https://t.me/x/1'", "'telegram_post'"), "tg:concerten").select("id", "title", "start_date", "city")


@query(f"""WITH o AS (SELECT *, d + (id % 60 + 1)::INT AS e FROM ({SHOWS})) SELECT id, CASE id % 4 WHEN 3 THEN 'Nuevo Cuenca' ELSE 'Candlelight N' || c END AS title, iso AS start_date, CASE WHEN id % 2 = 0 THEN strftime(e, '%Y-%m-%d') END AS end_date,
  CASE id % 4 WHEN 0 THEN 'Sala Moon Valencia' WHEN 1 THEN 'Teatre La Plazeta' WHEN 3 THEN 'Nuevo Cuenca' END AS venue_name, '€ ' || (c % 90 + 1) || '.50' AS price FROM o WHERE id % 11 > 0 AND id % 7 > 0""")
def experience_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks go, venues by the table of known ones; gift cards and addresses of lists go."""
    o = shows(spark, sf_dir).selectExpr("*", "date_add(d, cast(id % 60 + 1 AS int)) AS e")
    short = "element_at(array('ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'sept', 'oct', 'nov', 'dic'), month({}))"
    title = f"""concat(CASE WHEN id % 3 = 0 THEN '7 7 ' ELSE '' END, CASE id % 4 WHEN 0 THEN 'Sala Moon Valencia ' WHEN 1 THEN 'Teatre La Plazeta ' WHEN 3 THEN 'Nuevo Cuenca' ELSE '' END, CASE id % 4 WHEN 3 THEN '' ELSE concat('Candlelight N', c) END,
        CASE WHEN id % 5 = 0 THEN ' 4.7 (469)' ELSE '' END, ' ', day(d), ' ', {short.format("d")}, CASE WHEN id % 2 = 0 THEN concat(' - ', day(e), ' ', {short.format("e")}) ELSE '' END, CASE WHEN id % 5 = 1 THEN ' 4.7 (469)' ELSE '' END, ' Desde ', c % 90 + 1, ',50 €',
        CASE WHEN id % 11 = 0 THEN ' Tarjeta regalo' ELSE '' END)"""
    url = "CASE WHEN id % 7 = 0 THEN 'https://feverup.com/es/valencia/candlelight' ELSE concat('https://feverup.com/m/', id) END"
    return shaped(items(o, "web:fever", title, "NULL", url), "web:fever").select("id", "title", "start_date", "end_date", "venue_name", "price")


@query(f"""WITH o AS ({SHOWS}) SELECT id, CASE WHEN id % 5 = 4 THEN 'Roig Arena' ELSE 'Banda N' || c END AS title, CASE WHEN id % 5 < 3 THEN iso END AS start_date, CASE WHEN id % 5 < 3 THEN '09:30' END AS start_time,
  CASE id % 5 WHEN 0 THEN 'Sala Moon' WHEN 1 THEN 'Club N' || c WHEN 2 THEN 'Auditorio Roig Arena' WHEN 4 THEN 'Roig Arena' END AS venue_name FROM o WHERE id % 9 > 0""")
def box_office_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forms of cards; of the longer of two known names a card ends with the longer counts; pages of artists go."""
    title = """CASE id % 5 WHEN 0 THEN concat('Entradas Banda N', c, ', Valencia Sala Moon ', day(d), '/', month(d), '/', year(d), ', 9:30') WHEN 1 THEN concat('Entradas Banda N', c, ', Valencia Club N', c, ' ', day(d), '/', month(d), '/', year(d), ', 9:30')
        WHEN 2 THEN concat('sábado, ', day(d), ' de ', long, ' de ', year(d), ', 9:30 sáb. ', day(d), ' ', short, '. 9:30 Banda N', c, ' Auditorio Roig Arena') WHEN 3 THEN concat('Banda N', c) ELSE 'Roig Arena' END"""
    url = "CASE WHEN id % 9 = 0 THEN 'https://t.es/artist/x' ELSE concat('https://t.es/event/x/', id) END"
    return shaped(items(shows(spark, sf_dir), "web:ticketmaster", title, "NULL", url), "web:ticketmaster").select("id", "title", "start_date", "start_time", "venue_name")


@query(f"""WITH o AS ({SHOWS}) SELECT CASE WHEN id % 5 = 2 THEN id + 1000000000 ELSE id END AS id, CASE id % 5 WHEN 2 THEN 'Hall ' || c WHEN 1 THEN 'Festival N' || c || ' lineup' ELSE 'Band N' || c END AS title, CASE WHEN id % 5 < 4 THEN iso END AS start_date,
  CASE WHEN id % 5 < 4 THEN 'Hall ' || c END AS venue_name FROM o WHERE id % 7 > 0""")
def paired_concerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address's dated card and its longest title are one draft; titles lose the venue behind them; one without a title is named by its venue."""
    o = shows(spark, sf_dir)
    url = "CASE WHEN id % 7 = 0 THEN concat('https://www.songkick.com/venues/', id) WHEN id % 2 = 0 THEN concat('https://www.songkick.com/concerts/', id) ELSE concat('https://songkick.com/festivals/', id) END"
    title = "CASE id % 5 WHEN 1 THEN concat('Festival N', c, ' lineup') ELSE concat('Band N', c, CASE WHEN id % 5 < 4 THEN concat(' HALL ', c) ELSE '' END) END"
    named = items(o.where("id % 5 <> 2"), "web:songkick", title, "NULL", url)
    short = items(o.where("id % 5 = 1"), "web:songkick", "'Fest'", "NULL", url).withColumn("id", F.col("id") + 2_000_000_000)
    dated = items(o.where("id % 5 < 4"), "web:songkick", "concat(date_format(d, 'E d MMM yyyy'), ' Hall ', c, CASE WHEN id % 3 = 0 THEN ' Valencia, Spain' WHEN id % 3 = 1 THEN ' Cullera Beach, España' ELSE '' END)", "NULL", url).withColumn("id", F.col("id") + 1_000_000_000)
    return shaped(named.unionByName(short).unionByName(dated), "web:songkick").select("id", "title", "start_date", "venue_name")


@query(f"""WITH p AS ({PAGES}) SELECT CASE k % 5 WHEN 0 THEN 'EXPOSICIÓN N' || k WHEN 1 THEN 'CONFERENCIA N' || k WHEN 2 THEN 'GRAN MUESTRA N' || k ELSE 'OBSERVACIÓN SOLAR N' || k || '. ' || day(d) || ' DE ' || upper({SPANISH_MONTH}) END AS title,
  iso AS start_date, CASE k % 5 WHEN 2 THEN strftime(d + 9, '%Y-%m-%d') END AS end_date, CASE WHEN k % 5 IN (0, 2) THEN 'выставка' ELSE 'culture' END AS category, CASE WHEN k % 5 < 3 THEN 'Museu N' || k % 9 ELSE 'Ciutat de les Arts i les Ciències' END AS venue_name,
  CASE WHEN k % 5 < 3 THEN 'Una descripción larga de la actividad ' || k END AS description, CASE WHEN k % 3 = 0 THEN 'https://c.es/' || k END AS url FROM p WHERE k % 5 < 4""")
def capital_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines belong to the card that a title in capitals opens; menus, promotions, sentences and lines behind a card's end don't; days stand in lines or in titles, read from the day seen on."""
    title = f"""CASE k % 5 WHEN 0 THEN concat('EXPOSICIÓN N', k) WHEN 1 THEN concat('CONFERENCIA N', k) WHEN 2 THEN concat('GRAN MUESTRA N', k) WHEN 3 THEN concat('OBSERVACIÓN SOLAR N', k, '. ', day(d), ' DE ', upper(element_at(array('enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio',
        'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'), month(d)))) ELSE concat('REGALA UNA EXPERIENCIA N', k) END"""
    more = """CASE k % 5 WHEN 0 THEN concat('\nTemporal\n: ', date_format(d, 'dd/MM/yyyy')) WHEN 1 THEN concat('\n', day(d), ' ', element_at(array('Ene', 'Feb', 'Mar', 'Abr', 'May', 'Jun', 'Jul', 'Ago', 'Set', 'Oct', 'Nov', 'Dic'), month(d)), '. ', year(d))
        WHEN 2 THEN concat('\n', date_format(d, 'd/M/yyyy'), '\n– ', date_format(date_add(d, 9), 'dd/MM/yyyy')) ELSE '' END"""
    place = "CASE WHEN k % 5 < 3 THEN concat('\nRecinto:\nMuseu N', k % 9, '\nUna descripción larga de la actividad ', k, '\nVer más\nEsta frase está detrás del final y no cuenta') ELSE '' END"
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c", "cast(o_orderdate AS date) AS d")
    one = o.select("k", "c", "d", F.expr(f"concat('Inicio\nAgenda\n', {title}, {more}, {place})").alias("text"))
    snaps = one.selectExpr("k AS id", "concat('web:cac', k) AS source_key", "'page_snapshot' AS kind", "CAST(NULL AS string) AS title", "text", "CAST(NULL AS string) AS url", "cast(date_sub(d, cast(k % 9 AS int)) AS timestamp) AS seen")
    links = o.where("k % 3 = 0").selectExpr("k + 1000000000 AS id", "concat('web:cac', k) AS source_key", "'link_card' AS kind", f"{title} AS title", "CAST(NULL AS string) AS text", "concat('https://c.es/', k) AS url", "cast(d AS timestamp) AS seen")
    return shaped(snaps.unionByName(links), "web:cac_museu").select("title", "start_date", "end_date", "category", "venue_name", "description", "url")


@query(f"""WITH p AS ({PAGES}), b AS (SELECT id, 'TALLER N' || k AS title, strftime(d, '%Y-%m-%d') AS start_date FROM p) SELECT title, start_date, 'выставка' AS category, count(*) OVER (PARTITION BY id) AS on_page FROM b""")
def stacked_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many cards a page, one after another without ends: each line is of the card before it."""
    block = "concat('TALLER N', k, '\n', date_format(d, 'dd/MM/yyyy'), '\nuna frase en minúsculas que describe el taller ', k)"
    snaps = items(pages(spark, sf_dir, block), "x", "NULL", "text", "NULL", "'page_snapshot'", "d").withColumn("source_key", F.concat(F.lit("web:cac"), "id"))
    d = saved(shaped(snaps, "web:cac_exposiciones").select("page_id", "title", "start_date", "category"))
    return d.join(d.groupBy("page_id").agg(F.count("*").alias("on_page")), "page_id").select("title", "start_date", "category", "on_page")


@query("""WITH h AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS head FROM part),
v AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS venue FROM part WHERE p_partkey % 3 > 0 UNION SELECT DISTINCT split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) FROM part WHERE p_partkey % 2 = 0 UNION SELECT p_name FROM part WHERE p_partkey % 50 = 0),
m AS (SELECT h.id, h.head, max_by(venue, length(venue)) AS venue FROM h JOIN v ON starts_with(h.head, venue || ' ') GROUP BY ALL)
SELECT id, m.venue, CASE WHEN m.venue IS NULL THEN h.head ELSE substr(h.head, length(m.venue) + 2) END AS rest FROM h LEFT JOIN m USING (id, head)""")
def venue_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of names that grows with the parts; the longest of those that a head begins with."""
    p = table(spark, sf_dir, "part")
    word = lambda n: F.array_join(F.slice(F.split("p_name", " "), 1, n), " ").alias("venue")
    known = p.where("p_partkey % 3 > 0").select(word(1)).unionByName(p.where("p_partkey % 2 = 0").select(word(2))).unionByName(p.where("p_partkey % 50 = 0").select(F.col("p_name").alias("venue")))
    heads = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("head"))
    return vl.venue_split(heads, known, False).select("id", "venue", "rest")


@query(f"""WITH o AS ({SHOWS}) SELECT source_key, count(*) AS n, count(DISTINCT title) AS titles FROM (
  SELECT 'tg:rutatuta_vlc' AS source_key, 'Прогулка N' || c AS title FROM o UNION ALL SELECT 'tg:vidacultural_Valencia', 'Прогулка N' || c FROM o UNION ALL SELECT 'web:fever', 'Sesión N' || c FROM o WHERE id % 2 = 0
  UNION ALL SELECT 'web:songkick', 'Sesión N' || c FROM o WHERE id % 2 = 1) GROUP BY 1""")
def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats and listings at once."""
    o = shows(spark, sf_dir).withColumn("word", F.expr(f"element_at({GENITIVE}, month(d))"))
    post = "concat(day(d), ' ', word, ' ', year(d), ': Прогулка N', c)"
    every = items(o, "tg:rutatuta_vlc", "NULL", post, "NULL", "'telegram_post'").unionByName(items(o, "tg:vidacultural_Valencia", "NULL", post, "NULL", "'telegram_post'"))
    every = every.unionByName(items(o.where("id % 2 = 0"), "web:fever", "concat('Sesión N', c)", "NULL", "concat('https://feverup.com/m/', id)"))
    every = every.unionByName(items(o.where("id % 2 = 1"), "web:songkick", "concat('Sesión N', c)", "NULL", "concat('https://songkick.com/concerts/', id)"))
    d = drafts(every, ["tg:rutatuta_vlc", "tg:vidacultural_Valencia", "web:fever", "web:songkick"])
    return d.groupBy("source_key").agg(F.count("*").alias("n"), F.countDistinct("title").alias("titles"))
