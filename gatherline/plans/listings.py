"""Queries: one a source of listings. Cards and pages are composed from columns, read back through the shape registered for the source, and held against the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shapes import drafts, shaped
from .inputs import table
from .registry import query

SHORT = "array('ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'sep', 'oct', 'nov', 'dic')"
LONG = "array('enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre')"
RUSSIAN = "array('ЯНВ', 'ФЕВ', 'МАР', 'АПР', 'МАЙ', 'ИЮН', 'ИЮЛ', 'АВГ', 'СЕН', 'ОКТ', 'НОЯ', 'ДЕК')"
SHOWS = "SELECT o_orderkey AS id, o_orderdate::DATE AS d, strftime(o_orderdate, '%Y-%m-%d') AS iso, o_custkey AS c FROM orders"


def shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, d (a day), iso, c and month names of that day."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "cast(o_orderdate AS date) AS d", "date_format(o_orderdate, 'yyyy-MM-dd') AS iso", "o_custkey AS c")
    return o.selectExpr("*", f"element_at({SHORT}, month(d)) AS short", f"element_at({LONG}, month(d)) AS long", f"element_at({RUSSIAN}, month(d)) AS rus", "date_format(d, 'MMM') AS en")


def items(rows: DataFrame, source: str, title: str, text: str, url: str, kind: str = "'link_card'", seen: str = "date_sub(d, cast(id % 9 AS int))") -> DataFrame:
    return rows.selectExpr("id", f"'{source}' AS source_key", f"{kind} AS kind", f"{title} AS title", f"{text} AS text", f"{url} AS url", f"cast({seen} AS timestamp) AS seen")


@query(f"""WITH o AS ({SHOWS}) SELECT id, 'Тур ' || c || CASE id % 6 WHEN 0 THEN ' в Аликанте' WHEN 1 THEN ' (отменен)' WHEN 2 THEN ' в Мадриде' ELSE '' END AS title, iso AS start_date,
  CASE id % 6 WHEN 0 THEN 'Alicante' WHEN 2 THEN 'Madrid' WHEN 1 THEN 'Barcelona' ELSE 'Valencia' END AS city, id % 6 = 1 AS cancelled FROM o WHERE id % 6 < 4""")
def tour_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in addresses, else in the text; tours elsewhere and pages of artists go; cities by title, else by the address's path."""
    title = "concat('Тур ', c, CASE id % 6 WHEN 0 THEN ' в Аликанте' WHEN 1 THEN ' (отменен)' WHEN 2 THEN ' в Мадриде' ELSE '' END)"
    text = "CASE id % 6 WHEN 2 THEN concat('Madrid · Berlin ', iso) WHEN 3 THEN 'Испания' WHEN 4 THEN 'Испания' WHEN 5 THEN 'Berlin, Praha' END"
    url = """CASE id % 6 WHEN 1 THEN concat('https://worldafisha.com/event/tur-barselona-', iso) WHEN 2 THEN 'https://worldafisha.com/event/tur' WHEN 4 THEN 'https://worldafisha.com/persons/x' ELSE concat('https://worldafisha.com/event/tur-', iso) END"""
    return shaped(items(shows(spark, sf_dir), "web:worldafisha", title, text, url), "web:worldafisha").select("id", "title", "start_date", "city", "cancelled")


@query(f"""WITH o AS ({SHOWS}) SELECT id, CASE WHEN id % 4 = 3 THEN 'Концерт ' || c ELSE 'Шоу «N' || c % 900 || '»' || CASE WHEN id % 4 = 1 THEN ' в Аликанте' ELSE '' END END AS title, iso AS start_date,
  CASE id % 4 WHEN 0 THEN (c % 90 + 1) || ' €' WHEN 1 THEN '49 €' WHEN 3 THEN 'Free' END AS price, CASE WHEN id % 4 = 1 THEN 'Alicante' ELSE 'Valencia' END AS city, CASE WHEN id % 4 = 3 THEN 'calle Mayor ' || c % 9 END AS address FROM o WHERE id % 5 > 0""")
def offer_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers before titles are peeled off (month, day, time, sessions, price); labels of navigation go; the site's name in its address is no city."""
    title = """CASE WHEN id % 5 = 0 THEN 'Контакты' WHEN id % 4 = 0 THEN concat(rus, ' ', day(d), ' 2 сеансов от ', c % 90 + 1, ' € Шоу «N', c % 900, '»') WHEN id % 4 = 1 THEN concat(rus, ' ', lpad(cast(day(d) AS string), 2, '0'), ' 19:30 от 49 € Шоу «N', c % 900, '» в Аликанте')
        WHEN id % 4 = 2 THEN concat(rus, ' ', day(d), ' Шоу «N', c % 900, '»') ELSE concat('Концерт ', c) END"""
    text = "CASE WHEN id % 5 > 0 AND id % 4 = 3 THEN concat('Вход свободный, ', iso, ', calle Mayor ', c % 9) END"
    return shaped(items(shows(spark, sf_dir), "web:valenciarusa", title, text, "'https://www.valenciarusa.es/afisha/x'"), "web:valenciarusa").select("id", "title", "start_date", "price", "city", "address")


@query(f"""WITH o AS ({SHOWS}) SELECT id, 'Встреча ' || c AS title, CASE WHEN id % 7 = 0 THEN iso WHEN id % 7 = 1 THEN iso END AS start_date, CASE WHEN id % 7 = 1 THEN 'Hall ' || c END AS venue_name FROM o WHERE id % 7 < 3 AND c <> 404""")
def board_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A board of classified ads: the board itself, other boards, its labels and error pages (one meeting's number reads like one) go; an undated card stays."""
    title = "CASE id % 7 WHEN 5 THEN 'Каталог фирм' WHEN 6 THEN 'Страница не найдена' ELSE concat('Встреча ', c) END"
    text = "CASE id % 7 WHEN 0 THEN 'без даты' WHEN 1 THEN concat(iso, ' @ Hall ', c) END"
    url = "CASE id % 7 WHEN 0 THEN concat('https://elcontacto.ru/valencia/events/x-', iso) WHEN 3 THEN 'https://elcontacto.ru/valencia/events/' WHEN 4 THEN 'https://elcontacto.ru/ispaniya/x' ELSE 'https://www.elcontacto.ru/valencia/events/x' END"
    return shaped(items(shows(spark, sf_dir), "web:elcontacto", title, text, url), "web:elcontacto").select("id", "title", "start_date", "venue_name")


@query(f"WITH o AS ({SHOWS}) SELECT id, 'Вечер ' || c AS title, iso AS start_date FROM o WHERE id % 5 < 2")
def strict_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only addresses below the listing, only with a day."""
    url = "CASE id % 5 WHEN 2 THEN 'https://russpain.com/afisha/valencia/' WHEN 3 THEN concat('https://russpain.com/news/x-', iso) WHEN 1 THEN concat('https://russpain.com/afisha/valencia/x-', iso) ELSE 'https://russpain.com/afisha/valencia/x' END"
    return shaped(items(shows(spark, sf_dir), "web:russpain", "concat('Вечер ', c)", "CASE WHEN id % 5 = 0 THEN concat('Начало ', iso) ELSE 'скоро' END", url), "web:russpain").select("id", "title", "start_date")


@query(f"WITH o AS ({SHOWS}) SELECT id, CASE id % 3 WHEN 2 THEN 'Solo ' || c ELSE 'Camerata i Cor ' || c END AS title, iso AS start_date, CASE WHEN id % 2 = 0 THEN '18:00' END AS start_time FROM o WHERE id % 5 > 0")
def headed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in three languages come once."""
    name = "CASE id % 3 WHEN 0 THEN concat('Camerata i Cor ', c, ' Camerata y Cor ', c, ' Camerata & Cor ', c) WHEN 1 THEN concat('Camerata i Cor ', c, ' CAMERATA I COR ', c, ' Camerata i Cor ', c) ELSE concat('Solo ', c) END"
    text = f"concat('Data:  Fecha: Date: ', date_format(d, 'd/M/yyyy'), CASE WHEN id % 2 = 0 THEN ' Hora: Time: 18:00 ' ELSE ' ' END, {name})"
    url = "CASE WHEN id % 5 = 0 THEN 'https://www.palauvalencia.com/history' ELSE concat('https://www.palauvalencia.com/event?id=', id) END"
    return shaped(items(shows(spark, sf_dir), "web:palau", f"substr({text}, 1, 40)", text, url), "web:palau").select("id", "title", "start_date", "start_time")


@query(f"""WITH o AS ({SHOWS}) SELECT id, 'Obra N' || id AS title, CASE id % 6 WHEN 0 THEN iso WHEN 1 THEN iso WHEN 4 THEN iso WHEN 5 THEN iso END AS start_date,
  CASE id % 6 WHEN 1 THEN strftime(d + 9, '%Y-%m-%d') WHEN 2 THEN iso WHEN 3 THEN iso END AS end_date, CASE id % 3 WHEN 0 THEN '€ 12.5' WHEN 1 THEN 'Free' END AS price, CASE WHEN id % 2 = 0 THEN 'theatre' ELSE 'sport' END AS category,
  CASE WHEN id % 4 = 0 THEN 'Cullera' ELSE 'Valencia' END AS city FROM o""")
def badge_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that stack, a badge, six forms of dates, a town; each card comes twice."""
    cell = "concat(day(d), ' ', short, ' ', year(d))"
    when = f"""CASE id % 6 WHEN 0 THEN {cell} WHEN 1 THEN concat('Del ', {cell}, ' al ', day(date_add(d, 9)), ' ', element_at({SHORT}, month(date_add(d, 9))), ' ', year(date_add(d, 9))) WHEN 2 THEN concat('Hasta el ', {cell})
        WHEN 3 THEN concat('Del al ', {cell}) WHEN 4 THEN '✱ ¡Solo hoy!' ELSE '✱ ¡Termina mañana!' END"""
    price = "CASE id % 3 WHEN 0 THEN '¡Oferta con descuento! Desde 12,5 € ' WHEN 1 THEN 'Gratis ' ELSE 'Consultar precio ' END"
    title = f"concat({price}, CASE WHEN id % 2 = 0 THEN 'Teatro y espectáculos ' ELSE 'Actividades deportivas ' END, {when}, ' Obra N', id, CASE WHEN id % 4 = 0 THEN ' Cullera' WHEN id % 4 = 1 THEN ' València' ELSE ' valencia.' END)"
    one = items(shows(spark, sf_dir), "web:hoyvalencia", title, "NULL", "'https://hoyvalencia.es/planes/x/'", seen="date_sub(d, cast(id % 6 = 5 AS int))")
    twice = one.unionByName(one.withColumn("id", F.col("id") + 1_000_000_000))
    return shaped(twice, "web:hoyvalencia").select("id", "title", "start_date", "end_date", "price", "category", "city")


@query(f"""WITH o AS ({SHOWS}) SELECT id, 'Banda N' || c || CASE WHEN id % 5 = 1 THEN ' Directo' ELSE '' END AS title, iso AS start_date FROM o WHERE id % 5 < 2
UNION ALL SELECT id + 1000000000, 'Banda N' || c || CASE WHEN id % 5 = 1 THEN ' Directo' ELSE '' END, iso FROM o WHERE id % 5 < 2""")
def concert_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undated twins take the day of the dated card of their address; other regions and cards without any day go."""
    show = "concat('Banda N', c, CASE WHEN id % 5 = 1 THEN ' Directo' ELSE '' END)"
    day = "concat(day(d), ' de ', long, ' de ', year(d))"
    dated = f"CASE id % 5 WHEN 2 THEN concat({show}, ' en Madrid lunes ', {day}) WHEN 3 THEN concat({show}, ' en Valencia') WHEN 4 THEN concat({show}, ' en Valencia sábado ', {day}) ELSE concat({show}, CASE WHEN id % 2 = 0 THEN ' en Torrent, Valencia viernes ' ELSE ' en València sábado ' END, {day}) END"
    bare = f"CASE id % 5 WHEN 2 THEN concat({show}, ' - Madrid') WHEN 3 THEN concat({show}, ' - Valencia') WHEN 4 THEN 'Contact' ELSE concat({show}, CASE WHEN id % 2 = 0 THEN ' en Torrent, Valencia' ELSE ' - Valencia' END) END"
    url = "CASE WHEN id % 5 = 4 THEN 'https://l.net/conciertos/agenda' ELSE concat('https://l.net/conciertos/banda-', 10000 + id) END"
    o = shows(spark, sf_dir)
    twins = items(o, "web:laganzua", bare, "NULL", f"concat(upper({url}), '/')").withColumn("id", F.col("id") + 1_000_000_000)
    twins = twins.withColumn("url", F.lower("url"))
    return shaped(items(o, "web:laganzua", dated, "NULL", url).unionByName(twins), "web:laganzua").select("id", "title", "start_date")


# a customer is a page of its orders' cards; the page of the greater number is the newer one
PAGES = "SELECT o_orderkey AS k, o_custkey AS id, o_orderdate::DATE AS d, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders"


def pages(spark: SparkSession, sf_dir: str, block: str) -> DataFrame:
    """id, d (the day that a page was seen on) and text of a page for each customer: blocks made of its orders (k, d, short, en, long and seen), by number."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS id", "cast(o_orderdate AS date) AS d")
    o = o.selectExpr("*", "min(d) OVER (PARTITION BY id) AS seen", "date_format(d, 'MMM') AS en")
    g = o.groupBy("id").agg(F.min("d").alias("d"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.expr(block).alias("b")))), lambda x: x["b"]), "\n").alias("text"))
    return g


@query(f"""WITH p AS ({PAGES}), s AS (SELECT *, min(d) OVER (PARTITION BY id) AS seen FROM p),
c AS (SELECT 'Taller ' || k AS title, CASE k % 4 WHEN 0 THEN strftime(seen, '%Y-%m-%d') WHEN 1 THEN strftime(seen + 1, '%Y-%m-%d') WHEN 2 THEN strftime(seen + ((5 - dayofweek(seen) + 7) % 7)::INT, '%Y-%m-%d') END AS start_date,
  CASE WHEN k % 4 < 2 THEN '19:30' WHEN k % 4 = 2 THEN '20:00' END AS start_time, CASE WHEN k % 4 < 3 THEN 'Hall ' || k % 10 END AS venue_name, CASE WHEN k % 3 = 0 THEN 'https://www.eventbrite.es/e/t-' || k END AS url, k FROM s)
SELECT title, start_date, start_time, venue_name, url FROM c WHERE k % 4 < 3 UNION ALL SELECT upper(title), NULL, NULL, NULL, url FROM c WHERE k % 4 = 3 AND k % 3 = 0""")
def ticket_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words for days against the day of the page; online cards from elsewhere go, but come undated where a link card has their title."""
    block = """CASE k % 4 WHEN 0 THEN concat('Taller ', k, ' hoy a las 19:30\nHall ', k % 10, '\nComprobar el precio de la entrada en el evento') WHEN 1 THEN concat('Taller ', k, ' mañana a las 19:30 + 2 más\nHall ', k % 10, '\nCheck ticket price on event')
        WHEN 2 THEN concat('Taller ', k, ' viernes, 8:00 PM\nHall ', k % 10, '\nCheck ticket price on event') ELSE concat('chrome\nTaller ', k, ' viernes a las 9:00 GMT+1\nCheck ticket price on event') END"""
    snaps = items(pages(spark, sf_dir, block), "web:eventbrite", "NULL", "text", "NULL", "'page_snapshot'", "d")
    links = items(shows(spark, sf_dir).where("id % 3 = 0"), "web:eventbrite", "concat('TALLER ', id)", "NULL", "concat('https://www.eventbrite.es/e/t-', id, '?aff=x')").withColumn("id", F.col("id") + 1_000_000_000)
    got = shaped(snaps.unionByName(links), "web:eventbrite")
    return got.select("title", "start_date", "start_time", "venue_name", "url")


@query(f"""WITH p AS ({PAGES}), c AS (SELECT *, CASE k % 5 WHEN 0 THEN 'Выставка ' || k WHEN 1 THEN 'Праздник ' || k WHEN 2 THEN 'Sting ' || k WHEN 3 THEN 'Концерт ' || k ELSE 'Фестиваль ' || k || ' в Севилье' END AS title FROM p)
SELECT title, CASE WHEN k % 7 = 0 THEN 'Весь текст ' || k ELSE 'Описание ' || k END AS description, CASE k % 5 WHEN 2 THEN 'Madrid' WHEN 1 THEN 'Alicante' ELSE 'Valencia' END AS city, CASE WHEN k % 2 = 0 THEN 'Зал ' || k END AS venue_name,
  iso AS start_date, CASE WHEN k % 5 = 0 THEN strftime(d + 2, '%Y-%m-%d') END AS end_date, CASE WHEN k % 5 > 0 THEN '19:30' END AS start_time, CASE WHEN k % 7 < 2 THEN 'https://x.org/events/' || k END AS url FROM c WHERE k % 5 < 3""")
def agenda_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks about a date line: a title, perhaps a city line, a description before it, perhaps a venue after it; other regions go but for headliners; texts of detail pages replace descriptions."""
    title = "CASE k % 5 WHEN 0 THEN concat('Выставка ', k) WHEN 1 THEN concat('Праздник ', k) WHEN 2 THEN concat('Sting ', k) WHEN 3 THEN concat('Концерт ', k) ELSE concat('Фестиваль ', k, ' в Севилье') END"
    block = f"""concat({title}, CASE k % 5 WHEN 1 THEN '\nАликанте' WHEN 2 THEN '\nМадрид' WHEN 3 THEN '\nМадрид' ELSE '' END, '\nОписание ', k, '\n', day(d), ' ', en, ' ', year(d), ', 19:30',
        CASE WHEN k % 5 = 0 THEN concat(' - ', day(date_add(d, 2)), ' ', date_format(date_add(d, 2), 'MMM'), ' ', year(date_add(d, 2)), ', 21:00') ELSE '' END, CASE WHEN k % 2 = 0 THEN concat('\nЗал ', k) ELSE '\nМадрид' END)"""
    snaps = items(pages(spark, sf_dir, block), "web:lacotorra", "NULL", "text", "NULL", "'page_snapshot'", "d").withColumn("source_key", F.concat(F.lit("web:lacotorra"), "id"))
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c", "o_orderkey AS id", "cast(o_orderdate AS date) AS d")
    links = items(o.where("k % 7 < 2").withColumn("title", F.expr(title)), "x", "title", "NULL", "concat('https://x.org/events/', k)")
    details = items(o.where("k % 7 = 0"), "x", "NULL", "concat('Весь текст ', k)", "concat('https://x.org/events/', k)", "'event_detail'")
    own = o.select("id", F.concat(F.lit("web:lacotorra"), "c").alias("source_key"))
    more = links.unionByName(details).drop("source_key").join(own, "id").withColumn("id", F.col("id") + 1_000_000_000)
    got = shaped(snaps.unionByName(more), "web:lacotorra")
    return got.select("title", "description", "city", "venue_name", "start_date", "end_date", "start_time", "url")


@query(f"""WITH p AS ({PAGES}) SELECT 'Звезда ' || md5(k::VARCHAR) AS title, iso AS start_date, CASE WHEN k % 2 = 0 THEN '19:00' END AS start_time, CASE k % 5 WHEN 0 THEN 'València' WHEN 1 THEN 'Alicante' ELSE 'Madrid' END AS city, CASE WHEN k % 5 < 2 THEN 'Hall ' || k % 9 END AS venue_name,
  CASE WHEN k % 3 = 0 THEN 'https://t.ee/performances/z-' || k END AS url FROM p WHERE k % 5 < 2
UNION ALL SELECT 'Bruno Mars ' || md5(k::VARCHAR), iso, CASE WHEN k % 2 = 0 THEN '19:00' END, 'Madrid', NULL, CASE WHEN k % 3 = 0 THEN 'https://t.ee/performances/z-' || k END FROM p WHERE k % 5 = 2""")
def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in seven languages, a time or none, titles with a city chip, "Country, City, Venue"; the region of the country, and headliners in the country."""
    words = "array('jaanuar', 'февраля', 'marzo', 'aprīlis', 'gegužė', 'June', 'juuli', 'августа', 'septiembre', 'oktobris', 'lapkritis', 'December')"
    block = f"""concat('E\n•\n', day(d), ' ', element_at({words}, month(d)), ' ', year(d), CASE WHEN k % 2 = 0 THEN '\n19:00' ELSE '' END, '\n', CASE k % 5 WHEN 2 THEN 'Bruno Mars ' ELSE 'Звезда ' END, md5(cast(k AS string)), ' | Город\n',
        CASE k % 5 WHEN 0 THEN concat('Hispaania, València, Hall ', k % 9, ', Mayor 1') WHEN 1 THEN concat('España, Alicante, Hall ', k % 9) WHEN 2 THEN 'Spain, Madrid' WHEN 3 THEN 'Spain, Marbella, Hall' ELSE 'Latvia, Valencia, Hall' END, '\nOsta pilet')"""
    snaps = items(pages(spark, sf_dir, block), "x", "NULL", "text", "NULL", "'page_snapshot'", "d").withColumn("source_key", F.concat(F.lit("s"), "id"))
    o = shows(spark, sf_dir).where("id % 3 = 0")
    links = items(o, "x", "concat(CASE id % 5 WHEN 2 THEN 'Bruno Mars ' ELSE 'Звезда ' END, md5(cast(id AS string)), ' | Город')", "NULL", "concat('https://t.ee/performances/z-', id)").join(o.select("id", F.concat(F.lit("s"), "c").alias("source")), "id")
    links = links.withColumn("source_key", F.col("source")).drop("source").withColumn("id", F.col("id") + 1_000_000_000)
    return shaped(snaps.unionByName(links), "web:ticketbest").select("title", "start_date", "start_time", "city", "venue_name", "url")


@query(f"""WITH p AS ({PAGES}) SELECT k AS id, 'Concert ' || md5(k::VARCHAR) AS title, CASE WHEN k % 7 < 4 THEN iso WHEN k % 7 = 5 THEN iso END AS start_date, CASE WHEN k % 7 IN (0, 1, 2) THEN strftime(d + 5, '%Y-%m-%d') END AS end_date, 'concert' AS category
FROM p WHERE k % 9 > 0""")
def agenda_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards dated by a range glued to their title, else by their page's lines (in one line, in three, compact, a day alone; a whole year is no date), else by their text; guides go."""
    dmy = lambda c: f"date_format({c}, 'dd/MM/yyyy')"
    two = dmy("date_add(d, 5)")
    block = f"""concat('Music\nConcert ', md5(cast(k AS string)), '\nSearch', CASE k % 7 WHEN 0 THEN concat('\nFrom ', {dmy('d')}, ' to ', {two}) WHEN 1 THEN concat('\nFrom\n', {dmy('d')}, '\nto ', {two}) WHEN 3 THEN concat('\n', {dmy('d')})
        WHEN 4 THEN concat('\n01/01/', year(d), ' - 31/12/', year(d)) WHEN 5 THEN '' ELSE '' END)"""
    snaps = items(pages(spark, sf_dir, block), "x", "NULL", "text", "NULL", "'page_snapshot'", "d").withColumn("source_key", F.concat(F.lit("web:visitvalencia"), "id"))
    o = shows(spark, sf_dir)
    title = f"CASE WHEN id % 9 = 0 THEN concat('Where to hear number ', id) WHEN id % 7 = 2 THEN concat('Concert ', md5(cast(id AS string)), ' ', {dmy('d')}, ' - ', {two}) ELSE concat('Concert ', md5(cast(id AS string))) END"
    text = "CASE WHEN id % 7 = 5 THEN concat('On ', iso) END"
    cards = items(o, "x", title, text, "concat('https://v.com/en/events-valencia/', CASE WHEN id % 9 = 0 THEN 'where-hear' ELSE 'great' END, '-', id)").join(o.select("id", F.concat(F.lit("web:visitvalencia"), "c").alias("source")), "id")
    cards = cards.withColumn("source_key", F.col("source")).drop("source")
    return shaped(snaps.unionByName(cards), "web:visitvalencia").select("id", "title", "start_date", "end_date", "category")


@query(f"""WITH o AS ({SHOWS}) SELECT source_key, count(*) AS n, count(DISTINCT start_date) AS days FROM (
  SELECT 'web:russpain' AS source_key, iso AS start_date FROM o WHERE id % 2 = 0 UNION ALL SELECT 'web:valenciarusa', iso FROM o UNION ALL SELECT 'web:elcontacto', iso FROM o WHERE id % 3 > 0 AND c <> 404) GROUP BY 1""")
def registered_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several sources at once, each read in the shape that is registered for it."""
    o = shows(spark, sf_dir)
    own = items(o, "web:russpain", "concat('Вечер ', c)", "iso", "CASE WHEN id % 2 = 0 THEN 'https://russpain.com/afisha/valencia/x' ELSE 'https://russpain.com/' END")
    own = own.unionByName(items(o, "web:valenciarusa", "concat('Вечер ', c)", "iso", "'https://x.org'"))
    own = own.unionByName(items(o, "web:elcontacto", "CASE WHEN id % 3 = 0 THEN 'Разделы' ELSE concat('Вечер ', c) END", "CASE WHEN id % 3 > 0 THEN iso END", "'https://elcontacto.ru/valencia/x'"))
    return drafts(own, ["web:russpain", "web:valenciarusa", "web:elcontacto"]).groupBy("source_key").agg(F.count("*").alias("n"), F.countDistinct("start_date").alias("days"))
