"""Event drafts of listings: link cards, flattened cards and agenda pages, a job a shape; sources differ by options (register_shape).

Items have id, source_key, kind (page_snapshot, link_card or event_detail), title, text, url and seen (when they were first seen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, fixed, places, titles
from ..functions.storage import saved
from ..functions.text import compact, empty, fold, norm_title, once, worked_out
from . import gates
from .normalize import linked

DMY = r"(\d{2})/(\d{2})/(\d{4})"


def cards_of(items: DataFrame) -> DataFrame:
    """Link cards of single events: titled, with an address of their source's shape where it has a rule."""
    c = items.where((F.col("kind") == "link_card") & F.coalesce(gates.is_event_url(F.col("source_key"), F.col("url")), F.lit(True)))
    return worked_out(c, title=compact(F.col("title"))).where("title IS NOT NULL")


def link_cards(items: DataFrame, *, name: str = "", board: bool = False, country: tuple[list[str], list[str]] | None = None, needs_date: bool = False, offers: bool = False, cities: list[tuple[str, str]] = []) -> DataFrame:  # noqa: B006
    """Drafts of link cards that are no chrome (of a board: nor its labels or error pages): the date of the address, else of title and text read from the day seen on; price, venue and address
    of both; cancelled flags. country (stems inside, outside) keeps what speaks of it; offers peels them off titles; cities (stem, city) are looked for in title, text and path."""
    both = F.concat_ws(" ", "title", "text")
    c = cards_of(items).where(~gates.is_junk(F.col("title"), F.col("text"), F.lit(name)))
    if board:
        c = c.where(~gates.is_error_page(F.col("title"), F.col("text")) & ~gates.is_board_label(F.col("title"), F.col("text")))
    if country:
        c = c.where(places.in_country(F.col("title"), F.concat_ws(" ", "text", "url"), *country))
    start = F.coalesce(titles.date_of_url(F.col("url")), dates.parse_date(both, F.to_date("seen")))
    path = F.regexp_replace(places.without_host(empty(F.col("url"))), "[/_-]+", " ")
    city = places.city(F.concat_ws(" ", "title", "text", path), cities, fixed.HOME_CITY) if cities else F.lit(fixed.HOME_CITY)
    price = dates.price(both)
    c = c.select("id", "source_key", F.substring(titles.without_offer(F.col("title")) if offers else F.col("title"), 1, 300).alias("title"), start.alias("start_date"), price["price"].alias("price"),
        price["is_free"].alias("is_free"), titles.venue(both).alias("venue_name"), titles.address(both).alias("address"), city.alias("city"), "url", gates.is_cancelled(F.col("title")).alias("cancelled"))
    return c.where("start_date IS NOT NULL") if needs_date else c


def headed_cards(items: DataFrame, *, name: str = "") -> DataFrame:
    """Drafts of cards "Data: Fecha: Date: D/M/Y Hora: Time: H:MM TITLE" whose title stands there three times."""
    head = r"(?i)Data:\s*Fecha:\s*Date:\s*(\d{1,2})/(\d{1,2})/(\d{2,4})(?:\s*Hora:\s*Time:\s*(\d{1,2}:\d{2}))?"
    t = F.col("t")
    g = lambda i: F.regexp_extract("head", head, i)
    d, m, y = (F.col(c) for c in ("d", "m", "y"))
    day = F.when(d.between(1, 31) & m.between(1, 12), dates.iso(F.when(y < 100, y + 2000).otherwise(y), m, d))
    tail = F.when(F.col("head").isNotNull(), F.substring(t, F.position(F.col("head"), t) + F.length("head"), F.length(t))).otherwise(t)
    c = cards_of(items).where(~gates.is_junk(F.col("title"), F.col("text"), F.lit(name)))
    start = F.coalesce(day, dates.parse_date(t, F.to_date("seen")))
    c = worked_out(worked_out(c, t=F.coalesce(compact(F.col("text")), F.col("title"))), head=F.regexp_substr(t, F.lit(head)))
    c = worked_out(worked_out(c, d=dates.number(g(1)), m=dates.number(g(2)), y=dates.number(g(3)), time=g(4)), title=titles.once_of_three(tail), start_date=start)
    return c.select("id", "source_key", "title", "start_date", F.nullif("time", F.lit("")).alias("start_time"), "url").where("title <> ''")


def short_month(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in fixed.SHORT_MONTHS]), F.lower(c)).cast("int")


def badge_cards(items: DataFrame) -> DataFrame:
    """Drafts of cards "PRICES BADGE DATES TITLE TOWN": prices may stack, dates are a range (its start may be missing), an end, a day or a word for today or tomorrow; of cards with one title and start the first stays."""
    months = "|".join(fixed.SHORT_MONTHS)
    cell = rf"(\d{{1,2}})\s+({months})\s+(\d{{4}})"
    bare = cell.replace("(", "(?:").replace("(?:(?:", "(?:")
    t = F.col("title")
    g = lambda p, i: F.regexp_extract(t, rf"(?iu){p}", i)
    iso = lambda p, i: F.when(g(p, i) != "", dates.iso(dates.number(g(p, i + 2)), short_month(g(p, i + 1)), dates.number(g(p, i))))
    span, until, one = rf"Del\s+(?:{cell}\s+)?al\s+{cell}", rf"Hasta el\s+{cell}", rf"\b{cell}\b"
    seen = F.to_date("seen")
    today, tomorrow = r"(?iu)¡(?:Solo|Termina) hoy!", r"(?iu)¡(?:Solo|Termina) mañana!"
    day = F.when(t.rlike(today), F.date_format(seen, "yyyy-MM-dd")).when(t.rlike(tomorrow), F.date_format(F.date_add(seen, 1), "yyyy-MM-dd"))
    is_span, is_until = t.rlike(rf"(?iu){span}"), t.rlike(rf"(?iu){until}")
    start = F.when(is_span, iso(span, 1)).when(~is_until, F.coalesce(iso(one, 1), day))
    end = F.when(is_span, iso(span, 4)).when(is_until, iso(until, 1))
    free = t.rlike(r"(?iu)\bGratis\b")
    amount = F.replace(F.regexp_extract(t, r"(?iu)Desde\s+(\d+(?:[.,]\d+)?)\s*€", 1), F.lit(","), F.lit("."))
    price = F.when(free, "Free").when(amount != "", F.concat(F.lit("€ "), amount))
    names = sorted(fixed.BADGES, key=len, reverse=True)
    head = F.trim(F.regexp_replace(t, fixed.PRICES_BEFORE, ""))
    badge = F.regexp_extract(head, rf"^({'|'.join(names)})(?= |$)", 1)
    known = F.create_map(*[F.lit(x) for kv in fixed.BADGES.items() for x in kv])
    phrase = rf"(?iu)Del\s+(?:{bare}\s+)?al\s+{bare}|Hasta el\s+{bare}|\b{bare}\b|✱?\s*¡(?:Solo|Termina) (?:hoy|mañana)!|Fechas disponibles"
    rest = compact(F.replace(F.regexp_replace(F.substring(head, F.length(badge) + 1, F.length(head)), phrase, " "), F.lit("✱"), F.lit(" ")))
    c = cards_of(items).where(~gates.is_junk(F.col("title"), F.col("text"), F.lit("")))
    c = worked_out(c, price=price, is_free=F.when(free, 1).when(amount != "", 0), start_date=start, end_date=end, category=F.coalesce(F.try_element_at(known, badge), F.lit("culture")), rest=rest)
    last = F.regexp_replace(F.lower(F.regexp_extract("rest", r"(\S+)$", 1)), "[.,;]+$", "")
    town = F.when(F.contains(F.col("rest"), F.lit(" ")), F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.TOWNS.items() for x in kv]), last))
    c = worked_out(c, city=F.coalesce(town, F.lit(fixed.HOME_CITY)), title=F.when(town.isNotNull(), F.trim(F.regexp_replace("rest", r"\s*\S+$", ""))).otherwise(F.col("rest")))
    c = c.select("id", "source_key", "url", "price", "is_free", "start_date", "end_date", "category", "rest", "city", "title")
    first = Window.partitionBy("source_key", norm_title(F.col("title")), "start_date").orderBy("id")
    return c.where("title <> ''").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "rest")


def concert_cards(items: DataFrame, *, name: str = "") -> DataFrame:
    """Drafts of concerts in the region: a card without a date takes that of the latest dated card of its address; those without either go. Titles lose place and date behind them."""
    key = F.lower(F.regexp_replace(F.split("url", "[?#]")[0], "/+$", ""))
    c = worked_out(cards_of(items), key=key, own=dates.parse_date(F.col("title"), F.to_date("seen")))
    c = saved(c.select("id", "source_key", "title", "text", "url", "key", "own"))  # read twice
    twin = c.where("own IS NOT NULL").groupBy("source_key", "key").agg(F.max_by("own", "id").alias("twin"))
    in_province = F.col("title").rlike(fixed.PROVINCE_TAIL) | F.col("title").rlike(fixed.PROVINCE_TOWN)
    c = c.where(in_province & ~gates.is_junk(F.col("title"), F.col("text"), F.lit(name))).join(twin.hint("merge"), ["source_key", "key"], "left")
    c = c.withColumn("start_date", F.coalesce("own", "twin")).where("start_date IS NOT NULL")

    def without_place(t: Column, between: str) -> Column:
        part = lambda i: F.regexp_extract(t, rf"(?i)^(.*\S){between}(.+)$", i)
        is_place = lambda x: (x != "") & (F.length(x) <= 60) & ~x.rlike(r"\d") & (x.rlike(fixed.PROVINCE_TOWN) | x.rlike(rf"{fixed.PROVINCE_TAIL}\s*$"))
        return F.when(once(part(2), is_place), F.trim(part(1))).otherwise(t)

    bare = F.trim(F.regexp_replace("title", fixed.CONCERT_TAIL, ""))
    stripped = once(once(bare, lambda t: without_place(t, r"\s+en\s+")), lambda t: without_place(t, r"\s+-\s+"))
    return worked_out(c, t=stripped).select(
        "id", "source_key", F.when(F.col("t") != "", F.col("t")).otherwise(F.col("title")).alias("title"), "start_date", "url"
    )


def lined(snapshots: DataFrame, before: int, after: int) -> DataFrame:
    """Lines of snapshots, trimmed, empty ones left out, each with so many before (p1, p2, ...) and after (n1, ...) it; a page bounds a window."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s\x{a0}]+", " "))), lambda x: x != "")
    near = lambda x, i: F.struct(i.alias("pos"), x.alias("line"), *[F.get("lines", i - k).alias(f"p{k}") for k in range(1, before + 1)], *[F.get("lines", i + k).alias(f"n{k}") for k in range(1, after + 1)])
    return worked_out(snapshots.select("id", "source_key", "seen", "url", "text"), lines=lines).select("id", "source_key", "seen", "url", F.inline(F.transform("lines", near)))


def latest(items: DataFrame) -> DataFrame:
    """The snapshot of the greatest id of each source."""
    s = items.where("kind = 'page_snapshot'")
    return s.join(s.groupBy("source_key").agg(F.max("id").alias("id")), ["source_key", "id"], "left_semi")


def with_links(drafts: DataFrame, items: DataFrame) -> DataFrame:
    """drafts with the address of the link card of their source that resolves their title, in a column url."""
    links = items.where("kind = 'link_card' AND url IS NOT NULL").select("source_key", F.col("id").alias("pos"), "title", "url")
    return linked(drafts, links)


def ticket_lines(items: DataFrame, *, name: str = "") -> DataFrame:
    """Drafts of cards that a price line ends: before it a venue and, before that, title and date; or title and date at once (an online card, dropped with a time zone from elsewhere).

    Dates are words for days and weekdays, read against the day the page was seen, or English ones. Of one title and day the newest page's counts; link cards give
    addresses by title; those of which no page has the title come undated."""
    pattern = r"(?iu)^(.*?)\s+((?:hoy\b|ma[nñ]ana\b|lunes\b|martes\b|mi[eé]rcoles\b|jueves\b|viernes\b|s[aá]bado\b|domingo\b|(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),\s).*)$"
    hit = lined(items.where("kind = 'page_snapshot'"), 2, 0).where(F.col("line").isin(fixed.CARD_MARKERS))
    two = F.coalesce(F.col("p2").rlike(pattern), F.lit(False))
    card = F.when(two, F.col("p2")).when(F.col("p1").rlike(pattern), F.col("p1"))
    raw = F.regexp_extract(card, pattern, 2)
    hit = hit.where(card.isNotNull()).select("id", "source_key", "seen", "pos", compact(F.regexp_extract(card, pattern, 1)).alias("title"), raw.alias("raw"), F.when(two, F.col("p1")).alias("venue_name"))
    hit = hit.where(F.col("title").isNotNull() & ~(F.col("venue_name").isNull() & F.col("raw").rlike(fixed.FOREIGN_ZONE)) & ~gates.is_junk(F.col("title"), F.col("title"), F.lit(name)))
    expr = F.regexp_replace("raw", r"(?iu)\s*\+\s*\d+\s+(?:more|m[aá]s)\s*$", "")
    t, seen = F.lower(fold(expr)), F.to_date("seen")
    day = F.when(t.rlike(r"\bhoy\b"), seen).when(t.rlike(r"\bmanana\b"), F.date_add(seen, 1))
    for i, w in enumerate(fixed.WEEKDAYS):
        day = day.when(t.rlike(rf"\b{w}\b"), F.date_add(seen, F.pmod(F.lit(i + 1) - F.dayofweek(seen), F.lit(7))))
    start = F.coalesce(F.date_format(day, "yyyy-MM-dd"), dates.parse_date(expr, seen))
    hour, minute, half = (F.regexp_extract(expr, r"(?i)\b(\d{1,2}):(\d{2})(?:\s*(AM|PM)\b)?", i) for i in (1, 2, 3))
    h = dates.number(hour)
    h = F.when(half != "", h % 12 + F.when(F.lower(half) == "pm", 12).otherwise(0)).otherwise(h)
    key = lambda c: F.lower(fold(compact(c)))
    found = hit.select("id", "source_key", "pos", "title", "venue_name", start.alias("start_date"), F.when(h.between(0, 23), F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), minute)).alias("start_time"), key(F.col("title")).alias("key"))
    newest = Window.partitionBy("source_key", "key", "start_date").orderBy(F.desc("id"), "pos")
    found = saved(found.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n", "pos"))  # read twice, and so is link
    link = cards_of(items).groupBy("source_key", key(F.col("title")).alias("key")).agg(F.min_by(F.struct("id", F.split("url", "[?#]")[0].alias("url"), "title"), "id").alias("l"))
    link = saved(link)
    one = found.join(link.hint("merge"), ["source_key", "key"], "left").select(F.coalesce("l.id", "id").alias("id"), "source_key", "title", "start_date", "start_time", "venue_name", F.col("l.url").alias("url"))
    none = F.lit(None).cast("string")
    left = link.join(found.hint("merge"), ["source_key", "key"], "left_anti").select("l.id", "source_key", "l.title", none.alias("start_date"), none.alias("start_time"), none.alias("venue_name"), "l.url")
    return one.unionByName(left.where(~gates.is_junk(F.col("title"), F.col("title"), F.lit(name))))


def dated_lines(items: DataFrame, *, name: str = "") -> DataFrame:
    """Drafts of an agenda's newest page: at each line "D Mon YYYY, HH:MM - D Mon YYYY, HH:MM" (or the first half) a venue line follows, and a description, perhaps a city, and a title stand before.

    Spans of days have no time. Places elsewhere go, but for headliners; of one title and day the first stays; addresses by link cards; the text of the newest detail page of that address, if any, is the description."""
    pattern = r"^(\d{1,2})\s+([A-Za-z]{3,})\s+(\d{4}),\s*(\d{1,2}:\d{2})(?:\s*-\s*(\d{1,2})\s+([A-Za-z]{3,})\s+(\d{4}),\s*(\d{1,2}:\d{2}))?"
    city_line = rf"^(?:{'|'.join([*fixed.AGENDA_CITIES, *fixed.AGENDA_OTHER])})$"
    g = lambda i: F.regexp_extract("line", pattern, i)
    iso = lambda i: F.when(dates.number(g(i)).between(1, 31) & (dates.month_of(g(i + 1)) > 0), dates.iso(dates.number(g(i + 2)), dates.month_of(g(i + 1)), dates.number(g(i))))
    l = lined(latest(items), 3, 1).where(F.col("line").rlike(pattern))  # noqa: E741
    has_city = F.coalesce(F.col("p2").rlike(city_line), F.lit(False))
    city = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.AGENDA_CITIES.items() for x in kv]), F.when(has_city, F.col("p2"))), F.lit(fixed.HOME_CITY))
    venue = F.when(~F.col("n1").rlike(pattern) & ~F.col("n1").rlike(city_line) & (F.length("n1") <= 160), F.col("n1"))
    d = l.select("id", "source_key", "pos", F.when(has_city, F.col("p3")).otherwise(F.col("p2")).alias("title"), F.col("p1").alias("teaser"), city.alias("city"), venue.alias("venue_name"),
        iso(1).alias("start_date"), iso(5).alias("end_date"), g(4).alias("t"))
    d = d.withColumn("start_time", F.when(F.coalesce(F.col("end_date") == F.col("start_date"), F.lit(True)), F.col("t"))).drop("t")
    ok = (F.length("title") >= 3) & ~gates.is_junk(F.col("title"), F.col("teaser"), F.lit(name)) & ~F.col("title").rlike(city_line)
    d = d.where(ok & (gates.in_region(F.col("title"), F.col("city"), F.lit("")) | gates.is_headliner(F.col("title"))))
    first = Window.partitionBy("source_key", F.lower("title"), "start_date").orderBy("pos")
    d = d.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").withColumnRenamed("id", "page_id").withColumn("id", F.concat_ws("-", "page_id", "pos"))
    d = with_links(d, items)
    detail = items.where((F.col("kind") == "event_detail") & (F.trim(empty(F.col("text"))) != "")).groupBy("source_key", "url").agg(F.max_by("text", "id").alias("full"))
    return d.join(detail, ["source_key", "url"], "left").select("page_id", "source_key", "title", F.coalesce("full", "teaser").alias("description"), "city", "venue_name", "start_date", "end_date", "start_time", "url")


def shop_lines(items: DataFrame) -> DataFrame:
    """Drafts of a ticket shop's newest page: lines with a day, perhaps a time, a title and "Country, City, Venue". Only the country, and there the region or headliners."""
    pattern = r"^(\d{1,2})\s+(\p{L}{3,})\.?\s+(\d{4})$"
    part = lambda i: F.regexp_extract("line", pattern, i)

    def named(word: Column) -> Column:
        month = F.lit(None).cast("int")
        for i, words in enumerate(fixed.SHOP_MONTHS):
            month = F.when(word.isin(words), i + 1).otherwise(month)
        return month

    told = F.struct(dates.number(part(1)).alias("d"), once(F.lower(part(2)), named).alias("m"), dates.number(part(3)).alias("y"))
    day = once(told, lambda x: F.when(x["d"].between(1, 31) & x["m"].isNotNull(), dates.iso(x["y"], x["m"], x["d"])))
    timed = F.coalesce(F.col("n1").rlike(r"^\d{1,2}:\d{2}$"), F.lit(False))
    l = worked_out(lined(latest(items), 0, 3).where(F.col("line").rlike(pattern)), start_date=day).where("start_date IS NOT NULL")  # noqa: E741
    l = l.select("id", "source_key", "pos", "start_date", F.when(timed, F.col("n1")).alias("start_time"), F.when(timed, F.col("n2")).otherwise(F.col("n1")).alias("raw"), F.when(timed, F.col("n3")).otherwise(F.col("n2")).alias("place"))  # noqa: E741
    l = l.where((F.length("raw") >= 4) & ~F.col("raw").rlike(pattern) & (F.lower("raw") != "osta pilet"))  # noqa: E741
    parts = F.filter(F.transform(F.split("place", ","), lambda x: F.trim(x)), lambda x: x != "")
    l = worked_out(l, parts=F.when(F.contains(F.col("place"), F.lit(",")) & ~F.col("place").rlike(pattern), once(parts, lambda p: F.when(F.size(p) >= 2, p))))  # noqa: E741
    country, city = F.get("parts", F.lit(0)), F.get("parts", F.lit(1))
    title = F.coalesce(compact(F.regexp_replace("raw", r"\s*\|[^|]*$", "")), F.col("raw"))
    inside = gates.is_region_city(country, city) | (F.lower(F.trim(empty(country))).isin(fixed.COUNTRY_WORDS) & gates.is_headliner(F.col("raw")))
    d = l.where(inside).select("id", "source_key", "pos", title.alias("title"), "start_date", "start_time", city.alias("city"), F.get("parts", F.lit(2)).alias("venue_name"))
    first = Window.partitionBy("source_key", F.lower("title"), "start_date", "start_time").orderBy("pos")
    d = d.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").withColumnRenamed("id", "page_id").withColumn("id", F.concat_ws("-", "page_id", "pos"))
    return with_links(d, items).drop("id", "pos")


def ranged(start: Column, end: Column) -> Column:
    """struct(start, end): none where it is a whole year (a placeholder); without an end that isn't later."""

    def told(x: Column) -> Column:
        s, e = x["s"], x["e"]
        whole_year = (F.substring(s, 5, 6) == "-01-01") & (F.substring(e, 5, 6) == "-12-31") & (F.substring(s, 1, 4) == F.substring(e, 1, 4))
        return F.when(s.isNotNull() & ~F.coalesce(whole_year, F.lit(False)), F.struct(s.alias("start"), F.when(e > s, e).alias("end")))

    return once(F.struct(start.alias("s"), end.alias("e")), told)


def dmy(c: Column, pattern: str, i: int) -> Column:
    parts = F.struct(*[F.regexp_extract(c, pattern, i + k).alias(name) for k, name in enumerate("dmy")])
    return once(parts, lambda x: F.when(dates.number(x["d"]).between(1, 31) & dates.number(x["m"]).between(1, 12), F.concat_ws("-", x["y"], x["m"], x["d"])))


def agenda_ranges(items: DataFrame) -> DataFrame:
    """source_key, key (a folded title) and range of the date lines of all pages, the newest page's last one of a title: "From D to D", "D - D", "From" / "D" / "to D", or a day alone; the title is the nearest of four lines before that can be one."""
    inline, compacted, alone, until = rf"^From\s+{DMY}\s+to\s+{DMY}$", rf"^{DMY}\s*[-–]\s*{DMY}$", rf"^{DMY}$", rf"^to\s+{DMY}$"
    l = lined(items.where("kind = 'page_snapshot'"), 4, 2)  # noqa: E741
    split = (F.col("line") == "From") & F.col("n1").rlike(alone) & F.col("n2").rlike(until)
    eaten = F.coalesce((F.col("p1") == "From") & F.col("n1").rlike(until), F.lit(False))
    r = F.when(F.col("line").rlike(inline), ranged(dmy(F.col("line"), inline, 1), dmy(F.col("line"), inline, 4))).when(F.col("line").rlike(compacted), ranged(dmy(F.col("line"), compacted, 1), dmy(F.col("line"), compacted, 4)))
    r = r.when(split, ranged(dmy(F.col("n1"), alone, 1), dmy(F.col("n2"), until, 1))).when(F.col("line").rlike(alone) & ~eaten, ranged(dmy(F.col("line"), alone, 1), F.lit(None).cast("string")))
    can = lambda c: c.rlike("[a-zA-Zà-ÿÀ-Ÿ]") & ~F.lower(c).isin(fixed.AGENDA_CHROME) & (c != "From") & ~c.rlike(f"{alone}|{until}|{inline}|{compacted}")
    title = F.coalesce(*[F.when(can(F.col(f"p{i}")), F.col(f"p{i}")) for i in range(1, 5)])
    l = worked_out(l.where((F.col("line") == "From") | F.col("line").rlike(r"\d$")), range=r).where("range IS NOT NULL")  # noqa: E741
    l = worked_out(l, key=norm_title(title)).where("key <> ''").select("id", "source_key", "pos", "key", "range")  # noqa: E741
    return l.groupBy("source_key", "key").agg(F.max_by("range", F.struct("id", "pos")).alias("range"))


def agenda_cards(items: DataFrame, *, name: str = "") -> DataFrame:
    """Drafts of an agenda's cards that are no guides, dated by the range glued to their title, else by their pages' date lines of that title (or of one that holds it or is held by it, for
    the most part), else by their text, read from the day seen on; categories by cues."""
    tail = rf"\s*{DMY}\s*[-–]\s*{DMY}\s*$"
    c = worked_out(cards_of(items).select("id", "source_key", "seen", "url", "title", "text"), own=F.col("title").rlike(tail) & dmy(F.col("title"), tail, 1).isNotNull())
    bare = F.when(F.col("own"), F.coalesce(compact(F.regexp_replace("title", tail, "")), F.col("title"))).otherwise(F.col("title"))
    c = worked_out(c, title=bare, glued=F.when(F.col("own"), ranged(dmy(F.col("title"), tail, 1), dmy(F.col("title"), tail, 4)))).drop("own")
    c = c.where(~gates.is_junk(F.col("title"), F.col("text"), F.lit(name)) & ~gates.is_guide(F.col("title"), F.col("url")))
    ranges = agenda_ranges(items)
    links = ranges.select("source_key", F.xxhash64("key").alias("pos"), F.col("key").alias("title"), F.to_json("range").alias("url"))
    c = linked(c.withColumnRenamed("url", "own"), links).withColumnsRenamed({"url": "of_page", "own": "url"})
    c = c.withColumn("range", F.coalesce("glued", F.from_json("of_page", "start string, end string")))
    start = F.coalesce("range.start", dates.parse_date(F.concat_ws(" ", "title", F.regexp_replace(empty(F.col("text")), tail, "")), F.to_date("seen")))
    return c.select("id", "source_key", "title", start.alias("start_date"), F.col("range.end").alias("end_date"), titles.cued(F.concat_ws(" ", "title", "url"), fixed.CARD_CATEGORIES, "culture").alias("category"), "url")
