"""Event drafts of listings whose cards run a venue and a title together, and of pages whose blocks a title in capitals opens.

Venues are told apart by a table of known names (venue), of any size: the longest that a card begins or ends with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, fixed
from ..functions.storage import saved
from ..functions.text import compact, empty, once, worked_out
from . import gates
from .listings import cards_of, latest, short_month, with_links


def known_venues(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "venue string")


def venue_split(heads: DataFrame, venues: DataFrame, at_end: bool) -> DataFrame:
    """heads (id, head: words with single blanks) with venue and rest: the longest known venue (venue) that a head begins (at_end: ends) with, whole words only, and the other words; of a head that is a venue, itself.
    Without one, venue is null and rest the head.

    A head meets venues by equality of its first (last) words, as many as the longest name has; equal heads meet once."""
    known = venues.select(compact(F.col("venue")).alias("venue")).where("venue IS NOT NULL").distinct()
    longest = known.agg(F.coalesce(F.max(F.size(F.split("venue", " "))), F.lit(0))).first()[0]
    words = F.split("head", " ")
    size = F.least(F.size(words), F.lit(longest))
    at = F.when(F.lit(at_end), F.size(words) - F.col("k") + 1).otherwise(F.lit(1))
    distinct = heads.select("head").where("head IS NOT NULL").distinct()
    ends = distinct.select("head", words.alias("words"), F.explode(F.filter(F.sequence(F.lit(0), size), lambda k: k > 0)).alias("k"))
    ends = ends.select("head", "words", "k", F.array_join(F.slice("words", at.cast("int"), F.col("k")), " ").alias("venue"))
    found = ends.join(known, "venue").groupBy("head").agg(F.max(F.struct("k", "venue", "words")).alias("b"))
    left = F.size("b.words") - F.col("b.k")
    begin = F.lit(1) if at_end else F.col("b.k") + 1
    rest = F.when(left == 0, F.col("b.venue")).otherwise(F.array_join(F.slice("b.words", begin, left), " "))
    return heads.join(found.select("head", F.col("b.venue").alias("venue"), rest.alias("rest")), "head", "left").withColumn("rest", F.coalesce("rest", "head"))


def experience_cards(items: DataFrame, *, venues: list[str] | DataFrame = fixed.EXPERIENCE_VENUES) -> DataFrame:
    """Drafts of cards "N N VENUE TITLE 4.7 (469) 5 dic - 6 feb Desde 12,00 €": rank, rating, days and price in any order after the title, and each may be missing; gift cards and waiting lists go.

    Days have no year: the first is the next such day from the day seen on, the last is in its year, or in the next if its month comes before."""
    months = "|".join([*fixed.SHORT_MONTHS, "sept"])
    cell = rf"(\d{{1,2}})\s+({months})\b"
    days, rating, price = rf"(?i){cell}(?:\s*-\s*{cell})?", r"\s\d\.\d\s*\(\d+\)", r"(?i)(?:Desde\s*)?(\d+[.,]\d{2})\s*€"
    c = cards_of(items).where(~gates.is_product(F.col("title")))
    ranked = F.regexp_replace("title", r"^(\d{1,2})\s+\1\s+", "")
    c = worked_out(c, _t=ranked)
    cut = F.least(*[F.nullif(F.regexp_instr("_t", F.lit(p)), F.lit(0)) for p in (rating, days, price)])
    c = worked_out(c, head=compact(once(cut, lambda n: F.when(n.isNotNull(), F.substring("_t", F.lit(1), n - 1)).otherwise(F.col("_t"))))).where("head IS NOT NULL")
    g = lambda i: F.regexp_extract("title", days, i)
    month = lambda i: short_month(F.regexp_replace(F.lower(g(i)), "^sept$", "sep"))

    def spanned(x: Column) -> Column:
        passed = (x["m"] < F.month(x["seen"])) | ((x["m"] == F.month(x["seen"])) & (x["d"] < F.dayofmonth(x["seen"])))
        year = F.year(x["seen"]) + F.when(passed, 1).otherwise(0)
        good = (x["m"] > 0) & x["d"].between(1, 31)
        last = good & (x["m2"] > 0) & x["d2"].between(1, 31)
        return F.struct(F.when(good, dates.iso(year, x["m"], x["d"])).alias("start"), F.when(last, dates.iso(year + F.when(x["m2"] < x["m"], 1).otherwise(0), x["m2"], x["d2"])).alias("end"))

    told = F.struct(F.to_date("seen").alias("seen"), dates.number(g(1)).alias("d"), month(2).alias("m"), dates.number(g(3)).alias("d2"), month(4).alias("m2"))
    amount = F.replace(F.regexp_extract("title", price, 1), F.lit(","), F.lit("."))
    c = worked_out(c, span=once(told, spanned), price=F.when(amount != "", F.concat(F.lit("€ "), amount)))
    c = saved(c.select("id", "source_key", "url", "head", "span", "price"))  # read twice: for distinct heads, and where their venues come back
    known = venues if isinstance(venues, DataFrame) else known_venues(items.sparkSession, venues)
    return venue_split(c, known, False).select("id", "source_key", F.col("rest").alias("title"), F.col("span.start").alias("start_date"), F.col("span.end").alias("end_date"), F.col("venue").alias("venue_name"), "price", F.lit("concert").alias("category"), "url")


def box_office_cards(items: DataFrame, *, name: str = "", venues: list[str] | DataFrame = fixed.BOX_OFFICE_VENUES) -> DataFrame:
    """Drafts of cards of two forms: "Entradas TITLE, Valencia VENUE 27/6/26, 21:00", and "sábado, 27 de junio de 2026, 21:00 sáb. 27 jun. 21:00 TITLE VENUE"; any other is a title and perhaps a venue.

    Of the first form what stands for the venue is one, and is told by its known name where it ends with it."""
    offer, tail = r"(?i)^Entradas\s+(.+?),\s*Valencia\s+(.+)$", r"\s+\d{1,2}/\d{1,2}/\d{2,4},?\s*\d{1,2}:\d{2}\s*$"
    word = "[A-Za-zÀ-ÿ]+"
    before = rf"^{word},\s*\d{{1,2}}\s+de\s+{word}\s+de\s+\d{{4}},\s*\d{{1,2}}:\d{{2}}\s+{word}\.?\s+\d{{1,2}}\s+{word}\.?\s+(?:\d{{4}}\s+)?\d{{1,2}}:\d{{2}}\s+"
    c = cards_of(items).where(~gates.is_junk(F.col("title"), F.col("text"), F.lit(name)))
    is_offer = F.col("title").rlike(offer)
    bare = F.coalesce(compact(F.regexp_replace("title", before, "")), F.col("title"))
    c = worked_out(c, named=F.when(is_offer, compact(F.regexp_extract("title", offer, 1))), head=F.when(is_offer, compact(F.regexp_replace(F.regexp_extract("title", offer, 2), tail, ""))).otherwise(bare))
    hour, minute = (F.regexp_extract("title", r"\b(\d{1,2}):(\d{2})\b", i) for i in (1, 2))
    time = F.when((dates.number(hour) <= 23) & (dates.number(minute) <= 59), F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute))
    price = dates.price(F.col("title"))
    c = worked_out(c, start_date=dates.parse_date(F.col("title"), F.to_date("seen")), start_time=time, cost=price)
    c = saved(c.select("id", "source_key", "url", "named", "head", "start_date", "start_time", "cost.price", "cost.is_free"))  # read twice
    known = venues if isinstance(venues, DataFrame) else known_venues(items.sparkSession, venues)
    d = venue_split(c, known, True)
    title, venue = F.coalesce("named", "rest"), F.coalesce("venue", F.when(F.col("named").isNotNull(), F.col("head")))
    return d.select("id", "source_key", title.alias("title"), "start_date", "start_time", venue.alias("venue_name"), "price", "is_free", F.lit("concert").alias("category"), "url").where("title IS NOT NULL")


def paired_cards(items: DataFrame) -> DataFrame:
    """Drafts of concerts and festivals, of which an address has a dated card "Tue 17 Nov 2026 VENUE CITY, Spain" (the first counts) and titles (the longest counts) that may end with the venue; one without a title has the venue for it."""
    dated = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+(\d{1,2})\s+([A-Za-z]{3,4})\s+(\d{4})\b"
    c = cards_of(items).where(F.col("url").isNotNull()).withColumn("is_date", F.col("title").rlike(dated))
    longest = F.struct(F.length("title").alias("n"), (-F.col("id")).alias("i"), "title", "text", "id")
    g = c.groupBy("source_key", "url").agg(F.max(F.when(~F.col("is_date"), longest)).alias("t"), F.min(F.when(F.col("is_date"), F.struct("id", "title", "text"))).alias("d"))
    g = g.where(~gates.is_junk(F.coalesce("t.title", "d.title"), F.coalesce("t.text", F.when(F.col("t").isNull(), F.col("d.text"))), F.lit("")))
    part = lambda i: F.regexp_extract("d.title", dated, i)
    english = F.array(*[F.lit(m) for m in fixed.ENGLISH_MONTHS])
    month = F.array_position(english, F.regexp_replace(F.lower(part(2)), "^sept$", "sep")).cast("int")
    good = (month > 0) & dates.number(part(1)).between(1, 31)
    tail = F.regexp_replace(F.regexp_replace("d.title", dated, ""), r"(?i),\s*(?:Spain|España)\s*$", "")
    venue = F.when(good, compact(F.regexp_replace(tail, fixed.TOWN_AFTER, "")))
    g = g.withColumn("venue_name", venue).withColumn("start_date", F.when(good, dates.iso(dates.number(part(3)), month, dates.number(part(1)))))
    at = F.length("t.title") - F.length("venue_name")
    ends = (at > 1) & (F.lower(F.substring("t.title", at, F.length("t.title"))) == F.concat(F.lit(" "), F.lower("venue_name")))
    title = F.when(F.col("t").isNull(), F.coalesce("venue_name", "d.title")).when(ends, compact(F.substring("t.title", F.lit(1), at - 1))).otherwise(F.col("t.title"))
    return g.select(F.coalesce("t.id", "d.id").alias("id"), "source_key", title.alias("title"), "start_date", "venue_name", F.lit("concert").alias("category"), "url")


def line_date(c: Column) -> Column:
    """A line that is a date, perhaps after a colon or dash: D/M/Y, or day, Spanish or Catalan month and year; null for any other."""
    t = F.regexp_replace(empty(compact(c)), r"^[:–—-]\s*", "")
    numeric, worded = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$", r"^(\d{1,2})\s+(\p{L}{3,})\.?\s+(\d{4})$"
    g = lambda p, i: F.regexp_extract(t, p, i)

    def named(w: Column) -> Column:
        out = F.lit(None).cast("int")
        for i, stem in reversed([*enumerate(fixed.SPANISH_STEMS, 1)]):
            out = F.when(w.rlike(f"^({stem})"), i).otherwise(out)
        return F.when(w != "", out)

    month = once(F.lower(g(worded, 2)), named)
    year = dates.number(g(numeric, 3))
    d, m = dates.number(g(numeric, 1)), dates.number(g(numeric, 2))
    plain = F.when(d.between(1, 31) & m.between(1, 12), dates.iso(F.when(year < 100, year + 2000).otherwise(year), m, d))
    return F.coalesce(plain, F.when((month > 0) & dates.number(g(worded, 1)).between(1, 31), dates.iso(dates.number(g(worded, 3)), month, dates.number(g(worded, 1)))))


def marked_lines(snapshots: DataFrame) -> DataFrame:
    """Lines of snapshots (id, text) in order, with what each is: title (in capitals for the most part), status, date, venue mark, end of a card, section head or text, and the number of the card that it belongs to (0: before the first).

    A card begins at its title and goes on to the next one: a running sum over a page's lines. Lines behind the end of a card are of none."""
    trimmed = F.filter(F.transform(F.split(empty(F.col("text")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s\x{a0}]+", " "))), lambda x: x != "")
    l = snapshots.select("id", "source_key", "seen", F.posexplode(trimmed).alias("pos", "line"))  # noqa: E741
    l = worked_out(l, day=line_date(F.col("line")))  # noqa: E741
    kind = F.when(F.col("line").rlike(r"(?i)^(temporal|permanente)$"), "status").when(F.col("day").isNotNull(), "date").when(F.col("line").rlike(r"(?i)^recinto\s*:?$"), "mark")
    kind = kind.when(F.col("line").rlike(fixed.CARD_END), "end").when(F.col("line").rlike(fixed.SECTION_HEAD), "section")
    letters, capitals = F.length(F.regexp_replace("line", r"[^A-Za-zÀ-ÿА-Яа-яЁё]", "")), F.length(F.regexp_replace("line", r"[^A-ZÀ-ÝА-ЯЁ]", ""))
    titled = ~F.col("line").rlike("^[:–—-]") & (F.length("line") >= 5) & (letters >= 4) & (capitals >= 0.6 * letters)
    l = worked_out(l, kind=kind.when(titled, "title").otherwise("text"))  # noqa: E741
    page = Window.partitionBy("id").orderBy("pos")
    l = l.withColumn("card", F.sum((F.col("kind") == "title").cast("int")).over(page))  # noqa: E741
    ended = F.sum((F.col("kind") == "end").cast("int")).over(Window.partitionBy("id", "card").orderBy("pos")) > 0
    return l.withColumn("card", F.when(~ended, F.col("card")))


def block_cards(items: DataFrame, *, exhibitions: bool = False) -> DataFrame:
    """Drafts of the cards of a source's newest page: title, first and second date, venue (the first line of text after its mark), description (the first line of text over 20 characters that is not the venue).

    Undated cards take a day in their title, read from the day seen on; those without any go, and so do promotions. A card is an exhibition if its source has only such, it has a status, its title says so, or it lasts four days at
    least. Of one title and start the first stays; addresses by link cards."""
    l = marked_lines(latest(items)).where("card > 0")  # noqa: E741
    at = lambda kind: F.when(F.col("kind") == kind, F.col("pos"))
    mark = F.min(at("mark")).over(Window.partitionBy("id", "card"))
    l = l.withColumn("mark", mark).withColumn("venue_at", F.min(F.when((F.col("kind") == "text") & (F.col("pos") > F.col("mark")), F.col("pos"))).over(Window.partitionBy("id", "card")))  # noqa: E741
    is_text = (F.col("kind") == "text") & ~F.col("pos").eqNullSafe(F.col("venue_at")) & (F.length("line") > 20)
    days = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "date", F.struct("pos", "day")))), lambda x: x["day"])
    b = l.groupBy("id", "source_key", "seen", "card").agg(
        F.min(at("title")).alias("pos"), F.min(F.when(F.col("kind") == "title", F.col("line"))).alias("title"), days.alias("days"), F.max(F.col("kind") == "status").alias("has_status"),
        F.max(F.when(F.col("pos") == F.col("venue_at"), F.col("line"))).alias("venue_name"), F.min(F.when(is_text, F.struct("pos", "line")))["line"].alias("description"),
    )
    b = b.where(~gates.is_promotion(F.col("title")))
    named = [F.nullif(F.regexp_extract("title", r"(?i)(\d{1,2})\s+de\s+([A-Za-zÀ-ÿ]{3,})", i), F.lit("")) for i in (1, 2)]
    none = F.lit(None).cast("string")
    start = F.coalesce(F.get("days", F.lit(0)), dates.anchored_date(F.concat_ws(" de ", *named), none, F.col("seen"), none))
    b = worked_out(b, start_date=start).where("start_date IS NOT NULL").withColumn("end_date", F.nullif(F.get("days", F.lit(1)), F.col("start_date")))
    lasting = F.coalesce(F.date_diff(F.col("end_date").try_cast("date"), F.col("start_date").try_cast("date")) >= fixed.EXHIBITION_DAYS, F.lit(False))
    shown = F.lit(exhibitions) | F.col("has_status") | F.col("title").rlike(fixed.EXHIBITION_TITLE) | lasting
    first = Window.partitionBy("source_key", F.lower("title"), "start_date").orderBy("pos")
    b = b.withColumn("n", F.row_number().over(first)).where("n = 1").withColumnRenamed("id", "page_id").withColumn("id", F.concat_ws("-", "page_id", "card"))
    price = dates.price(F.concat_ws(" ", "title", "description"))
    d = b.select("id", "page_id", "source_key", F.substring("title", 1, 300).alias("title"), "description", F.when(shown, fixed.EXHIBITION).otherwise("culture").alias("category"), "start_date", "end_date",
        F.coalesce("venue_name", F.lit(fixed.BLOCK_VENUE)).alias("venue_name"), price["price"].alias("price"), price["is_free"].alias("is_free"))
    return with_links(saved(d), items)  # read several times
