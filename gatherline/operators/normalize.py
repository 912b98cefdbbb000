"""From source items to event drafts: one job per shape of source, and how drafts meet the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.storage import saved

DRAFT_COLUMNS = ["title", "description", "category", "start_date", "end_date", "start_time", "venue_name", "district", "address", "price", "is_free", "url", "source_url", "image_url", "source_item_id"]


def posts(items: DataFrame, category: str | None = None, needs_date: bool = False) -> DataFrame:
    """Drafts of chat posts (id, source_key, text, seen): headline, date from the day seen on, price; posts under 12 characters without a date or venue cue go."""
    price = dates.price(F.col("text"))
    start = dates.parse_date(F.col("text"), F.to_date("seen"))
    d = text.worked_out(text.spread(items), title=dates.headline(F.col("text")), start_date=start, price=price, time=F.regexp_extract("text", r"(?<!\d)([01]\d|2[0-3]):([0-5]\d)(?!\d)", 0))
    d = d.select("id", "source_key", "title", "start_date", "price.price", "price.is_free", F.nullif("time", F.lit("")).alias("start_time"), F.lit(category).cast("string").alias("category"), "text")
    cue = F.col("text").rlike(r"(?iu)📍|адрес|где:|место:|dónde|lugar")
    d = d.where((F.length("text") >= 12) & (F.col("start_date").isNotNull() | (F.lit(not needs_date) & cue)) & F.col("title").isNotNull())
    return d.drop("text")


def cards(items: DataFrame) -> DataFrame:
    """Drafts of flattened cards (id, source_key, text, seen): TITLE, then a rating, a range "5 dic - 6 feb" without years, and "Desde N,NN €" in some order; the end of a range is after its start."""
    span = rf"(\d{{1,2}}) ({dates.WORD})(?: - (\d{{1,2}}) ({dates.WORD}))?"
    tail = rf"\s+(?:\d[.,]\d(?!\d)|{span.replace('(', '(?:', 0)}|Desde \d).*$"
    t = text.compact(F.col("text"))
    part = lambda i: F.regexp_extract(t, rf"(?<![\d\p{{L}}]){span}(?= Desde|$| \d[.,]\d)", i)
    seen = F.to_date("seen")

    def after(d: Column, m: Column, from_: Column) -> Column:
        in_year = F.expr("1").cast("int") * 0 + F.year(from_)
        this = F.make_date(in_year, m, d)
        return F.when(this < from_, F.make_date(in_year + 1, m, d)).otherwise(this)

    start = after(dates.number(part(1)), dates.month_of(part(2)), seen)
    d = items.select("id", "source_key", F.regexp_replace(t, tail, "").alias("title"), start.alias("s"), dates.number(part(3)).alias("d2"), dates.month_of(part(4)).alias("m2"), dates.price(t)["price"].alias("price"))
    d = d.withColumn("e", after(F.col("d2"), F.col("m2"), F.col("s")))
    return d.select("id", "source_key", "title", F.date_format("s", "yyyy-MM-dd").alias("start_date"), F.date_format("e", "yyyy-MM-dd").alias("end_date"), "price")


def tickets(items: DataFrame, city: str = "Valencia") -> DataFrame:
    """Drafts of "Entradas TITLE, CITY VENUE D/M/YY, HH:MM"."""
    p = rf"^Entradas (.+), {city} (.+?) (\d{{1,2}})/(\d{{1,2}})/(\d{{2}}), (\d{{2}}:\d{{2}})$"
    g = lambda i: F.regexp_extract("text", p, i)
    day = dates.iso(dates.number(g(5)) + 2000, dates.number(g(4)), dates.number(g(3)))
    return items.where(F.col("text").rlike(p)).select("id", "source_key", g(1).alias("title"), g(2).alias("venue_name"), day.alias("start_date"), g(6).alias("start_time"))


def lines(snapshots: DataFrame) -> DataFrame:
    """Drafts of snapshots whose text has blocks of a title line, ": DD/MM/YYYY", "– DD/MM/YYYY" (if it ends later), "Recinto:" and a venue line; blocks without a date go.

    Lines look at their neighbours within a snapshot; the newest snapshot of a source that has a (title, start) counts."""
    w = Window.partitionBy("id").orderBy("pos")
    one = snapshots.select("id", "source_key", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    dmy = lambda c: F.date_format(F.to_date(F.regexp_extract(c, r"(\d{2}/\d{2}/\d{4})", 1).try_cast("string"), "dd/MM/yyyy"), "yyyy-MM-dd")
    look = one.select("id", "source_key", "pos", "line", F.lag("line").over(w).alias("title"), *[F.lead("line", i).over(w).alias(f"n{i}") for i in (1, 2, 3)])
    hit = look.where(F.col("line").rlike(r"^: \d{2}/\d{2}/\d{4}$") & F.col("title").isNotNull())
    ends = F.col("n1").rlike(r"^– \d{2}/\d{2}/\d{4}$")
    venue = F.when(ends & (F.col("n2") == "Recinto:"), F.col("n3")).when(F.col("n1") == "Recinto:", F.col("n2"))
    d = hit.select("id", "source_key", "title", dmy("line").alias("start_date"), F.when(ends, dmy("n1")).alias("end_date"), venue.alias("venue_name"))
    g = d.groupBy("source_key", "title", "start_date").agg(F.max_by(F.struct("end_date", "venue_name"), "id").alias("v"), F.max("id").alias("id"))
    return g.select("id", "source_key", "title", "start_date", "v.end_date", "v.venue_name")


def paired(items: DataFrame) -> DataFrame:
    """One draft per url of items (id, url, text): its first dated row's date, and its longest undated row as the title."""
    day = F.regexp_extract("text", r"(\d{4}-\d{2}-\d{2})", 1)
    i = items.withColumn("day", F.nullif(day, F.lit("")))
    longest = F.struct(F.length("text").alias("n"), (-F.col("id")).alias("i"), F.col("text").alias("t"))
    g = i.groupBy("url").agg(F.min_by("day", F.when(F.col("day").isNotNull(), F.col("id"))).alias("start_date"), F.max(F.when(F.col("day").isNull(), longest)).alias("t"))
    return g.where("start_date IS NOT NULL AND t IS NOT NULL").select("url", F.col("t.t").alias("title"), "start_date")


def scheduled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Series (show, first and last day, n) and occurrences (show, day, time) of schedule rows (show, day, times: array)."""
    occ = rows.select("show", "day", F.explode_outer("times").alias("time"))
    return rows.groupBy("show").agg(F.min("day").alias("start_date"), F.max("day").alias("end_date"), F.count("*").alias("n")), occ


def linked(drafts: DataFrame, links: DataFrame) -> DataFrame:
    """drafts (id, source_key, title) with the url of the best of its source's links (source_key, pos, title, url): equal titles, else one in the
    other (8 characters and 60 % at least), else 60 % of words in common; ties go to the first link. A number stands in a title as a whole or not at all: "Show 65" is no part of "Show 65500". Links meet drafts that share a word with them.

    Drafts are written once with the words of their titles, as they are read twice."""
    key = lambda df, t, u: text.worked_out(df, **{t: text.norm_title(F.col("title"))}).withColumn(u, F.array_distinct(F.split(F.col(t), " ")))
    titles = saved(key(drafts, "k", "ws"))
    d = titles.where("k <> ''").select("source_key", "k", "ws").distinct().withColumn("w", F.explode("ws"))  # drafts of one title meet links once
    n = key(links, "k2", "ws2").where("k2 <> ''").groupBy("source_key", "k2", "ws2").agg(F.min(F.struct("pos", "url")).alias("l")).select("source_key", "l.pos", "l.url", "k2", "ws2", F.explode("ws2").alias("w"))
    low, high = F.least(F.length("k"), F.length("k2")), F.greatest(F.length("k"), F.length("k2"))
    whole = lambda c: F.regexp_replace(c, "([0-9]+)", "<$1>")
    inside = (low >= 8) & (low >= 0.6 * high) & (F.col("k").contains(F.col("k2")) | F.col("k2").contains(F.col("k")))
    inside = inside & (whole("k").contains(whole("k2")) | whole("k2").contains(whole("k")))
    both = F.size("ws") + F.size("ws2")
    alike = F.when(F.least(F.size("ws"), F.size("ws2")) >= 0.6 * F.greatest(F.size("ws"), F.size("ws2")), text.once(F.size(F.array_intersect("ws", "ws2")), lambda c: c / (both - c)))  # words in common of all: words are distinct
    told = text.once(alike, lambda c: F.when(c >= 0.6, F.struct(F.lit(2).alias("t"), (-c).alias("s"))))
    rank = F.when(F.col("k") == F.col("k2"), F.struct(F.lit(0).alias("t"), F.lit(0.0).alias("s"))).when(inside, F.struct(F.lit(1).alias("t"), (-low / high).alias("s"))).otherwise(told)
    j = d.join(n.hint("merge"), ["source_key", "w"])  # by sort-merge, here and below: split titles take far more than their files. A pair comes by each word it shares, which changes no least
    best = text.worked_out(j.select("source_key", "k", "k2", "ws", "ws2", "pos", "url"), rank=rank).where("rank IS NOT NULL").groupBy("source_key", "k").agg(F.min(F.struct("rank", "pos", "url")).alias("b"))
    return titles.join(best.hint("merge"), ["source_key", "k"], "left").select(*drafts.columns, F.col("b.url").alias("url"))


def upserted(events: DataFrame, drafts: DataFrame, run_at: Column) -> DataFrame:
    """The events table after drafts (hash and some of DRAFT_COLUMNS; the greatest id of a hash counts): known hashes take the drafts' columns and keep all others, new ones come in as upcoming."""
    own = [c for c in DRAFT_COLUMNS if c in drafts.columns]
    last = drafts.groupBy("hash").agg(F.max_by(F.struct(*own), "id").alias("n"))
    j = events.withColumn("old", F.lit(True)).join(last, "hash", "full")
    rest = [c for c in events.columns if c not in {*own, "hash", "last_seen", "status"}]
    return j.select("hash", *[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in own], *rest,
        F.when(F.col("n").isNotNull(), run_at).otherwise(F.col("last_seen")).alias("last_seen"), F.when(F.col("old").isNull(), "upcoming").otherwise(F.col("status")).alias("status"))


def reconciled(events: DataFrame, produced: DataFrame, source: str) -> DataFrame:
    """events of a source that a run has not produced again (hash) become duplicates."""
    made = produced.select("hash", F.lit(True).alias("made")).distinct()
    j = events.join(made, "hash", "left")
    return j.withColumn("status", F.when((F.col("source") == source) & F.col("made").isNull(), "duplicate").otherwise(F.col("status"))).drop("made")
