"""Series and their occurrences: upserts, what they supersede, their place in the feed, and digests of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, titles
from . import read_model as rm

OWNED = ["title", "description", "category", "start_date", "end_date", "venue_name", "district", "address", "price", "is_free", "url", "image_url"]
#: What a series' card and an occurrence's row have their ids above.
CARD_ID, OCCURRENCE_ID = 1_000_000_000, 2_000_000_000


def merged(held: DataFrame, drafts: DataFrame, key: str, owned: list[str], order: str, run_at: Column) -> DataFrame:
    """held after drafts, by a key: of drafts of one key the one of greatest order counts; it gives the owned columns, all others stay; new ones come in as upcoming, first seen now."""
    own = [c for c in owned if c in drafts.columns]
    last = drafts.groupBy(key).agg(F.max_by(F.struct(*own), order).alias("n"))
    j = held.withColumn("old", F.lit(True)).join(last, key, "full")
    new, fresh = F.col("n").isNotNull(), F.col("old").isNull()
    rest = [c for c in held.columns if c not in {*own, key, "last_seen", "first_seen", "status"}]
    seen = [F.when(fresh, run_at).otherwise(F.col("first_seen")).alias("first_seen")] if "first_seen" in held.columns else []
    return j.select(key, *[F.when(new, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in own], *rest, *seen,
        F.when(new, run_at).otherwise(F.col("last_seen")).alias("last_seen"), F.when(fresh, "upcoming").otherwise(F.col("status")).alias("status"))


def upserted(held: DataFrame, drafts: DataFrame, run_at: Column) -> DataFrame:
    """The series table (hash, OWNED columns and others) after drafts (hash, id): scores, enrichment and what readers were told stay."""
    return merged(held, drafts, "hash", OWNED, "id", run_at)


def occurrences_upserted(held: DataFrame, drafts: DataFrame, run_at: Column) -> DataFrame:
    """The occurrences table (hash, series, day, time, status, last_seen) after drafts (series, day, time, end_time): one row a (series, day, time); an unchanged schedule adds none."""
    d = drafts.withColumn("hash", text.occurrence_hash(F.col("series"), F.col("day"), F.col("time"))).withColumn("at", F.coalesce("end_time", F.lit("")))
    return merged(held, d, "hash", ["series", "day", "time", "end_time"], "at", run_at)


def superseded(events: DataFrame, members: DataFrame) -> DataFrame:
    """events whose ids a series has taken (members: id, series) become duplicates and name it in their metadata, which keeps all else that it holds."""
    of = members.groupBy("id").agg(F.min("series").alias("into"))
    j = events.join(of, "id", "left")
    held = F.coalesce(F.from_json("metadata_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(held, lambda k, v: k != "merged_into_series")
    body = F.to_json(F.map_concat(kept, F.create_map(F.lit("merged_into_series"), F.col("into").cast("string"))))
    return j.withColumns({"status": F.when(F.col("into").isNotNull(), "duplicate").otherwise(F.col("status")), "metadata_json": F.when(F.col("into").isNotNull(), body).otherwise(F.col("metadata_json"))}).drop("into")


def ahead(series: DataFrame, occ: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Series that are upcoming (or of no status) and not over, and their occurrences that are."""
    s = series.where(rm.visible(as_of))
    return s, occ.where("status IS NULL OR status = 'upcoming'").join(s.select(F.col("id").alias("series_id")), "series_id", "left_semi")


def series_cards(series: DataFrame) -> DataFrame:
    """id and what a site shows of a series, in its card and its sessions alike: title (Russian, else as it is), excerpt (of the Russian description, else the description, else the raw text), location, category with its label, feature, cleaned
    tags, page, image, price, language, end_date and score. Columns that series lack are null."""
    optional = ("title_ru", "description_ru", "description", "raw_excerpt", "image_url", "price", "language", "source", "tags_json", "category", "district")
    s = series.withColumns({c: F.lit(None).cast("string") for c in optional if c not in series.columns})
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    title, category = F.coalesce(filled("title_ru"), F.col("title")), text.category(F.col("category"))
    page = F.concat(F.lit("/events/series-"), F.col("id"), F.lit("-"), text.page_slug(title, F.concat(F.lit("series-"), "id")))
    return s.select(
        "id", title.alias("title"), text.excerpt(F.coalesce(*[filled(c) for c in ("description_ru", "description", "raw_excerpt")])).alias("excerpt"), titles.event_location().alias("location"), "city", category.alias("category"),
        text.category_label(category).alias("category_label"), rm.feature().alias("feature"), text.clean_tags(text.tags_of(F.col("tags_json"))).alias("tags"), page.alias("page"), titles.image(F.col("image_url")).alias("image"),
        "price", "language", "start_date", "end_date", "score",
    )


def feed_rows(series: DataFrame, occ: DataFrame, as_of: str) -> DataFrame:
    """Rows for the feed and calendar: a card for each series ahead (what series_cards shows, day, date_label, n_occurrences, calendar_only) and a row, for the calendar only, for each of its occurrences ahead, with its own day, time and label."""
    s, o = ahead(series, occ, as_of)
    n = o.groupBy("series_id").agg(F.count("*").alias("n"))
    shown = series_cards(s)
    shared = [c for c in shown.columns if c not in ("id", "start_date")]
    label = lambda c: F.date_format(rm.day(F.col(c)), "dd.MM.yyyy")
    span = F.concat(label("start_date"), F.when(F.col("end_date") != F.col("start_date"), F.concat(F.lit("–"), label("end_date"))).otherwise(""))
    card = shown.join(n, shown["id"] == n["series_id"], "left").select((F.col("id") + CARD_ID).alias("id"), F.col("id").alias("series_id"), *shared, span.alias("date_label"), F.col("start_date").alias("day"),
        F.lit(None).cast("string").alias("time"), F.coalesce("n", F.lit(0)).alias("n_occurrences"), F.lit(False).alias("calendar_only"))
    own = o.select("series_id", (F.col("id") + OCCURRENCE_ID).alias("oid"), "day", "time")
    when = F.concat(label("day"), F.when(text.empty(F.col("time")) != "", F.concat(F.lit(" "), "time")).otherwise(""))
    rows = shown.join(own, shown["id"] == own["series_id"]).select(F.col("oid").alias("id"), "series_id", *shared, when.alias("date_label"), "day", "time", F.lit(0).cast("long").alias("n_occurrences"), F.lit(True).alias("calendar_only"))
    return card.unionByName(rows)


def united(singles: DataFrame, series_rows: DataFrame) -> DataFrame:
    """Single events (id, title, day, end_date, time, score, city and more) and series' rows as one feed: by score (none: -1) downward, day (none: last), title, id."""
    one = singles.withColumns({"calendar_only": F.lit(False), "series_id": F.lit(None).cast("long"), "n_occurrences": F.lit(0).cast("long")})
    return rm.ordered(one.unionByName(series_rows, allowMissingColumns=True))


def due_in_digest(series: DataFrame, occ: DataFrame, as_of: str, days: int, least: int) -> DataFrame:
    """Series for the weekly digest: not notified, upcoming, fit for it, scored so high at least, and next held within so many days: at a day named by itself, else at its
    first occurrence ahead that isn't cancelled, else at its start. start_date becomes that day."""
    n = rm.next_occurrence(occ.withColumnRenamed("series_id", "series"), as_of).withColumnRenamed("series", "sid")
    j = series.where("notified = 0 AND status = 'upcoming'").join(n, F.col("id") == F.col("sid"), "left")
    j = j.withColumn("next_day", F.coalesce("next_occurrence", "next_day", "start_date")).drop("sid")
    until = F.date_format(F.date_add(F.to_date(F.lit(as_of)), days), "yyyy-MM-dd")
    return j.where(rm.digest_gate() & (F.col("score") >= least) & F.col("next_day").between(F.lit(as_of), until)).withColumn("start_date", F.col("next_day"))


def candidates(events: DataFrame) -> DataFrame:
    """Upcoming events that readers haven't been told of, best first."""
    return events.where("notified = 0 AND status = 'upcoming'").orderBy(F.desc_nulls_last("score"), "id")


def new_places(places: DataFrame) -> DataFrame:
    return places.where("notified = 0").orderBy(F.desc("id"))


def payload(mode: str, events: DataFrame, series: DataFrame, occ: DataFrame, places: DataFrame, as_of: str) -> DataFrame:
    """kind, id and day of all that a mail holds: weekly has events, series and new places; an alert has rare events only."""
    as_row = lambda df, kind, day: df.select(F.lit(kind).alias("kind"), "id", day.alias("day"))
    if mode == "alert":
        return as_row(rm.alerts(candidates(events)), "event", F.col("start_date"))
    e, s = rm.digest(candidates(events), as_of), due_in_digest(series, occ, as_of, rm.fixed.DIGEST_DAYS, rm.fixed.DIGEST_SCORE)
    none = F.lit(None).cast("string")
    return as_row(e, "event", F.col("start_date")).unionByName(as_row(s, "series", F.col("start_date"))).unionByName(as_row(new_places(places), "place", none))


def badge(end: Column, as_of: str) -> Column:
    """Of an exposition: permanent without an end or with one over a year ahead, else until when."""
    far = F.date_diff(rm.day(end), F.to_date(F.lit(as_of))) > 365
    return F.when(end.isNull() | F.coalesce(far, F.lit(True)), "permanent").otherwise(F.concat(F.lit("until "), F.date_format(rm.day(end), "d MMM")))


def catalogue(places: DataFrame, category: str | None = None, area: str | None = None, tag: str | None = None, words: str | None = None) -> DataFrame:
    """Places (id, name, category, area, district, city, description, last_seen, tags), those last seen latest first, then by name, that meet all that is asked for."""
    if category:
        places = places.where(F.col("category") == category)
    if area:
        places = places.where(F.coalesce(F.nullif("area", F.lit("")), "district") == area)
    if tag:
        places = places.where(F.array_contains("tags", tag))
    if words:
        places = places.where(F.lower(F.concat_ws(" ", "name", "description", "category", "area", "district", F.array_join("tags", " "))).contains(words.lower()))
    shown = places.select("id", "name", "category", "area", titles.place_location().alias("location"), text.excerpt(F.col("description")).alias("excerpt"), "tags", "last_seen",
        F.concat(F.lit("/places/"), "id", F.lit("-"), text.page_slug(F.col("name"), F.concat(F.lit("place-"), "id"))).alias("page"))
    return shown.orderBy(F.desc("last_seen"), "name", "id")


def by_id(table: DataFrame, id_: int) -> DataFrame:
    return table.where(F.col("id") == id_)


def rescored(events: DataFrame, as_of: str) -> DataFrame:
    """The events table with new scores where it is upcoming or of no status; other rows keep theirs."""
    live = F.col("status").isNull() | (F.col("status") == "upcoming")
    return events.withColumn("score", F.when(live, rm.score(as_of)).otherwise(F.col("score")))


def retagged(events: DataFrame) -> DataFrame:
    """The events table with tags_json anew in every row."""
    return events.withColumn("tags_json", F.to_json(rm.event_tags(events)))


def places_retagged(places: DataFrame) -> DataFrame:
    """The places table with tags_json anew in every row."""
    return places.withColumn("tags_json", F.to_json(rm.place_tags(places)))
