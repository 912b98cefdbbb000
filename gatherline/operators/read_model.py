"""Scores, tags, the feed, calendars, facets, series and digests. The day of reference is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text


def points(c: Column, table: dict[str, int], other: Column | int = 0) -> Column:
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(known, text.empty(c)), other if isinstance(other, Column) else F.lit(other))


def day(c: Column) -> Column:
    return c.cast("string").substr(1, 10).try_cast("date")


def score(as_of: str) -> Column:
    """Relevance from 0 to 100 of rows with source, source_weight, language, category, city, audience, start_date, end_date, title, description and is_free."""
    days = F.date_diff(day(F.col("start_date")), F.to_date(F.lit(as_of)))
    run = F.coalesce(F.greatest(F.date_diff(day(F.col("end_date")), day(F.col("start_date"))), F.lit(0)), F.lit(0))
    words = F.concat(F.lower(text.empty(F.col("title"))), F.lit(" "), F.lower(text.empty(F.col("description"))))
    soon = F.when(days.isNull(), -24).when(days < 0, -40).when(days <= 7, 20).when(days <= 21, 16).when(days <= 45, 10).when(days <= 90, 4).otherwise(-6)
    total = (
        points(F.col("source_weight"), fixed.WEIGHT_SCORE)
        + points(F.col("language"), fixed.LANGUAGE_SCORE)
        + points(F.col("category"), fixed.CATEGORY_SCORE)
        + points(F.col("city"), fixed.CITY_SCORE, F.when(text.empty(F.col("city")) != "", 1).otherwise(0))
        + points(F.col("audience"), {"family": 10, "adult": 4})
        + soon
        - F.when(run >= 120, 26).when(run >= 45, 12).otherwise(0)
        + F.when(text.any_word(words, fixed.GOOD_WORDS), 4).otherwise(0)
        - F.when(text.any_word(words, fixed.DULL_WORDS), 22).otherwise(0)
        + F.when(F.col("is_free") == 1, 4).otherwise(0)
        - F.when((F.col("source") == fixed.LONG_RUN_SOURCE) & (run >= 90), 12).otherwise(0)
        + F.when(F.col("source").isin(fixed.NEARBY_SOURCES) & F.col("city").isin(fixed.NEARBY_CITIES), 8).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def blob(df: DataFrame, name: str) -> Column:
    parts = [c for c in (name, "description", "raw_excerpt", "venue_name", "address", "district", "area", "occasion", "notes") if c in df.columns]
    return F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in parts]))


def tags(df: DataFrame, kind: str, name: str, plain: list[str], prefixed: list[str], words: dict[str, list[str]], flags: dict[str, Column]) -> Column:
    """Sorted distinct tags: the kind, slugs of columns (some with the column's name before), flags that hold, and words' tags."""
    slugs = [F.nullif(text.slug(F.col(c)), F.lit("")) for c in plain if c in df.columns]
    slugs += [F.when(text.slug(F.col(c)) != "", F.concat(F.lit(f"{c}:"), text.slug(F.col(c)))) for c in prefixed if c in df.columns]
    own = [F.when(F.coalesce(holds, F.lit(False)), F.lit(t)) for t, holds in flags.items()]
    found = text.once(blob(df, name), lambda b: F.array(*[F.when(text.any_word(b, ws), F.lit(t)) for t, ws in words.items()]))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(F.lit(kind), *slugs, *own), found))))


def event_tags(df: DataFrame) -> Column:
    has = lambda c: F.col(c) if c in df.columns else F.lit(None)
    flags = {
        "free": has("is_free") == 1, "timed": text.empty(has("start_time").cast("string")) != "", "has-image": text.empty(has("image_url").cast("string")) != "",
        "mapped": has("lat").isNotNull() | (text.empty(has("venue_url").cast("string")) != ""), "top-pick": has("score") >= 80,
    }
    return tags(df, "event", "title", ["category", "language", "audience", "source"], ["city", "district"], fixed.EVENT_TAG_WORDS, flags)


def place_tags(df: DataFrame) -> Column:
    has = lambda c: F.col(c) if c in df.columns else F.lit(None)
    flags = {"mapped": has("lat").isNotNull() | (text.empty(has("maps_url").cast("string")) != ""), "has-image": text.empty(has("image_url").cast("string")) != ""}
    t = tags(df, "place", "name", ["category", "source", "price_level"], ["city", "district", "area"], fixed.PLACE_TAG_WORDS, flags)
    chunks = F.transform(F.split(F.lower(text.empty(has("occasion").cast("string"))), r"[,;]\s*"), text.slug)
    return F.array_sort(F.array_distinct(F.concat(t, F.filter(chunks, lambda x: x != ""))))


def is_exposition() -> Column:
    """A span of four days at least that reads as an exhibition, or is culture."""
    span = F.date_diff(day(F.col("end_date")), day(F.col("start_date")))
    reads = F.concat_ws(" ", "title", "category").rlike("(?iu)выстав|экспоз|exposici[oó]n|exhibition") | (F.lower(F.col("category")) == "culture")
    return F.coalesce((span >= 4) & reads, F.lit(False))


def feature() -> Column:
    """What sets an event apart, by the first rule that holds; null for an ordinary one."""
    src, cat, own = F.col("source"), F.lower(text.empty(F.col("category"))), text.tags_of(F.col("tags_json"))
    has = lambda t: F.array_contains(own, t)
    return (
        F.when(src == "api:hemisferic", "hemisferic").when(src == "web:feriadejuliovlc", "feria").when((src == "tg:rutatuta_vlc") | (cat == "excursion"), "excursion")
        .when(has("feria-de-julio"), "feria").when(cat.isin("festival", "fireworks") | has("festival") | has("featured"), "festival").when(is_exposition(), "exposition")
    )


def visible(as_of: str) -> Column:
    """Upcoming (or of no status) and not over; undated rows are kept."""
    return (F.col("status").isNull() | (F.col("status") == "upcoming")) & (F.col("start_date").isNull() | (F.coalesce("end_date", "start_date") >= as_of))


def cards(events: DataFrame) -> DataFrame:
    """Rows of the feed: id, title, excerpt, date label, category with its label, feature, cleaned tags, page, day, time and score."""
    label = lambda c: F.date_format(day(F.col(c)), "dd.MM.yyyy")
    dates = F.concat(label("start_date"), F.when(F.col("end_date") != F.col("start_date"), F.concat(F.lit("–"), label("end_date"))).otherwise(""))
    time = F.when(text.empty(F.col("start_time")) != "", F.concat(F.lit(" "), "start_time")).otherwise("")
    return events.select(
        "id", "title", text.excerpt(F.col("title")).alias("excerpt"), F.concat(dates, time).alias("date_label"), text.category(F.col("category")).alias("category"),
        text.category_label(text.category(F.col("category"))).alias("category_label"), feature().alias("feature"), text.clean_tags(text.tags_of(F.col("tags_json"))).alias("tags"),
        F.concat(F.lit("/events/"), F.col("id"), F.lit("-"), text.page_slug(F.col("title"), F.lit("event"))).alias("page"),
        F.col("start_date").alias("day"), "end_date", F.col("start_time").alias("time"), "score", "city",
    )


def site_cards(events: DataFrame) -> DataFrame:
    """What a site shows of events: the Russian title, else one derived from the title; an excerpt of the Russian description, else of the description, else of the raw text; a place's label; cards' other columns."""
    from ..functions import titles

    title = F.coalesce(F.nullif(F.trim("title_ru"), F.lit("")), titles.derived_title(F.col("title")))
    body = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("description_ru", "description", "raw_excerpt")])
    own = events.select("id", title.alias("shown"), text.excerpt(body).alias("about"), titles.event_location().alias("location"), (F.col("source") == "api:hemisferic").alias("of_schedule"), F.coalesce(is_exposition(), F.lit(False)).alias("is_exposition"), titles.image(F.col("image_url")).alias("image"))
    c = cards(events).drop("title", "excerpt").join(own, "id")
    return c.withColumnsRenamed({"shown": "title", "about": "excerpt"})


def ordered(feed: DataFrame) -> DataFrame:
    return feed.orderBy(F.coalesce("score", F.lit(-1)).desc(), F.coalesce("day", F.lit("9999-99-99")), "title", "id")


def feed(events: DataFrame, as_of: str) -> DataFrame:
    return cards(events.where(visible(as_of)))


def tag_counts(*tables: DataFrame) -> DataFrame:
    """tag and n over the tags of all tables (a tags column each)."""
    every = tables[0].select(F.explode("tags").alias("tag"))
    for t in tables[1:]:
        every = every.unionByName(t.select(F.explode("tags").alias("tag")))
    return every.groupBy("tag").agg(F.count("*").alias("n"))


def top(counts: DataFrame, k: int, name: str) -> DataFrame:
    return counts.orderBy(F.desc("n"), name).limit(k)


def weighed(cloud: DataFrame) -> DataFrame:
    """A cloud's size (0.82 to 1.20, linear in n; 1 if all are equal) and weight."""
    w = cloud.agg(F.min("n").alias("low"), F.max("n").alias("high"))
    part = (F.col("n") - F.col("low")) / (F.col("high") - F.col("low"))
    c = cloud.join(F.broadcast(w)).withColumn("size", F.when(F.col("high") == F.col("low"), 1.0).otherwise(0.82 + part * 0.38))
    return c.select("tag", "n", F.round("size", 4).alias("size"), F.when(F.col("size") > 1.08, 800).when(F.col("size") > 0.95, 700).otherwise(500).alias("weight"))


def stats(feed_rows: DataFrame, events: DataFrame, places: DataFrame) -> DataFrame:
    """One row: events (rows of the feed), mapped_events (those of events, id, lat, lng, that are in it and have coordinates), places, mapped_places and tags (distinct ones of the feed and of places, tags: array)."""
    mapped = F.count_if(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    shown = events.select("id", "lat", "lng").join(feed_rows.select("id"), "id", "left_semi").agg(mapped.alias("mapped_events"))
    one = feed_rows.agg(F.count("*").alias("events")).join(shown).join(places.agg(F.count("*").alias("places"), mapped.alias("mapped_places")))
    return one.join(tag_counts(feed_rows, places).agg(F.count("*").alias("tags")))


def months(feed_rows: DataFrame, as_of: str) -> DataFrame:
    """Distinct months with is_default: the first from as_of's on, else the last."""
    m = feed_rows.where("day IS NOT NULL").select(F.substring("day", 1, 7).alias("month")).distinct()
    pick = m.agg(F.coalesce(F.min(F.when(F.col("month") >= as_of[:7], F.col("month"))), F.max("month")).alias("pick"))
    return m.join(F.broadcast(pick)).select("month", (F.col("month") == F.col("pick")).alias("is_default"))


def calendar(feed_rows: DataFrame, month: str) -> DataFrame:
    """Every day of a month with its number of rows and their ids by time (rows without one last), expositions left out; weekday: Monday is 0."""
    own = feed_rows.where(F.col("day").startswith(month) & (F.coalesce("feature", F.lit("")) != "exposition"))
    item = F.struct(F.coalesce("time", F.lit("99:99")).alias("t"), F.col("title").alias("s"), F.col("id"))
    per_day = own.groupBy("day").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["id"]).alias("ids"))
    first = F.to_date(F.lit(f"{month}-01"))
    days = feed_rows.sparkSession.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("d"))
    days = days.select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.weekday("d").alias("weekday"))
    return days.join(per_day, "day", "left").select("day", "weekday", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def calendar_split(feed_rows: DataFrame, month: str) -> DataFrame:
    """Every day of a month with its number of rows, and by time (rows without one last) the ids of those of the schedule and of all others. Cards of series have no day of their own, and expositions lie in the strip:
    neither are in it; series come by their sessions."""
    card = F.col("series_id").isNotNull() & ~F.col("calendar_only") if {"series_id", "calendar_only"} <= {*feed_rows.columns} else F.lit(False)
    own = feed_rows.where(F.col("day").startswith(month) & (F.coalesce("feature", F.lit("")) != "exposition") & ~card)
    item = F.struct(F.coalesce("time", F.lit("99:99")).alias("t"), F.col("title").alias("s"), F.col("id"))
    of_schedule = F.coalesce(F.col("feature") == "hemisferic", F.lit(False))
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, item))), lambda x: x["id"])
    per_day = own.groupBy("day").agg(F.count("*").alias("n"), ids(of_schedule).alias("of_schedule"), ids(~of_schedule).alias("others"))
    none, first = F.array().cast("array<bigint>"), F.to_date(F.lit(f"{month}-01"))
    days = feed_rows.sparkSession.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("d"))
    days = days.select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.weekday("d").alias("weekday"))
    return days.join(per_day, "day", "left").select("day", "weekday", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("of_schedule", none).alias("of_schedule"), F.coalesce("others", none).alias("others"))


def strip(feed_rows: DataFrame, month: str) -> DataFrame:
    """Expositions whose span meets a month, longest first."""
    last = F.date_format(F.last_day(F.to_date(F.lit(f"{month}-01"))), "yyyy-MM-dd")
    own = feed_rows.where((F.col("feature") == "exposition") & (F.col("day") <= last) & (F.coalesce("end_date", "day") >= f"{month}-01"))
    span = F.date_diff(day(F.coalesce("end_date", "day")), day(F.col("day")))
    return own.select("id", "title", "day", "end_date", span.alias("span")).orderBy(F.desc("span"), "day", "title", "id")


def search(feed_rows: DataFrame, words: str | None = None, tag: str | None = None, cat: str | None = None) -> DataFrame:
    """Rows whose title (or name), description, excerpt, place and tags hold some words, with a tag, of a category; all that is asked for. The place is the location label, of rows without one the city."""
    place = "location" if "location" in feed_rows.columns else "city"
    parts = [c for c in ("title", "name", "description", "excerpt", place) if c in feed_rows.columns]
    hay = F.lower(F.concat_ws(" ", *parts, F.array_join("tags", " ")))
    if words:
        feed_rows = feed_rows.where(hay.contains(words.lower()))
    if tag:
        feed_rows = feed_rows.where(F.array_contains("tags", tag))
    return feed_rows.where(F.col("category") == text.category(F.lit(cat))) if cat else feed_rows


def page(feed_rows: DataFrame, number: int, size: int = 30) -> DataFrame:
    """One page of the feed in its order: a top-k of what lies up to it, then its rows by rank."""
    head = ordered(feed_rows).limit((number + 1) * size)
    w = Window.orderBy(F.coalesce("score", F.lit(-1)).desc(), F.coalesce("day", F.lit("9999-99-99")), "title", "id")
    return head.withColumn("place", F.row_number().over(w)).where(F.col("place") > number * size)


def detail(events: DataFrame) -> DataFrame:
    """id and schema.org JSON without nulls; < is escaped."""
    body = F.to_json(F.struct(F.lit("Event").alias("@type"), F.col("title").alias("name"), F.col("start_date").alias("startDate"), F.col("end_date").alias("endDate"),
        F.struct(F.col("venue_name").alias("name"), F.col("city").alias("address")).alias("location"), F.col("url")))
    return events.select("id", F.replace(body, F.lit("<"), F.lit("\\u003c")).alias("json"))


def described(events: DataFrame, site: str = "") -> DataFrame:
    """id and schema.org JSON of events, with what they have: shown title, address of their page under a site, days (with a time), meta description, image, place and offer (in euros only where the price says so). Nothing is null, < is escaped."""
    from ..functions import titles

    has = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in events.columns else F.lit(None).cast("string")
    shown = F.coalesce(has("title_ru"), titles.derived_title(F.col("title"), 120))
    page_title = F.coalesce(has("title_ru"), titles.derived_title(F.col("title")))
    address = F.concat(F.lit(f"{site}/events/"), F.col("id"), F.lit("-"), text.page_slug(page_title, F.lit("event")))
    place = F.when(F.coalesce(has("venue_name"), has("address")).isNotNull(), F.struct(F.lit("Place").alias("@type"), has("venue_name").alias("name"), has("address").alias("address")))
    price = has("price")
    offer = F.when(price.isNotNull(), F.struct(F.lit("Offer").alias("@type"), price.alias("price"), F.when(price.rlike("(?i)€|eur"), "EUR").alias("priceCurrency")))
    begin = F.when(has("start_time").isNotNull(), F.concat_ws("T", has("start_date"), has("start_time"))).otherwise(has("start_date"))
    body = F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), shown.alias("name"), address.alias("url"), F.when(has("start_date").isNotNull(), begin).alias("startDate"), has("end_date").alias("endDate"),
        text.meta_description(F.coalesce(has("description_ru"), has("description"))).alias("description"), (titles.image(has("image_url"))).alias("image"), place.alias("location"), offer.alias("offers"),
    ))
    return events.select("id", F.replace(body, F.lit("<"), F.lit("\\u003c")).alias("json"))


def fold_series(sessions: DataFrame) -> DataFrame:
    """Series of sessions (id, title, venue_name, source, start_date, score): hash, first and last day, best score, number of sessions."""
    return sessions.groupBy(text.series_hash(F.col("title"), F.col("venue_name"), F.col("source")).alias("series")).agg(
        F.min("title").alias("title"), F.min("start_date").alias("start_date"), F.max("start_date").alias("end_date"), F.max("score").alias("score"), F.count("*").alias("n")
    )


def folded_into(held: DataFrame, sessions: DataFrame) -> DataFrame:
    """The series table (series, title, start_date, end_date, score, image_url, description and others) after sessions (id, title, venue_name, source, start_date, score, image_url, description): first and last day are the sessions', image and
    description the first ones that the series and then the sessions (by id) have, the score the best session's where the series has none. New series come in, others stay as they are."""
    key = text.series_hash(F.col("title"), F.col("venue_name"), F.col("source"))
    first = lambda c: F.min_by(c, F.when(text.empty(F.col(c)) != "", F.col("id"))).alias(c)
    g = sessions.groupBy(key.alias("series")).agg(F.min_by("title", "id").alias("title"), F.min("start_date").alias("start_date"), F.max("start_date").alias("end_date"), F.max("score").alias("score"), first("image_url"), first("description"))
    new = g.select("series", F.struct(*[c for c in g.columns if c != "series"]).alias("n"))
    j = held.join(new, "series", "full")
    kept = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), f"n.{c}") if c in ("image_url", "description") else F.coalesce(c, f"n.{c}") if c in ("score", "title") else F.coalesce(f"n.{c}", c)
    return j.select(*[F.col(c) if c not in g.columns or c == "series" else kept(c).alias(c) for c in held.columns])


def occurrences(sessions: DataFrame) -> DataFrame:
    series = text.series_hash(F.col("title"), F.col("venue_name"), F.col("source"))
    o = sessions.select("id", series.alias("series"), F.col("start_date").alias("day"), F.col("start_time").alias("time"), "status")
    return o.withColumn("occurrence", text.occurrence_hash(F.col("series"), F.col("day"), F.col("time")))


def next_occurrence(occ: DataFrame, as_of: str) -> DataFrame:
    """First day from as_of on and number of such occurrences of every series, cancelled ones left out."""
    ahead = occ.where((F.col("day") >= as_of) & (F.coalesce("status", F.lit("")) != "cancelled"))
    return ahead.groupBy("series").agg(F.min("day").alias("next_day"), F.count("*").alias("n_ahead"))


def schedule(occ: DataFrame) -> DataFrame:
    return occ.groupBy("series").agg(F.array_sort(F.collect_set(F.struct("day", "time"))).alias("slots"))


def digest_gate() -> Column:
    """Fit for the digest: no excluded stem in category or tags, and not enriched with low confidence."""
    cat, own = F.lower(text.empty(F.col("category"))), F.transform(text.tags_of(F.col("tags_json")), F.lower)
    bad = text.any_word(cat, fixed.DIGEST_EXCLUDES) | F.exists(own, lambda t: text.any_word(t, fixed.DIGEST_EXCLUDES))
    sure = F.get_json_object("enrichment_json", "$.confidence").try_cast("double")
    return ~bad & F.coalesce(F.col("enriched_at").isNull() | (sure >= fixed.LEAST_CONFIDENCE), F.lit(True))


def digest(events: DataFrame, as_of: str, sent: DataFrame | None = None) -> DataFrame:
    """Rows for the weekly digest, but those in sent (id)."""
    until = F.date_format(F.date_add(F.to_date(F.lit(as_of)), fixed.DIGEST_DAYS), "yyyy-MM-dd")
    rows = events.where(digest_gate() & (F.col("score") >= fixed.DIGEST_SCORE) & F.col("start_date").between(F.lit(as_of), until))
    return rows if sent is None else rows.join(sent.select("id"), "id", "left_anti")


def alerts(events: DataFrame) -> DataFrame:
    return events.where(digest_gate() & (F.col("score") >= fixed.ALERT_SCORE))


def mail(events: DataFrame, series: DataFrame, places: DataFrame) -> DataFrame:
    """Lines of a mail by block (1 events by score downward, 2 series by day, 3 new places by name) and place in it, so that no row holds a whole mail: block, n, line."""
    e = events.select(F.lit(1).alias("block"), F.struct((-F.coalesce("score", F.lit(0))).cast("string").alias("a"), F.lpad(F.col("id").cast("string"), 20, "0").alias("b")).alias("o"),
        F.concat(F.lit("• "), "title", F.lit(" — "), F.coalesce("start_date", F.lit("?")), F.coalesce(F.concat(F.lit(" ("), F.col("score").cast("string"), F.lit(")")), F.lit(""))).alias("line"))
    e = e.withColumn("o", F.struct(F.lpad((1_000_000 + F.col("o.a").cast("long")).cast("string"), 20, "0").alias("a"), F.col("o.b").alias("b")))
    s = series.select(F.lit(2).alias("block"), F.struct(F.col("start_date").alias("a"), F.lpad(F.col("id").cast("string"), 20, "0").alias("b")).alias("o"), F.concat(F.lit("↻ "), "title", F.lit(" — "), "start_date").alias("line"))
    p = places.select(F.lit(3).alias("block"), F.struct(F.col("name").alias("a"), F.lpad(F.col("id").cast("string"), 20, "0").alias("b")).alias("o"), F.concat(F.lit("📍 "), "name", F.coalesce(F.concat(F.lit(", "), "area"), F.lit(""))).alias("line"))
    w = Window.partitionBy("block").orderBy("o")
    return e.unionByName(s).unionByName(p).select("block", F.row_number().over(w).alias("n"), "line")


def facets(places: DataFrame, k: int = 16) -> DataFrame:
    """facet, value and n: categories, areas (else districts) and the k most frequent tags of places (tags: array)."""
    area = F.coalesce(F.nullif("area", F.lit("")), "district")
    one = lambda name, c: places.select(F.lit(name).alias("facet"), c.alias("value")).where("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))
    tags = top(tag_counts(places), k, "tag").select(F.lit("tag").alias("facet"), F.col("tag").alias("value"), "n")
    return one("category", F.col("category")).unionByName(one("area", area)).unionByName(tags)


def rendered(rows: DataFrame) -> DataFrame:
    """One line of text per day of a digest: a bounded row each, not one for all."""
    item = F.struct(F.col("score"), F.col("id"), F.concat(F.lit("• "), F.coalesce("title", F.lit("")), F.lit(" — "), F.coalesce("city", F.lit(""))).alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(item), asc=False), lambda x: x["line"])
    return rows.groupBy(F.col("start_date").alias("day")).agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("body"))
