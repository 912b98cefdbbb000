"""What is no event: chrome, guides, promotions, other regions, addresses of another shape. Conditions over columns, and tables of sources that jobs start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.storage import saved
from ..functions.text import any_word, compact, empty, fold, norm_title, once
from .classes import paired


def card_text(title: Column, body: Column) -> Column:
    """The longer of title and body; empty if there is none."""
    both = F.struct(empty(compact(title)).alias("t"), empty(compact(body)).alias("b"))
    return once(both, lambda x: F.when(F.length(x["b"]) >= F.length(x["t"]), x["b"]).otherwise(x["t"]))


def is_junk(title: Column, body: Column, source_name: Column) -> Column:
    """Empty cards, posts about posts, bare mail addresses and handles, labels of navigation, and headers that only name their source (but for views, a time or a temperature)."""
    name = F.lower(empty(compact(source_name)))

    def junk(t: Column) -> Column:
        core = F.regexp_replace(F.regexp_replace(t, rf"{fixed.META_POST}.*$", ""), r"(?i)\b\d[\d.,km]*\s*views?\b.*$", "")
        core = F.lower(empty(compact(F.regexp_replace(core, r"\b\d{1,2}:\d{2}\b\s*$", ""))))
        header = once(core, lambda x: (name != "") & ((x == name) | (F.trim(F.regexp_replace(x, r"\s*\d{1,3}\s*°.*$", "")) == name)))
        bare = t.rlike(r"(?i)^(?:mailto:)?\s*[^\s@]+@[^\s@]+\.[^\s@]{2,}\s*$") | t.rlike(r"^@[A-Za-z0-9_]{3,}$")
        return (t == "") | t.rlike(fixed.META_POST) | bare | F.lower(t).isin(fixed.NAV_LABELS) | header

    return once(card_text(title, body), junk)


def is_board_label(title: Column, body: Column) -> Column:
    t = F.lower(card_text(title, body))
    return (t == "") | t.isin(fixed.BOARD_LABELS)


def is_error_page(title: Column, body: Column) -> Column:
    return F.concat_ws(" ", empty(compact(title)), empty(compact(body))).rlike(fixed.ERROR_PAGE)


def is_cancelled(title: Column) -> Column:
    return empty(title).rlike(fixed.CANCELLED)


def is_promotion(title: Column) -> Column:
    return empty(title).rlike(fixed.PROMOTION)


def is_product(title: Column) -> Column:
    return empty(title).rlike(fixed.PRODUCT)


def is_guide(title: Column, url: Column) -> Column:
    """Guides and lists, by title or by the slug of their page."""
    slug = norm_title(F.try_url_decode(F.regexp_extract(F.split(empty(url), "[?#]")[0], "/events-valencia/([^/]+)", 1)))
    return norm_title(title).rlike(fixed.GUIDE_TITLE) | F.coalesce(slug.rlike(fixed.GUIDE_SLUG), F.lit(False))


def is_event_url(source: Column, url: Column) -> Column:
    """Whether an address has the shape of a single event's at its source; null for sources without a rule."""
    u, out = empty(url), F.lit(None).cast("boolean")
    for key, (inside, outside) in fixed.EVENT_URLS.items():
        ok = u.rlike(inside) & (~u.rlike(outside) if outside else F.lit(True))
        out = F.when(source == key, ok).otherwise(out)
    return out


def in_region(title: Column, city: Column, notes: Column) -> Column:
    """Named places elsewhere rule a text out; otherwise it is of the region, also where it names no place."""
    t = F.lower(F.concat_ws(" ", empty(title), empty(city), empty(notes)))
    return ~any_word(t, fixed.ELSEWHERE_STEMS)


def names_region(title: Column, city: Column, notes: Column) -> Column:
    t = F.lower(F.concat_ws(" ", empty(title), empty(city), empty(notes)))
    return any_word(t, fixed.REGION_STEMS) & ~any_word(t, fixed.ELSEWHERE_STEMS)


def is_headliner(title: Column) -> Column:
    return any_word(F.lower(empty(title)), fixed.HEADLINERS)


def is_region_city(country: Column, city: Column) -> Column:
    """Strict: the country's name and a city of the region."""
    return F.lower(F.trim(empty(country))).isin(fixed.COUNTRY_WORDS) & any_word(fold(F.lower(empty(city))), fixed.REGION_CITY_STEMS)


def is_address_as_name(name: Column) -> Column:
    return empty(name).rlike(r"(?i)^\s*(?:https?://|www\.|(?:goo\.gl|maps\.app)/)")


def enabled_sources(sources: DataFrame) -> DataFrame:
    """Enabled sources by weight, then key."""
    return sources.where("enabled = 1").orderBy("weight", "key")


def routed(sources: DataFrame, own: DataFrame) -> DataFrame:
    """sources with parser: own's for a key (key, parser: a small registry), else telegram (by type or address), else the type if a parser has it, else web."""
    kinds = [r["parser"] for r in own.select("parser").distinct().collect()]  # a registry of parsers, a few dozen rows
    j = sources.join(F.broadcast(own.withColumnRenamed("parser", "own")), "key", "left")
    chat = (F.col("type") == "telegram") | F.contains(empty(F.col("url")), F.lit("t.me/s/"))
    return j.withColumn("parser", F.coalesce("own", F.when(chat, "telegram").when(F.col("type").isin(kinds), F.col("type")).otherwise("web"))).drop("own")


def processed(items: DataFrame, batch: DataFrame) -> DataFrame:
    """items with status normalized where a batch (id) has read them, whether or not it kept them."""
    read = batch.select("id", F.lit(True).alias("read")).distinct()
    return items.join(read, "id", "left").withColumn("status", F.when(F.col("read"), "normalized").otherwise(F.col("status"))).drop("read")


def media_of(media: DataFrame, kind: str, entity: Column) -> DataFrame:
    """Media of an entity, primary ones first, then by order, then by id."""
    return media.where((F.col("entity_type") == kind) & (F.col("entity_id") == entity)).orderBy(F.desc("is_primary"), "sort_order", "id")


def with_cadence(sources: DataFrame, defaults: DataFrame) -> DataFrame:
    """sources with the defaults (type, poll) of their type where they have no poll of their own."""
    return sources.join(F.broadcast(defaults.withColumnRenamed("poll", "usual")), "type", "left").withColumn("poll", F.coalesce("poll", "usual")).drop("usual")


def is_fresh(fetched: Column, now: Column, hours: int) -> Column:
    """Fetched within so many hours, so that a run skips it."""
    return F.coalesce((F.unix_micros(now) - F.unix_micros(fetched)) < hours * 3_600_000_000, F.lit(False))


def freshness(runs: DataFrame, sent: DataFrame, *enriched: DataFrame) -> DataFrame:
    """One row: last_ok, last_run (finished_at of runs), last_sent (sent_at) and last_enriched (the latest enriched_at of all tables; null ones are skipped)."""
    one = runs.agg(F.max(F.when(F.col("status") == "ok", F.col("finished_at"))).alias("last_ok"), F.max("finished_at").alias("last_run")).join(sent.agg(F.max("sent_at").alias("last_sent")))
    names = []
    for i, e in enumerate(enriched):
        one, names = one.join(e.agg(F.max("enriched_at").alias(f"e{i}"))), [*names, f"e{i}"]
    return one.withColumn("last_enriched", F.greatest(*names) if len(names) > 1 else F.col(names[0])).drop(*names)


def geo_queries(address: Column, venue: Column, district: Column, city: Column) -> Column:
    """Distinct queries for a geocoder, the most exact first: address, venue and district each with the city."""
    one = lambda c: F.when(empty(compact(c)) != "", F.concat_ws(", ", compact(c), compact(city)))
    return F.array_distinct(F.array_compact(F.array(one(address), one(venue), one(district))))


def name_variants(names: DataFrame) -> DataFrame:
    """a and b of places (id, keys: array) of which a key is equal, or holds the other's with six characters at least.

    Places of the same keys are a class, which its least id stands for, and keys meet once a class: equal keys in a join, a shorter key longer ones by its first six characters, at each place of the longer one. Each pair of classes is
    spread to its places once, part by part, so no pair comes twice, none need be told apart and none is shuffled; joins are by sort-merge, as what they read is far greater than its files."""
    rows = saved(names.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("set")).where(F.size("set") > 0))
    classes = saved(rows.groupBy("set").agg(F.min("id").alias("key"), F.count("*").alias("n")))
    k = classes.select("key", F.explode("set").alias("k"))
    at = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("k") - 5, F.lit(1))), lambda i: F.substring(F.col("k"), i, F.lit(6))))
    long = k.where("length(k) >= 6").select(F.col("key").alias("x"), F.col("k").alias("kx"), at.alias("g")).distinct()
    short = k.where("length(k) >= 6").select(F.col("key").alias("y"), F.col("k").alias("ky"), F.substring("k", 1, 6).alias("g"))
    holds = long.join(short.hint("merge"), "g").where("contains(kx, ky)").select("x", "y")
    equal = k.select(F.col("key").alias("x"), "k").join(k.select(F.col("key").alias("y"), "k").hint("merge"), "k").select("x", "y")
    met = holds.unionByName(equal).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    return paired(met, rows.join(classes.hint("merge"), "set").select("key", "id", "n"))
