"""Event drafts of chat posts, one parameterised job for all chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, fixed, places, text, titles
from ..functions.text import compact, empty, once
from . import gates


def without_intro(c: Column) -> Column:
    """A post without the advertisement before its news (to the first decoration after it), where 12 characters at least are left."""

    def peeled(t: Column) -> Column:
        rest = F.trim(F.regexp_replace(t, fixed.PROMO_INTRO, ""))
        return F.when(t.rlike(fixed.PROMO_INTRO) & (F.length(rest) >= 12), rest).otherwise(t)

    return once(compact(c), peeled)


def post_title(c: Column, other: Column) -> Column:
    """The post (else another title) in one line, without advertisement, date and decoration before it, 300 characters at most; null if nothing is left."""
    line = F.regexp_replace(without_intro(F.coalesce(compact(c), compact(other))), fixed.DATE_BEFORE, "")
    return compact(F.substring(F.regexp_replace(line, r"^[^\p{L}\p{N}]+", ""), 1, 300))


def is_event_like(c: Column, dated: Column) -> Column:
    """Twelve characters at least, and a date, a venue or a word for one."""
    t = empty(compact(c))
    return (F.length(t) >= 12) & (dated | titles.venue(c).isNotNull() | t.rlike(fixed.PLACE_CUE))


def optional(items: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in items.columns else F.lit(None).cast(kind)


def chat_posts(
    items: DataFrame, *, name: str = "", gated: bool = True, needs_date: bool = False, relative: bool = False, category: str | None = None, language: str | None = "ru",
    audience: str | None = None, country: tuple[list[str], list[str]] | None = None, cities: list[tuple[str, str]] = [],
) -> DataFrame:  # noqa: B006
    """Drafts of posts (id, source_key, title, text, url, seen; perhaps published, last_seen and media) that are no junk (of a chat with that name, its cards of pinned posts neither) and speak of an event.

    Dates are read from the day of the post; relative also reads Spanish phrases for days, for which the day published, else seen, must be known. Without a category or language they are told by cues and
    letters. country (stems inside, outside) keeps what speaks of it and does without the other gates; cities (cue, city) tell the city, the first of the list."""
    body, published = F.col("text"), optional(items, "published", "string")
    every = F.concat_ws(" ", "title", "text", "url")
    p = items.where(F.lit(True) if country else ~gates.is_junk(F.col("title"), body, F.lit(name)))
    if name:
        p = p.where(~F.ltrim(empty(body)).startswith(f"{name} pinned"))
    if country:
        p = p.where(places.in_country(F.col("title"), F.concat_ws(" ", "text", "url"), *country))
    read = every if country else empty(body)
    p = text.worked_out(p, _date=dates.anchored_date(read, published, F.col("seen"), optional(items, "last_seen", "timestamp")))
    if relative:
        day = F.coalesce(published.cast("string").substr(1, 10).try_cast("date"), F.to_date("seen"))
        p = text.worked_out(p, _phrase=F.when(F.col("_date").isNull(), titles.relative_days(body, day)))
    else:
        p = p.withColumn("_phrase", F.lit(None).cast("struct<start:string,end:string>"))
    p = p.withColumn("_start", F.coalesce("_date", "_phrase.start"))
    if needs_date:
        p = p.where("_start IS NOT NULL")
    if gated and not country:
        p = p.where(is_event_like(body, F.col("_start").isNotNull()))
    p = text.worked_out(p, _title=post_title(body, F.col("title"))).where("_title IS NOT NULL")
    price = dates.price(body)  # not worked out before, so that whoever doesn't ask for it doesn't wait for it
    kind = F.lit(category) if category else titles.cued(F.concat_ws(" ", "_title", "text"), fixed.POST_CATEGORIES, "event")
    city = titles.cued(every, cities, fixed.HOME_CITY) if cities else F.lit(fixed.HOME_CITY)
    return p.select(
        "id", "source_key", F.col("_title").alias("title"), F.substring(compact(body), 1, 2000).alias("description"), kind.alias("category"), (F.lit(language) if language else text.language(body)).alias("language"),
        F.lit(audience).cast("string").alias("audience"), F.col("_start").alias("start_date"), F.col("_phrase.end").alias("end_date"), titles.venue(body).alias("venue_name"), titles.address(body).alias("address"), city.alias("city"),
        price["price"].alias("price"), price["is_free"].alias("is_free"), "url", F.get(optional(items, "media", "array<string>"), F.lit(0)).alias("image_url"),
    )
