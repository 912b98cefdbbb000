"""The registry of sources: which job reads a source's items, with which options."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import spread
from . import listings, posts, venue_listings

FORMS: dict[str, Callable[..., DataFrame]] = {
    "posts": posts.chat_posts, "link_cards": listings.link_cards, "headed": listings.headed_cards, "badges": listings.badge_cards, "concerts": listings.concert_cards, "tickets": listings.ticket_lines,
    "dated": listings.dated_lines, "shop": listings.shop_lines, "agenda": listings.agenda_cards, "experiences": venue_listings.experience_cards, "box_office": venue_listings.box_office_cards,
    "paired": venue_listings.paired_cards, "blocks": venue_listings.block_cards,
}
#: Forms that know the name of their source, whose header cards go.
NAMED = {"posts", "link_cards", "headed", "concerts", "tickets", "dated", "agenda", "box_office"}
SHAPES: dict[str, tuple[str, dict]] = {}
#: Columns of drafts of several sources; what a form doesn't tell is null.
DRAFT = ["title", "category", "language", "start_date", "end_date", "start_time", "venue_name", "address", "city", "price", "is_free", "url"]


def register_shape(source_key: str, form: str, **options) -> None:
    """Makes a source's items be read in a form, with options and, where the form takes one, the source's name."""
    if form in NAMED and source_key in fixed.SOURCE_NAMES:
        options.setdefault("name", fixed.SOURCE_NAMES[source_key])
    SHAPES[source_key] = (form, options)


COUNTRY = (fixed.COUNTRY_STEMS, fixed.ABROAD_STEMS)
for key, form, options in (
    ("web:worldafisha", "link_cards", {"country": COUNTRY, "cities": fixed.CITY_STEMS}),
    ("web:valenciarusa", "link_cards", {"offers": True, "cities": fixed.CITY_STEMS}),
    ("web:elcontacto", "link_cards", {"board": True}),
    ("web:russpain", "link_cards", {"needs_date": True}),
    ("web:palau", "headed", {}), ("web:hoyvalencia", "badges", {}), ("web:laganzua", "concerts", {}), ("web:eventbrite", "tickets", {}),
    ("web:lacotorra", "dated", {}), ("web:ticketbest", "shop", {}), ("web:visitvalencia", "agenda", {}),
    ("web:fever", "experiences", {}), ("web:ticketmaster", "box_office", {}), ("web:songkick", "paired", {}),
    ("web:cac_exposiciones", "blocks", {"exhibitions": True}), ("web:cac_museu", "blocks", {}), ("web:cac_agenda", "blocks", {}), ("web:cac_actividades", "blocks", {}),
    ("tg:vidacultural_Valencia", "posts", {"category": "culture", "audience": "family"}),
    ("tg:rutatuta_vlc", "posts", {"category": "excursion", "audience": "family", "needs_date": True}),
    ("tg:valenciabonitatelegram", "posts", {"language": None, "relative": True}),
    ("tg:concerten", "posts", {"category": "concert", "audience": "adult", "country": COUNTRY, "cities": fixed.CITY_CUES}),
):
    register_shape(key, form, **options)


def shaped(items: DataFrame, source: str) -> DataFrame:
    """Drafts of a source's items."""
    form, options = SHAPES[source]
    return FORMS[form](spread(items), **options)


def drafts(items: DataFrame, sources: list[str]) -> DataFrame:
    """Drafts of all named sources, each read in the shape that is registered for it. Sources of one form and options are read at once, so items are scanned once a form, not once a source."""
    out, groups = None, {}
    for source in sources:
        groups.setdefault(repr(SHAPES[source]), []).append(source)
    for same in groups.values():
        one = shaped(items.where(F.col("source_key").isin(same)), same[0])
        one = one.select("source_key", *[c for c in DRAFT if c in one.columns])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def jobs(sources: list[str]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """A job for each named source, as streaming.dispatch takes them."""
    return {source: (lambda items, source=source: drafts(items, [source])) for source in sources}
