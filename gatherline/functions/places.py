"""Cities, countries and place names in text, as column expressions over lists that the caller gives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import empty


def without_host(c: Column) -> Column:
    return F.regexp_replace(c, r"https?://[^/\s]+", " ")


def city(c: Column, stems: list[tuple[str, str]], other: str) -> Column:
    """The city of the stem that stands first in a text (the earlier stem of the list on a tie); hosts of urls don't count."""
    t = F.lower(without_host(empty(c)))
    found = F.array_compact(F.array(*[F.when(F.locate(s, t) > 0, F.struct(F.locate(s, t).alias("at"), F.lit(i).alias("i"), F.lit(name).alias("city"))) for i, (s, name) in enumerate(stems)]))
    return F.coalesce(F.array_min(found)["city"], F.lit(other))


def in_country(title: Column, body: Column, inside: list[str], outside: list[str]) -> Column:
    """Whether a text speaks of the country; where it also names a place abroad, the title itself must."""
    has = lambda c, words: F.lower(empty(c)).rlike("|".join(words))
    both = F.concat_ws(" ", title, body)
    return has(both, inside) & (~has(both, outside) | has(title, inside))


def name_of_link(url: Column) -> Column:
    """A place's name from a maps link: of /maps/place/, else q, query, search, else /maps/search/; its first comma part without a postcode; null if it is a number."""
    paths = [r"/maps/place/([^/?#@]+)", r"[?&](?:q|query|search)=([^&#]+)", r"/maps/search/([^/?#]+)"]
    raw = F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in paths])
    name = F.trim(F.regexp_replace(F.split(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit(" "))), ",")[0], r"\b\d{5}\b", ""))
    return F.when((name != "") & ~name.rlike(r"^[\d\s.,-]+$"), name)


def street_query(c: Column) -> Column:
    """Street, number and town of a maps text, for a geocoder: the first part of a street's kind, the first number, the part with a postcode or the last."""
    parts = F.filter(F.transform(F.split(empty(c), ","), lambda p: F.trim(p)), lambda p: p != "")
    street = F.get(F.filter(parts, lambda p: F.lower(p).rlike(r"^(c/|calle|carrer|av|avda|avenida|avinguda|plaza|plaça|pl\.|paseo|passeig|camino|cami)")), F.lit(0))
    number = F.get(F.filter(parts, lambda p: p.rlike(r"^\d{1,4}[a-zA-Z]?$")), F.lit(0))
    town = F.coalesce(F.get(F.filter(parts, lambda p: p.rlike(r"\b\d{5}\b")), F.lit(0)), F.try_element_at(parts, F.lit(-1)))
    return F.when(street.isNotNull(), F.array_join(F.array_distinct(F.array_compact(F.array(street, number, town, F.lit("Spain")))), ", "))


def grounding_links(source_url: Column, links: Column, limit: int = 4) -> Column:
    """The first distinct web links of a row that are no social network's (links: array of struct with url)."""
    every = F.concat(F.array(source_url), F.transform(F.coalesce(links, F.array()), lambda x: x["url"]))
    good = F.filter(every, lambda u: u.rlike("^https?://") & ~u.rlike(r"(?i)^https?://([^/]*\.)?(t\.me|instagram\.com|facebook\.com|vk\.com|x\.com|twitter\.com)(/|$)"))
    return F.slice(F.array_distinct(good), 1, limit)
