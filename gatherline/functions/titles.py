"""Titles, labels, categories and places of posts and cards, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import compact, empty, fold, latin, once


def derived_title(c: Column, limit: int = 72) -> Column:
    """A short title of a post: without "... pinned" and decoration at either end, of parts set off by a pointing hand the first that is no date, cut before it begins anew, then
    after its first sentence if that has 13 characters at least and fits, else at a blank in its second half. Nothing left: the label for untitled ones."""
    t = F.regexp_replace(empty(compact(c)), r"(?i)^.{0,48}?pinned\s*[«\"']?\s*", "")
    hand = F.lit(fixed.POINTING_HAND)
    parts = F.filter(F.transform(F.split(t, fixed.POINTING_HAND), lambda s: F.regexp_replace(s, r"^[\s«»\"']+|[\s«»\"']+$", "")), lambda s: s != "")
    is_date = F.get(parts, F.lit(0)).rlike(r"(?iu)^\d{1,2}\s*[а-яёa-z]*\.?,?\s*\d{0,2}[:.]?\d{0,2}\s*$")
    t = F.when(F.contains(t, hand), F.coalesce(F.when(is_date, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))), t)).otherwise(t)
    t = F.regexp_replace(t, rf"^[\s{fixed.DECORATION_BEFORE}]+", "")

    def steps(s: Column) -> Column:
        begin = F.trim(F.substring(s, 1, 15))
        again = F.position(begin, s, F.lit(7)) - 1
        short = F.when((F.length(begin) >= 8) & (again > 6) & (again < F.length(s) * 0.7), F.trim(F.substring(s, F.lit(1), again))).otherwise(s)
        return once(short, cut)

    def cut(s: Column) -> Column:
        stop = F.regexp_instr(s, F.lit(r"[.!?…](?:\s|$)"))
        head = F.rtrim(F.substring(s, 1, limit))
        blank = F.length(head) - F.position(F.lit(" "), F.reverse(head))
        at_blank = F.when(F.contains(head, F.lit(" ")) & (blank > limit * 0.5), F.substring(head, F.lit(1), blank)).otherwise(head)
        short = F.when((stop > 12) & (stop <= limit + 1), F.substring(s, F.lit(1), stop)).when(F.length(s) > limit, F.concat(at_blank, F.lit("…"))).otherwise(s)
        return F.trim(F.regexp_replace(short, rf"[\s{fixed.DECORATION_AFTER}]+$", ""))

    return once(once(t, steps), lambda out: F.when(out != "", out).otherwise(fixed.UNTITLED))


def image(c: Column) -> Column:
    """An absolute web address of an image on a host that is not known dead; else null."""
    t = F.trim(c)
    ok = F.lower(F.try_parse_url(t, F.lit("PROTOCOL"))).isin("http", "https") & ~F.try_parse_url(t, F.lit("HOST")).rlike(fixed.DEAD_IMAGE_HOST)
    return F.when(ok, t)


def tag_label(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, "^(city|district|area):", "$1 "), F.lit("-"), F.lit(" "))


def location(parts: list[Column], other: str) -> Column:
    """The different non-empty parts in order, or another label."""
    out = F.array_join(F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))), ", ")
    return F.when(out != "", out).otherwise(other)


def event_location() -> Column:
    return location([F.col(c) for c in ("venue_name", "district", "city")], fixed.NO_LOCATION)


def place_location() -> Column:
    return location([F.col(c) for c in ("area", "district", "city")], fixed.HOME_CITY)


def month_label(c: Column) -> Column:
    """Of YYYY-MM: the month's name and the year."""
    return F.concat(F.element_at(F.array(*[F.lit(m) for m in fixed.MONTH_LABELS]), F.substring(c, 6, 2).cast("int")), F.lit(" "), F.substring(c, 1, 4))


def name_keys(c: Column) -> Column:
    """Keys of a place's name: of the whole, of what is outside parentheses and of each in them; letters and digits in Latin, c as k but before h."""
    key = lambda x: F.regexp_replace(F.regexp_replace(latin(fold(F.lower(x))), "c(?!h)", "k"), r"[^\p{L}\p{N}]", "")
    inside = F.regexp_extract_all(c, F.lit(r"\(([^)]*)\)"), F.lit(1))
    every = F.concat(F.array(c, F.regexp_replace(c, r"\([^)]*\)", " ")), inside)
    return F.array_distinct(F.filter(F.transform(every, key), lambda k: k != ""))


def cued(c: Column, cues: list[tuple[str, str]], other: str) -> Column:
    """What the first cue that a text holds stands for."""

    def first(t: Column) -> Column:
        out = F.lit(other)
        for pattern, name in reversed(cues):
            out = F.when(t.rlike(f"(?iu){pattern}"), name).otherwise(out)
        return out

    return once(empty(compact(c)), first)


def date_of_url(c: Column) -> Column:
    """A date at the end of a path (YYYY-MM-DD or with slashes), if its month and day can be."""
    path = F.split(c, "[?#]")[0]
    y, m, d = (F.regexp_extract(path, r"(\d{4})[-/](\d{2})[-/](\d{2})/?$", i) for i in (1, 2, 3))
    return F.when((m != "") & m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31), F.concat_ws("-", y, m, d))


def relative_days(c: Column, anchor: Column) -> Column:
    """struct(start, end) of the first Spanish phrase for a day, weekend or month, read against the day of the post; null without either."""
    monday = F.date_sub(anchor, F.weekday(anchor))
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    phrases = [
        (r"\b(?:este|el)\s+(?:fin\s+de\s+semana|finde)\b", F.date_add(monday, 5), F.date_add(monday, 6)),
        (r"\b(?:el\s+)?proximo\s+(?:fin\s+de\s+semana|finde)\b", F.date_add(monday, 12), F.date_add(monday, 13)),
        (r"\beste\s+mes\b", anchor, F.last_day(anchor)),
        (r"\bhoy\b", anchor, F.lit(None).cast("date")),
        (r"(?<!\bla\s)(?<!\besta\s)\bmanana\b", F.date_add(anchor, 1), F.lit(None).cast("date")),
    ]

    def met(t: Column, i: int) -> Column:
        p, a, b = phrases[i]
        return once(F.regexp_instr(t, F.lit(p)), lambda at: F.when(at > 0, F.struct(at.alias("at"), F.lit(i).alias("i"), iso(a).alias("start"), iso(b).alias("end"))))

    def first(t: Column) -> Column:
        return F.array_min(F.array_compact(F.array(*[met(t, i) for i in range(len(phrases))])))

    def days(x: Column) -> Column:
        return F.when(x.isNotNull() & anchor.isNotNull(), F.struct(x["start"].alias("start"), x["end"].alias("end")))

    return once(once(F.lower(fold(compact(c))), first), days)


def venue(c: Column) -> Column:
    """What follows an @ or a pin; else the capitalised words after the first cue word."""
    return once(compact(c), venue_in)


def venue_in(t: Column) -> Column:
    pinned = F.regexp_extract(t, r"(?:@|📍)\s*([^\n,;]{3,80})", 1)
    cue = F.regexp_substr(t, F.lit(fixed.VENUE_CUE))
    after = F.substring(t, F.regexp_instr(t, F.lit(fixed.VENUE_CUE)) + F.length(cue), F.length(t))
    named = F.regexp_extract(after, r"^([A-ZА-ЯÀ-Ü][\p{L}0-9'’.\- ]{2,60})", 1)
    return F.coalesce(compact(pinned), compact(named))


def address(c: Column) -> Column:
    return compact(F.regexp_extract(compact(c), fixed.STREET, 1))


def without_offer(c: Column) -> Column:
    """A title without month, day, time, sessions and price before it; whole where under three characters would be left."""
    t = compact(c)
    rest = compact(F.regexp_replace(t, fixed.OFFER_BEFORE, ""))
    return F.when(F.length(rest) >= 3, rest).otherwise(t)


def once_of_three(c: Column) -> Column:
    """A title that is given three times in a row (in three languages of nearly one length), once; any other as it is."""

    def taken(w: Column) -> Column:
        n = (F.size(w) / 3).cast("int")
        return F.array(*[F.array_join(F.slice(w, n * i + 1, n), " ") for i in range(3)])

    def one_of(t: Column) -> Column:
        key = lambda s: F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", "")
        same = (key(t[0]) == key(t[1])) & (key(t[1]) == key(t[2]))
        near = (F.abs(F.length(t[0]) - F.length(t[1])) <= 4) & (F.abs(F.length(t[1]) - F.length(t[2])) <= 4)
        return F.when(same | near, t[0])

    def whole_or_one(t: Column) -> Column:
        w = F.split(empty(t), " ")
        return F.when((F.size(w) >= 3) & (F.size(w) % 3 == 0), F.coalesce(once(once(w, taken), one_of), t)).otherwise(t)

    return once(compact(c), whole_or_one)
