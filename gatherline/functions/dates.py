"""Dates and prices in free text, as column expressions. An anchor day stands for the day on which a text was seen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, empty, once

# Stems of month names in four languages, looked for in this order.
MONTH_STEMS = [
    "янв|січ|enero|january|jan", "фев|лют|febrero|february|feb", "март|мар(?![тз])|берез|marzo|march|mar", "апр|квіт|abril|april|apr", "ма[йя]|трав|mayo|may",
    "июн|черв|junio|june|jun", "июл|лип|julio|july|jul", "авг|серп|agosto|august|aug", "сен|верес|septiembre|september|sep", "окт|жовт|octubre|october|oct",
    "ноя|листопад|noviembre|november|nov", "дек|груд|diciembre|december|dec",
]
WORD = "[A-Za-zА-Яа-яёЁЇїІіЄєҐґ]{3,}"
NUMERIC = r"(?<![\d.,\p{L}])(\d{1,2})([./-])(\d{1,2})(?:[./-](\d{2,4}))?(?![\d\p{L}])"
DAY_FIRST = rf"(?<![\d\p{{L}}])(\d{{1,2}})\s+(?:de\s+)?({WORD})\.?(?:\s+(?:de\s+)?(\d{{4}}))?"
YEAR = r"(?<![\d\p{L}])20\d{2}(?!\d)"
MONTH_FIRST = rf"(?<![\p{{L}}\d])({WORD})\.?\s+(\d{{1,2}})(?!\d)(?:[^\d]{{0,12}}?(\d{{4}}))?"


def month_of(word: Column) -> Column:
    """Number of the month that a word names; null for none."""

    def found(w: Column) -> Column:
        out = F.lit(None).cast("int")
        for n, stems in reversed([*enumerate(MONTH_STEMS, 1)]):
            out = F.when(w.rlike(f"(?iu){stems}"), n).otherwise(out)
        return out

    return once(word, found)


def number(c: Column) -> Column:
    """The whole number that a text is, else null. Empty texts (of groups that a pattern did not meet) are told first: a cast that fails costs more than all patterns of a date."""
    return once(c, lambda x: F.when(x != "", x.try_cast("int")))


def sole_year(t: Column) -> Column:
    """The one year from 2000 to 2099 that a text names, if it is one; a number behind a letter (N2024) is none."""
    years = F.array_distinct(F.regexp_extract_all(t, F.lit(f"({YEAR})"), F.lit(1)))
    return once(years, lambda y: F.when(F.size(y) == 1, number(F.get(y, F.lit(0)))))


def iso(year: Column, month: Column, day: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", year, month, day)


def parse_date(c: Column, anchor: Column) -> Column:
    """The first date in a text as YYYY-MM-DD: ISO at once; else numeric (day, month; dots need a year), day and month word, or month word and day, whichever stands first.

    Without a year of its own, the date takes the sole year that the text names, else it is the next such day from the anchor on."""
    return once(compact(c), lambda t: first_date(t, anchor))


def first_date(t: Column, anchor: Column) -> Column:
    roll = lambda m, d: F.year(anchor) + F.when((m < F.month(anchor)) | ((m == F.month(anchor)) & (d < F.dayofmonth(anchor))), 1).otherwise(0)
    part = lambda p, i: F.regexp_extract(t, p, i)

    def candidate(pattern: str, day: int, month: Column, year: Column) -> Column:
        def dated(x: Column) -> Column:
            good = x["d"].between(1, 31) & (x["m"] > 0)
            return F.when(good, F.struct(x["at"].alias("at"), iso(F.coalesce(x["y"], sole_year(t), roll(x["m"], x["d"])), x["m"], x["d"]).alias("iso")))

        # the groups of a pattern are only looked for where it is met
        return once(F.regexp_instr(t, F.lit(pattern)), lambda at: F.when(at > 0, once(F.struct(at.alias("at"), number(part(pattern, day)).alias("d"), month.alias("m"), year.alias("y")), dated)))

    short = once(number(part(NUMERIC, 4)), lambda y: F.nullif(F.when(y < 100, y + 2000).otherwise(y), F.lit(0)))
    month = once(number(part(NUMERIC, 3)), lambda m: F.when((m <= 12) & ((part(NUMERIC, 2) != ".") | F.coalesce(number(part(NUMERIC, 4)) > 0, F.lit(False))), m))
    found = F.array_compact(F.array(
        candidate(NUMERIC, 1, month, short),
        candidate(DAY_FIRST, 1, month_of(part(DAY_FIRST, 2)), number(part(DAY_FIRST, 3))),
        candidate(MONTH_FIRST, 2, month_of(part(MONTH_FIRST, 1)), number(part(MONTH_FIRST, 3))),
    ))
    whole = F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.when(whole != "", whole).otherwise(F.array_min(found)["iso"])


def anchored_date(c: Column, published: Column, first_seen: Column, last_seen: Column) -> Column:
    """The first date in a text, read from the day that it was published, else first seen, else last seen on; one without a year in the text that would lie over 60 days ahead, in the year after, is of the year before."""
    day = F.coalesce(*[x.cast("string").substr(1, 10).try_cast("date") for x in (published, first_seen, last_seen)])

    def undone(d: Column) -> Column:
        y, m, n = (F.substring(d, at, size).cast("int") for at, size in ((1, 4), (6, 2), (9, 2)))
        rolled = F.date_add(F.make_date(y, m, F.lit(1)), n - 1)  # the 29th of February may be rolled into a year without one
        far = (y == F.year(day) + 1) & (F.date_diff(rolled, day) > 60) & ~c.rlike(YEAR + r"|(?<![\d.,])\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b")
        return F.when(far, iso(y - 1, m, n)).otherwise(d)

    return once(parse_date(c, day), undone)


FREE = r"(?iu)бесплатн|вход свободн|gratis|gratuit|entrada libre|free entry|free admission|(?<![\p{L}\d])free(?![\p{L}\d])"
PRICE = r"(?iu)(?:от\s*)?(\d{1,4})(?:[.,]\d{1,2})?\s*(?:€|евро|euros?(?![\p{L}\d])|eur(?![\p{L}\d]))|(?:€|(?<![\p{L}\d])eur(?![\p{L}\d]))\s*(\d{1,4})"


def price(c: Column) -> Column:
    """struct(price, is_free) of a text: Free and 1, an amount in euros and 0, or nulls."""
    said = lambda m: F.concat(F.regexp_extract(m, PRICE, 1), F.regexp_extract(m, PRICE, 2))  # noqa: E731  # one of them is empty

    def told(x: Column) -> Column:
        amount = x["amount"]
        return F.struct(F.when(x["free"], "Free").when(amount.isNotNull(), F.concat(amount, F.lit(" €"))).alias("price"), F.when(x["free"], 1).when(amount.isNotNull(), 0).alias("is_free"))

    return once(compact(c), lambda t: once(F.struct(F.coalesce(t.rlike(FREE), F.lit(False)).alias("free"), F.nullif(said(t), F.lit("")).alias("amount")), told))


def headline(c: Column) -> Column:
    """First line, without a date and decoration before it, at most 300 characters."""
    line = F.trim(F.split(empty(c), "\n")[0])
    line = F.regexp_replace(line, r"^(?:\d{1,2}[./-]\d{1,2}(?:[./-]\d{2,4})?)?[\s\p{P}\p{S}]*", "")
    return F.nullif(F.substring(F.trim(line), 1, 300), F.lit(""))
