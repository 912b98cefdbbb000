"""Column families for text: every function takes and gives columns and runs in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c's value, which is evaluated once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are evaluated once a row: filters on them are not moved below, where they would evaluate them again."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def tasks(df: DataFrame, each: int = 8) -> int:
    """A number of tasks for rows whose work, or size, their packed bytes tell little of: Spark puts tasks together by those, but not where it is given a number. Some for each core, so that none has to wait for a last one."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), each * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """df (id and others) dealt over all tasks by id: a table of few files is read in few, and what is worked out of its texts, filters too, would stay there."""
    return df.repartition(tasks(df), "id").select(F.inline(F.array(F.struct(*df.columns))))


def norm(c: Column) -> Column:
    """Lower case, trimmed, white space collapsed, then all but letters, digits and blanks dropped (which may leave blanks in a row). Null: empty."""
    t = F.regexp_replace(F.lower(empty(c)), r"^[\s\x{a0}]+|[\s\x{a0}]+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"[\s\x{a0}]+", " "), r"[^\p{L}\p{N}\s]", "")


def compact(c: Column) -> Column:
    """White space collapsed and trimmed; null where nothing is left."""
    return once(F.trim(F.regexp_replace(c, r"[\s\x{a0}]+", " ")), lambda t: F.when(t != "", t))


def sha1short(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *[empty(p) for p in parts])), 1, 16)


def item_hash(source: Column, external_id: Column, url: Column, title: Column, text: Column) -> Column:
    return sha1short(source, external_id, norm(url), norm(title), norm(text))


def event_hash(title: Column, start: Column, end: Column, venue: Column, address: Column) -> Column:
    return sha1short(norm(title), start, end, norm(venue), norm(address))


def series_hash(title: Column, venue: Column, source: Column) -> Column:
    return sha1short(norm(title), norm(venue), source)


def occurrence_hash(series: Column, day: Column, time: Column) -> Column:
    return sha1short(series, day, time)


def folding() -> tuple[str, str]:
    """Letters with marks and their base letters, over the Latin, Greek and Cyrillic blocks."""
    pairs = []
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BASE = folding()


def fold(c: Column) -> Column:
    """Letters without their marks, composed or combining."""
    return F.regexp_replace(F.translate(c, ACCENTED, BASE), r"\p{Mn}", "")


def slug(c: Column) -> Column:
    ascii_ = F.lower(F.regexp_replace(fold(empty(c)), r"[^\x00-\x7F]", ""))
    return F.regexp_replace(F.regexp_replace(ascii_, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def page_slug(c: Column, fallback: Column) -> Column:
    """First eight words of the slug, at most 72 characters."""
    words = F.filter(F.split(slug(c), "-"), lambda w: w != "")
    short = F.regexp_replace(F.substring(F.array_join(F.slice(words, 1, 8), "-"), 1, 72), "^-+|-+$", "")
    return F.when(short != "", short).otherwise(fallback)


def latin(c: Column) -> Column:
    """Lower case, Cyrillic letters in Latin ones."""
    t = F.lower(empty(c))
    for a, b in fixed.TRANSLIT.items():
        if len(b) > 1:
            t = F.replace(t, F.lit(a), F.lit(b))
    one = [(a, b) for a, b in fixed.TRANSLIT.items() if len(b) == 1]
    none = [a for a, b in fixed.TRANSLIT.items() if not b]
    return F.translate(t, "".join([*(a for a, _ in one), *none]), "".join(b for _, b in one))


def norm_title(c: Column) -> Column:
    """Lower case without marks and quotes; letters, digits and single blanks."""
    t = F.regexp_replace(fold(F.lower(empty(c))), "[«»\"'“”‘’]", "")
    return F.trim(F.regexp_replace(t, "[^0-9a-zа-я]+", " "))


def signature_words(c: Column) -> Column:
    """Sorted words of a title that may tell what it is (repeated ones stay); the whole slug where none does; empty for no slug."""
    stop = F.array(*[F.lit(w) for w in fixed.TITLE_STOPWORDS])

    def words_of(s: Column) -> Column:
        words = F.filter(F.split(s, "-"), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w) & ~w.rlike("^[0-9]+$"))
        some = once(words, lambda ws: F.when(F.size(ws) == 0, F.array(s)).otherwise(F.array_sort(ws)))
        return F.when(s == "", F.array().cast("array<string>")).otherwise(some)

    return once(slug(latin(c)), words_of)


def signature(c: Column) -> Column:
    return once(signature_words(c), lambda words: F.when(F.size(words) == 0, F.lit("untitled")).otherwise(F.array_join(words, "-")))


def base_title(c: Column) -> Column:
    """A title without a ticket-tier marker and what separates it, in lower case: cut at the first listed marker that follows a separator or blank."""

    def cut(t: Column) -> Column:
        out = t
        for kw in reversed(fixed.TIER_KEYWORDS):
            at = F.locate(kw, t)
            before = F.substring(t, F.lit(1), at - 1)
            base = F.regexp_replace(before, r"[\s|,\-–—:(]+$", "")
            out = F.when((at > 1) & before.rlike(r"[|,\-–—:(\s]$") & (F.length(base) >= 3), base).otherwise(out)
        return out

    return once(F.lower(empty(compact(c))), cut)


def decode_entities(c: Column) -> Column:
    """Named and numeric entities (of any number of digits; of no character: a replacement character); numbers need no table: they are read as UTF-32."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, "(?i)&#x27;", "'")

    def char(x: Column, base: int) -> Column:
        n = F.regexp_replace(x, "^0+(?=.)", "")
        code = F.conv(F.when(F.length(n) <= 7, n), base, 10).cast("long")
        ok = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")

    def decoded(t: Column, pattern: str, base: int) -> Column:
        parts = F.split(t, pattern, -1)
        codes = F.regexp_extract_all(t, F.lit(pattern.replace("(?:", "(")), F.lit(1))
        return F.array_join(F.zip_with(parts, codes, lambda p, x: F.concat(p, F.when(x.isNotNull(), char(x, base)).otherwise(""))), "")

    c = once(c, lambda t: F.when(t.rlike("&#[0-9]+;"), decoded(t, "&#(?:[0-9]+);", 10)).otherwise(t))
    return once(c, lambda t: F.when(t.rlike("&#[xX][0-9a-fA-F]+;"), decoded(t, "&#[xX](?:[0-9a-fA-F]+);", 16)).otherwise(t))


def html_text(c: Column) -> Column:
    """Text of HTML: breaks and block ends are line feeds, scripts and styles go, tags are blanks, entities are decoded, blanks collapse."""
    t = F.regexp_replace(c, r"(?i)<br\s*/?>|</(?:p|div|li)>", "\n")
    t = F.regexp_replace(t, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    t = decode_entities(F.regexp_replace(t, "<[^>]+>", " "))
    t = F.replace(F.replace(t, F.lit(" "), F.lit(" ")), F.lit("\r"), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(t, r"\n\s*\n\s*\n+", "\n\n"), "[ \t]+", " ")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def excerpt(c: Column, limit: int = 220) -> Column:
    t = F.trim(empty(c))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…")))


def meta_description(c: Column, limit: int = 160) -> Column:
    """A text in one line, cut (at a blank in its second half, if there is one) with an ellipsis where it is longer; null if there is none."""

    def cut(t: Column) -> Column:
        head = F.substring(t, 1, limit)
        blank = F.length(head) - F.position(F.lit(" "), F.reverse(head))
        short = F.when(F.contains(head, F.lit(" ")) & (blank > limit * 0.5), F.substring(head, F.lit(1), blank)).otherwise(head)
        return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(short, r"[\s,;:—–-]+$", ""), F.lit("…")))

    return once(compact(c), cut)


def clean_controls(c: Column) -> Column:
    """Without control characters (but tab, line feed, carriage return) and code points that aren't characters."""
    return F.regexp_replace(c, r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}\x{fdd0}-\x{fdef}\x{fffe}\x{ffff}]", "")


def tags_of(json: Column) -> Column:
    """Tags of a JSON array of strings; malformed or null: none."""
    return F.filter(F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))


def is_noise_tag(tag: Column) -> Column:
    n = F.trim(F.lower(F.replace(F.trim(tag), F.lit("-"), F.lit(" "))))
    raw = F.lower(F.trim(tag))
    prefixed = F.lit(False)
    for p in fixed.SYSTEM_TAG_PREFIXES:
        prefixed = prefixed | n.startswith(p) | raw.startswith(p)
    digits = F.length(F.regexp_replace(n, "[^0-9]", ""))
    return (n == "") | n.isin(fixed.SYSTEM_TAGS) | prefixed | n.rlike(r"^[\d\s.,;:–—\-/]+$") | (digits > 0.35 * F.length(n)) | (F.length(n) > 28)


def clean_tags(tags: Column) -> Column:
    return F.filter(tags, lambda t: t.isNotNull() & ~is_noise_tag(t))


def any_word(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def category(c: Column) -> Column:
    """The category that a raw one counts as; a Russian plural counts as its singular; unknown ones stay; blank: empty."""
    key = F.lower(F.trim(empty(c)))
    known = F.create_map(*[F.lit(x) for kv in fixed.CATEGORY_SYNONYMS.items() for x in kv])
    single = F.regexp_replace(key, "[ыи]$", "")
    return F.coalesce(F.try_element_at(known, key), F.when((F.length(key) > 4) & (single != key), F.try_element_at(known, single)), key)


def category_label(key: Column) -> Column:
    return F.concat(F.upper(F.substring(key, 1, 1)), F.substring(key, F.lit(2), F.length(key)))


def language(c: Column) -> Column:
    """ru where Cyrillic letters outnumber Latin ones, else es."""
    n = lambda p: F.length(F.regexp_replace(empty(c), f"[^{p}]", ""))
    return F.when(n("а-яёА-ЯЁ") > n("a-zA-Z"), F.lit("ru")).otherwise("es")


def json_in(c: Column, schema: str) -> Column:
    """The outermost braces of noisy text, parsed; null if there are none."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), schema)
