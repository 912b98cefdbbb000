"""From landed pages to source items, and the append-only bronze table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text

TEXT_LIMIT, HTML_LIMIT, CARD_LIMIT = 12_000, 20_000, 80


def meta(html: Column) -> Column:
    """Map of the known meta tags (the last of a name counts)."""
    pattern = r"""(?is)<meta[^>]+(?:property|name)=["']([^"']+)["'][^>]+content=["']([^"']*)["']"""
    names = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda n: F.lower(F.trim(n)))
    values = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(2)), lambda v: F.trim(v))
    pairs = F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda p: p["n"].isin(fixed.META_NAMES))

    def last(name: str) -> Column:
        """The last value of a name; null (out of range of an empty array) if there is none."""
        return F.try_element_at(F.filter(pairs, lambda p: p["n"] == name), F.lit(-1))["v"]

    return F.map_filter(F.create_map(*[x for n in fixed.META_NAMES for x in (F.lit(n), last(n))]), lambda k, v: v.isNotNull())


def snapshots(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text (cut at the limit) and meta of pages (page_id, url, html)."""
    title = text.compact(text.html_text(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)))
    return pages.select("page_id", "url", title.alias("title"), F.substring(text.html_text(F.col("html")), 1, TEXT_LIMIT).alias("text"), meta(F.col("html")).alias("meta"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]+)", 1))


def resolved(href: Column, base: Column) -> Column:
    """An href against the page's url: absolute ones stay, those of another host take its scheme, rooted ones its host, others its folder."""
    scheme, origin, folder = (F.regexp_extract(base, p, 1) for p in ("^([a-zA-Z]+:)", "^([a-zA-Z]+://[^/?#]+)", "^([a-zA-Z]+://[^?#]*/)"))
    beside = F.when(F.length(folder) > 8, folder).otherwise(F.concat(origin, F.lit("/")))

    def absolute(h: Column) -> Column:
        return F.when(h.rlike("^[a-zA-Z]+://"), h).when(h.startswith("//"), F.concat(scheme, h)).when(h.startswith("/"), F.concat(origin, h)).otherwise(F.concat(beside, h))

    return text.once(text.decode_entities(href), absolute)


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, page (its url), pos, url and title (the text inside) of all anchors of pages. A page is searched once; address and text are taken from each anchor."""

    def told(a: Column) -> Column:
        body = F.regexp_replace(a, "(?is)^<a\\b[^>]*>|</a>$", "")
        return F.struct(resolved(F.regexp_extract(a, fixed.ANCHOR, 1), F.col("url")).alias("url"), text.compact(text.html_text(body)).alias("title"))

    # told inside the array, so that conditions on url and title, of which there are many, don't work them out anew
    found = F.transform(F.regexp_extract_all("html", F.lit(fixed.ANCHOR), F.lit(0)), told)
    return pages.select("page_id", F.col("url").alias("page"), F.posexplode(found).alias("pos", "a")).select("page_id", "page", "pos", "a.url", "a.title")


def cards(pages: DataFrame, low: int = 18, high: int = 220) -> DataFrame:
    """page_id, url, title and place of a page's links of its own host (or a ticket shop's) with a text of low to high
    characters, noise left out, the first of equal ones, at most CARD_LIMIT a page in order."""
    a = anchors(pages)
    noise = text.any_word(F.lower("url"), fixed.NOISE_URL)
    for w in fixed.NOISE_TEXT:
        noise = noise | F.lower("title").startswith(w)
    own = (host(F.col("url")) == host(F.col("page"))) | host(F.col("url")).contains("ticketmaster") | host(F.col("url")).contains("songkick")
    a = a.where(F.length("title").between(low, high) & ~noise & own)
    a = a.groupBy("page_id", "page", "url", F.lower("title").alias("key")).agg(F.min(F.struct("pos", "title")).alias("f"))
    w = Window.partitionBy("page_id").orderBy("f.pos")
    return a.withColumn("place", F.row_number().over(w)).where(F.col("place") <= CARD_LIMIT).select("page_id", "url", F.col("f.title").alias("title"), "place")


def upserted(held: DataFrame, batch: DataFrame) -> DataFrame:
    """The bronze table after a batch, whose titles and texts lose control characters: new hashes come in as pending, known ones take the batch's text, title and time and keep what they had else.

    Both have item_hash, source_key, title, text, seen (timestamp); held also first_seen, status. One shuffle by hash; the last of a batch's equal hashes counts."""
    old = held.select("item_hash", F.struct("source_key", "title", "text", F.col("last_seen").alias("seen"), "first_seen", "status").alias("o"), F.lit(None).cast("struct<seen:timestamp,source_key:string,title:string,text:string>").alias("n"))
    clean = [text.clean_controls(F.col(c)).alias(c) for c in ("title", "text")]
    new = batch.select("item_hash", F.lit(None).cast(old.schema["o"].dataType).alias("o"), F.struct("seen", "source_key", *clean).alias("n"))
    g = old.unionByName(new).groupBy("item_hash").agg(F.max("o").alias("o"), F.max("n").alias("n"), F.min("n.seen").alias("first"))
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}").alias(c)
    return g.select("item_hash", F.coalesce("o.source_key", "n.source_key").alias("source_key"), pick("title"), pick("text"), F.coalesce("o.first_seen", "first").alias("first_seen"), F.coalesce("n.seen", "o.seen").alias("last_seen"), F.coalesce("o.status", F.lit("pending")).alias("status"))


def pending(items: DataFrame) -> DataFrame:
    return items.where("status IS NULL OR status = 'pending' OR normalized_at IS NULL OR normalized_at < last_seen")


def swept(items: DataFrame, registry: DataFrame) -> DataFrame:
    """items with status ignored for pending rows of sources that no registry row names."""
    known = registry.select("source_key", F.lit(True).alias("known")).distinct()
    j = items.join(known, "source_key", "left")
    return j.withColumn("status", F.when(F.col("known").isNull() & (F.coalesce("status", F.lit("pending")) == "pending"), "ignored").otherwise(F.col("status"))).drop("known")


def latest_snapshots(items: DataFrame) -> DataFrame:
    """Of a source's snapshots only the one of greatest id; other items stay."""
    last = items.where("kind = 'page_snapshot'").groupBy("source_key").agg(F.max("id").alias("last"))
    return items.join(last, "source_key", "left").where("kind <> 'page_snapshot' OR id = last").drop("last")


def run_log(polls: DataFrame) -> DataFrame:
    return polls.groupBy("source_key").agg(F.count("*").alias("n_items"), F.max("seen").alias("finished_at"), F.sum(F.col("changed").cast("int")).alias("n_changed"))


def seeded(held: DataFrame, seeds: DataFrame) -> DataFrame:
    """held and the seeds whose id and hash it lacks; of seeds with one id or hash the one of the first file counts."""
    by_id = Window.partitionBy("id").orderBy("file", "hash")
    by_hash = Window.partitionBy("hash").orderBy("file", "id")
    s = seeds.withColumn("n", F.row_number().over(by_id)).where("n = 1").withColumn("n", F.row_number().over(by_hash)).where("n = 1").drop("n")
    new = s.join(held.select("id"), "id", "left_anti").join(held.select("hash"), "hash", "left_anti")
    return held.unionByName(new.select(*held.columns))


def detail_links(pages: DataFrame, limit: int = 200) -> DataFrame:
    """page_id, url, title and place of links of a page's own host whose last path segment is a hyphenated slug of 8 characters
    at least; the title is the link's text (4 to 220 characters); the first of a url counts."""
    a = anchors(pages)
    slug = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "^[a-zA-Z]+://[^/]+/(?:.*/)?([^/]+)/?$", 1)
    a = a.where((host(F.col("url")) == host(F.col("page"))) & (F.length(slug) >= 8) & slug.contains("-") & F.length("title").between(4, 220))
    a = a.groupBy("page_id", "url").agg(F.min(F.struct("pos", "title")).alias("f"))
    w = Window.partitionBy("page_id").orderBy("f.pos")
    return a.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("page_id", "url", F.col("f.title").alias("title"), "place")


def matches(pages: DataFrame, pattern: str) -> DataFrame:
    """page_id, url, size (of the page), pos, step (how far its end is behind the last one's), long, found and after (what follows up to the next) of every match of a pattern in pages (page_id, url, html)."""
    found, between = F.regexp_extract_all("html", F.lit(pattern), F.lit(0)), F.split("html", pattern, -1)
    sized = pages.select("page_id", "url", "html", F.length("html").alias("size"))  # before, so that no match carries its page
    cut = sized.select("page_id", "url", "size", F.posexplode(F.arrays_zip(found.alias("found"), between.alias("before"), F.slice(between, 2, F.size(between)).alias("after"))).alias("pos", "m"))
    return cut.where("m.found IS NOT NULL").select("page_id", "url", "size", "pos", (F.length("m.before") + F.length("m.found")).alias("step"), F.length("m.found").alias("long"), "m.found", "m.after")


def placed(matches: DataFrame, told: str) -> DataFrame:
    """page_id, size, at and to (where a match begins, and where it is over, from 0) and told (a column) of matches: what lies between them is measured, so places are running sums and no page is searched twice; of texts only what is told is sorted."""
    up_to = F.sum("step").over(Window.partitionBy("page_id").orderBy("pos"))
    every = matches.select("page_id", "size", "pos", "step", "long", told).withColumn("to", up_to)
    return every.select("page_id", "size", (F.col("to") - F.col("long")).alias("at"), "to", told)


def is_detail(url: Column, page: Column) -> Column:
    """An address of the page's host whose path has no part of the site's own and ends with a slug of eight characters at least."""
    path = F.regexp_replace(F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "/+$", "")
    is_slug = lambda last: last.rlike("(?i)[a-z0-9]-[a-z0-9]") & (F.length(last) >= 8)
    shaped = lambda p: text.once(F.regexp_extract(p, "([^/]*)$", 1), is_slug) & ~text.once(F.lower(p), lambda low: text.any_word(low, fixed.CHROME_PATHS))
    return (host(url) == host(page)) & text.once(path, shaped)


def card_titles(pages: DataFrame, limit: int = 200) -> DataFrame:
    """page_id, url, title and place of the cards of listing pages: each link to a detail page with the title that its anchor has inside (a title element's, else its whole text: 8 to 220 characters, no "read more"), else with
    the first title element that begins behind the anchor and is over 200 characters behind the next such anchor at most (the last one: 2,700 behind it).

    Anchors and titles of a page are one ordered stream, and an anchor looks ahead to the next title and the next anchor. The first pair of an address counts, and the first of a page as the limit says.
    Pages are dealt over a number of tasks: packed, they are so small that Spark would put very many into one."""
    pages = pages.repartition(text.tasks(pages, 32), "page_id")
    plain = lambda c: text.compact(text.html_text(c))
    element = lambda c: plain(F.coalesce(*[F.nullif(F.regexp_extract(c, fixed.TITLE_ELEMENT, i), F.lit("")) for i in (1, 2)]))

    def good(own: Column) -> Column:
        noise = text.once(F.lower("href"), lambda low: text.any_word(low, fixed.NOISE_URL))
        for w in fixed.NOISE_TEXT:
            noise = noise | F.lower(own).startswith(w)
        return F.when(F.length(own).between(8, 220) & ~noise, own)

    inside = F.regexp_extract(F.substring("after", 1, 3000), r"(?is)^(.*?)</a\b", 1)
    own = text.once(text.once(inside, lambda x: F.coalesce(element(x), plain(x))), good)
    anchors = text.worked_out(matches(pages, fixed.ANCHOR_TAG), href=resolved(F.regexp_extract("found", fixed.ANCHOR_TAG, 1), F.col("url")))
    anchors = text.worked_out(anchors, detail=is_detail(F.col("href"), F.col("url")))
    anchors = text.worked_out(anchors, card=F.when(F.col("detail"), F.struct("href", own.alias("own"))))
    anchors = placed(anchors, "card").where("card IS NOT NULL").select("*", "card.*")
    found = placed(text.worked_out(matches(pages, fixed.TITLE_ELEMENT), name=element(F.col("found"))), "name")
    none = F.lit(None)
    stream = anchors.select("page_id", "size", F.col("to").alias("at"), F.struct("to", "href", "own").alias("a"), none.cast("struct<to:bigint,name:string>").alias("t"))
    stream = stream.unionByName(found.select("page_id", "size", "at", none.cast(stream.schema["a"].dataType).alias("a"), F.struct("to", "name").alias("t")))
    ahead = Window.partitionBy("page_id").orderBy("at", F.col("a").isNull()).rowsBetween(1, Window.unboundedFollowing)
    stream = stream.withColumn("title", F.first("t", ignorenulls=True).over(ahead)).withColumn("next", F.first("a", ignorenulls=True).over(ahead)).where("a IS NOT NULL")
    end = F.coalesce(F.col("next.to"), F.least("size", F.col("a.to") + 2500)) + 200
    pairs = stream.select("page_id", F.col("a.href").alias("url"), F.col("a.to").alias("at"), F.coalesce("a.own", F.when(F.col("title.to") <= end, F.col("title.name"))).alias("title")).where(F.length("title").between(4, 220))
    first = pairs.groupBy("page_id", "url").agg(F.min(F.struct("at", "title")).alias("f"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("f.at"))
    return first.withColumn("place", place).where(F.col("place") <= limit).select("page_id", "url", F.col("f.title").alias("title"), "place")


def new_details(links: DataFrame, items: DataFrame, limit: int = 60) -> DataFrame:
    """The first links (url, place) that no item (url) holds yet."""
    return links.join(items.select("url").distinct(), "url", "left_anti").orderBy("place", "url").limit(limit)


def posts(pages: DataFrame, mark: str = 'class="message"') -> DataFrame:
    """page_id, ref, place, text, html (of the text, cut at HTML_LIMIT; null if there is none), url (the block's own dated link, else made of the reference), published_at and media of pages of chat messages: a block from each mark to the next, with a data-post reference."""
    block = pages.select("page_id", F.posexplode(F.split("html", mark)).alias("place", "block")).where("place > 0")
    one = lambda p: F.nullif(F.regexp_extract("block", p, 1), F.lit(""))
    inner = F.regexp_extract("block", r'(?s)class="text"[^>]*>(.*?)</div>', 1)
    body = text.html_text(inner)
    url = F.coalesce(text.decode_entities(one(fixed.POST_LINK)), F.concat(F.lit("https://t.me/"), one(r'data-post="([^"]+)"')))
    media = F.array_distinct(F.regexp_extract_all("block", F.lit(r"""(?:src=["']|url\(["']?)(https?://[^"')]+)"""), F.lit(1)))
    return block.select("page_id", one(r'data-post="([^"]+)"').alias("ref"), "place", F.substring(body, 1, TEXT_LIMIT).alias("text"), F.nullif(F.substring(inner, 1, HTML_LIMIT), F.lit("")).alias("html"), url.alias("url"), one(r'datetime="([^"]+)"').alias("published_at"), media.alias("media"))


def posts_or_cards(pages: DataFrame) -> DataFrame:
    """Posts of pages that have some, link cards of the others (page_id, url or reference, title)."""
    p = posts(pages).where("text <> ''")
    rest = pages.join(p.select("page_id").distinct(), "page_id", "left_anti")
    return p.select("page_id", F.col("ref").alias("url"), F.substring("text", 1, 200).alias("title")).unionByName(cards(rest).select("page_id", "url", "title"))


def embedded(pages: DataFrame) -> DataFrame:
    """page_id, post_id, text, photos (of the chat's own picture host), links (distinct, outside of the chat service), maps_url (the first to a map) and hashtags (distinct) of pages that embed one chat post."""
    marked = r"(?s)tgme_widget_message_text[^>]*>(.*?)</div>"
    footed = rf"{marked}\s*<div class=\"tgme_widget_message_footer"
    inner = F.coalesce(F.nullif(F.regexp_extract("html", footed, 1), F.lit("")), F.regexp_extract("html", marked, 1))
    found = lambda p: F.regexp_extract_all("html", F.lit(p), F.lit(1))
    photos = F.array_distinct(F.filter(found(r"background-image:url\('([^']+)'\)"), lambda u: u.contains("telesco.pe")))
    links = F.array_distinct(F.filter(F.transform(found(r'href="(https?://[^"]+)"'), text.decode_entities), lambda u: ~u.rlike(r"t\.me|telegram\.")))
    p = pages.select("page_id", F.nullif(F.regexp_extract("html", r"t\.me/[^/\"']+/(\d+)", 1), F.lit("")).cast("long").alias("post_id"), text.html_text(inner).alias("text"), photos.alias("photos"), links.alias("links"))
    maps = F.get(F.filter("links", lambda u: u.rlike(r"maps\.app\.goo\.gl|google\.[^/]+/maps|goo\.gl/maps")), F.lit(0))
    return p.select("*", maps.alias("maps_url"), F.array_distinct(F.regexp_extract_all("text", F.lit(r"#([^\s#<]+)"), F.lit(1))).alias("hashtags"))


def polled(polls: DataFrame) -> DataFrame:
    """The run log: a row for each poll of a source (source_key, run_id, http, n_items, n_new, error) with its status and whether anything changed."""
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("http") == 304, "not_modified").when(F.col("n_new") > 0, "changed").otherwise("unchanged")
    return polls.select("source_key", "run_id", "http", F.coalesce("n_items", F.lit(0)).alias("n_items"), status.alias("status"), (F.coalesce("n_new", F.lit(0)) > 0).alias("changed"), F.substring("error", 1, 200).alias("notes"))


def article(pages: DataFrame) -> DataFrame:
    """page_id, title (h1) and body (paragraphs joined by blank lines, trailing photo credits left out; else the description) of article pages."""
    paragraphs = F.filter(F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>(.*?)(?=<p\b|</p>)"), F.lit(1)), lambda x: text.compact(text.html_text(x))), lambda x: x.isNotNull())
    credit = lambda x: x.rlike(r"(?iu)^(foto|fotos|photo|фото)\s*[:©]")
    last = F.coalesce(F.array_max(F.transform(paragraphs, lambda x, i: F.when(~credit(x), i + 1).otherwise(0))), F.lit(0))
    body = F.nullif(F.array_join(F.slice(paragraphs, F.lit(1), last), "\n\n"), F.lit(""))
    return pages.select("page_id", text.compact(text.html_text(F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1))).alias("title"), F.coalesce(body, F.try_element_at(meta(F.col("html")), F.lit("og:description"))).alias("body"))
