"""Entity resolution of places, coordinates from text and a gazetteer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, text
from ..functions.storage import saved
from .graph import components
from .resolution import weight_rank

EARTH_METRES = 6_371_000


def jaro_winkler(a: str | None, b: str | None) -> float:
    """Likeness of two strings; a common prefix of up to four characters counts at any likeness."""
    a, b = a or "", b or ""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = list(b)
    mine, theirs = [], [False] * len(b)
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(i + reach + 1, len(b))):
            if free[j] == c and not theirs[j]:
                theirs[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(mine, (c for c, t in zip(b, theirs, strict=True) if t), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)])


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    s = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_METRES * F.asin(F.least(F.lit(1.0), F.sqrt(s)))


def is_centroid(lat: Column, lng: Column) -> Column:
    near = F.lit(False)
    for a, b in fixed.CENTROIDS:
        near = near | (metres(lat, lng, F.lit(a), F.lit(b)) <= fixed.CENTROID_METRES)
    return F.coalesce(near, F.lit(False))


def corroborates(a: str, b: str) -> Column:
    """Whether both pins (columns lat, lng, geo_source with the suffixes a and b) come from maps, are no fallback, and are near."""
    c = lambda n, x: F.col(n + x)
    pins = (c("geo_source", a) == "map_url") & (c("geo_source", b) == "map_url")
    pins = pins & ~is_centroid(c("lat", a), c("lng", a)) & ~is_centroid(c("lat", b), c("lng", b))
    return F.coalesce(pins & (metres(c("lat", a), c("lng", a), c("lat", b), c("lng", b)) <= fixed.PIN_METRES), F.lit(False))


def block(places: DataFrame) -> DataFrame:
    known = lambda c: F.when(text.slug(c) == "", "unknown").otherwise(text.slug(c))
    area = F.coalesce(F.nullif("area", F.lit("")), F.col("district") if "district" in places.columns else F.lit(None))
    return places.withColumn("block", F.concat_ws("|", text.signature(F.col("name")), known(area), known(F.col("category")))).withColumn("plain", text.slug(text.latin(F.col("name"))))


#: Rows of one key that a task compares with all others of it; a fuller key is cut by salts.
DENSE = 1000


def side(p: DataFrame, x: str, *more: str) -> DataFrame:
    return p.select(*[F.col(c).alias(c + x) for c in ("id", "link", "source", "external_ref")], *more)


def met(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """left and right (id_a and id_b in them) where they agree in key and id_a < id_b.

    Pairs are many where rows are few, so both sides are dealt over a fixed number of tasks instead of by their size, and a key of more than DENSE rows in right is cut by salts of their ids that left looks into in turn."""
    tasks = 4 * left.sparkSession.sparkContext.defaultParallelism
    full = right.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > DENSE).select(*key, F.ceil(F.col("n") / DENSE).cast("int").alias("salts"))
    l = left.join(full, [*key], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0))))).drop("salts")  # noqa: E741
    r = right.join(full, [*key], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id_b"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    return l.repartition(tasks, *key, "salt").join(r.repartition(tasks, *key, "salt").hint("merge"), [*key, "salt"]).where("id_a < id_b")


def rows_alike(p: DataFrame) -> DataFrame:
    """Rows a and b (columns of side; id_a < id_b) of one block with like names and (two sources or near pins). Names are compared once a block, in both orders, however many rows have them."""
    n = saved(p.select("block", "plain").where("plain <> ''").distinct().withColumn("name", F.monotonically_increasing_id()))
    tasks = 4 * p.sparkSession.sparkContext.defaultParallelism
    one = lambda x: n.select("block", F.col("plain").alias("plain" + x), F.col("name").alias("name" + x)).repartition(tasks, "block")
    # with so high a likeness, neither name is over twice as long as the other: likeness is at most 0.4 + 0.6 * (2 + shorter / longer) / 3
    near = F.least(F.length("plain_a"), F.length("plain_b")) * 2 >= F.greatest(F.length("plain_a"), F.length("plain_b"))
    two = one("_a").join(one("_b").hint("merge"), "block").where("name_a <> name_b").where(near).where(likeness("plain_a", "plain_b") >= fixed.NAME_LIKENESS)
    like = saved(two.select("name_a", "name_b").unionByName(n.select(F.col("name").alias("name_a"), F.col("name").alias("name_b"))))
    pin = F.coalesce((F.col("geo_source") == "map_url") & ~is_centroid(F.col("lat"), F.col("lng")), F.lit(False))
    rows = p.join(n.hint("merge"), ["block", "plain"]).withColumn("pin", pin)
    own = lambda x: side(rows, x, *[F.col(c).alias(c + x) for c in ("name", "lat", "lng", "pin")])
    found = met(own("_a").join(like.hint("merge"), "name_a").drop("name_a"), own("_b"), "name_b")
    close = F.col("pin_a") & F.col("pin_b") & F.coalesce(metres(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b")) <= fixed.PIN_METRES, F.lit(False))
    return found.where(F.coalesce(F.col("source_a") != F.col("source_b"), F.lit(False)) | close)


def alike_in_block(p: DataFrame) -> DataFrame:
    """a and b (a < b) of one block with like names and (two sources or near pins)."""
    return rows_alike(p).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def like_names(p: DataFrame) -> DataFrame:
    """block, plain_a and plain_b (both orders, and each name with itself) of like names of a block: names are compared once, however many rows have them."""
    n = p.select("block", "plain").where("plain <> ''").distinct()
    two = n.withColumnRenamed("plain", "plain_a").join(n.withColumnRenamed("plain", "plain_b").hint("merge"), "block").where("plain_a < plain_b")
    # with so high a likeness, neither name is over twice as long as the other: likeness is at most 0.4 + 0.6 * (2 + shorter / longer) / 3
    near = F.least(F.length("plain_a"), F.length("plain_b")) * 2 >= F.greatest(F.length("plain_a"), F.length("plain_b"))
    like = F.greatest(likeness("plain_a", "plain_b"), likeness("plain_b", "plain_a")) >= fixed.NAME_LIKENESS
    one = two.where(near).where(like)
    return one.unionByName(one.select("block", F.col("plain_b").alias("plain_a"), F.col("plain_a").alias("plain_b"))).unionByName(n.select("block", F.col("plain").alias("plain_a"), F.col("plain").alias("plain_b")))


def links_by_name(p: DataFrame) -> DataFrame:
    """a and b that join the same rows as alike_in_block, without all its pairs.

    Rows of one block, name and source are a class. Like names of two sources tie all rows of one class to all of the other, so each row is tied to the least one of its class and the least ones to each other. Rows of one source
    need near pins too: those of one class and pin are tied to their least one, and such groups meet group by group."""
    like = like_names(p)
    key = ["block", "plain", "source"]
    rows = p.where("plain <> ''").select("id", "block", "plain", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"), "lat", "lng", "geo_source")  # empty: a source unknown, which differs from none
    classes = rows.groupBy(*key).agg(F.min("id").alias("least"))
    left, right = classes.select("block", F.col("plain").alias("plain_a"), F.col("source").alias("s"), F.col("least").alias("a")), classes.select("block", F.col("plain").alias("plain_b"), F.col("source").alias("t"), F.col("least").alias("b"))
    across = like.join(left.hint("merge"), ["block", "plain_a"]).join(right.hint("merge"), ["block", "plain_b"]).where("s <> t AND s <> '' AND t <> ''").select("a", "b")
    met = across.select(F.col("a").alias("least")).distinct()
    own = rows.join(classes.join(met.hint("merge"), "least", "left_semi").hint("merge"), key).where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    pin = rows.where("geo_source = 'map_url' AND lat IS NOT NULL AND lng IS NOT NULL").groupBy(*key, "lat", "lng", "geo_source").agg(F.min("id").alias("id"))
    pins = lambda x: pin.select("block", *[F.col(c).alias(c + x) for c in ("plain", "source", "lat", "lng", "geo_source", "id")])
    near = like.join(pins("_a").hint("merge"), ["block", "plain_a"]).join(pins("_b").hint("merge"), ["block", "plain_b"]).where("(source_a = source_b OR source_a = '' OR source_b = '') AND id_a < id_b").where(corroborates("_a", "_b"))
    same = rows.join(pin.where(~is_centroid(F.col("lat"), F.col("lng"))).withColumnRenamed("id", "least").hint("merge"), [*key, "lat", "lng", "geo_source"]).where("id <> least")
    return across.where("a < b").unionByName(own).unionByName(near.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).unionByName(same.select(F.col("least").alias("a"), F.col("id").alias("b")))


def pairs(places: DataFrame) -> DataFrame:
    """a and b (a < b) of one place: one maps link, or one reference of one source, or one block with like names and (two sources or near pins).

    A pair that two of these find is left to the first of them, so no pair is shuffled to find its repeats; only where ids repeat, pairs are made distinct."""
    p = block(text.spread(places)).withColumn("link", F.nullif(F.lower(F.trim(text.empty(F.col("maps_url")))), F.lit("")))
    p = saved(p.select("id", "link", "source", "external_ref", "block", "plain", "lat", "lng", "geo_source"))
    linked, named = p.dropna(subset=["link"]), p.dropna(subset=["source", "external_ref"])
    by_link = met(linked.select(F.col("id").alias("id_a"), "link"), linked.select(F.col("id").alias("id_b"), "link"), "link")
    by_ref = met(named.select(F.col("id").alias("id_a"), F.col("link").alias("link_a"), "source", "external_ref"), named.select(F.col("id").alias("id_b"), F.col("link").alias("link_b"), "source", "external_ref"), "source", "external_ref")
    one_link = F.coalesce(F.col("link_a") == F.col("link_b"), F.lit(False))
    one_ref = F.coalesce((F.col("source_a") == F.col("source_b")) & (F.col("external_ref_a") == F.col("external_ref_b")), F.lit(False))
    every = by_link.select("id_a", "id_b").unionByName(by_ref.where(~one_link).select("id_a", "id_b")).unionByName(rows_alike(p).where(~one_link & ~one_ref).select("id_a", "id_b"))
    every = every.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return every if p.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty() else every.distinct()


def links(places: DataFrame) -> DataFrame:
    """a and b that join the same places as pairs, but rows of one maps link, or of one reference of one source, only to the least of them, so that a shared link makes no pairs of all its rows."""
    p = block(places).withColumn("link", F.nullif(F.lower(F.trim(text.empty(F.col("maps_url")))), F.lit("")))

    def star(*key: str) -> DataFrame:
        rows = p.select("id", *key).dropna(subset=[*key])
        least = rows.groupBy(*key).agg(F.min("id").alias("a"))
        return rows.join(least.hint("merge"), [*key]).where("a < id").select("a", F.col("id").alias("b"))

    return star("link").unionByName(star("source", "external_ref")).unionByName(links_by_name(p)).distinct()


def resolved(places: DataFrame, weights: dict[str, str]) -> DataFrame:
    """id and root of every place: its component's row of best source weight, with a pin, seen first (if places have first_seen, as text), of least id."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source"))
    seen = F.coalesce("first_seen", F.lit("~")) if "first_seen" in places.columns else F.lit("")
    order = F.struct((-weight_rank(weight)).alias("w"), F.col("lat").isNull().alias("p"), seen.alias("s"), "id")
    own = places.select("id", order.alias("o")).join(components(links(places)), "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = own.groupBy("root").agg(F.min("o").alias("f"))
    return own.join(first, "root").select("id", F.col("f.id").alias("root"))


def merged_places(places: DataFrame, found: DataFrame) -> DataFrame:
    """Surviving places with recommended_by (array: the distinct ones of all members, sorted) and n_members; a place's own may be null."""
    own = places.select("id", "recommended_by").join(found, "id")
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("recommended_by", F.array().cast("array<string>"))))))
    g = own.groupBy("root").agg(every.alias("recommended_by"), F.count("*").alias("n_members")).withColumnRenamed("root", "id")
    return places.drop("recommended_by").join(g, "id")


def geocoded(rows: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """rows (id, queries, url_lat, url_lng) with lat, lng and geo_source: the link's own point, else the gazetteer's (name, lat, lng) for the first query that has one and isn't a fallback."""
    asked = rows.select("id", F.posexplode("queries").alias("pos", "q"))
    good = gazetteer.where(~is_centroid(F.col("lat"), F.col("lng")))
    hit = asked.join(good, F.col("q") == F.col("name")).groupBy("id").agg(F.min(F.struct("pos", "lat", "lng")).alias("h"))
    j = rows.join(hit, "id", "left")
    source = F.when(F.col("url_lat").isNotNull(), "map_url").when(F.col("h").isNotNull(), "gazetteer")
    return j.select("id", F.coalesce("url_lat", "h.lat").alias("lat"), F.coalesce("url_lng", "h.lng").alias("lng"), source.alias("geo_source"))


def coverage(hinted: DataFrame) -> DataFrame:
    """One row: hinted (rows) and mapped (the share of them that has coordinates)."""
    return hinted.agg(F.count("*").alias("hinted"), F.avg((F.col("lat").isNotNull() & F.col("lng").isNotNull()).cast("int")).alias("mapped"))


def point_of(url: Column) -> Column:
    """struct(lat, lng) of a maps link: of q, query, ll or center, in this order, else of @lat,lng; null without one."""
    number = r"(-?\d+(?:\.\d+)?)"
    out = F.lit(None).cast("struct<lat:double,lng:double>")
    for pattern in (rf"@{number},{number}", *(rf"[?&]{k}={number}(?:,|%2C){number}" for k in ("center", "ll", "query", "q"))):
        out = F.when(url.rlike(pattern), F.struct(F.regexp_extract(url, pattern, 1).cast("double").alias("lat"), F.regexp_extract(url, pattern, 2).cast("double").alias("lng"))).otherwise(out)
    return out


ENRICHMENT = "title_ru string, description_ru string, category string, venue_name string, confidence string, links array<struct<label:string,url:string>>, citations array<struct<url:string,supports:string>>"


def validated(json: Column) -> Column:
    """The JSON in a model's answer (what stands around it doesn't count) as a struct: unknown keys go, blanks are null, confidence is in [0, 1] (0 where it is no number), links need a url and are labelled with it."""
    j = text.json_in(json, ENRICHMENT)
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    sure = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), j["confidence"].try_cast("double"))), F.lit(0.0))
    links = F.transform(F.filter(F.coalesce(j["links"], F.array().cast("array<struct<label:string,url:string>>")), lambda x: blank(x["url"]).isNotNull()), lambda x: F.struct(F.coalesce(blank(x["label"]), x["url"]).alias("label"), x["url"].alias("url")))
    cites = F.filter(F.coalesce(j["citations"], F.array().cast("array<struct<url:string,supports:string>>")), lambda x: blank(x["url"]).isNotNull())
    own = [blank(j[c]).alias(c) for c in ("title_ru", "description_ru", "category", "venue_name")]
    return F.struct(*own, sure.alias("confidence"), links.alias("links"), cites.alias("citations"), (F.coalesce(blank(j["venue_name"]), F.lit("")) != "").alias("asserts"))


def promoted(events: DataFrame, results: DataFrame) -> DataFrame:
    """events with an enrichment's values first where it has them (results: id, json), held where facts lack a citation or confidence is low."""
    r = results.select("id", validated(F.col("json")).alias("v"))
    j = events.join(r, "id", "left")
    held = F.coalesce((F.col("v.asserts") & (F.size("v.citations") == 0)) | (F.col("v.confidence") < fixed.LEAST_CONFIDENCE), F.lit(False))
    new = {c: F.coalesce(f"v.{c}", c) for c in ("category", "venue_name")}
    return j.withColumns(new | {"title_ru": F.col("v.title_ru"), "held": held, "confidence": F.col("v.confidence")}).drop("v")


#: Columns of events that an enrichment's values come first in.
PROMOTED = ["title_ru", "description_ru", "category", "venue_name", "address", "district", "price", "image_url"]
ANSWER = ", ".join([*(f"{c} string" for c in PROMOTED), "is_free boolean, maps_url string, confidence string, model string, notes string, links array<struct<label:string,url:string>>, citations array<struct<url:string,supports:string>>"])


def written_back(events: DataFrame, results: DataFrame, at: Column, model: str | None = None) -> DataFrame:
    """The events table after enrichment results (id, json: a model's answer): values that an answer has come first, all others stay (blank is none); links_json takes its links and then its map link, if it has any; enrichment_json holds the
    answer in full, without unknown keys, with confidence in [0, 1], the model, and a note where facts lack a citation; enriched_at is set. Events without an answer, or with one that is no JSON, stay as they are; scores do in any case."""
    j = text.json_in(F.col("json"), ANSWER)
    r = results.select("id", j.alias("j"), validated(F.col("json")).alias("v")).where("j IS NOT NULL")
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    link = F.when(blank("j.maps_url").isNotNull(), F.array(F.struct(F.lit("Google Maps").alias("label"), blank("j.maps_url").alias("url")))).otherwise(F.array().cast("array<struct<label:string,url:string>>"))
    links = F.concat("v.links", link)
    bare = F.col("v.asserts") & (F.size("v.citations") == 0)
    note = F.nullif(F.concat_ws("; ", blank("j.notes"), F.when(bare, "ungrounded"), F.when(F.col("v.confidence") < fixed.LEAST_CONFIDENCE, "low confidence")), F.lit(""))
    audit = F.to_json(F.struct(*[blank(f"j.{c}").alias(c) for c in PROMOTED], F.col("j.is_free").alias("is_free"), blank("j.maps_url").alias("maps_url"), F.col("v.confidence").alias("confidence"), F.coalesce(blank("j.model"), F.lit(model)).alias("model"),
        note.alias("notes"), F.col("v.links").alias("links"), F.col("v.citations").alias("citations")))
    r = r.select("id", F.struct(*[blank(f"j.{c}").alias(c) for c in PROMOTED], F.col("j.is_free").cast("int").alias("is_free"), F.when(F.size(links) > 0, F.to_json(links)).alias("links_json"), audit.alias("enrichment_json")).alias("new"))
    own = [c for c in (*PROMOTED, "is_free", "links_json") if c in events.columns]
    e = events.join(r, "id", "left").withColumns({c: F.coalesce(f"new.{c}", c) for c in own})
    return e.withColumns({"enrichment_json": F.coalesce("new.enrichment_json", "enrichment_json"), "enriched_at": F.when(F.col("new").isNotNull(), at).otherwise(F.col("enriched_at"))}).drop("new")


def enrichment_queue(events: DataFrame, limit: int) -> DataFrame:
    todo = events.where("enriched_at IS NULL OR last_seen > enriched_at")
    return todo.orderBy(F.desc_nulls_last("score"), "id").limit(limit)


def evaluated(pairs: DataFrame) -> DataFrame:
    """path, cases, passed of predictions against expectations (columns path, predicted, expected): a text passes that is 85 % alike by edit distance."""
    a, b = F.lower(text.empty(F.col("predicted"))), F.lower(text.empty(F.col("expected")))
    most = F.floor(F.greatest(F.length(a), F.length(b)) * 15 / 100).cast("int")
    near = (F.abs(F.length(a) - F.length(b)) <= most) & (F.call_function("levenshtein", a, b, most) >= 0)  # beyond so many edits: -1, and only that many are looked at
    return pairs.groupBy("path").agg(F.count("*").alias("cases"), F.sum(near.cast("long")).alias("passed"))


CRITERIA = "venue_name string, start_date string, end_date string, address string, confidence double, urls array<string>"


def judged(predictions: DataFrame, golden: DataFrame) -> DataFrame:
    """case, path, criterion and passed of every criterion that a golden case (case, path, json) states, against the prediction of its case (case, json; a case may have none, and then fails).

    json of a golden case has some of venue_name (alike to 85 % by edit distance), start_date, end_date and address (stand in the prediction as they are), confidence (at least that, but for a ten-thousandth) and links or links_json (objects with
    a url, or urls; links_json may be the array as text). All urls that are wanted must be among the prediction's links: they are divided by those that are there, so a wanted url twice is one. A prediction that is no JSON object fails."""
    wanted = golden.select("case", "path", F.try_parse_json("json").alias("g"))
    one = lambda v, path: F.try_variant_get(v, path, "string")
    facts = [("venue_name", "venue"), ("start_date", "dates"), ("end_date", "dates"), ("address", "address")]
    stated = F.array(*[F.struct(F.lit(kind).alias("criterion"), F.lit(name).alias("name"), text.compact(one("g", f"$.{name}")).alias("value")) for name, kind in facts], F.struct(F.lit("confidence").alias("criterion"), F.lit("confidence").alias("name"), one("g", "$.confidence").alias("value")))
    predicted = predictions.select("case", F.col("json").alias("said"), F.try_parse_json("json").alias("p"))
    g = wanted.join(predicted, "case", "left")
    each = g.select("case", "path", "said", "p", F.explode(F.filter(stated, lambda s: s["value"].isNotNull())).alias("s"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("p"), F.lit("OBJECT")), F.lit(False))
    a, b = F.lower(text.empty(one("p", "$.venue_name"))), F.lower(F.col("s.value"))
    alike = F.levenshtein(a, b) * 100 <= F.greatest(F.length(a), F.length(b)) * 15
    sure = one("p", "$.confidence").try_cast("double") >= F.col("s.value").try_cast("double") - 0.0001
    ok = F.when(F.col("s.criterion") == "venue", alike).when(F.col("s.criterion") == "confidence", sure).otherwise(F.contains("said", F.col("s.value")))
    facts_passed = each.select("case", "path", F.col("s.name").alias("criterion"), (is_object & F.coalesce(ok, F.lit(False))).alias("passed"))

    def urls(v: str) -> Column:
        """The urls of links, else of links_json."""
        lists = F.coalesce(F.try_variant_get(v, "$.links", "array<variant>"), F.try_variant_get(v, "$.links_json", "array<variant>"), F.try_variant_get(F.try_parse_json(one(v, "$.links_json")), "$", "array<variant>"))
        found = F.transform(F.coalesce(lists, F.array().cast("array<variant>")), lambda x: F.coalesce(one(x, "$.url"), F.when(F.schema_of_variant(x) == "STRING", one(x, "$"))))
        return F.array_distinct(F.filter(found, lambda u: u.isNotNull() & (u != "")))

    asked = wanted.select("case", "path", F.explode(urls("g")).alias("url"))
    there = predicted.select("case", F.explode(urls("p")).alias("url"), F.lit(True).alias("there"))
    links = asked.join(there, ["case", "url"], "left").groupBy("case", "path").agg((F.count("there") == F.count("*")).alias("passed"))
    return facts_passed.unionByName(links.select("case", "path", F.lit("links").alias("criterion"), "passed"))


def verdicts(judgements: DataFrame) -> DataFrame:
    """path, cases, passed (cases that meet all their criteria), and for each criterion how many cases met it, of how many."""
    by_case = judgements.groupBy("path", "case").agg(F.min(F.col("passed").cast("int")).alias("all_met"))
    cases = by_case.groupBy("path").agg(F.count("*").alias("cases"), F.sum("all_met").alias("passed"))
    by_criterion = judgements.groupBy("path", "criterion").agg(F.count_if("passed").alias("met"), F.count("*").alias("of"))
    return cases.join(by_criterion, "path").select("path", "cases", "passed", "criterion", "met", "of")
