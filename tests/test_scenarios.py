"""Expectations on small tables: resolution, text, scores, places, health."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from gatherline.functions import text
from gatherline.operators import operations, places, read_model, resolution

EVENT = "id long, title string, city string, start_date string, end_date string, start_time string, venue_name string, score int, source string, source_weight string, url string, external_ref string, source_url string"


def event(i, title, day="2026-07-10", source="a", weight="good", **more):
    row = {"id": i, "title": title, "city": "Valencia", "start_date": day, "end_date": None, "start_time": None, "venue_name": None, "score": None, "source": source, "source_weight": weight, "url": None, "external_ref": None, "source_url": f"http://{source}/{i}"}
    return tuple((row | more).values())


def roots(spark, rows):
    return {r["id"]: (r["root"], r["method"]) for r in resolution.resolve(spark.createDataFrame(rows, EVENT)).collect()}


def test_one_concert_of_three_sources(spark):
    rows = [event(1, "Слава Комиссаренко", "2026-07-10", "a", "good"), event(2, "Stand Up: Slava Komissarenko", "2026-07-11", "b", "gold"), event(3, "Slava Komissarenko — concert", "2026-07-12", "c", "mine", end_date="2026-07-20")]
    assert roots(spark, rows) == {1: (2, "fuzzy"), 2: (2, "self"), 3: (2, "fuzzy")}
    df = spark.createDataFrame(rows, EVENT)
    one = resolution.merged(df, resolution.resolve(df)).collect()
    assert [(r["id"], r["end_date"], r["n_members"], [s["source"] for s in r["sources"]]) for r in one] == [(2, "2026-07-20", 3, ["a", "b", "c"])]


def test_windows_are_anchored(spark):
    days = ["2026-07-01", "2026-07-03", "2026-07-05", "2026-07-07", None]
    rows = [event(i, "Oxxxymiron", d, f"s{i}") for i, d in enumerate(days)]
    got = {r["id"]: r["window"] for r in resolution.windows(resolution.keyed(spark.createDataFrame(rows, EVENT))).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2, 4: 1}


def test_shared_page_events_stay_apart(spark):
    rows = [event(1, "Alpha night", "2026-07-01", "a", url="http://x/list"), event(2, "Beta morning", "2026-07-01", "a", url="http://x/list"), event(3, "Alpha night", "2026-07-01", "a", url="http://X/list/")]
    assert roots(spark, rows) == {1: (1, "self"), 2: (2, "self"), 3: (1, "strong")}


def test_untitled_rows_of_one_source_are_not_one(spark):
    assert {r for r, _ in roots(spark, [event(1, "!!!", url="http://x"), event(2, "???", url="http://x")]).values()} == {1, 2}


def test_digest_never_chains(spark):
    rows = [event(1, "Komissarenko morgenshtern oxxxymiron digest", source="news"), event(2, "Komissarenko", source="a"), event(3, "Morgenshtern", source="b"), event(4, "Oxxxymiron", source="c")]
    assert {i: r for i, (r, _) in roots(spark, rows).items()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_containment(spark):
    rows = [event(1, "Oxxxymiron", source="a"), event(2, "Oxxxymiron Roig Arena", "2026-07-12", source="b"), event(3, "Mamma Mia Teatro Olympia", source="a"), event(4, "Ilustres Ignorantes Teatro Olympia", source="b")]
    got = roots(spark, rows)
    assert got[2] == (1, "contain") and got[3][0] == 3 and got[4][0] == 4


def test_ticket_tiers(spark):
    rows = [event(1, "Rod Stewart | Paquetes VIP", source="t", start_time="00:00", venue_name="V"), event(2, "Rod Stewart", source="t", start_time="21:00", venue_name="v"), event(3, "Rod Stewart", "2026-07-11", "t", start_time="21:00", venue_name="v")]
    assert roots(spark, rows) == {1: (2, "tier"), 2: (2, "self"), 3: (3, "self")}


def test_resolution_does_not_depend_on_order(spark):
    rows = [event(i, t, f"2026-07-{10 + i % 4}", f"s{i % 3}") for i, t in enumerate(["Oxxxymiron", "Oxxxymiron live", "Yandel", "Yandel — Meet&Greet", "Komissarenko", "Komissarenko show", "x", ""] * 2)]
    assert roots(spark, rows) == roots(spark, rows[::-1])


def one(spark, c, value):
    return spark.createDataFrame([(value,)], "v string").select(c(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.slug, "  Crème Brûlée & Öl! ", "creme-brulee-ol"), (text.slug, None, ""), (text.latin, "Щука Ёж", "schuka ezh"), (text.norm, " A  b—C ", "a bc"),
        (text.signature, "Stand Up: Slava 28", "slava"), (text.signature, "!!!", "untitled"), (text.signature, "28 69", "28-69"), (text.base_title, "Yandel — Meet&Greet Upgrade", "yandel"),
        (text.decode_entities, "&amp;lt; &#1078;&#x1F525; &nbsp;", "< ж🔥  "), (text.html_text, "<p>a<br>b</p><script>x</script>c", "a\nb\n c"), (text.category, " Концерты ", "концерт"),
        (text.category, "выставки", "выставки"), (text.clean_controls, "a\x00b\tc🔥", "ab\tc🔥"), (text.language, "привет hi", "ru"), (text.excerpt, "a" * 300, "a" * 219 + "…"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, f, value) == want


def test_folding_is_that_of_unicode(spark):
    letters = [c for c in map(chr, range(0xC0, 0x24F)) if len(n := unicodedata.normalize("NFKD", c)) == 2 and unicodedata.combining(n[1])]
    want = "".join(c for c in unicodedata.normalize("NFKD", "".join(letters)) if not unicodedata.combining(c))
    assert one(spark, text.fold, "".join(letters)) == want


def test_noise_tags(spark):
    tags = ["jazz", "city:valencia", "city valencia", "has-image", "99 5", "a1234567", "x" * 29, "", "tg-logunespa", "open air"]
    got = spark.createDataFrame([(tags,)], "t array<string>").select(text.clean_tags(F.col("t"))).first()[0]
    assert got == ["jazz", "open air"]


def test_exposition_and_feature(spark):
    rows = [("Expo", "culture", "web:x", "[]", "2026-01-01", "2026-01-03"), ("Выставка", "", "web:x", "[]", "2026-01-01", "2026-01-05"), ("Fest", "festival", "web:x", "[]", "2026-01-01", "2026-02-05"), ("x", "", "web:x", '["feria-de-julio"]', None, None), ("x", "", "w", "bad json", None, None)]
    df = spark.createDataFrame(rows, "title string, category string, source string, tags_json string, start_date string, end_date string")
    assert [r[0] for r in df.select(read_model.feature()).collect()] == [None, "exposition", "festival", "feria", None]


def test_confidence_gate(spark):
    rows = [("t", None, None), ("t", "2026", '{"confidence": 0.4}'), ("t", "2026", '{"confidence": 0.6}'), ("t", "2026", "bad"), ("news", None, None)]
    df = spark.createDataFrame(rows, "category string, enriched_at string, enrichment_json string").withColumn("tags_json", F.lit("[]"))
    assert [r[0] for r in df.select(read_model.digest_gate()).collect()] == [True, False, True, True, False]


PLACE = "id long, name string, area string, category string, lat double, lng double, geo_source string, maps_url string, external_ref string, source string"


def test_places(spark):
    fallback = (39.4697065, -0.3763353)
    rows = [(i, "Cafe Uno", "centre", "cafe", *fallback, "map_url", None, None, "s") for i in (1, 2, 3)]  # a fallback point never corroborates
    rows += [(4, "Bar Dos", "port", "bar", 39.5, -0.3, "map_url", None, None, "s"), (5, "Bar Dos", "port", "bar", 39.5001, -0.3, "map_url", None, None, "s")]
    rows += [(6, "A", None, None, None, None, None, "https://M/1 ", None, "x"), (7, "B", None, None, None, None, None, "https://m/1", None, "y")]
    df = spark.createDataFrame(rows, PLACE)
    assert {tuple(r) for r in places.pairs(df).collect()} == {(4, 5), (6, 7)}


def test_jaro_winkler():
    assert places.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert places.jaro_winkler("abcd", "abxyzq") == pytest.approx(0.688889, abs=1e-5)
    assert places.jaro_winkler("", "") == 0 and places.jaro_winkler("a", "a") == 1


def test_stale_reasons(spark):
    rows = [("a", 1, "2026-01-01 00:00:00", 0, "ok"), ("b", 1, "2026-01-01 11:00:00", 0, "ok"), ("c", 1, None, 5, "ok"), ("d", 1, None, 0, "error"), ("e", 0, None, 9, "error")]
    df = spark.createDataFrame(rows, "source_key string, enabled int, next_due string, fail_count long, last_status string").withColumn("next_due", F.to_timestamp("next_due"))
    got = {r["source_key"]: r["reason"] for r in operations.stale(df, "2026-01-01 12:00:00").collect()}
    assert got == {"a": "overdue 12.0h past next_due_at", "c": "fail_count 5 ≥ 5", "d": "last run errored"}
