"""Pages, posts, venues, feeds, exports and golden cases on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatherline.functions import text
from gatherline.operators import gates, normalize, places, posts, proximity, resolution, shapes, venue_listings
from gatherline.sources import export, pages, schedules

ITEM = "id long, source_key string, kind string, title string, text string, url string, seen string"


def item(i, title=None, body=None, source="s", kind="link_card", url=None, seen="2026-06-01 10:00:00"):
    return (i, source, kind, title, body, url, seen)


def items(spark, rows):
    return spark.createDataFrame(rows, ITEM).withColumn("seen", F.to_timestamp("seen"))


def haversine(a, b):
    s = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * places.EARTH_METRES * math.asin(min(1, math.sqrt(s)))


def test_near_pins_anywhere_on_the_globe(spark):
    r = random.Random(3)
    pins = [(i, 39.47 + r.uniform(-0.01, 0.01), -0.37 + r.uniform(-0.01, 0.01)) for i in range(150)]
    pins += [(200 + i, r.uniform(-0.001, 0.001), r.choice([-1, 1]) * (180 - r.uniform(0, 0.001))) for i in range(60)]
    pins += [(300 + i, r.choice([-1, 1]) * (90 - r.uniform(0, 0.001)), r.uniform(-180, 180)) for i in range(60)]
    pins += [(400 + i, 10.0, 20.0) for i in range(30)] + [(500, None, 1.0), (501, 95.0, 1.0), (502, 1.0, float("nan"))] + [(600 + i, 71.2 + i * 1e-4, 25.0 + i * 2e-3) for i in range(40)]
    good = [p for p in pins if p[1] is not None and -90 <= p[1] <= 90 and -180 <= p[2] <= 180]
    df = spark.createDataFrame(pins, "id long, lat double, lng double")
    for within in (100, 1000):
        want = {(a[0], b[0]) for a in good for b in good if a[0] < b[0] and haversine(a[1:], b[1:]) <= within}
        for dense in (2000, 7):  # salted cells too
            got = proximity.near_pairs(df, within, dense).collect()
            assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


def test_a_dense_cell_is_cut(spark):
    pins = spark.range(3000).selectExpr("id", "cast(10 AS double) + id * 1e-9 AS lat", "cast(20 AS double) AS lng")
    assert proximity.near_pairs(pins, 1e-6, 100).count() == 0 and proximity.near_pairs(pins.where("id < 300"), 100, 100).count() == 300 * 299 // 2


def test_titles_of_cards(spark):
    html = """<a href="/events/alpha-night"><img></a><div class="x event-title">Alpha &amp; co</div>
    <a href='https://h.org/events/beta-night'>Leer más de este acto</a><p>text</p><h2>Beta night</h2>
    <h3>Gamma night</h3><a class=c href="/events/gamma-night">Gamma night</a>
    <a href="/events/delta-night"><span>far</span></a>""" + "x" * 300 + """<a href="/events/epsilon-night">Epsilon night it is</a>""" + "x" * 250 + """<h3>Not delta's</h3>
    <a href="/tag/some-tag-here">Tagged and long</a><a href="/short-a">Too short a slug</a><a href="//other.org/events/zeta-night">Zeta night it is</a>
    <a href="/events/alpha-night?x=1#y"><h4>Alpha again</h4> 5 events</a><a href="/events/omega-night"><img></a>""" + "y" * 2600 + "<h2>Omega</h2>" + "<h2>Behind</h2>"
    df = spark.createDataFrame([(1, "https://h.org/list/", html), (2, "https://h.org/", ""), (3, "https://h.org/", None), (4, "https://h.org/", '<a href="/events/lone-night"></a>' + "z" * 2800 + "<h1>Too far</h1>")], "page_id long, url string, html string")
    got = [(r["page_id"], r["url"].split("/")[-1], r["title"]) for r in pages.card_titles(df).orderBy("page_id", "place").collect()]
    assert got == [(1, "alpha-night", "Alpha & co"), (1, "beta-night", "Beta night"), (1, "gamma-night", "Gamma night"), (1, "epsilon-night", "Epsilon night it is"), (1, "alpha-night?x=1#y", "Alpha again"), (1, "omega-night", "Omega")]


def test_trailing_credits_only(spark):
    html = "<h1>T</h1><p>One</p><p>Foto: somebody</p><p>Two</p><p>Foto: other</p><p>Photo © x</p>"
    assert pages.article(spark.createDataFrame([(1, html)], "page_id long, html string")).first()["body"] == "One\n\nFoto: somebody\n\nTwo"


def test_upsert_cleans_controls(spark):
    batch = spark.createDataFrame([("h", "s", "a\x00b\x85", "c\td\ufffe")], "item_hash string, source_key string, title string, text string").withColumn("seen", F.current_timestamp())
    none = batch.limit(0).selectExpr("item_hash", "source_key", "title", "text", "seen AS first_seen", "seen AS last_seen", "'' AS status")
    assert tuple(pages.upserted(none, batch).select("title", "text").first()) == ("ab", "c\td")


def test_venue_split(spark):
    heads = spark.createDataFrame([(1, "Roig Arena"), (2, "Big Auditorio Roig Arena"), (3, "Auditorio"), (4, "x Roig Arenas"), (5, None), (6, "Show Roig Arena"), (7, "Show Roig Arena")], "id long, head string")
    known = spark.createDataFrame([("Roig Arena",), ("Auditorio  Roig Arena",), ("Roig Arena",), (None,), ("",)], "venue string")
    got = {r["id"]: (r["venue"], r["rest"]) for r in venue_listings.venue_split(heads, known, True).collect()}
    assert got == {1: ("Roig Arena", "Roig Arena"), 2: ("Auditorio Roig Arena", "Big"), 3: (None, "Auditorio"), 4: (None, "x Roig Arenas"), 5: (None, None), 6: ("Roig Arena", "Show"), 7: ("Roig Arena", "Show")}
    assert {r["venue"] for r in venue_listings.venue_split(heads, known.limit(0), False).collect()} == {None}
    first = venue_listings.venue_split(heads, spark.createDataFrame([("Big",), ("Big Auditorio",)], "venue string"), False).where("id = 2").first()
    assert (first["venue"], first["rest"]) == ("Big Auditorio", "Roig Arena")


def test_blocks_of_a_page(spark):
    body = "\n".join(["Menú", "EXPOSICIONES", "GRAN MUESTRA DE ARTE", "Permanente", ": 01/02/2026", "– 03/02/2026", "Recinto:", "Museu", "Una frase bastante larga sobre la muestra", "Ver más", "Otra frase que ya no cuenta aquí",
        "GOLDEN TICKET", "1 Mar 2026", "ACTO DE UN DÍA", "5 Abr. 2026", "5 Abr 2026", "SIN FECHA ALGUNA", "texto", "GRAN MUESTRA DE ARTE", "1/2/26"])
    rows = [item(1, body="VIEJA PÁGINA\n1/1/2026", kind="page_snapshot"), item(2, body=body, kind="page_snapshot"), item(3, "Gran muestra de arte", url="https://c.es/a"), item(4, body=None, kind="page_snapshot", source="other")]
    got = venue_listings.block_cards(items(spark, rows)).orderBy("start_date").collect()
    assert [(r["title"], r["start_date"], r["end_date"], r["category"], r["venue_name"], r["url"]) for r in got] == [
        ("GRAN MUESTRA DE ARTE", "2026-02-01", "2026-02-03", "выставка", "Museu", "https://c.es/a"), ("ACTO DE UN DÍA", "2026-04-05", None, "culture", "Ciutat de les Arts i les Ciències", None),
    ]


def test_post_titles(spark):
    df = spark.createDataFrame([(1, "21 червня — Concierto en La Nau", None), (2, None, "Fallback"), (3, "Валенсія 🚩 У нас для Вас просто космічні новини 🪐 26 червня спецпоказ фільму", None), (4, "У нас для вас все 🎉 x", None), (5, "🎈🎈", "x"), (6, "a\n b", None)], "id long, t string, o string")
    got = {r["id"]: r["x"] for r in df.select("id", posts.post_title(F.col("t"), F.col("o")).alias("x")).collect()}
    assert got == {1: "Concierto en La Nau", 2: "Fallback", 3: "26 червня спецпоказ фільму", 4: "У нас для вас все 🎉 x", 5: None, 6: "a b"}


def test_every_module_of_the_registry_reads_its_items(spark):
    """All registered sources at once, with items that are empty in every way."""
    rows = [item(i, None, None, s, k) for i, (s, k) in enumerate((s, k) for s in shapes.SHAPES for k in ("link_card", "page_snapshot"))]
    assert shapes.drafts(items(spark, rows), list(shapes.SHAPES)).count() == 0 and len(shapes.SHAPES) == 22
    name = "Visit Valencia"
    header = [item(1, f"{name} 21°", None, "web:visitvalencia", url="https://v.com/events-valencia/x"), item(2, "Jazz 1/7/2026", None, "web:visitvalencia", url="https://v.com/events-valencia/y")]
    assert [r["title"] for r in shapes.shaped(items(spark, header), "web:visitvalencia").collect()] == ["Jazz 1/7/2026"]


def test_schedules_of_odd_answers(spark):
    bodies = ["[]", None, "", "{", '"x"', "[1, null, [], {}]", '[{"nombre": 5, "horasdeinicio": [[1], {"a": 1}, "9:00"], "idcontenido": 0, "descripcion": {"a": 1}}]']
    df = spark.createDataFrame([("s", "2026-01-0%d" % (i + 1), b) for i, b in enumerate(bodies)], "source_key string, day string, body string")
    got = [(r["day"], r["place"], r["show"], r["times"], r["external_id"], r["poster_url"]) for r in schedules.schedule_items(df).orderBy("day", "place").collect()]
    assert got[0] == ("2026-01-06", 3, "Hemisfèric session", [], "2026-01-06::Hemisfèric session", None) and got[1][:3] == ("2026-01-07", 0, "5") and got[1][4:] == ("2026-01-07:0:5", None) and len(got) == 2


def test_export_is_ordered_and_read_back(spark, tmp_path):
    rows = [(i if i % 10 else None, f"n{i}", {"a": i}) for i in range(500)] + [(7, "same", None)] * 200
    df = spark.createDataFrame(rows, "id long, name string, more map<string,long>").repartition(6)
    schema = T.StructType([*df.schema.fields[:2], T.StructField("late", T.DoubleType()), T.StructField("secret", T.StringType()), df.schema["more"]])
    stated = export.export(df, schema, str(tmp_path / "x"), leave_out=["secret"], parts=5).orderBy("part").collect()
    assert sum(r["n"] for r in stated) == 700 and len(stated) == 5 and max(r["n"] for r in stated) < 300
    lines = [line for r in stated for f in sorted((tmp_path / "x/data" / f"part={r['part']}").glob("part-*")) for line in f.read_text().splitlines()]
    import json

    ids = [json.loads(x)["id"] for x in lines]
    assert [i is not None for i in ids] == sorted(i is not None for i in ids) and [i for i in ids if i is not None] == sorted(i for i in ids if i is not None) and set(json.loads(lines[0])) == {"id", "name", "late", "more"}
    back = export.read_back(spark, str(tmp_path / "x"), schema, ["secret"])
    assert back.columns == ["id", "name", "late", "more"] and sorted(map(repr, back.select("id", "name", "more").collect())) == sorted(map(repr, df.collect()))
    with pytest.raises(Exception, match="exist"):
        export.export(df, schema, str(tmp_path / "x"))
    next((tmp_path / "x/data" / "part=2").glob("part-*")).unlink()
    with pytest.raises(ValueError, match="2"):
        export.read_back(spark, str(tmp_path / "x"), schema, ["secret"])
    export.export(df.limit(0), schema, str(tmp_path / "y"))
    assert export.read_back(spark, str(tmp_path / "y"), schema).count() == 0


def test_golden_cases(spark):
    golden = [("a", "p", '{"venue_name": "La Rambleta", "links_json": "[\\"https://x\\", {\\"url\\": \\"https://y\\"}]"}'), ("b", "p", '{"confidence": 0.8}'), ("c", "q", "{}"), ("d", "q", '{"start_date": "2026-01-01", "links": [{"url": "https://x"}, {"url": "https://x"}]}')]
    said = [("a", '{"venue_name": "la rambletta", "links": [{"url": "https://y"}, {"url": "https://x"}]}'), ("b", '{"confidence": "0.79995"}'), ("d", '{"when": "2026-01-01", "links_json": ["https://z"]}')]
    j = places.judged(spark.createDataFrame(said, "case string, json string"), spark.createDataFrame(golden, "case string, path string, json string"))
    assert {(r["case"], r["criterion"]): r["passed"] for r in j.collect()} == {("a", "venue_name"): True, ("a", "links"): True, ("b", "confidence"): True, ("d", "start_date"): True, ("d", "links"): False}
    assert {(r["path"], r["criterion"]): (r["cases"], r["passed"], r["met"], r["of"]) for r in places.verdicts(j).collect()} == {
        ("p", "venue_name"): (2, 2, 1, 1), ("p", "links"): (2, 2, 1, 1), ("p", "confidence"): (2, 2, 1, 1), ("q", "start_date"): (1, 0, 1, 1), ("q", "links"): (1, 0, 0, 1),
    }


def test_noisy_answers_of_models(spark):
    df = spark.createDataFrame([(1, 'Sure! ```{"venue_name": "Hall", "citations": [{"url": "https://a"}], "confidence": 0.9}``` done')], "id long, j string")
    assert df.select(places.validated(F.col("j"))["venue_name"]).first()[0] == "Hall"


def test_meta_descriptions(spark):
    df = spark.createDataFrame([("short  one",), ("word " * 50,), ("x" * 200,), ("a, " * 80,), ("  ",), (None,)], "t string")
    got = [r[0] for r in df.select(text.meta_description(F.col("t"))).collect()]
    assert got == ["short one", ("word " * 31) + "word…", "x" * 160 + "…", ("a, " * 53)[:-2] + "…", None, None]


def rows_of(df):
    """Rows that the joins of a plan put out, by running it."""
    df.collect()
    plan, n = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if "Join" in name and p.metrics().contains("numOutputRows"):
            n += p.metrics().get("numOutputRows").get().value()
        todo += [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else []
        c = p.children()
        todo += [c.apply(i) for i in range(c.size())]
    return n


def test_hot_keys_stay_linear(spark):
    """10,000 rows of one title, day and venue: repeats follow their class, so joins put out rows by the number of rows, not of pairs."""
    many = spark.range(10_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'Komissarenko stand-up gala' ELSE 'Komissarenko stand-up gala | VIP' END AS title", "'Valencia' AS city", "'2026-07-10' AS start_date", "CAST(NULL AS string) AS end_date",
        "'20:00' AS start_time", "'Hall' AS venue_name", "1 AS score", "'a' AS source", "'gold' AS source_weight", "CAST(NULL AS string) AS url", "CAST(NULL AS string) AS external_ref", "'u' AS source_url")
    keyed = resolution.keyed(many.unionByName(many.where("id < 2").withColumns({"id": F.col("id") + 20_000, "source": F.lit("b"), "title": F.lit("Gala of Komissarenko in the great hall")})))
    for step in (resolution.contained, resolution.tiers):
        found = step(keyed)
        assert rows_of(found) < 100_000
        assert {r["root"] for r in found.collect()} == {0} and found.count() == (10_002 if step is resolution.contained else 10_000)
    drafts = many.select("id", F.lit("s").alias("source_key"), "title")
    links = many.select(F.lit("s").alias("source_key"), F.col("id").alias("pos"), "title", F.concat(F.lit("u"), "id").alias("url"))
    got = normalize.linked(drafts, links)
    assert rows_of(got) < 100_000 and {r["url"] for r in got.collect()} == {"u0", "u1"}
    spots = many.select("id", F.lit("Bar").alias("name"), F.lit("x").alias("area"), F.lit("bar").alias("category"), F.lit(39.0).alias("lat"), F.lit(0.0).alias("lng"), F.lit("address").alias("geo_source"), F.lit("https://maps/1").alias("maps_url"), F.lit(None).cast("string").alias("external_ref"), F.concat(F.lit("s"), "id").alias("source"))
    star = places.links(spots.withColumn("area", F.concat(F.lit("x"), "id")))
    assert rows_of(star) < 100_000 and star.count() == 9_999


def test_names_of_sources_and_pins_of_gates(spark):
    df = spark.createDataFrame([("Eventbrite 1.2k views",), ("Eventbrite gala",)], "t string")
    assert [r[0] for r in df.select(gates.is_junk(F.col("t"), F.lit(None), F.lit("Eventbrite"))).collect()] == [True, False]
