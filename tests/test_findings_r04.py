"""What the fourth round's findings were about, on small rows."""

import pytest
from pyspark.sql import functions as F

from gatherline.functions import text
from gatherline.operators import classes, gates, listings, normalize, proximity, resolution
from gatherline.operators.graph import components
from gatherline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("part", [3, 1000])
def test_classes_are_paired_to_all_pairs_once(spark, monkeypatch, part):
    monkeypatch.setattr(classes, "PART", part)
    of = {i: i % 4 for i in range(40)}
    members = spark.createDataFrame([(k, i, 10) for i, k in of.items()], "key long, id long, n long")
    pairs = spark.createDataFrame([(0, 0), (1, 0), (2, 3), (9, 1)], "x long, y long")
    tied = {(0, 0), (0, 1), (1, 0), (2, 3), (3, 2)}
    want = [(a, b) for a in of for b in of if a < b and (of[a], of[b]) in tied]
    assert sorted(tuple(r) for r in classes.paired(pairs, members).collect()) == want


def test_pins_of_one_point_are_all_paired(spark):
    df = spark.range(300).selectExpr("id", "CASE WHEN id % 9 = 0 THEN NULL ELSE 10.0D + (id % 8) * 0.0004D END AS lat", "CASE WHEN id % 2 = 0 THEN 20.0D ELSE 20.0D + (id % 3) * 0.0006D END AS lng")
    want = sorted((r["a"], r["b"]) for r in proximity.near_pairs(df, 100).collect())
    assert sorted(tuple(r) for r in proximity.all_near(df, 100).collect()) == want and len(want) > 1000
    found = registry.queries()["near_pins"](spark, SF)
    pins = spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey % 5 = 0").groupBy("c_nationkey").count()
    assert found.columns == ["a", "b"] and found.where("a % 5 = 0 AND b % 5 = 0").count() == pins.select(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]


def test_name_variants_are_made_of_parts_of_classes(spark, monkeypatch):
    monkeypatch.setattr(classes, "PART", 5)
    names = ["kafemar", "kafemarina", "marina", "bar", "barrio", "bar", ""]
    df = spark.createDataFrame([(i, [k for k in {names[i % 7], names[i % 5]} if k]) for i in range(60)], "id long, keys array<string>")
    keys = {r["id"]: r["keys"] for r in df.collect()}
    meet = lambda a, b: any(x == y or (len(y) >= 6 and y in x) or (len(x) >= 6 and x in y) for x in keys[a] for y in keys[b])
    found = gates.name_variants(df)
    want = [(a, b) for a in keys for b in keys if a < b and meet(a, b)]
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 300
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert "[x#" in joins[0] and "p#" in joins[0] and "q#" in joins[0]  # the pairs are made in the last join, of parts


def events(spark, n):
    titles = ["Granada flamenco", "Flamenco Granada noche", "Luna roja", "Luna", "Roja luna azul", "Gala show", "Noche azul", None]
    rows = [(i, titles[i % 8], [None, "Alicante", "alicante!"][i // 8 % 3], f"2024-03-{1 + i % 6:02d}" if i % 8 else None, f"s{i % 3}" if i % 11 else "") for i in range(n)]
    return spark.createDataFrame(rows, "id long, title string, city string, start_date string, source string").selectExpr("*", "'' AS url", "'' AS external_ref", "'' AS source_weight", "0 AS score")


def test_containment_compares_titles_once_a_class_and_pairs_all_rows(spark, monkeypatch):
    monkeypatch.setattr(classes, "PART", 3)
    keyed = resolution.keyed(events(spark, 240))
    e, f = keyed.alias("e"), keyed.alias("f")
    brute = e.join(f, F.expr("e.city_key = f.city_key AND e.id < f.id AND e.source <> f.source AND e.source <> '' AND f.source <> '' AND abs(date_diff(e.day, f.day)) <= 3")).where(resolution.related(F.col("e.words"), F.col("f.words")))
    want = sorted(tuple(r) for r in brute.select("e.id", "f.id").collect())
    assert sorted(tuple(r) for r in resolution.containment_pairs(keyed).collect()) == want and len(want) > 1000
    tied = components(brute.select(F.col("e.id").alias("a"), F.col("f.id").alias("b")))
    ends = lambda df: sorted((r["id"], r["root"]) for r in df.collect())
    assert ends(resolution.containment_components(keyed)) == ends(tied)
    twice = keyed.unionByName(resolution.keyed(events(spark, 240).withColumn("source", F.lit("s1"))))  # ids in two classes
    assert ends(resolution.containment_components(twice)) == ends(components(resolution.containment_pairs(twice)))
    more = resolution.alike(resolution.keyed(events(spark, 8 * 3 * 3 * 11 * 2)))[1].count()
    assert more == resolution.alike(resolution.keyed(events(spark, 8 * 3 * 3 * 11 * 4)))[1].count() > 0  # copies are not compared again


def test_lines_know_their_neighbours_without_a_sort(spark):
    df = spark.createDataFrame([(1, "s", "a\n\n b \nc"), (2, "s", "d"), (3, "s", None)], "id long, source_key string, text string").selectExpr("*", "date'2024-01-01' AS seen", "'u' AS url")
    found = listings.lined(df, 1, 2)
    got = sorted((r["id"], r["pos"], r["p1"], r["line"], r["n1"], r["n2"]) for r in found.collect())
    assert got == [(1, 0, None, "a", "b", "c"), (1, 1, "a", "b", "c", None), (1, 2, "b", "c", None, None), (2, 0, None, "d", None, None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_drafts_that_meet_links_are_worked_out_once(spark):
    titles = ["Concierto de Ana", "Concierto de Ana y Luis", "Gran noche de jazz", "Noche gran de jazz 5", "Gala", "", None]
    drafts = spark.createDataFrame([(i, f"s{i % 2}", t) for i, t in enumerate(titles * 2)], "id long, source_key string, title string").withColumn("mark", F.sha1("source_key"))
    links = spark.createDataFrame([("s0", 1, "Gran noche de jazz", "a"), ("s1", 2, "concierto de ana!", "b"), ("s0", 3, "Ana: concierto de", "c"), ("s1", 4, "Gala", "d"), ("s1", 5, "gala", "e")], "source_key string, pos long, title string, url string")
    found = normalize.linked(drafts, links)
    assert found.columns == [*drafts.columns, "url"] and found.count() == len(titles) * 2
    want = {0: "c", 1: "b", 2: "a", 3: None, 4: None, 5: None, 6: None, 7: "b", 8: "c", 9: None, 10: "a", 11: "d", 12: None, 13: None}
    assert {r["id"]: r["url"] for r in found.collect()} == want
    assert "sha1" not in found._jdf.queryExecution().executedPlan().toString()


def test_agenda_cards_are_read_once_and_join_their_ranges_once(spark):
    rows = [(1, "v", "page_snapshot", None, "Music\nConcert One\nSearch\nFrom 01/02/2024 to 05/02/2024\nConcert Two\nFrom\n03/02/2024\nto 03/02/2024\nConcert Three\n01/01/2024 - 31/12/2024", None)]
    rows += [(2, "v", "link_card", "Concert One", None, "https://v.com/en/events-valencia/one"), (3, "v", "link_card", "Concert Two", None, "https://v.com/en/events-valencia/two"), (4, "v", "link_card", "Concert Three", "On 2024-03-09", "https://v.com/en/events-valencia/three")]
    rows += [(5, "v", "link_card", "Concert Four 07/02/2024 - 09/02/2024", None, "https://v.com/en/events-valencia/four")]
    items = spark.createDataFrame(rows, "id long, source_key string, kind string, title string, text string, url string").withColumn("seen", F.expr("timestamp'2024-01-15'"))
    found = listings.agenda_cards(items)
    got = {r["id"]: (r["title"], r["start_date"], r["end_date"]) for r in found.collect()}
    assert got == {2: ("Concert One", "2024-02-01", "2024-02-05"), 3: ("Concert Two", "2024-02-03", None), 4: ("Concert Three", "2024-03-09", None), 5: ("Concert Four", "2024-02-07", "2024-02-09")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join LeftOuter") == 1


def test_normalized_titles_are_as_in_three_steps(spark):
    df = spark.createDataFrame([("  A «B»\t\n c--D!  é'x  Ёлка 5 ",), (" x",), ("!!",), ("",), (None,)], "t string")
    t = F.regexp_replace(text.fold(F.lower(text.empty(F.col("t")))), "[«»\"'“”‘’]", "")
    steps = F.trim(F.regexp_replace(F.regexp_replace(t, "[^0-9a-zа-я\\s]", " "), r"\s+", " "))
    assert all(r["a"] == r["b"] for r in df.select(text.norm_title(F.col("t")).alias("a"), steps.alias("b")).collect())
