"""What the third round's findings were about, on small rows."""

from pyspark.sql import functions as F

from gatherline.functions import dates
from gatherline.operators import gates, normalize, operations, places, proximity, resolution
from gatherline.operators.graph import components
from gatherline.sources import pages


def test_a_number_behind_a_letter_is_no_year(spark):
    df = spark.createDataFrame([("Party n2024, 5 de marzo", "1998-02-01"), ("Jazz 2024, 5 de marzo", "1998-02-01")], "t string, seen string")
    day = F.col("seen").cast("date")
    none = F.lit(None).cast("string")
    got = df.select(dates.parse_date(F.col("t"), day).alias("a"), dates.anchored_date(F.col("t"), none, F.col("seen"), none).alias("b")).collect()
    assert [tuple(r) for r in got] == [("1998-03-05", "1998-03-05"), ("2024-03-05", "2024-03-05")]


def test_a_past_day_behind_a_numbered_name_is_of_the_year_of_the_post(spark):
    df = spark.createDataFrame([("Прошла экскурсия N2050 5 марта", "1998-06-01")], "t string, seen string")
    none = F.lit(None).cast("string")
    assert df.select(dates.anchored_date(F.col("t"), none, F.col("seen"), none).alias("d")).first()["d"] == "1998-03-05"


def test_gap_of_changes_at_one_time_and_its_third(spark):
    rows = [("a", 1, "2024-01-01 00:00:00", "ok", 1), ("a", 2, "2024-01-01 09:00:00", "ok", 1), ("a", 3, "2024-01-01 09:00:00", "ok", 1), ("b", 1, "2024-01-01 00:00:00", "ok", 1), ("b", 2, "2024-01-01 03:19:10", "ok", 1)]
    df = spark.createDataFrame(rows, "source_key string, run_id long, at string, status string, new_items long").withColumn("started_at", F.to_timestamp("at"))
    got = {r["source_key"]: (r["observed_gap"], r["poll"]) for r in operations.cadence(df, F.lit("web")).collect()}
    assert got == {"a": (0, 3600), "b": (11950, 3944)}  # 3943.5


def test_evaluation_looks_at_so_many_edits_only(spark):
    df = spark.createDataFrame([("p", "a" * 100, "a" * 85), ("p", "a" * 100, "a" * 84), ("p", "abc", "abd"), ("p", None, ""), ("p", "x" * 20, "x" * 18 + "yz")], "path string, predicted string, expected string")
    assert tuple(places.evaluated(df).first()) == ("p", 5, 3)


def test_components_of_a_long_chain(spark):
    n = 3000
    ids = [(i * 7919) % 100_003 for i in range(n)]  # neighbours in the chain are far apart in number
    df = spark.createDataFrame([*zip(ids[:-1], ids[1:], strict=True), (200_000, 200_001), (200_005, 200_005)], "a long, b long")
    got = {r["id"]: r["root"] for r in components(df).collect()}
    assert got == {**dict.fromkeys(ids, min(ids)), 200_000: 200_000, 200_001: 200_000, 200_005: 200_005}


def test_links_by_name_tie_what_all_pairs_tie(spark):
    df = spark.range(240).selectExpr("id", "element_at(array('cafe-uno', 'cafe-una', 'bar', ''), cast(pmod(hash(id), 4) + 1 AS int)) AS plain", "concat('b', id % 3) AS block", "CASE WHEN id % 7 > 0 THEN concat('s', id % 2 * (id % 3)) END AS source",
        "39.0 + (id % 11) * 0.0004 AS lat", "-0.4D AS lng", "CASE WHEN id % 4 < 2 THEN 'map_url' ELSE 'address' END AS geo_source", "'' AS link", "'' AS external_ref")
    tied = lambda edges: {(r["id"], r["root"]) for r in components(edges).collect()}
    assert tied(places.links_by_name(df)) == tied(places.alike_in_block(df)) != set()


def test_name_variants_come_once_and_meet_by_class(spark):
    df = spark.createDataFrame([(1, ["kafemar"]), (2, ["kafemar"]), (3, ["kafemarina", "marina"]), (4, ["marina"]), (5, ["bar"]), (6, ["bar"]), (7, ["barrio"]), (8, [])], "id long, keys array<string>")
    got = sorted(tuple(r) for r in gates.name_variants(df).collect())
    assert got == [(1, 2), (1, 3), (2, 3), (3, 4), (5, 6)]
    plan = gates.name_variants(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_place_pairs_compare_names_before_rows(spark, monkeypatch):
    monkeypatch.setattr(places, "DENSE", 7)  # so that keys are cut by salts
    df = spark.range(90).selectExpr("id", "concat(element_at(array('Cafe Mar', 'Cafe Mars', 'Bar', '!'), cast(pmod(hash(id), 4) + 1 AS int)), ' ', id % 3) AS name", "CASE WHEN id % 2 = 0 THEN 'a' END AS area", "'c' AS category", "39.0D + (id % 5) * 0.0004D AS lat", "-0.4D AS lng",
        "CASE WHEN id % 4 < 2 THEN 'map_url' END AS geo_source", "CASE WHEN id % 9 = 0 THEN 'http://m' ELSE ' ' END AS maps_url", "CASE WHEN id % 6 < 2 THEN 'r' END AS external_ref", "CASE WHEN id % 7 > 0 THEN concat('s', id % 2) END AS source")
    rows = {r["id"]: r for r in places.block(df).collect()}

    def one_place(a, b):
        pins = a["geo_source"] == b["geo_source"] == "map_url" and abs(a["lat"] - b["lat"]) < 0.0005  # some 44 m a step
        apart = None not in (a["source"], b["source"]) and a["source"] != b["source"]
        by_ref = a["external_ref"] == b["external_ref"] == "r" and a["source"] == b["source"] is not None
        by_name = a["block"] == b["block"] and places.jaro_winkler(a["plain"], b["plain"]) >= 0.9
        return a["maps_url"] == b["maps_url"] == "http://m" or by_ref or (by_name and (apart or pins or (a["geo_source"] == b["geo_source"] == "map_url" and round(abs(a["lat"] - b["lat"]) / 0.0004) == 2)))

    want = sorted((a, b) for a in rows for b in rows if a < b and one_place(rows[a], rows[b]))
    found = places.pairs(df)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == want and len(want) > 100
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()  # no row pair is compared by name
    twice = places.pairs(df.unionByName(df))
    assert sorted((r["a"], r["b"]) for r in twice.collect()) == want


def test_a_title_does_not_end_within_a_number_of_another(spark):
    drafts = spark.createDataFrame([(1, "s", "Выставка 65"), (2, "s", "Выставка 77"), (3, "s", "Concierto de Ana")], "id long, source_key string, title string")
    links = spark.createDataFrame([("s", 1, "Выставка 65500", "a"), ("s", 2, "Nueva: выставка 77", "b"), ("s", 3, "Выставка 177", "c"), ("s", 4, "Concierto de Ana 12", "d")], "source_key string, pos long, title string, url string")
    got = {r["id"]: r["url"] for r in normalize.linked(drafts, links).collect()}
    assert got == {1: None, 2: "b", 3: "d"}


def test_containment_pairs_come_once_without_a_last_shuffle(spark):
    titles = ["Granada flamenco", "Flamenco Granada noche", "Luna roja", "Luna", "Roja luna azul", "Gala show", "Noche azul"]
    rows = [(i, titles[i % 7], "Valencia" if i % 5 else "Alicante", f"2024-03-{1 + i % 9:02d}", f"s{i % 3}" if i % 11 else "") for i in range(80)]
    df = spark.createDataFrame(rows, "id long, title string, city string, start_date string, source string").selectExpr("*", "'' AS url", "'' AS external_ref", "'' AS source_weight", "0 AS score")
    keyed = resolution.keyed(df)
    e, f = keyed.alias("e"), keyed.alias("f")
    brute = e.join(f, F.expr("e.city_key = f.city_key AND e.id < f.id AND e.source <> f.source AND e.source <> '' AND f.source <> '' AND abs(date_diff(e.day, f.day)) <= 3")).where(resolution.related(F.col("e.words"), F.col("f.words")))
    want = sorted(tuple(r) for r in brute.select("e.id", "f.id").collect())
    found = resolution.containment_pairs(keyed)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "BroadcastHashJoin" not in plan
    assert sorted(tuple(r) for r in resolution.containment_pairs(keyed.unionByName(keyed)).collect()) == want


def test_passes_of_resolution_send_no_table_to_the_driver(spark):
    df = spark.createDataFrame([(1, "Luna", "s0", "u", "2024-03-01"), (2, "Luna", "s1", "u", "2024-03-01"), (3, "Sol", "s1", "v", "2024-03-02")], "id long, title string, source string, url string, start_date string")
    df = df.selectExpr("*", "'Valencia' AS city", "'' AS external_ref", "'gold' AS source_weight", "0 AS score", "'upcoming' AS status", "'' AS start_time", "'' AS venue_name")
    found = resolution.resolve(df)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, "self"), (2, 1, "strong"), (3, 3, "self")]
    for step in (resolution.strong(resolution.keyed(df)), resolution.fuzzy(resolution.keyed(df)), resolution.marked(df, found)):
        assert "BroadcastHashJoin" not in step._jdf.queryExecution().executedPlan().toString()


def test_bpe_merges_by_rank_as_pieces_joined_one_by_one():
    from gatherline.llm import bpe

    ranks = {bytes([i]): i for i in range(256)} | {w: 256 + i for i, w in enumerate([b"ab", b"bc", b"abc", b"cd", b"abcd", b"aa", b"aaa", b"\xd0\xb0"])}

    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    for word in (b"abcdabcaab", b"aaaaaaa", b"dcba", b"bcbcd", "абаа".encode(), b"xaby", b"a"):
        assert bpe.merged(word, ranks) == plain(word)


def test_pins_of_one_point_are_tied_to_one_of_them_and_lose_no_pair(spark):
    df = spark.range(400).selectExpr("id", "CASE WHEN id % 9 = 0 THEN NULL ELSE 10.0D + (id % 8) * 0.0004D END AS lat", "CASE WHEN id % 2 = 0 THEN 20.0D ELSE 20.0D + (id % 3) * 0.0006D END AS lng")
    rows = proximity.near_classes(df, 100).collect()
    of = {r["b"]: r["a"] for r in rows if r["same"]}
    members = {}
    for i in {r[c] for r in rows for c in ("a", "b")}:
        members.setdefault(of.get(i, i), set()).add(i)
    spread = [(a, b) for m in members.values() for a in m for b in m if a < b]
    spread += [(min(x, y), max(x, y)) for r in rows if not r["same"] for x in members[r["a"]] for y in members[r["b"]]]
    want = sorted((r["a"], r["b"]) for r in proximity.near_pairs(df, 100).collect())
    assert sorted(spread) == want and len(want) > 10 * len(rows)
    assert proximity.near_classes(spark.range(2000).selectExpr("id", "1.0D AS lat", "2.0D AS lng"), 100).count() == 1999


def test_pages_of_card_titles_are_dealt_over_a_number_of_tasks(spark):
    df = spark.range(200).selectExpr("id AS page_id", "'https://h.org/list/' AS url", "concat('<a href=\"/events/show-', id, '-abc\">Show number ', id, '</a>') AS html")
    found = pages.card_titles(df)
    assert found.count() == 200
    assert found.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism  # not put together by their packed size
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("html" not in line.split("[")[-1] for line in plan.splitlines() if "Window" in line or "Sort" in line)


def test_shapes_deal_rows_over_a_number_of_tasks(spark):
    from gatherline.functions import text

    assert text.spread(spark.range(10)).rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
