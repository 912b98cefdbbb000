from gatherline.sources import pages, publish

HTML = """<html><head><title> A &amp; B </title><meta property="og:image" content=" http://i/x.png "><meta name="robots" content="no"></head>
<a href="/events/summer-night-2026?x=1"><b>Summer night</b></a><a href="/about">About this fine page here</a><a href="https://other.org/some-long-slug">Elsewhere entirely, not ours</a>
<a href="/pic-of-night.jpg">A picture of the long night</a><a href="/about">about THIS fine page here</a></html>"""
CHAT = """<div class="message" data-post="c/1"><div class="text">Hi &lt;b&gt;<br>you</div><time datetime="2026-07-01T10:00:00"></time><img src="http://i/1.jpg"></div><div class="message" data-post="c/2"><div class="text"></div></div>"""


def frame(spark):
    return spark.createDataFrame([(1, "http://x.org/list/", HTML), (2, "http://t.org/s/c", CHAT), (3, None, None)], "page_id long, url string, html string")


def test_snapshots(spark):
    got = {r["page_id"]: r for r in pages.snapshots(frame(spark)).collect()}
    assert got[1]["title"] == "A & B" and got[1]["meta"] == {"og:image": "http://i/x.png"} and got[3]["text"] is None


def test_cards_and_details(spark):
    cards = [(r["url"], r["title"]) for r in pages.cards(frame(spark)).collect()]
    assert cards == [("http://x.org/about", "About this fine page here")]
    assert [tuple(r)[:3] for r in pages.detail_links(frame(spark)).collect()] == [(1, "http://x.org/events/summer-night-2026?x=1", "Summer night")] + [(1, "http://x.org/pic-of-night.jpg", "A picture of the long night")]


def test_posts(spark):
    got = [(r["ref"], r["text"], r["published_at"], r["media"]) for r in pages.posts(frame(spark)).collect()]
    assert got == [("c/1", "Hi <b>\nyou", "2026-07-01T10:00:00", ["http://i/1.jpg"]), ("c/2", "", None, [])]
    assert {r["page_id"] for r in pages.posts_or_cards(frame(spark)).collect()} == {1, 2}


def test_guards_stop_a_bad_bake(spark):
    import pytest

    e = spark.createDataFrame([(1, "api:hemisferic", None)], "id long, source string, start_date string")
    s, o = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1,), (2,)], "series_id long")
    report = publish.guards(e, s, o)
    assert report.first().asDict() == {"leaked": 1, "undated": 1, "series": 1, "orphans": 1, "ok": False}
    with pytest.raises(ValueError):
        publish.checked(report)
