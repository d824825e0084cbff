"""Candidates of result pages, plans, routes, posts and reports."""

import base64
import json

from pyspark.sql import functions as F

from gleanmark.functions import url
from gleanmark.operators import media, nested, report, search, sites


def test_candidates(spark):
    target = base64.urlsafe_b64encode(b"https://www.site.test/item/9").decode().rstrip("=")
    links = [f"https://www.bing.com/ck/a?u=a1{target}", "https://site.test.evil.test/item/9", "https://www.site.test/login", "https://www.site.test/", "https://www.site.test/#/rank", "https://site.test/item/9", "https://www.site.test/item/9?utm_source=x", "https://www.site.test/search?q=1", "nothing", None]
    rows = spark.createDataFrame([("https://www.site.test/search?q=1", k, link) for k, link in enumerate(links)], "page string, place int, link string").withColumn("domains", F.array(F.lit("Site.test"), F.lit(None)))
    got = search.candidates(rows, "page", "link", "place", F.col("domains")).orderBy("place").collect()
    assert [(r.place, r.canonical) for r in got] == [(0, "https://www.site.test/item/9"), (4, "https://www.site.test/#/rank"), (5, "https://site.test/item/9")]
    outside = search.candidates(rows, "page", "link", "place", external=True).collect()
    assert {r.place for r in outside} == {0, 1, 4, 5}
    detail = search.candidates(rows, "page", "link", "place", F.col("domains"), F.lit("/ITEM/\\d+")).collect()
    assert {r.place for r in detail} == {0, 5}


def test_states_of_searches(spark):
    rows = spark.createDataFrame([("a", 3, 2, 2, False), ("b", 3, 2, 1, False), ("c", 0, 0, 0, True), ("d", None, 0, 0, None)], "id string, n int, want int, got int, waits boolean")
    assert {r.id: (r.search_status, r.status) for r in search.search_states(rows, "id", "n", "want", "got", "waits").collect()} == {
        "a": ("candidates_found", "completed"), "b": ("candidates_found", "partial"), "c": ("awaiting_user", "awaiting_user"), "d": ("no_verified_candidates", "partial"),
    }


def test_overlays(spark):
    base = spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "site_id string, name string, n int")
    custom = spark.createDataFrame([("b", None, 9), ("c", "C", None)], "site_id string, name string, n int")
    assert {tuple(r) for r in sites.overlay(base, custom).collect()} == {("a", "A", 1), ("b", None, 9), ("c", "C", None)}
    assert {tuple(r) for r in sites.overlay_settings(base, custom, "site_id").collect()} == {("a", "A", 1), ("b", "B", 9), ("c", "C", None)}


def test_posts(spark):
    post = {"id": 1, "account": {"name": "Ann\nmore", "handle": "", "profile_url": "https://s.example/u/ann?x=1"}, "engagement": {"likes": {"value": 3.0, "approximate": True}, "views": None}, "images": ["https://s.example/avatar/1.png", {"url": "https://s.example/i.png?w=1"}, {"url": "https://t.example/i.png?w=2"}, None], "videos": {"url": "v", "variants": [{"bitrate": 5}, {"bitrate": 9}, {}]}}
    df = spark.createDataFrame([(1, json.dumps(post)), (2, None), (3, "x"), (4, json.dumps({"post": {"id": 2}}))], "content_id long, post string")
    assert [tuple(r) for r in media.accounts(df).collect()] == [(1, "Ann", "ann")]
    assert {tuple(r) for r in media.engagement(df).collect()} == {(1, "likes", 3.0, True), (1, "views", None, False)}
    assert [tuple(r) for r in media.best_streams(df).collect()] == [(1, "v", 9)]
    assert [tuple(r) for r in media.images(df).collect()] == [(1, 1, "https://s.example/i.png?w=1")]


def test_streams_and_viewers(spark):
    streams = spark.createDataFrame([(1, [("a", "vp9", 1080, 5), ("b", "avc1", 720, 3), ("c", "avc1", 2160, 9)]), (2, [("d", "vp9", 2160, 1)]), (3, [])], "k int, s array<struct<url:string,codec:string,height:int,bitrate:int>>")
    assert {r.k: r.c and r.c.url for r in streams.select("k", media.chosen_stream(F.col("s")).alias("c")).collect()} == {1: "b", 2: "d", 3: None}
    rows = spark.createDataFrame([("o", "media_viewer", "view", "x", 0), ("o", "img", "first", "x", 1), ("o", "img", "second", "x", 2), ("o", "media_viewer", "lost", "y", 3)], "owner string, kind string, url string, viewer_url string, place int")
    assert {r.url: r.asset_url for r in media.resolved_viewers(rows, "owner").collect()} == {"view": "first", "lost": None}
    page = spark.range(1).select(media.inlined(F.lit("<img src='u/1'><img src='u/10'>"), F.create_map(F.lit("u/1"), F.lit("A"), F.lit("u/10"), F.lit("B"))).alias("h"))
    assert page.first().h == "<img src='A'><img src='B'>"


def test_walk_of_json(spark):
    raw = json.dumps({"a": [{"id": "x", "variants": [{"url": "low", "bitrate": 1}, {"url": "high", "bitrate": 7}]}, [[{"b": {}}]]]})
    df = spark.createDataFrame([(1, raw, "x"), (2, "broken", "x"), (3, None, "x")], "k int, body string, wanted string")
    objects = df.select("k", F.size(nested.objects_in(nested.parsed_json(F.col("body")), F.col("body"))).alias("n"))
    assert {r.k: r.n for r in objects.collect()}[1] == 6
    assert [tuple(r) for r in media.observed_media(df, "k", "body", "wanted").collect()] == [(1, "high", 7)]


def test_links(spark):
    rows = spark.createDataFrame([("a b/ü.html",)], "p string").select(url.file_link(F.col("p")).alias("l"))
    assert rows.first().l == "a%20b/%C3%BC.html"


def test_reports(spark):
    schema = "content_id long, title string, author string, canonical_url string, text string, items array<struct<kind:string,text:string>>, platform string"
    rows = [(k, "a<b", " x ", "https://e.org/?a=1&b=2", "body", [("page_shell", "no"), ("article", " one "), None, ("article", "one"), ("reply", "no")], "p") for k in range(5)] + [(9, None, None, "javascript:x", "only & body", None, "q")]
    df = spark.createDataFrame(rows, schema)
    sections = report.source_sections(df)
    got = {r.content_id: r.section for r in sections.collect()}
    assert got[0] == '<section><h2>a b</h2><a href="https://e.org/?a=1&amp;b=2">https://e.org/?a=1&amp;b=2</a><address>x</address><p>one</p><blockquote>no</blockquote></section>'
    assert got[9].endswith("<p>only &amp; body</p></section>") and "href" not in got[9]
    pages = report.report_pages(sections, df.select("content_id", "platform"), "platform", 2).collect()
    assert sorted((p.platform, p.page_no, p.n_sources) for p in pages) == [("p", 1, 2), ("p", 2, 2), ("p", 3, 1), ("q", 1, 1)]
    runs = spark.createDataFrame([("p", "a<b", 3)], "platform string, search_query string, found int")
    whole = {p.platform: p.document for p in report.report_pages(sections, df.select("content_id", "platform", "title"), "platform", 10, runs).collect()}
    assert whole["p"].startswith('<nav><a href="#source-1">1. a&lt;b</a>') and "<main><table><tr><td>a&lt;b</td><td>3</td></tr></table><section>" in whole["p"]
    assert whole["q"].startswith("<main><section>")


def test_small_helpers(spark):
    from gleanmark.operators import archive, merge

    paths = spark.createDataFrame([("a/b",), ("/a",), ("a/../b",), ("C:\\x",)], "p string").select("p", archive.is_inside(F.lit("root"), F.col("p")).alias("ok"))
    assert {r.p for r in paths.where("ok").collect()} == {"a/b"}
    results = spark.createDataFrame([("t", "awaiting_user", 0), ("u", "partial", 1)], "task string, status string, n int")
    audits = spark.createDataFrame([("t", "captured", 5), ("u", "awaiting_user", 9)], "task string, status string, n int")
    assert {tuple(r) for r in merge.refreshed(results, audits, "task").collect()} == {("t", "captured", 5), ("u", "partial", 1)}
    plan = spark.createDataFrame([("x", "a" * 64), ("y", "b" * 64)], "path string, sha string")
    assert [r.path for r in archive.still_valid(plan, spark.createDataFrame([("x", "A" * 64), ("y", "c" * 64)], "path string, sha string"), "path", "sha").collect()] == ["x"]
    images = spark.createDataFrame([("o", "i.png", "image"), ("o", "j.png", "image")], "owner string, name string, kind string")
    got = archive.with_downloads(images, spark.createDataFrame([("o", "i.png", "image", "raw/2"), ("o", "i.png", "image", "raw/1"), ("o", "j.png", "video", "raw/3")], "owner string, name string, kind string, file_path string"), "owner", "name")
    assert {r.name: r.file_path for r in got.collect()} == {"i.png": "raw/1", "j.png": None}
    items = spark.createDataFrame([(1, [("reply", "a"), ("article", "b"), None])], "k int, items array<struct<kind:string,text:string>>")
    assert [len(r.i) for r in items.select(merge.without_answers(F.col("items")).alias("i")).collect()] == [1]
