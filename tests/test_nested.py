"""Flat tables of nested records: layouts, depth and dirty values."""

import json

import pytest

from gleanmark.operators.nested import comments_of, flat_entities

SCHEMA = """content_id long, post string, comments string,
    items array<struct<id:string,url:string,kind:string,author:string,time:string,text:string,truncated:boolean,metrics_text:string,media:array<struct<kind:string,url:string,alt:string,loaded:boolean>>>>,
    url_check struct<requested:string,resolved:string,target_confirmed:boolean,valid_content:boolean,reason:string,redirects:array<struct<hop:int,url:string,code:int>>>, entity string, child_id string"""


def made(spark, *rows):
    full = [(*r, *[None] * (5 - len(r)), "clash", "clash") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def found(df):
    return {tuple(r) for r in flat_entities(df).collect()}


def test_layouts_of_comments(spark):
    deep = {"id": "a0", "text": "x"}
    for k in range(40):
        deep = {"id": f"a{k + 1}", "body": "y", ["replies", "thread", "children"][k % 3]: [deep, None] if k % 2 else {deep["id"]: {k2: v for k2, v in deep.items() if k2 != "id"}}}
    got = found(made(spark, (1, None, json.dumps({"items": [deep, deep, None, {"text": "no id"}], "count": 2})), (2, None, json.dumps({"loaded": [{"id": 7, "images": [{"url": "u"}, "v", None]}]})), (3, None, json.dumps({"c1": {"text": "t"}, "c2": None}))))
    assert {(1, "comment", "a40", "1"), (1, "comment", "a0", "a1"), (2, "comment", "7", "2"), (2, "image", "u", "7"), (2, "image", "v", "7"), (3, "comment", "c1", "3")} <= got
    assert len([g for g in got if g[0] == 1]) == 41 and len([g for g in got if g[0] == 3]) == 1


def test_posts_and_double_encoding(spark):
    post = {"id": 12, "images": {"url": "one"}, "videos": ["v", {"url": "w", "variants": []}]}
    rows = made(spark, (1, json.dumps(json.dumps(post)), ""), (2, json.dumps({"post": post}), "{broken"), (3, "not json", "null"), (4, json.dumps({"images": ["x"]}), None), (None, json.dumps(post), None))
    want = {(k, e, c, p) for k in (1, 2) for e, c, p in (("post", "12", str(k)), ("image", "one", "12"), ("video", "v", "12"), ("video", "w", "12"))}
    assert found(rows) == want


def test_items_media_redirects_and_repeats(spark):
    item = ("", "http://i", None, None, None, None, None, None, [("img", "m", None, None), None, ("img", None, None, None), ("img", "m", None, None)])
    check = (None, None, None, None, None, [(1, "r", 301), None, (2, "r", 302)])
    rows = made(spark, (5, None, None, [item, None, item], check), (5, None, None, [item], check), (6, None, None, [], None))
    assert found(rows) == {(5, "item", "http://i", "5"), (5, "media", "m", "http://i"), (5, "redirect", "r", "5")}


def test_empty_table(spark):
    assert found(made(spark, (1, None, None)).where("content_id = 2")) == set()


@pytest.mark.parametrize("text", [None, "", "  ", "[]", "{}", "3", '"x"'])
def test_comments_without_any(spark, text):
    assert comments_of(made(spark, (1, None, text))).count() == 0


def test_very_long_comment(spark):
    rows = made(spark, (1, None, json.dumps([{"id": "a", "text": "x" * 1_000_000}])))
    assert [len(r.text) for r in comments_of(rows).collect()] == [1_000_000]
