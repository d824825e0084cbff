"""Nested capture records into related flat tables.

One projection per target table: nested ``transform`` calls attach the keys of the ancestors, ``flatten``
joins the arrays and one ``inline`` emits rows. JSON columns are read as VARIANT, so optional keys, other
layouts and numbers where strings are usual need no schema. Comments nest to any depth: a fold over the
frontier of open comments runs as often as the text has keys that can hold answers, which bounds the depth.
There is no join, no shuffle but the final ``distinct`` and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys under which a comment keeps its answers, and a list of comments its entries.
ANSWER_KEYS = ("replies", "thread", "children")
LIST_KEYS = ("items", "loaded")
ROW = "struct<entity:string,child_id:string,parent_id:string>"
NODE = "struct<parent:string,id:string,node:variant>"


def parsed_json(text: Column) -> Column:
    """VARIANT of a JSON text, also of one that was encoded twice; null where it isn't valid JSON."""
    once = F.try_parse_json(F.when(F.trim(text) != "", text))
    return F.when(F.schema_of_variant(once) == "STRING", F.try_parse_json(F.try_variant_get(once, "$", "string"))).otherwise(once)


def _text(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "string")


def _filled(value: Column) -> Column:
    """``value``, or null where it is an empty string."""
    return F.when(value != "", value)


def entries(value: Column) -> Column:
    """``array<struct<id, node>>`` of a list of comments: an array, an object that wraps one, or a map by id."""
    as_array = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), *[F.try_variant_get(value, f"$.{k}", "array<variant>") for k in LIST_KEYS])
    as_map = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    listed = F.transform(as_array, lambda v: F.struct(_filled(_text(v, "$.id")).alias("id"), v.alias("node")))
    keyed = F.transform(as_map, lambda e: F.struct(F.coalesce(_filled(_text(e["value"], "$.id")), e["key"]).alias("id"), e["value"].alias("node")))
    is_comment = lambda e: e["id"].isNotNull() & F.schema_of_variant(e["node"]).startswith("OBJECT")
    return F.filter(F.coalesce(listed, keyed, F.array().cast("array<struct<id:string,node:variant>>")), is_comment)


def _answers(node: Column) -> Column:
    return entries(F.coalesce(*[F.try_variant_get(node, f"$.{k}", "variant") for k in ANSWER_KEYS]))


def comment_nodes(tree: Column, raw: Column, record: Column) -> Column:
    """``array<struct<parent, id, node>>`` of the comments at any depth of ``tree``, parsed from ``raw``."""
    at = lambda parent: lambda e: F.struct(parent.alias("parent"), e["id"].alias("id"), e["node"].alias("node"))
    first = F.transform(entries(tree), at(record))
    deeper = lambda nodes: F.flatten(F.transform(nodes, lambda n: F.transform(_answers(n["node"]), at(n["id"]))))
    bound = F.regexp_count(raw, F.lit('"(' + "|".join(ANSWER_KEYS) + r')"\s*:'))
    start = F.struct(first.alias("open"), F.array().cast(f"array<{NODE}>").alias("done"))

    def step(state: Column, _: Column) -> Column:
        return F.when(
            F.size(state["open"]) > 0,
            F.struct(deeper(state["open"]).alias("open"), F.concat(state["done"], state["open"]).alias("done")),
        ).otherwise(state)

    return F.aggregate(F.sequence(F.lit(0), bound), start, step, lambda s: F.concat(s["done"], s["open"]))


def _media(node: Column, key: str) -> Column:
    """URLs of ``node.key``: objects with a url, plain strings, or one object instead of an array."""
    value = F.try_variant_get(node, f"$.{key}", "variant")
    each = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.when(value.isNotNull(), F.array(value)))
    url = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(_text(v, "$.url"))
    return F.filter(F.transform(F.coalesce(each, F.array().cast("array<variant>")), url), lambda u: u.isNotNull() & (u != ""))


def _rows(entity: str, children: Column, parent: Column) -> Column:
    return F.transform(children, lambda c: F.struct(F.lit(entity).alias("entity"), c.alias("child_id"), parent.alias("parent_id")))


def _or_none(rows: Column) -> Column:
    return F.coalesce(rows, F.array().cast(f"array<{ROW}>"))


def comments_of(content: DataFrame, *keep: str) -> DataFrame:
    """One row per comment at any depth: ``content_id``, ``comment_id``, ``parent_id``, ``text``, ``node`` and the columns ``keep``.

    A record whose ``comments`` is null, blank or not valid JSON gives none.
    """
    tree = content.select("content_id", *keep, F.col("comments").alias("_raw"), parsed_json(F.col("comments")).alias("_tree")).where(F.col("_tree").isNotNull())
    nodes = comment_nodes(F.col("_tree"), F.col("_raw"), F.col("content_id").cast("string"))
    return tree.select("content_id", *keep, F.inline(nodes).alias("parent_id", "comment_id", "node")).select(
        "content_id", *keep, "comment_id", "parent_id", F.coalesce(_text(F.col("node"), "$.text"), _text(F.col("node"), "$.body")).alias("text"), "node"
    )


def flat_entities(content: DataFrame) -> DataFrame:
    """``content_id, entity, child_id, parent_id``: one row per nested object of the records.

    Nulls in any column, empty arrays, null entries, blank keys and JSON that isn't valid give no row;
    repeated entries and repeated records give one. Other columns of the input are ignored.
    """
    base = content.select("content_id", "items", "url_check", F.col("comments").alias("_raw"), parsed_json(F.col("comments")).alias("_tree"), parsed_json(F.col("post")).alias("_outer"))
    record = F.col("content_id").cast("string")
    wrapped = F.try_variant_get(F.col("_outer"), "$.post", "variant")
    inner = F.when(F.schema_of_variant(wrapped).startswith("OBJECT"), wrapped)
    base = base.withColumn("_post", F.coalesce(inner, F.col("_outer"))).withColumn("_comments", comment_nodes(F.col("_tree"), F.col("_raw"), record))
    post_id = _filled(_text(F.col("_post"), "$.id"))
    present = F.when(post_id.isNotNull(), F.array(post_id)).otherwise(F.array().cast("array<string>"))
    of_post = lambda entity, key: F.when(post_id.isNotNull(), _rows(entity, _media(F.col("_post"), key), post_id))
    item_id = lambda i: F.coalesce(_filled(i["id"]), _filled(i["url"]))
    kept = F.filter(F.col("items"), lambda i: i.isNotNull() & item_id(i).isNotNull())
    groups = [
        _rows("post", present, record),
        of_post("image", "images"),
        of_post("video", "videos"),
        F.transform(F.col("_comments"), lambda n: F.struct(F.lit("comment").alias("entity"), n["id"].alias("child_id"), n["parent"].alias("parent_id"))),
        F.flatten(F.transform(F.col("_comments"), lambda n: _rows("image", _media(n["node"], "images"), n["id"]))),
        _rows("item", F.transform(kept, item_id), record),
        F.flatten(F.transform(kept, lambda i: _or_none(_rows("media", F.filter(F.transform(i["media"], lambda m: m["url"]), lambda u: u.isNotNull() & (u != "")), item_id(i))))),
        _rows("redirect", F.filter(F.transform(F.col("url_check.redirects"), lambda r: r["url"]), lambda u: u.isNotNull() & (u != "")), record),
    ]
    rows = F.array_distinct(F.flatten(F.array(*map(_or_none, groups))))
    return base.where(F.col("content_id").isNotNull()).select("content_id", F.inline(rows)).distinct()


def _objects(node: Column, key: str, kind: str) -> Column:
    """``array<struct<url, place, detail>>`` of ``node.key`` in order; ``detail`` is a field of those that are objects."""
    value = F.try_variant_get(node, f"$.{key}", "variant")
    each = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.when(value.isNotNull(), F.array(value)), F.array().cast("array<variant>"))
    plain = lambda v: F.schema_of_variant(v) == "STRING"
    one = lambda v, k: F.struct(F.when(plain(v), F.try_variant_get(v, "$", "string")).otherwise(_text(v, "$.url")).alias("url"), k.alias("place"), F.when(~plain(v), F.try_variant_get(v, f"$.{kind}", "string")).alias("detail"))
    return F.filter(F.transform(each, one), lambda m: F.coalesce(m["url"], F.lit("")) != "")


def _trees(content: DataFrame) -> DataFrame:
    """``content_id, record, items, url_check, post, post_id, comments`` of the records, JSON parsed once."""
    base = content.where("content_id is not null").select("content_id", F.col("content_id").cast("string").alias("record"), "items", "url_check", F.col("comments").alias("_raw"), parsed_json(F.col("comments")).alias("_tree"), parsed_json(F.col("post")).alias("_outer"))
    wrapped = F.try_variant_get("_outer", "$.post", "variant")
    post = F.coalesce(F.when(F.schema_of_variant(wrapped).startswith("OBJECT"), wrapped), F.col("_outer"))
    rows = base.withColumn("post", post).withColumn("comments", comment_nodes(F.col("_tree"), F.col("_raw"), F.col("record")))
    return rows.withColumn("post_id", _filled(_text(F.col("post"), "$.id"))).select("content_id", "record", "items", "url_check", "post", "post_id", "comments")


def _item_id(i: Column) -> Column:
    return F.coalesce(_filled(i["id"]), _filled(i["url"]))


def posts_table(content: DataFrame) -> DataFrame:
    """``content_id, post_id, url, title, text, account``: the post of each record. As in all these tables, rows are distinct,
    nulls and blank keys give none, and a missing field is null."""
    t, p = _trees(content).where("post_id is not null"), F.col("post")
    return t.select("content_id", "post_id", *[_text(p, f"$.{c}").alias(c) for c in ("url", "title", "text")], _text(p, "$.account.name").alias("account")).distinct()


def images_table(content: DataFrame) -> DataFrame:
    """``content_id, parent_id, place, url, alt``: images of posts and of comments under the id of theirs, numbered from 0."""
    own = lambda parent, node: F.transform(_objects(node, "images", "alt"), lambda m: F.struct(parent.alias("parent_id"), m["place"].alias("place"), m["url"].alias("url"), m["detail"].alias("alt")))
    of_post = F.when(F.col("post_id").isNotNull(), own(F.col("post_id"), F.col("post")))
    of_comments = F.flatten(F.transform("comments", lambda n: own(n["id"], n["node"])))
    none = F.array().cast("array<struct<parent_id:string,place:int,url:string,alt:string>>")
    return _trees(content).select("content_id", F.inline(F.concat(F.coalesce(of_post, none), F.coalesce(of_comments, none)))).distinct()


def videos_table(content: DataFrame) -> DataFrame:
    """``content_id, parent_id, place, url, poster``: videos of posts."""
    rows = F.transform(_objects(F.col("post"), "videos", "poster"), lambda m: F.struct(F.col("post_id").alias("parent_id"), m["place"].alias("place"), m["url"].alias("url"), m["detail"].alias("poster")))
    return _trees(content).where("post_id is not null").select("content_id", F.inline(rows)).distinct()


def items_table(content: DataFrame) -> DataFrame:
    """``content_id, item_id, url, kind, author, time, text, truncated, metrics_text``: entries of ``items``."""
    kept = F.filter("items", lambda i: i.isNotNull() & _item_id(i).isNotNull())
    rows = F.transform(kept, lambda i: F.struct(_item_id(i).alias("item_id"), *[i[c].alias(c) for c in ("url", "kind", "author", "time", "text", "truncated", "metrics_text")]))
    return content.where("content_id is not null").select("content_id", F.inline(rows)).distinct()


def media_table(content: DataFrame) -> DataFrame:
    """``content_id, item_id, place, kind, url, alt, loaded``: media of items, numbered from 0 within theirs."""
    kept = F.filter("items", lambda i: i.isNotNull() & _item_id(i).isNotNull())
    own = lambda i: F.filter(F.transform(i["media"], lambda m, k: F.struct(_item_id(i).alias("item_id"), k.alias("place"), *[m[c].alias(c) for c in ("kind", "url", "alt", "loaded")])), lambda m: F.coalesce(m["url"], F.lit("")) != "")
    none = F.array().cast("array<struct<item_id:string,place:int,kind:string,url:string,alt:string,loaded:boolean>>")
    return content.where("content_id is not null").select("content_id", F.inline(F.flatten(F.transform(kept, lambda i: F.coalesce(own(i), none))))).distinct()


def comments_table(content: DataFrame) -> DataFrame:
    """``content_id, comment_id, parent_id, account, time, text``: comments at any depth."""
    one = lambda n: F.struct(n["id"].alias("comment_id"), n["parent"].alias("parent_id"), _text(n["node"], "$.account.name").alias("account"), _text(n["node"], "$.time").alias("time"), F.coalesce(_text(n["node"], "$.text"), _text(n["node"], "$.body")).alias("text"))
    return _trees(content).select("content_id", F.inline(F.transform("comments", one))).distinct()


def redirects_table(content: DataFrame) -> DataFrame:
    """``content_id, hop, url, code``: the redirects on the way to each record."""
    kept = F.filter(F.transform("url_check.redirects", lambda r: F.struct(r["hop"].alias("hop"), r["url"].alias("url"), r["code"].alias("code"))), lambda r: F.coalesce(r["url"], F.lit("")) != "")
    return content.where("content_id is not null").select("content_id", F.inline(kept)).distinct()


def objects_in(tree: Column, raw: Column) -> Column:
    """``array<variant>`` of all objects at any depth of a JSON value: the walk of a document without a schema.

    Each round opens one level; the number of brackets in the text bounds the depth, and an empty frontier ends the work.
    """
    empty = F.array().cast("array<variant>")
    inner = lambda v: F.concat(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), empty), F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), empty))
    start = F.struct(F.when(tree.isNotNull(), F.array(tree)).otherwise(empty).alias("open"), empty.alias("done"))

    def step(state: Column, _: Column) -> Column:
        opened = F.filter(F.flatten(F.transform(state["open"], inner)), lambda v: v.isNotNull())
        objects = F.filter(state["open"], lambda v: F.schema_of_variant(v).startswith("OBJECT"))
        return F.when(F.size(state["open"]) > 0, F.struct(opened.alias("open"), F.concat(state["done"], objects).alias("done"))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(0), F.coalesce(F.regexp_count(raw, F.lit(r"[\[{]")), F.lit(0)) + 1), start, step, lambda s: s["done"])


def post_of(content: DataFrame) -> DataFrame:
    """``content_id, post``: the post of each record as VARIANT, unwrapped; records without one are left out."""
    outer = parsed_json(F.col("post"))
    rows = content.where("content_id is not null").select("content_id", outer.alias("_o")).where("_o is not null")
    wrapped = F.try_variant_get(F.col("_o"), "$.post", "variant")
    post = F.coalesce(F.when(F.schema_of_variant(wrapped).startswith("OBJECT"), wrapped), F.col("_o"))
    return rows.select("content_id", post.alias("post")).where(F.schema_of_variant("post").startswith("OBJECT"))
