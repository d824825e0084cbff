"""Posts in detail: accounts, engagement, images, streams, and what stands in for a viewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmark.operators.nested import objects_in, parsed_json, post_of

# Parts of addresses and contexts that name an avatar, not content.
AVATARS = "(?i)(avatar|profile[_-]?images?|user[_-]?icon|/emoji/)"
#: Tallest stream that is chosen.
MOST_HEIGHT = 1080


def _field(node: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(node, path, kind)


def accounts(content: DataFrame) -> DataFrame:
    """``content_id, name, handle``: the account of each post: first line of the name; the handle, else that of the profile address."""
    rows = post_of(content).select("content_id", *[_field(F.col("post"), f"$.account.{f}").alias(f) for f in ("name", "handle", "profile_url")])
    from_url = F.regexp_extract("profile_url", "(?:/u/|/user/|/@|/)([^/?#@]+)/?(?:[?#].*)?$", 1)
    handle = F.coalesce(F.when(F.col("handle") != "", F.col("handle")), F.when(from_url != "", from_url))
    return rows.select("content_id", F.trim(F.split("name", "\\n")[0]).alias("name"), handle.alias("handle")).where("name is not null or handle is not null").distinct()


def engagement(content: DataFrame) -> DataFrame:
    """``content_id, metric, value, approximate``: the counts of each post; hidden ones have no value."""
    rows = post_of(content).select("content_id", F.explode(_field(F.col("post"), "$.engagement", "map<string,variant>")).alias("metric", "m"))
    return rows.select("content_id", "metric", _field(F.col("m"), "$.value", "double").alias("value"), F.coalesce(_field(F.col("m"), "$.approximate", "boolean"), F.lit(False)).alias("approximate")).distinct()


def best_streams(content: DataFrame) -> DataFrame:
    """``content_id, url, bitrate``: each video of a post with the highest bitrate among its variants, null where it has none."""
    listed = F.coalesce(_field(F.col("post"), "$.videos", "array<variant>"), F.array(_field(F.col("post"), "$.videos", "variant")))
    rows = post_of(content).select("content_id", F.explode(listed).alias("v")).where("v is not null")
    url = F.when(F.schema_of_variant("v") == "STRING", _field(F.col("v"), "$")).otherwise(_field(F.col("v"), "$.url"))
    rates = F.transform(_field(F.col("v"), "$.variants", "array<variant>"), lambda x: _field(x, "$.bitrate", "long"))
    return rows.select("content_id", url.alias("url"), F.array_max(rates).alias("bitrate")).where("url <> ''").distinct()


def chosen_stream(streams: Column, most: int = MOST_HEIGHT) -> Column:
    """Of ``array<struct<url, codec, height, bitrate>>`` the tallest up to ``most``, by bitrate on ties; H.264 ahead of others;
    the smallest where all are taller."""
    order = lambda s: F.struct((F.coalesce(s["codec"], F.lit("")).rlike("(?i)avc|h264")).cast("int").alias("c"), s["height"].alias("h"), s["bitrate"].alias("b"), s.alias("s"))
    fits = F.filter(streams, lambda s: F.coalesce(s["height"], F.lit(0)) <= most)
    best = F.array_max(F.transform(fits, order))["s"]
    return F.coalesce(best, F.array_min(F.transform(streams, lambda s: F.struct(s["height"].alias("h"), s.alias("s"))))["s"])


def images(content: DataFrame) -> DataFrame:
    """``content_id, place, url``: images of each post in order, one per file name without its query, avatars left out."""
    listed = F.coalesce(_field(F.col("post"), "$.images", "array<variant>"), F.array(_field(F.col("post"), "$.images", "variant")))
    rows = post_of(content).select("content_id", F.posexplode(listed).alias("place", "v")).where("v is not null")
    rows = rows.select("content_id", "place", F.when(F.schema_of_variant("v") == "STRING", _field(F.col("v"), "$")).otherwise(_field(F.col("v"), "$.url")).alias("url")).where("url <> ''")
    key = F.regexp_extract("url", "([^/?#]+)(?:[?#].*)?$", 1)
    return rows.where(~F.col("url").rlike(AVATARS)).groupBy("content_id", key.alias("_key")).agg(F.min_by("url", "place").alias("url"), F.min("place").alias("place")).select("content_id", "place", "url")


def resolved_viewers(media: DataFrame, owner: str) -> DataFrame:
    """Viewers of media with the asset that was found for them: the first other entry with the same viewer address.

    ``media`` has ``owner, kind, url, viewer_url, place``; a viewer without an asset keeps a null ``asset_url``.
    """
    assets = media.where("kind <> 'media_viewer' and viewer_url is not null").groupBy(owner, "viewer_url").agg(F.min_by("url", "place").alias("asset_url"))
    return media.where("kind = 'media_viewer'").join(assets, [owner, "viewer_url"], "left")


def linked_media(links: DataFrame, media: DataFrame, owner: str) -> DataFrame:
    """Links of an article with the media of the same id."""
    return links.join(media, [owner, "media_id"], "left")


def inlined(html: Column, assets: Column) -> Column:
    """Markup with the addresses of ``assets`` (a map) replaced by what they stand for, longest first."""
    pairs = F.reverse(F.array_sort(F.transform(F.map_entries(assets), lambda e: F.struct(F.length(e["key"]).alias("n"), e["key"].alias("k"), e["value"].alias("v")))))
    return F.aggregate(F.coalesce(pairs, F.array().cast("array<struct<n:int,k:string,v:string>>")), html, lambda h, e: F.replace(h, e["k"], F.coalesce(e["v"], e["k"])))


def content_root(article: Column, body: Column, is_search: Column) -> Column:
    """Text that stands for a page: its article, or the whole body on a search page or where the article has less than half of it."""
    short = F.length(F.coalesce(article, F.lit(""))) * 2 < F.length(F.coalesce(body, F.lit("")))
    return F.when(F.coalesce(is_search, F.lit(False)) | short, body).otherwise(article)


def observed_media(responses: DataFrame, key: str, body: str, wanted: str) -> DataFrame:
    """``key, url, bitrate``: videos that network responses hold for the wanted id, at any depth of their JSON.

    An object counts if it has the id and a list of variants; of those the one with the highest bitrate is taken.
    """
    rows = responses.select(key, wanted, F.col(body).alias("_raw"), parsed_json(F.col(body)).alias("_tree")).where("_tree is not null")
    objects = rows.select(key, wanted, F.explode(objects_in(F.col("_tree"), F.col("_raw"))).alias("o"))
    variants = objects.where(_field(F.col("o"), "$.id") == F.col(wanted)).select(key, F.explode(_field(F.col("o"), "$.variants", "array<variant>")).alias("v"))
    found = variants.select(key, _field(F.col("v"), "$.url").alias("url"), _field(F.col("v"), "$.bitrate", "long").alias("bitrate")).where("url <> ''")
    return found.groupBy(key).agg(F.max_by("url", F.coalesce("bitrate", F.lit(0))).alias("url"), F.max("bitrate").alias("bitrate"))
