"""What a captured page yields: its items, transcripts, media of articles, streams of players, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmark.operators.nested import objects_in, parsed_json

#: Tallest stream of a player that is taken.
PLAYER_HEIGHT = 720


def body_kind(confirmed: Column, is_video: Column) -> Column:
    """Kind of the item that stands for the body: a shell unless it was confirmed, else a description on a site of videos."""
    return F.when(~F.coalesce(confirmed, F.lit(False)), "page_shell").when(F.coalesce(is_video, F.lit(False)), "video_description").otherwise("page_body")


def emitted_items(content: DataFrame, confirmed: Column, is_video: Column, is_search: Column) -> DataFrame:
    """``content_id, item_no, kind, text``: the body of a page as its first item, then its items with a text, in order.

    Search pages have no body of their own. Null entries and blank texts give none, null arrays no items.
    """
    blank = lambda t: F.coalesce(F.trim(t), F.lit("")) == ""
    one = lambda kind, text: F.struct(kind.alias("kind"), text.alias("text"))
    body = F.when(~F.coalesce(is_search, F.lit(False)) & ~blank(F.col("text")), F.array(one(body_kind(confirmed, is_video), F.col("text")))).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))
    listed = F.transform(F.filter(F.coalesce(F.col("items"), F.array().cast(dict(content.dtypes)["items"])), lambda i: i.isNotNull() & ~blank(i["text"])), lambda i: one(i["kind"], i["text"]))
    return content.select("content_id", F.posexplode(F.concat(body, listed)).alias("item_no", "item")).select("content_id", "item_no", "item.kind", "item.text")


def transcript_cues(rows: DataFrame, owner: str, cues: str) -> DataFrame:
    """``owner, cue_no, time, text`` of the cues (``array<struct<time, text>>``) that say something, numbered as they were."""
    return rows.select(owner, F.posexplode(cues).alias("cue_no", "cue")).where("trim(cue.text) <> ''").select(owner, "cue_no", "cue.time", "cue.text")


def article_media(responses: DataFrame, key: str, body: str, wanted: str, host: str) -> DataFrame:
    """``key, media_id, url``: images of the article of the wanted post in network responses, at any depth of their JSON.

    An object counts if its ``rest_id`` is the wanted one; of its article the media and the cover on ``host`` are taken, the
    cover last, so that it wins over an entry of the same id.
    """
    rows = responses.select(key, wanted, F.col(body).alias("_raw"), parsed_json(F.col(body)).alias("_tree")).where("_tree is not null")
    objects = rows.select(key, wanted, F.explode(objects_in(F.col("_tree"), F.col("_raw"))).alias("o"))
    article = "$.article.article_results.result"
    entries = F.coalesce(F.try_variant_get("o", f"{article}.media_entities", "array<variant>"), F.array().cast("array<variant>"))
    cover = F.filter(F.array(F.try_variant_get("o", f"{article}.cover_media", "variant")), lambda v: v.isNotNull())
    found = objects.where(F.try_variant_get("o", "$.rest_id", "string") == F.col(wanted)).select(key, F.posexplode(F.concat(entries, cover)).alias("_at", "m"))
    media = found.select(key, "_at", F.try_variant_get("m", "$.media_id", "string").alias("media_id"), F.try_variant_get("m", "$.media_info.original_img_url", "string").alias("url"))
    good = media.where(F.col("media_id").isNotNull() & F.startswith("url", F.lit(f"https://{host}/")))
    return good.groupBy(key, "media_id").agg(F.max_by("url", "_at").alias("url"))


def player_stream(streams: Column, hosts: str, codec: Column, most: int = PLAYER_HEIGHT) -> Column:
    """Of ``array<struct<urls, codec, height>>`` the tallest of the codec up to ``most``: ``struct<url, height>``, its first address
    on an official host (a pattern); null where there is none."""
    fits = F.filter(streams, lambda s: (s["codec"] == codec) & (s["height"] <= most))
    best = F.get(F.array_sort(fits, lambda a, b: F.coalesce(F.sign(b["height"] - a["height"]).cast("int"), F.lit(0))), F.lit(0))
    url = F.get(F.filter(best["urls"], lambda u: u.rlike(f"^https://{hosts}/")), F.lit(0))
    return F.when(url.isNotNull(), F.struct(url.alias("url"), best["height"].alias("height")))


def overridden_counts(shown: Column, state: Column) -> Column:
    """Counts by metric: those of the page's own state in place of the shown ones."""
    empty = F.create_map().cast("map<string,double>")
    kept = F.map_filter(F.coalesce(state, empty), lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(F.coalesce(shown, empty), lambda k, _: ~F.map_contains_key(kept, k)), kept)
