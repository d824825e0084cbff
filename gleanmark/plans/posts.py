"""Queries over posts: accounts, engagement, images, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark.functions import url
from gleanmark.operators import media, merge, report
from gleanmark.plans import archives, pages
from gleanmark.sources.tables import table


def _content(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "content").dropDuplicates(["content_id"])


def post_accounts(spark: SparkSession, folder: str) -> DataFrame:
    return media.accounts(_content(spark, folder))


def post_engagement(spark: SparkSession, folder: str) -> DataFrame:
    return media.engagement(_content(spark, folder))


def best_streams(spark: SparkSession, folder: str) -> DataFrame:
    return media.best_streams(_content(spark, folder))


def post_images(spark: SparkSession, folder: str) -> DataFrame:
    return media.images(_content(spark, folder))


def content_roots(spark: SparkSession, folder: str) -> DataFrame:
    """Length of the text that stands for each page: its items, or the whole text."""
    article = F.array_join(F.filter(F.transform("items", lambda i: i["text"]), lambda t: t.isNotNull()), "\n")
    return _content(spark, folder).select("content_id", F.length(media.content_root(article, F.col("text"), F.col("search_query") != "")).alias("n_chars"))


def public_alternates(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(_LINKS)], "case_no int, link string")
    return rows.select("case_no", url.public_alternate(F.col("link")).alias("alternate"))


_LINKS = ("https://jingxuan.douyin.com/m/video/123", "https://apps.weibo.com/12/aB3", "https://www.reddit.com/r/x/comments/1/", "https://www.reddit.com.evil.test/comments/1", "https://jingxuan.douyin.com/m/1")


def file_links(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "manifest").select("file_path").distinct().select("file_path", url.file_link(F.col("file_path")).alias("link"))


def observed_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Posts as if they were network responses: the best variant below any object with the id of the record."""
    rows = _content(spark, folder).select("content_id", F.concat(F.lit('{"data":[{"entry":{"id":"'), "content_id", F.lit('","variants":[{"url":"low","bitrate":1},{"url":"high","bitrate":'), F.col("content_id") + 1, F.lit("}]}}]}")).alias("body"), F.col("content_id").cast("string").alias("wanted"))
    return media.observed_media(rows, "content_id", "body", "wanted")


def capture_checks(spark: SparkSession, folder: str) -> DataFrame:
    rows = report.capture_checks(_content(spark, folder))
    return rows.select("content_id", F.array_join("limitations", "; ").alias("limitations"), "target_confirmed", "valid_content")


def last_redirects(spark: SparkSession, folder: str) -> DataFrame:
    """The last permanent redirect of each record."""
    rows = _content(spark, folder).select("content_id", merge.last_matching(F.col("url_check.redirects"), lambda r: r["code"] == 301).alias("r"))
    return rows.select("content_id", "r.hop", "r.url").where("url is not null")


def all_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Records and batch results as entries of one summary."""
    one = _content(spark, folder).select(F.col("resolved_url").alias("url"), "status", F.col("captured_at").alias("at"), "title")
    two = table(spark, folder, "batch_rows").dropDuplicates(["batch_file", "idx"]).select("url", "status", F.col("finished_at").alias("at"))
    return report.all_entries(one, two).groupBy("status").agg(F.count("*").alias("n"), F.count("title").alias("titled"), F.max("at").alias("newest"))


def collection_states(spark: SparkSession, folder: str) -> DataFrame:
    """Batches as collections, with the states of the downloads of their records."""
    rows = table(spark, folder, "batch_rows").dropDuplicates(["batch_file", "idx"])
    states = archives.media_downloads(spark, folder).select("content_id", F.col("download_status").alias("downloads"))
    return report.collection_states(rows.join(states, "content_id", "left"), "batch_file", "status", "downloads")


QUERIES = {f.__name__: f for f in (post_accounts, post_engagement, best_streams, post_images, content_roots, public_alternates, file_links, observed_streams, capture_checks, last_redirects, all_entries, collection_states)}

_ONCE = "(select distinct on (content_id) * from content order by content_id)"
_POSTS = f"""with j as (select content_id, case when json_type(p) = 'VARCHAR' then case when json_valid(p->>'$') then (p->>'$')::json end else p end as p from (select content_id, case when json_valid(post) then post::json end as p from {_ONCE})),
        posts as (select content_id, case when json_type(p->'post') = 'OBJECT' then (p->'post') else p end as p from j where json_type(p) = 'OBJECT')"""
_EACH = "unnest(case when json_type(p->'{k}') = 'ARRAY' then (p->'{k}')::json[] when json_type(p->'{k}') <> 'NULL' then [(p->'{k}')] else [] end)"
_LINK = "case when json_type(v) = 'VARCHAR' then (v->>'$') else (v->>'url') end"
SQL = {
    "post_accounts": _POSTS + """, a as (select content_id, (p->'account'->>'name') as name, (p->'account'->>'handle') as handle, (p->'account'->>'profile_url') as profile_url from posts)
        select distinct content_id, trim(split_part(name, chr(10), 1)) as name, coalesce(nullif(handle, ''), nullif(regexp_extract(profile_url, '(?:/u/|/user/|/@|/)([^/?#@]+)/?(?:[?#].*)?$', 1), '')) as handle from a where name is not null or coalesce(nullif(handle, ''), nullif(regexp_extract(profile_url, '(?:/u/|/user/|/@|/)([^/?#@]+)/?(?:[?#].*)?$', 1), '')) is not null""",
    "post_engagement": _POSTS + """, e as (select content_id, p, unnest(json_keys(p->'engagement')) as metric from posts where json_type(p->'engagement') = 'OBJECT')
        select distinct content_id, metric, json_extract(p, '$.engagement.' || metric || '.value')::double as value, coalesce(json_extract(p, '$.engagement.' || metric || '.approximate')::boolean, false) as approximate from e""",
    "best_streams": _POSTS + f""", v as (select content_id, {_EACH.format(k='videos')} as v from posts)
        select distinct content_id, url, bitrate from (select content_id, {_LINK} as url, list_max(list_transform(case when json_type(v->'variants') = 'ARRAY' then (v->'variants')::json[] end, lambda x: (x->>'bitrate')::bigint)) as bitrate from v) where url <> ''""",
    "post_images": _POSTS + f""", v as (select content_id, {_EACH.format(k='images')} as v, generate_subscripts(case when json_type(p->'images') = 'ARRAY' then (p->'images')::json[] when json_type(p->'images') <> 'NULL' then [(p->'images')] else [] end, 1) - 1 as place from posts),
        u as (select content_id, place, {_LINK} as url from v)
        select content_id, min(place)::int as place, arg_min(url, place) as url from u where url <> '' and not regexp_matches(url, '(?i)(avatar|profile[_-]?images?|user[_-]?icon|/emoji/)') group by content_id, regexp_extract(url, '([^/?#]+)(?:[?#].*)?$', 1)""",
    "content_roots": f"""with a as (select content_id, text, search_query, array_to_string(list_filter(list_transform(items, lambda i: i.text), lambda t: t is not null), chr(10)) as article from {_ONCE})
        select content_id, length(case when coalesce(search_query <> '', false) or length(coalesce(article, '')) * 2 < length(coalesce(text, '')) then text else article end)::int as n_chars from a""",
    "capture_checks": f"""with g as ({pages.SQL['page_gates']}), k as (select content_id, {pages.CANONICAL_SQL} as a from (select content_id, {pages.SANITIZED_SQL} as u from (select content_id, requested_url as u from {_ONCE}))),
        r as (select content_id, {pages.CANONICAL_SQL} as b from (select content_id, {pages.SANITIZED_SQL} as u from (select content_id, resolved_url as u from {_ONCE})))
        select c.content_id, array_to_string(list_filter([case when gate is not null then 'page restriction: ' || gate end, case when len(list_filter(items, lambda i: coalesce(i.truncated, false))) > 0 then 'some text is still folded' end,
          case when stop_reason = 'scroll_budget' then 'scroll budget reached, later content unconfirmed' end, case when not coalesce(completeness.target_present, false) then 'body not confirmed, the page shell is no evidence' end], lambda x: x is not null), '; ') as limitations,
          coalesce(a = b, false) as target_confirmed, gate is null and coalesce(completeness.target_present, false) and coalesce(length(text), 0) > 0 as valid_content
        from {_ONCE} c left join g on g.content_id = c.content_id join k on k.content_id = c.content_id join r on r.content_id = c.content_id""",
    "last_redirects": f"select content_id, r.hop as hop, r.url as url from (select content_id, list_filter(url_check.redirects, lambda r: r.code = 301)[-1] as r from {_ONCE}) where r.url is not null",
    "all_entries": f"""select status, count(*) as n, count(title) as titled, max(t) as newest from (select status, title, captured_at as t from {_ONCE} union all select status, null, finished_at from (select distinct on (batch_file, idx) * from batch_rows order by batch_file, idx)) group by 1""",
    "collection_states": f"""with d as ({archives.SQL['media_downloads']}) select batch_file, case when bool_and(coalesce(lower(trim(status)) in ('captured', 'completed'), false) and coalesce(download_status in ('downloaded', 'no_media'), true)) then 'completed' else 'partial' end as status
        from (select distinct on (batch_file, idx) * from batch_rows order by batch_file, idx) b left join d on d.content_id = b.content_id group by 1""",
    "public_alternates": "select * from (values (0, 'https://www.douyin.com/video/123'), (1, 'https://weibo.com/12/aB3'), (2, 'https://old.reddit.com/r/x/comments/1/'), (3, null), (4, null)) v(case_no, alternate)",
    "file_links": "select distinct file_path, array_to_string(list_transform(string_split(file_path, '/'), lambda p: url_encode(p)), '/') as link from manifest",
    "observed_streams": f"select content_id, case when content_id + 1 > 1 then 'high' else 'low' end as url, greatest(content_id + 1, 1) as bitrate from {_ONCE}",
}
