"""Queries over archives, search history and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark.operators import archive, nested, ordered, report, search, sites
from gleanmark.plans import capture
from gleanmark.sources.tables import table


def _content(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "content").dropDuplicates(["content_id"])


def manifest_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the manifests against the files of the archives whose hash is known in the usual spelling."""
    rows = table(spark, folder, "manifest").select("content_id", "file_path", "sha256", "batch_no").distinct()
    return archive.verification(rows, rows.where("sha256 is not null"), "content_id", "file_path", "sha256")


def duplicate_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "manifest").select(F.concat_ws("/", "content_id", "file_path").alias("path"), "bytes", "sha256").distinct()
    return archive.duplicate_groups(rows, "sha256", "bytes", "path")


def duplicate_images(spark: SparkSession, folder: str) -> DataFrame:
    rows = archive.image_files(table(spark, folder, "manifest").select(F.concat_ws("/", "content_id", "file_path").alias("path"), "bytes", "sha256").distinct(), "path")
    return archive.duplicate_groups(rows, "sha256", "bytes", "path").agg(F.count("*").alias("n_groups"), F.sum("reclaimable").cast("long").alias("reclaimable"))


def retention_plan(spark: SparkSession, folder: str) -> DataFrame:
    return archive.prunable(table(spark, folder, "manifest"), _content(spark, folder))


def outer_folders(spark: SparkSession, folder: str) -> DataFrame:
    paths = table(spark, folder, "manifest").select(F.regexp_replace("file_path", "/[^/]+$", "").alias("path")).distinct()
    more = spark.createDataFrame([("a",), ("a/b",), ("a/b/c",), ("ab/c",), ("d/e",)], "path string")
    return archive.outermost(paths.unionByName(more), "path").distinct()


def media_downloads(spark: SparkSession, folder: str) -> DataFrame:
    """Media of items against the media files of the archives, by their file names."""
    entities = nested.flat_entities(table(spark, folder, "content")).where("entity = 'media'")
    wanted = entities.select("content_id", F.regexp_extract("child_id", "([^/]+)$", 1).alias("name"))
    got = table(spark, folder, "manifest").where("sha256 is not null").select("content_id", F.regexp_extract("file_path", "([^/]+)$", 1).alias("name"))
    return archive.download_states(wanted, got, "content_id", ["name"])


def ambiguous_addresses(spark: SparkSession, folder: str) -> DataFrame:
    return archive.ambiguous_archives(table(spark, folder, "manifest"), "canonical_url")


def keyword_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return search.keyword_ranking(table(spark, folder, "experience_log").distinct())


def newest_events(spark: SparkSession, folder: str) -> DataFrame:
    return search.recent_events(table(spark, folder, "experience_log"), "captured").select("event_id", "happened_at", "platform")


def preferred_routes(spark: SparkSession, folder: str) -> DataFrame:
    return search.preferred_routes(table(spark, folder, "experience_log"))


def search_routes(spark: SparkSession, folder: str) -> DataFrame:
    return search.routes(table(spark, folder, "sites"), search.preferred_routes(table(spark, folder, "experience_log")))


def verified_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return search.verified_corrections(table(spark, folder, "experience_log"))


def search_plan(spark: SparkSession, folder: str) -> DataFrame:
    return search.search_plan("the ferry", table(spark, folder, "sites"), table(spark, folder, "experience_log").distinct(), ["social"], ["murmel"])


def site_overlay(spark: SparkSession, folder: str) -> DataFrame:
    custom = spark.createDataFrame([("findry", "Findry two", "search"), ("mine", "My site", "custom")], "site_id string, site_name string, category string")
    return sites.overlay(table(spark, folder, "sites").select("site_id", "site_name", "category"), custom)


def policy_overlay(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "sites").select("site_id", F.lit(40).alias("most_requests"), F.lit(600).alias("window_s"))
    custom = spark.createDataFrame([("findry", 25, None), ("mine", None, 60)], "site_id string, most_requests int, window_s int")
    return sites.overlay_settings(base, custom, "site_id")


def resolved_names(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "sites").select(F.explode("aliases").alias("name")).where("name is not null").unionByName(table(spark, folder, "sites").select(F.upper("site_id").alias("name"))).unionByName(spark.createDataFrame([("nobody",)], "name string"))
    return sites.resolve_names(names.distinct(), "name", table(spark, folder, "sites"))


def redirect_closure(spark: SparkSession, folder: str) -> DataFrame:
    hops = _content(spark, folder).select("content_id", "requested_url", F.posexplode("url_check.redirects").alias("pos", "r")).where("r.url is not null")
    edges = hops.select(F.col("requested_url").alias("source"), F.col("r.url").alias("target"))
    return search.closure(edges, "source", "target", 3)


def crawl_counts(spark: SparkSession, folder: str) -> DataFrame:
    from gleanmark.functions.url import host

    return report.crawl_counts(table(spark, folder, "batch_rows").dropDuplicates(["batch_file", "idx"]).withColumn("host", host(F.col("url"))), "host", "status")


def summary_states(spark: SparkSession, folder: str) -> DataFrame:
    rows = report.summary_entries(_content(spark, folder))
    return rows.groupBy("host", "status").agg(F.count("*").alias("n"), F.sum("chars").cast("long").alias("chars"), F.count_if("body_observed").alias("observed"), F.max("at").alias("newest"))


def source_sections(spark: SparkSession, folder: str) -> DataFrame:
    return report.source_sections(_content(spark, folder))


def report_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = _content(spark, folder)
    runs = table(spark, folder, "experience_log").dropDuplicates(["event_id"]).where("search_performed and search_query is not null and platform is not null").groupBy("platform", "search_query").agg(F.coalesce(F.sum("candidates"), F.lit(0)).alias("found"))
    pages = report.report_pages(report.source_sections(rows), rows.select("content_id", F.coalesce("platform", F.lit("web")).alias("platform"), "title"), "platform", 25, runs)
    return pages.select("platform", "page_no", "n_sources", F.md5("document").alias("document"))


def summary_rows(spark: SparkSession, folder: str) -> DataFrame:
    return report.summary_rows(_content(spark, folder))


def media_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of records with the media of their archives, once and again."""
    files = table(spark, folder, "manifest").where("file_path like 'raw/media/%'").select("content_id", "file_path").distinct().groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct(F.col("file_path").alias("path"), F.when(F.lower("file_path").rlike("\\.(png|jpe?g|webp)$"), "image").otherwise("video").alias("kind")))).alias("files"))
    rows = _content(spark, folder).select("content_id", F.lit("<main><p>x</p></main>").alias("document")).join(files, "content_id", "left")
    once = report.with_media_section(F.col("document"), F.col("files"))
    return rows.select("content_id", report.with_media_section(once, F.col("files")).alias("document"))


def written_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of records whose last output was left as it was."""
    rows = _content(spark, folder)
    before = rows.where("content_id % 3 = 0").select("content_id", F.sha2("title", 256).alias("recorded"), F.when(F.col("content_id") % 2 == 0, F.sha2("title", 256)).otherwise(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("found"))
    return report.written_report(rows.select("content_id", F.col("title").alias("document")), before, "content_id").select("content_id")


def final_states(spark: SparkSession, folder: str) -> DataFrame:
    rows = _content(spark, folder)
    total = F.try_variant_get(nested.parsed_json(F.col("comments")), "$.displayed_total", "long")
    return report.final_states(rows, nested.comments_of(rows).select("content_id"), rows.select("content_id", F.coalesce(total, F.when(F.col("content_id") % 6 == 0, 3).cast("long")).alias("displayed_total")))


def comment_coverage(spark: SparkSession, folder: str) -> DataFrame:
    rows = _content(spark, folder)
    total = F.try_variant_get(nested.parsed_json(F.col("comments")), "$.displayed_total", "long")
    totals = rows.select("content_id", total.alias("displayed_total")).where("displayed_total is not null")
    return report.comment_coverage(nested.comments_of(rows).select("content_id", "comment_id").distinct(), totals, "content_id")


def newest_per_host(spark: SparkSession, folder: str) -> DataFrame:
    rows = report.summary_entries(_content(spark, folder))
    return ordered.top_per(rows, ["host"], [F.desc("at"), F.col("content_id")], 3).select("host", "rank", "content_id")


QUERIES = {
    f.__name__: f
    for f in (
        manifest_failures, duplicate_files, duplicate_images, retention_plan, outer_folders, media_downloads, ambiguous_addresses, keyword_ranking, newest_events, preferred_routes, search_routes,
        verified_hosts, search_plan, site_overlay, policy_overlay, resolved_names, redirect_closure, crawl_counts, summary_states, source_sections, report_documents, comment_coverage, newest_per_host, summary_rows, media_sections, written_reports, final_states,
    )
}

_ONCE = "(select distinct on (content_id) * from content order by content_id)"
_LOG = "(select distinct * from experience_log)"
_DIG = "nullif(regexp_extract(lower(trim(sha256)), '([0-9a-f]{64})$', 1), '')"
_HOST = r"regexp_replace(lower(regexp_extract(trim(url), '(?i)^https?://([^/?#@\\\s]+)', 1)), ':\d*$', '')"
_N = "case when coalesce(observations, 0) = 0 then 1 else observations end"
_READ = "coalesce(lower(trim(status)) in ('captured', 'completed', 'partial') and valid_content, false)"
_DUP = f"""with f as (select distinct content_id::varchar || '/' || file_path as path, bytes, sha256 from manifest), r as (select path, bytes, {_DIG} as sha256 from f where bytes is not null and path is not null),
        o as (select *, row_number() over (partition by bytes, sha256 order by regexp_matches(lower(path), '(对比|备份|旧版|copy|backup|duplicate)')::int, len(string_split(path, '/')), lower(path), path) as n from r where sha256 is not null"""
_PAGE = r"'(?i)https?://[^/?#@\\\s]+(/[^?#\s]*)?(\?[^#\s]*)?(#\S*)?'"
SQL = {
    "manifest_failures": f"""with r as (select distinct content_id, file_path, sha256 from manifest), w as (select distinct content_id, file_path, {_DIG} as sha256 from r), f as (select content_id, file_path from w where sha256 is null group by all)
        select content_id, count(distinct file_path) as n_files, coalesce(any_value(k.n), 0) as n_failed, coalesce(any_value(k.n), 0) = 0 as ok from r left join (select content_id as c, count(*) as n from f group by 1) k on k.c = r.content_id group by content_id""",
    "duplicate_files": _DUP + ") select bytes, sha256, count(*) as n_files, (count(*) - 1) * bytes as reclaimable, min(path) filter (n = 1) as canonical_path from o group by 1, 2 having count(*) > 1",
    "duplicate_images": _DUP + " and regexp_matches(lower(path), '\\.(png|jpe?g|webp)$')) select count(*) as n_groups, sum(reclaimable)::bigint as reclaimable from (select (count(*) - 1) * bytes as reclaimable from o group by bytes, sha256 having count(*) > 1)",
    "retention_plan": f"""with m as (select distinct content_id, primary_file, file_path, bytes, {_DIG} as sha from manifest where output_layout = 'html_and_raw_v1' and status = 'captured'),
        w as (select content_id from m group by 1 having bool_or(file_path = 'raw/content.json') and bool_or(primary_file <> '' and ends_with(file_path, primary_file) and sha is not null))
        select distinct content_id, file_path, bytes from m where bytes >= 262144 and sha is not null and (regexp_full_match(lower(file_path), 'raw/snapshots/.*\\.(json|html)') or lower(file_path) = 'raw/page.png') and content_id in (select content_id from w)
          and content_id in (select content_id from {_ONCE} where completeness.target_present and coalesce(resolved_url, canonical_url, requested_url, '') <> '')""",
    "outer_folders": """with p as (select distinct regexp_replace(file_path, '/[^/]+$', '') as path from manifest union select * from (values ('a'), ('a/b'), ('a/b/c'), ('ab/c'), ('d/e')))
        select path from p where not exists (select 1 from p q where starts_with(p.path, q.path || '/'))""",
    "ambiguous_addresses": "select canonical_url, count(distinct content_id) as n_archives from manifest where canonical_url is not null group by 1 having count(distinct content_id) > 1",
    "keyword_ranking": f"select search_query, sum({_N})::bigint as n_observed, coalesce(sum({_N}) filter ({_READ}), 0)::bigint as n_readable, max(happened_at) as last_seen from {_LOG} where coalesce(trim(search_query), '') <> '' group by 1 order by n_readable desc, last_seen desc, search_query limit 20",
    "newest_events": """with e as (select event_id, happened_at, platform from experience_log where regexp_matches(lower(concat_ws(' ', platform, url, search_query, status, stop_reason, lesson)), '(^|[^a-z0-9_])captured([^a-z0-9_]|$)'))
        select distinct on (event_id) * from e order by happened_at desc, event_id limit 20""",
    "preferred_routes": """with e as (select distinct on (event_id) * from experience_log order by event_id), n as (select *, row_number() over (partition by platform order by happened_at desc nulls last, event_id) as n from e)
        select platform, arg_min(route_kind, n) as route_kind from n where n <= 20 and valid_content and lower(trim(status)) in ('captured', 'partial') and route_kind is not null group by 1""",
    "search_routes": """with e as (select distinct on (event_id) * from experience_log order by event_id), n as (select *, row_number() over (partition by platform order by happened_at desc nulls last, event_id) as n from e),
        b as (select platform, arg_min(route_kind, n) as best from n where n <= 20 and valid_content and lower(trim(status)) in ('captured', 'partial') and route_kind is not null group by 1),
        r as (select site_id, 0 as o, 'native' as route_kind from sites union all select site_id, i, 'public_alternate' from sites, range(1, 100) t(i) where i < len(domains)
          union all select site_id, 999, 'public_index' from sites where public_index and category not in ('procurement', 'company', 'commerce', 'analytics', 'creator', 'custom'))
        select r.site_id, row_number() over (partition by r.site_id order by coalesce(route_kind = best and route_kind <> 'public_index', false) desc, o)::int as route_no, route_kind from r left join b on b.platform = r.site_id qualify route_no <= 3""",
    "verified_hosts": "select distinct source_host, verified_host from experience_log where route_kind = 'source_url_correction' and valid_content and verified_host is not null",
    "search_plan": f"""with base as (select site_id from sites where category = 'social' and site_id <> 'murmel'),
        learned as (select platform as site_id, max(happened_at) as seen_at from {_LOG} where search_performed and valid_content and candidates > 0 and lower(trim(status)) in ('captured', 'partial') and platform in (select site_id from sites) and platform not in (select site_id from base) and platform <> 'murmel' group by 1 order by seen_at desc, site_id limit 3),
        words as (select search_query from (select search_query, sum({_N}) filter ({_READ}) as r, max(happened_at) as seen_at from {_LOG} where coalesce(trim(search_query), '') <> '' group by 1) where coalesce(r, 0) > 0 and lower(search_query) <> 'the ferry' order by r desc, seen_at desc, search_query limit 2),
        t as (select site_id, 0 as s, 0 as w, 'the ferry' as search_query from base union all select site_id, 1, 0, 'the ferry' from learned union all select site_id, 1, 1, search_query from learned, words)
        select row_number() over (order by s, w, site_id, search_query)::int as task_no, site_id, search_query from t order by 1 limit 60""",
    "site_overlay": "with c as (select * from (values ('findry', 'Findry two', 'search'), ('mine', 'My site', 'custom')) v(site_id, site_name, category)) select * from c union all select site_id, site_name, category from sites where site_id not in (select site_id from c)",
    "policy_overlay": "with c as (select * from (values ('findry', 25, null), ('mine', null, 60)) v(site_id, most_requests, window_s)) select coalesce(s.site_id, c.site_id) as site_id, coalesce(c.most_requests, case when s.site_id is not null then 40 end) as most_requests, coalesce(c.window_s, case when s.site_id is not null then 600 end) as window_s from sites s full join c on s.site_id = c.site_id",
    "resolved_names": """with n as (select unnest(aliases) as name from sites union select upper(site_id) from sites union select 'nobody'), k as (select site_id, lower(trim(unnest(list_concat([site_id], coalesce(aliases, []))))) as name from sites), m as (select name, min(site_id) as site_id from k group by 1)
        select n.name, m.site_id from n left join m on lower(trim(n.name)) = m.name where n.name is not null""",
    "redirect_closure": f"""with recursive e as (select distinct requested_url as source, unnest(url_check.redirects).url as target from {_ONCE}), d as (select * from e where source is not null and target is not null),
        r as (select source, target, 1 as hops from d union select r.source, d.target, r.hops + 1 from r join d on d.source = r.target where r.hops < 3 and r.source <> d.target)
        select source, target, min(hops)::int as hops from r where source <> target group by 1, 2""",
    "crawl_counts": f"select count(distinct h) filter (s <> 'skipped') as websites, count(*) filter (s <> 'skipped') as pages, count(*) as records from (select distinct on (batch_file, idx) coalesce({_HOST}, '') as h, coalesce(lower(trim(status)), '') as s from batch_rows order by batch_file, idx)",
    "newest_per_host": rf"""with p as (select *, case when regexp_full_match(trim(resolved_url), {_PAGE}) then resolved_url when regexp_full_match(trim(canonical_url), {_PAGE}) then canonical_url when regexp_full_match(trim(requested_url), {_PAGE}) then requested_url end as url from {_ONCE}),
        h as (select content_id, {_HOST} as host, captured_at from p where url is not null)
        select host, n::int as rank, content_id from (select *, row_number() over (partition by host order by captured_at desc nulls last, content_id) as n from h) where n <= 3""",
    "summary_states": rf"""with p as (select *, regexp_full_match(trim(resolved_url), '(?i)https?://[^/?#@\\\s]+(/[^?#\s]*)?(\?[^#\s]*)?(#\S*)?') as a, regexp_full_match(trim(canonical_url), '(?i)https?://[^/?#@\\\s]+(/[^?#\s]*)?(\?[^#\s]*)?(#\S*)?') as b, regexp_full_match(trim(requested_url), '(?i)https?://[^/?#@\\\s]+(/[^?#\s]*)?(\?[^#\s]*)?(#\S*)?') as c from {_ONCE}),
        u as (select *, case when a then resolved_url when b then canonical_url when c then requested_url end as url from p)
        select {_HOST} as host, case when lower(trim(status)) in ('captured', 'completed', 'partial', 'awaiting_user', 'blocked', 'failed', 'skipped') then lower(trim(status)) else 'partial' end as status, count(*) as n, sum(coalesce(length(text), 0))::bigint as chars, count(*) filter (text is not null or items is not null) as observed, max(captured_at) as newest from u where url is not null group by 1, 2""",
}
_ESC = "replace(replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_TITLED = "regexp_replace(substr(trim(regexp_replace(regexp_replace(coalesce(nfc_normalize(title), ''), '[<>:\"/\\\\|?*\\x00-\\x1f\\x7f\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 64), '[. ]+$', '')"
_POST = f"""posts as (select content_id, case when json_type(p->'post') = 'OBJECT' then (p->'post') else p end as p from (select content_id, case when json_type(p) = 'VARCHAR' then case when json_valid(p->>'$') then (p->>'$')::json end else p end as p from (select content_id, case when json_valid(post) then post::json end as p from {_ONCE})))"""
_COUNT = "case when (p->'engagement'->'{k}'->>'value')::double is not null then '{v} ' || (p->'engagement'->'{k}'->>'raw') end"
_KEPT = "list_filter(list_transform(list_filter(items, lambda i: i is not null and coalesce(i.kind, '') not in ('page_shell', 'comment', 'reply', 'thread_or_reply')), lambda i: trim(coalesce(i.text, ''), ' ')), lambda t: t <> '')"
_SECTIONS = f"""{_POST}, b as (select c.*, p, coalesce({_KEPT}, []) as own, case when trim(author, ' ') <> '' then trim(author, ' ') else list_filter(list_transform(items, lambda i: trim(i.author, ' ')), lambda a: coalesce(a, '') <> '')[1] end as name,
          array_to_string(list_filter([{", ".join(_COUNT.format(k=k, v=v) for k, v in (("likes", "赞"), ("comments", "评"), ("favorites", "藏"), ("shares", "分享"), ("views", "播放 / 浏览")))}], lambda x: x is not null), ' · ') as counts from {_ONCE} c join posts using (content_id)),
        d as (select *, case when len(own) > 0 then list_filter(list_transform(own, lambda t, k: case when list_position(own, t) = k then t end), lambda t: t is not null) when trim(coalesce(text, ''), ' ') <> '' then [trim(text, ' ')] else [] end as texts from b),
        sections as (select content_id, coalesce(platform, 'web') as platform, title, '<section><h2>' || {_ESC.format(c=f"case when {_TITLED} = '' then 'untitled page' else {_TITLED} end")} || '</h2>' || case when regexp_full_match(trim(coalesce(canonical_url, '')), {_PAGE}) then '<a href="' || {_ESC.format(c='canonical_url')} || '">' || {_ESC.format(c='canonical_url')} || '</a>' else '' end
          || case when name is not null then '<address>' || {_ESC.format(c='name')} || '</address>' else '' end || case when counts <> '' then '<p>' || {_ESC.format(c='counts')} || '</p>' else '' end
          || coalesce(array_to_string(list_transform(texts, lambda t: '<p>' || {_ESC.format(c='t')} || '</p>'), ''), '')
          || case when coalesce(trim(comments, ' '), '') = '' then coalesce(array_to_string(list_transform(list_filter(items, lambda i: coalesce(i.kind in ('comment', 'reply'), false) and coalesce(trim(i.text, ' '), '') <> ''), lambda i: '<blockquote>' || {_ESC.format(c='i.text')} || '</blockquote>'), ''), '') else '' end || '</section>' as section from d)"""
_CLEAN = "trim(regexp_replace(regexp_replace(coalesce({c}, ''), 'https?://[^\\s<>\"）)]+', '', 'g'), '\\s+', ' ', 'g'))"
SQL |= {
    "source_sections": f"with {_SECTIONS} select content_id, section from sections",
    "report_documents": f"""with {_SECTIONS}, n as (select *, row_number() over (partition by platform order by content_id) as no from sections), g as (select platform, ((no - 1) // 25 + 1)::int as page_no, count(*) as n_sources, string_agg(section, '' order by no) as body,
          string_agg('<a href="#source-' || no || '">' || no || '. ' || {_ESC.format(c='title')} || '</a>', '' order by no) as nav from n group by 1, 2),
        r as (select platform, '<table>' || string_agg('<tr><td>' || {_ESC.format(c='search_query')} || '</td><td>' || found || '</td></tr>', '' order by '<tr><td>' || {_ESC.format(c='search_query')} || '</td><td>' || found || '</td></tr>') || '</table>' as runs
          from (select platform, search_query, coalesce(sum(candidates), 0)::bigint as found from (select distinct on (event_id) * from experience_log order by event_id) where search_performed and search_query is not null and platform is not null group by 1, 2) group by 1)
        select g.platform, page_no, n_sources, md5(case when n_sources >= 4 then '<nav>' || nav || '</nav>' else '' end || '<main>' || case when page_no = 1 then coalesce(runs, '') else '' end || body || '</main>') as document from g left join r on r.platform = g.platform""",
    "summary_rows": f"""with {_POST}, b as (select content_id, stop_reason, coalesce(status, 'unknown') as status, coalesce(nullif(p->>'text', ''), nullif(text, ''), array_to_string(list_transform(list_filter(items, lambda i: i is not null and coalesce(i.kind, '') <> 'page_shell'), lambda i: coalesce(i.text, '')), chr(10)), '') as t,
          coalesce(nullif(substr({_CLEAN.format(c="coalesce(nullif(title, ''), nullif(p->>'title', ''), nullif(search_query, ''), '页面详情')")}, 1, 110), ''), '页面详情') as title,
          coalesce(nullif(case when json_type(p->'images') = 'ARRAY' then json_array_length(p->'images') end, 0), list_sum(list_transform(items, lambda i: coalesce(len(list_filter(i.media, lambda m: m.kind = 'image')), 0))), 0)::int as n_images,
          coalesce(nullif(case when json_type(p->'videos') = 'ARRAY' then json_array_length(p->'videos') end, 0), list_sum(list_transform(items, lambda i: coalesce(len(list_filter(i.media, lambda m: m.kind = 'video')), 0))), 0)::int as n_videos from {_ONCE} join posts using (content_id)),
        l as (select *, substr({_CLEAN.format(c='title')}, 1, 15) as head, list_filter(list_transform(string_split(replace(t, chr(13), chr(10)), chr(10)), lambda x: {_CLEAN.format(c='x')}), lambda s: length(s) >= 8 and not regexp_matches(s, '(?i)^Copyright|^版权所有')) as lines from b),
        e as (select *, substr(coalesce(list_filter(lines, lambda s: head <> '' and contains(s, head))[1], list_filter(lines, lambda s: length(s) >= 50)[1], lines[1], ''), 1, 125) as x from l)
        select content_id, title, case status when 'captured' then '已保存' when 'completed' then '动作完成' when 'partial' then '部分获取' when 'awaiting_user' then '需人工处理' when 'blocked' then '受阻' when 'failed' then '失败' when 'skipped' then '未访问' else '待核验' end as label, length(t)::int as chars, n_images, n_videos,
          case when status = 'skipped' then '同站前序任务受阻，本页尚未访问。' when status in ('failed', 'blocked', 'awaiting_user') then case when t <> '' then '保留' || length(t) || '字可见文字；' else '未取得可用正文；' end
            || case coalesce(stop_reason, '') when '' then '等待处理' when 'login_required' then '需要登录' when 'verification_required' then '需要验证' when 'rate_limited' then '平台限流' when 'access_denied' then '访问被拒绝' when 'operation_budget' then '操作预算已用尽' else {_CLEAN.format(c='stop_reason')} end || '。'
          else case when x <> '' then '取得“' || x || case when length(x) = 125 then '…' else '' end || '”等可见内容' when t <> '' then '取得页面可见文字' else '没有取得目标正文' end || case when t <> '' then '（约' || length(t) || '字）' else '' end
            || case when n_images > 0 or n_videos > 0 then '，观察到' || n_images || '张图片、' || n_videos || '段视频、0段音频' else '' end || '。' end as summary from e""",
    "media_sections": f"""with f as (select content_id, string_agg('<' || case when regexp_matches(lower(file_path), '\\.(png|jpe?g|webp)$') then 'img' else 'video' end || ' src="' || array_to_string(list_transform(string_split(file_path, '/'), lambda p: url_encode(p)), '/') || '">', '' order by file_path) as m from (select distinct content_id, file_path from manifest where file_path like 'raw/media/%') group by 1)
        select c.content_id, case when m is null then '<main><p>x</p></main>' else '<main><p>x</p><section id="media">' || m || '</section></main>' end as document from {_ONCE} c left join f on f.content_id = c.content_id""",
    "written_reports": f"select content_id from {_ONCE} where not (content_id % 3 = 0 and (case when content_id % 2 = 0 then sha256(title) else sha256(coalesce(text, '')) end is not null) and (sha256(title) is null or case when content_id % 2 = 0 then sha256(title) else sha256(coalesce(text, '')) end <> sha256(title)))",
    "final_states": f"""with e as (select content_id, count(*) as n from ({capture.SQL['p2_comments']}) group by 1), t as (select content_id, case when json_valid(comments) then (comments::json->>'displayed_total')::bigint end as d from {_ONCE}),
        b as (select c.*, case when stop_reason in ('login_required', 'verification_required', 'rate_limited', 'unavailable', 'access_denied', 'target_post_not_found', 'target_body_not_found') then case when real then 'partial' else 'blocked' end when real and stop_reason in ('stable_after_3_scrolls', 'article_dom_complete') then 'captured' else 'partial' end as s,
          coalesce(t.d, case when c.content_id % 6 = 0 then 3 end, 0) > 0 and coalesce(e.n, 0) = 0 as missing, coalesce(len(list_filter(items, lambda i: coalesce(i.truncated, false))) > 0, false) as folded,
          coalesce(len(list_filter(items, lambda i: coalesce(len(list_filter(i.media, lambda m: m.kind = 'media_viewer' and not coalesce(m.loaded, false))), 0) > 0)) > 0, false) as viewer
          from (select *, coalesce(completeness.target_present, false) and coalesce(length(text), 0) > 0 as real from {_ONCE}) c left join t on t.content_id = c.content_id left join e on e.content_id = c.content_id)
        select content_id, case when s = 'captured' and (missing or folded or viewer) then 'partial' else s end as status, s = 'captured' and (missing or folded or viewer) as downgraded from b""",
    "comment_coverage": f"""with e as (select content_id, count(distinct comment_id) as n from ({capture.SQL['p2_comments']}) group by 1), t as (select content_id, case when json_valid(comments) then (comments::json->>'displayed_total')::bigint end as displayed_total from {_ONCE})
        select t.content_id, coalesce(n, 0) as loaded, displayed_total, displayed_total <= coalesce(n, 0) as all_verified from t left join e on e.content_id = t.content_id where displayed_total is not null""",
    "media_downloads": f"""with e as ({capture.SQL['p2_found']}), w as (select distinct content_id, regexp_extract(child_id, '([^/]+)$', 1) as name from e where entity = 'media'), g as (select distinct content_id, regexp_extract(file_path, '([^/]+)$', 1) as name from manifest where sha256 is not null)
        select w.content_id, count(*) as n_wanted, count(*) - count(g.name) as n_missing, case when count(*) = count(g.name) then 'downloaded' else 'partial' end as download_status from w left join g on g.content_id = w.content_id and g.name = w.name group by 1""",
}
