"""Queries over single records: addresses, texts, numbers, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark.functions import network, status, text, url
from gleanmark.operators import report, search, sites
from gleanmark.sources.tables import table

# SQL of the parts of an address, for a column named u.
_IS = rf"coalesce(regexp_full_match(trim(u), '(?i)https?://[^/?#@\\\s]+(/[^?#\s]*)?(\?[^#\s]*)?(#\S*)?'), false)"


def _ex(k: int) -> str:
    return rf"coalesce(regexp_extract(trim(u), '(?i)^(https?)://([^/?#@\\\s]+)(/[^?#\s]*)?(\?[^#\s]*)?(#\S*)?$', {k}), '')"


_SCHEME, _PATH, _QUERY, _FRAGMENT = f"lower({_ex(1)})", _ex(3), f"regexp_replace({_ex(4)}, '^\\?', '')", _ex(5)
_AUTHORITY = f"regexp_replace(lower({_ex(2)}), case when {_SCHEME} = 'http' then ':80$' else ':443$' end, '')"
_HOST = f"regexp_replace(lower({_ex(2)}), ':\\d*$', '')"
_ROUTE = f"(case when regexp_matches({_FRAGMENT}, '^#!?/') then {_FRAGMENT} else '' end)"
_CAMPAIGN = "utm_[^=&]+|fbclid|gclid|auth|authorization|access_token|refresh_token|api_key|session|sessionid|password|code"
_SECRET = "auth|authorization|access_token|refresh_token|api_key|session|sessionid|password|code"


def _without(q: str, keys: str, flags: str = "(?i)") -> str:
    return f"array_to_string(list_filter(string_split({q}, '&'), lambda p: p <> '' and not regexp_matches(p, '{flags}^({keys})(=|$)')), '&')"


def _joined(base: str, q: str, route: str) -> str:
    return f"({base} || case when {q} <> '' then '?' || {q} else '' end || {route})"


_SECRETLESS = f"(case when contains({_ROUTE}, '?') then " + _joined(f"regexp_extract({_ROUTE}, '^([^?]*)', 1)", _without(f"regexp_extract({_ROUTE}, '\\?(.*)$', 1)", _SECRET), "''") + f" else {_ROUTE} end)"
SANITIZED_SQL = f"case when {_IS} then " + _joined(f"{_SCHEME} || '://' || {_AUTHORITY} || case when {_PATH} = '' then '/' else {_PATH} end", _without(_QUERY, _CAMPAIGN), _SECRETLESS) + " end"
_SHARE = "xsec_token|xsec_source|share|feature|si|source|ref|ref_src"
CANONICAL_SQL = "case when u is null then null else " + _joined(
    f"{_SCHEME} || '://' || {_AUTHORITY} || case when regexp_replace({_PATH}, '/$', '') = '' then '/' else regexp_replace({_PATH}, '/$', '') end", _without(_QUERY, _SHARE, ""), _ROUTE
) + " end"
# The canonical address of the address u in one expression.
_CANON = CANONICAL_SQL.replace("(trim(u)", f"(trim({SANITIZED_SQL})").replace("case when u is null", f"case when {SANITIZED_SQL} is null")


def _content(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "content").dropDuplicates(["content_id"])


def url_sanitized(spark: SparkSession, folder: str) -> DataFrame:
    return _content(spark, folder).select("content_id", url.sanitized(F.col("canonical_url")).alias("sanitized"))


def url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return _content(spark, folder).select("content_id", url.canonical(F.col("requested_url")).alias("canonical"))


def url_site(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "batch_rows").select("batch_file", "idx", url.host(F.col("url")).alias("host")).distinct()
    return sites.with_site(rows, "host", table(spark, folder, "sites")).groupBy("host", "site").agg(F.count("*").alias("n"))


def redirect_targets(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(_REDIRECTS)], "case_no int, link string")
    return rows.select("case_no", url.redirect_target(F.col("link")).alias("target"))


_REDIRECTS = (
    "https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9leGFtcGxlLmNvbS9hL2I&x=1",
    "https://www.google.com/url?q=https%3A%2F%2Fexample.org%2Fpage&sa=1",
    "https://duckduckgo.com/l/?uddg=https%3A%2F%2Fexample.net%2F",
    "https://www.google.com/url?q=javascript%3Aalert(1)",
    "https://example.com/plain?q=1",
    "file:///secret",
)


def search_addresses(spark: SparkSession, folder: str) -> DataFrame:
    places = table(spark, folder, "sites").where("search_template is not null").select("site_id", "search_template")
    words = table(spark, folder, "experience_log").where("trim(search_query) <> ''").select("platform", "search_query").distinct()
    return words.join(places, words.platform == places.site_id).select("site_id", "search_query", url.search_address(F.col("search_template"), F.col("search_query")).alias("address"))


def links_in_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(text.addresses_in(F.col("text"))).alias("pos", "link"))
    return docs.withColumn("canonical", url.canonical(F.col("link"))).where("canonical is not null").groupBy("doc_id", "canonical").agg(F.min_by("link", "pos").alias("link"), F.min("pos").alias("pos"))


def link_candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = _content(spark, folder).select("content_id", "requested_url", "platform", F.posexplode("items").alias("pos", "item")).select("content_id", "requested_url", "platform", "pos", F.col("item.url").alias("link")).where("link is not null")
    rows = rows.join(table(spark, folder, "sites").select(F.col("site_id").alias("platform"), "domains"), "platform")
    return search.candidates(rows, "requested_url", "link", "pos", F.col("domains")).groupBy("platform").agg(F.count("*").alias("n_links"), F.countDistinct("canonical").alias("n_pages"))


def metric_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = _content(spark, folder).select(F.inline("items")).select("metrics_text").where("metrics_text is not null").distinct()
    extra = spark.createDataFrame([(v,) for v in _METRICS], "metrics_text string")
    shown = rows.unionByName(extra).distinct()
    return shown.select("metrics_text", text.metric(F.lit(None).cast("string"), F.col("metrics_text")).alias("m")).select("metrics_text", "m.value", "m.approximate")


_METRICS = ("1.2K views", "2.1万", "4,344 Bookmarks", "-2", "3亿", "12 kids", "none", ",", "5M")


def html_escaped(spark: SparkSession, folder: str) -> DataFrame:
    return _content(spark, folder).select("content_id", text.escape_html(F.col("title")).alias("title"), text.escape_html(F.col("post")).alias("post"))


def safe_titles(spark: SparkSession, folder: str) -> DataFrame:
    return _content(spark, folder).select("content_id", text.safe_title(F.col("title")).alias("safe_title"))


def page_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    return _content(spark, folder).select("content_id", text.excerpt(F.col("title"), F.col("text")).alias("excerpt"))


def static_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Markup made of the titles and texts, and its text again."""
    markup = F.concat(F.lit("<html><style>p{}</style><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><!-- x --><script>var a='</p>';</script><p>"), F.coalesce("text", F.lit("")), F.lit("</p>&copy;</html>"))
    return _content(spark, folder).select("content_id", text.static_text(markup).alias("static_text"))


def query_matches(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    # A handful of fixed queries, carried as an array: no join.
    asked = F.array(*map(F.lit, _QUERIES))
    return docs.select("doc_id", "text", F.explode(asked).alias("words")).where(text.matches_words(F.col("text"), F.col("words"))).groupBy("words").agg(F.count("*").alias("n_docs"), F.sum("doc_id").alias("sum_ids"))


_QUERIES = ("ferry", "ferry bakery", "price list", "渡轮", "")


def page_gates(spark: SparkSession, folder: str) -> DataFrame:
    rows = _content(spark, folder)
    found = status.gate(
        url.path(F.col("resolved_url")), F.col("title"), F.col("text"), fragment=url.fragment(F.col("resolved_url")), platform=F.col("platform"), query=url.query(F.col("resolved_url")),
        has_article=F.exists("items", lambda i: i["kind"] == "article"),
    )
    return rows.select("content_id", found.alias("gate")).where("gate is not null")


# What a page may show, to be tried on every record: path, title and text before its own, dialog, password field, puzzle.
_SHOWN = (
    ("/404", "", "", "", False, False), ("/a", "410 - page", "", "", False, False), ("/a", "404页面", "", "", False, False), ("/a", "你访问的页面不见了", "", "", False, False), ("/a", "Just a moment...", "", "", False, False),
    ("/a", "", "Checking your browser", "", False, False), ("/a", "", "", "", False, True), ("/nocaptcha/x", "", "", "", False, False), ("/i/flow/login", "", "", "", False, False), ("/a#/login", "", "", "", False, False),
    ("/a", "", "", "Please sign in", False, False), ("/a", "", "", "", True, False), ("/a", "", "请先登录后查看", "", False, False), ("/a", "", "too many requests", "", False, False), ("/a", "HTTP ERROR 403", "", "", False, False),
    ("/a", "403 ERROR", "", "", False, False), ("/a", "503 Service Unavailable", "", "", False, False), ("/a", "", "该内容无法查看", "", False, False), ("/a", "", "请打开小红书App扫码查看", "", False, False), ("/a", "", "", "", False, False),
)


def _shown(spark: SparkSession, folder: str) -> DataFrame:
    cases = F.array(*[F.struct(F.lit(k).alias("case_no"), *[F.lit(v).alias(n) for n, v in zip(("path", "head", "says", "dialog", "password", "puzzle"), c)]) for k, c in enumerate(_SHOWN)])
    rows = _content(spark, folder).select("content_id", "platform", "items", F.col("title").alias("own_title"), F.col("text").alias("own_text"), F.inline(cases))
    title = F.when(F.col("head") != "", F.col("head")).otherwise(F.col("own_title"))
    body = F.concat_ws("\n", F.when(F.col("says") != "", F.col("says")), "own_text")
    site = F.when((F.col("case_no") == 18) & (F.col("content_id") % 2 == 0), "xhs").otherwise(F.col("platform"))
    return rows.select("content_id", "case_no", title.alias("title"), body.alias("text"), site.alias("platform"), F.regexp_extract("path", "^([^#]*)", 1).alias("path"), F.regexp_extract("path", "(#.*)$", 1).alias("fragment"), "dialog", "password", "puzzle", F.coalesce(F.exists("items", lambda i: i["kind"] == "article"), F.lit(False)).alias("article"))


def gate_branches(spark: SparkSession, folder: str) -> DataFrame:
    """Every branch of the gates, tried on the titles and texts of all records, by case."""
    r = _shown(spark, folder)
    found = status.gate(F.col("path"), F.col("title"), F.col("text"), F.col("article"), F.col("password"), F.col("fragment"), F.col("platform"), None, F.col("dialog"), F.col("puzzle"))
    return r.select("case_no", found.alias("gate")).groupBy("case_no", "gate").agg(F.count("*").alias("n"))


def action_gates(spark: SparkSession, folder: str) -> DataFrame:
    r = _shown(spark, folder)
    found = status.action_gate(F.col("title"), F.col("text"), F.col("password"), F.col("puzzle"))
    return r.select("case_no", found.alias("gate")).groupBy("case_no", "gate").agg(F.count("*").alias("n"))


def capture_states(spark: SparkSession, folder: str) -> DataFrame:
    rows = _content(spark, folder)
    substantive = F.coalesce(F.col("completeness.target_present"), F.lit(False)) & (F.coalesce(F.length("text"), F.lit(0)) > 0)
    return rows.select("content_id", status.capture_status(F.col("stop_reason"), substantive).alias("derived"), status.known_status(F.col("status")).alias("stated"))


def completeness_check(spark: SparkSession, folder: str) -> DataFrame:
    return _content(spark, folder).select("content_id", report.completeness(F.col("items")).alias("c")).select("content_id", "c.*")


def failure_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(k, *v) for k, v in enumerate(_FAILURES)], "case_no int, code string, http int, message string, idempotent boolean")
    found = rows.select("case_no", status.failure_code(F.col("code"), F.col("http"), F.col("message"), F.col("idempotent")).alias("f")).select("case_no", "f.*")
    return found.withColumn("next_step", status.next_step(F.col("code"), F.col("retryable"), F.col("outcome_unknown")))


_FAILURES = (
    (None, 429, "slow down", True), (None, None, "HTTP 403 from host", True), (None, 401, "no", True), (None, 503, "busy", True), (None, 503, "busy", False),
    ("ETIMEDOUT", None, "socket", False), ("command_lost", None, "", True), ("command_lost", None, "", False), ("AbortError", None, "stop", True), (None, 404, "", True),
    (None, None, "ambiguous selector", True), (None, None, "please solve the captcha", True), (None, None, "something else", True), ("ENOTFOUND", None, "dns", True),
)


def waits(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.range(1, 9).select(F.col("id").cast("int").alias("attempt"))
    return rows.select(
        "attempt",
        status.backoff_ms(F.col("attempt")).alias("backoff"),
        status.backoff_ms(F.col("attempt"), floor=F.lit(1500)).alias("asked"),
        status.poll_ms(F.col("attempt"), F.lit(200.0), F.lit(1000), F.lit(700)).alias("poll"),
        status.retry_after_ms(F.col("attempt").cast("string"), F.lit("2025-01-01 00:00:00").cast("timestamp")).alias("retry_after"),
    )


def private_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Every first and second octet, and some first groups of IPv6."""
    four = spark.range(1 << 16).select(F.concat_ws(".", F.shiftright("id", 8), F.col("id").bitwiseAND(255), F.lit(1), F.lit(1)).alias("address"))
    six = spark.range(1 << 12).select(F.concat(F.lower(F.hex(F.col("id") * 16 + 1)), F.lit("::1")).alias("address"))
    other = spark.createDataFrame([("300.1.1.1",), ("10.1",), ("localhost",)], "address string")
    return four.unionByName(six).unionByName(other).select("address", network.is_private_address(F.col("address")).alias("private"))


def media_kinds(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(t, b) for t in _TYPES for b in (1, 30 << 20, 300 << 20)], "media_type string, size long")
    return rows.select("media_type", "size", network.media_kind(F.col("media_type")).alias("kind")).withColumn("kept", network.within_limit(F.col("kind"), F.col("size")))


_TYPES = (
    "image/jpeg", "image/png", "image/webp", "image/avif", "image/gif", "image/svg+xml", "video/mp4", "video/webm", "audio/mp4", "audio/mpeg", "audio/aac", "audio/ogg", "audio/wav", "audio/webm", "audio/flac",
    "image/bmp", "video/quicktime", "text/html", "application/octet-stream", "video/mp4; codecs=x", "IMAGE/JPEG",
)


def topic_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Sites asked for the titles of all records as topics."""
    rows = _content(spark, folder).select(F.coalesce("search_query", "title").alias("topic")).where("topic is not null").unionByName(spark.createDataFrame([(t,) for t in _TOPICS], "topic string"))
    return rows.select(F.posexplode(status.topic_sites(F.col("topic"))).alias("place", "site")).groupBy("place", "site").agg(F.count("*").alias("n"))


_TOPICS = ("学校供应商", "标书 模板", "Tender notice", "TypeScript generics", "linux kernel", "coding club", "手机开发", "bug tracker", "framework", "咖啡")


def topic_classes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "experience_log").where("search_query is not null").select("search_query").distinct().unionByName(spark.createDataFrame([(t,) for t in _TOPICS], "search_query string"))
    return rows.select("search_query", status.topic_class(F.col("search_query")).alias("topic_class")).groupBy("topic_class").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        url_sanitized, url_canonical, url_site, redirect_targets, search_addresses, links_in_text, link_candidates, metric_values, html_escaped, safe_titles, page_excerpts, static_texts,
        query_matches, page_gates, capture_states, completeness_check, failure_codes, waits, private_addresses, media_kinds, topic_classes, topic_sites, gate_branches, action_gates,
    )
}


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


_ONCE = "(select distinct on (content_id) * from content order by content_id)"
_BLOCKING = ", ".join(f"'{r}'" for r in status.BLOCKING_REASONS)


def _esc(c: str) -> str:
    return f"replace(replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), 'https?://[^\\s<>\"）)]+', '', 'g'), '\\s+', ' ', 'g'))"


_CLASS = "case when regexp_matches({t}, '(?i)(tender|procurement|招标|投标|采购|供应商|标书)') then 'procurement' when regexp_matches({t}, '(?i)(python|javascript|typescript|github|linux|api|coding|开源|编程|代码|开发|程序)') then 'technical' else 'social' end"
# The gates in the order of their rules, over path, fragment, query, title, text, n (its length), platform, dialog and flags.
_GATE = """case when platform = 'xhs' and regexp_matches(coalesce(text, ''), '(?i)请打开小红书App扫码查看') then 'verification_required'
        when regexp_matches(path, '(?i)/(404|notfound|error)([/?]|$)') or regexp_matches(coalesce(title, ''), '(?i)^(404|410)(页面|\\s*[-:|]?\\s*(page|not found|error))|你访问的页面不见了|页面不存在|page not found') then 'unavailable'
        when puzzle or regexp_matches(coalesce(title, ''), '(?i)^(验证|访问验证|安全验证|安全检查|just a moment|human verification)') or regexp_matches(path, '(?i)/nocaptcha([/?]|$)') or (n < 2000 and not article and regexp_matches(coalesce(text, ''), '(?i)完成验证|拖动滑块|请进行安全验证|verify you are human|checking your browser')) then 'verification_required'
        when regexp_matches(path || fragment, '(?i)/(i/flow/login|login|signin|passport)([/?]|$)') or regexp_matches(dialog, '(?i)登录|登入|sign in|log in') then 'login_required'
        when password and not article then 'login_required'
        when n < 1800 and regexp_matches(coalesce(text, ''), '(?i)请(先)?登录后|登录后(查看|使用|访问)|扫码(即可)?登录|sign in to continue|log in to continue') then 'login_required'
        when n < 1500 and regexp_matches(coalesce(text, ''), '(?i)rate limit exceeded|too many requests|操作频繁|访问过于频繁|请求过于频繁') then 'rate_limited'
        when n < 4000 and regexp_matches(coalesce(title, '') || chr(10) || coalesce(text, ''), '(?i)access denied|403 forbidden|^403 error|http error\\s*403|request rejected|拒绝访问|请求遭到拒绝|禁止访问|you(''ve| have) been blocked|blocked your request|request blocked') then 'access_denied'
        when n < 1500 and regexp_matches(coalesce(title, ''), '(?i)^(502 bad gateway|503 service (unavailable|temporarily unavailable)|504 gateway (timeout|time-out))(\\s|$)') then 'transient_failure'
        when n < 1000 and regexp_matches(coalesce(text, ''), '(?i)this post was deleted|this post is unavailable|帖子已删除|内容已删除|笔记不存在|内容不存在|该内容无法查看|account suspended|this account doesn.t exist|page not found') then 'unavailable' end"""
_SHOWN_SQL = f"""with c as (select * from (values {_values([(k, *c) for k, c in enumerate(_SHOWN)])}) v(case_no, cpath, head, says, dialog, password, puzzle)),
        q as (select case_no, regexp_extract(cpath, '^([^#]*)', 1) as path, regexp_extract(cpath, '(#.*)$', 1) as fragment, dialog, password, puzzle, case when head <> '' then head else title end as title, concat_ws(chr(10), nullif(says, ''), text) as text,
          case when case_no = 18 and content_id % 2 = 0 then 'xhs' else platform end as platform, coalesce(list_bool_or(list_transform(items, lambda i: i.kind = 'article')), false) as article from {_ONCE}, c),
        p as (select *, length(text) as n from q)"""
_METRIC_RE = "(?i)(-?\\d[\\d,]*(?:\\.\\d+)?)\\s*(?:(万|亿)|([kmb])(?:[^a-z]|$))?"
_P = lambda p: p.replace("'", "''")
SQL = {
    "url_sanitized": f"select content_id, {SANITIZED_SQL} as sanitized from (select content_id, canonical_url as u from {_ONCE})",
    "url_canonical": f"select content_id, {CANONICAL_SQL} as canonical from (select content_id, {SANITIZED_SQL} as u from (select content_id, requested_url as u from {_ONCE}))",
    "url_site": f"""with rows as (select distinct batch_file, idx, {_HOST} as host from (select *, url as u from batch_rows)),
        doms as (select site_id, lower(unnest(domains)) as domain from sites),
        hosts as (select distinct host from rows),
        found as (select h.host, d.site_id, row_number() over (partition by h.host order by length(d.domain) desc, d.site_id) as n from hosts h join doms d on h.host = d.domain or ends_with(h.host, '.' || d.domain))
        select r.host, coalesce(f.site_id, 'web') as site, count(*) as n from rows r left join found f on r.host = f.host and f.n = 1 group by 1, 2""",
    "redirect_targets": "select * from (values (0, 'https://example.com/a/b'), (1, 'https://example.org/page'), (2, 'https://example.net/'), (3, 'https://www.google.com/url?q=javascript%3Aalert(1)'), (4, 'https://example.com/plain?q=1'), (5, null)) t(case_no, target)",
    "search_addresses": "select distinct site_id, search_query, replace(search_template, '{query}', url_encode(trim(search_query))) as address from experience_log join sites on platform = site_id where trim(search_query) <> '' and search_template is not null",
    "links_in_text": f"""with l as (select doc_id, unnest(regexp_extract_all(text, '(https?://[^\\s<>\\[\\]"''`，。；）)]+)', 1)) as link, generate_subscripts(regexp_extract_all(text, '(https?://[^\\s<>\\[\\]"''`，。；）)]+)', 1), 1) - 1 as pos from documents),
        s as (select doc_id, link, pos, {SANITIZED_SQL} as u from (select *, link as u from l)), c as (select doc_id, link, pos, {CANONICAL_SQL} as canonical from s)
        select doc_id, canonical, arg_min(link, pos) as link, min(pos)::int as pos from c where canonical is not null group by 1, 2""",
    "metric_values": f"""with shown as (select distinct metrics_text from (select unnest(items).metrics_text as metrics_text from {_ONCE} union all select * from (values {_values([(m,) for m in _METRICS])})) where metrics_text is not null),
        m as (select metrics_text, replace(regexp_extract(trim(metrics_text), '{_P(_METRIC_RE)}', 1), ',', '') as num, lower(regexp_extract(trim(metrics_text), '{_P(_METRIC_RE)}', 2) || regexp_extract(trim(metrics_text), '{_P(_METRIC_RE)}', 3)) as unit from shown)
        select metrics_text, case when num <> '' then num::double * case unit when 'k' then 1e3 when 'm' then 1e6 when 'b' then 1e9 when '万' then 1e4 when '亿' then 1e8 else 1.0 end end as value, unit <> '' as approximate from m""",
    "html_escaped": f"select content_id, {_esc('title')} as title, {_esc('post')} as post from {_ONCE}",
    "page_excerpts": f"""with l as (select content_id, substr({_clean('title')}, 1, 15) as head, list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13), chr(10)), chr(10)), lambda x: {_clean('x')}), lambda s: length(s) >= 8 and not regexp_matches(s, '(?i)^Copyright|^版权所有')) as lines from {_ONCE})
        select content_id, substr(coalesce(list_filter(lines, lambda s: head <> '' and contains(s, head))[1], list_filter(lines, lambda s: length(s) >= 50)[1], lines[1], ''), 1, 125) as excerpt from l""",
    "query_matches": f"""select words, count(*) as n_docs, sum(doc_id)::bigint as sum_ids from documents, (values {_values([(q,) for q in _QUERIES])}) q(words)
        where coalesce(list_bool_and(list_transform(list_filter(string_split(words, ' '), lambda t: t <> ''), lambda t: case when regexp_full_match(t, '[a-z0-9_]+') then regexp_matches(lower(coalesce(text, '')), '(^|[^a-z0-9_])' || t || '([^a-z0-9_]|$)') else contains(lower(coalesce(text, '')), t) end)), true) group by words""",
    "capture_states": f"""select content_id, case when stop_reason in ({_BLOCKING}) then case when real then 'partial' else 'blocked' end when real and stop_reason in ('stable_after_3_scrolls', 'article_dom_complete') then 'captured' else 'partial' end as derived,
        case when lower(trim(status)) in ('captured', 'completed', 'partial', 'awaiting_user', 'blocked', 'failed', 'skipped') then lower(trim(status)) end as stated
        from (select *, coalesce(completeness.target_present, false) and coalesce(length(text), 0) > 0 as real from {_ONCE})""",
    "completeness_check": f"""with i as (select content_id, list_filter(items, lambda x: x is not null) as it from {_ONCE})
        select content_id, coalesce(len(it), 0)::bigint as n_items, coalesce(list_sum(list_transform(list_filter(it, lambda x: coalesce(x.kind, '') <> 'page_shell'), lambda x: coalesce(length(x.text), 0))), 0)::bigint as chars,
        coalesce(list_sum(list_transform(it, lambda x: coalesce(len(list_filter(x.media, lambda m: m is not null and coalesce(m.kind, '') <> 'media_viewer')), 0))), 0)::bigint as media_assets from i""",
    "page_gates": f"""with p as (select content_id, title, text, coalesce(length(text), 0) as n, {_PATH} as path, {_FRAGMENT} as fragment, {_QUERY} as query, platform, '' as dialog, false as password, false as puzzle, coalesce(list_bool_or(list_transform(items, lambda i: i.kind = 'article')), false) as article from (select *, resolved_url as u from {_ONCE})),
        g as (select content_id, {_GATE} as gate from p)
        select * from g where gate is not null""",
    "gate_branches": f"""{_SHOWN_SQL} select case_no, {_GATE} as gate, count(*) as n from p group by 1, 2""",
    "action_gates": f"""{_SHOWN_SQL} select case_no, case when regexp_matches(coalesce(title, ''), '(?i)^(429|too many requests|访问过于频繁|操作过于频繁)') or (n < 1500 and regexp_matches(trim(text), '(?i)^(too many requests|访问过于频繁|操作过于频繁)')) then 'rate_limited'
        when regexp_matches(coalesce(title, ''), '(?i)^(访问验证|安全验证|安全检查|验证中心|just a moment|human verification|verify you are human)') or puzzle then 'verification_required'
        when regexp_matches(coalesce(title, ''), '(?i)^(登录|登入|sign in|log in)(\\s|$|[-|])') and password then 'login_required' end as gate, count(*) as n from p group by 1, 2""",
    "waits": """select a::int as attempt, ceil(least(3000, 700 * pow(2, a - 1)))::bigint as backoff, greatest(ceil(least(3000, 700 * pow(2, a - 1))), 1500)::bigint as asked, least(700, 1000, ceil(200 * pow(1.5, a - 1)))::bigint as poll, (a * 1000)::bigint as retry_after from range(1, 9) t(a)""",
    "private_addresses": """select address, case when contains(address, ':') then not regexp_matches(address, '^[23][0-9a-f]{3}:') when not regexp_full_match(address, '\\d{1,3}(\\.\\d{1,3}){3}') or list_max(list_transform(string_split(address, '.'), lambda o: try_cast(o as int))) > 255 then true else
        a in (0, 10, 127) or a >= 224 or (a = 100 and b between 64 and 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b in (0, 168)) or (a = 198 and b in (18, 19)) end as private
        from (select address, try_cast(split_part(address, '.', 1) as int) as a, try_cast(split_part(address, '.', 2) as int) as b from (select (i >> 8) || '.' || (i & 255) || '.1.1' as address from range(65536) t(i)
          union all select lower(to_hex(i * 16 + 1)) || '::1' from range(4096) t(i) union all select unnest(['300.1.1.1', '10.1', 'localhost'])))""",
    "failure_codes": "select * from (values (0, 'rate_limited', false, false, 'wait'), (1, 'access_denied', false, false, 'correct_input'), (2, 'login_required', false, false, 'sign_in_by_hand'), (3, 'transient_failure', true, false, 'retry'), (4, 'transient_failure', false, true, 'read_before_writing_again'), (5, 'transient_failure', false, true, 'read_before_writing_again'), (6, 'transient_failure', true, false, 'retry'), (7, 'write_outcome_unknown', false, true, 'read_before_writing_again'), (8, 'cancelled', false, false, 'correct_input'), (9, 'unavailable', false, false, 'correct_input'), (10, 'invalid_target', false, false, 'correct_input'), (11, 'verification_required', false, false, 'sign_in_by_hand'), (12, 'operation_failed', false, false, 'correct_input'), (13, 'unavailable', false, false, 'correct_input')) v(case_no, code, retryable, outcome_unknown, next_step)",
    "media_kinds": f"""with t as (select * from (values {_values([(t,) for t in _TYPES])}) a(media_type), (values (1::bigint), (31457280), (314572800)) b(size)),
        k as (select *, lower(split_part(media_type, ';', 1)) as m from t),
        j as (select *, case when m in ('image/gif', 'image/png', 'image/jpeg', 'image/webp', 'image/avif', 'image/svg+xml') then 'image' when m in ('video/mp4', 'video/webm') then 'video' when m in ('audio/mp4', 'audio/mpeg', 'audio/aac', 'audio/ogg', 'audio/wav', 'audio/webm', 'audio/flac') then 'audio' end as kind from k)
        select media_type, size, kind, case kind when 'image' then size <= 26214400 when 'video' then size <= 262144000 when 'audio' then size <= 262144000 else false end as kept from j""",
    "safe_titles": f"""with t as (select content_id, regexp_replace(substr(trim(regexp_replace(regexp_replace(coalesce(nfc_normalize(title), ''), '[<>:"/\\\\|?*\\x00-\\x1f\\x7f\\x{{202a}}-\\x{{202e}}\\x{{2066}}-\\x{{2069}}]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 64), '[. ]+$', '') as s from {_ONCE}) select content_id, case when s = '' then 'untitled page' else s end as safe_title from t""",
    "topic_classes": f"""select topic_class, count(*) as n from (select search_query, {_CLASS.format(t='search_query')} as topic_class from (select distinct search_query from experience_log where search_query is not null union all select * from (values {_values([(t,) for t in _TOPICS])}))) group by 1""",
    "topic_sites": f"""with t as (select coalesce(search_query, title) as topic from {_ONCE} where coalesce(search_query, title) is not null union all select * from (values {_values([(t,) for t in _TOPICS])})),
        s as (select case {_CLASS.format(t='topic')} when 'procurement' then 'ccgp,ggzy,chinabidding,qianlima,bidcenter,made-in-china,bing' when 'technical' then 'github,csdn,cnblogs,juejin,stackoverflow,devto,hackernews,v2ex,bilibili,youtube,bing'
          else 'xhs,x,zhihu,douban,reddit,douyin,bilibili,youtube,wechat,weibo,instagram,tiktok,google,bing' end as listed from t)
        select (place - 1)::int as place, site, count(*) as n from (select unnest(string_split(listed, ',')) as site, generate_subscripts(string_split(listed, ','), 1) as place from s) group by 1, 2""",
}
_SPACED = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_UNTAGGED = "regexp_replace(regexp_replace(regexp_replace({c}, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<(script|style|noscript|template)\\b.*?</(script|style|noscript|template)\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
_MARKS = "replace(replace(replace(replace(replace(replace(replace(replace({c}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_MADE = "'<html><style>p{}</style><h1>' || coalesce(title, '') || '</h1><!-- x --><script>var a=''</p>'';</script><p>' || coalesce(text, '') || '</p>&copy;</html>'"
SQL |= {
    "static_texts": f"select content_id, {_SPACED.format(c=_MARKS.format(c=_UNTAGGED.format(c=_MADE)))} as static_text from {_ONCE}",
    "link_candidates": f"""with i as (select content_id, requested_url, platform, i.url as target, p - 1 as pos from (select content_id, requested_url, platform, unnest(items) as i, generate_subscripts(items, 1) as p from {_ONCE}) where i.url is not null),
        r as (select *, {_CANON} as canonical, {_HOST} as host, {_PATH} as path, {_ROUTE} as route from (select *, target as u from i)), a as (select distinct requested_url, {_CANON} as self from (select *, requested_url as u from i)),
        k as (select r.*, row_number() over (partition by r.requested_url, canonical order by pos) as n from r left join a on a.requested_url = r.requested_url where canonical is not null and exists (select 1 from (select site_id, lower(unnest(domains)) as d from sites) s where s.site_id = r.platform and (r.host = d or ends_with(r.host, '.' || d)))
          and not regexp_matches(path, '(?i)/(login|signin|signup|privacy|terms|help|about)([/?#]|$)') and not (path in ('', '/') and route = '') and canonical <> coalesce(self, ''))
        select platform, count(*) as n_links, count(distinct canonical) as n_pages from k where n = 1 group by 1""",
}
