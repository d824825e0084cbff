"""Page addresses as Column expressions: parts, sanitising, canonical forms, redirects and search addresses.

All are built-in string functions, so they run in generated code and fold into scans. Scheme and host are compared in
lower case; a value that isn't an http(s) address without credentials gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query keys that name a campaign or hold a secret (any case), and keys of shared links (exact case).
CAMPAIGN_KEYS = ("utm_[^=&]+", "fbclid", "gclid")
SECRET_KEYS = ("auth", "authorization", "access_token", "refresh_token", "api_key", "session", "sessionid", "password", "code")
SHARE_KEYS = ("xsec_token", "xsec_source", "share", "feature", "si", "source", "ref", "ref_src")
# Keys that don't choose the page of this project's sites.
PAGE_NEUTRAL_KEYS = (*CAMPAIGN_KEYS, *SECRET_KEYS, "spm", "share_token", "share_from", "from", "share", "si", "ref", "ref_src", "source", "feature", "xsec_token", "xsec_source")
# Search engines whose own pages are no results.
SEARCH_ENGINES = ("bing.com", "google.com", "sogou.com", "so.com", "duckduckgo.com")

_PARTS = r"^(?i:(https?)):\/\/([^\/?#@\\\s]+)(\/[^?#\s]*)?(\?[^#\s]*)?(#\S*)?$"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, k)


def is_page(url: Column) -> Column:
    """Whether ``url`` is an http(s) address without credentials; false for null."""
    return F.coalesce(F.trim(url).rlike(_PARTS), F.lit(False))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Host in lower case with its port, unless that is the scheme's own."""
    return F.regexp_replace(F.lower(_part(url, 2)), F.when(scheme(url) == "http", F.lit(":80$")).otherwise(F.lit(":443$")), F.lit(""))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(_part(url, 2)), ":\\d*$", "")


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    """Query without its question mark."""
    return F.regexp_replace(_part(url, 4), "^\\?", "")


def fragment(url: Column) -> Column:
    return _part(url, 5)


def app_route(url: Column) -> Column:
    """The fragment where it is a route of the page's own (``#/`` or ``#!/``), else empty."""
    return F.when(fragment(url).rlike("^#!?/"), fragment(url)).otherwise(F.lit(""))


def without_keys(text: Column, keys: tuple[str, ...], any_case: bool) -> Column:
    """A query without the parameters of ``keys`` (patterns of whole keys); empty parameters go as well."""
    pattern = ("(?i)" if any_case else "") + "^(" + "|".join(keys) + ")(=|$)"
    kept = F.filter(F.split(text, "&"), lambda p: (p != "") & ~p.rlike(pattern))
    return F.array_join(kept, "&")


def _joined(base: Column, parameters: Column, route: Column) -> Column:
    return F.concat(base, F.when(parameters != "", F.concat(F.lit("?"), parameters)).otherwise(F.lit("")), route)


def _without_secrets(route: Column) -> Column:
    head, rest = F.regexp_extract(route, "^([^?]*)", 1), F.regexp_extract(route, "\\?(.*)$", 1)
    return F.when(route.contains("?"), _let(without_keys(rest, SECRET_KEYS, True), lambda q: _joined(head, q, F.lit("")))).otherwise(route)


def sanitized(url: Column) -> Column:
    """Address without ordinary fragment, campaign keys and secrets; null where it isn't a page address."""
    bare_path = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    base = F.concat(scheme(url), F.lit("://"), authority(url), bare_path)
    kept = without_keys(query(url), CAMPAIGN_KEYS + SECRET_KEYS, True)
    return F.when(is_page(url), _let(kept, lambda q: _joined(base, q, _let(app_route(url), _without_secrets))))


def _id_form(url: Column, sites: str, pattern: str, form: str, source: Column) -> tuple[Column, Column]:
    found = F.regexp_extract(source, pattern, 1)
    return host(url).rlike(f"(^|\\.)({sites})$") & (found != ""), F.concat(F.lit(form), found)


def canonical(url: Column) -> Column:
    """One address per page: sanitised, video and post pages by their id, without keys of shared links and closing slash."""
    return _let(sanitized(url), _canonical)


def _canonical(clean: Column) -> Column:
    video_id = F.regexp_extract(query(clean), "(?:^|&)v=([^&]+)", 1)
    rules = [
        _id_form(clean, "x\\.com|twitter\\.com", "/status/(\\d+)", "https://x.com/i/status/", path(clean)),
        _id_form(clean, "x\\.com|twitter\\.com", "/article/(\\d+)", "https://x.com/i/article/", path(clean)),
        _id_form(clean, "xiaohongshu\\.com", "/(?:explore|discovery/item|search_result)/((?i)[a-f\\d]+)", "https://www.xiaohongshu.com/explore/", path(clean)),
        (host(clean).rlike("(^|\\.)youtube\\.com$") & (video_id != ""), F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)),
        _id_form(clean, "youtu\\.be", "^/([^/]+)", "https://www.youtube.com/watch?v=", path(clean)),
        _id_form(clean, "youtube\\.com", "/(?:shorts|embed)/([^/]+)", "https://www.youtube.com/watch?v=", path(clean)),
        _id_form(clean, "douyin\\.com", "/((?:video|note)/\\d+)", "https://www.douyin.com/", path(clean)),
    ]
    short = F.regexp_replace(path(clean), "/$", "")
    base = F.concat(scheme(clean), F.lit("://"), authority(clean), F.when(short == "", F.lit("/")).otherwise(short))
    out = F.when(clean.isNull(), F.lit(None).cast("string"))
    for condition, form in rules:
        out = out.when(condition, form)
    return out.otherwise(_let(without_keys(query(clean), SHARE_KEYS, False), lambda q: _joined(base, q, app_route(clean))))


def redirect_target(url: Column) -> Column:
    """Target of a search engine's redirect; the address itself where it is none or the target isn't a page."""
    one = lambda k: F.regexp_extract(query(url), f"(?:^|&){k}=([^&]*)", 1)
    coded = F.translate(F.regexp_extract(query(url), "(?:^|&)u=a1([^&]*)", 1), "-_", "+/")
    padded = F.concat(coded, F.repeat(F.lit("="), F.pmod(F.lit(0) - F.length(coded), F.lit(4))))
    bing = host(url).rlike("(^|\\.)bing\\.com$") & (path(url) == "/ck/a") & (coded != "")
    google = host(url).rlike("(^|\\.)google\\.com$") & (path(url) == "/url")
    target = (
        F.when(bing, F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"))
        .when(google, F.try_url_decode(F.when(one("q") != "", one("q")).otherwise(one("url"))))
        .when(host(url).rlike("(^|\\.)duckduckgo\\.com$"), F.try_url_decode(one("uddg")))
    )
    return _let(target, lambda t: F.when(is_page(t), t).otherwise(F.when(is_page(url), url)))


def search_address(template: Column, words: Column, domain: Column | None = None) -> Column:
    """``template`` with ``{query}`` filled in, percent-encoded; null for blank words."""
    asked = F.trim(words) if domain is None else F.when(domain.isNull(), F.trim(words)).otherwise(F.concat(F.lit("site:"), domain, F.lit(" "), F.trim(words)))
    return F.when(F.trim(words) != "", F.replace(template, F.lit("{query}"), F.replace(F.url_encode(asked), F.lit("+"), F.lit("%20"))))


def in_domain(name: Column, domain: Column) -> Column:
    """Whether a host is the domain or below it."""
    return (name == domain) | F.endswith(name, F.concat(F.lit("."), domain))


def with_page_address(df: DataFrame, column: str, sites: DataFrame, name: str = "address") -> DataFrame:
    """``df`` with the address that chooses the page: the site for all its hosts, path, neutral keys and anchors left out.

    The site catalogue (``site_id``, ``domains``) is joined on the host without ``www.``; an unknown host stands for itself.
    Null where ``column`` isn't a page address.
    """
    known = sites.select("site_id", F.explode("domains").alias("_host")).where("_host is not null").select(F.regexp_replace(F.lower("_host"), "^www\\.", "").alias("_host"), "site_id").dropDuplicates(["_host"])
    url = F.col(column)
    place = df.withColumn("_host", F.regexp_replace(host(url), "^www\\.", "")).join(known, "_host", "left")
    parameters = F.array_join(F.array_sort(F.split(without_keys(query(url), PAGE_NEUTRAL_KEYS, True), "&")), "&")
    base = F.concat(F.coalesce(F.col("site_id"), F.regexp_replace(authority(url), "^www\\.", "")), F.regexp_replace(path(url), "/+$", ""))
    return place.withColumn(name, F.when(is_page(url), _let(parameters, lambda q: _joined(base, q, app_route(url))))).drop("_host", "site_id")


def public_alternate(url: Column) -> Column:
    """Another public address of the same content, for the few hosts that have one; null for others."""
    video = F.regexp_extract(path(url), "/video/(\\d+)", 1)
    return (
        F.when((host(url) == "jingxuan.douyin.com") & (video != ""), F.concat(F.lit("https://www.douyin.com/video/"), video))
        .when((host(url) == "apps.weibo.com") & path(url).rlike("^/\\d+/(?i:[a-z0-9]+)$"), F.concat(scheme(url), F.lit("://weibo.com"), path(url)))
        .when((host(url) == "www.reddit.com") & path(url).contains("/comments/"), F.concat(scheme(url), F.lit("://old.reddit.com"), path(url)))
    )


def file_link(file_path: Column) -> Column:
    """A relative file path as a link: every part percent-encoded."""
    return F.array_join(F.transform(F.split(file_path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")


def safe_href(url: Column) -> Column:
    """The address as an attribute of markup; empty where it is no http(s) address without credentials."""
    from gleanmark.functions.text import escape_html

    return F.when(is_page(url), escape_html(F.trim(url))).otherwise(F.lit(""))


def resolved(base: Column, href: Column) -> Column:
    """A link of a page as an absolute address: relative to scheme, host, folder or page; null where either is no address."""
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(F.when(path(base) == "", F.lit("/")).otherwise(path(base)), "[^/]*$", "")
    asked = F.regexp_extract(href, "^([^?#]*)", 1)
    parts = F.split(F.concat(folder, asked), "/")
    # Dot parts go, and each ".." takes the part before it along; the first part is empty.
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
    found = (
        F.when(href.rlike("^(?i)https?://"), href)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.startswith(href, F.lit("//")), F.concat(scheme(base), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, F.when(path(base) == "", F.lit("/")).otherwise(path(base)), href))
        .when(F.startswith(href, F.lit("#")) | (href == ""), F.concat(F.regexp_extract(F.trim(base), "^([^#]*)", 1), href))
        .otherwise(F.concat(origin, F.array_join(walked, "/"), F.substring(href, F.length(asked) + 1, F.length(href))))
    )
    return F.when(is_page(base), _let(found, lambda u: F.when(is_page(u), u)))
