"""Summaries and the report: entries, counts, sections and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanmark.functions import text, url
from gleanmark.functions.status import known_status

# Kinds of items that aren't content of their own.
SHELL_KINDS = ("page_shell",)
ANSWER_KINDS = ("comment", "reply", "thread_or_reply")


def completeness(items: Column) -> Column:
    """``struct<n_items, chars, media_assets>`` of an array of items, shells left out of the characters."""
    real = F.filter(items, lambda i: i.isNotNull())
    chars = F.aggregate(F.filter(real, lambda i: ~F.coalesce(i["kind"].isin(*SHELL_KINDS), F.lit(False))), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.length(i["text"]), F.lit(0)))
    media = F.aggregate(real, F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.size(F.filter(i["media"], lambda m: m.isNotNull() & (F.coalesce(m["kind"], F.lit("")) != "media_viewer"))), F.lit(0)))
    return F.struct(F.coalesce(F.size(real), F.lit(0)).cast("long").alias("n_items"), F.coalesce(chars, F.lit(0)).cast("long").alias("chars"), F.coalesce(media, F.lit(0)).cast("long").alias("media_assets"))


def report_texts(items: Column, body: Column) -> Column:
    """Distinct texts of a source in order: items that are content, else the body."""
    own = F.filter(F.transform(F.filter(items, lambda i: i.isNotNull() & ~F.coalesce(i["kind"].isin(*SHELL_KINDS, *ANSWER_KINDS), F.lit(False))), lambda i: F.trim(F.coalesce(i["text"], F.lit("")))), lambda t: t != "")
    return F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) > 0, F.array_distinct(own)).otherwise(F.filter(F.array(F.trim(F.coalesce(body, F.lit("")))), lambda t: t != ""))


def summary_entries(content: DataFrame) -> DataFrame:
    """One entry per record: ``content_id, url, host, title, status, excerpt, chars, body_observed, at``.

    The address is the first of resolved, canonical and requested that is a page; records without one have no entry.
    """
    page = F.coalesce(*[F.when(url.is_page(F.col(c)), F.col(c)) for c in ("resolved_url", "canonical_url", "requested_url")])
    rows = content.withColumn("url", page).where("url is not null")
    title = F.coalesce(*[F.when(F.trim(c) != "", text.clean(F.col(c))) for c in ("title", "search_query")], F.lit(text.UNTITLED))
    return rows.select(
        "content_id",
        "url",
        url.host(F.col("url")).alias("host"),
        F.substring(title, 1, 110).alias("title"),
        F.coalesce(known_status(F.col("status")), F.lit("partial")).alias("status"),
        text.excerpt(F.col("title"), F.col("text")).alias("excerpt"),
        F.coalesce(F.length("text"), F.lit(0)).alias("chars"),
        (F.col("text").isNotNull() | F.col("items").isNotNull()).alias("body_observed"),
        F.col("captured_at").alias("at"),
    )


def crawl_counts(rows: DataFrame, host: str, status: str) -> DataFrame:
    """``websites, pages, records``: hosts and rows that weren't skipped, and all rows."""
    seen = F.coalesce(F.lower(F.trim(status)), F.lit("")) != "skipped"
    return rows.agg(F.countDistinct(F.when(seen, F.col(host))).alias("websites"), F.count_if(seen).alias("pages"), F.count("*").alias("records"))


# The counts that a source shows, with their labels.
SHOWN_COUNTS = {"likes": "赞", "comments": "评", "favorites": "藏", "shares": "分享", "views": "播放 / 浏览"}


def source_sections(content: DataFrame) -> DataFrame:
    """``content_id, section``: a source as an escaped piece of the report.

    Title, link, author (that of the record, else of the first item that has one), counts of the post, paragraphs of the
    distinct texts, and the comments among the items where the record has none of its own.
    """
    from gleanmark.operators.nested import parsed_json

    # A record may come without a post or comments of its own.
    for name in ("post", "comments"):
        content = content if name in content.columns else content.withColumn(name, F.lit(None).cast("string"))
    rows = content.withColumn("_outer", parsed_json(F.col("post")))
    wrapped = F.try_variant_get("_outer", "$.post", "variant")
    rows = rows.withColumn("_post", F.coalesce(F.when(F.schema_of_variant(wrapped).startswith("OBJECT"), wrapped), F.col("_outer")))
    paragraph = lambda t: F.concat(F.lit("<p>"), text.escape_html(t), F.lit("</p>"))
    paragraphs = F.array_join(F.transform(report_texts(F.col("items"), F.col("text")), paragraph), "")
    link = F.when(url.is_page(F.col("canonical_url")), F.concat(F.lit('<a href="'), text.escape_html(F.col("canonical_url")), F.lit('">'), text.escape_html(F.col("canonical_url")), F.lit("</a>"))).otherwise(F.lit(""))
    signed = "author" in content.schema["items"].dataType.elementType.names
    of_item = F.get(F.filter(F.transform("items", lambda i: F.trim(i["author"])), lambda a: F.coalesce(a, F.lit("")) != ""), F.lit(0)) if signed else F.lit(None).cast("string")
    name = F.coalesce(F.when(F.trim("author") != "", F.trim("author")), of_item)
    author = F.when(name.isNotNull(), F.concat(F.lit("<address>"), text.escape_html(name), F.lit("</address>"))).otherwise(F.lit(""))
    one = lambda k, label: F.when(F.try_variant_get("_post", f"$.engagement.{k}.value", "double").isNotNull(), F.concat(F.lit(label + " "), F.try_variant_get("_post", f"$.engagement.{k}.raw", "string")))
    counts = F.array_join(F.filter(F.array(*[one(k, v) for k, v in SHOWN_COUNTS.items()]), lambda c: c.isNotNull()), " · ")
    shown = F.when(counts != "", F.concat(F.lit("<p>"), text.escape_html(counts), F.lit("</p>"))).otherwise(F.lit(""))
    answers = F.filter("items", lambda i: F.coalesce(i["kind"].isin("comment", "reply"), F.lit(False)) & (F.coalesce(F.trim(i["text"]), F.lit("")) != ""))
    said = F.when(F.coalesce(F.trim("comments"), F.lit("")) == "", F.array_join(F.transform(answers, lambda i: F.concat(F.lit("<blockquote>"), text.escape_html(i["text"]), F.lit("</blockquote>"))), ""))
    parts = [F.lit("<section><h2>"), text.escape_html(text.safe_title(F.col("title"))), F.lit("</h2>"), link, author, shown, paragraphs, F.coalesce(said, F.lit("")), F.lit("</section>")]
    return rows.select("content_id", F.concat(*parts).alias("section"))


#: Sources from which a document has a table of contents.
LEAST_NAV = 4


def report_pages(sections: DataFrame, index: DataFrame, group: str, per_page: int = 200, runs: DataFrame | None = None) -> DataFrame:
    """``group, page_no, n_sources, document``: sections of a group joined into documents of at most ``per_page`` sources.

    Sources are numbered in the order of their ids; a group of any size becomes as many documents as it needs, so that no
    task joins an unbounded text. ``index`` has ``content_id``, the group and, for the contents of documents of four sources
    and more, a ``title``. ``runs`` (the group, ``search_query, found``) are the searches, listed on the first document of theirs;
    a group's searches are few by their nature.
    """
    from gleanmark.operators.ordered import numbered

    titles = index if "title" in index.columns else index.withColumn("title", F.lit(None).cast("string"))
    paged = numbered(sections.join(titles, "content_id"), [group], ["content_id"], "source_no").withColumn("page_no", ((F.col("source_no") - 1) / per_page).cast("int") + 1)
    ordered = F.array_sort(F.collect_list(F.struct("source_no", "section", "title")))
    pages = paged.groupBy(group, "page_no").agg(F.count("*").alias("n_sources"), ordered.alias("_all"))
    if runs is not None:
        row = F.concat(F.lit("<tr><td>"), text.escape_html(F.col("search_query")), F.lit("</td><td>"), F.col("found").cast("string"), F.lit("</td></tr>"))
        table = runs.groupBy(group).agg(F.concat(F.lit("<table>"), F.array_join(F.array_sort(F.collect_list(row)), ""), F.lit("</table>")).alias("_table")).withColumn("page_no", F.lit(1))
        pages = pages.join(table, [group, "page_no"], "left")
    else:
        pages = pages.withColumn("_table", F.lit(None).cast("string"))
    link = lambda s: F.concat(F.lit('<a href="#source-'), s["source_no"].cast("string"), F.lit('">'), s["source_no"].cast("string"), F.lit(". "), text.escape_html(s["title"]), F.lit("</a>"))
    nav = F.when(F.col("n_sources") >= LEAST_NAV, F.concat(F.lit("<nav>"), F.array_join(F.transform("_all", link), ""), F.lit("</nav>"))).otherwise(F.lit(""))
    body = F.array_join(F.transform("_all", lambda s: s["section"]), "")
    return pages.select(group, "page_no", "n_sources", F.concat(nav, F.lit("<main>"), F.coalesce("_table", F.lit("")), body, F.lit("</main>")).alias("document"))


def with_media_section(document: Column, files: Column) -> Column:
    """A document with a section of media files (``array<struct<path, kind>>``) before its end; one that has a section of an
    earlier export gets the new one in place of it."""
    bare = F.regexp_replace(document, "(?s)<section id=.media.>.*?</section>", "")
    tag = lambda f: F.when(f["kind"] == "image", "img").when(f["kind"] == "audio", "audio").otherwise("video")
    rows = F.array_join(F.transform(files, lambda f: F.concat(F.lit("<"), tag(f), F.lit(' src="'), text.escape_html(url.file_link(f["path"])), F.lit('">'))), "")
    made = F.concat(F.lit('<section id="media">'), rows, F.lit("</section>"))
    return F.when(F.coalesce(F.size(files), F.lit(0)) > 0, F.concat(F.regexp_replace(bare, "</main>$", ""), made, F.lit("</main>"))).otherwise(bare)


def written_report(documents: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """``documents`` (``key, document``) that may be written: those whose last output (``written``: ``key, recorded, found``, hashes)
    is as it was left. An output that was edited since is refused and not overwritten."""
    edited = written.where("found is not null and (recorded is null or found <> recorded)").select(key)
    return documents.join(edited.distinct(), key, "left_anti")


def comment_coverage(loaded: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """``key, loaded, displayed_total, all_verified``: comments that were loaded against those a page displays."""
    out = totals.join(loaded.groupBy(key).agg(F.count("*").alias("_n")), key, "left").withColumn("loaded", F.coalesce("_n", F.lit(0)))
    return out.select(key, "loaded", "displayed_total", (F.coalesce(F.col("displayed_total") <= F.col("loaded"), F.lit(False))).alias("all_verified"))


# Limitations of a capture in the tool's own words.
LIMITATIONS = {
    "folded": "some text is still folded",
    "budget": "scroll budget reached, later content unconfirmed",
    "unconfirmed": "body not confirmed, the page shell is no evidence",
    "restricted": "page restriction: ",
}


def capture_checks(content: DataFrame) -> DataFrame:
    """``content_id, limitations, target_confirmed, valid_content``: what a capture lacks and whether it reached its page.

    Limitations are listed in a fixed order: a gate, folded items, a spent scroll budget, an unconfirmed body.
    """
    from gleanmark.functions.status import gate

    article = F.exists("items", lambda i: i["kind"] == "article")
    found = gate(url.path(F.col("resolved_url")), F.col("title"), F.col("text"), article, fragment=url.fragment(F.col("resolved_url")), platform=F.col("platform"), query=url.query(F.col("resolved_url")))
    folded = F.coalesce(F.exists("items", lambda i: F.coalesce(i["truncated"], F.lit(False))), F.lit(False))
    present = F.coalesce(F.col("completeness.target_present"), F.lit(False))
    listed = F.array(
        F.concat(F.lit(LIMITATIONS["restricted"]), found),
        F.when(folded, LIMITATIONS["folded"]),
        F.when(F.col("stop_reason") == "scroll_budget", LIMITATIONS["budget"]),
        F.when(~present, LIMITATIONS["unconfirmed"]),
    )
    same = F.coalesce(url.canonical(F.col("requested_url")) == url.canonical(F.col("resolved_url")), F.lit(False))
    valid = found.isNull() & present & (F.coalesce(F.length("text"), F.lit(0)) > 0)
    return content.select("content_id", F.filter(listed, lambda x: x.isNotNull()).alias("limitations"), same.alias("target_confirmed"), valid.alias("valid_content"))


def all_entries(*frames: DataFrame) -> DataFrame:
    """Records of several kinds of sources under each other; columns that one lacks are null."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return whole


def collection_states(results: DataFrame, collection: str, status: str, download_status: str) -> DataFrame:
    """``collection, status``: completed if every source was captured and every download is whole."""
    done = F.coalesce(F.lower(F.trim(status)).isin("captured", "completed"), F.lit(False)) & F.coalesce(F.col(download_status).isin("downloaded", "no_media"), F.lit(True))
    return results.groupBy(collection).agg(F.when(F.bool_and(done), "completed").otherwise("partial").alias("status"))


# Labels of states and reasons in a summary, and its title of a page without one.
STATE_LABELS = {"captured": "已保存", "completed": "动作完成", "partial": "部分获取", "awaiting_user": "需人工处理", "blocked": "受阻", "failed": "失败", "skipped": "未访问"}
REASON_LABELS = {"login_required": "需要登录", "verification_required": "需要验证", "rate_limited": "平台限流", "access_denied": "访问被拒绝", "operation_budget": "操作预算已用尽"}
NO_TITLE = "页面详情"


def summary_rows(content: DataFrame) -> DataFrame:
    """``content_id, title, label, chars, n_images, n_videos, summary``: what a summary says about each record.

    The text is that of the post, else of the record, else of its items without shells; the title that of the record, else of
    the post, else the search words. A record that was skipped, failed or waits says why; others give a telling line, the
    number of characters and what media was seen.
    """
    from gleanmark.operators.nested import parsed_json

    rows = content.withColumn("_outer", parsed_json(F.col("post")))
    wrapped = F.try_variant_get("_outer", "$.post", "variant")
    rows = rows.withColumn("_post", F.coalesce(F.when(F.schema_of_variant(wrapped).startswith("OBJECT"), wrapped), F.col("_outer")))
    filled = lambda c: F.when(c != "", c)
    of_post = lambda k: filled(F.try_variant_get("_post", f"$.{k}", "string"))
    of_items = F.array_join(F.transform(F.filter("items", lambda i: i.isNotNull() & (F.coalesce(i["kind"], F.lit("")) != "page_shell")), lambda i: F.coalesce(i["text"], F.lit(""))), "\n")
    listed = lambda k: F.try_variant_get("_post", f"$.{k}", "array<variant>")
    seen = lambda k: F.aggregate(F.coalesce(F.transform("items", lambda i: F.coalesce(F.size(F.filter(i["media"], lambda m: m["kind"] == k)), F.lit(0))), F.array().cast("array<int>")), F.lit(0), lambda a, n: a + F.greatest(n, F.lit(0)))
    number = lambda key, kind: F.when(F.coalesce(F.size(listed(key)), F.lit(0)) > 0, F.size(listed(key))).otherwise(seen(kind))
    rows = rows.select(
        "content_id",
        "stop_reason",
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce(of_post("text"), filled(F.col("text")), of_items, F.lit("")).alias("_text"),
        F.substring(text.clean(F.coalesce(filled(F.col("title")), of_post("title"), filled(F.col("search_query")), F.lit(NO_TITLE))), 1, 110).alias("_title"),
        number("images", "image").alias("n_images"),
        number("videos", "video").alias("n_videos"),
    ).withColumn("title", F.when(F.col("_title") == "", NO_TITLE).otherwise(F.col("_title")))
    chars, line = F.length("_text"), text.excerpt(F.col("title"), F.col("_text"))
    labels = lambda c, table, otherwise: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), otherwise)
    reason = labels(F.coalesce("stop_reason", F.lit("")), REASON_LABELS, F.when(F.coalesce(F.col("stop_reason"), F.lit("")) != "", text.clean(F.col("stop_reason"))).otherwise(F.lit("等待处理")))
    kept = F.when(chars > 0, F.concat(F.lit("保留"), chars.cast("string"), F.lit("字可见文字；"))).otherwise(F.lit("未取得可用正文；"))
    telling = F.when(line != "", F.concat(F.lit("取得“"), line, F.when(F.length(line) == 125, "…").otherwise(""), F.lit("”等可见内容"))).when(chars > 0, "取得页面可见文字").otherwise("没有取得目标正文")
    size = F.when(chars > 0, F.concat(F.lit("（约"), chars.cast("string"), F.lit("字）"))).otherwise(F.lit(""))
    media = F.when((F.col("n_images") > 0) | (F.col("n_videos") > 0), F.concat(F.lit("，观察到"), F.col("n_images").cast("string"), F.lit("张图片、"), F.col("n_videos").cast("string"), F.lit("段视频、0段音频"))).otherwise(F.lit(""))
    summary = (
        F.when(F.col("status") == "skipped", "同站前序任务受阻，本页尚未访问。")
        .when(F.col("status").isin("failed", "blocked", "awaiting_user"), F.concat(kept, reason, F.lit("。")))
        .otherwise(F.concat(telling, size, media, F.lit("。")))
    )
    return rows.select("content_id", "title", labels(F.col("status"), STATE_LABELS, F.lit("待核验")).alias("label"), chars.alias("chars"), "n_images", "n_videos", summary.alias("summary"))


def final_states(content: DataFrame, loaded: DataFrame, displayed: DataFrame) -> DataFrame:
    """``content_id, status, downgraded``: states of captures after what else they lack.

    A captured record becomes partial if one of its items is folded, a viewer of media was not resolved, or its page displays
    comments (``displayed``: ``content_id, displayed_total``) of which none was loaded (``loaded``: ``content_id`` per comment).
    """
    from gleanmark.functions.status import capture_status

    real = F.coalesce(F.col("completeness.target_present"), F.lit(False)) & (F.coalesce(F.length("text"), F.lit(0)) > 0)
    folded = F.coalesce(F.exists("items", lambda i: F.coalesce(i["truncated"], F.lit(False))), F.lit(False))
    viewer = F.coalesce(F.exists("items", lambda i: F.coalesce(F.exists(i["media"], lambda m: (m["kind"] == "media_viewer") & ~F.coalesce(m["loaded"], F.lit(False))), F.lit(False))), F.lit(False))
    some = loaded.groupBy("content_id").agg(F.count("*").alias("_loaded"))
    rows = content.join(displayed.groupBy("content_id").agg(F.max("displayed_total").alias("_shown")), "content_id", "left").join(some, "content_id", "left")
    missing = (F.coalesce("_shown", F.lit(0)) > 0) & (F.coalesce("_loaded", F.lit(0)) == 0)
    before = capture_status(F.col("stop_reason"), real)
    down = (before == "captured") & (folded | viewer | missing)
    return rows.select("content_id", F.when(down, "partial").otherwise(before).alias("status"), down.alias("downgraded"))
