"""Queries over markup, files, tasks and memory: the smaller operators, each on whole tables, with SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark.functions import network, status, text, url
from gleanmark.operators import archive, media, memory, merge, nested, ordered, pages, search, sites
from gleanmark.plans import archives, capture, posts
from gleanmark.plans.pages import _CANON, _HOST, _IS, _ONCE, _PATH, _ROUTE, _values
from gleanmark.session import shared_folder
from gleanmark.sources import evidence
from gleanmark.sources.tables import table


def _content(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "content").dropDuplicates(["content_id"])


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- addresses and markup


def text_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def safe_links(spark: SparkSession, folder: str) -> DataFrame:
    return _content(spark, folder).select("content_id", url.safe_href(F.col("resolved_url")).alias("href"))


_HREFS = ("/p/1", "q/2?x=1", "//cdn.test/3", "?r=4", "#f", "https://abs.test/5", "../u/6", "./v", "mailto:a@b.c", "javascript:x")


def resolved_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of every kind on the pages of all records."""
    rows = _content(spark, folder).select("content_id", "resolved_url", F.explode(F.array(*map(F.lit, _HREFS))).alias("link"))
    return rows.select("content_id", "link", url.resolved(F.col("resolved_url"), F.col("link")).alias("address"))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return _content(spark, folder).select("content_id", F.posexplode("items").alias("pos", "item")).where("item is not null")


def markup_links(spark: SparkSession, folder: str) -> DataFrame:
    """The links of markup that holds the items of each record."""
    one = F.concat(F.lit('<li><a class="x" href="'), text.escape_html(F.col("item.url")), F.lit('">'), text.escape_html(F.col("item.text")), F.lit("</a><a href='/rel'>r</a></li>"))
    pages_ = _items(spark, folder).groupBy("content_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", one.alias("m"))))["m"], "\n").alias("html"))
    return pages_.select("content_id", F.explode(text.links_of(F.col("html"))).alias("link"))


def markup_media(spark: SparkSession, folder: str) -> DataFrame:
    tag = lambda m: F.when(m["kind"] == "image", "img").when(m["kind"] == "audio", "audio").otherwise("video")
    html = F.array_join(F.transform(F.filter("item.media", lambda m: m["url"].isNotNull()), lambda m: F.concat(F.lit("<"), tag(m), F.lit(' loading="lazy" src="'), m["url"], F.lit('">'))), "")
    return _items(spark, folder).select("content_id", "pos", F.explode(text.media_of(html)).alias("m")).select("content_id", "pos", "m.kind", "m.url")


def safe_markup(spark: SparkSession, folder: str) -> DataFrame:
    said = text.escape_html(F.col("title"))
    html = F.concat(F.lit('<div onclick="x()" class="c"><script>bad("</p>")</script><p>'), said, F.lit('</p><a href="javascript:x()">l</a><input value="v"><iframe src="y">z</iframe></div>'))
    return _content(spark, folder).select("content_id", text.safe_markup(html).alias("markup"))


def inlined_markup(spark: SparkSession, folder: str) -> DataFrame:
    """Markup whose addresses are replaced by the hashes of what they name; one is the beginning of another."""
    html = F.concat(F.lit('<img src="'), "canonical_url", F.lit('"><img src="'), "canonical_url", F.lit('/more">'))
    assets = F.create_map(F.col("canonical_url"), F.concat(F.lit("data:"), F.md5("canonical_url")), F.concat("canonical_url", F.lit("/more")), F.lit("data:more"))
    return _content(spark, folder).where("canonical_url <> ''").select("content_id", media.inlined(html, assets).alias("markup"))


# --- candidates


def _links(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of items, every other one behind a search engine's redirect."""
    coded = F.translate(F.regexp_replace(F.base64(F.col("item.url").cast("binary")), "[\\r\\n=]", ""), "+/", "-_")
    link = F.when(F.col("pos") % 2 == 1, F.concat(F.lit("https://www.bing.com/ck/a?x=1&u=a1"), coded)).otherwise(F.col("item.url"))
    rows = _items(spark, folder).where("item.url is not null").select("content_id", "pos", link.alias("link"))
    return rows.join(_content(spark, folder).select("content_id", "requested_url", F.col("platform").alias("site_id")), "content_id").withColumn("place", F.col("content_id") * 100_000 + F.col("pos"))


def site_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates on the hosts of each record's site; one site has a pattern for its pages."""
    rows = _links(spark, folder).join(table(spark, folder, "sites").select("site_id", "domains", F.when(F.col("site_id") == "murmel", "/(POST|guide)/").alias("detail")), "site_id")
    return search.candidates(rows, "requested_url", "link", "place", F.col("domains"), F.col("detail")).select("place", "canonical")


def external_candidates(spark: SparkSession, folder: str) -> DataFrame:
    more = _content(spark, folder).where("content_id % 5 = 0").select("content_id", (F.col("content_id") * 100_000 + 99_999).alias("place"), "requested_url", F.explode(F.array(*map(F.lit, _SERVICE))).alias("link"))
    rows = _links(spark, folder).select("place", "requested_url", "link").unionByName(more.select((F.col("place") + F.length("link") * 1_000_000_000_000).alias("place"), "requested_url", "link"))
    return search.candidates(rows, "requested_url", "link", "place", external=True).select("place", "canonical")


_SERVICE = ("https://www.google.com/search?q=a", "https://baidu.com/s?wd=abc", "https://news.test/privacy", "https://news.test/help/faq", "https://news.test/", "https://news.test/#/route", "https://news.test/helpful", "https://so.com/abcdef")


def learned_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose source and verified host are a correction that was seen to work."""
    log = table(spark, folder, "experience_log")
    return log.select("event_id", "source_host", "verified_host").distinct().join(search.verified_corrections(log), ["source_host", "verified_host"], "left_semi").select("event_id")


def search_states(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "experience_log").distinct().withColumn("s", F.lower(F.trim("status")))
    per = log.where("platform is not null").groupBy("platform").agg(F.sum("candidates").alias("found"), F.lit(2).alias("wanted"), F.count_if(F.col("s").isin("captured", "completed")).alias("got"), F.bool_or(F.col("s") == "awaiting_user").alias("waits"))
    return search.search_states(per, "platform", "found", "wanted", "got", "waits")


def category_sites(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sites").where(F.col("category") == "technical").select("site_id", "site_name")


def job_lanes(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs by queue: the site of their host, or the host itself."""
    rows = table(spark, folder, "batch_rows").select("batch_file", "idx", url.host(F.col("url")).alias("host")).distinct().where("host is not null")
    # Every third job is sent to a host that no site has.
    rows = rows.withColumn("host", F.when(F.col("idx") % 3 == 0, F.concat("host", F.lit(".other"))).otherwise(F.col("host")))
    known = sites.with_site(rows, "host", table(spark, folder, "sites"))
    return known.select(ordered.lane_of(F.col("site"), F.col("host")).alias("lane")).groupBy("lane").agg(F.count("*").alias("n"))


# --- files


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "manifest").select("content_id", "file_path", archive.digest(F.col("sha256")).alias("sha256"), "bytes", "batch_no", "primary_file").distinct()


def manifest_check(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the manifests against a second inventory, in which some are missing and some have changed."""
    files = _files(spark, folder)
    actual = files.where("content_id % 7 <> 0 or bytes % 2 = 0").withColumn("sha256", F.when(F.col("content_id") % 11 == 0, F.sha2("file_path", 256)).otherwise(F.col("sha256")))
    return archive.verification(files, actual, "content_id", "file_path", "sha256")


def media_downloads_all(spark: SparkSession, folder: str) -> DataFrame:
    """States of the downloads of all records, those without media too, by the names of the files."""
    content = table(spark, folder, "content")
    wanted = nested.flat_entities(content).where("entity = 'media'").select("content_id", F.regexp_extract("child_id", "([^/]+)$", 1).alias("name"))
    owners = content.select("content_id").distinct().withColumn("name", F.lit(None).cast("string"))
    got = table(spark, folder, "manifest").where("sha256 is not null").select("content_id", F.regexp_extract("file_path", "([^/]+)$", 1).alias("name"))
    return archive.download_states(wanted.unionByName(owners), got, "content_id", ["name"])


def standalone_media(spark: SparkSession, folder: str) -> DataFrame:
    """Media of items that no post of the record has."""
    all_ = nested.flat_entities(table(spark, folder, "content"))
    return archive.missing_rows(all_.where("entity = 'media'").select("content_id", F.col("child_id").alias("url")), all_.where("entity in ('image', 'video')").select("content_id", F.col("child_id").alias("url")), ["content_id", "url"])


def undelivered_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Raw files whose content no file outside of raw has."""
    files = _files(spark, folder).where("sha256 is not null")
    raw = F.startswith("file_path", F.lit("raw/"))
    return archive.missing_rows(files.where(raw), files.where(~raw), ["content_id", "sha256"])


def image_downloads(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.lower(F.col("file_path")).rlike("\\.(png|jpe?g|webp)$"), "image").otherwise("other")
    files = _files(spark, folder).select("content_id", F.regexp_extract("file_path", "([^/]+)$", 1).alias("name"), kind.alias("kind"), "file_path")
    wanted = nested.flat_entities(table(spark, folder, "content")).where("entity = 'media'").select("content_id", F.regexp_extract("child_id", "([^/]+)$", 1).alias("name"), F.lit("image").alias("kind")).distinct()
    return archive.with_downloads(wanted, files, "content_id", "name")


def viewer_assets(spark: SparkSession, folder: str) -> DataFrame:
    """A viewer for every media of items, resolved by those that were loaded."""
    rows = _items(spark, folder).select("content_id", "pos", F.posexplode("item.media").alias("at", "m")).where("m.url is not null").select("content_id", (F.col("pos") * 1_000 + F.col("at")).alias("place"), "m.url", "m.loaded")
    assets = rows.select("content_id", F.lit("image").alias("kind"), "url", F.when(F.col("loaded"), F.concat(F.lit("view:"), "url")).alias("viewer_url"), "place")
    viewers = rows.select("content_id", F.lit("media_viewer").alias("kind"), F.concat(F.lit("v"), "url").alias("url"), F.concat(F.lit("view:"), "url").alias("viewer_url"), "place").distinct()
    return media.resolved_viewers(assets.unionByName(viewers), "content_id").select("content_id", "place", "asset_url")


def linked_media(spark: SparkSession, folder: str) -> DataFrame:
    """Links of posts by the names of their images, with the media of items of the same name."""
    all_ = nested.flat_entities(table(spark, folder, "content"))
    name = F.regexp_extract("child_id", "([^/]+)$", 1).alias("media_id")
    links = all_.where("entity = 'image'").select("content_id", name).distinct()
    return media.linked_media(links, all_.where("entity = 'media'").select("content_id", name, F.col("child_id").alias("url")).groupBy("content_id", "media_id").agg(F.min("url").alias("url")), "content_id")


def archive_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Archives three folders deep and deliveries in some of the folders above them."""
    page = _files(spark, folder).where("primary_file <> '' and endswith(file_path, primary_file) and sha256 is not null").groupBy("content_id").agg(F.min("primary_file").alias("name"), F.min("sha256").alias("sha256"))
    archives = page.select(F.concat(F.lit("t"), F.col("content_id") % 9, F.lit("/s"), F.col("content_id") % 4, F.lit("/"), "content_id").alias("path"), "name", "sha256", "content_id")
    near = archives.where("content_id % 2 = 0").select(F.concat(F.lit("t"), F.col("content_id") % 9, F.lit("/s"), F.col("content_id") % 4).alias("folder"), "name", "sha256")
    far = archives.where("content_id % 3 = 0").select(F.concat(F.lit("t"), F.col("content_id") % 9).alias("folder"), "name", "sha256")
    return archive.nearest_delivery(archives.drop("content_id"), near.unionByName(far), "path", "name", "sha256").select("path", "delivery_folder")


def valid_plans(spark: SparkSession, folder: str) -> DataFrame:
    """Planned files that are there with the planned hash, after some files changed."""
    files = _files(spark, folder).select(F.concat_ws("/", "content_id", "file_path").alias("path"), "sha256", "bytes").where("sha256 is not null")
    return archive.still_valid(files.where("bytes >= 100000"), files.where("bytes % 3 <> 0"), "path", "sha256").select("path", "sha256").distinct()


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    one = _files(spark, folder).groupBy(F.concat_ws("/", "content_id", "file_path").alias("path")).agg(F.min("sha256").alias("sha256"), F.min("bytes").alias("bytes")).where("sha256 is not null")
    after = one.where("bytes % 5 <> 0").withColumn("sha256", F.when(F.col("bytes") % 3 == 0, F.lit("0" * 64)).otherwise(F.col("sha256")))
    return archive.changed_files(one.where("bytes % 7 <> 0"), after).groupBy("change").agg(F.count("*").alias("n"))


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Names of sites written as files, and the inventory of these."""
    place = _scratch(spark, "inventory")
    table(spark, folder, "sites").select("site_id", "site_name").repartition(24, "site_id").write.partitionBy("site_id").text(place)
    return archive.inventory(spark, place, "*.txt").select(F.regexp_extract("path", "site_id=([^/]+)", 1).alias("site_id"), "bytes", "sha256")


def safe_paths(spark: SparkSession, folder: str) -> DataFrame:
    paths = table(spark, folder, "manifest").select("file_path").distinct()
    cases = F.array(*map(F.lit, ("", "/", "../", "a/../", "C:/", "..x/")))
    return paths.select(F.explode(F.transform(cases, lambda c: F.concat(c, "file_path"))).alias("path")).select("path", archive.is_inside(F.lit("root"), F.col("path")).alias("inside")).distinct()


def copy_ranks(spark: SparkSession, folder: str) -> DataFrame:
    files = archive.image_files(_files(spark, folder).select(F.concat_ws("/", "content_id", F.when(F.col("content_id") % 5 == 0, F.lit("Backup")), "file_path").alias("path"), "sha256", "bytes").where("sha256 is not null"), "path")
    return archive.rank_copies(files.distinct(), "sha256", "bytes", "path").select("path", "copy_no")


def next_serials(spark: SparkSession, folder: str) -> DataFrame:
    names = _content(spark, folder).select("platform", F.concat((F.col("content_id") % 1_000).cast("string"), F.lit("_"), "kind").alias("name"))
    return ordered.next_serial(names, ["platform"], "name")


def planned_files(spark: SparkSession, folder: str) -> DataFrame:
    plan = archive.prunable(table(spark, folder, "manifest"), _content(spark, folder))
    return archive.planned(plan, "content_id", "file_path").groupBy("content_id").agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("bytes"))


_MANIFEST = "content_id long, files array<struct<path: string, sha256: string>>"


def manifests_on_disk(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests written as JSON, found again and taken apart."""
    place = _scratch(spark, "manifests")
    files = _files(spark, folder).where("file_path is not null").groupBy("content_id").agg(F.array_sort(F.collect_set(F.struct(F.col("file_path").alias("path"), "sha256"))).alias("files"))
    files.write.json(place)
    return archive.manifests(spark, place, _MANIFEST).select("content_id", F.explode_outer("files").alias("f")).select("content_id", F.col("f.path").alias("file_path"), "f.sha256")


def readable_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of verified archives with valid content."""
    return archive.readable(_content(spark, folder), manifest_check(spark, folder)).select("content_id")


def run_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results of batch runs, taken out of the record of each run; a run without results gives one row."""
    rows = table(spark, folder, "batch_rows").dropDuplicates(["batch_file", "idx"])
    kept = F.collect_list(F.when(F.coalesce(F.lower(F.trim("status")), F.lit("")) != "skipped", F.struct("idx", "url", "status")))
    runs = rows.groupBy("batch_file").agg(kept.alias("results")).unionByName(spark.createDataFrame([("none", [])], "batch_file string, results array<struct<idx: long, url: string, status: string>>"))
    return runs.select("batch_file", F.explode_outer("results").alias("r")).select("batch_file", "r.idx", "r.url", "r.status")


# --- evidence


_RECORD = "content_id long, status string, url string"


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Records as files of evidence: some in folders that hold none, some broken."""
    place = _scratch(spark, "evidence")
    rows = _content(spark, folder).select("content_id", "status", F.col("canonical_url").alias("url"))
    line = F.when(F.col("content_id") % 13 == 0, F.concat(F.lit('{"content_id": '), "content_id", F.lit(', "status": "broken'))).otherwise(F.to_json(F.struct("content_id", "status", "url")))
    # One file for each of a few folders; the scan is by file, so a file holds one record a line here.
    rows.select(F.when(F.col("content_id") % 5 == 0, "snapshots").otherwise("tasks").alias("place"), line.alias("value")).write.partitionBy("place").text(place)
    return spark.read.schema(_RECORD + ", _broken string").option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(place).select("*", F.col("_metadata.file_path").alias("path"))


def evidence_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the evidence, broken ones apart, folders of snapshots left out."""
    rows = _evidence(spark, folder).where(~F.col("path").rlike("[/=](" + "|".join(evidence.SKIPPED_FOLDERS) + ")/"))
    return rows.select(F.when(F.col("_broken").isNull(), F.col("content_id")).alias("content_id"), F.when(F.col("_broken").isNull(), F.col("status")).alias("status"), F.col("_broken").isNotNull().alias("broken")).groupBy("broken", "status").agg(F.count("*").alias("n"), F.sum("content_id").alias("ids"))


def job_list(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs found in the urls of batches written as free text."""
    place = _scratch(spark, "jobs")
    rows = table(spark, folder, "batch_rows").where("url is not null").select("url").distinct().orderBy("url")
    rows.agg(F.concat(F.lit("see "), F.array_join(F.array_sort(F.collect_set("url")), " and\n")).alias("value")).coalesce(1).write.text(place)
    return evidence.jobs_in(spark, place).select(url.canonical(F.col("url")).alias("page"))


def appended_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Rounds of records added one after the other and then replaced for some batches: what the table holds in the end."""
    place = _scratch(spark, "rounds")
    rows = _content(spark, folder).select("content_id", "status", F.coalesce("batch_no", F.lit(0)).alias("batch_no"))
    for k in (0, 1):
        evidence.append_partitioned(rows.where(F.col("content_id") % 2 == k), place, "batch_no")
    evidence.replace_partitions(rows.where("batch_no in (2, 3)").withColumn("status", F.lit("replaced")), place, "batch_no")
    return spark.read.parquet(place).groupBy("batch_no", "status").agg(F.count("*").alias("n")).withColumn("batch_no", F.col("batch_no").cast("int"))


# --- merges and memory


def author_items(spark: SparkSession, folder: str) -> DataFrame:
    return _content(spark, folder).select(F.explode(merge.without_answers(F.col("items"))).alias("i")).groupBy("i.kind").agg(F.count("*").alias("n")).select("kind", "n")


def refreshed_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results of batches with the later states of their records, where these no longer wait."""
    results = table(spark, folder, "batch_rows").where("content_id is not null").groupBy("content_id").agg(F.min("status").alias("status"))
    return merge.refreshed(results, _content(spark, folder).select("content_id", "status"), "content_id")


def noted_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return memory.noted_lines(lines.select((F.col("doc_id") % 3).cast("int").alias("file_no"), (F.col("doc_id") * 10_000 + F.col("pos")).alias("line_no"), "text"), "ferry bakery")


_SEEDS = (("murmel", "native"), ("findry", "public_index"), ("murmel", "public_alternate"))


def route_hints(spark: SparkSession, folder: str) -> DataFrame:
    return memory.route_hints(spark.createDataFrame(_SEEDS, "platform string, route_kind string"), "murmel").join(table(spark, folder, "sites").select(F.col("site_id").alias("platform"), "category"), "platform")


def _pending(spark: SparkSession, folder: str) -> DataFrame:
    place = _scratch(spark, "pending")
    waiting = table(spark, folder, "batch_rows").where("lower(trim(status)) = 'awaiting_user' and url is not null").groupBy("batch_file").agg(F.min("idx").alias("idx"), F.min_by(F.when(F.col("idx") % 2 == 0, F.col("url")), "idx").alias("page"))
    waiting.select(F.col("batch_file").alias("task_id"), "page").write.json(place)
    return memory.pending_tasks(spark, place, "task_id string, page string")


def pending_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return _pending(spark, folder)


def checked_tabs(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "batch_rows").select(F.col("batch_file").alias("task_id")).distinct()
    return memory.with_tabs(results, _pending(spark, folder), "task_id")


def matrix_totals(spark: SparkSession, folder: str) -> DataFrame:
    return memory.matrix_totals(table(spark, folder, "experience_log").dropDuplicates(["event_id"]).withColumn("status", F.lower(F.trim("status"))), "candidates", "status")


def preferences(spark: SparkSession, folder: str) -> DataFrame:
    saved = table(spark, folder, "sites").select("site_id", F.when(F.col("account"), "background").alias("window"), F.when(F.col("public_index"), "md").alias("format"))
    return memory.with_preferences(saved, "site_id")


def display_names(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "sites").select(F.explode("domains").alias("domain"), "site_name", F.col("site_id").alias("place")).where("domain is not null")
    entries = _content(spark, folder).select("content_id", url.host(F.col("resolved_url")).alias("host"), F.coalesce("title", F.lit("")).alias("title"))
    return memory.with_display_names(entries, "host", names.groupBy("domain").agg(F.min("site_name").alias("site_name"), F.min("place").alias("place")), "title").select("content_id", "site")


def listed_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred entries of the summary, numbered in its order."""
    rows = _content(spark, folder).select("content_id", url.host(F.col("resolved_url")).alias("host"), F.col("captured_at").alias("at")).where("host <> ''")
    first = memory.listed_entries(rows, "host", "at", "content_id").limit(100)
    return first.select("content_id", "host", "at")


# --- pages


def page_items(spark: SparkSession, folder: str) -> DataFrame:
    rows = _content(spark, folder)
    found = pages.emitted_items(rows, F.col("completeness.target_present"), F.col("platform").isin(*_VIDEO_SITES), F.coalesce(F.col("search_query"), F.lit("")) != "")
    return found.select("content_id", "item_no", "kind", F.length("text").alias("n_chars"))


_VIDEO_SITES = ("clipharbor", "reelmoor")


def transcript_cues(spark: SparkSession, folder: str) -> DataFrame:
    rows = _content(spark, folder).select("content_id", F.transform("items", lambda i: F.struct(i["time"].alias("time"), i["text"].alias("text"))).alias("cues"))
    return pages.transcript_cues(rows, "content_id", "cues").select("content_id", "cue_no", "time", F.length("text").alias("n_chars"))


def article_media(spark: SparkSession, folder: str) -> DataFrame:
    """Images of posts as if they were the media of an article deep in a response, the first one its cover as well."""
    images = nested.flat_entities(table(spark, folder, "content")).where("entity = 'image'").select("content_id", "child_id").distinct()
    entity = F.concat(F.lit('{"media_id":"'), F.md5("child_id"), F.lit('","media_info":{"original_img_url":"https://'), F.when(F.length("child_id") % 3 == 0, "other.test").otherwise("pbs.test"), F.lit("/"), F.md5("child_id"), F.lit('"}}'))
    per = images.select("content_id", entity.alias("e")).groupBy("content_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    body = F.concat(F.lit('{"data":[{"x":{"rest_id":"'), "content_id", F.lit('","article":{"article_results":{"result":{"media_entities":['), F.array_join("es", ","), F.lit('],"cover_media":'), F.replace(F.get("es", F.lit(0)), F.lit("other.test"), F.lit("pbs.test")), F.lit('}}}}},{"rest_id":"0","article":{}}]}'))
    return pages.article_media(per.select("content_id", body.alias("body"), F.col("content_id").cast("string").alias("wanted")), "content_id", "body", "wanted", "pbs.test")


def player_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Streams of a player made of the numbers of each record."""
    one = lambda k: F.struct(F.array(F.concat(F.lit("https://peer.test/"), F.lit(k)), F.when(F.col("content_id") % (k + 2) == 0, F.concat(F.lit("https://a.video.test/"), F.lit(k))).otherwise(F.lit("http://a.video.test/x"))).alias("urls"), F.when((F.col("content_id") + k) % 3 == 0, 12).otherwise(7).alias("codec"), (F.lit(240) * (k + 1)).alias("height"))
    chosen = pages.player_stream(F.array(*[one(k) for k in range(4)]), "[^/]+\\.video\\.test", F.lit(7))
    return _content(spark, folder).select("content_id", chosen.alias("s")).where("s is not null").select("content_id", "s.url", "s.height")


def counts_of_state(spark: SparkSession, folder: str) -> DataFrame:
    shown = media.engagement(_content(spark, folder)).where("value is not null").groupBy("content_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("shown"))
    state = F.create_map(F.lit("likes"), F.when(F.col("content_id") % 2 == 0, F.col("content_id").cast("double")), F.lit("own"), F.lit(1.0))
    return shown.select("content_id", F.explode(pages.overridden_counts(F.col("shown"), state)).alias("metric", "value"))


def fallback_reasons(spark: SparkSession, folder: str) -> DataFrame:
    rows = _content(spark, folder)
    found = status.fallback_reason(F.lower(F.trim("status")), F.col("stop_reason"), F.when(F.col("content_id") % 50 == 0, "platform_page"), F.col("url_check.valid_content"))
    return rows.select(found.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def browser_agents(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sites").select("site_id", F.explode(F.array(*[F.concat(F.lit(a), "site_id", F.lit(b)) for a, b in _AGENTS])).alias("agent"))
    return rows.select("agent", network.desktop_agent(F.col("agent")).alias("desktop"))


_AGENTS = (("Mozilla ", " HeadlessChrome/120.0.1"), ("Chrome/99 ", ""), ("Chrome/x ", ""), ("Chrome/9\n", ""), ("Firefox ", ""))


def proxies(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sites").select(F.explode(F.array(*[F.concat(F.lit(a), "site_id", F.lit(b)) for a, b in _PROXIES])).alias("proxy"))
    return rows.select("proxy", network.proxy_server(F.col("proxy")).alias("p")).select("proxy", "p.server", "p.username", "p.password")


_PROXIES = (("http://", ":8080"), ("socks5://u%40x:p%3A@", ".test:1"), ("HTTPS://me@", "/path"), ("ftp://", ""), ("", ":1"))


QUERIES = {
    f.__name__: f
    for f in (
        text_hashes, safe_links, resolved_links, markup_links, markup_media, safe_markup, inlined_markup, site_candidates, external_candidates, learned_corrections, search_states, category_sites, job_lanes,
        manifest_check, media_downloads_all, standalone_media, undelivered_parts, image_downloads, viewer_assets, linked_media, archive_deliveries, valid_plans, changed_files, file_inventory, safe_paths,
        copy_ranks, next_serials, planned_files, manifests_on_disk, readable_archives, run_results, evidence_records, job_list, appended_rounds, author_items, refreshed_results, noted_lines, route_hints,
        pending_tasks, checked_tabs, matrix_totals, preferences, display_names, listed_entries, page_items, transcript_cues, article_media, player_streams, counts_of_state, fallback_reasons, browser_agents, proxies,
    )
}

_DIG = "nullif(regexp_extract(lower(trim(sha256)), '([0-9a-f]{64})$', 1), '')"
_FILES = f"files as (select distinct content_id, file_path, {_DIG} as sha256, bytes, batch_no, primary_file from manifest)"
_ITEMS = f"items as (select content_id, i as item, (p - 1)::int as pos from (select content_id, unnest(items) as i, generate_subscripts(items, 1) as p from {_ONCE}) where i is not null)"
_ESC = "replace(replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_ENTITIES = f"entities as ({capture.SQL['p2_found'].replace('with recursive', 'with recursive', 1)})"
_FOUND = f"""rows as (select place, requested_url, target, {{extra}} {_CANON} as canonical, {_HOST} as host, {_PATH} as path, {_ROUTE} as route from (select *, target as u from ({{source}}))),
        asked as (select distinct requested_url, {_CANON} as self from (select *, requested_url as u from (select requested_url from {_ONCE}))),
        kept as (select r.*, row_number() over (partition by r.requested_url, canonical order by place) as n from rows r left join asked a on a.requested_url = r.requested_url
          where canonical is not null and {{where}} and not regexp_matches(path, '(?i)/(login|signin|signup|privacy|terms|help|about)([/?#]|$)') and not (path in ('', '/') and route = '') and canonical <> coalesce(self, ''))
        select place, canonical from kept where n = 1"""
_LINKED = f"select l.content_id, l.content_id * 100000 + pos as place, requested_url, platform, item.url as target from items l join {_ONCE} c on c.content_id = l.content_id where item.url is not null"
_NAME = "regexp_extract({c}, '([^/]+)$', 1)"
SQL = {
    "text_hashes": "select doc_id, sha256(text) as sha256 from documents",
    "safe_links": f"select content_id, case when {_IS} then {_ESC.format(c='trim(u)')} else '' end as href from (select content_id, resolved_url as u from {_ONCE})",
    "resolved_links": f"""with p as (select content_id, u, {_IS} as ok, regexp_extract(trim(u), '(?i)^(https?)://', 1) as s, regexp_replace(lower(regexp_extract(trim(u), '(?i)^https?://([^/?#@\\\\\\s]+)', 1)), case when lower(u) like 'http:%' then ':80$' else ':443$' end, '') as a, case when {_PATH} = '' then '/' else {_PATH} end as path from (select content_id, resolved_url as u from {_ONCE})),
        d as (select *, lower(s) || '://' || a as o, regexp_replace(path, '[^/]*$', '') as dir, case when len(string_split(path, '/')) > 2 then regexp_replace(path, '[^/]*/[^/]*$', '') else '/' end as up from p)
        select content_id, link, case when not ok then null when link = '/p/1' then o || link when link = 'q/2?x=1' then o || dir || link when link = '//cdn.test/3' then lower(s) || ':' || link when link = '?r=4' then o || path || link when link = '#f' then regexp_extract(trim(u), '^([^#]*)', 1) || link
          when link = 'https://abs.test/5' then link when link = '../u/6' then o || up || 'u/6' when link = './v' then o || dir || 'v' end as address from d, (values {_values([(h,) for h in _HREFS])}) v(link)""",
    "markup_links": f"with {_ITEMS} select distinct content_id, {_ESC.format(c='item.url')} as link from items where regexp_matches(item.url, '^https?://')",
    "markup_media": f"with {_ITEMS} select distinct content_id, pos, case m.kind when 'image' then 'img' when 'audio' then 'audio' else 'video' end as kind, m.url as url from (select content_id, pos, unnest(item.media) as m from items) where regexp_matches(m.url, '^https?://')",
    "safe_markup": f"select content_id, '<div class=\"c\"><p>' || {_ESC.format(c='title')} || '</p><a>l</a></div>' as markup from {_ONCE}",
    "inlined_markup": f"select content_id, '<img src=\"data:' || md5(canonical_url) || '\"><img src=\"data:more\">' as markup from {_ONCE} where canonical_url <> ''",
    "site_candidates": f"with {_ITEMS}, " + _FOUND.format(extra="platform,", source=_LINKED, where="exists (select 1 from (select site_id, lower(unnest(domains)) as d from sites) s where s.site_id = r.platform and (r.host = d or ends_with(r.host, '.' || d))) and (r.platform <> 'murmel' or regexp_matches(target, '(?i)/(POST|guide)/'))"),
    "external_candidates": f"with {_ITEMS}, " + _FOUND.format(
        extra="", source=f"select place, requested_url, target from ({_LINKED}) union all select content_id * 100000 + 99999 + length(target) * 1000000000000, requested_url, target from {_ONCE}, (values {_values([(s,) for s in _SERVICE])}) v(target) where content_id % 5 = 0",
        where="not regexp_matches(r.host, '(^|\\.)(bing\\.com|google\\.com|sogou\\.com|so\\.com|duckduckgo\\.com)$')",
    ),
    "learned_corrections": "select distinct event_id from experience_log e where exists (select 1 from experience_log v where v.route_kind = 'source_url_correction' and v.valid_content and v.verified_host is not null and v.source_host = e.source_host and v.verified_host = e.verified_host)",
    "search_states": """with p as (select platform, coalesce(sum(candidates), 0) > 0 as found, count(*) filter (lower(trim(status)) in ('captured', 'completed')) as got, coalesce(bool_or(lower(trim(status)) = 'awaiting_user'), false) as waits from (select distinct * from experience_log) where platform is not null group by 1)
        select platform, case when found then 'candidates_found' when waits then 'awaiting_user' else 'no_verified_candidates' end as search_status, case when waits and not found then 'awaiting_user' when not found or got < 2 then 'partial' else 'completed' end as status from p""",
    "category_sites": "select site_id, site_name from sites where category = 'technical'",
    "job_lanes": f"""with r as (select distinct batch_file, idx, case when idx % 3 = 0 then {_HOST} || '.other' else {_HOST} end as host from (select *, url as u from batch_rows) where {_HOST} is not null and url is not null),
        d as (select site_id, lower(unnest(domains)) as d from sites), f as (select h.host, arg_max(site_id, length(d)) as site from (select distinct host from r) h join d on h.host = d or ends_with(h.host, '.' || d) group by 1)
        select coalesce(site, r.host) as lane, count(*) as n from r left join f on f.host = r.host group by 1""",
    "manifest_check": f"""with {_FILES}, w as (select distinct content_id, file_path, sha256 from files), a as (select distinct content_id, file_path, case when content_id % 11 = 0 then sha256(file_path) else sha256 end as sha256 from files where content_id % 7 <> 0 or bytes % 2 = 0),
        f as (select distinct content_id, file_path from w where not exists (select 1 from a where a.content_id = w.content_id and a.file_path = w.file_path and a.sha256 = w.sha256))
        select w.content_id, count(distinct file_path) as n_files, coalesce(any_value(n), 0) as n_failed, coalesce(any_value(n), 0) = 0 as ok from w left join (select content_id, count(*) as n from f group by 1) k on k.content_id = w.content_id group by 1""",
    "media_downloads_all": f"""with {_ENTITIES}, w as (select distinct content_id, {_NAME.format(c='child_id')} as name from entities where entity = 'media'), g as (select distinct content_id, {_NAME.format(c='file_path')} as name from manifest where sha256 is not null)
        select o.content_id, count(w.name) as n_wanted, count(w.name) - count(g.name) as n_missing, case when count(w.name) = 0 then 'no_media' when count(w.name) = count(g.name) then 'downloaded' else 'partial' end as download_status
        from (select distinct content_id from content) o left join w on w.content_id = o.content_id left join g on g.content_id = w.content_id and g.name = w.name group by 1""",
    "standalone_media": f"with {_ENTITIES} select content_id, child_id as url from entities where entity = 'media' except select content_id, child_id from entities where entity in ('image', 'video')",
    "undelivered_parts": f"with {_FILES} select content_id, sha256 from files where sha256 is not null and file_path like 'raw/%' except select content_id, sha256 from files where file_path not like 'raw/%'",
    "image_downloads": f"""with {_ENTITIES}, w as (select distinct content_id, {_NAME.format(c='child_id')} as name from entities where entity = 'media'), f as (select content_id, {_NAME.format(c='file_path')} as name, min(file_path) as file_path from manifest where regexp_matches(lower(file_path), '\\.(png|jpe?g|webp)$') group by 1, 2)
        select w.content_id, w.name, 'image' as kind, f.file_path from w left join f on f.content_id = w.content_id and f.name = w.name""",
    "viewer_assets": f"""with {_ITEMS}, m as (select content_id, pos * 1000 + pl - 1 as place, x.url as url, x.loaded as loaded from (select content_id, pos, unnest(item.media) as x, generate_subscripts(item.media, 1) as pl from items) where x.url is not null)
        select distinct content_id, place::int as place, case when exists (select 1 from m o where o.content_id = m.content_id and o.url = m.url and o.loaded) then url end as asset_url from m""",
    "linked_media": f"""with {_ENTITIES}, l as (select distinct content_id, {_NAME.format(c='child_id')} as media_id from entities where entity = 'image'), m as (select content_id, {_NAME.format(c='child_id')} as media_id, min(child_id) as url from entities where entity = 'media' group by 1, 2)
        select l.content_id, l.media_id, m.url from l left join m on m.content_id = l.content_id and m.media_id = l.media_id""",
    "archive_deliveries": f"""with {_FILES}, p as (select content_id, min(primary_file) as name, min(sha256) as sha256 from files where primary_file <> '' and ends_with(file_path, primary_file) and sha256 is not null group by 1)
        select 't' || content_id % 9 || '/s' || content_id % 4 || '/' || content_id as path, case when exists (select 1 from p q where q.content_id % 2 = 0 and q.content_id % 9 = p.content_id % 9 and q.content_id % 4 = p.content_id % 4 and q.name = p.name and q.sha256 = p.sha256) then 't' || content_id % 9 || '/s' || content_id % 4
          when exists (select 1 from p q where q.content_id % 3 = 0 and q.content_id % 9 = p.content_id % 9 and q.name = p.name and q.sha256 = p.sha256) then 't' || content_id % 9 end as delivery_folder from p""",
    "valid_plans": f"with {_FILES}, p as (select distinct content_id || '/' || file_path as path, sha256, bytes from files where sha256 is not null) select distinct path, sha256 from p where bytes >= 100000 and exists (select 1 from p q where q.path = p.path and q.sha256 = p.sha256 and q.bytes % 3 <> 0)",
    "changed_files": f"""with {_FILES}, o as (select content_id || '/' || file_path as path, min(sha256) as sha256, min(bytes) as bytes from files group by 1 having min(sha256) is not null)
        select case when bytes % 7 = 0 then 'added' when bytes % 5 = 0 then 'removed' else 'changed' end as change, count(*) as n from o where (bytes % 7 = 0) <> (bytes % 5 = 0) or (bytes % 7 <> 0 and bytes % 5 <> 0 and bytes % 3 = 0) group by 1""",
    "file_inventory": "select site_id, (strlen(site_name) + 1)::bigint as bytes, sha256(site_name || chr(10)) as sha256 from sites",
    "safe_paths": "select distinct c || file_path as path, c in ('', '..x/') and not regexp_matches(file_path, '^(/|[A-Za-z]:|\\\\)') and not list_contains(string_split(file_path, '/'), '..') as inside from manifest, (values (''), ('/'), ('../'), ('a/../'), ('C:/'), ('..x/')) v(c) where file_path is not null",
    "copy_ranks": f"""with {_FILES}, p as (select distinct concat_ws('/', content_id, case when content_id % 5 = 0 then 'Backup' end, file_path) as path, sha256, bytes from files where sha256 is not null)
        select path, row_number() over (partition by bytes, sha256 order by regexp_matches(lower(path), '(对比|备份|旧版|copy|backup|duplicate)')::int, len(string_split(path, '/')), lower(path), path)::int as copy_no from p where regexp_matches(lower(path), '\\.(png|jpe?g|webp)$')""",
    "next_serials": f"select platform, (coalesce(max(content_id % 1000) filter (kind is not null), 0) + 1)::int as next_serial from {_ONCE} group by 1",
    "manifests_on_disk": f"with {_FILES} select distinct content_id, file_path, sha256 from files where file_path is not null",
    "run_results": "select batch_file, idx, url, status from (select distinct on (batch_file, idx) * from batch_rows order by batch_file, idx) where coalesce(lower(trim(status)), '') <> 'skipped' union all select batch_file, null, null, null from batch_rows group by 1 having bool_and(coalesce(lower(trim(status)), '') = 'skipped') union all select 'none', null, null, null",
    "evidence_records": f"select content_id % 13 = 0 as broken, case when content_id % 13 <> 0 then status end as status, count(*) as n, sum(case when content_id % 13 <> 0 then content_id end)::bigint as ids from {_ONCE} where content_id % 5 <> 0 group by 1, 2",
    "job_list": f"select distinct {_CANON} as page from (select distinct url as u from batch_rows where url is not null) where regexp_matches(u, '^https?://') and {_CANON} is not null",
    "appended_rounds": f"select b as batch_no, case when b in (2, 3) then 'replaced' else status end as status, count(*) as n from (select coalesce(batch_no, 0)::int as b, status from {_ONCE}) group by 1, 2",
    "author_items": f"with {_ITEMS} select item.kind as kind, count(*) as n from items where coalesce(item.kind, '') <> 'reply' group by 1",
    "refreshed_results": f"select r.content_id, case when c.status <> 'awaiting_user' then c.status else r.status end as status from (select content_id, min(status) as status from batch_rows where content_id is not null group by 1) r left join {_ONCE} c on c.content_id = r.content_id",
    "noted_lines": """with l as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)
        select (doc_id % 3)::int as file_no, doc_id * 10000 + pos as line_no, text from l where regexp_matches(lower(text), '(^|[^a-z0-9_])ferry([^a-z0-9_]|$)') and regexp_matches(lower(text), '(^|[^a-z0-9_])bakery([^a-z0-9_]|$)') order by file_no, line_no desc limit 12""",
    "route_hints": f"select platform, route_kind, category from (values {_values(list(_SEEDS))}) v(platform, route_kind) join sites on site_id = platform where platform = 'murmel'",
    "pending_tasks": "select batch_file as task_id, case when min(idx) % 2 = 0 then arg_min(url, idx) end as page from batch_rows where lower(trim(status)) = 'awaiting_user' and url is not null group by 1",
    "checked_tabs": """with p as (select batch_file as task_id, min(idx) % 2 = 0 as page from batch_rows where lower(trim(status)) = 'awaiting_user' and url is not null group by 1)
        select r.task_id, coalesce(page, false) as retained, not coalesce(page, false) as closed, coalesce(not page, false) as parked from (select distinct batch_file as task_id from batch_rows) r left join p on p.task_id = r.task_id""",
    "matrix_totals": "select count(*) as tested, count(*) filter (candidates > 0) as readable, count(*) filter (lower(trim(status)) = 'awaiting_user') as awaiting_user from (select distinct on (event_id) * from experience_log order by event_id)",
    "preferences": "select site_id, case when public_index then 'md' else 'html' end as format, '{seq}_{title}' as naming, case when account then 'background' else 'foreground' end as \"window\", 'true' as close_after_use, 'edge' as browser, 'true' as reuse_browser_profile from sites",
    "display_names": f"""with d as (select lower(unnest(domains)) as d, site_name, site_id from sites), c as (select content_id, coalesce(title, '') as title, {_HOST} as host from (select *, resolved_url as u from {_ONCE}))
        select content_id, coalesce((select arg_min(site_name, site_id) from d where c.host = d or ends_with(c.host, '.' || d)), title) as site from c""",
    "listed_entries": f"select content_id, {_HOST} as host, captured_at as at from (select *, resolved_url as u from {_ONCE}) where {_HOST} <> '' order by {_HOST}, captured_at desc nulls last, content_id limit 100",
    "page_items": f"""with {_ITEMS}, b as (select content_id, 0 as o, -1 as pos, case when not coalesce(completeness.target_present, false) then 'page_shell' when platform in ('clipharbor', 'reelmoor') then 'video_description' else 'page_body' end as kind, text from {_ONCE} where coalesce(search_query, '') = '' and coalesce(trim(text, ' '), '') <> ''),
        i as (select content_id, 1 as o, pos, item.kind as kind, item.text as text from items where coalesce(trim(item.text, ' '), '') <> '')
        select content_id, (row_number() over (partition by content_id order by o, pos) - 1)::int as item_no, kind, length(text)::int as n_chars from (select * from b union all select * from i)""",
    "transcript_cues": f"with {_ITEMS} select content_id, pos as cue_no, item.time as time, length(item.text)::int as n_chars from items where trim(item.text, ' ') <> ''",
    "article_media": f"""with {_ENTITIES}, i as (select distinct content_id, md5(child_id) as media_id, length(child_id) % 3 <> 0 as good from entities where entity = 'image'), f as (select content_id, min(media_id) as cover from i group by 1)
        select i.content_id, media_id, 'https://pbs.test/' || media_id as url from i join f on f.content_id = i.content_id where good or media_id = cover""",
    "player_streams": f"""with s as (select content_id, k, 240 * (k + 1) as height from {_ONCE}, range(4) t(k) where (content_id + k) % 3 <> 0 and 240 * (k + 1) <= 720), b as (select content_id, max(k) as k from s group by 1)
        select content_id, 'https://a.video.test/' || k as url, (240 * (k + 1))::int as height from b where content_id % (k + 2) = 0""",
    "fallback_reasons": f"""select case when content_id % 50 = 0 then 'visible_platform_cooldown' when stop_reason in ('rate_limited', 'operation_budget', 'cancelled') then null when s = 'awaiting_user' then case when stop_reason in ('login_required', 'verification_required') then 'visible_' || stop_reason end
        when s in ('partial', 'blocked') then 'visible_' || coalesce(stop_reason, s) when s = 'failed' and stop_reason in ('login_required', 'verification_required', 'access_denied', 'unavailable', 'transient_failure') then 'visible_' || stop_reason when not url_check.valid_content then 'visible_content_unverified' end as reason, count(*) as n
        from (select *, lower(trim(status)) as s from {_ONCE}) group by 1""",
    "browser_agents": "select agent, case when regexp_matches(agent, 'Chrome/[0-9.]+') and not contains(agent, chr(10)) then replace(agent, 'HeadlessChrome/', 'Chrome/') end as desktop from (select unnest(['Mozilla ' || site_id || ' HeadlessChrome/120.0.1', 'Chrome/99 ' || site_id, 'Chrome/x ' || site_id, 'Chrome/9' || chr(10) || site_id, 'Firefox ' || site_id]) as agent from sites)",
    "proxies": """select * from (select 'http://' || site_id || ':8080' as proxy, 'http://' || site_id || ':8080' as server, null as username, null as password from sites union all select 'socks5://u%40x:p%3A@' || site_id || '.test:1', 'socks5://' || site_id || '.test:1', 'u@x', 'p:' from sites
        union all select 'HTTPS://me@' || site_id || '/path', 'https://' || site_id, 'me', '' from sites union all select 'ftp://' || site_id, null, null, null from sites union all select site_id || ':1', null, null, null from sites)""",
}
SQL |= {
    "planned_files": f"select content_id, count(*) as n, sum(bytes)::bigint as bytes from ({archives.SQL['retention_plan']}) group by 1",
    "readable_archives": f"select content_id from ({SQL['manifest_check']}) v where ok and content_id in (select content_id from {_ONCE} where url_check.valid_content and coalesce(trim(search_query, ' '), '') = '')",
    "counts_of_state": f"""with e as (select content_id, metric, min(value) as value from ({posts.SQL['post_engagement']}) where value is not null group by 1, 2)
        select content_id, metric, value from e where metric <> 'own' and not (metric = 'likes' and content_id % 2 = 0) union all select distinct content_id, 'likes', content_id::double from e where content_id % 2 = 0 union all select distinct content_id, 'own', 1.0 from e""",
}
