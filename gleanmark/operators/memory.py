"""What is remembered between tasks: notes, seeds, pending tasks, preferences, names of sites, matrices of checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark.functions.text import matches_words
from gleanmark.operators.sites import host_suffixes

#: Lines of old notes that a search returns.
MOST_NOTES = 12
# Preferences of a user who saved none.
PREFERENCES = {"format": "html", "naming": "{seq}_{title}", "window": "foreground", "close_after_use": "true", "browser": "edge", "reuse_browser_profile": "true"}


def noted_lines(notes: DataFrame, words: str, k: int = MOST_NOTES) -> DataFrame:
    """``file_no, line_no, text``: the first ``k`` lines that hold all words, file by file, each from its end; none for blank words."""
    if not words.strip():
        return notes.select("file_no", "line_no", "text").limit(0)
    return notes.where(matches_words(F.col("text"), F.lit(words))).select("file_no", "line_no", "text").orderBy("file_no", F.desc("line_no")).limit(k)


def route_hints(seeds: DataFrame, platform: str | None = None) -> DataFrame:
    """Hints that are shipped, those of one platform if it is named."""
    return seeds if not platform else seeds.where(F.col("platform") == platform)


def pending_tasks(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Tasks that wait for the user: the JSON files of a folder, other files left out."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(folder)


def with_preferences(saved: DataFrame, key: str) -> DataFrame:
    """``saved`` (a column per preference) with the defaults in place of what is null or missing."""
    return saved.select(key, *[(F.coalesce(F.col(c).cast("string"), F.lit(v)) if c in saved.columns else F.lit(v)).alias(c) for c, v in PREFERENCES.items()])


def with_tabs(results: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """Results of checks with the state of their tabs, that of a pending task in place of the recorded one: ``retained``,
    ``closed`` and ``parked``. ``pending`` has ``key, page``, one row per task."""
    open_tabs = pending.select(key, F.lit(True).alias("_waits"), (F.coalesce("page", F.lit("")) != "").alias("_page"))
    joined = results.join(open_tabs, key, "left")
    waits = F.coalesce("_waits", F.lit(False))
    return joined.select(*results.columns, F.when(waits, F.col("_page")).otherwise(F.lit(False)).alias("retained"), F.when(waits, ~F.col("_page")).otherwise(F.lit(True)).alias("closed"), (waits & ~F.coalesce("_page", F.lit(True))).alias("parked"))


def matrix_totals(results: DataFrame, readable: str, status: str) -> DataFrame:
    """``tested, readable, awaiting_user``: one row for all checks."""
    return results.agg(F.count("*").alias("tested"), F.count_if(F.coalesce(F.col(readable), F.lit(0)) > 0).alias("readable"), F.count_if(F.col(status) == "awaiting_user").alias("awaiting_user"))


def with_display_names(entries: DataFrame, host: str, names: DataFrame, fallback: str) -> DataFrame:
    """``entries`` with ``site``: the name of their host's domain in ``names`` (``domain, site_name, place``), the first in
    order that the host is or lies below, else ``fallback``. A hash join on the suffixes of the distinct hosts."""
    hosts = entries.select(F.col(host).alias("_host")).where("_host is not null").distinct()
    found = hosts.select("_host", F.explode(host_suffixes(F.col("_host"))).alias("domain")).join(names, "domain").groupBy("_host").agg(F.min_by("site_name", "place").alias("_site"))
    return entries.join(found, entries[host] == F.col("_host"), "left").withColumn("site", F.coalesce("_site", F.col(fallback))).drop("_host", "_site")


def listed_entries(entries: DataFrame, host: str, at: str, key: str) -> DataFrame:
    """Entries in the order of a summary: hosts alphabetically as people sort them, the newest first, then by key."""
    return entries.orderBy(F.collate(F.col(host), "UNICODE"), F.desc(at), key)
