"""Folders of JSON evidence: scans that survive broken files, job lists with validation, and the writing of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanmark.functions import text, url

# Folders below an evidence root that hold no records, and the files that do.
SKIPPED_FOLDERS = ("snapshots", "browser-actions", "media", "downloads", "platform-probes")
RECORD_FILES = r"(^|/)(content\.json|collection\.json|batch-[^/]*\.json|search-[^/]*\.json|tasks/[^/]*\.json)$"
#: Jobs of one batch, and the keys that a job may have.
MOST_JOBS, JOB_KEYS = 500, ("id", "url", "steps")


def evidence(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """Records of the JSON files below ``root`` with their ``path``; files that can't be read have ``_broken`` set.

    Folders of snapshots, media and the like are left out by their path.
    """
    wanted = StructType(list(schema.fields)).add("_broken", "string")
    files = spark.read.schema(wanted).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(root)
    rows = files.select("*", F.col("_metadata.file_path").alias("path"))
    return rows.where(F.col("path").rlike(RECORD_FILES) & ~F.col("path").rlike("/(" + "|".join(SKIPPED_FOLDERS) + ")/"))


def warnings_of(rows: DataFrame) -> DataFrame:
    """``path, warning`` of the files that couldn't be read."""
    return rows.where("_broken is not null").select("path", F.substring("_broken", 1, 200).alias("warning"))


def jobs_in(spark: SparkSession, path: str) -> DataFrame:
    """``idx, url`` of a job list as free text: every address, in order, the first of each page."""
    lines = spark.read.option("wholetext", "true").text(path)
    found = lines.select(F.posexplode(text.addresses_in(F.col("value"))).alias("idx", "url")).withColumn("page", url.canonical(F.col("url"))).where("page is not null")
    return found.groupBy("page").agg(F.min("idx").alias("idx"), F.min_by("url", "idx").alias("url")).select("idx", "url")


def checked_jobs(jobs: DataFrame) -> DataFrame:
    """``jobs`` as they are, if all are valid: 1 to 500, only known keys, page addresses. Else ``ValueError``."""
    unknown = sorted(set(jobs.columns) - {*JOB_KEYS, "idx"})
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    seen = jobs.agg(F.count("*").alias("n"), F.count_if(~url.is_page(F.col("url"))).alias("bad")).first()
    if not 1 <= seen.n <= MOST_JOBS:
        raise ValueError(f"a batch has 1 to {MOST_JOBS} jobs, not {seen.n}")
    if seen.bad:
        raise ValueError(f"{seen.bad} jobs have no page address")
    return jobs


def append_partitioned(rows: DataFrame, folder: str, *columns: str) -> None:
    """Adds rows to a table partitioned by ``columns``; nothing that is there changes."""
    rows.write.mode("append").partitionBy(*columns).parquet(folder)


def replace_partitions(rows: DataFrame, folder: str, *columns: str) -> None:
    """Replaces the partitions that ``rows`` has rows of, and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(folder)
