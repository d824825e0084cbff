"""Archives of files: verification, duplicates, retention and what deliveries lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Files from this size on are worth pruning.
PRUNE_BYTES = 256 * 1024
# Marks of a backup in a name, and the layout whose files may be pruned.
BACKUP_MARKERS = ("对比", "备份", "旧版", "copy", "backup", "duplicate")
PRUNE_LAYOUT = "html_and_raw_v1"


def digest(value: Column) -> Column:
    """A SHA-256 in one spelling: 64 hex digits in lower case, without a prefix; null where it isn't one."""
    found = F.regexp_extract(F.lower(F.trim(value)), "([0-9a-f]{64})$", 1)
    return F.when(found != "", found)


def failed_files(expected: DataFrame, actual: DataFrame, archive: str, path: str, sha: str) -> DataFrame:
    """Files of the manifests without an actual file of the same path and hash. A missing hash fails as well."""
    wanted = expected.select(archive, path, digest(F.col(sha)).alias("sha256")).distinct()
    found = actual.select(archive, path, digest(F.col(sha)).alias("sha256")).where("sha256 is not null").distinct()
    return wanted.join(found, [archive, path, "sha256"], "left_anti")


def verification(expected: DataFrame, actual: DataFrame, archive: str, path: str, sha: str) -> DataFrame:
    """``archive, n_files, n_failed, ok`` of each archive."""
    files = expected.select(archive, path).distinct().groupBy(archive).agg(F.count("*").alias("n_files"))
    failed = failed_files(expected, actual, archive, path, sha).select(archive, path).distinct().groupBy(archive).agg(F.count("*").alias("_failed"))
    out = files.join(failed, archive, "left").withColumn("n_failed", F.coalesce("_failed", F.lit(0)))
    return out.select(archive, "n_files", "n_failed", (F.col("n_failed") == 0).alias("ok"))


def canonical_order(path: Column) -> list[Column]:
    """Order in which copies are preferred: without a backup marker in any part, less deep, then by path in lower case."""
    parts = F.split(F.lower(path), "/")
    backup = F.lower(path).rlike("|".join(BACKUP_MARKERS))
    return [backup.cast("int"), F.size(parts), F.lower(path), path]


def duplicate_groups(files: DataFrame, sha: str, size: str, path: str) -> DataFrame:
    """Groups of files of the same size and hash: ``bytes, sha256, n_files, reclaimable, canonical_path``.

    The size is grouped with the hash, so that a group is one row however many copies it has.
    """
    rows = files.select(F.col(size).alias("bytes"), digest(F.col(sha)).alias("sha256"), F.col(path).alias("path")).where("sha256 is not null and bytes is not null and path is not null")
    order = F.struct(*[c.alias(f"_{k}") for k, c in enumerate(canonical_order(F.col("path")))])
    groups = rows.groupBy("bytes", "sha256").agg(F.count("*").alias("n_files"), F.min_by("path", order).alias("canonical_path")).where("n_files > 1")
    return groups.select("bytes", "sha256", "n_files", ((F.col("n_files") - 1) * F.col("bytes")).alias("reclaimable"), "canonical_path")


def image_files(files: DataFrame, path: str) -> DataFrame:
    """Files with the suffix of an image."""
    return files.where(F.lower(path).rlike("\\.(png|jpe?g|webp)$"))


def prunable(files: DataFrame, content: DataFrame, least: int = PRUNE_BYTES) -> DataFrame:
    """Files that stand in an archive's delivery as well and are large: ``content_id, file_path, bytes``.

    The archive has the layout of deliveries and was captured, its target was there, one of its addresses is known, it
    lists ``raw/content.json`` and its delivered page has a valid hash. Of its files, the screenshot ``raw/page.png`` and the
    ``.json`` and ``.html`` snapshots of at least ``least`` bytes with a valid hash are offered. Rows with nulls in these give
    none; repeated rows count once.
    """
    known = F.coalesce("resolved_url", "canonical_url", "requested_url", F.lit("")) != ""
    kept = content.where(F.col("completeness.target_present") & known).select("content_id").distinct()
    archive = files.where((F.col("output_layout") == PRUNE_LAYOUT) & (F.col("status") == "captured"))
    listed = F.max(F.col("file_path") == "raw/content.json")
    delivered = F.max(F.endswith("file_path", "primary_file") & (F.col("primary_file") != "") & digest(F.col("sha256")).isNotNull())
    whole = archive.groupBy("content_id").agg(listed.alias("_listed"), delivered.alias("_delivered")).where("_listed and _delivered").select("content_id")
    low = F.lower("file_path")
    offered = ((F.startswith(low, F.lit("raw/snapshots/")) & low.rlike("\\.(json|html)$")) | (low == "raw/page.png")) & (F.col("bytes") >= least) & digest(F.col("sha256")).isNotNull()
    return archive.where(offered).join(kept, "content_id", "left_semi").join(whole, "content_id", "left_semi").select("content_id", "file_path", "bytes").distinct()


def path_ancestors(path: Column) -> Column:
    """All folders above a path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def outermost(folders: DataFrame, path: str) -> DataFrame:
    """Folders that lie below none of the others; a join on exploded ancestors, not on a prefix condition."""
    one = folders.select(path).distinct()
    above = one.where(F.col(path).contains("/")).select(F.col(path), F.explode(path_ancestors(F.col(path))).alias("_above"))
    nested = above.join(one.select(F.col(path).alias("_above")), "_above").select(path).distinct()
    return folders.join(nested, path, "left_anti")


def nearest_delivery(archives: DataFrame, deliveries: DataFrame, path: str, name: str, sha: str) -> DataFrame:
    """``archives`` with the delivery of the same name and hash in the nearest folder above: ``delivery_folder``."""
    up = archives.select(path, name, sha, F.posexplode(F.reverse(path_ancestors(F.col(path)))).alias("_near", "delivery_folder"))
    found = up.join(deliveries.select(F.col("folder").alias("delivery_folder"), name, sha).distinct(), ["delivery_folder", name, sha])
    best = found.groupBy(path, name, sha).agg(F.min_by("delivery_folder", "_near").alias("delivery_folder"))
    return archives.join(best, [path, name, sha], "left")


def missing_rows(wanted: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` that ``got`` lacks, each once."""
    return wanted.select(*keys).distinct().join(got.select(*keys).distinct(), keys, "left_anti")


def download_states(wanted: DataFrame, got: DataFrame, owner: str, keys: list[str]) -> DataFrame:
    """``owner, n_wanted, n_missing, download_status``: no_media, downloaded or partial. A row of ``wanted`` whose keys are all
    null stands for an owner that wants none."""
    some = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()
    asked = wanted.select(owner, *keys).distinct()
    lacking = missing_rows(asked.where(some), got, [owner, *keys]).groupBy(owner).agg(F.count("*").alias("_m"))
    out = asked.groupBy(owner).agg(F.count_if(some).alias("n_wanted")).join(lacking, owner, "left").withColumn("n_missing", F.coalesce("_m", F.lit(0)))
    state = F.when(F.col("n_wanted") == 0, "no_media").when(F.col("n_missing") == 0, "downloaded").otherwise("partial")
    return out.select(owner, "n_wanted", "n_missing", state.alias("download_status"))


def manifests(spark, folder: str, schema: str) -> DataFrame:
    """Manifests below a folder as rows, one per archive, with the ``path`` of each; their files are an array."""
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    return found.select("*", F.col("_metadata.file_path").alias("path"))


def readable(content: DataFrame, verified: DataFrame) -> DataFrame:
    """Records that a report may use: of a verified archive (``content_id, ok``), with valid content, and no search page."""
    valid = F.coalesce(F.col("url_check.valid_content"), F.lit(False)) & (F.coalesce(F.trim("search_query"), F.lit("")) == "")
    return content.where(valid).join(verified.where("ok").select("content_id"), "content_id", "left_semi")


def ambiguous_archives(archives: DataFrame, address: str) -> DataFrame:
    """Addresses with more than one archive: an error of the archive, which is reported and not merged."""
    return archives.where(F.col(address).isNotNull()).groupBy(address).agg(F.countDistinct("content_id").alias("n_archives")).where("n_archives > 1")


def inventory(spark, folder: str, pattern: str = "*") -> DataFrame:
    """``path, bytes, sha256`` of all files below ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, change`` between two inventories: added, removed or changed."""
    joined = before.select("path", F.col("sha256").alias("_old")).join(after.select("path", F.col("sha256").alias("_new")), "path", "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return joined.select("path", change.alias("change")).where("change is not null")


def rank_copies(files: DataFrame, sha: str, size: str, path: str) -> DataFrame:
    """``files`` with ``copy_no`` within their group of equal files, the canonical one first."""
    return files.withColumn("copy_no", F.row_number().over(W.partitionBy(size, sha).orderBy(*canonical_order(F.col(path)))))


def is_inside(folder: Column, path: Column) -> Column:
    """Whether a relative path stays in its folder: no absolute path, no step up."""
    return ~path.rlike("^(/|[A-Za-z]:|\\\\)") & ~F.exists(F.split(path, "[/\\\\]"), lambda p: p == "..") & folder.isNotNull()


def still_valid(plan: DataFrame, actual: DataFrame, path: str, sha: str) -> DataFrame:
    """The planned files that are there with the planned hash; a plan may be applied only if none is missing here."""
    return plan.withColumn("_d", digest(F.col(sha))).join(actual.select(path, digest(F.col(sha)).alias("_d")).distinct(), [path, "_d"], "left_semi").drop("_d")


def planned(files: DataFrame, folder: str, path: str) -> DataFrame:
    """Files of a plan in the order of their paths, so that two plans of the same files are the same text."""
    return files.orderBy(folder, path)


def with_downloads(images: DataFrame, downloads: DataFrame, owner: str, name: str) -> DataFrame:
    """``images`` with the first download of the same name and media class: ``file_path``, null where there is none."""
    first = downloads.groupBy(owner, name, "kind").agg(F.min("file_path").alias("file_path"))
    return images.join(first, [owner, name, "kind"], "left")
