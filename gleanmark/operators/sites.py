"""The site catalogue: overlay, aliases and the site of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlay(base: DataFrame, custom: DataFrame, key: str = "site_id") -> DataFrame:
    """Rows of ``base`` with those of ``custom`` in place of the same key, and its new ones; columns by name."""
    columns = [c for c in base.columns if c != key]
    other = custom.select(key, F.lit(True).alias("_custom"), *[F.col(c).alias(f"_{c}") for c in columns if c in custom.columns])
    joined = base.join(other, key, "full_outer")
    chosen = [F.when(F.col("_custom"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in custom.columns else F.col(c) for c in columns]
    return joined.select(key, *chosen)


def overlay_settings(base: DataFrame, custom: DataFrame, key: str) -> DataFrame:
    """Like ``overlay``, but column by column: a null setting of ``custom`` leaves the default."""
    columns = [c for c in base.columns if c != key]
    other = custom.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(other, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def host_suffixes(host: Column) -> Column:
    """The host and all its parent domains, longest first."""
    labels = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def with_site(df: DataFrame, host: str, catalogue: DataFrame, default: str = "web", name: str = "site") -> DataFrame:
    """``df`` with the site whose domain is the host's or the longest one above it; the first in ``site_id`` order on ties.

    A hash join on exploded suffixes of the few distinct hosts instead of a join on a suffix condition, which would
    compare all pairs. Hosts below no domain, and null hosts, get ``default``.
    """
    domains = catalogue.select("site_id", F.explode("domains").alias("domain")).where("domain is not null").select(F.lower("domain").alias("domain"), "site_id").groupBy("domain").agg(F.min("site_id").alias("site_id"))
    hosts = df.select(F.col(host).alias("_host")).where("_host is not null").distinct()
    found = hosts.select("_host", F.explode(host_suffixes(F.col("_host"))).alias("domain")).join(domains, "domain").groupBy("_host").agg(F.max_by("site_id", F.length("domain")).alias("_site"))
    return df.join(found, df[host] == F.col("_host"), "left").withColumn(name, F.coalesce("_site", F.lit(default))).drop("_host", "_site")


def resolve_names(requests: DataFrame, column: str, catalogue: DataFrame) -> DataFrame:
    """``requests`` with the ``site_id`` whose id or alias the column names, in any case; null for unknown names."""
    names = catalogue.select("site_id", F.explode(F.array_union(F.array("site_id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_name"))
    names = names.select(F.lower(F.trim("_name")).alias("_name"), "site_id").groupBy("_name").agg(F.min("site_id").alias("site_id"))
    return requests.withColumn("_name", F.lower(F.trim(column))).join(names, "_name", "left").drop("_name")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
