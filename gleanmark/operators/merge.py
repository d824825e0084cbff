"""Keyed merges whose result depends on order: every operator takes an explicit order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_longest(df: DataFrame, keys: list[str], order: str, text: str, overlay: list[str]) -> DataFrame:
    """Fold of snapshots: one is taken over if its text is at least as long as the kept one (a null text has length 0),
    and its values lie over the older ones where they aren't null; one that isn't taken over adds nothing.

    So the rows that count are the running maxima of the length; the winner is the last of them. Returns the keys, the
    text, the columns of ``overlay`` and the number of rows taken over.
    """
    length = F.coalesce(F.length(text), F.lit(0))
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    taken = df.withColumn("_most", F.max(length).over(before)).where(F.col("_most").isNull() | (length >= F.col("_most")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return taken.groupBy(*keys).agg(last(text), *[last(c) for c in overlay], F.count("*").alias("n_taken"))


def unique_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, with the place of the first: ``_first`` orders the result."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"), F.min(order).alias("_first")).select(*keys, "_row.*", "_first")


def carried(df: DataFrame, keys: list[str], order: str, columns: list[str], longest: list[str]) -> DataFrame:
    """Merge of partial records: the last value that isn't null of each of ``columns``, the longest (on ties the last)
    of each of ``longest``."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    most = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.length(c), F.col(order)))).alias(c) for c in longest]
    return df.groupBy(*keys).agg(*last, *most)


def thread_kinds(items: DataFrame, thread: str, order: str, kind: str = "kind", author: str = "author") -> DataFrame:
    """Answers of a thread told apart: those by the author of its target post, and others."""
    target = F.first(F.when(F.col(kind) == "target_post", F.col(author)), ignorenulls=True).over(W.partitionBy(thread).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    own = F.when(F.col(kind) == "thread_or_reply", F.when(F.col(author) == target, "same_author_thread").otherwise("reply")).otherwise(F.col(kind))
    return items.withColumn(kind, own)


def latest_with_backfill(events: DataFrame, key: str, order: str, at: str, status: str, chars: str, observed: str, carried_columns: list[str]) -> DataFrame:
    """Latest entry per key where entries may arrive late, folded in the order they arrive.

    An entry as new as the kept one or newer replaces it; if it has no characters, saw no body, and both have the same
    readable status, the kept characters and ``carried_columns`` stay. A late entry with characters fills a newer one that
    has none and saw no body, if both have the same status; the newer time stays. ``order`` breaks ties and must be unique
    within a key. One sorted array per key is folded by a higher-order function.
    """
    fields = [at, status, chars, observed, *carried_columns]
    kept = lambda s, names: [s[c].alias(c) for c in names]
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *fields)))
    columns = [chars, *carried_columns]

    def step(old: Column, new: Column) -> Column:
        readable = old[status].isin("captured", "completed", "partial")
        same = F.coalesce(old[status] == new[status], F.lit(False))
        lacks = lambda e: (F.coalesce(e[chars], F.lit(0)) == 0) & ~F.coalesce(e[observed], F.lit(False))
        has = lambda e: F.coalesce(e[chars], F.lit(0)) > 0
        newer = F.coalesce(new[at] >= old[at], F.lit(True))
        keeps = newer & same & readable & lacks(new) & has(old)
        fills = ~newer & same & lacks(old) & has(new)
        pick = lambda c: F.when(keeps, old[c]).when(newer, new[c]).when(fills, new[c]).otherwise(old[c])
        fixed = lambda c: F.when(newer, new[c]).otherwise(old[c])
        return F.struct(*[(pick(c) if c in columns else fixed(c)).alias(c) for c in fields])

    folded = events.where(F.col(key).isNotNull()).groupBy(key).agg(rows.alias("_rows"))
    first = F.struct(*kept(F.col("_rows")[0], fields))
    rest = F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0)))
    return folded.select(key, F.aggregate(rest, first, lambda s, e: step(s, e)).alias("_e")).select(key, "_e.*")


def upsert_events(events: DataFrame, key: str, at: str, overlay: list[str], observations: str | None = None) -> DataFrame:
    """Events by their digest: the newest values that aren't null, and how often each was observed.

    An observation count that is null or 0 counts as 1.
    """
    n = F.lit(1) if observations is None else F.when(F.coalesce(F.col(observations), F.lit(0)) == 0, 1).otherwise(F.col(observations))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in overlay]
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(*last, F.max(at).alias(at), F.sum(n).alias("observations"))


def last_writer(df: DataFrame, key: str, updated: str) -> DataFrame:
    """The row of each key with the latest update."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), updated).alias("_row")).select(key, "_row.*")


def refreshed(results: DataFrame, audits: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Results of tasks with those of later audits in place of them, where an audit no longer waits for the user."""
    columns = [c for c in results.columns if c != key]
    done = audits.where(F.col(status) != "awaiting_user").select(key, F.lit(True).alias("_done"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = results.join(done.dropDuplicates([key]), key, "left")
    return joined.select(key, *[F.when(F.col("_done"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def without_answers(items: Column) -> Column:
    """Items of a thread without the answers of others."""
    return F.filter(items, lambda i: i.isNotNull() & (F.coalesce(i["kind"], F.lit("")) != "reply"))


def last_matching(values: Column, matches) -> Column:
    """The last element for which ``matches`` holds; null where there is none."""
    return F.try_element_at(F.filter(values, matches), F.lit(-1))
