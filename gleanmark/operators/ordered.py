"""Operators over ordered rows: queues by site, runs of equal states, breaks, serial numbers, request windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanmark.functions.status import LANE_BLOCKING_REASONS
from gleanmark.session import staged


def lane_of(site: Column, host: Column) -> Column:
    """The queue of a job: its site, or its host where no site is known."""
    return F.when(F.coalesce(site, F.lit("web")) == "web", host).otherwise(site)


def propagate_blocks(rows: DataFrame, lane: list[str], order: str, status: str, reason: str) -> DataFrame:
    """``rows`` with ``effective_status`` and ``lane_block``: after the first row that blocks its lane all later ones are skipped.

    A row blocks by a login, a verification or a rate limit, or by waiting for the user; ``lane_block`` of the skipped rows
    is the reason of the first block.
    """
    blocks = F.when(F.col(reason).isin(*LANE_BLOCKING_REASONS), F.col(reason)).when(F.lower(F.trim(status)) == "awaiting_user", F.coalesce(reason, F.lit("awaiting_user")))
    before = W.partitionBy(*lane).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    first = F.first(blocks, ignorenulls=True).over(before)
    return rows.withColumn("lane_block", first).withColumn("effective_status", F.when(F.col("lane_block").isNotNull(), "skipped").otherwise(F.col(status)))


def batch_states(rows: DataFrame, batch: str, status: str) -> DataFrame:
    """``batch, n_rows, n_attempted, batch_status``: completed if every row was captured or completed."""
    plain = F.lower(F.trim(status))
    done = F.coalesce(plain.isin("captured", "completed"), F.lit(False))
    attempted = F.count_if(F.coalesce(plain, F.lit("")) != "skipped")
    return rows.groupBy(batch).agg(F.count("*").alias("n_rows"), attempted.alias("n_attempted"), F.when(F.bool_and(done), "completed").otherwise("partial").alias("batch_status"))


def until_stop(rows: DataFrame, keys: list[str], order: str, stops: Column) -> DataFrame:
    """The rows of each key up to the first that stops its loop, that one included."""
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_stopped", F.max(F.coalesce(stops, F.lit(False))).over(before)).where(~F.coalesce("_stopped", F.lit(False))).drop("_stopped")


def stable_runs(rows: DataFrame, keys: list[str], order: str, signature: str, least: int, ready: Column | None = None) -> DataFrame:
    """Runs of ``least`` or more rows in a row with the same signature: keys, signature, ``first_at``, ``last_at``, ``run``.

    Rows that aren't ``ready`` break a run and belong to none; null signatures are equal to each other.
    """
    by = W.partitionBy(*keys).orderBy(order)
    ok = F.lit(True) if ready is None else F.coalesce(ready, F.lit(False))
    flagged = rows.withColumn("_ok", ok)
    starts = F.when(~F.col("_ok"), 1).when(F.col(signature).eqNullSafe(F.lag(signature).over(by)) & F.coalesce(F.lag("_ok").over(by), F.lit(False)), 0).otherwise(1)
    runs = flagged.withColumn("_start", starts).withColumn("_run", F.sum("_start").over(by)).where("_ok")
    return runs.groupBy(*keys, "_run", signature).agg(F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.count("*").alias("run")).where(F.col("run") >= least).drop("_run")


def unchanged_twice(rows: DataFrame, keys: list[str], order: str, fingerprint: str) -> DataFrame:
    """The first row of each key whose fingerprint equals that of the row before."""
    by = W.partitionBy(*keys).orderBy(order)
    same = rows.where(F.col(fingerprint).isNotNull() | F.lit(True)).withColumn("_same", F.col(fingerprint) == F.lag(fingerprint).over(by))
    return same.where("_same").groupBy(*keys).agg(F.min(order).alias("stable_at"))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their number within their keys in ``order``, which must be unique within a key, nulls first.

    Rows are split by ranges of key and order, counted in each range and numbered from the counts of the ranges before, so
    that a key with a third of all rows isn't one task.
    """
    ranged = staged(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    # A few rows per range: one for each key that has rows in it, but a key of many rows has one per range.
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy("_range", *keys).orderBy(*order))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = ranged.withColumn("_own", own).alias("a").join(offsets.alias("b"), [F.col("a._range") == F.col("b._range"), *same])
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("_own") + F.col("_before")).cast("int").alias(name))


def serials(rows: DataFrame, keys: list[str], order: list[str], width: int = 3) -> DataFrame:
    """``rows`` numbered within their keys: ``serial``, padded with zeros, longer where needed."""
    rows, n = numbered(rows, keys, order, "_serial"), F.col("_serial")
    return rows.withColumn("serial", F.when(F.length(n.cast("string")) >= width, n.cast("string")).otherwise(F.lpad(n.cast("string"), width, "0"))).drop("_serial")


def next_serial(names: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One more than the highest number that a name of each key starts with; 1 where none does."""
    number = F.regexp_extract(name, "^(\\d{1,9})", 1).try_cast("int")
    return names.groupBy(*keys).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_serial"))


def top_per(rows: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The ``k`` first rows of each key."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def _spells(requests: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """``keys, _spell, _t``: the sorted times of each key, cut wherever no request came for ``gap``: what went before can't
    matter after that, so a busy key is folded in as many pieces as it has pauses."""
    rows = requests.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("long").alias("_at"))
    of_key = W.partitionBy(*keys).orderBy("_at")
    pause = F.coalesce(F.col("_at") - F.lag("_at").over(of_key) >= gap, F.lit(False)).cast("long")
    spells = rows.withColumn("_pause", pause).withColumn("_spell", F.sum("_pause").over(of_key.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return spells.groupBy(*keys, "_spell").agg(F.array_sort(F.collect_list("_at")).alias("_t"))


def request_windows(requests: DataFrame, keys: list[str], at: str, length: int, most: int) -> DataFrame:
    """Anchored windows of requests: ``n_windows, n_rejected`` of each key.

    A window opens at the first request after the last one ended and takes ``most`` requests; more are rejected until it
    ends. ``at`` is a whole number, ``length`` in the same unit. The sorted times of a key are folded in one expression for
    each spell without a pause of a window's length, after which a new window opens in any case.
    """
    zero = F.struct(F.lit(None).cast("long").alias("opened"), F.lit(0).alias("used"), F.lit(0).alias("windows"), F.lit(0).alias("rejected"))

    def step(s: Column, t: Column) -> Column:
        opens = s["opened"].isNull() | (t - s["opened"] >= length)
        full = s["used"] >= most
        return F.struct(
            F.when(opens, t).otherwise(s["opened"]).alias("opened"),
            F.when(opens, 1).when(full, s["used"]).otherwise(s["used"] + 1).alias("used"),
            (s["windows"] + opens.cast("int")).alias("windows"),
            (s["rejected"] + (~opens & full).cast("int")).alias("rejected"),
        )

    per = _spells(requests, keys, at, length).select(*keys, F.aggregate("_t", zero, step).alias("_s"))
    return per.groupBy(*keys).agg(F.sum("_s.windows").cast("int").alias("n_windows"), F.sum("_s.rejected").cast("int").alias("n_rejected"))


def paced(requests: DataFrame, keys: list[str], at: str, interval: int, most_delay: int) -> DataFrame:
    """Requests that keep a distance: ``n_sent, n_refused, total_delay`` of each key.

    Each reserves the next free time; one that would wait longer than ``most_delay`` is refused and reserves nothing. After a
    pause of delay and interval the time is free in any case, so each spell is folded by itself.
    """
    zero = F.struct(F.lit(None).cast("long").alias("free"), F.lit(0).alias("sent"), F.lit(0).alias("refused"), F.lit(0).cast("long").alias("delay"))

    def step(s: Column, t: Column) -> Column:
        wait = F.greatest(F.coalesce(s["free"], t) - t, F.lit(0).cast("long"))
        sent = wait <= most_delay
        return F.struct(
            F.when(sent, t + wait + interval).otherwise(s["free"]).alias("free"),
            (s["sent"] + sent.cast("int")).alias("sent"),
            (s["refused"] + (~sent).cast("int")).alias("refused"),
            (s["delay"] + F.when(sent, wait).otherwise(F.lit(0).cast("long"))).alias("delay"),
        )

    per = _spells(requests, keys, at, most_delay + interval).select(*keys, F.aggregate("_t", zero, step).alias("_s"))
    return per.groupBy(*keys).agg(F.sum("_s.sent").cast("int").alias("n_sent"), F.sum("_s.refused").cast("int").alias("n_refused"), F.sum("_s.delay").alias("total_delay"))


def cooldowns(requests: DataFrame, keys: list[str], order: str, at: str, limited: Column, cooldown: int, asked: Column | None = None) -> DataFrame:
    """``requests`` with ``blocked_until``: the latest end of a cooldown that a limited request started so far, and
    ``in_cooldown``: whether an earlier one was still running."""
    wait = F.lit(cooldown) if asked is None else F.greatest(F.lit(cooldown), F.coalesce(asked, F.lit(0)))
    until = F.when(limited, F.col(at) + wait)
    by = W.partitionBy(*keys).orderBy(order)
    so_far = F.max(until).over(by.rowsBetween(W.unboundedPreceding, 0))
    before = F.max(until).over(by.rowsBetween(W.unboundedPreceding, -1))
    return requests.withColumn("blocked_until", so_far).withColumn("in_cooldown", F.coalesce(F.col(at) < before, F.lit(False)))


def breaker_trips(requests: DataFrame, keys: list[str], order: str, failed: Column, threshold: int) -> DataFrame:
    """Circuit breaker: ``n_trips, longest`` of each key. Failures in a row trip it from ``threshold`` on, each further one
    again; a success sets the count back."""
    by = W.partitionBy(*keys).orderBy(order)
    marked = requests.withColumn("_f", F.coalesce(failed, F.lit(False))).withColumn("_g", F.count_if(~F.col("_f")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    run = F.count_if(F.col("_f")).over(W.partitionBy(*keys, "_g").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("_run", run).groupBy(*keys).agg(F.count_if(F.col("_f") & (F.col("_run") >= threshold)).alias("n_trips"), F.max("_run").alias("longest"))


def within_budget(operations: DataFrame, keys: list[str], order: str, at: str, most: int, longest: int) -> DataFrame:
    """The operations of each key before its budget of operations or of time is spent."""
    by = W.partitionBy(*keys).orderBy(order)
    first = F.min(at).over(W.partitionBy(*keys))
    return operations.withColumn("_n", F.row_number().over(by)).withColumn("_t", F.col(at) - first).where((F.col("_n") <= most) & (F.col("_t") <= longest)).drop("_n", "_t")
