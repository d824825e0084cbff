"""Streams: request windows per key, duplicates across micro-batches, windowed counts and idempotent upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DataType

from gleanmark.operators.merge import upsert_events


def limited_requests(requests: DataFrame, key: str, at: str, length: int, most: int, idle_ms: int | None = None) -> DataFrame:
    """``key, at, accepted``: the anchored request window of each key as a stream.

    The same rule as ``operators.ordered.request_windows``: a window opens at the first request after the last one ended
    and takes ``most`` requests. Two numbers per key are kept. Requests are taken in order of ``at`` within a micro-batch;
    one that comes late counts at its own time if that falls into the open window, else it opens none and is rejected. With
    ``idle_ms``, which should exceed a window, a key that is idle for so long is forgotten; such a stream never comes to rest.
    """
    kind = dict(requests.dtypes)[key]

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        accepted = []
        for t in rows["at"]:
            if opened is None or t - opened >= length:
                opened, used = int(t), 1
                accepted.append(True)
            else:
                ok = t >= opened and used < most
                used += ok
                accepted.append(bool(ok))
        state.update((opened, used))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"key": group[0], "at": rows["at"], "accepted": accepted})

    rows = requests.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("long").alias("at"))
    out = rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, at long, accepted boolean", "opened long, used int", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
    return out.withColumnRenamed("key", key).withColumnRenamed("at", at) if at != key else out


def unique_within(items: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Each key once, as long as its repeats come within ``delay``; older state is dropped by the watermark."""
    return items.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, at: str, keys: list[str], length: str, delay: str) -> DataFrame:
    """Events per key in windows of ``length``; late ones count until ``delay`` has passed."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.groupBy(F.window(at, length), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


#: Parts of an upserted table; a micro-batch rewrites those that its keys fall into.
BUCKETS = 64


def current(spark, folder: str, before: int | None = None) -> DataFrame | None:
    """The rows of an upserted table, or those it had before a version; None where there are none."""
    try:
        rows = spark.read.parquet(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise
    if before is not None:
        rows = rows.where(F.col("version") < before)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(newest, ["bucket", "version"], "left_semi").drop("bucket", "version")


def upserting(folder: str, key: str, at: str, overlay: list[str], observations: str, run: int = 0, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps one row per key, newest values over older ones, observations added up.

    The table is kept in buckets of keys; a micro-batch writes new versions of those that its keys fall into and reads only
    these. Versions are numbered by ``run`` and batch, so that a batch that runs again after a failure overwrites its own
    version and counts nothing twice, and a stream that starts anew with a higher ``run`` goes on from what was there.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, version = batch.sparkSession, run * 1_000_000_000 + number
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        rows = batch.select(key, at, *overlay, observations).withColumn("bucket", bucket)
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        old = current(spark, folder, version)
        if old is not None and touched:
            kept = old.withColumn("bucket", bucket).where(F.col("bucket").isin(*touched))
            rows = rows.unionByName(kept.select(key, at, *overlay, F.col("observations").alias(observations), "bucket"))
        merged = upsert_events(rows.drop("bucket"), key, at, overlay, observations).withColumn("bucket", bucket)
        merged.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/version={version}")

    return write


def replayed(folder: str, spark, schema: DataType, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder, a few per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
