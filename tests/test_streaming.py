"""Streams against the batch operators, and the sources of evidence."""

import json

import pytest
from pyspark.sql import functions as F

from gleanmark.operators import ordered
from gleanmark.sources import evidence
from gleanmark.streaming import state


def run(stream, name, mode="append"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name)


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(k, k % 3, k * 7 % 501 + k) for k in range(300)]
    df = spark.createDataFrame(rows, "n int, user int, at long")
    df.orderBy("at").coalesce(1).write.parquet(str(tmp_path / "requests"))
    return str(tmp_path / "requests"), df


def test_windows_as_stream(spark, folder):
    path, df = folder
    out = run(state.limited_requests(state.replayed(path, spark, df.schema), "user", "at", 60, 5), "limited")
    rejected = {r.user: r.n for r in out.groupBy("user").agg(F.count_if(~F.col("accepted")).alias("n")).collect()}
    assert rejected == {r.user: r.n_rejected for r in ordered.request_windows(df, ["user"], "at", 60, 5).collect()}


def test_unique_and_windowed(spark, tmp_path):
    rows = [(k % 10, f"2025-01-01 00:0{k % 6}:00") for k in range(60)]
    df = spark.createDataFrame(rows, "id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "items"))
    stream = state.replayed(str(tmp_path / "items"), spark, df.schema, 100)
    assert run(state.unique_within(stream, ["id"], "ts", "1 hour"), "unique_items").count() == 10
    counts = run(state.windowed_counts(stream, "ts", ["id"], "10 minutes", "1 hour"), "windowed", "complete")
    assert counts.agg(F.sum("n")).first()[0] == 60


def test_upserts_count_once_when_run_again(spark, tmp_path):
    folder = str(tmp_path / "t")
    write = state.upserting(folder, "id", "at", ["v"], "seen", buckets=4)
    schema = "id string, at int, v string, seen int"
    first, second = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, 0), ("b", 1, "y", 3)], schema), spark.createDataFrame([("a", 3, "z", 2)], schema)
    assert state.current(spark, folder) is None
    write(first, 0)
    write(second, 1)
    write(second, 1)
    assert {r.id: (r.at, r.v, r.observations) for r in state.current(spark, folder).collect()} == {"a": (3, "z", 4), "b": (1, "y", 3)}
    # A stream that begins again at batch 0 goes on from there; buckets that it doesn't touch aren't written.
    state.upserting(folder, "id", "at", ["v"], "seen", run=1, buckets=4)(second, 0)
    assert {r.id: r.observations for r in state.current(spark, folder).collect()} == {"a": 6, "b": 3}
    assert len(list((tmp_path / "t" / "version=1000000000").glob("bucket=*"))) == 1


def test_evidence_survives_broken_files(spark, tmp_path):
    for name, body in {"a/content.json": json.dumps({"url": "u", "status": "captured"}), "b/content.json": "{broken", "a/snapshots/content.json": "{}", "tasks/one.json": json.dumps({"url": "v"}), "other.json": "{}"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    from pyspark.sql.types import StructType

    rows = evidence.evidence(spark, str(tmp_path), StructType().add("url", "string").add("status", "string")).cache()
    assert sorted((r.url or "") for r in rows.collect()) == ["", "u", "v"]
    assert evidence.warnings_of(rows).count() == 1


def test_jobs(spark, tmp_path):
    (tmp_path / "jobs.txt").write_text("see https://x.com/a/status/1 and https://twitter.com/b/status/1, also (https://e.org/p).\n")
    jobs = evidence.jobs_in(spark, str(tmp_path / "jobs.txt"))
    assert sorted(r.url for r in jobs.collect()) == ["https://e.org/p", "https://x.com/a/status/1"]
    assert evidence.checked_jobs(jobs).count() == 2
    with pytest.raises(ValueError, match="unknown"):
        evidence.checked_jobs(jobs.withColumn("more", F.lit(1)))
    with pytest.raises(ValueError, match="page address"):
        evidence.checked_jobs(spark.createDataFrame([(0, "file:///x")], "idx int, url string"))


def test_partitions_are_replaced(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, p string")
    evidence.append_partitioned(df, str(tmp_path / "t"), "p")
    evidence.replace_partitions(spark.createDataFrame([(9, "a")], "n int, p string"), str(tmp_path / "t"), "p")
    assert sorted((r.n, r.p) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(2, "b"), (9, "a")]
