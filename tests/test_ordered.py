"""Order-dependent operators against plain loops over random rows."""

import random

import pytest

from gleanmark.operators import archive, merge, ordered, search, sites
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def requests(spark):
    r = random.Random(5)
    rows = [(k, r.randrange(6), r.randrange(0, 2_000), r.choice("abE"), r.choice([None, "x", "yy", "zzz"])) for k in range(600)]
    return rows, spark.createDataFrame(rows, "n int, user int, at long, kind string, text string")


def test_request_windows(requests):
    rows, df = requests
    want = {}
    for user in range(6):
        opened, used, windows, rejected = None, 0, 0, 0
        for t in sorted(r[2] for r in rows if r[1] == user):
            if opened is None or t - opened >= 100:
                opened, used, windows = t, 1, windows + 1
            elif used >= 4:
                rejected += 1
            else:
                used += 1
        want[user] = (windows, rejected)
    assert {r.user: (r.n_windows, r.n_rejected) for r in ordered.request_windows(df, ["user"], "at", 100, 4).collect()} == want


def test_merge_longest(requests):
    rows, df = requests
    want = {}
    for user in range(6):
        kept, kind, taken = None, None, 0
        for n, u, _, k, t in sorted(rows):
            if u == user and (taken == 0 or len(t or "") >= len(kept or "")):
                kept, kind, taken = t or kept, k, taken + 1
        want[user] = (kept, kind, taken)
    assert {r.user: (r.text, r.kind, r.n_taken) for r in merge.merge_longest(df, ["user"], "n", "text", ["kind"]).collect()} == want


def test_breaker(requests):
    rows, df = requests
    want = {}
    for user in range(6):
        run, trips, longest = 0, 0, 0
        for _, u, _, k, _ in sorted(rows):
            if u == user:
                run = run + 1 if k == "E" else 0
                trips += run >= 2
                longest = max(longest, run)
        want[user] = (trips, longest)
    assert {r.user: (r.n_trips, r.longest) for r in ordered.breaker_trips(df, ["user"], "n", F.col("kind") == "E", 2).collect()} == want


def test_blocks(spark):
    rows = [("f", k, lane, s, w) for k, (lane, s, w) in enumerate([("a", "captured", None), ("a", "failed", "rate_limited"), ("b", "captured", None), ("a", "captured", None), ("b", "awaiting_user", None), ("b", "partial", None)])]
    df = spark.createDataFrame(rows, "file string, idx int, lane string, status string, reason string")
    got = {r.idx: (r.effective_status, r.lane_block) for r in ordered.propagate_blocks(df, ["file", "lane"], "idx", "status", "reason").collect()}
    assert got[3] == ("skipped", "rate_limited") and got[5] == ("skipped", "awaiting_user") and got[1] == ("failed", None)


def test_backfill(spark):
    rows = [("u", 1, 10, "captured", 5, True, "x"), ("u", 2, 20, "captured", 0, False, "y"), ("v", 1, 20, "captured", 0, False, None), ("v", 2, 10, "captured", 7, True, "late"), ("w", 1, 10, "captured", 9, True, "a"), ("w", 2, 20, "failed", 0, False, "b")]
    df = spark.createDataFrame(rows, "url string, n int, at int, status string, chars int, seen boolean, title string")
    got = {r.url: (r.at, r.status, r.chars, r.title) for r in merge.latest_with_backfill(df, "url", "n", "at", "status", "chars", "seen", ["title"]).collect()}
    assert got == {"u": (20, "captured", 5, "x"), "v": (20, "captured", 7, "late"), "w": (20, "failed", 0, "b")}


def test_hosts_and_folders(spark):
    catalogue = spark.createDataFrame([("a", ["example.com"]), ("b", ["x.example.com"]), ("c", None)], "site_id string, domains array<string>")
    hosts = spark.createDataFrame([(h,) for h in ("example.com", "y.x.example.com", "example.com.evil.test", None)], "host string")
    assert {r.host: r.site for r in sites.with_site(hosts, "host", catalogue).collect()} == {"example.com": "a", "y.x.example.com": "b", "example.com.evil.test": "web", None: "web"}
    folders = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("c/d/e",)], "path string")
    assert {r.path for r in archive.outermost(folders, "path").collect()} == {"a", "ab", "c/d/e"}


def test_duplicates_prefer_no_backup(spark):
    files = spark.createDataFrame([("x/backup/i.png", 5, "A" * 64), ("x/deep/er/i.png", 5, "sha256:" + "a" * 64), ("y/j.png", 5, "b" * 64), ("z", None, None)], "path string, bytes long, sha256 string")
    assert [(r.n_files, r.reclaimable, r.canonical_path) for r in archive.duplicate_groups(files, "sha256", "bytes", "path").collect()] == [(2, 5, "x/deep/er/i.png")]


def test_closure_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "x")], "s string, t string")
    got = {(r.source, r.target): r.hops for r in search.closure(edges, "s", "t", 5).collect()}
    assert got[("a", "d")] == 3 and got[("a", "b")] == 1 and ("a", "a") not in got and len(got) == 9


def test_a_busy_key_is_numbered_and_folded_in_pieces(spark):
    """One key has most of the rows: numbers run on over ranges, and windows are folded between pauses."""
    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise("hot").cast("string").alias("k"), "id", (F.col("id") * 7 + F.when(F.col("id") > 1500, 100_000).otherwise(0)).alias("at"))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = ordered.numbered(rows, ["k"], ["id"], "n").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for _, own in got.groupby(got["k"].fillna("")):
        assert own.sort_values("id")["n"].tolist() == list(range(1, len(own) + 1))
    times, windows, rejected = sorted(got.loc[got["k"] == "hot", "at"]), 0, 0
    opened, used = None, 0
    for t in times:
        if opened is None or t - opened >= 100:
            opened, used, windows = t, 1, windows + 1
        elif used >= 5:
            rejected += 1
        else:
            used += 1
    out = ordered.request_windows(rows.where("k = 'hot'"), ["k"], "at", 100, 5).first()
    assert (out.n_windows, out.n_rejected) == (windows, rejected) and rejected > 0
