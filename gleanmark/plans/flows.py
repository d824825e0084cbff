"""Queries over ordered rows: merges, upserts, queues, runs, request windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark.operators import merge, ordered
from gleanmark.sources.tables import table

HOUR = 3_600


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("at", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct log entries with a number in the order of their arrival."""
    rows = table(spark, folder, "experience_log").distinct()
    from pyspark.sql import Window as W

    place = W.partitionBy("url").orderBy("received_at", "happened_at", "event_id", "status", "candidates", "lesson", "observations", "search_query")
    return rows.where("url is not null").withColumn("arrival", F.row_number().over(place))


def merged_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "content").dropDuplicates(["content_id"]).where("canonical_url is not null")
    return merge.merge_longest(rows, ["canonical_url"], "content_id", "text", ["title", "author", "status"])


def unique_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "manifest").where("sha256 is not null").select("content_id", "file_path", "sha256", "bytes").distinct()
    return merge.unique_last(rows.select(F.lower("sha256").alias("digest"), "content_id", "file_path", "bytes").groupBy("digest", "content_id").agg(F.min("file_path").alias("file_path"), F.max("bytes").alias("bytes")), ["digest"], "content_id").select("digest", "file_path", "bytes", "_first").withColumnRenamed("_first", "first_id")


def carried_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "content").dropDuplicates(["content_id"]).where("platform is not null")
    return merge.carried(rows, ["platform"], "content_id", ["lang", "author"], ["title"])


def thread_answers(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "content").dropDuplicates(["content_id"]).select("content_id", F.posexplode("items").alias("pos", "i")).where("i is not null")
    rows = items.select("content_id", "pos", F.when(F.col("pos") == 0, "target_post").otherwise("thread_or_reply").alias("kind"), F.col("i.author").alias("author"))
    return merge.thread_kinds(rows, "content_id", "pos").groupBy("kind").agg(F.count("*").alias("n"))


def latest_entries(spark: SparkSession, folder: str) -> DataFrame:
    return merge.latest_with_backfill(_log(spark, folder), "url", "arrival", "happened_at", "status", "candidates", "valid_content", ["lesson"])


def event_upserts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "experience_log").distinct()
    return merge.upsert_events(rows, "event_id", "received_at", ["platform"], "observations")


def newest_preferences(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each user, as a setting that the last writer wins."""
    return merge.last_writer(_events(spark, folder).select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


def lane_blocks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "batch_rows").dropDuplicates(["batch_file", "idx"]).withColumn("status", F.lower(F.trim("status")))
    out = ordered.propagate_blocks(rows, ["batch_file", "lane"], "idx", "status", "stop_reason")
    return out.select("batch_file", "idx", "lane", "effective_status", "lane_block")


def batch_status(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.batch_states(table(spark, folder, "batch_rows").dropDuplicates(["batch_file", "idx"]), "batch_file", "status")


def lane_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "batch_rows").dropDuplicates(["batch_file", "idx"])
    return ordered.until_stop(rows, ["batch_file"], "idx", F.col("stop_reason") == "rate_limited").groupBy("batch_file").agg(F.count("*").alias("n_run"), F.max("idx").alias("last_idx"))


def stable_event_runs(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.stable_runs(_events(spark, folder), ["user_id"], "event_id", "event_type", 3)


def repeated_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.unchanged_twice(_events(spark, folder), ["user_id"], "event_id", "event_type")


def request_windows(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.request_windows(_events(spark, folder), ["user_id"], "at", 24 * HOUR, 3)


def paced_requests(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.paced(_events(spark, folder), ["user_id"], "at", 6 * HOUR, 12 * HOUR)


def cooldown_ends(spark: SparkSession, folder: str) -> DataFrame:
    out = ordered.cooldowns(_events(spark, folder), ["user_id"], "event_id", "at", F.col("event_type") == "error", 10 * 60)
    return out.select("event_id", "user_id", "blocked_until", "in_cooldown")


def circuit_breakers(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.breaker_trips(_events(spark, folder), ["user_id"], "event_id", F.col("event_type") == "error", 3)


def budgeted_operations(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.within_budget(_events(spark, folder), ["user_id"], "event_id", "at", 12, 30 * 24 * HOUR).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


def serial_numbers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "content").dropDuplicates(["content_id"]).select("content_id", F.coalesce("platform", F.lit("")).alias("platform"))
    return ordered.serials(rows, ["platform"], ["content_id"])


QUERIES = {
    f.__name__: f
    for f in (
        merged_snapshots, unique_files, carried_values, thread_answers, latest_entries, event_upserts, newest_preferences, lane_blocks, batch_status, lane_prefixes, stable_event_runs,
        repeated_fingerprints, request_windows, paced_requests, cooldown_ends, circuit_breakers, budgeted_operations, serial_numbers,
    )
}

_AT = "(epoch_us(ts) // 1000000)::bigint"
_BATCH = "(select distinct on (batch_file, idx) * from batch_rows order by batch_file, idx)"
_ONCE = "(select distinct on (content_id) * from content order by content_id)"
_LANE_BLOCK = "case when stop_reason in ('login_required', 'verification_required', 'rate_limited') then stop_reason when lower(trim(status)) = 'awaiting_user' then coalesce(stop_reason, 'awaiting_user') end"
SQL = {
    "merged_snapshots": f"""with r as (select content_id, canonical_url, text, title, author, status, coalesce(length(text), 0) as n, max(coalesce(length(text), 0)) over (partition by canonical_url order by content_id rows between unbounded preceding and 1 preceding) as m from {_ONCE} where canonical_url is not null)
        select canonical_url, arg_max(text, content_id) filter (text is not null) as text, arg_max(title, content_id) filter (title is not null) as title, arg_max(author, content_id) filter (author is not null) as author, arg_max(status, content_id) filter (status is not null) as status, count(*) as n_taken
        from r where m is null or n >= m group by 1""",
    "unique_files": """with r as (select lower(sha256) as digest, content_id, min(file_path) as file_path, max(bytes) as bytes from manifest where sha256 is not null group by 1, 2)
        select digest, arg_max(file_path, content_id) as file_path, arg_max(bytes, content_id) as bytes, min(content_id) as first_id from r group by 1""",
    "carried_values": f"""select platform, arg_max(lang, content_id) filter (lang is not null) as lang, arg_max(author, content_id) filter (author is not null) as author,
        (list(title order by length(title) desc, content_id desc) filter (title is not null))[1] as title from {_ONCE} where platform is not null group by 1""",
    "thread_answers": f"""with i as (select content_id, unnest(items) as i, generate_subscripts(items, 1) - 1 as pos from {_ONCE}), t as (select content_id, pos, i.author as author from i where i is not null),
        k as (select *, first_value(case when pos = 0 then author end ignore nulls) over (partition by content_id order by pos rows between unbounded preceding and unbounded following) as target from t)
        select case when pos = 0 then 'target_post' when author = target then 'same_author_thread' else 'reply' end as kind, count(*) as n from k group by 1""",
    "latest_entries": """with recursive r as (select *, row_number() over (partition by url order by received_at nulls first, happened_at nulls first, event_id nulls first, status nulls first, candidates nulls first, lesson nulls first, observations nulls first, search_query nulls first) as arrival from (select distinct * from experience_log) where url is not null),
        f as (select url, arrival, happened_at, status, candidates, valid_content, lesson from r where arrival = 1
        union all select r.url, r.arrival,
          case when newer then r.happened_at else f.happened_at end, case when newer then r.status else f.status end,
          case when keeps then f.candidates when newer or fills then r.candidates else f.candidates end, case when newer then r.valid_content else f.valid_content end,
          case when keeps then f.lesson when newer or fills then r.lesson else f.lesson end
        from f join r on r.url = f.url and r.arrival = f.arrival + 1, lateral (select coalesce(r.happened_at >= f.happened_at, true) as newer, coalesce(r.status = f.status, false) as same) a,
          lateral (select newer and same and coalesce(f.status in ('captured', 'completed', 'partial'), false) and coalesce(r.candidates, 0) = 0 and not coalesce(r.valid_content, false) and coalesce(f.candidates, 0) > 0 as keeps,
            not newer and same and coalesce(f.candidates, 0) = 0 and not coalesce(f.valid_content, false) and coalesce(r.candidates, 0) > 0 as fills) b)
        select url, happened_at, status, candidates, valid_content, lesson from f qualify row_number() over (partition by url order by arrival desc) = 1""",
    "event_upserts": """select event_id, arg_max(platform, received_at) filter (platform is not null) as platform, max(received_at) as received_at, sum(case when coalesce(observations, 0) = 0 then 1 else observations end)::bigint as observations from (select distinct * from experience_log) where event_id is not null group by 1""",
    "newest_preferences": "select user_id, arg_max(event_id, event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by 1",
    "lane_blocks": f"""with b as (select *, first_value({_LANE_BLOCK} ignore nulls) over (partition by batch_file, lane order by idx rows between unbounded preceding and 1 preceding) as lane_block from {_BATCH})
        select batch_file, idx, lane, case when lane_block is not null then 'skipped' else lower(trim(status)) end as effective_status, lane_block from b""",
    "batch_status": f"select batch_file, count(*) as n_rows, count(*) filter (coalesce(lower(trim(status)), '') <> 'skipped') as n_attempted, case when bool_and(coalesce(lower(trim(status)) in ('captured', 'completed'), false)) then 'completed' else 'partial' end as batch_status from {_BATCH} group by 1",
    "lane_prefixes": f"""select batch_file, count(*) as n_run, max(idx) as last_idx from (select *, coalesce(bool_or(coalesce(stop_reason = 'rate_limited', false)) over (partition by batch_file order by idx rows between unbounded preceding and 1 preceding), false) as stopped from {_BATCH}) where not stopped group by 1""",
    "stable_event_runs": """with g as (select *, event_id - event_id + row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type order by event_id) as grp from events)
        select user_id, event_type, min(event_id) as first_at, max(event_id) as last_at, count(*) as run from g group by user_id, event_type, grp having count(*) >= 3""",
    "repeated_fingerprints": "select user_id, min(event_id) as stable_at from (select user_id, event_id, event_type = lag(event_type) over (partition by user_id order by event_id) as same from events) where same group by 1",
    "request_windows": f"""with recursive r as (select user_id, {_AT} as t0, row_number() over (partition by user_id order by ts, event_id) as n from events),
        f as (select user_id, n, t0 as opened, 1 as used, 1 as windows, 0 as rejected from r where n = 1
        union all select r.user_id, r.n, case when r.t0 - f.opened >= 86400 then r.t0 else f.opened end, case when r.t0 - f.opened >= 86400 then 1 when f.used >= 3 then f.used else f.used + 1 end,
          f.windows + case when r.t0 - f.opened >= 86400 then 1 else 0 end, f.rejected + case when r.t0 - f.opened < 86400 and f.used >= 3 then 1 else 0 end from f join r on r.user_id = f.user_id and r.n = f.n + 1)
        select user_id, windows as n_windows, rejected as n_rejected from f qualify row_number() over (partition by user_id order by n desc) = 1""",
    "paced_requests": f"""with recursive r as (select user_id, {_AT} as t0, row_number() over (partition by user_id order by ts, event_id) as n from events),
        f as (select user_id, n, t0 + 21600 as free, 1 as sent, 0 as refused, 0::bigint as delay from r where n = 1
        union all select r.user_id, r.n, case when greatest(f.free - r.t0, 0) <= 43200 then r.t0 + greatest(f.free - r.t0, 0) + 21600 else f.free end, f.sent + case when greatest(f.free - r.t0, 0) <= 43200 then 1 else 0 end,
          f.refused + case when greatest(f.free - r.t0, 0) <= 43200 then 0 else 1 end, f.delay + case when greatest(f.free - r.t0, 0) <= 43200 then greatest(f.free - r.t0, 0) else 0 end from f join r on r.user_id = f.user_id and r.n = f.n + 1)
        select user_id, sent as n_sent, refused as n_refused, delay as total_delay from f qualify row_number() over (partition by user_id order by n desc) = 1""",
    "cooldown_ends": f"""with r as (select event_id, user_id, {_AT} as t0, case when event_type = 'error' then {_AT} + 600 end as until from events)
        select event_id, user_id, max(until) over (partition by user_id order by event_id rows between unbounded preceding and current row) as blocked_until, coalesce(t0 < max(until) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), false) as in_cooldown from r""",
    "circuit_breakers": """with g as (select *, count(*) filter (event_type <> 'error') over (partition by user_id order by event_id rows between unbounded preceding and current row) as grp from events),
        r as (select *, count(*) filter (event_type = 'error') over (partition by user_id, grp order by event_id rows between unbounded preceding and current row) as run from g)
        select user_id, count(*) filter (event_type = 'error' and run >= 3) as n_trips, max(run) as longest from r group by 1""",
    "budgeted_operations": f"""select user_id, count(*) as n, max(event_id) as last_event from (select *, row_number() over (partition by user_id order by event_id) as n, {_AT} - min({_AT}) over (partition by user_id) as t from events) where n <= 12 and t <= 2592000 group by 1""",
    "serial_numbers": f"select content_id, coalesce(platform, '') as platform, case when length(n::varchar) >= 3 then n::varchar else lpad(n::varchar, 3, '0') end as serial from (select *, row_number() over (partition by coalesce(platform, '') order by content_id) as n from {_ONCE})",
}
