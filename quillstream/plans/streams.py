"""The events table as a stream: schedules, chains, queues and live sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.tables import shared_dir
from quillstream.plans.registry import frame_query, read
from quillstream.streaming import ingest
from quillstream.streaming.scheduler import BEAT, Chains, Polls, rocksdb, schedule

_HOUR = 3600


def streamed(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The events table as a stream, and a fresh shared folder for what comes of it; the pattern lets the source take a file as well as a folder."""
    schema = read(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/event[s].parquet"), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _logged(spark: SparkSession, d: str, machine: Polls | Chains, key: Column, value: Column) -> DataFrame:
    """The log up to an hour before the last event."""
    events, folder = streamed(spark, d)
    last = read(spark, d, "events").agg(F.unix_micros(F.max("ts").cast("timestamp"))).head()[0]
    rows = events.select(key.cast("string").alias("key"), F.col("ts").alias("at"), value.alias("value"))
    with rocksdb(spark):
        log = ingest.run_to_table(schedule(rows, machine, horizon=None if last is None else last - _HOUR * 1_000_000), folder)
    return log.select("key", F.col("at").cast("timestamp_ntz").alias("at"), "what", "n")


def _poll_sql(m: Polls, key: str, value: str) -> str:
    first = f"greatest(case when f between 1 and {m.retries} then {m.retry} * (1 << (f - 1)::int) else every end, {m.ttl})"
    gone = f"v > 0 or rn >= {m.max_attempts}" if m.once else "false"
    return f"""with h as (select max(ts) - interval 1 hour as h from events),
r as (select {key} as key, ts, ({value})::int as v, row_number() over (partition by {key} order by ts, ({value})::int) as rn from events, h where ts < h),
g as (select *, min(case when {gone} then rn end) over (partition by key) as last from r),
f as (select *, lead(ts) over w as nx, rn - coalesce(max(case when v > 0 then rn end) over w, 0) as f from g where last is null or rn <= last window w as (partition by key order by ts, v)),
w as (select *, {m.interval} * case when f >= {m.slow_after} then {m.slow} else 1 end as every from f),
t as (select *, {first} as first, least(coalesce(nx, h), h) as stop from w, h where last is null or rn < last),
k as (select *, unnest(range(0, 1 + greatest(0, ceil((epoch_us(stop) - epoch_us(ts)) / 1000000.0 / every))::bigint)) as k from t),
d as (select key, ts + to_seconds(first + k * every) as "at", case when f between 1 and {m.retries} then 'retry' else 'poll' end as what, f as n, stop from k)
select key, "at", what, n from d where "at" < stop union all select key, ts, case when v > 0 then 'done' else 'left' end, f from f where rn = last"""


_OK = "event_type in ('click', 'purchase')"
_POLLS = Polls(interval=6 * _HOUR)
_RETRIES = Polls(interval=12 * _HOUR, retry=_HOUR, retries=3, ttl=2 * _HOUR)
_JOBS = Polls(interval=24 * _HOUR, retry=6 * _HOUR, retries=2, once=True)
_week = "user_id || '-' || (epoch_us(ts) // 604800000000)"


@frame_query("R2_dispatch_log", _poll_sql(_POLLS, "user_id::varchar", _OK))
def r2(spark: SparkSession, d: str) -> DataFrame:
    """Users as sources and their events as crawls: every poll that falls due, six times later after five failures in a row."""
    return _logged(spark, d, _POLLS, F.col("user_id"), F.expr(_OK).cast("int"))


@frame_query("R9_retry_log", _poll_sql(_RETRIES, "user_id::varchar", _OK))
def r9(spark: SparkSession, d: str) -> DataFrame:
    """As R2, with three retries at doubling distance and a lock of two hours."""
    return _logged(spark, d, _RETRIES, F.col("user_id"), F.expr(_OK).cast("int"))


@frame_query("R10_queue_leavers", _poll_sql(_JOBS, _week, _OK))
def r10(spark: SparkSession, d: str) -> DataFrame:
    """A user's weeks as bodies to fetch: each leaves the queue with its first success or its third failure."""
    week = F.concat_ws("-", "user_id", F.expr("unix_micros(cast(ts as timestamp)) div 604800000000"))
    return _logged(spark, d, _JOBS, week, F.expr(_OK).cast("int"))


_CHAINS = """with recursive h as (select max(ts) - interval 1 hour as h from events),
r as (select user_id::varchar as key, ts, v, row_number() over (partition by user_id order by ts, v) as rn from (select *, case when event_type in ('click', 'view') then -1 when event_type = 'error' then 0 else 3 end as v from events) e, h where ts < h),
s as (
  select key, 0::bigint as rn, null::timestamp as "at", null::timestamp as gone, 0 as gone_n, null::varchar as what, 0 as n, null::timestamp as held, 0 as batches from (select distinct key from r) k
  union all
  select key, rn, ts, gone, batches, what, case when what = 'started' then 0 when what = 'refused' then batches else batches + 1 end,
    case when what in ('started', 'continued') then ts + interval 8 hour when what = 'refused' then held end,
    case when what = 'started' then 0 when what in ('continued', 'ended') then batches + 1 else batches end
  from (select *, case when v = -1 then case when held is null then 'started' else 'refused' end when held is not null then case when v > 0 then 'continued' else 'ended' end end as what
    from (select r.key, r.rn, r.ts, r.v, s.batches, case when s.held <= r.ts then s.held end as gone, case when s.held > r.ts then s.held end as held from s join r on r.key = s.key and r.rn = s.rn + 1) x) y)
select key, "at", what, n from s where what is not null union all select key, gone, 'expired', gone_n from s where gone is not null
union all select key, held, 'expired', batches from (select *, row_number() over (partition by key order by rn desc) as back from s) z, h where back = 1 and held < h"""


@frame_query("R5_chains", _CHAINS)
def r5(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as beats and batches of chains under a lock of eight hours."""
    value = F.when(F.col("event_type").isin("click", "view"), BEAT).when(F.col("event_type") == "error", 0).otherwise(3)
    return _logged(spark, d, Chains(ttl=8 * _HOUR), F.col("user_id"), value)


_SESSIONS = """with g as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 12 hour, true) as opens from events),
n as (select user_id, ts, sum(opens::int) over (partition by user_id order by ts rows unbounded preceding) as s from g),
w as (select user_id, min(ts) as first_at, max(ts) as last_at, count(*) as n from n group by user_id, s)
select user_id, first_at, last_at, n from w where last_at + interval 12 hour <= (select date_trunc('millisecond', max(ts)) from events)"""


@frame_query("W1_live_sessions", _SESSIONS)
def w1_live(spark: SparkSession, d: str) -> DataFrame:
    """Users' spells of activity between silences of twelve hours, as sessions of a stream; a late row may join two. Told when the watermark has passed the silence."""
    events, folder = streamed(spark, d)
    return ingest.run_to_table(ingest.sessions(events.select(F.col("user_id").alias("key"), F.col("ts").alias("at")), hours=12), folder).select(F.col("key").alias("user_id"), *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_at", "last_at")], "n")
