"""Windowed and stateful queries over events."""

from uuid import uuid4

from pyspark.sql import functions as F

from gaugeworks.functions.materialise import checkpoint_dir
from gaugeworks.functions.repeats import without_repeats
from gaugeworks.operators import evidence, parse
from gaugeworks.plans.registry import query
from gaugeworks.sources import read_table
from gaugeworks.streaming import streams

_HOUR = 3600


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def tumbling_hours(spark, d):
    return streams.tumbling(read_table(spark, d, "events"), "ts", "1 hour", ["event_type"])


@query(
    "with e as (select ts, event_type, time_bucket(interval '1 hour', ts) as b from events) select w as window_start, event_type, count(*) as n from (select unnest([b - interval '1 hour', b]) as w, ts, event_type from e) where ts >= w and ts < w + interval '2 hours' group by 1, 2"
)
def sliding_hours(spark, d):
    return streams.sliding(read_table(spark, d, "events"), "ts", "2 hours", "1 hour", ["event_type"])


@query(
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '1 hour' then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as session_start, max(ts) + interval '1 hour' as session_end, count(*) as n from s group by user_id, k"""
)
def sessions(spark, d):
    return streams.sessions(read_table(spark, d, "events"), "ts", "1 hour", ["user_id"])


@query(
    "select event_id, user_id, coalesce(sum((event_type = 'error')::int) over (w range between 299999999 preceding and 1 preceding), 0)::int as n_failures, "
    "coalesce(sum((event_type = 'error')::int) over (w range between 43199999999 preceding and 1 preceding), 0)::int as n_half_day from events window w as (partition by user_id order by epoch_us(ts))"
)
def failure_count_window(spark, d):
    """Failures of a user in the five minutes before each event, and in the half day before."""
    e = read_table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    failed = F.col("event_type") == "error"
    five = streams.failure_count(e, "user_id", "ts", "event_id", failed, streams.WINDOW_SECONDS).withColumnRenamed("n_failures", "n_five")
    half_day = streams.failure_count(five, "user_id", "ts", "event_id", failed, 12 * _HOUR)
    return half_day.select("event_id", "user_id", F.col("n_five").alias("n_failures"), F.col("n_failures").alias("n_half_day"))


def _throttle_sql(limit: int, seconds: int) -> str:
    """The fold of each user's events as a recursion over their places."""
    return f"""with recursive e as (select user_id, event_id, epoch_us(ts) as t, event_type as k, row_number() over (partition by user_id order by epoch_us(ts), event_id) as r from events where ts is not null),
f as (select user_id, 0::bigint as event_id, 0::bigint as r, false as blocked, []::bigint[] as recent from (select distinct user_id from e)
union all select user_id, event_id, r, len(kept) >= {limit}, case when len(kept) >= {limit} then kept when k = 'signup' then []::bigint[] when k = 'error' then list_append(kept, t) else kept end
from (select e.*, list_filter(f.recent, lambda x: e.t - x < {seconds * 1_000_000}) as kept from f join e on e.user_id = f.user_id and e.r = f.r + 1))
select user_id, event_id, blocked from f where r > 0"""


@query(_throttle_sql(streams.LIMIT, streams.WINDOW_SECONDS))
def failure_throttle(spark, d):
    """Which events of a user the throttle (five errors in five minutes) would block; a signup clears it."""
    return streams.failure_throttle(read_table(spark, d, "events"), "user_id", "ts", "event_id", "event_type", "error", "signup")


@query(_throttle_sql(2, 48 * _HOUR))
def failure_throttle_days(spark, d):
    """The same with two errors in two days, which the sparse events of the tables do reach."""
    return streams.failure_throttle(read_table(spark, d, "events"), "user_id", "ts", "event_id", "event_type", "error", "signup", limit=2, seconds=48 * _HOUR)


@query("select event_type, count(*) as n, round(sum(value), 2) as total from events group by 1")
def stream_metrics(spark, d):
    """Totals kept by a stream that runs over all there is."""
    schema = read_table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(_folder(spark, d))
    name = f"stream_metrics_{uuid4().hex[:8]}"
    return streams.run_to_end(streams.kind_totals(source.where("event_type is not null"), "event_type"), name, f"{checkpoint_dir(spark)}/{name}")


def _folder(spark, d):
    """A pattern that names the table's file or folder; streams read folders and patterns."""
    return f"{d}/[e]vents.parquet"


@query(
    """with recursive s as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as attempt, event_type = 'purchase' as ok from events where event_type in ('error', 'purchase')),
o as (select *, row_number() over (partition by user_id order by event_id) as r from s),
f as (select user_id, 0::bigint as r, 0 as due, 'running' as state from (select distinct user_id from o)
union all select o.user_id, o.r, case when state = 'running' and attempt = due then due + 1 else due end,
case when state <> 'running' or attempt <> due then state when ok then 'complete' when due + 1 > 3 then 'rejected' else 'running' end from f join o on o.user_id = f.user_id and o.r = f.r + 1)
select user_id, arg_max(state, r) as state, max(due)::int as attempts from f group by user_id"""
)
def run_state_replay(spark, d):
    """Generation runs replayed from events: a user's events are the steps of one run."""
    from pyspark.sql import Window

    e = read_table(spark, d, "events").where("event_type in ('error', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = e.select("user_id", "event_id", (F.row_number().over(w) - 1).cast("int").alias("attempt"), (F.col("event_type") == "purchase").alias("ok"))
    return streams.run_states(steps, "user_id", "event_id")


def _sources(spark, d):
    p = without_repeats(read_table(spark, d, "projects").select("id", "chunks_json"), "id")
    c = evidence.chunks(p, ["id", "kind", "text", "file"]).where("file <> '' and kind in ('function', 'notebook_cell', 'source', 'module_var')")
    code = F.regexp_replace("text", r"(?s)^(?:.*?\nCode:\n|Notebook [^\n]*:\n|[^\n]* file [^\n]*\nContent [^\n]*\n)", "")
    return c.select("project_id", F.col("id").alias("chunk_id"), "file", code.alias("code"))


@query()
def parse_code(spark, d):
    """Functions, classes, imports and declarations in the code of all chunks."""
    s = parse.symbols(_sources(spark, d), ["project_id", "chunk_id"], "file", "code")
    return s.select("project_id", "chunk_id", "file", "kind", "name", "start_line", "end_line", F.array_join("names", ",").alias("names"), F.array_join("calls", ",").alias("calls"))


@query()
def code_without_comments(spark, d):
    s = _sources(spark, d)
    return s.select("project_id", "chunk_id", "file", parse.without_comments(F.col("code"), F.col("file")).alias("code"))
