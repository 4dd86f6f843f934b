"""Limiter audits and streaming queries; streams run over the given tables until all is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietlog.operators import limits as L
from quietlog.plans import data
from quietlog.plans.transcripts import GRADING, _duck_nodes
from quietlog.plans.usage import LOG, TOKENS
from quietlog.session import scratch
from quietlog.sources import tracks
from quietlog.streaming import jobs

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


EVENTS = "ev as (select user_id % 10 as key, event_id as id, epoch_us(ts) as ts_us, row_number() over (partition by user_id % 10 order by ts, event_id) as n from events)"
MAX, SIZE = 3, 7200


def events(spark, sf):
    return data.table(spark, sf, "events").select(
        F.expr("user_id % 10").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")
    )


@query(
    "window_limit_audit",
    f"""with recursive {EVENTS}, walk as (
      select key, id, ts_us, n, ts_us as window_start_us, 1 as nth from ev where n = 1
      union all
      select e.key, e.id, e.ts_us, e.n, case when e.ts_us - w.window_start_us > {SIZE}000000 then e.ts_us else w.window_start_us end,
        case when e.ts_us - w.window_start_us > {SIZE}000000 then 1 else w.nth + 1 end
      from walk w join ev e on e.key = w.key and e.n = w.n + 1)
    select key, id, window_start_us, nth <= {MAX} as allowed, greatest({MAX} - nth, 0) as remaining from walk""",
)
def window_limit_audit(spark, sf):
    """Small chunks, so that every key is cut and chained."""
    out = L.window_limit(events(spark, sf), MAX, SIZE, chunk_rows=400)
    return out.select("key", "id", "window_start_us", "allowed", "remaining")


RATE, BURST = 1, 2


@query(
    "token_bucket_audit",
    f"""with recursive squeezed as (select key, id, n, ts_us // 2000 as t from ({EVENTS.split('as (', 1)[1][:-1]}) e), walk as (
      select key, id, n, t, ({BURST - 1} * 1000000)::bigint as tokens, true as allowed from squeezed where n = 1
      union all
      select e.key, e.id, e.n, e.t, case when least({BURST}000000, w.tokens + (e.t - w.t) * {RATE}) >= 1000000
          then least({BURST}000000, w.tokens + (e.t - w.t) * {RATE}) - 1000000 else least({BURST}000000, w.tokens + (e.t - w.t) * {RATE}) end,
        least({BURST}000000, w.tokens + (e.t - w.t) * {RATE}) >= 1000000
      from walk w join squeezed e on e.key = w.key and e.n = w.n + 1)
    select key, id, allowed, tokens / 1000000 as tokens from walk""",
)
def token_bucket_audit(spark, sf):
    """Time squeezed, so that buckets run dry; small chunks, so that every key is cut and chained."""
    fast = events(spark, sf).withColumn("ts_us", F.floor(F.col("ts_us") / 2000))
    out = L.token_bucket(fast, requests=20, window_seconds=20, chunk_rows=400)
    return out.select("key", "id", "allowed", "tokens")


# ---- streams


def _requests_stream(spark, sf):
    raw = jobs.read_table(spark, sf, "events").withColumn("timestamp", F.col("ts").cast("timestamp"))
    pending = F.col("event_id") % 50 == 0
    return raw.select(
        F.col("event_id").alias("id"),
        "timestamp",
        F.expr("user_id % 7").alias("provider_no"),
        F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int").alias("input_tokens"),
        F.when(pending, 0).otherwise(F.floor("value").cast("int")).alias("output_tokens"),
        pending.alias("pending"),
    )


def _drain(spark, df, name):
    out, checkpoint = scratch(spark, name), scratch(spark, f"{name}-checkpoint")
    jobs.append_parquet(df, out, checkpoint).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _settled(spark, df, name):
    """Windows as they stand when the stream has been read, those included that the watermark still keeps open."""
    out = scratch(spark, name)
    jobs.upsert_parquet(df, out, scratch(spark, f"{name}-checkpoint"), keys=["window_start"]).awaitTermination()
    return jobs.latest(spark, out, ["window_start"], [c for c in df.columns if c != "window_start"])


@query(
    "hourly_stream",
    f"{LOG} select epoch_us(date_trunc('hour', timestamp)) as hour_us, {TOKENS} from requests group by 1",
)
def hourly_stream(spark, sf):
    done = _settled(spark, jobs.hourly_stream(_requests_stream(spark, sf)), "hourly")
    return done.select(F.unix_micros("window_start").alias("hour_us"), "requests", "input_tokens", "output_tokens")


@query(
    "recent_rate_stream",
    f"""{LOG}, w as (select date_trunc('minute', timestamp) - to_minutes(unnest(range(5))) as start, * from requests)
    select epoch_us(start) as start_us, count(*) / 5 as requests_per_min, sum(input_tokens) / 5 as input_per_min, sum(output_tokens) / 5 as output_per_min from w
    group by start""",
)
def recent_rate_stream(spark, sf):
    done = _settled(spark, jobs.recent_rate_stream(_requests_stream(spark, sf)), "rates")
    return done.select(F.unix_micros("window_start").alias("start_us"), "requests_per_min", "input_per_min", "output_per_min")


@query("usage_incremental", f"{LOG} select id % 10 as shard, {TOKENS} from requests group by 1")
def usage_incremental(spark, sf):
    counters = jobs.usage_counters(_requests_stream(spark, sf), F.expr("id % 10").alias("shard"))
    out = scratch(spark, "counters")
    jobs.upsert_parquet(counters, out, scratch(spark, "counters-checkpoint"), keys=["shard"]).awaitTermination()
    return jobs.latest(spark, out, ["shard"], ["requests", "input_tokens", "output_tokens"])


#: after all data: what is still open at the end of the given tables is settled
END = "timestamp '2200-01-01'"
NO_ID = -(2**63)


@query(
    "request_two_phase_stream",
    f"""{LOG} select status, count(*) as n, case when status = 'completed' then sum(output_tokens)::bigint end as output_tokens from requests group by 1""",
)
def request_two_phase_stream(spark, sf):
    """Arrivals joined with completions that come 30 s later; heartbeats behind the last row settle the unmatched."""
    arrivals = _requests_stream(spark, sf).select("id", "timestamp", "input_tokens")
    done = _requests_stream(spark, sf).filter("not pending").select(
        "id", (F.col("timestamp") + F.expr("INTERVAL 30 SECONDS")).alias("completed_at"), "output_tokens"
    )
    left, right, out = (scratch(spark, f"two-phase-{x}") for x in ("arrivals", "completions", "out"))
    joined = jobs.complete_stream(jobs.with_heartbeat(arrivals, left), jobs.with_heartbeat(done, right))
    jobs.settled_parquet(joined, out, scratch(spark, "two-phase-checkpoint"),
        lambda: jobs.beat(arrivals, left, "timestamp", F.expr(END)),
        lambda: jobs.beat(done, right, "completed_at", F.expr(END), id=F.lit(NO_ID)),
    )
    rows = spark.read.schema(joined.schema).parquet(out).where("id is not null")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("output_tokens").alias("output_tokens"))


@query(
    "window_limit_stream",
    ORACLE["window_limit_audit"].rsplit("select", 1)[0] + f"select id, nth <= {MAX} as allowed from walk",
)
def window_limit_stream(spark, sf):
    raw = jobs.read_table(spark, sf, "events").select(
        F.expr("user_id % 10").cast("string").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")
    )
    beats, out = scratch(spark, "limits-beats"), scratch(spark, "limits")
    judged = jobs.window_limit_stream(jobs.with_heartbeat(raw, beats), MAX, SIZE)
    jobs.settled_parquet(judged, out, scratch(spark, "limits-checkpoint"), lambda: jobs.beat(raw, beats, "ts_us", F.unix_micros(F.expr(END))))
    return spark.read.schema(judged.schema).parquet(out).where("id is not null").select("id", "allowed")


GUARD_TEXT = "text || case turn % 3 when 0 then ' my password is pw' || turn when 1 then ' see ~/.ssh/id_rsa' else '' end"


@query(
    "guard_stream",
    f"""with payloads as (select conv_id * 1000 + turn as payload_id, conv_id, json_object('messages', json_array(json_object('role', role, 'content', {GUARD_TEXT}))) as body
      from conversations), {_duck_nodes()}, {GRADING},
    hits as (select payload_id, bool_or(decision = 'redact') as red from entries group by 1),
    ended as (select case when base = 'allow' and coalesce(red, false) then 'redact' else base end as action, base from decided left join hits using (payload_id))
    select 'released ' || action as what, count(*) filter (base <> 'block') as n from ended group by 1
    union all select 'audited ' || track || ' ' || decision, count(*) from entries, (values ('full'), ('clean')) v(track) group by 1""",
)
def guard_stream(spark, sf):
    """Live guard over payloads made from the conversation stream; result: what the audit and the output hold."""
    raw = jobs.read_table(spark, sf, "conversations").select(
        F.expr("conv_id * 1000 + turn").alias("payload_id"),
        F.concat(F.lit("c"), F.col("conv_id")).alias("session"),
        F.to_json(
            F.struct(
                F.array(
                    F.struct("role", F.expr(GUARD_TEXT).alias("content"))
                ).alias("messages")
            )
        ).alias("body"),
    )
    audit, out = scratch(spark, "audit"), scratch(spark, "guarded")
    jobs.guard_stream(raw, F.col("session"), "payload_id", audit, out, scratch(spark, "guard-checkpoint"), buckets=8, order=F.col("payload_id")).awaitTermination()
    released = spark.read.parquet(f"{out}/released")
    counts = released.groupBy(F.concat(F.lit("released "), "decision.action").alias("what")).agg(F.count("body_out").alias("n"))
    rows = tracks.read_track(spark, audit, "full").unionByName(tracks.read_track(spark, audit, "clean"))
    kept = rows.groupBy(F.concat(F.lit("audited "), "track", F.lit(" "), F.col("metadata")["decision"]).alias("what")).agg(F.count("*").alias("n"))
    return counts.unionByName(kept)
