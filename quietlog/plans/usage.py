"""Queries over the request log, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietlog.functions.chat import remap_models
from quietlog.functions.payload import parse_object, vget
from quietlog.functions.text import pin
from quietlog.functions.tokens import message_bytes, output_tokens, text_tokens
from quietlog.operators import usage as U
from quietlog.operators.guard import safe_session_id, session_of
from quietlog.operators.limits import limiter_state
from quietlog.plans import data
from quietlog.plans.data import AS_OF_SQL as NOW
from quietlog.session import scratch
from quietlog.sources import request_log
from quietlog.sources.providers import PROVIDERS, providers

QUERIES, ORACLE = {}, {}
LOG = "with " + data.duck_requests()
STAMP = "epoch_us(timestamp) as ts_us"
TOKENS = (
    "count(*) as requests, coalesce(sum(input_tokens), 0)::bigint as input_tokens,"
    " coalesce(sum(output_tokens), 0)::bigint as output_tokens"
)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def with_stamp(df):
    return df.withColumn("ts_us", F.unix_micros("timestamp")).drop("timestamp")


def log(spark, sf, bodies=False):
    """The log as the reference stores it: client address resolved, helper columns gone."""
    df = data.requests(spark, sf, bodies).withColumn("client_ip", U.client_of(F.col("xff"), F.col("remote")))
    return df.drop("xff", "remote", "session_header")


CLIENT = "case when xff <> '' then trim(string_split(xff, ',')[1]) else remote end"
FULL = (
    f"select id, {STAMP}, provider, model, stream, method, path, {CLIENT} as client_ip, request_body, response_body,"
    " status_code, duration_ms, input_tokens, output_tokens, total_tokens, success, error_msg, status from requests"
)


@query("request_log_scan", f"{LOG} {FULL} where timestamp >= TIMESTAMP '2024-01-20 00:00:00'")
def request_log_scan(spark, sf):
    """Written as a day-partitioned table, then read from a given day on."""
    path = scratch(spark, "requests")
    df = log(spark, sf)
    df.withColumn("dt", F.to_date("timestamp")).hint("rebalance", "dt").write.partitionBy("dt").parquet(path)
    return with_stamp(request_log.scan(spark, path, since="2024-01-20"))


@query("request_log_append", f"{LOG} select status, {TOKENS} from ({FULL.replace(', status from', ', $$completed$$ as status from')}) x group by status".replace("$$", "'"))
def request_log_append(spark, sf):
    """Two appends of finished requests, then totals of the table."""
    path = scratch(spark, "requests")
    df = log(spark, sf)
    request_log.append(df.filter("id % 2 = 0"), path)
    request_log.append(df.filter("id % 2 = 1"), path)
    return U.usage_by(request_log.scan(spark, path), "status")


@query(
    "request_two_phase",
    f"""{LOG} select id, {STAMP}, provider, model, input_tokens, case when status = 'pending' then null
        when id % 7 = 0 then case id % 3 when 0 then 500 when 1 then 499 else 502 end else status_code end as status_code,
      case when status = 'pending' or id % 7 = 0 then 0 else output_tokens end as output_tokens,
      case when status = 'pending' then true when id % 7 = 0 then false else success end as success,
      case when status = 'pending' then null when id % 7 = 0 then case id % 3 when 0 then '创建请求失败' when 1 then '请求被取消'
        else '上游服务不可用: refused' end else error_msg end as error_msg, status from requests""",
)
def request_two_phase(spark, sf):
    """Arrivals joined with the latest of up to two completions each."""
    df = log(spark, sf)
    pending = df.withColumn("status", F.lit("pending"))
    kind = F.when(F.col("id") % 3 == 0, "build").when(F.col("id") % 3 == 1, "cancelled").otherwise("upstream")
    failure = request_log.failed(kind, F.lit("refused"))
    broken = F.col("id") % 7 == 0
    done = df.filter("status = 'completed'").select("id", *request_log.RESPONSE_COLUMNS)
    first = done.withColumn("seq", F.lit(1)).withColumn("status_code", F.lit(100))
    last = (
        done.withColumn("seq", F.lit(2))
        .withColumn("error_msg", F.when(broken, failure["error_msg"]).otherwise(F.col("error_msg")))
        .withColumn("status_code", F.when(broken, failure["status_code"]).otherwise(F.col("status_code")))
        .withColumn("output_tokens", F.when(broken, 0).otherwise(F.col("output_tokens")))
        .withColumn("success", F.when(broken, False).otherwise(F.col("success")))
    )
    out = request_log.complete(pending, first.unionByName(last))
    return with_stamp(out).select(
        "id", "ts_us", "provider", "model", "input_tokens", "status_code", "output_tokens", "success", "error_msg", "status"
    )


BODY_LEN = "strlen('ask ' || id || ' é')"


@query(
    "request_body_parse",
    f"""{LOG} select id, case when id % 97 = 0 then '' else json_extract_string(request_body, '$.model') end as model,
      case when id % 97 = 0 then false else id % 3 = 0 end as stream,
      case when id % 97 = 0 then 0 else ({BODY_LEN} // 2)::int end as input_tokens from
      (select id, case when id % 97 = 0 then '{{}}' else request_body end as request_body from requests) r""",
)
def request_body_parse(spark, sf):
    df = request_log.parse_bodies(data.requests(spark, sf, bodies=True).select("id", "request_body"))
    return df.select("id", "model", "stream", "input_tokens")


STATS = f"""select count(*) as total_requests, sum(input_tokens)::bigint as total_input_tokens, sum(output_tokens)::bigint as total_output_tokens,
  sum(input_tokens + output_tokens)::bigint as total_tokens, count(*) filter (d) as today_requests,
  coalesce(sum(input_tokens) filter (d), 0)::bigint as today_input_tokens, coalesce(sum(output_tokens) filter (d), 0)::bigint as today_output_tokens,
  coalesce(sum(input_tokens + output_tokens) filter (d), 0)::bigint as today_tokens,
  (count(*) filter (m)) / 5 as requests_per_min, coalesce(sum(input_tokens) filter (m), 0) / 5 as input_per_min,
  coalesce(sum(output_tokens) filter (m), 0) / 5 as output_per_min
  from (select *, timestamp::date = {NOW}::date as d, timestamp >= {NOW} - interval 5 minute as m from requests) x"""


@query("stats_json_sink", f"{LOG} {STATS}")
def stats_json_sink(spark, sf):
    """Stats row written as JSON and read back."""
    path = scratch(spark, "stats")
    stats = U.stats(log(spark, sf), data.as_of())
    stats.write.json(path)
    return spark.read.schema(stats.schema).json(path)


_VALUES = ", ".join(f"('{p}', '{n}', {len(m)}, {repr(m[-1]) if m else 'null'})" for p, n, _, _, m in PROVIDERS)
DIM = f"dim as (select * from (values {_VALUES}) v(provider, name, n_models, last_model))"


@query(
    "provider_dim",
    f"{LOG}, {DIM}, u as (select provider, {TOKENS} from requests group by provider) select dim.*, requests, input_tokens, output_tokens from dim join u using (provider)",
)
def provider_dim(spark, sf):
    used = U.usage_by(log(spark, sf), "provider")
    dim = providers(spark).select(
        "provider", "name", F.size("models").alias("n_models"), F.try_element_at("models", F.lit(-1)).alias("last_model")
    )
    return used.join(F.broadcast(dim), "provider")


@query(
    "model_remap",
    f"""{LOG}, {DIM} select r.provider, case when lower(model) like 'claude-%' and last_model is not null then last_model else model end as model,
      count(*) as n from requests r left join dim using (provider) group by 1, 2""",
)
def model_remap(spark, sf):
    return remap_models(log(spark, sf), providers(spark)).groupBy("provider", "model").agg(F.count("*").alias("n"))


LITE = "id, provider, model, stream, method, path, client_ip, status_code, duration_ms, input_tokens, output_tokens, total_tokens, success"


@query("history_lite", f"{LOG} select ts_us, {LITE} from ({FULL}) x where status_code is not null")
def history_lite(spark, sf):
    return with_stamp(U.history(log(spark, sf), limit=None))


@query("recent_requests", f"{LOG} select ts_us, {LITE}, error_msg from (select * from ({FULL}) x order by ts_us desc, id desc limit 120) y where status_code is not null")
def recent_requests(spark, sf):
    return with_stamp(U.recent(log(spark, sf), 120))


@query("request_by_id", f"{LOG} {FULL} where id = 77")
def request_by_id(spark, sf):
    return with_stamp(U.by_id(log(spark, sf), 77))


@query(
    "path_version_strip",
    f"{LOG} select path, trim(regexp_replace(path, '^/?v\\d+[a-z]*(?:/|$)', ''), '/') as stripped, count(*) as n from requests group by 1, 2",
)
def path_version_strip(spark, sf):
    return log(spark, sf).groupBy("path", U.strip_version(F.col("path")).alias("stripped")).agg(F.count("*").alias("n"))


ROUTE = """case when path in ('/', '/health', '/ready', '/stats', '/redact') or starts_with(path, '/privacy/') or starts_with(path, '/context/')
  or starts_with(path, '/sessions/') then 'local' when regexp_replace(path, '/$', '') in ('/models', '/v1/models', '/v2/models', '/v3/models') then 'models'
  when trim(regexp_replace(path, '^/?v\\d+[a-z]*(?:/|$)', ''), '/') = 'messages' then 'messages' else 'other' end"""


@query("usage_by_route", f"{LOG} select {ROUTE} as route, {TOKENS} from requests group by 1")
def usage_by_route(spark, sf):
    return U.usage_by(log(spark, sf), U.route_class(F.col("path")).alias("route"))


@query("usage_by_client", f"{LOG} select {CLIENT} as client, {TOKENS} from requests group by 1")
def usage_by_client(spark, sf):
    return U.usage_by(log(spark, sf), F.col("client_ip").alias("client"))


def _duck_text(path: str) -> str:
    return f"case when json_type(b, '{path}') = 'VARCHAR' then nullif(trim(json_extract_string(b, '{path}')), '') end"


SESSION = f"""{LOG}, s as (select input_tokens, output_tokens, coalesce(nullif(trim(session_header), ''), {_duck_text('$.session_id')}, {_duck_text('$.conversation_id')},
  {_duck_text('$.thread_id')}, 'request-' || id) as s from (select *, case when id % 97 = 0 then '{{}}' else request_body end as b from requests) x)"""


@query("sessionize_requests", f"{SESSION} select substr(regexp_replace(s, '[^A-Za-z0-9_-]', '_', 'g'), 1, 128) as session_id, {TOKENS} from s group by 1")
def sessionize_requests(spark, sf):
    """Requests without a session get one of their own (the row id stands in for a random one)."""
    headers = F.create_map(F.lit("X-Session-Id"), F.col("session_header"))
    df = data.requests(spark, sf, bodies=True).withColumn("payload", pin(parse_object(F.col("request_body"))))
    sid = session_of(headers, F.col("payload"), F.concat(F.lit("request-"), F.col("id")))
    return U.usage_by(df, sid.alias("session_id"))


@query(
    "safe_session_id",
    """select url, case when page_id % 20 = 0 then 'default'
      else substr(regexp_replace(repeat(url, page_id::int % 4 + 1), '[^A-Za-z0-9_-]', '_', 'g'), 1, 128) end as session_id from pages""",
)
def safe_session_ids(spark, sf):
    """Urls once to four times over, so that some are too long; some names are blank."""
    url = F.expr("case when page_id % 20 = 0 then ' ' else repeat(url, cast(page_id % 4 as int) + 1) end")
    return data.table(spark, sf, "pages").select("url", safe_session_id(url).alias("session_id"))


@query(
    "errors_by_model",
    f"""{LOG}, x as (select *, coalesce(status_code between 400 and 599, false) as bad from requests)
    select provider, model, count(status_code) as finished, count(*) filter (bad) as errors, count(*) filter (status_code = 200) as successes,
      arg_max(case when strlen(response_body) > 60 then substr(response_body, 1, 60) || '...(truncated)' else response_body end, (timestamp, id)) filter (bad) as sample
    from x group by 1, 2""",
)
def errors_by_model(spark, sf):
    """A limit of 60 bytes, so that the test bodies are cut."""
    return U.errors_by_model(log(spark, sf), body_limit=60)


@query(
    "masked_export",
    "select c_custkey, case when strlen(c_name) <= 8 then '****' else c_name[:4] || '****' || c_name[-4:] end as c_name,"
    " case when strlen(c_custkey::varchar) <= 8 then '****' else '?' end as masked_key from customer",
)
def masked_export(spark, sf):
    key = F.col("c_custkey").cast("string")
    return data.table(spark, sf, "customer").select("c_custkey", U.mask(F.col("c_name")).alias("c_name"), U.mask(key).alias("masked_key"))


@query("usage_totals", f"{LOG} select requests, input_tokens, output_tokens, input_tokens + output_tokens as total_tokens from (select {TOKENS} from requests) x")
def usage_totals(spark, sf):
    return U.totals(log(spark, sf))


@query("usage_stats", f"{LOG} {STATS}")
def usage_stats(spark, sf):
    return U.stats(log(spark, sf), data.as_of())


@query(
    "usage_hourly",
    f"""{LOG} select strftime(timestamp, '%Y-%m-%d %H:00') as hour, {TOKENS}, (sum(input_tokens) + sum(output_tokens))::bigint as total_tokens
      from requests where timestamp >= {NOW} - interval 240 hour group by 1""",
)
def usage_hourly(spark, sf):
    return U.hourly(log(spark, sf), data.as_of(), 240)


@query(
    "usage_dashboard",
    f"""with recursive {data.duck_requests()}, ev as (select provider, epoch_us(timestamp) as t, row_number() over (partition by provider order by timestamp, id) as n from requests),
    walk as (select provider, n, t, t as w, 1 as nth from ev where n = 1 union all
      select e.provider, e.n, e.t, case when e.t - k.w > 3600000000 then e.t else k.w end, case when e.t - k.w > 3600000000 then 1 else k.nth + 1 end
      from walk k join ev e on e.provider = k.provider and e.n = k.n + 1),
    state as (select provider, arg_max(least(nth, 3), n)::bigint as request_count, arg_max(greatest(0, w + 3600000000 - t), n)::bigint as window_remaining_us from walk group by 1),
    dim as (select * from (values {", ".join(f"('{p}', '{n}', '{','.join(m)}')" for p, n, _, _, m in PROVIDERS)}) v(provider, name, models)),
    used as (select provider, {TOKENS}, (sum(input_tokens) + sum(output_tokens))::bigint as total_tokens from requests group by 1)
    select used.*, request_count, 3::bigint as rate_limit, window_remaining_us, name, models from used join state using (provider) join dim using (provider)""",
)
def usage_dashboard(spark, sf):
    """Stats and limiter state per provider, one row each, with name and models."""
    df = log(spark, sf)
    events = df.select(F.col("provider").alias("key"), "id", F.unix_micros("timestamp").alias("ts_us"))
    state = limiter_state(events, 3, 3600, per_key=True).withColumnRenamed("key", "provider")
    used = U.usage_by(df, "provider").withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    dim = providers(spark).select("provider", "name", F.array_join("models", ",").alias("models"))
    return used.join(state, "provider").join(F.broadcast(dim), "provider")


# ---- tokens


@query(
    "estimate_input_tokens",
    "select conv_id, (sum(strlen(text)) // 2)::bigint as input_tokens from conversations group by conv_id",
)
def estimate_input_tokens(spark, sf):
    """Turns are measured row by row, so a conversation of any size is summed before the shuffle and never gathered."""
    turns = data.table(spark, sf, "conversations").select("conv_id", message_bytes(F.col("text")).alias("size"))
    return turns.groupBy("conv_id").agg(F.floor(F.sum("size") / 2).cast("long").alias("input_tokens"))


@query(
    "estimate_text_tokens",
    "select conv_id, turn, (length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) // 2)::int as tokens from (select conv_id, turn, '  ' || text || chr(10) as text from conversations) c",
)
def estimate_text_tokens(spark, sf):
    padded = F.concat(F.lit("  "), "text", F.lit("\n"))
    return data.table(spark, sf, "conversations").select("conv_id", "turn", text_tokens(padded).alias("tokens"))


ODD_BODY = """case id % 5 when 0 then '{"content": ["a", {"text": "b' || id || '"}], "text": "t"}'
  when 1 then '{"output_text": "o' || id || '", "choices": [{"text": "c"}]}' when 2 then 'no json ' || id else response_body end"""
ODD_TEXT = """case id % 5 when 0 then 'ab' || id || 't' when 1 then 'o' || id || 'c' when 2 then null
  else json_extract_string(response_body, '$.choices[0].message.content') end"""


@query("extract_response_text", f"{LOG} select id, {ODD_TEXT} as text from requests where status = 'completed'")
def extract_response_text(spark, sf):
    from quietlog.functions.tokens import response_text

    df = log(spark, sf, bodies=True).filter("status = 'completed'").select("id", pin(parse_object(F.expr(ODD_BODY))).alias("v"))
    return df.select("id", F.when(F.col("v").isNotNull(), response_text(F.col("v"))).alias("text"))


@query(
    "usage_extract",
    f"""{LOG}, b as (select id, input_tokens, {ODD_BODY} as body, {ODD_TEXT} as text from requests where status = 'completed'),
    u as (select *, case when id % 5 = 2 then null else coalesce(try_cast(json_extract(body, '$.usage.completion_tokens') as bigint),
      try_cast(json_extract(body, '$.usage.total_tokens') as bigint)) end as reported from b)
    select id, coalesce(nullif(reported, 0), nullif(length(text) // 2, 0), length(body) // 2)::int as output_tokens,
      (input_tokens + coalesce(nullif(reported, 0), nullif(length(text) // 2, 0), length(body) // 2))::int as total_tokens from u""",
)
def usage_extract(spark, sf):
    df = log(spark, sf, bodies=True).filter("status = 'completed'").withColumn("b", F.expr(ODD_BODY))
    df = df.withColumn("v", pin(parse_object(F.col("b"))))
    out = df.select("id", "input_tokens", pin(output_tokens(F.col("b"), F.col("v"))).alias("output_tokens"))
    return out.select("id", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


@query(
    "pending_timeout",
    f"{LOG} select id, {STAMP}, provider from requests where status = 'pending' and timestamp < {NOW} - interval 120 second",
)
def pending_timeout(spark, sf):
    df = log(spark, sf)
    late = U.pending_timeouts(df.select("id", "timestamp", "provider"), df.filter("status = 'completed'"), data.as_of())
    return with_stamp(late)
