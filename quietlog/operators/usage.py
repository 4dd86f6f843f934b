"""Usage statistics over the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlog.functions.text import byte_prefix, trim_space

LITE = (
    "id", "timestamp", "provider", "model", "stream", "method", "path", "client_ip",
    "status_code", "duration_ms", "input_tokens", "output_tokens", "total_tokens", "success",
)
BODIES = ("request_body", "response_body")


def history(requests: DataFrame, limit: int | None = 20) -> DataFrame:
    """Finished requests without bodies, newest first."""
    out = requests.select(*LITE).filter(F.col("status_code").isNotNull()).orderBy(F.desc("timestamp"), F.desc("id"))
    return out if limit is None else out.limit(limit)


def recent(requests: DataFrame, limit: int) -> DataFrame:
    """The newest `limit` requests, of which unfinished ones are then left out."""
    newest = requests.select(*LITE, "error_msg").orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
    return newest.filter(F.col("status_code").isNotNull())


def by_id(requests: DataFrame, request_id: int) -> DataFrame:
    return requests.filter(F.col("id") == request_id)


def pretty_json(body: Column, schema: str) -> Column:
    """Indented JSON of a body with a known schema."""
    return F.to_json(F.from_json(body, schema), {"pretty": "true"})


def strip_version(path: Column) -> Column:
    """Path without a leading /v<digits><letters> segment and without slashes at the ends."""
    return F.btrim(F.regexp_replace(path, r"^/?v\d+[a-z]*(?:/|\z)", ""), F.lit("/"))


# Local endpoints and their prefixes.
LOCAL_PATHS = ("/", "/health", "/ready", "/stats", "/redact")
LOCAL_PREFIXES = ("/privacy/", "/context/", "/sessions/")


def is_models_path(path: Column) -> Column:
    return F.regexp_replace(path, r"/\z", "").isin("/models", "/v1/models", "/v2/models", "/v3/models")


def is_messages_path(path: Column) -> Column:
    return strip_version(path) == "messages"


def route_class(path: Column) -> Column:
    local = path.isin(*LOCAL_PATHS)
    for prefix in LOCAL_PREFIXES:
        local = local | path.startswith(prefix)
    return (
        F.when(local, "local").when(is_models_path(path), "models").when(is_messages_path(path), "messages").otherwise("other")
    )


def client_of(forwarded_for: Column, remote: Column) -> Column:
    """First forwarded address, trimmed (even if that is empty), else the remote address."""
    given = F.coalesce(forwarded_for != "", F.lit(False))
    return F.when(given, trim_space(F.element_at(F.split(forwarded_for, ","), 1))).otherwise(remote)


def _tokens(name: str) -> Column:
    return F.coalesce(F.sum(F.col(name).cast("long")), F.lit(0).cast("long"))


def usage_by(requests: DataFrame, *by) -> DataFrame:
    """Requests and tokens per group; pending requests count."""
    return requests.groupBy(*by).agg(
        F.count("*").alias("requests"),
        _tokens("input_tokens").alias("input_tokens"),
        _tokens("output_tokens").alias("output_tokens"),
    )


def totals(requests: DataFrame) -> DataFrame:
    return (
        usage_by(requests)
        .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    )


def stats(requests: DataFrame, as_of: Column) -> DataFrame:
    """Totals, today's part and rates over the last five minutes, in one pass.

    `as_of` stands for the current time (a literal, or a column holding one value).
    """
    ts = F.col("timestamp")
    scopes = {
        "total": F.lit(True),
        "today": F.to_date(ts) == F.to_date(as_of),
        "recent": ts >= as_of - F.expr("INTERVAL 5 MINUTES"),
    }
    aggs = []
    for scope, inside in scopes.items():
        aggs.append(F.count_if(inside).alias(f"{scope}_requests"))
        for kind in ("input", "output"):
            amount = F.sum(F.when(inside, F.col(f"{kind}_tokens").cast("long")))
            aggs.append(F.coalesce(amount, F.lit(0).cast("long")).alias(f"{scope}_{kind}_tokens"))
    both = {s: (F.col(f"{s}_input_tokens") + F.col(f"{s}_output_tokens")).alias(f"{s}_tokens") for s in ("total", "today")}
    return requests.agg(*aggs).select(
        "total_requests", "total_input_tokens", "total_output_tokens", both["total"],
        "today_requests", "today_input_tokens", "today_output_tokens", both["today"],
        (F.col("recent_requests") / 5).alias("requests_per_min"),
        (F.col("recent_input_tokens") / 5).alias("input_per_min"),
        (F.col("recent_output_tokens") / 5).alias("output_per_min"),
    )


def stats_json(stats_row: DataFrame) -> DataFrame:
    return stats_row.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))


def hourly(requests: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Requests and tokens per UTC hour since `hours` before `as_of`, newest first."""
    since = as_of - F.make_interval(hours=F.lit(hours))
    hour = F.date_format(F.date_trunc("hour", "timestamp"), "yyyy-MM-dd HH:00")
    return (
        usage_by(requests.filter(F.col("timestamp") >= since), hour.alias("hour"))
        .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
        .orderBy(F.desc("hour"))
    )


def errors_by_model(requests: DataFrame, body_limit: int = 500) -> DataFrame:
    """Errors (4xx, 5xx) and successes (200 only) per provider and model, with the newest error body, cut."""
    status = F.col("status_code")
    is_error = F.coalesce(status.between(400, 599), F.lit(False))
    body = F.col("response_body")
    cut = F.when(F.octet_length(body) > body_limit, F.concat(byte_prefix(body, body_limit), F.lit("...(truncated)"))).otherwise(body)
    return (
        requests.groupBy("provider", "model")
        .agg(
            F.count("status_code").alias("finished"),
            F.count_if(is_error).alias("errors"),
            F.count_if(status == 200).alias("successes"),
            # only the newest body is kept while aggregating, and it is cut first
            F.max_by(F.when(is_error, cut), F.when(is_error, F.struct("timestamp", "id"))).alias("sample"),
        )
    )


def mask(c: Column) -> Column:
    """**** for up to 8 bytes, else first four + **** + last four bytes."""
    head = byte_prefix(c, 4)
    tail = F.decode(F.substring(c.cast("binary"), -4, 4), "UTF-8")
    return F.when(F.octet_length(c) <= 8, "****").otherwise(F.concat(head, F.lit("****"), tail))


def pending_timeouts(requests: DataFrame, completions: DataFrame, as_of: Column, seconds: int = 120) -> DataFrame:
    """Requests older than the time-out that no completion exists for."""
    old = requests.filter(F.col("timestamp") < as_of - F.make_interval(secs=F.lit(seconds)))
    return old.join(completions.select("id"), "id", "left_anti")
