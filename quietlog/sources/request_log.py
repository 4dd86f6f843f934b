"""The request log: a parquet table partitioned by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.functions.payload import parse_object, vget, vkind, vstring
from quietlog.functions.text import let, pin
from quietlog.functions.tokens import input_tokens_of
from quietlog.schemas import REQUESTS

RESPONSE_COLUMNS = (
    "response_body", "status_code", "duration_ms", "output_tokens", "total_tokens", "success", "error_msg",
)


def scan(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Read the log.  `since` (date) prunes whole day partitions."""
    df = spark.read.schema(REQUESTS + ", dt date").parquet(path)
    return (df if since is None else df.filter(F.col("dt") >= F.lit(since))).drop("dt")


def append(df: DataFrame, path: str) -> None:
    """Append finished requests.  Rebalancing by day keeps files large and splits a heavy day."""
    (
        df.withColumn("status", F.lit("completed"))
        .withColumn("dt", F.to_date("timestamp"))
        .hint("rebalance", "dt")
        .write.mode("append")
        .partitionBy("dt")
        .parquet(path)
    )


def complete(pending: DataFrame, completions: DataFrame) -> DataFrame:
    """Fill response columns of pending rows from their latest completion (by `seq`), matched on id."""
    latest = completions.groupBy("id").agg(
        F.max_by(F.struct(*RESPONSE_COLUMNS), "seq").alias("r")
    )
    joined = pending.drop(*RESPONSE_COLUMNS, "status").join(latest, "id", "left")
    done = F.col("r").isNotNull()
    return joined.select(
        *[c for c in pending.columns if c not in RESPONSE_COLUMNS and c != "status"],
        *[F.col(f"r.{c}").alias(c) for c in RESPONSE_COLUMNS if c not in ("output_tokens", "total_tokens", "success")],
        F.coalesce("r.output_tokens", F.lit(0)).alias("output_tokens"),
        F.coalesce("r.total_tokens", F.lit(0)).alias("total_tokens"),
        F.coalesce("r.success", F.lit(True)).alias("success"),
        F.when(done, "completed").otherwise("pending").alias("status"),
    )


# Status codes and messages of the three ways a request can fail.
FAILURES = {
    "build": (500, "创建请求失败"),
    "cancelled": (499, "请求被取消"),
    "upstream": (502, "上游服务不可用: "),
}


def failed(kind: Column, detail: Column) -> Column:
    """struct<status_code, error_msg> for a failure kind ('build', 'cancelled', 'upstream')."""
    return F.struct(
        F.when(kind == "build", 500).when(kind == "cancelled", 499).otherwise(502).alias("status_code"),
        F.when(kind == "build", FAILURES["build"][1])
        .when(kind == "cancelled", FAILURES["cancelled"][1])
        .otherwise(F.concat(F.lit(FAILURES["upstream"][1]), detail))
        .alias("error_msg"),
    )


def parse_bodies(df: DataFrame, body: str = "request_body") -> DataFrame:
    """Add `payload` (variant, null for anything but a JSON object), `model`, `stream` and `input_tokens`."""
    v = F.col("payload")
    streaming = let(vget(v, "$.stream"), lambda s: F.when(vkind(s) == "BOOLEAN", vget(s, "$", "boolean")))
    return (
        df.withColumn("payload", pin(parse_object(F.col(body))))
        .withColumn("model", F.coalesce(vstring(v, "$.model"), F.lit("")))
        .withColumn("stream", F.coalesce(streaming, F.lit(False)))
        .withColumn("input_tokens", F.coalesce(input_tokens_of(v), F.lit(0)))
    )


def split_by_size(df: DataFrame, text: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows within the byte limit, rows above it)."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    return df.filter(size <= limit), df.filter(size > limit)
