"""Grading and redacting whole corpora: one scan, column work, small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.functions import detect as D
from quietlog.functions import rules as R
from quietlog.functions.redact import mapping_of, redact
from quietlog.functions.restore import encode_token, restore
from quietlog.functions.text import pin


def grade(df: DataFrame, text: str = "text", policy: R.Policy = R.Policy()) -> DataFrame:
    """Add `graded`: struct<level, action, reason>."""
    return df.withColumn("graded", pin(D.evaluate_policy(policy, message=F.col(text))))


def grade_report(graded: DataFrame, *by: str) -> DataFrame:
    """Rows per level and the given columns."""
    return graded.groupBy(F.col("graded.level").alias("level"), *by).agg(F.count("*").alias("n"))


def rule_report(graded: DataFrame) -> DataFrame:
    """How often each reason occurs."""
    reasons = F.explode(F.split("graded.reason", "; "))
    return graded.select(reasons.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def redact_corpus(
    df: DataFrame, text: str = "text", options=R.DEFAULT_ON, rules: R.Rules = R.Rules(), option_columns=None
) -> DataFrame:
    """Add `redacted` (null above the size limit) and `replacements`."""
    return (
        df.withColumn("_r", pin(redact(F.col(text), options, rules, option_columns)))
        .withColumn("redacted", F.col("_r.text"))
        .withColumn("replacements", F.col("_r.replacements"))
        .drop("_r")
    )


def tag_report(redacted: DataFrame, *by: str) -> DataFrame:
    """Values redacted per tag and the given columns."""
    return (
        redacted.select(*by, F.explode("replacements").alias("r"))
        .groupBy(F.col("r.tag").alias("tag"), *by)
        .agg(F.count("*").alias("n_values"))
    )


def vault(redacted: DataFrame, key: str) -> DataFrame:
    """What is needed to restore a corpus, one row per text: to be kept apart from it."""
    return redacted.select(
        key, "replacements", mapping_of(F.col("replacements")).alias("mapping"), encode_token(F.col("replacements")).alias("restore_token")
    )


def vault_rows(vaulted: DataFrame, key: str) -> DataFrame:
    """The vault with one row per replacement, in replacement order."""
    return vaulted.select(key, F.posexplode("replacements").alias("ord", "r")).select(key, "ord", "r.original", "r.tag")


def restore_corpus(redacted: DataFrame, vaulted: DataFrame, key: str, text: str = "redacted", escape_html=False) -> DataFrame:
    """Join texts with their vault rows (one to one on the key) and restore inside the row."""
    both = redacted.join(vaulted.select(key, F.col("replacements").alias("_rep")), key, "left")
    empty = F.array().cast("array<struct<original:string,tag:string>>")
    return both.withColumn(
        "restored", restore(F.col(text), F.coalesce("_rep", empty), escape_html)
    ).drop("_rep")


def merged_mapping(redacted: DataFrame, group: str, order: str) -> DataFrame:
    """One row per (group, original): the tag given last, by message order and then position.

    Kept as rows: a conversation of any size stays spread over the cluster.
    """
    rows = redacted.select(group, order, F.posexplode("replacements").alias("pos", "r"))
    return (
        rows.groupBy(group, F.col("r.original").alias("original"))
        .agg(F.max_by("r.tag", F.struct(order, "pos")).alias("tag"), F.count("*").alias("times"))
    )


def redaction_counts(redacted: DataFrame, mapping: DataFrame, group: str) -> DataFrame:
    """Per group: segments processed and distinct values redacted."""
    segments = redacted.groupBy(group).agg(F.count("redacted").alias("segments_processed"))
    values = mapping.groupBy(group).agg(F.count("*").alias("redacted_values"))
    return segments.join(values, group, "left").select(
        group, "segments_processed", F.coalesce("redacted_values", F.lit(0).cast("long")).alias("redacted_values")
    )
