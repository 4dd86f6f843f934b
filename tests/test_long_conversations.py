"""Token estimates of conversations that fit in no single body."""

from pyspark.sql import functions as F

from quietlog.plans import usage
from quietlog.plans.registry import QUERIES


def test_input_tokens_of_a_very_long_conversation(spark, tmp_path):
    """Null is a conversation as any other; one above the size of a variant is not taken for empty."""
    rows = spark.range(150).select(
        F.when(F.col("id") % 3 > 0, 7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.expr("repeat('é', 1000000)").alias("text")
    )
    odd = spark.createDataFrame([(8, 0, "user", None), (9, 0, "user", "abc"), (9, 1, "user", '"\n'), (9, 1, "user", '"\n')], "conv_id long, turn long, role string, text string")
    rows.unionByName(odd).write.parquet(f"{tmp_path}/conversations.parquet")
    out = QUERIES["estimate_input_tokens"](spark, str(tmp_path))
    assert {r.conv_id: r.input_tokens for r in out.collect()} == {7: 100_000_000, None: 50_000_000, 8: 0, 9: 3}
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_input_tokens_beyond_four_gigabytes(spark, tmp_path, monkeypatch):
    """The sum of a conversation of more than 4 GB is a long; its turns are only said to be so long."""
    monkeypatch.setattr(usage, "message_bytes", lambda c: F.length(c).cast("long") * 2**31)
    spark.createDataFrame([(1, i, "user", "abc") for i in range(7)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.input_tokens for r in QUERIES["estimate_input_tokens"](spark, str(tmp_path)).collect()] == [21 * 2**30]
