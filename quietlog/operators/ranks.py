"""Top-n, numbers and running sums per key that stay spread out when one key holds a large share of the rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietlog.session import staged

SALTS = 64


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str | None = None) -> DataFrame:
    """First n rows per key in the given (total) order, exactly.

    A first round ranks inside (key, salt) slices, so a hot key is shared by many tasks and at most
    SALTS * n of its rows reach the second round.
    """
    hashable = [f.name for f in df.schema.fields if not re.search("map|variant", f.dataType.simpleString())]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(SALTS)))
    inner = W.partitionBy(*keys, "_salt").orderBy(*order)
    outer = W.partitionBy(*keys).orderBy(*order)
    first = salted.withColumn("_n", F.row_number().over(inner)).filter(F.col("_n") <= n).drop("_n", "_salt")
    name = rank or "_n"
    out = first.withColumn(name, F.row_number().over(outer)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def last_n(df: DataFrame, keys: list[str], seq: str, n: int) -> DataFrame:
    """Last n rows per key by `seq`."""
    return top_n(df, keys, [F.desc(seq)], n)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"_{k}"])
    return out


def running_sums(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """`rows` with sums over the rows of their keys (null is a key) up to their own, in ascending order, nulls first.

    Rows are dealt out by ranges of (keys, order), so a hot key lies in many ranges; each range sums up its own rows, and starts
    at the sum of the ranges before it.  Equal rows can be cut apart too, by their place in the input.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = staged(ties.repartitionByRange(parts, *keys, *order, "_tie").withColumn("_slice", F.spark_partition_id()), "ranges")
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy(*keys, "_slice").agg(*(F.sum(c).alias(n) for n, c in sums.items())).select(
        *(F.col(k).alias(f"_{k}") for k in keys), F.col("_slice").alias("_of"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums)
    )
    joined = ranged.join(starts, _same(ranged, starts, keys) & (ranged["_slice"] == starts["_of"]))
    upto = W.partitionBy(*keys, "_slice").orderBy(*order, "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = joined.withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in sums.items()})
    return summed.drop("_tie", "_slice", "_of", *(f"_{k}" for k in keys), *(f"_{n}" for n in sums))


def numbered(rows: DataFrame, keys: list[str], order: list[str], place: str = "place", parts: int | None = None) -> DataFrame:
    """`rows` with their number within `keys`, from 1."""
    return running_sums(rows, keys, order, {place: F.lit(1).cast("long")}, parts)
