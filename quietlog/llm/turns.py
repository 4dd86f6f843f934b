"""Running sums and digests within keys of any size, that don't gather a key's rows in one task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: rows that one group of a running sum has
SPAN = 1024


def running(rows: DataFrame, key: str, at: str, sums: dict[str, str]) -> DataFrame:
    """`rows`, one for each (key, at), with the sums over smaller `at` of the columns that `sums` names: {new: summed}."""
    group = (F.col(at) / SPAN).cast("long")
    cut = rows.withColumn("_group", group)
    total = cut.groupBy(key, "_group").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    earlier = W.partitionBy(key).orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    base = total.select(F.col(key).alias("_key"), F.col("_group").alias("_of"), *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    within = W.partitionBy(key, "_group").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    joined = cut.join(base, cut[key].eqNullSafe(base["_key"]) & (cut["_group"] == base["_of"]))
    both = joined.withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    return both.drop("_group", "_key", "_of", *(f"_{n}" for n in sums))


def joined_sha256(rows: DataFrame, key: str, order: str, part: Column, name: str) -> DataFrame:
    """(key, `name`): lowercase SHA-256 hex of each key's parts, in order, concatenated, without the first character.

    A digest is sequential, so a key's parts pass through one task, but in a stream: none but the current one is held.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_key, first = None, None, False
        for batch in batches:
            keys, done = batch.column(0).to_pylist(), []
            for k, text in zip(keys, batch.column(2), strict=True):
                if now is None or k != open_key:
                    if now is not None:
                        done.append((open_key, now.hexdigest()))
                    now, open_key, first = hashlib.sha256(), k, True
                data = text.as_py()
                if data:
                    now.update((data[1:] if first else data).encode())
                    first = False
            if done:
                yield packed(done, batch.schema.field(0).type)
            last_type = batch.schema.field(0).type
        if now is not None:
            yield packed([(open_key, now.hexdigest())], last_type)

    def packed(done: list, kind: pa.DataType) -> pa.RecordBatch:
        return pa.record_batch([pa.array([k for k, _ in done], kind), pa.array([d for _, d in done], pa.string())], [key, name])

    slim = rows.select(key, order, part.alias("_part"))
    return slim.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"`{key}` {kind}, `{name}` string")
