"""Streams whose state is settled: limiter windows and two-phase requests, whatever order and batches the rows come in."""

import random

import pytest
from pyspark.sql import functions as F

from quietlog.streaming import jobs
from test_flows import windows_plainly

US = 1_000_000


def written(spark, rows, kind, folder, batches):
    for b in range(batches):
        own = rows[len(rows) * b // batches : len(rows) * (b + 1) // batches]
        spark.createDataFrame(own, kind).coalesce(1).write.mode("append").parquet(f"{folder}/part={b:03d}")
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


@pytest.mark.parametrize("batches", [1, 9])
def test_limiter_judges_in_time_order(spark, tmp_path, batches):
    rng = random.Random(3)
    times = {k: sorted(rng.randint(0, 900) * US + rng.randint(0, 9) for _ in range(n)) for k, n in (("a", 250), ("b", 60), ("c", 1))}
    rows = [(k, i, t) for k, ts in times.items() for i, t in enumerate(ts)]
    rows.sort(key=lambda r: r[2] + rng.randint(0, 50) * US)  # up to 50 s out of order
    kind = "key string, id long, ts_us long"
    raw = written(spark, rows, kind, tmp_path / "in", batches)
    beats, out, checkpoint = (str(tmp_path / x) for x in ("beats", "out", "checkpoint"))
    judged = jobs.window_limit_stream(jobs.with_heartbeat(raw, beats), 4, 20, lateness="1 minute")
    jobs.settled_parquet(judged, out, checkpoint, lambda: jobs.beat(raw, beats, "ts_us", F.expr("unix_micros(timestamp '2100-01-01')")))
    got = {(r.key, r.id): r.allowed for r in spark.read.schema(judged.schema).parquet(out).collect() if r.id is not None}
    assert got == {(k, i): ok for k, ts in times.items() for i, (_, ok) in enumerate(windows_plainly(ts, 20 * US, 4))}
    for state in ("window", "waiting"):
        kept = spark.read.format("statestore").option("stateVarName", state)
        kept = (kept.option("flattenCollectionTypes", True) if state == "waiting" else kept).load(checkpoint)
        assert kept.where("key.key is not null").count() == 0


def test_events_beyond_the_lateness_go(spark, tmp_path):
    """Late is what lies before the watermark of the batch before."""
    rows = [("a", 1, 1000 * US), ("a", 2, 1500 * US), ("a", 5, 1501 * US), ("a", 3, 1000 * US), ("a", 4, 1490 * US)]
    raw = written(spark, rows, "key string, id long, ts_us long", tmp_path / "in", 5)
    beats, out = str(tmp_path / "beats"), str(tmp_path / "out")
    judged = jobs.window_limit_stream(jobs.with_heartbeat(raw, beats), 4, 20, lateness="1 minute")
    jobs.settled_parquet(judged, out, str(tmp_path / "checkpoint"), lambda: jobs.beat(raw, beats, "ts_us", F.expr("unix_micros(timestamp '2100-01-01')")))
    assert sorted(r.id for r in spark.read.schema(judged.schema).parquet(out).collect() if r.id is not None) == [1, 2, 4, 5]


def test_two_phases_are_settled(spark, tmp_path):
    arrivals = written(spark, [(i, 1000 + i * 10) for i in range(60)], "id long, s long", tmp_path / "a", 3)
    done = written(spark, [(i, 1000 + i * 10 + (30 if i % 3 else 500)) for i in range(60) if i % 5], "id long, s long", tmp_path / "d", 3)
    arrivals = arrivals.select("id", F.timestamp_seconds("s").alias("timestamp"))
    done = done.select("id", F.timestamp_seconds("s").alias("completed_at"), F.lit(1).alias("output_tokens"))
    left, right, out = (str(tmp_path / x) for x in ("left", "right", "out"))
    joined = jobs.complete_stream(jobs.with_heartbeat(arrivals, left), jobs.with_heartbeat(done, right))
    far = F.expr("timestamp '2100-01-01'")
    beats = lambda: jobs.beat(arrivals, left, "timestamp", far), lambda: jobs.beat(done, right, "completed_at", far, id=F.lit(-1))
    jobs.settled_parquet(joined, out, str(tmp_path / "checkpoint"), *beats)
    got = sorted((r.id, r.status) for r in spark.read.schema(joined.schema).parquet(out).collect() if r.id is not None)
    assert got == [(i, "completed" if i % 5 and i % 3 else "pending") for i in range(60)]


@pytest.mark.parametrize("keys", [["k"], []])
def test_snapshots_keep_the_state_in_few_folders(spark, tmp_path, keys):
    rng = random.Random(5)
    rows = [(rng.randint(0, 4), i) for i in range(60)]
    raw = written(spark, rows, "k long, n long", tmp_path / "in", 30)
    counters = (raw.groupBy("k") if keys else raw.groupBy()).agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    out = str(tmp_path / "out")
    jobs.upsert_parquet(counters, out, str(tmp_path / "checkpoint"), keys=keys, every=4).awaitTermination()
    folders = jobs.changed_folders(spark, out)
    assert len(folders) <= 4 and "_snapshots/upto=27" in folders[0]
    assert len(jobs._numbered_folders(spark, out, "batch=")) <= 8 and len(jobs._numbered_folders(spark, f"{out}/_snapshots", "upto=")) == 2
    want = {}
    for k, n in rows:
        c, total = want.get(k if keys else 0, (0, 0))
        want[k if keys else 0] = (c + 1, total + n)
    assert {(r.k if keys else 0): (r.c, r.n) for r in jobs.latest(spark, out, keys, ["c", "n"]).collect()} == want
    # a snapshot that is still being written is not read
    (tmp_path / "out" / "_snapshots" / "upto=99").mkdir()
    assert jobs.changed_folders(spark, out) == folders
