"""The track store: sorted files, names without texts, lists that replace files at once."""

import random

import pytest
from pyspark.sql import functions as F

from quietlog.sources.track_store import Conflict, TrackStore


def entries(spark, rows):
    """rows: (session, seq, text)"""
    kind = "session_id string, seq long, role string, full_text string, clean_text string, timestamp_ms long"
    df = spark.createDataFrame([(s, n, "user", t, None if n % 2 else f"clean {t}", n * 10) for s, n, t in rows], kind)
    return df.withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))


def kept(store, track="full"):
    return sorted((r.session_id, r.seq, r.content) for r in store.read(track).collect())


@pytest.fixture
def store(spark, tmp_path):
    return TrackStore(spark, str(tmp_path / "store"), buckets=4)


def test_empty_store(store, spark):
    assert store.read().count() == store.sessions().count() == store.session("a").count() == 0
    assert store.trim(1, 0).number == store.compact().number == 0
    store.append(entries(spark, []))
    assert store.read().count() == store.names().count() == 0


def test_sessions_come_back(store, spark):
    rows = [(f"s{i % 7}", i, f"text {i}") for i in range(60)] + [("ü/=&", 0, "odd"), ("", 1, "")]
    store.append(entries(spark, rows[:30]))
    store.append(entries(spark, rows[30:]))
    assert kept(store) == sorted(rows)
    assert kept(store, "clean") == sorted((s, n, t if n % 2 else f"clean {t}") for s, n, t in rows)
    assert [r.seq for r in store.session("s3", "full").collect()] == [i for i in range(60) if i % 7 == 3]
    assert [r.content for r in store.session("s3", limit=2).collect()] == ["clean text 52", "text 59"]
    assert [r.session_id for r in store.sessions().collect()] == sorted({s for s, *_ in rows})
    with pytest.raises(ValueError, match="track must be"):
        store.session("a", "other")


def test_a_session_is_a_range_of_its_bucket(store, spark, capsys):
    store.append(entries(spark, [(f"s{i % 50}", i, "x" * 50) for i in range(2000)]))
    store.session("s7").explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(session_id,s7)" in plan and plan.count("bucket=") <= 2
    store.sessions().explain("formatted")
    assert "content" not in capsys.readouterr().out
    rows = spark.read.parquet(*(f"{store.path}/{p}" for p in store.snapshot().parts if "track=full" in p))
    inside = rows.select("session_id", "seq", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("m"))
    for f, own in inside.toPandas().sort_values("m").groupby("f"):
        assert list(zip(own.session_id, own.seq, strict=True)) == sorted(zip(own.session_id, own.seq, strict=True)), f


def test_trim_replaces_only_what_it_touches(store, spark):
    rng = random.Random(1)
    rows = [("hot", i, "h" * rng.randint(50, 90)) for i in range(400)] + [("few", i, "f" * 4000) for i in range(3)] + [(f"s{i}", i, "small") for i in range(40)]
    rng.shuffle(rows)
    store.append(entries(spark, rows[:200]))
    store.append(entries(spark, rows[200:]))
    old = store.snapshot()
    reader = store.read("full", old)
    new = store.trim(max_entries=10, min_bytes=3000)
    want = sorted(r for r in rows if r[0] != "hot" or r[1] >= 390)
    assert kept(store) == want and new.number == old.number + 1
    assert sum(r.rows for r in store.names().collect()) == 2 * len(want)
    hot = {p.split("/", 2)[2] for p in old.parts} - {p.split("/", 2)[2] for p in set(old.parts) & set(new.parts)}
    assert len(hot) == 2  # the bucket of the hot session, in both tracks
    assert reader.count() == len(rows)  # whoever read the old list goes on
    assert store.trim(max_entries=10, min_bytes=3000) == new
    assert store.compact().number == new.number + 1 and kept(store) == want
    assert len(store.snapshot().parts) == len({p.split("/", 2)[2] for p in store.snapshot().parts})
    assert store.vacuum(keep=1) and kept(store) == want and store.vacuum(keep=1) == []


def test_of_two_writers_one_wins(store, spark):
    store.append(entries(spark, [("a", 0, "x")]))
    base = store.snapshot()
    store.append(entries(spark, [("b", 0, "y")]))
    with pytest.raises(Conflict):
        store._publish(base, [], [])
    assert [r.session_id for r in store.sessions().collect()] == ["a", "b"]
