"""Limiters on keys that bunch in time: same answers as event by event, and no group above the chunk size."""

import random

import pytest
from pyspark.sql import functions as F

from quietlog.operators import limits, ranks
from test_flows import bucket_plainly, windows_plainly

US = 1_000_000


def bursts(rng, n):
    t, out = 0, []
    while len(out) < n:
        t += rng.choice([20 * US, 7 * US, 300 * US])
        out += sorted(t + rng.randint(0, 3 * US) for _ in range(rng.choice([1, 5, 200])))
        t = out[-1]
    return out[:n]


KEYS = {
    "dense": lambda rng: sorted(rng.randint(0, 5 * US) for _ in range(1500)),  # all within one window
    "equal": lambda rng: [3 * US] * 300 + [10 * US] * 50,
    "bursty": lambda rng: bursts(rng, 500),
    "steady": lambda rng: [i * US for i in range(400)],
    "sparse": lambda rng: [i * 100 * US for i in range(150)],
    "cold": lambda rng: [0, 1, 7 * US],
    None: lambda rng: bursts(rng, 300),
}


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(4)
    times = {k: f(rng) for k, f in KEYS.items()}
    rows = [(k, i, x) for k, xs in times.items() for i, x in enumerate(xs)]
    rng.shuffle(rows)
    return times, spark.createDataFrame(rows, "key string, id long, ts_us long")


@pytest.mark.parametrize("chunk_rows", [16, 250])
def test_windows(events, chunk_rows):
    times, df = events
    got = limits.window_limit(df, 4, 6, chunk_rows).orderBy("key", "id").collect()
    state = {r.key: r for r in limits.newest_windows(df, 6, chunk_rows).collect()}
    for k, xs in times.items():
        want = list(windows_plainly(xs, 6 * US, 4))
        assert [(r.window_start_us, r.allowed) for r in got if r.key == k] == want
        last = want[-1][0]
        assert (state[k].window_start_us, state[k].n, state[k].ts_us) == (last, sum(w == last for w, _ in want), xs[-1])


@pytest.mark.parametrize("chunk_rows", [16, 250])
@pytest.mark.parametrize("requests,seconds", [(30, 15), (1000, 600)])
def test_buckets(events, chunk_rows, requests, seconds, monkeypatch):
    monkeypatch.setattr(limits, "FAN", 3)
    times, df = events
    rate, burst = limits.bucket_settings(requests, seconds)
    got = limits.token_bucket(df, requests, seconds, chunk_rows).orderBy("key", "id").collect()
    for k, xs in times.items():
        assert [(r.allowed, r.tokens) for r in got if r.key == k] == list(bucket_plainly(xs, rate, burst))


def test_chunks_are_cut_by_count(events):
    _, df = events
    cold, placed = limits._split(df, 100)
    sizes = [r["count"] for r in placed.groupBy("key", "chunk").count().collect()]
    assert max(sizes) == 100 and {r.key for r in cold.select("key").distinct().collect()} == {"cold"}
    # one first window for a chunk at most, whatever its events
    entries = limits._entries(placed, 6 * US).groupBy("key", "chunk").count()
    assert entries.agg(F.max("count")).first()[0] == 1


def test_functions_of_a_bucket_compose():
    rng = random.Random(9)
    cap = 5 * limits.ONE
    for _ in range(100):
        gains = [[rng.choice([0, 400_000, 1_000_000, 1_700_001, 9_000_000]) for _ in range(rng.randint(1, 12))] for _ in range(2)]
        functions = []
        for own in gains:
            pieces = [(0, 0, 1)]
            for g in own:
                pieces = limits.through(pieces, g, cap)
            assert len(pieces) <= 7
            functions.append(pieces)
        gap = rng.choice([0, 1, 999_999, 3_000_000])
        both = limits.then(functions[0], gap, functions[1], cap)
        for x in [0, cap, *(rng.randint(0, cap) for _ in range(60))]:
            assert limits.value(both, x) == limits.value(functions[1], min(cap, limits.value(functions[0], x) + gap))


def test_numbers_within_keys(spark):
    rows = [(k, i % 50) for k, n in ((None, 30), (1, 500), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = ranks.numbered(df, ["k"], ["v"], parts=9).collect()
    sums = ranks.running_sums(df, ["k"], ["v"], {"upto": F.col("v")}, parts=5).collect()
    for key in (None, 1, 2):
        own = sorted((r.place, r.v) for r in got if r.k == key)
        assert [p for p, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own] == sorted(v for _, v in own)
        assert max(r.upto for r in sums if r.k == key) == sum(r.v for r in sums if r.k == key)
    assert ranks.numbered(df.limit(0), ["k"], ["v"]).count() == 0


def test_no_events(spark):
    df = spark.createDataFrame([], "key string, id long, ts_us long")
    assert limits.window_limit(df).count() == limits.token_bucket(df).count() == limits.limiter_state(df, 3, 6).count() == 0
