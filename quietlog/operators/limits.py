"""Rate-limit audits over the request log: which requests a limiter would have let through.

Both limiters are sequential per key.  A key of ordinary size is one group.  A hot key is numbered over ranges of the
sorted log and cut by count, so a chunk has `chunk_rows` events however they bunch in time, and no step gathers more:

- window limit: the window that an event would open ends at the first event later than its size, so windows are paths
  in a graph of events.  Each chunk shortens the paths inside it to their last window; where that one ends is a number
  of events, found by one more pass over the sorted log.  What is left are single steps between chunks, and which of
  them the log takes follows by doubling the steps: joins on (key, place), as many as the logarithm of the chunks.
- token bucket: a chunk is a piecewise function of the tokens it starts with, of no more pieces than the burst has tokens.
  Functions of neighbouring chunks are composed, `FAN` at a time, storey by storey, and the way back hands each chunk its tokens.

Then all chunks are replayed side by side from their true start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietlog.operators.ranks import numbered, running_sums
from quietlog.session import staged

CHUNK_ROWS = 200_000
FAN = 64
ONE = 1_000_000  # a token, in millionths; also a second in microseconds


def _split(events: DataFrame, chunk_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Events of ordinary keys, dealt out by key; those of hot keys with place and chunk, or None without such keys."""
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = staged(events.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk_rows), "hot-keys")
    rows = hot.agg(F.sum("n")).first()[0]
    keys = hot.select(F.col("key").alias("_hot"))
    same = events["key"].eqNullSafe(keys["_hot"])
    # a fixed number of partitions: the Python work per byte is too high for merging small ones
    if not rows:
        return events.repartition(parts, "key"), None
    own = events.join(keys, same, "left_semi")
    placed = numbered(own, ["key"], ["ts_us", "id"], parts=max(parts, -(-rows // chunk_rows)))
    chunk = F.floor((F.col("place") - 1) / chunk_rows).cast("long")
    return events.join(keys, same, "left_anti").repartition(parts, "key"), staged(placed.withColumn("chunk", chunk), "placed")


def _chunks(placed: DataFrame, *on: str) -> DataFrame:
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "key", *(on or ("chunk",)))


def _matched(a: DataFrame, b: DataFrame, how: str = "inner", **columns: str) -> DataFrame:
    """Rows of `a` with what `b` has for their key (null is a key) and for `columns`, named {of a: of b}."""
    on = {"key": "key"} | columns
    right = b.select(*(F.col(r).alias(f"_{r}") for r in on.values()), *(c for c in b.columns if c not in on.values() and "semi" not in how))
    same = F.lit(True)
    for mine, theirs in on.items():
        same = same & F.col(mine).eqNullSafe(F.col(f"_{theirs}"))
    return a.join(right, same, how).drop(*(f"_{r}" for r in on.values()))


def _entries(placed: DataFrame, size: int) -> DataFrame:
    """The first window that opens in each chunk of hot keys, if any, and the last one: key, chunk, place, last_place, last_us."""
    kind = dict(placed.dtypes)["key"]

    def shorten(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("place")
        t, place = pdf["ts_us"].to_numpy(), pdf["place"].to_numpy()
        n = len(t)
        follow = np.searchsorted(t, t + size, side="right")
        root = np.where(follow == n, np.arange(n), follow)
        while True:  # pointer jumping: where does the chain that starts at each event end?
            further = root[root]
            if (further == root).all():
                break
            root = further
        opens = np.flatnonzero(np.append(True, t[1:] != t[:-1]))  # of equal times only the first can open a window
        return pd.DataFrame(
            {"key": pdf["key"].iloc[0], "chunk": pdf["chunk"].iloc[0], "place": place[opens], "last_place": place[root[opens]], "last_us": t[root[opens]]}
        )

    paths = staged(
        _chunks(placed).groupBy("key", "chunk").applyInPandas(shorten, f"key {kind}, chunk long, place long, last_place long, last_us long"), "paths"
    )
    ends = paths.select("key", (F.col("last_us") + size).alias("ts_us")).distinct()
    both = placed.select("key", "ts_us", F.lit(0).alias("end")).unionByName(ends.withColumn("end", F.lit(1)))
    counted = running_sums(both, ["key"], ["ts_us", "end"], {"upto": (1 - F.col("end")).cast("long")}).where("end = 1")
    ending = paths.withColumn("end_us", F.col("last_us") + size)
    steps = staged(_matched(ending, counted.select("key", "ts_us", (F.col("upto") + 1).alias("next")), end_us="ts_us").drop("end_us"), "steps")
    # only an event that follows some window can open one, and the first of a key
    follows = steps.select("key", F.col("next").alias("place")).distinct()
    kept = _matched(steps, follows, "left_semi", place="place").unionByName(steps.where("place = 1"))
    nodes = staged(kept, "nodes")
    taken = nodes.where("place = 1").select("key", "place")
    jump = nodes.select("key", "place", "next")
    while not jump.isEmpty():
        more = _matched(taken, jump, place="place").select("key", F.col("next").alias("place"))
        taken = staged(taken.unionByName(more), "taken")
        after = jump.select("key", F.col("place").alias("via"), F.col("next").alias("beyond"))
        jump = staged(_matched(jump, after, next="via").select("key", "place", F.col("beyond").alias("next")), "jump")
    return staged(_matched(nodes, taken, "left_semi", place="place").drop("next"), "entries")


def _replay_windows(size: int):
    """(window starts, number in the window) of sorted events, from the state they begin in."""
    import numpy as np

    def replay(t, place, entry, root_place, root_us):
        starts, nth = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
        at = len(t) if entry is None else int(np.searchsorted(place, entry))
        if at:
            starts[:at], nth[:at] = root_us, place[:at] - root_place + 1
        while at < len(t):
            end = int(np.searchsorted(t, t[at] + size, side="right"))
            starts[at:end] = t[at]
            nth[at:end] = np.arange(1, end - at + 1)
            at = end
        return starts, nth

    return replay


def window_limit(events: DataFrame, max_requests: int = 100, size_seconds: int = 300, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Anchored fixed windows per key over events (key, id, ts_us): adds window_start_us, allowed, remaining.

    The first event of a key opens a window; an event more than `size_seconds` after the window start
    opens the next one at its own time.  Beyond `max_requests` a window rejects.
    """
    size = size_seconds * ONE
    kind = dict(events.dtypes)["key"]

    def judged(pdf, place, entry, root_place, root_us):
        import numpy as np
        import pandas as pd

        t = pdf["ts_us"].to_numpy()
        starts, nth = _replay_windows(size)(t, place, entry, root_place, root_us)
        return pd.DataFrame(
            {
                "key": pdf["key"], "id": pdf["id"], "ts_us": t, "window_start_us": starts,
                "allowed": nth <= max_requests, "remaining": np.maximum(max_requests - nth, 0),
            }
        )

    def whole(pdf):
        import numpy as np

        return judged(pdf.sort_values(["ts_us", "id"]), np.arange(1, len(pdf) + 1), 1, 0, 0)

    def chunk(pdf):
        import pandas as pd

        pdf = pdf.sort_values("place")
        entry, root_place, root_us = pdf[["entry", "root_place", "root_us"]].iloc[0]
        return judged(pdf, pdf["place"].to_numpy(), None if pd.isna(entry) else int(entry), *((0, 0) if pd.isna(root_us) else (int(root_place), int(root_us))))

    out = f"key {kind}, id long, ts_us long, window_start_us long, allowed boolean, remaining long"
    cold, placed = _split(events.select("key", "id", "ts_us"), chunk_rows)
    done = cold.groupBy("key").applyInPandas(whole, out)
    if placed is None:
        return done
    entries = _entries(placed, size)
    every = placed.select("key", "chunk").distinct()
    at = _matched(every, entries.withColumnRenamed("place", "entry"), "left", chunk="chunk")
    earlier = W.partitionBy("key").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    open_ = at.select("key", "chunk", "entry", F.last("last_place", True).over(earlier).alias("root_place"), F.last("last_us", True).over(earlier).alias("root_us"))
    rows = _chunks(_matched(placed, open_, chunk="chunk"))
    return done.unionByName(rows.groupBy("key", "chunk").applyInPandas(chunk, out))


def newest_windows(events: DataFrame, size_seconds: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The last window of each key over events (key, id, ts_us): key, window_start_us, n (its events), ts_us (the newest).

    Of hot keys the windows are chained, not replayed.
    """
    size = size_seconds * ONE
    kind = dict(events.dtypes)["key"]

    def whole(pdf):
        import numpy as np
        import pandas as pd

        t = np.sort(pdf["ts_us"].to_numpy())
        at, end = 0, 0
        while end < len(t):
            at, end = end, int(np.searchsorted(t, t[end] + size, side="right"))
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "window_start_us": t[at], "n": len(t) - at, "ts_us": t[-1]})

    cold, placed = _split(events.select("key", "id", "ts_us"), chunk_rows)
    done = cold.groupBy("key").applyInPandas(whole, f"key {kind}, window_start_us long, n long, ts_us long")
    if placed is None:
        return done
    last = _entries(placed, size).groupBy("key").agg(F.max(F.struct("last_place", "last_us")).alias("w"))
    ends = placed.groupBy("key").agg(F.max("place").alias("events"), F.max("ts_us").alias("ts_us"))
    hot = _matched(ends, last).select("key", F.col("w.last_us").alias("window_start_us"), (F.col("events") - F.col("w.last_place") + 1).alias("n"), "ts_us")
    return done.unionByName(hot)


def bucket_settings(requests: int, window_seconds: float) -> tuple[int, int]:
    """(tokens per second, burst) of a token bucket: at least 1 each, fractions dropped."""
    return int(max(requests / window_seconds, 1)), max(requests // 10, 1)


Pieces = list[tuple[int, int, int]]


def _joined(pieces: Pieces) -> Pieces:
    """Without pieces that only continue the one before them."""
    out = pieces[:1]
    for at, v, slope in pieces[1:]:
        lo, base, rise = out[-1]
        if slope != rise or v != base + rise * (at - lo):
            out.append((at, v, slope))
    return out


def through(pieces: Pieces, gain: int, cap: int) -> Pieces:
    """`pieces` (tokens after some events, as a function of those before), then one more event, then a refill."""
    moved: Pieces = []
    for i, (lo, base, slope) in enumerate(pieces):
        hi = pieces[i + 1][0] if i + 1 < len(pieces) else cap + 1
        parts = [(lo, base)]
        if slope and base < ONE <= base + (hi - 1 - lo):
            parts.append((lo + ONE - base, ONE))
        for k, (at, v) in enumerate(parts):
            until = parts[k + 1][0] if k + 1 < len(parts) else hi
            v = (v - ONE if v >= ONE else v) + gain
            if v >= cap:
                moved.append((at, cap, 0))
            elif slope and v + (until - 1 - at) > cap:
                moved += [(at, v, 1), (at + cap - v, cap, 0)]
            else:
                moved.append((at, v, slope))
    return _joined(moved)


def value(pieces: Pieces, tokens: int) -> int:
    from bisect import bisect_right

    lo, base, slope = pieces[bisect_right(pieces, tokens, key=lambda p: p[0]) - 1]
    return base + slope * (tokens - lo)


def then(first: Pieces, gain: int, second: Pieces, cap: int) -> Pieces:
    """`second` after a refill by `gain` after `first`."""
    out: Pieces = []
    for i, (lo, base, slope) in enumerate(first):
        hi = first[i + 1][0] if i + 1 < len(first) else cap + 1
        v = base + gain
        if not slope or v >= cap:
            out.append((lo, value(second, min(v, cap)), 0))
            continue
        full = min(hi, lo + cap - v)  # from here on, the bucket is full
        inner = [lo + p - v for p, _, _ in second if v < p < v + full - lo]
        for at in [lo, *inner]:
            x = v + at - lo
            rise = next(s for p, _, s in reversed(second) if p <= x)
            out.append((at, value(second, x), rise))
        if full < hi:
            out.append((full, value(second, cap), 0))
    return _joined(out)


def token_bucket(events: DataFrame, requests: int = 100, window_seconds: float = 300, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Token bucket per key over events (key, id, ts_us): adds allowed and tokens (after the request)."""
    rate, burst = bucket_settings(requests, window_seconds)
    cap = burst * ONE
    kind = dict(events.dtypes)["key"]

    def told(key, at, pieces: Pieces, first: int, last: int):
        import pandas as pd

        out = pd.DataFrame(pieces, columns=["lo", "base", "slope"])
        return out.assign(key=key, at=at, first=first, last=last)[["key", "at", "lo", "base", "slope", "first", "last"]]

    def summarize(pdf):
        """The chunk as a piecewise function of the tokens at its first event: (lo, base, slope) pieces."""
        import numpy as np

        t = np.sort(pdf["ts_us"].to_numpy())
        pieces: Pieces = [(0, 0, 1)]
        for gain in (np.append(np.diff(t), 0) * rate).tolist():
            pieces = through(pieces, gain, cap)
        return told(pdf["key"].iloc[0], pdf["chunk"].iloc[0], pieces, int(t[0]), int(t[-1]))

    def parts(pdf):
        """(at, pieces, first, last) of the functions in a group, in order."""
        for at, own in pdf.sort_values(["at", "lo"]).groupby("at", sort=True):
            yield at, list(own[["lo", "base", "slope"]].itertuples(index=False, name=None)), int(own["first"].iloc[0]), int(own["last"].iloc[0])

    def compose(pdf):
        whole: Pieces | None = None
        begin = seen = 0
        for _, pieces, first, last in parts(pdf):
            whole, begin = (pieces, first) if whole is None else (then(whole, (first - seen) * rate, pieces, cap), begin)
            seen = last
        return told(pdf["key"].iloc[0], pdf["up"].iloc[0], whole, begin, seen)

    def hand_down(pdf):
        import pandas as pd

        tokens, seen, rows = int(pdf["tokens_in"].iloc[0]), None, []
        for at, pieces, first, last in parts(pdf):
            if seen is not None:
                tokens = min(cap, tokens + (first - seen) * rate)
            rows.append((pdf["key"].iloc[0], at, tokens))
            tokens, seen = value(pieces, tokens), last
        return pd.DataFrame(rows, columns=["key", "at", "tokens_in"])

    def replay(pdf, tokens: int):
        import numpy as np
        import pandas as pd

        t = pdf["ts_us"].to_numpy()
        allowed, left = [], []
        for gain in (np.diff(t, prepend=t[:1]) * rate).tolist():
            tokens = min(cap, tokens + gain)
            ok = tokens >= ONE
            tokens -= ONE if ok else 0
            allowed.append(ok)
            left.append(tokens / ONE)
        return pd.DataFrame({"key": pdf["key"], "id": pdf["id"], "ts_us": t, "allowed": allowed, "tokens": left})

    def whole(pdf):
        return replay(pdf.sort_values(["ts_us", "id"]), cap)

    def chunk(pdf):
        return replay(pdf.sort_values("place"), int(pdf["tokens_in"].iloc[0]))

    out = f"key {kind}, id long, ts_us long, allowed boolean, tokens double"
    cold, placed = _split(events.select("key", "id", "ts_us"), chunk_rows)
    done = cold.groupBy("key").applyInPandas(whole, out)
    if placed is None:
        return done
    function = f"key {kind}, at long, lo long, base long, slope int, first long, last long"
    floors = [staged(_chunks(placed).groupBy("key", "chunk").applyInPandas(summarize, function), "floor")]
    most = floors[0].agg(F.max("at")).first()[0] + 1
    while most > 1:
        up = floors[-1].withColumn("up", F.floor(F.col("at") / FAN).cast("long"))
        floors.append(staged(_chunks(up, "up").groupBy("key", "up").applyInPandas(compose, function), "floor"))
        most = -(-most // FAN)
    given = floors.pop().select("key", "at", F.lit(cap).cast("long").alias("tokens_in")).distinct()
    for floor in reversed(floors):
        up = floor.withColumn("up", F.floor(F.col("at") / FAN).cast("long"))
        under = _matched(up, given.select("key", F.col("at").alias("of"), "tokens_in"), up="of")
        given = staged(_chunks(under, "up").groupBy("key", "up").applyInPandas(hand_down, f"key {kind}, at long, tokens_in long"), "tokens")
    rows = _chunks(_matched(placed, given, chunk="at"))
    return done.unionByName(rows.groupBy("key", "chunk").applyInPandas(chunk, out))


def limiter_state(events: DataFrame, max_requests: int, size_seconds: int, as_of_us: int | None = None, per_key: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Requests counted in the newest window, the limit, and microseconds until it ends: one row, or one per key."""
    rows = newest_windows(events, size_seconds, chunk_rows)
    if not per_key:
        rows = rows.agg(F.max(F.struct("ts_us", "window_start_us", "n")).alias("w")).where("w is not null").select("w.*")
    now = F.col("ts_us") if as_of_us is None else F.lit(as_of_us)
    return rows.select(
        *(["key"] if per_key else []),
        F.least("n", F.lit(max_requests)).cast("long").alias("request_count"),
        F.lit(max_requests).cast("long").alias("rate_limit"),
        F.greatest(F.lit(0).cast("long"), F.col("window_start_us") + size_seconds * ONE - now).alias("window_remaining_us"),
    )
