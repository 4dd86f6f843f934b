"""Structured Streaming jobs.  Every job takes a streaming DataFrame and returns one, or starts a query
with a caller-given sink folder and checkpoint; nothing is kept on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quietlog.functions.rules import Policy
from quietlog.functions.text import SPACE_CHARS, pin
from quietlog.operators.capture import block_pieces, chunk_of, ends_stream, event_data
from quietlog.operators.guard import audit_entries, guard
from quietlog.sources.request_log import RESPONSE_COLUMNS
from quietlog.sources.tracks import BUCKETS, append_tracks


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Stream of `<folder>/<name>.parquet`, be it one file or a folder of parts."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if is_folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def append_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_parquet(df: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, every: int = 20) -> StreamingQuery:
    """Update-mode sink: each batch's changed rows go to their own folder, so a repeated batch overwrites itself.

    With `keys`, every `every` batches the rows are compacted into a snapshot, so `latest` reads a bounded number of folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("changed_in", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if keys is not None and batch_id % every == every - 1:
            compact(batch.sparkSession, path, keys, batch_id)

    return (
        df.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _numbered_folders(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    """Folders `<prefix><number>` that a write has completed, by number."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return {}
    found = {f.getPath().getName(): f.getPath() for f in files.listStatus(hadoop) if f.isDirectory()}
    done = {n: p for n, p in found.items() if n.startswith(prefix) and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}
    return {int(n.removeprefix(prefix)): p.toString() for n, p in done.items()}


def changed_folders(spark: SparkSession, path: str, upto: int | None = None) -> list[str]:
    """What `latest` has to read: the newest snapshot, and the batches after it."""
    least = lambda n: upto is None or n <= upto
    snapshots = {n: p for n, p in _numbered_folders(spark, f"{path}/_snapshots", "upto=").items() if least(n)}
    newest = max(snapshots, default=-1)
    batches = {n: p for n, p in _numbered_folders(spark, path, "batch=").items() if n > newest and least(n)}
    return [snapshots[n] for n in snapshots if n == newest] + [batches[n] for n in sorted(batches)]


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*values), "changed_in").alias("v")
    return (rows.groupBy(*keys) if keys else rows).agg(newest).select(*keys, "v.*")


def compact(spark: SparkSession, path: str, keys: list[str], upto: int) -> None:
    """A snapshot of an `upsert_parquet` folder up to a batch.

    It appears as a whole, once it has been written.  Batches and snapshots that it replaces stay until the next one, so whoever has just
    listed them can still read them.
    """
    old = _numbered_folders(spark, f"{path}/_snapshots", "upto=")
    gone = sorted(n for n in old if n < upto)
    rows = spark.read.parquet(*changed_folders(spark, path, upto))
    _newest(rows, keys).write.mode("overwrite").parquet(f"{path}/_snapshots/upto={upto}")
    if gone:
        batches = _numbered_folders(spark, path, "batch=")
        for folder in [old[n] for n in gone[:-1]] + [p for n, p in batches.items() if n <= gone[-1]]:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def latest(spark: SparkSession, path: str, keys: list[str], values: list[str]) -> DataFrame:
    """Current state of an `upsert_parquet` folder."""
    rows = spark.read.parquet(*changed_folders(spark, path)).select(*keys, *values, "changed_in")
    return _newest(rows, keys).select(*keys, *values)


def usage_counters(requests: DataFrame, *by) -> DataFrame:
    """Running counters: arrivals count requests and input tokens, completions output tokens."""
    zero = F.lit(0).cast("long")
    return requests.groupBy(*by).agg(
        F.count("*").alias("requests"),
        F.coalesce(F.sum(F.col("input_tokens").cast("long")), zero).alias("input_tokens"),
        F.coalesce(F.sum(F.col("output_tokens").cast("long")), zero).alias("output_tokens"),
    )


def hourly_stream(requests: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Tumbling hours; rows later than `lateness` are dropped.

    `append_parquet` emits an hour once, when it is final, so the last ones stay open; `upsert_parquet` has them all.
    """
    return _windowed(requests, lateness, F.window("timestamp", "1 hour"))


def recent_rate_stream(requests: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Per-minute rates over five minutes, sliding by one."""
    counted = _windowed(requests, lateness, F.window("timestamp", "5 minutes", "1 minute"))
    rate = [(F.col(c) / 5).alias(f"{n}_per_min") for c, n in (("requests", "requests"), ("input_tokens", "input"), ("output_tokens", "output"))]
    return counted.select("window_start", "window_end", *rate)


def _windowed(requests: DataFrame, lateness: str, window: Column) -> DataFrame:
    return (
        usage_counters(requests.withWatermark("timestamp", lateness), window.alias("window"))
        .withColumn("window_start", F.col("window.start"))
        .withColumn("window_end", F.col("window.end"))
        .drop("window")
    )


def complete_stream(pending: DataFrame, completions: DataFrame, timeout: str = "2 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Pending requests with their completion; those without one by `timeout` come out with null response columns.

    pending(id, timestamp, ...), completions(id, completed_at, response columns)
    """
    left = pending.drop(*RESPONSE_COLUMNS, "status").withWatermark("timestamp", lateness)
    right = completions.withColumnRenamed("id", "completed_id").withWatermark("completed_at", lateness)
    joined = left.join(
        right,
        F.expr(f"completed_id = id AND completed_at >= timestamp AND completed_at <= timestamp + INTERVAL {timeout}"),
        "leftOuter",
    )
    return joined.withColumn("status", F.when(F.col("completed_id").isNull(), "pending").otherwise("completed"))


class _Windows(StatefulProcessor):
    """Events of a key wait in list state until the watermark has passed them, and are judged in time order then."""

    def __init__(self, most: int, size: int):
        self.most, self.size = most, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_us long, id long")
        self.window = handle.getValueState("window", "start_us long, count long")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for pdf in rows:
            new = list(zip(pdf["ts_us"].tolist(), pdf["id"].tolist(), strict=True))
            self.waiting.appendList(new)
            first = min(new)[0] if first is None else min(first, min(new)[0])
        self.handle.registerTimer(_passed(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        until = timerValues.getCurrentWatermarkInMs() * 1000
        start, count = self.window.get() if self.window.exists() else (None, 0)
        due, later = [], []
        for event in self.waiting.get():
            (due if event[0] < until else later).append(event)
        due.sort()
        judged = []
        for t, i in due:
            if start is None or t - start > self.size:
                start, count = t, 0
            judged.append((i, count < self.most))
            count += count < self.most
        # a window that ended before the watermark can count no event any more
        if start is not None and start + self.size >= until:
            self.window.update((start, count))
        elif self.window.exists():
            self.window.clear()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(_passed(min(later)[0]))
        else:
            self.waiting.clear()
            if start is not None and start + self.size >= until:
                self.handle.registerTimer(_passed(start + self.size))
        if judged:
            keys = pd.Series([key[0]] * len(judged), dtype=object)  # strings of Arrow come in chunks, which this operator doesn't take
            yield pd.DataFrame({"key": keys, "id": [i for i, _ in judged], "allowed": [ok for _, ok in judged]})


def _passed(us: int) -> int:
    """The first millisecond after a time in microseconds."""
    return us // 1000 + 1


def keyed_state(spark: SparkSession) -> None:
    """State with lists and timers is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def window_limit_stream(events: DataFrame, max_requests: int = 100, size_seconds: int = 300, lateness: str = "10 minutes") -> DataFrame:
    """Anchored-window limiter with keyed state over (key string, id, ts_us): allowed by key and id.

    Events are judged in time order, however they arrive, once the watermark has passed them; those that come later
    than `lateness` are dropped.  A key's state goes when its window has ended and no event waits.
    """
    keyed_state(events.sparkSession)
    timed = events.select("key", "id", "ts_us", F.timestamp_micros("ts_us").alias("at")).withWatermark("at", lateness)
    return timed.groupBy("key").transformWithStateInPandas(
        _Windows(max_requests, size_seconds * 1_000_000), "key string, id long, allowed boolean", "append", "eventTime"
    )


class _Blocks(StatefulProcessor):
    """A capture's block events as its lines come: opened by the first line, closed by [DONE] or by a pause."""

    STATE = "lines long, started boolean, closed boolean, finish string, tokens long, chars long, blanks long, any_text boolean, message_id string, model string, input_tokens long, due_ms long"

    def __init__(self, pause_ms: int, count_lines: bool):
        self.pause_ms, self.count_lines = pause_ms, count_lines

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("capture", self.STATE)

    def handleInputRows(self, key, rows, timerValues):
        new = sorted((r for pdf in rows for r in pdf.itertuples(index=False)), key=lambda r: r.seq)
        names = [f.split()[0] for f in self.STATE.split(", ")]
        out = []
        if self.state.exists():
            now = dict(zip(names, self.state.get(), strict=True))
        else:
            r = new[0]
            now = dict.fromkeys(names, None) | {"lines": 0, "started": False, "closed": False, "chars": 0, "blanks": 0, "any_text": False, "due_ms": 0}
            now |= {"message_id": _value(r.message_id), "model": _value(r.model), "input_tokens": _value(r.input_tokens, int)}
            out.append((0, 0, "message_start", None))
        for r in new:
            place = now["lines"] if self.count_lines else int(r.seq)
            now["lines"] += 1
            if now["closed"]:
                continue
            if r.ends:
                out += self._closing(now)
                continue
            if not r.is_chunk:
                continue
            if (reason := _value(r.finish)) is not None:
                now["finish"] = reason
            if (tokens := _value(r.tokens, int)) is not None and tokens > 0:
                now["tokens"] = tokens
            if r.text:
                if not now["started"]:
                    now["started"] = True
                    out.append((1, 0, "content_block_start", None))
                out.append((2, place, "content_block_delta", r.text))
                _measure(now, r.text)
        if now["due_ms"]:
            self.handle.deleteTimer(now["due_ms"])
        now["due_ms"] = max(now["due_ms"], max(int(r.at_ms) for r in new) + self.pause_ms)
        self.handle.registerTimer(now["due_ms"])
        self.state.update(tuple(now[n] for n in names))
        if out:
            yield self._frame(key[0], now, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = dict(zip([f.split()[0] for f in self.STATE.split(", ")], self.state.get(), strict=True))
        self.state.clear()
        if not now["closed"]:
            yield self._frame(key[0], now, self._closing(now))

    def _closing(self, now: dict) -> list:
        now["closed"] = True
        stop = [(3, 0, "content_block_stop", None)] if now["started"] else []
        return [*stop, (4, 0, "message_delta", None), (5, 0, "message_stop", None)]

    def _frame(self, key, now: dict, out: list):
        import pandas as pd

        tokens = now["tokens"] or now["chars"] // 2
        # strings of Arrow come in chunks, which this operator doesn't take
        column = lambda values: pd.Series(list(values), dtype=object)
        told = lambda name, value: column(value if e == name else None for _, _, e, _ in out)
        return pd.DataFrame(
            {
                "stream_id": [key] * len(out), "phase": [p for p, *_ in out], "seq": [n for _, n, *_ in out],
                "event": column(e for _, _, e, _ in out), "text": column(t for *_, t in out), "finish": told("message_delta", now["finish"]),
                "out": told("message_delta", tokens), "message_id": told("message_start", now["message_id"]),
                "model": told("message_start", now["model"]), "input_tokens": told("message_start", now["input_tokens"]),
            }
        )


def _value(x, kind=None):
    """A value of a pandas row, with None for what is missing."""
    return None if x is None or x != x else kind(x) if kind else x


def _measure(now: dict, text: str) -> None:
    """Count the characters of a growing text without white space at its ends."""
    inner = text.strip(SPACE_CHARS)
    if not inner:
        now["blanks"] += len(text)
        return
    lead = len(text) - len(text.lstrip(SPACE_CHARS))
    if now["any_text"]:
        now["chars"] += now["blanks"] + lead
    now["any_text"] = True
    now["chars"] += len(inner)
    now["blanks"] = len(text) - lead - len(inner)


def block_event_stream(lines: DataFrame, requests: DataFrame, pause: str = "10 minutes", count_lines: bool = False) -> DataFrame:
    """Block events (stream_id, phase, seq, event, data) of captures that are still being written.

    `lines` (stream_id, seq, line, at) may come in any number of batches, a capture's lines in order; `requests` is a table
    as for `block_events`.  A capture without [DONE] is closed when no line has come for `pause` of `at`; its state goes then too.
    `count_lines` gives text events the line's number instead of its seq.
    """
    spark = lines.sparkSession
    keyed_state(spark)
    kind = dict(lines.dtypes)["stream_id"]
    milliseconds = int(spark.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + interval {pause})")).first()[0])
    parsed = lines.withWatermark("at", "0 seconds").withColumn("ends", ends_stream(F.col("line"))).withColumn("chunk", pin(chunk_of(F.col("line")))).drop("line")
    pieces = block_pieces(parsed.withColumns({"is_chunk": F.col("chunk").isNotNull(), "at_ms": F.unix_millis("at")}))
    joined = pieces.join(requests, "stream_id", "left")
    fields = "phase int, seq long, event string, text string, finish string, out long, message_id string, model string, input_tokens long"
    rows = joined.groupBy("stream_id").transformWithStateInPandas(_Blocks(milliseconds, count_lines), f"stream_id {kind}, {fields}", "append", "eventTime")
    return rows.select("stream_id", "phase", "seq", "event", event_data().alias("data"))


def with_heartbeat(stream: DataFrame, folder: str) -> DataFrame:
    """A stream that also reads the rows that `beat` puts into `folder`: they move the watermark when no data comes."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def beat(stream: DataFrame, folder: str, column: str, at: Column, **values: Column) -> None:
    """A row of nulls but for its time and `values`: what waits for the watermark up to `at`, less the lateness, is settled.

    A join drops rows with a null key before they move a watermark, so those need a key that nothing has.
    """
    spark = stream.sparkSession
    given = values | {column: at}
    row = spark.range(1).select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema.fields))
    row.coalesce(1).write.mode("append").parquet(folder)


def settled_parquet(df: DataFrame, path: str, checkpoint: str, *beats: Callable[[], None]) -> None:
    """Run a query until all is read, then once more from its checkpoint after the beats: nothing waits any longer."""
    append_parquet(df, path, checkpoint).awaitTermination()
    for each in beats:
        each()
    append_parquet(df, path, checkpoint).awaitTermination()


def guard_stream(
    payloads: DataFrame,
    session: Column,
    key: str,
    audit_path: str,
    out_path: str,
    checkpoint: str,
    policy: Policy = Policy(),
    body: str = "body",
    buckets: int = BUCKETS,
    order: Column | None = None,
) -> StreamingQuery:
    """Guard a stream of payloads and keep both audit tracks, failing closed.

    A batch is guarded once into a staging folder below the audit folder, without the bodies that came in; the
    audit rows are written from it before anything is released, and then it is removed.  An audit error fails the
    batch.  All folders carry the batch id, so a repeated batch replaces what it wrote before.  `order` is a
    payload's place in its session, which the tracks keep.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = f"{audit_path}/_staged/batch={batch_id}"
        batch = batch.withColumn("_session", session).withColumn("_order", F.lit(0) if order is None else order)
        kept = guard(batch, policy, body).select(key, "_session", "_order", "decision", "status_code", "entries", "body_out")
        kept.write.mode("overwrite").parquet(staged)
        done = spark.read.parquet(staged)
        entries = audit_entries(done, F.col("_session"), key, None if order is None else F.col("_order")).withColumn("timestamp_ms", F.unix_millis(F.current_timestamp()))
        append_tracks(entries, f"{audit_path}/batch={batch_id}", mode="overwrite", buckets=buckets)
        released = done.select(key, "decision", "status_code", "body_out")
        released.write.mode("overwrite").parquet(f"{out_path}/released/batch={batch_id}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return (
        payloads.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
