"""Capture files as table and stream, and block events of captures in any number of batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quietlog.operators import capture
from quietlog.sources import captures
from quietlog.streaming import jobs


def plain(folder):
    """(stream, offset, line) of each file below a folder."""
    out = []
    for path in folder.rglob("*.sse"):
        data, at = path.read_bytes(), 0
        while at < len(data):
            end = data.find(b"\n", at)
            end = len(data) if end < 0 else end
            out.append((path.parent.name.split("=")[1], at, data[at:end].removesuffix(b"\r").decode(errors="replace")))
            at = end + 1
    return sorted(out)


def put(folder, stream, data, name="a.sse", mode="wb"):
    path = folder / f"stream_id={stream}"
    path.mkdir(parents=True, exist_ok=True)
    with (path / name).open(mode) as out:
        out.write(data)


FILES = {
    "1": b'data: {"a": 1}\r\n\n: note\ndata: [DONE]\ndata: [DONE]\nlate',
    "2": b"",
    "3": b"\n\n\n",
    "4": "ä€ x\n".encode() * 300 + b"\xff broken \xc3\n" + b"z" * 5000 + b"\nend\n",
    "5": b"one line without an end" * 100,
}


@pytest.mark.parametrize("split", [1, 7, 1000, 1 << 20])
def test_lines_do_not_depend_on_splits(spark, tmp_path, split):
    small = {k: v if split > 6 else v[:300] for k, v in FILES.items()}
    for stream, data in small.items():
        put(tmp_path, stream, data)
    if split > 6:
        got = captures.read_captures(spark, str(tmp_path), split)
        assert sorted((r.stream_id, r.offset, r.line) for r in got.collect()) == plain(tmp_path)
    for stream, data in small.items():
        path = tmp_path / f"stream_id={stream}" / "a.sse"
        parts = captures.ranges(str(path), 0, len(data), split)
        rows = [row for p in parts for b in captures._batches(str(tmp_path), p, False) for row in b.to_pylist()]
        assert [(r["offset"], r["line"]) for r in rows] == [(o, x) for s, o, x in plain(tmp_path) if s == stream]


def test_a_line_too_long_ends_a_capture(spark, tmp_path, monkeypatch):
    put(tmp_path, "9", b'data: {"x": 1}\n' + b"y" * (captures.LINE_BYTES + 1) + b'\ndata: {"x": 2}\n' + b"z" * captures.LINE_BYTES + b"\n")
    lines = captures.numbered_lines(captures.read_captures(spark, str(tmp_path), 1 << 20))
    assert [(r.seq, None if r.line is None else len(r.line)) for r in lines.orderBy("seq").collect()] == [(0, 14), (1, None), (2, 14), (3, captures.LINE_BYTES)]
    assert [r.seq for r in capture.chunks(lines).collect()] == [0]


def test_written_files_come_back(spark, tmp_path):
    rows = [(s, i, x) for s in ("a", "b/c=d", "ü") for i, x in enumerate(['data: {"n": %d}' % k for k in range(40)] + ["data: {broken", "", "data: [DONE]", 'data: {"n": 0}', "data: [DONE]"])]
    captures.write_captures(spark.createDataFrame(rows, "stream_id string, seq long, line string"), str(tmp_path / "c"))
    got = captures.numbered_lines(captures.read_captures(spark, str(tmp_path / "c"), 100))
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert capture.chunks(got).groupBy("stream_id").count().collect()[0]["count"] == 40
    assert captures.read_captures(spark, str(tmp_path / "none")).count() == 0


def test_stream_follows_growing_files(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    steps = [{"1": b"a\nb", "2": b"x\n"}, {"1": b"c\nd\n"}, {"3": b"new\n", "1": b""}, {"2": b"y"}, {"2": b"\nz\n"}]
    for step in steps:
        for stream, data in step.items():
            put(folder, stream, data, mode="ab")
        jobs.append_parquet(captures.stream_captures(spark, str(folder), 2), out, str(tmp_path / "checkpoint")).awaitTermination()
        whole = [(s, o, x) for s, o, x in plain(folder) if (folder / f"stream_id={s}" / "a.sse").read_bytes()[o:].find(b"\n") >= 0]
        assert sorted(map(tuple, spark.read.schema(captures.SCHEMA).parquet(out).collect())) == whole


def chunk(text=None, finish=None, tokens=None):
    out = {"choices": [{"delta": {} if text is None else {"content": text}, "finish_reason": finish}]}
    return "data: " + json.dumps(out | ({} if tokens is None else {"usage": {"completion_tokens": tokens}}))


@pytest.mark.parametrize("batches", [1, 3, 40])
def test_block_events_do_not_depend_on_batches(spark, tmp_path, batches):
    rng = random.Random(2)
    lines = []
    for s in range(12):
        own = [rng.choice([chunk(rng.choice(["ab", " ", "\n x ", "", "é"])), chunk(finish=rng.choice(["stop", "length"])), chunk(tokens=rng.randint(0, 3)), "data: {", "", ": c"]) for _ in range(rng.randint(0, 30))]
        own += ["data: [DONE]", chunk("late")] if s % 3 else []
        lines += [(s, i, x) for i, x in enumerate(own)]
    requests = spark.createDataFrame([(s, f"m{s}", "model", s) for s in range(12)], "stream_id long, message_id string, model string, input_tokens long")
    kind = "stream_id long, seq long, line string, at timestamp"
    # every batch takes the next lines of each capture
    of = {s: [x for x in lines if x[0] == s] for s in range(12)}
    for b in range(batches):
        rows = [(*x, None) for own in of.values() for x in own[len(own) * b // batches : len(own) * (b + 1) // batches]]
        part = spark.createDataFrame(rows, kind).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000 + b)))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={b}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out, beats, checkpoint = (str(tmp_path / x) for x in ("out", "beats", "checkpoint"))
    events = jobs.block_event_stream(jobs.with_heartbeat(stream, beats), requests, count_lines=True)
    jobs.settled_parquet(events, out, checkpoint, lambda: jobs.beat(stream, beats, "at", F.expr("timestamp '2100-01-01'")))
    got = {tuple(r) for r in spark.read.schema(events.schema).parquet(out).collect() if r.stream_id is not None}
    begun = spark.createDataFrame(lines, "stream_id long, seq long, line string")
    want = capture.block_events(begun, requests.join(begun.select("stream_id").distinct(), "stream_id"))
    assert got == set(map(tuple, want.collect()))
    # only the heartbeat's own key still waits for its pause
    assert spark.read.format("statestore").option("stateVarName", "capture").load(checkpoint).where("key.stream_id is not null").count() == 0
