"""Capture files of many streams, and tasks of many ranges."""

import pytest

from quietlog.sources import captures

SHAPE = "stream_id string, seq long, line string"


def test_many_captures_share_files_and_tasks(spark, tmp_path):
    spark.range(3000).selectExpr("cast(id as string) as stream_id", "explode(sequence(0L, 2L)) as seq").selectExpr("*", "concat('data: ', seq) as line").createOrReplaceTempView("lines_of_many")
    captures.write_captures(spark.table("lines_of_many"), str(tmp_path))
    assert len(captures.listed(str(tmp_path))) <= 16
    assert len(captures.CaptureReader({"path": str(tmp_path), "splitBytes": "64"}).partitions()) <= 16
    got = captures.numbered_lines(captures.read_captures(spark, str(tmp_path), 64))
    assert got.exceptAll(spark.table("lines_of_many")).isEmpty() and got.count() == 9000


@pytest.mark.parametrize("size", [1, 1000])
def test_small_files_share_tasks(tmp_path, monkeypatch, size):
    for i in range(50):
        (tmp_path / f"stream_id={i}").mkdir()
        (tmp_path / f"stream_id={i}/a.sse").write_bytes(b"a\nbb\n" * 20)
    monkeypatch.setattr(captures, "TASK_BYTES", 1000)
    options = {"path": str(tmp_path), "splitBytes": str(size)}
    batch = captures.CaptureReader(options).partitions()
    stream = captures.CaptureStreamReader(options)
    grown = stream.partitions(stream.initialOffset(), stream.latestOffset())
    for found in (batch, grown):
        assert len(found) == 5
        rows = [tuple(r.values()) for p in found for b in captures._batches(str(tmp_path), p, False) for r in b.to_pylist()]
        assert sorted(rows) == sorted((str(i), at, x) for i in range(50) for k in range(20) for at, x in ((5 * k, "a"), (5 * k + 2, "bb")))


def test_odd_ids_and_lines_in_bulk(spark, tmp_path, monkeypatch):
    ids = ["a b+c%2B/é\t=\n", "", None, "x"]
    rows = [(s, i, x) for s in ids for i, x in enumerate(["", None, "one\ntwo", "tab\there", "z" * 30, "end\r", "last"])]
    captures.write_captures(spark.createDataFrame(rows, SHAPE), str(tmp_path))
    lines = ["", "", "one", "two", "tab\there", "z" * 30, "end", "last"]
    for split in (1, 7, 1 << 20):
        got = {}
        for s, at, x in sorted(captures.read_captures(spark, str(tmp_path), split).collect(), key=lambda r: (r.stream_id, r.offset)):
            got.setdefault(s, []).append(x)
        assert got.pop(captures.NO_ID) and got == {"a b+c%2B/é\t=\n": lines, "x": lines}
    # lines that are too long keep their ids
    monkeypatch.setattr(captures, "LINE_BYTES", 20)
    monkeypatch.setattr(captures, "ID_BYTES", 5)
    part = [r for p in captures.CaptureReader({"path": str(tmp_path)}).partitions() for b in captures._batches(str(tmp_path), p, False) for r in b.to_pylist()]
    assert [r["line"] for r in part if r["stream_id"] == "x"] == [None if x == "z" * 30 else x for x in lines]


def test_files_beside_captures_are_left_alone(tmp_path):
    (tmp_path / "captures").mkdir()
    (tmp_path / "captures/notes.txt").write_text("x")
    assert captures.listed(str(tmp_path / "captures")) == {}
    assert list(captures.listed(str(tmp_path))) == [str(tmp_path / "captures/notes.txt")]


def test_a_range_reads_little_beyond_itself():
    class Counted:
        def __init__(self, data):
            self.data, self.at, self.read_bytes = data, 0, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            out = self.data[self.at : self.at + n]
            self.at, self.read_bytes = self.at + len(out), self.read_bytes + len(out)
            return out

    stream = Counted(b"line\n" * 400_000)
    assert sum(1 for _ in captures.lines_of(stream, 500_000, 510_000, False)) == 2000
    assert stream.read_bytes <= 50_000
