"""Removal of byte strings that occur earlier: prefix doubling over the positions that are still ambiguous.

Texts are UTF-8 bytes. A string of `LENGTH` bytes is a repeat if it also starts earlier (smaller doc_id, or the same and
an earlier byte); every byte under a repeat is removed. As in prefix doubling, positions get ranks for longer and longer
strings, Spark sorts the ranks, and positions whose rank is unique take no further part:

1. rank of `FIRST` bytes, taken at sampled positions only: each window of LENGTH bytes is sampled at the smallest hash
   of its FIRST-byte strings, so equal windows are sampled alike. Neighbouring windows with one sample make a *run*;
2. the rank is paired with that of the run's whole extent: a run that is an exact copy of an earlier one is a repeat in
   all its windows; a rank of step 1 that is unique ends here, with all windows of its run;
3. runs that share their first rank with runs of other extent are ranked window by window, at full LENGTH.

Ranks are fingerprints (polynomial, 64 bits, plus 32 of the sampled string and the bucket), so that a rank needs no
second pass to be looked up. What is sorted goes through the shuffle packed, one row per block of documents and bucket.
Before that, equal strings of a block are one entry, and a first rank has at most `SPREAD` entries of a block (the rest
goes to step 3 at once), so the entries of a very common string grow with the blocks, not with its occurrences.

A null text is empty, a null doc_id comes first. Rows with one doc_id count as the same document: equal strings at equal
positions of such rows are not earlier than each other. Other columns go through unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm.common import byte_view, give_back, mixed, pieces, ranges
from quietlog.session import free_shuffles, staged

LENGTH = 100
FIRST = 32
#: entries of one first rank that a block sends
SPREAD = 4
#: bytes of text in a block, and of windows in one numpy step, whose arrays take some hundred times as much
BLOCK = 1 << 20
STEP = 1 << 17
#: buckets of ranks for each shuffle partition: what a task sorts at once
BUCKETS = 4
REPEAT, AMBIGUOUS = 1, 2

#: multiplier of the fingerprints and its inverse modulo 2^64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LETTERS = np.random.default_rng(20240101).integers(0, 1 << 64, 256, np.uint64)

ENTRY = np.dtype([("key", "<u4"), ("rank", "<u8"), ("doc", "<i8"), ("at", "<u4")])
PACKED = "bucket int, block_id long, base int, payload binary"
PART = "block_id long, kind int, payload binary"

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


class Prints:
    """Fingerprints of all substrings of some bytes."""

    def __init__(self, data: np.ndarray) -> None:
        self.n = len(data)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(LETTERS[data] * powers(BASE, self.n), out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * powers(INVERSE, self.n)[start]

    def every(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[:-length]) * powers(INVERSE, self.n)[: self.n - length + 1]


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours: prefix and suffix minima of aligned stretches."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def steps(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of a block's bytes, with the windows that start in them: offset and bytes."""
    for at in range(0, max(len(data) - LENGTH + 1, 0), STEP):
        yield at, data[at : at + STEP + LENGTH - 1]


class Block:
    """The documents of a block, and their runs: first and last window, first rank and rank of the extent."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch = batch
        self.data, self.offsets = byte_view(batch.column("text").fill_null(""))
        self.doc_id = batch.column("doc_id").cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
        found = [self._runs(at, part) for at, part in steps(self.data, self.offsets)]
        self.first, self.last, self.key, self.rank = (np.concatenate(x) if found else np.empty(0, t) for x, t in zip(list(zip(*found, strict=True)) or [()] * 4, (np.int64, np.int64, np.uint64, np.uint64), strict=True))

    def _runs(self, base: int, part: np.ndarray) -> tuple[np.ndarray, ...]:
        prints, n = Prints(part), len(part) - LENGTH + 1
        rank = mixed(prints.every(FIRST))
        low = np.uint64((1 << 24) - 1)
        # leftmost of the smallest: hash above, position below
        sample = (smallest(rank & ~low | np.arange(len(rank), dtype=np.uint64), LENGTH - FIRST + 1) & low).astype(np.int64)
        whole = np.ones(n, bool)  # windows within one document
        for end in self.offsets[1:-1]:
            if base - LENGTH < end < base + n + LENGTH:
                whole[max(0, end - base - LENGTH + 1) : max(0, end - base)] = False
        new = np.flatnonzero(whole & np.append(True, (sample[1:] != sample[:-1]) | ~whole[:-1]))
        stop = np.flatnonzero(whole & np.append((sample[1:] != sample[:-1]) | ~whole[1:], True))
        extent = prints.of(new, stop - new + LENGTH)
        with np.errstate(over="ignore"):
            shape = mixed(((stop - new) << 32 | (sample[new] - new)).astype(np.uint64))
        return new + base, stop + base, rank[sample[new]], mixed(extent ^ shape)

    def position(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc_id and byte in the document."""
        doc = np.searchsorted(self.offsets, window, "right") - 1
        return self.doc_id[doc], window - self.offsets[doc]

    def ambiguous(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs with that code: all windows, their run, and their rank at full length."""
        some = np.flatnonzero(code == AMBIGUOUS)
        n = self.last[some] - self.first[some] + 1
        run = np.repeat(some, n)
        window = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + self.first[run]
        rank = np.empty(len(window), np.uint64)
        for at, part in steps(self.data, self.offsets):
            lo, hi = np.searchsorted(window, (at, at + STEP))
            if hi > lo:
                rank[lo:hi] = mixed(Prints(part).of(window[lo:hi] - at, LENGTH))
        return window, run, rank


def planes(column: np.ndarray) -> bytes:
    """First bytes of all values, then second bytes, and so on: bytes that hardly change are compressed away."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), -1).T.tobytes()


class Entries:
    """Strings of a block by rank: equal ones are one entry, which stands where the string comes first."""

    def __init__(self, key: np.ndarray, rank: np.ndarray, doc: np.ndarray, at: np.ndarray, by: np.ndarray, buckets: int, spread: int | None) -> None:
        bucket = (by >> np.uint64(32)) % np.uint64(buckets)
        short = key.astype(np.uint32)
        self.order = np.lexsort((at, doc, rank, short, bucket))
        k, r, d, a, b = (x[self.order] for x in (short, rank, doc, at, bucket))
        n = len(k)
        new_key = np.ones(n, bool)
        new_key[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
        new = new_key.copy()
        new[1:] |= r[1:] != r[:-1]
        head = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        later = (d != d[head[self.group]]) | (a != a[head[self.group]])
        sent = np.ones(len(head), bool)
        if spread:  # how many groups of its key come before each
            start = np.maximum.accumulate(np.where(new_key[head], np.arange(len(head)), 0))
            sent = np.arange(len(head)) - start < spread
        self.later, self.sent = later, sent
        self.number = np.cumsum(sent) - 1
        at_ = head[sent]
        self.bucket = b[at_].astype(np.int64)
        self.table = np.empty(len(at_), ENTRY)
        for name, column in zip(ENTRY.names, (k, r, d, a), strict=True):
            self.table[name] = column[at_]

    def rows(self, block_id: int) -> pa.RecordBatch:
        cut, ends = ranges(self.bucket)
        payload = [b"".join(planes(self.table[name][a:b]) for name in ENTRY.names) for a, b in zip(cut, ends, strict=True)]
        columns = [pa.array(self.bucket[cut], pa.int32()), pa.array(np.full(len(cut), block_id)), pa.array(cut, pa.int32()), pa.array(payload, pa.binary())]
        return pa.record_batch(columns, ["bucket", "block_id", "base", "payload"])

    def codes(self, verdict: list[bytes]) -> np.ndarray:
        """The code of each string: its own, if it comes later in the block, else that of its entry."""
        of = np.zeros(len(self.table), np.uint8)
        for v in verdict:
            pairs = np.frombuffer(v, "<u4")
            of[pairs >> 2] = pairs & 3
        group = np.where(self.sent, of[np.minimum(self.number, max(len(of) - 1, 0))] if len(of) else 0, AMBIGUOUS)
        out = np.empty(len(self.order), np.uint8)
        out[self.order] = np.where(self.later, REPEAT, group[self.group])
        return out


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` in a worker that holds no memory of an earlier step, and leaves none behind."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return step


def judged(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
    """Sort the entries of a partition's buckets; tell each block which of its entries are repeats or ambiguous."""
    tables, bucket, block, number = [], [], [], []
    for batch in batches:
        for b, block_id, base, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, at = len(payload) // ENTRY.itemsize, 0
            t = np.empty(n, ENTRY)
            for name in ENTRY.names:
                size = ENTRY[name].itemsize
                t[name] = np.frombuffer(payload, np.uint8, n * size, at).reshape(size, n).T.copy().view(ENTRY[name])[:, 0]
                at += n * size
            tables.append(t)
            bucket.append(np.full(n, b, np.int32))
            block.append(np.full(n, block_id))
            number.append(np.arange(base, base + n, dtype=np.uint32))
    if not tables:
        return
    t, b, block, number = (np.concatenate(x) for x in (tables, bucket, block, number))
    del tables
    order = np.lexsort((t["at"], t["doc"], t["rank"], t["key"], b))
    t, b, block, number = t[order], b[order], block[order], number[order]
    new_key = np.append(True, (t["key"][1:] != t["key"][:-1]) | (b[1:] != b[:-1]))
    new = new_key | np.append(True, t["rank"][1:] != t["rank"][:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (t["doc"] != t["doc"][head]) | (t["at"] != t["at"][head])
    key_of = np.cumsum(new_key) - 1
    several = np.bincount(key_of, new) > 1
    code = np.where(later, REPEAT, np.where(several[key_of], AMBIGUOUS, 0)).astype(np.uint32)
    some = np.flatnonzero(code)
    some = some[np.argsort(block[some], kind="stable")]
    pairs, owner = number[some] << np.uint32(2) | code[some], block[some]
    cut, ends = ranges(owner)
    payload = [pairs[a:z].astype("<u4").tobytes() for a, z in zip(cut, ends, strict=True)]
    yield pa.record_batch([pa.array(owner[cut], pa.int64()), pa.array(np.full(len(cut), kind), pa.int32()), pa.array(payload, pa.binary())], ["block_id", "kind", "payload"])


def blocks(docs: DataFrame) -> DataFrame:
    """Documents in blocks of about BLOCK bytes of text, compressed, written once so that a block keeps its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, waiting, size = TaskContext.get().partitionId() << 32, [], 0

        def close() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            whole = pa.concat_batches(waiting)
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
                out.write_batch(whole)
            return pa.record_batch([pa.array([made]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block_id", "payload"])

        for piece in pieces(batches, "text", BLOCK // 4):
            waiting.append(piece)
            size += max(piece.column("text").nbytes, 1)
            if size >= BLOCK:
                yield close()
                made, waiting, size = made + 1, [], 0
        if waiting:
            yield close()

    return staged(docs.mapInArrow(frugal(run), "block_id long, payload binary"), "blocks")


def _with_verdicts(stored: DataFrame, verdicts: list[DataFrame], parts: int, use: Callable, schema) -> DataFrame:
    """`use(block_id, Block, verdict payloads by kind)` for each block."""
    rows = stored.select("block_id", F.lit(9).alias("kind"), "payload")
    for v in verdicts:
        rows = rows.unionByName(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[bytes]] = {}
        for batch in batches:
            ids, kinds, payload = batch.columns
            for i in range(batch.num_rows):
                kind = kinds[i].as_py()
                if kind < 9:
                    got.setdefault(kind, []).append(payload[i].as_py())
                else:
                    yield from use(ids[i].as_py(), opened(payload[i]), got)
                    got = {}

    if verdicts:
        rows = rows.repartition(parts, "block_id").sortWithinPartitions("block_id", "kind")
    return rows.mapInArrow(frugal(run), schema)


def opened(payload: pa.BinaryScalar) -> Block:
    with pa.ipc.open_stream(payload.as_buffer()) as stream:
        return Block(stream.read_next_batch())


def marked(docs: DataFrame, result: Callable[[Block, np.ndarray], pa.RecordBatch], schema) -> DataFrame:
    """`result(block, starts of its repeats)` for each block of the documents."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * BUCKETS
    stored = blocks(docs)

    def runs_of(block: Block) -> Entries:
        return Entries(block.key, block.rank, *block.position(block.first), block.key, buckets, SPREAD)

    def windows_of(block: Block, code: np.ndarray) -> tuple[np.ndarray, Entries]:
        window, run, rank = block.ambiguous(code)
        return window, Entries(block.key[run], rank, *block.position(window), rank, buckets, None)

    def first(block_id: int, block: Block, _: dict) -> Iterator[pa.RecordBatch]:
        yield runs_of(block).rows(block_id)

    def second(block_id: int, block: Block, got: dict) -> Iterator[pa.RecordBatch]:
        yield windows_of(block, runs_of(block).codes(got.get(0, [])))[1].rows(block_id)

    def last(block_id: int, block: Block, got: dict) -> Iterator[pa.RecordBatch]:
        code = runs_of(block).codes(got.get(0, []))
        window, entries = windows_of(block, code)
        mark = np.zeros(len(block.data) + 1, np.int32)  # +1 where removal begins, -1 behind its end
        np.add.at(mark, block.first[code == REPEAT], 1)
        np.add.at(mark, block.last[code == REPEAT] + LENGTH, -1)
        single = window[entries.codes(got.get(1, [])) == REPEAT]
        np.add.at(mark, single, 1)
        np.add.at(mark, single + LENGTH, -1)
        yield result(block, np.cumsum(mark[:-1]) > 0)

    def sorted_by_rank(packed: DataFrame, kind: int) -> DataFrame:
        return packed.repartition(buckets, "bucket").mapInArrow(frugal(lambda batches: judged(batches, kind)), PART)

    runs = staged(sorted_by_rank(_with_verdicts(stored, [], parts, first, PACKED), 0), "runs")
    free_shuffles(spark)
    windows = sorted_by_rank(_with_verdicts(stored, [runs], parts, second, PACKED), 1)
    return _with_verdicts(stored, [runs, windows], parts, last, schema)


def kept_bytes(block: Block, removed: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """Bytes, removed bytes, removed runs and what is left, for each document."""
    starts = removed & ~np.append(False, removed[:-1]) if len(removed) else removed
    for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
        gone = removed[a:b]
        spans = int(starts[a:b].sum()) + (b > a and bool(gone[0]) and not starts[a])
        yield b - a, int(gone.sum()), spans, block.data[a:b][~gone].tobytes()


def whole_characters(data: np.ndarray, removed: np.ndarray) -> np.ndarray:
    """`removed`, widened to every byte of each UTF-8 character that loses one, so that no two halves can meet."""
    if not len(data):
        return removed
    first = np.flatnonzero((data & 0xC0) != 0x80)
    return np.repeat(np.logical_or.reduceat(removed, first), np.diff(np.append(first, len(data))))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the remaining bytes, for every row."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def result(block: Block, removed: np.ndarray) -> pa.RecordBatch:
        rows = [(n, gone, spans, hashlib.sha256(kept).hexdigest()) for n, gone, spans, kept in kept_bytes(block, removed)]
        columns = [block.batch.column("doc_id"), *(pa.array(c) for c in zip(*rows, strict=True))]
        return pa.record_batch(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return marked(rows, result, schema)


def removed(docs: DataFrame) -> DataFrame:
    """The rows with what is left of their texts; characters that lost some of their bytes go as well.

    `n_chars`, where there is such a column, is the length of the new text.
    """

    def result(block: Block, gone: np.ndarray) -> pa.RecordBatch:
        whole = block.batch.column("text")
        gone = whole_characters(block.data, gone)
        new = [None if t is None else kept.decode() for t, (*_, kept) in zip(whole.to_pylist(), kept_bytes(block, gone), strict=True)]
        columns = dict(zip(block.batch.schema.names, block.batch.columns, strict=True))
        columns["text"] = pa.array(new, whole.type)
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in new]).cast(columns["n_chars"].type)
        return pa.record_batch(columns)

    return marked(docs, result, docs.schema)
