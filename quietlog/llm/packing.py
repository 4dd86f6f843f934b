"""Packing of tokenised documents into sequences, in order, by dynamic programming.

Documents in ascending doc_id are one stream of ids (each ends with `END`). A window may be cut after a document
(free), after a sentence, or, where neither comes for a while, anywhere (both at a price in tokens). The cheapest cuts
minimise padding plus prices: cost(j) = price(j) + min over i within `WIDTH` of cost(i) + padding of the window i..j.
Padding is WIDTH minus length, so the minimum of cost(i) + i over a sliding window decides: a monotone queue. Windows
whose length is a power of two are not padded; they are looked up besides.

The stream is cut into ranges of doc_id, one per task, and a range is packed on its own in stretches of `STRETCH`
tokens, whose last sequence goes on into the next stretch; so only the last sequence of a range can be much padded.

A null text is empty and still has its END; null doc_ids come first; repeated rows are packed each. Texts of any length
are cut; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quietlog.llm.bpe import BATCH_BYTES, Bpe, loaded
from quietlog.llm.common import give_back, pieces, texts

WIDTH = 4096
END = 2
#: prices, in tokens of padding, of a cut after a sentence and of one anywhere
SENTENCE, ANYWHERE = 16, 128
#: longest way between places where a cut is possible
GAP = 64
STRETCH = 1 << 20
#: lengths of windows that need no padding
POWERS = tuple(1 << k for k in range(WIDTH.bit_length() - 1))

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _exact(place: np.ndarray, width: int) -> tuple[list[int], list[int]]:
    """For place j, in the first list from upto[j] to upto[j + 1]: those a power of two below `width` before it, nearest first."""
    powers = np.array([p for p in POWERS if p < width], np.int64)
    low = place[:, None] - powers
    i = np.minimum(np.searchsorted(place, low), len(place) - 1)
    there = place[i] == low
    return i[there].tolist(), np.concatenate([[0], np.cumsum(there.sum(1))]).tolist()


def cuts(place: list[int], price: list[int], width: int = WIDTH) -> list[int]:
    """The places where windows end, of those given (ascending, from 0 to the end, at most `width` apart)."""
    cost, back, value = [0] * len(place), [0] * len(place), [0] * len(place)
    queue, exact, upto = deque([0]), *_exact(np.array(place, np.int64), width)
    for j in range(1, len(place)):
        p = place[j]
        while place[queue[0]] < p - width:
            queue.popleft()
        low = queue[0]
        least = value[low] + width - p
        for i in exact[upto[j] : upto[j + 1]]:
            if cost[i] < least:
                least, low = cost[i], i
        cost[j], back[j] = least + price[j], low
        value[j] = v = least + price[j] + p
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    ends, j = [], len(place) - 1
    while j:
        ends.append(place[j])
        j = back[j]
    return ends[::-1]


def places(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray) -> tuple[list[int], list[int]]:
    """Where a stream may be cut, and the prices."""
    price = np.full(len(ids) + 1, ANYWHERE, np.int32)
    price[1:][sentence[ids]] = SENTENCE
    price[doc_ends] = 0
    price[0] = 0
    good = np.flatnonzero(price < ANYWHERE)
    if not len(good) or good[-1] != len(ids):
        good = np.append(good, len(ids))
    gap = np.diff(good)
    more = [np.arange(a + GAP, b, GAP) for a, b in zip(good[:-1][gap > GAP].tolist(), good[1:][gap > GAP].tolist(), strict=True)]
    where = np.sort(np.concatenate([good, *more]))
    return where.tolist(), price[where].tolist()


def sentence_ends(bpe: Bpe) -> np.ndarray:
    """For each id whether its token ends a sentence."""
    out = np.zeros(max(bpe.tokens) + 1, bool)
    for i, token in bpe.tokens.items():
        out[i] = token.endswith("</w>") and bool(token[:-4]) and all(c in ".!?" for c in token[:-4])
    return out


class Stream:
    """Documents that wait for their windows."""

    def __init__(self, sentence: np.ndarray, first: int) -> None:
        self.sentence, self.sequence = sentence, first
        self.docs: deque[tuple[int | None, bytes, int]] = deque()  # doc_id, ids, how many are packed
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, ids, 0))
        self.size += len(ids) // 4

    def packed(self, whole: bool) -> Iterator[tuple]:
        """Rows of PIECES; if not `whole`, the last sequence waits for more."""
        if not self.docs:
            return
        ids = np.concatenate([np.frombuffer(d, "<u4")[done:] for _, d, done in self.docs])
        ends = np.cumsum([len(d) // 4 - done for _, d, done in self.docs])
        windows = cuts(*places(ids, ends, self.sentence))
        at = 0
        for end in windows if whole else windows[:-1]:
            offset = 0
            while at < end:
                doc_id, data, done = self.docs[0]
                n = min(end - at, len(data) // 4 - done)
                yield doc_id, done, n, zlib.crc32(data[4 * done : 4 * (done + n)]), len(data) // 4, self.sequence, offset
                at, offset = at + n, offset + n
                if done + n == len(data) // 4:
                    self.docs.popleft()
                else:
                    self.docs[0] = doc_id, data, done + n
            self.sequence += 1
        self.size -= at


def packed(docs: DataFrame, path: str) -> DataFrame:
    """A row per piece of a document in a sequence; sequence ids ascend with the documents."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        stream = Stream(sentence_ends(bpe), TaskContext.get().partitionId() << 32)
        end = END.to_bytes(4, "little")
        for batch in pieces(batches, "text", BATCH_BYTES):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), bpe.encode_all(batch.column("text").to_pylist()), strict=True):
                stream.add(doc_id, ids + end)
            if stream.size >= STRETCH and (found := list(stream.packed(False))):
                yield rows(found)
        if found := list(stream.packed(True)):
            yield rows(found)
        give_back()

    return texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, PIECES)
