"""Near-duplicate documents: DartMinHash signatures, banding, exact check, connected components.

A document is its set of word shingles (`SHINGLE` words, lower case, between white space), or a bag with the counts as
weights. Each element has a Poisson process of darts on (weight, rank), thrown by hashing and alike in all documents;
a document owns the darts below its element's weight. Each dart falls on one of k coordinates; the dart of lowest rank
on each makes the signature. Two signatures agree on a coordinate with the probability of their (generalised) Jaccard
similarity. Only ranks up to t / weight are thrown first (t = k ln k + 2k darts are enough for nearly all documents);
where a coordinate stays empty, the bound is doubled.

Documents that agree on a whole band are candidates. In two steps none of their links is lost, without listing the
pairs of a group: first every member of a bucket is compared with the bucket's most connected member; then only buckets
whose members are still in different components are compared, tile by tile, across components: by signatures, in the
first band that a pair shares, and then by sets where the tile has not linked the two components already. Only links
leave a tile. Every link is checked on the exact sets; with ROWS = 4 and BANDS = 24 a pair of similarity 0.8 shares no band with
probability 3e-6. Equal sets are one node from the start.

Documents with fewer words than a shingle have one shingle of all their words; those without words (null, empty) are in
no group. A null doc_id stays null and names no group unless all its members have none. Repeated rows are copies.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietlog.llm.common import mixed, pieces
from quietlog.llm.repeats import Prints
from quietlog.session import staged

SHINGLE = 5
SIMILAR = 0.8
ROWS, BANDS = 4, 24
#: members of a tile when a bucket is compared as a whole
TILE = 1024
#: bytes of text that are sketched at a time
SKETCHED = 1 << 20
#: agreeing share of a signature below which a pair can't be similar (five standard deviations at 0.8)
LEAST_AGREEMENT = 0.6

ODD_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
SKETCH = "doc_id long, node long, bands array<long>, signature binary, members binary"


def shingles(values: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in sequence: text number, hash (each once a text, ascending) and count of shingles."""
    low = [" ".join(v.split()).lower() if ODD_SPACE.search(v) else v.lower() for v in values]
    raw = [v.encode() for v in low]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.append(True, space[:-1])
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(space & ~before)
    ends = np.cumsum([len(r) + 1 for r in raw])
    owner = np.searchsorted(ends, start, "right")
    word = mixed(Prints(data).of(start, end - start)) if len(start) else np.empty(0, np.uint64)
    n = np.bincount(owner, minlength=len(values))
    first = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        made = np.zeros(len(word), np.uint64)  # of up to `width` words from each, within its text
        left = np.repeat(first + n, n) - np.arange(len(word))
        for k in range(width):
            some = left > k
            made[some] = mixed(made[some] + word[np.flatnonzero(some) + k])
    keep = (left >= width) | ((left == np.repeat(n, n)) & (np.repeat(n, n) < width))
    owner, made = owner[keep], made[keep]
    order = np.lexsort((made, owner))
    owner, made = owner[order], made[order]
    new = np.append(True, (made[1:] != made[:-1]) | (owner[1:] != owner[:-1]))[: len(made)]
    at = np.flatnonzero(new)
    return owner[at], made[at], np.diff(np.append(at, len(made)))


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k ids of the earliest darts; 0 in rows of documents without elements. owner: ascending document numbers."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, weight, minlength=n)
    bound = np.divide(k * np.log(k) + 2 * k, total, out=np.zeros(n), where=total > 0)
    todo = total > 0
    while todo.any():
        mine = todo[owner]
        out[todo] = _thrown(owner[mine], element[mine], weight[mine].astype(float), bound, n, k)[todo]
        todo = todo & (out == 0).any(1)
        bound = bound * 2
    return out


def _thrown(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, bound: np.ndarray, n: int, k: int) -> np.ndarray:
    """Darts of rank below each document's bound."""
    ranks, cells, darts = [], [], []
    band = 0
    while True:  # bands of weight: [0, 1), [1, 2), [2, 4) ...
        low, width = (0.0, 1.0) if band == 0 else (2.0 ** (band - 1), 2.0 ** (band - 1))
        at = np.flatnonzero(weight > low)
        if not len(at):
            break
        rank, throw = np.zeros(len(at)), 0
        while len(at):
            seed = np.uint64((band << 32 | throw) + 1)
            dart = mixed(element[at] ^ mixed(np.array([seed]))[0]) | np.uint64(1)
            rank = rank - np.log1p(-(dart >> np.uint64(11)).astype(float) / 2.0**53) / width
            near = rank < bound[owner[at]]
            at, rank, dart = at[near], rank[near], dart[near]
            place = mixed(dart)
            own = low + width * (place >> np.uint64(32)).astype(float) / 2.0**32 < weight[at]
            cell = owner[at] * k + ((place & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
            ranks.append(rank[own])
            cells.append(cell[own])
            darts.append(dart[own])
            throw += 1
        band += 1
    rank, cell, dart = (np.concatenate(x) for x in (ranks, cells, darts))
    least = np.full(n * k, np.inf)
    np.minimum.at(least, cell, rank)
    out = np.zeros(n * k, np.uint64)
    won = rank == least[cell]
    out[cell[won]] = dart[won]
    return out.reshape(n, k)


def sketches(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """doc_id; node: fingerprint of the set, null without words; band hashes, short signature, sorted short hashes."""
    k = ROWS * BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SKETCHED):
            values, n = batch.column("text").to_pylist(), batch.num_rows
            owner, element, count = shingles(values)
            weight = count if weighted else np.ones(len(count))
            sign = signatures(owner, element, weight, n, k)
            salt = mixed(np.arange(1, BANDS + 1))
            with np.errstate(over="ignore"):
                band = np.zeros((n, BANDS), np.uint64)
                for r in range(ROWS):
                    band = mixed((band ^ sign[:, r::ROWS]) + salt)
            cut = np.searchsorted(owner, np.arange(n + 1))
            members = (element >> np.uint64(32)).astype("<u4")
            node, sets = [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                whole = element[a:b].tobytes() + (count[a:b].tobytes() if weighted else b"")
                node.append(int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little", signed=True) if b > a else None)
                sets.append(np.unique(members[a:b]).tobytes())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS), pa.int32()), pa.array(band.view(np.int64).ravel()))
            short = (sign >> np.uint64(20)).astype("<u2")
            columns = [batch.column("doc_id"), pa.array(node, pa.int64()), lists, pa.array([s.tobytes() for s in short], pa.binary()), pa.array(sets, pa.binary())]
            yield pa.record_batch(columns, ["doc_id", "node", "bands", "signature", "members"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, SKETCH)


@F.pandas_udf(T.DoubleType())
def similarity(a, b):
    """Jaccard similarity of two sorted sets of 32-bit values."""
    import pandas as pd

    return pd.Series([_jaccard(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(a, b, strict=True)])


def _jaccard(p: np.ndarray, q: np.ndarray) -> float:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both / (len(p) + len(q) - both)


def checked(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs whose exact similarity is high enough; the joins are plain ones, which Spark splits at a hot node."""
    left, right = sets.select(F.col("node").alias("a"), F.col("members").alias("x")), sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(similarity("x", "y") >= similar).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that can be reached. Edges (a, b), either way round.

    Each round takes the least label of the neighbours and then that label's label; staged, so lineage stays short.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        new = labels.join(near, "node").select("node", F.least("label", "low").alias("label"), F.col("label").alias("was"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = staged(new.join(far, "label").select("node", F.least("label", "further").alias("label"), "was"), "labels")
        if new.where("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def links(sketch: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Enough verified links (a, b) between nodes that their components are those of all links."""
    band = sketch.where("node is not null").select("node", F.posexplode("bands").alias("place", "band"))
    several = band.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("band")
    member = staged(band.join(several, "band").distinct(), "buckets")
    size = member.groupBy("band").agg(F.count("*").alias("n"))
    fame = member.join(size, "band").groupBy("node").agg(F.sum("n").alias("fame"))
    hub = member.join(fame, "node").groupBy("band").agg(F.max_by("node", F.struct("fame", "node")).alias("hub"))
    star = member.join(hub, "band").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    nodes = member.select("node").distinct()
    own = sketch.select("node", "signature", "members").join(nodes, "node").groupBy("node").agg(F.first("signature").alias("signature"), F.first("members").alias("members"))
    own = staged(own, "sets")
    first = staged(checked(star, own, similar), "links")
    label = components(first)
    part = member.join(label, "node", "left").select("band", "place", "node", F.coalesce("label", "node").alias("label"))
    open_ = part.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x < y")
    rest = part.join(open_.select("band", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "band").join(own, "node")
    return first.unionByName(staged(_across(rest, similar), "links"))


def _across(rows: DataFrame, similar: float) -> DataFrame:
    """Links of a bucket between components, as many as join what is similar; in pairs of tiles."""
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("band", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "place", "tile", "node", "label", "signature", "members")

    def compare(t: pa.Table) -> pa.Table:
        sign = np.frombuffer(b"".join(t["signature"].to_pylist()), "<u2").reshape(t.num_rows, BANDS, ROWS)
        sets = [np.frombuffer(x, "<u4") for x in t["members"].to_pylist()]
        node, label, tile = (t[c].to_numpy() for c in ("node", "label", "tile"))
        i, j, place = t["i"][0].as_py(), t["j"][0].as_py(), t["place"][0].as_py()
        one, two = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        label = label.copy()  # one label for what this tile has linked
        found = []
        for a in one.tolist():
            other = two[(label[two] != label[a]) & ((node[two] > node[a]) | (i != j))]
            same = sign[other] == sign[a]
            likely = (same.mean((1, 2)) >= LEAST_AGREEMENT) & (same.all(2).argmax(1) == place)
            for b in other[likely].tolist():
                if label[a] != label[b] and _jaccard(sets[a], sets[b]) >= similar:
                    found.append((node[a], node[b]))
                    label[label == label[b]] = label[a]
        ends = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return rows.groupBy("band", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def groups(docs: DataFrame, similar: float = SIMILAR, weighted: bool = False) -> DataFrame:
    """doc_id and group_id, the smallest doc_id of those that are linked, for every row."""
    sketch = staged(sketches(docs, weighted), "sketches")
    label = components(links(sketch, similar))
    rows = sketch.select("doc_id", "node").join(label, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    least = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    return rows.join(least, "label", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))


def deduplicated(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows, as they are, without documents of a group that has a smaller doc_id.

    Rows that share a doc_id are one document: it goes if all of them would. Rows without doc_id can't be named and stay.
    """
    later = F.coalesce(F.col("doc_id") > F.col("group_id"), F.lit(False))
    gone = groups(docs, similar).groupBy("doc_id").agg(F.min(later).alias("all")).where("all").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
