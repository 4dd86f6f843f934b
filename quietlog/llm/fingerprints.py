"""Document fingerprints by consistent weighted sampling.

A document is a bag of terms (pairs of neighbouring words), weighted by their counts. For each of `SAMPLES` samples a
term of weight w draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash alone, t = floor(ln w / r + b), and
ln a = ln c - r (t - b) - r; the term of least a is the sample, together with its t. Two documents have the same sample
with the probability of their generalised Jaccard similarity, sum of minima over sum of maxima. The Gamma draws are read
from tables of 2^16 quantiles, so a term costs one hash for each sample.

A fingerprint is the samples' hashes as hex text; likeness is the share of equal samples. Texts without words (null,
empty) have a fingerprint of zeros, which is like itself only. Neighbours are taken by doc_id (null first), then text,
so repeated rows stand next to each other; a single document is its own neighbour. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietlog.llm.common import mixed, pieces
from quietlog.llm.near_dups import shingles

SAMPLES = 64
TERM_WORDS = 2
#: terms in one numpy step
STEP = 1 << 14
#: bytes of text whose terms are sampled together, some fifty times as much in memory
PIECE = 1 << 20
#: ranges for each partition, from which partitions of like size are made
FINE = 16

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@lru_cache(1)
def gamma_quantiles() -> np.ndarray:
    """2^16 quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) e^-x, by bisection."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(len(p)), np.full(len(p), 50.0)
    for _ in range(60):
        x = (low + high) / 2
        less = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(less, x, low), np.where(less, high, x)
    return x


def _distinct(term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each weighted term comes first, and which of these every one is."""
    order = np.lexsort((weight, term))
    t, w = term[order], weight[order]
    new = np.append(True, (t[1:] != t[:-1]) | (w[1:] != w[:-1]))[: len(t)]
    of = np.empty(len(term), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def samples(owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int = SAMPLES) -> np.ndarray:
    """n x k hashes of the sampled terms; zeros for documents without terms. owner: ascending document numbers.

    A weighted term is sampled once, however many of the documents have it; a document takes the least of its terms.
    """
    r_of = gamma_quantiles().astype(np.float32)
    ln_of = np.log(gamma_quantiles()).astype(np.float32)
    salt = mixed(np.arange(1, k + 1))

    def drawn(h: np.ndarray, log_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = r_of[(h & np.uint64(0xFFFF)).astype(np.int32)]
        b = (h >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
        t = np.floor(log_weight / r + b)
        return t, ln_of[(h >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int32)] - r * (t - b) - r

    first_of, of = _distinct(term, weight)
    log_weight = np.log(weight).astype(np.float32)
    drawn_a = np.empty((len(first_of), k), np.float32)
    for at in range(0, len(first_of), STEP):
        e = first_of[at : at + STEP]
        drawn_a[at : at + STEP] = drawn(mixed(term[e][:, None] ^ salt), log_weight[e][:, None])[1]
    least, best = np.full((n, k), np.inf, np.float32), np.full((n, k), -1)
    for at in range(0, len(term), STEP):
        o = owner[at : at + STEP]
        a = drawn_a[of[at : at + STEP]]
        first = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        low, doc = np.minimum.reduceat(a, first, axis=0), o[first]
        better = low <= least[doc]  # of equal ones the last term wins, in one step or over two
        least[doc] = np.where(better, low, least[doc])
        row, col = np.nonzero((a == least[o]) & better[np.cumsum(np.append(False, o[1:] != o[:-1]))])
        best[o[row], col] = at + row
    out = np.zeros((n, k), np.uint64)
    doc, col = np.nonzero(best >= 0)
    e = best[doc, col]
    t = drawn(mixed(term[e] ^ salt[col]), log_weight[e])[0]
    with np.errstate(over="ignore"):
        out[doc, col] = mixed(term[e] + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return out


def fingerprints(values: list[str]) -> np.ndarray:
    """n x SAMPLES 32-bit samples of the texts."""
    return (samples(*shingles(values, TERM_WORDS), len(values)) & np.uint64(0xFFFFFFFF)).astype(">u4")


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, guest, doc_id, text, sorted within partitions: the documents in ranges of doc_id, and at the end of each
    range, as guest, the first document of the next range (of the first range, at the very end).

    What the driver gets is a bound and a size for each of the finer ranges that they are made of, and one doc_id for each
    range; texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fine = parts * FINE
    bounds = sorted(set(rows.approxQuantile("key", [i / fine for i in range(1, fine)], 0.2 / fine)))

    def bucket_of(bounds):
        @F.pandas_udf(T.IntegerType())
        def bucket(key):
            import pandas as pd

            return pd.Series(np.searchsorted(np.array(bounds, np.float64), key.to_numpy().astype(np.float64), "right").astype(np.int32))

        return bucket("key")

    # neighbouring ranges make a partition when they have its share of the bytes
    sizes = {r.range: r.size for r in rows.groupBy(bucket_of(bounds).alias("range")).agg(F.sum(F.octet_length("text") + 64).alias("size")).collect()}
    share, filled, cuts = sum(sizes.values()) / parts, 0, []
    for i, bound in enumerate(bounds):
        filled += sizes.get(i, 0)
        if filled >= share * (len(cuts) + 1):
            cuts.append(bound)
    keyed = rows.withColumn("bucket", bucket_of(cuts))
    heads = keyed.groupBy("bucket").agg(F.min("key").alias("key")).orderBy("bucket").collect()
    before = [(heads[i].key, heads[i - 1].bucket) for i in range(len(heads))]
    guests = rows.join(F.broadcast(spark.createDataFrame(before, "key long, bucket int")), "key")
    both = keyed.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", "key", "text").select("bucket", "guest", "doc_id", "text")


def compared(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint, that of its edited text, and how like it is to that and to its neighbour."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        """found: (bucket, guest, doc_id, text), each with what comes next; the last has no answer yet."""
        pairs = [(a, b) for a, b in zip(found, found[1:], strict=False) if not a[1] and a[0] == b[0]]
        at = {id(x): i for i, x in enumerate(found)}
        edited = []
        for a, b in pairs:
            q = len(a[3]) // 4
            edited.append(a[3][: len(a[3]) - q] + b[3][:q])
        both = fingerprints([x[3] for x in found] + edited)  # they share most of their terms
        own, other = both[: len(found)], both[len(found) :]
        mine, near = own[[at[id(a)] for a, _ in pairs]], own[[at[id(b)] for _, b in pairs]]
        columns = [
            pa.array([a[2] for a, _ in pairs], pa.int64()),
            pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            pa.array([x.tobytes().hex() for x in mine], pa.string()),
            pa.array([x.tobytes().hex() for x in other], pa.string()),
            pa.array((mine == other).mean(1)),
            pa.array((mine == near).mean(1)),
        ]
        return pa.record_batch(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in pieces(batches, "text", PIECE):
            waiting += list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if len(waiting) > 1:
                out = rows(waiting)
                if out.num_rows:
                    yield out
                waiting = waiting[-1:]

    return with_next(docs).mapInArrow(run, RESULT)
