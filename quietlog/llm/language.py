"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are folded to lower-case letters, everything else is a word gap. N-grams of one to three characters that do not
cross a gap (but may start or end with it) are hashed into bins. Training counts bins by language over all labelled
texts, summed up in each task before the shuffle; the matrix of log-probabilities (languages x bins, both bounded by
parameters) is broadcast. A text's n-grams are a sparse row that is multiplied with it, batch by batch, in numpy.

The posterior only says which learned language is likelier than the others, so `norms` adds how well training texts fit
their winning language: mean log-probability an n-gram, as far below the language's usual one as any training text is.

A null text, or one without letters, is `und` with score 0, and so is everything where nothing could be learned. Rows
without language or doc_id teach nothing; repeated rows count as often as they appear and each get an answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlog.llm.common import give_back, pieces

BINS = 1 << 16
ORDERS = (1, 2, 3)
GAP = 32
#: short texts stray more: 1 + SHORT / sqrt(n-grams) times as far
SHORT = 8
#: room for texts not learned from, and the most allowed, as a share of the way to bins that are all alike, where gibberish is
ROOM, MOST = 0.5, 0.35
#: bytes of text that are weighed at a time where no scores come out; numpy takes some 40 times as many, and more for each language
WEIGHED = 1 << 19


class Model(NamedTuple):
    langs: tuple[str, ...]
    #: bins x languages
    log_p: np.ndarray
    log_prior: np.ndarray
    #: mean log-probability of the n-grams learned for each language; 0 where there were none
    usual: np.ndarray


def held_out() -> Column:
    """True for the third of the documents that is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


@lru_cache(1)
def fold() -> np.ndarray:
    """Lower-case letter, or the gap, for each code point."""
    table = np.full(0x110000, GAP, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def grams(values: list[str | None], bins: int = BINS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: text number, in order, and bin of every n-gram."""
    whole = "".join(" " + (v or "") for v in values) + " "
    codes = fold()[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
    owner = np.repeat(np.arange(len(values)), [len(v or "") + 1 for v in values])
    gap = codes == GAP
    keep = ~(gap[1:] & gap[:-1])  # the last of each run of gaps, so that a text keeps its own
    keep[:-1] |= owner[1:] != owner[:-1]
    at = np.flatnonzero(keep)
    codes, owner, gap = np.append(codes[at], GAP), owner[at], np.append(gap[at], True)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            m = max(0, len(owner) - n + 2) if n > 1 else len(owner)
            h = np.full(m, 0x9E3779B9 * n & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ codes[k : k + m]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            inner = ~gap[:m] if n == 1 else np.ones(m, bool)
            for k in range(1, n - 1):
                inner &= ~gap[k : k + m]
            if n == 2:
                inner &= ~(gap[:m] & gap[1 : 1 + m])
            yield owner[:m][inner], (h[inner] % np.uint32(bins)).astype(np.int64)


def fit(docs: DataFrame, bins: int = BINS, max_langs: int = 32, smoothing: float = 0.5) -> Model:
    """Learn from all rows with text and lang. More than `max_langs` languages are an error: the matrix is broadcast."""
    known = docs.where("text is not null and lang is not null").select("text", "lang")
    langs = sorted(r.lang for r in known.select("lang").distinct().limit(max_langs + 1).collect())
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {lang: i for i, lang in enumerate(langs)}
        total = np.zeros((len(langs), bins + 1), np.int64)  # the last column counts texts
        for batch in pieces(batches, "text"):
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
            total[:, bins] += np.bincount(lang, minlength=len(langs))
            for owner, bin_ in grams(batch.column("text").to_pylist(), bins):
                total[:, :bins] += np.bincount(lang[owner] * bins + bin_, minlength=len(langs) * bins).reshape(len(langs), bins)
        i, j = np.nonzero(total)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["lang", "bin", "n"])
        give_back()

    summed = known.mapInArrow(count, "lang int, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(langs), bins + 1))
    total[summed["lang"].to_numpy(), summed["bin"].to_numpy()] = summed["n"].to_numpy()
    p = total[:, :bins] + smoothing
    log_p = np.ascontiguousarray(np.log(p / p.sum(1, keepdims=True)).T)
    docs_of = total[:, bins]
    usual = (total[:, :bins] * log_p.T).sum(1) / np.maximum(total[:, :bins].sum(1), 1)
    return Model(tuple(langs), log_p, np.log(np.maximum(docs_of, 1) / max(docs_of.sum(), 1)), usual)


def weighed(values: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probability of each text and language, number of n-grams, and whether there are letters."""
    n = len(values)
    total, letters, count = np.tile(model.log_prior, (n, 1)), np.zeros(n, bool), np.zeros(n, np.int64)
    for order, (owner, bin_) in zip(ORDERS, grams(values, len(model.log_p)), strict=True):
        start = np.searchsorted(owner, np.arange(n))
        size = np.diff(start, append=len(owner))
        some = size > 0
        count += size
        if order == 1:
            letters = some
        if some.any() and model.langs:
            total[some] += np.add.reduceat(model.log_p[bin_], start[some], axis=0)
    return total, count, letters


def posterior(total: np.ndarray) -> np.ndarray:
    """Probability of the likeliest language of each text."""
    return 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)


def score(values: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    total, _, letters = weighed(values, model)
    if not model.langs:
        return ["und"] * len(values), np.zeros(len(values))
    return [model.langs[b] if x else "und" for b, x in zip(total.argmax(1), letters, strict=True)], np.where(letters, posterior(total), 0.0)


def misfit(total: np.ndarray, count: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Likeliest language of each text, and how far its mean n-gram is below the usual one there, by what its length allows."""
    best = total.argmax(1)
    n = np.maximum(count, 1)
    mean = (total[np.arange(len(best)), best] - model.log_prior[best]) / n
    return best, (model.usual[best] - mean) / (1 + SHORT / np.sqrt(n))


def norms(docs: DataFrame, model: Model) -> np.ndarray:
    """The largest misfit to accept in each language: that of all training texts it won, and some room, but at most MOST."""
    if not model.langs:
        return np.zeros(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(len(shared.value.langs))
        for batch in pieces(batches, "text", WEIGHED):
            total, count, letters = weighed(batch.column("text").to_pylist(), shared.value)
            best, off = misfit(total, count, shared.value)
            np.maximum.at(most, best[letters], off[letters])
        yield pa.record_batch([pa.array(np.arange(len(most)), pa.int32()), pa.array(most)], ["lang", "most"])
        give_back()

    known = docs.where("text is not null and lang is not null").select("text")
    out = np.zeros(len(model.langs))
    for r in known.mapInArrow(worst, "lang int, most double").groupBy("lang").agg(F.max("most").alias("most")).collect():
        out[r.lang] = r.most
    limit = MOST * (model.usual + np.log(len(model.log_p)))
    return np.where(model.usual < 0, np.minimum(out + ROOM, limit), -1.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; only doc_id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            langs, p = score(batch.column("text").to_pylist(), shared.value)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(p)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, most: np.ndarray | None = None) -> DataFrame:
    """The rows, all columns as they are, whose text is in a known language with at least that probability.

    With `most` (see `norms`) the text must also fit that language; without, any text with letters is in one of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, most = shared.value
        for batch in pieces(batches, "text", WEIGHED):
            total, count, letters = weighed(batch.column("text").to_pylist(), model)
            keep = letters & bool(model.langs)
            if model.langs:
                keep &= posterior(total) >= least
            if model.langs and most is not None:
                best, off = misfit(total, count, model)
                keep &= off <= most[best]
            yield batch.filter(pa.array(keep))
        give_back()

    return docs.mapInArrow(run, docs.schema)
