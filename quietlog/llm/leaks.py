"""Benchmark decontamination by winnowing, in DataFrame and SQL functions alone.

Words are runs of digits, letters a-z (A-Z in lower case) and code points above ASCII.  A window is ten words of an
item, or the whole item where it has fewer (but any).  A document word is hit if it lies in an occurrence of a window.

Method: in a window of t words every k-gram of words is hashed, and the least hash is kept (k = half of t, rounded up).
What is kept depends on the window alone, so a span of t shared words keeps the same hash on both sides: joining the
kept hashes of documents with those of items misses none.  Each hit is then extended: of documents that share a hash,
the windows are compared with the items' windows word by word.  Windows of equal text count once, so neither repeated items
nor repeated words multiply the pairs.

Both joins are on hashes and left to Spark, which broadcasts the items' side where its written table is small and
shuffles by hash where it isn't.  Lengths below ten get hashes of their own, and only if an item is that short.

Rows: each document row gives one row.  Null text and text without words: no words, never contaminated.  Rows of
equal doc_id (or null) are told apart by their texts; equal rows get equal results.  Items of equal text all
count.  Items without item_id mark words, but aren't counted or listed.  Other columns stay out of the way.
Empty tables give no rows, or rows without hits.  A text is held as an array of words in its task, some 100 bytes a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietlog.functions.text import pin
from quietlog.llm.common import let, n_pieces
from quietlog.session import staged

#: words of a window
WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what lies between words, before and after lower-casing
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, in order; ASCII capitals alone are lowered."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def kept(items: Column, t: int) -> Column:
    """The least k-gram hash of each window of `t` words, by the window's place; `items` are words."""
    k = (t + 1) // 2
    width = t - k + 1
    last = F.size(items) - t + 1

    def grams(hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: F.xxhash64(F.lit(t), h, *(F.get(hashes, i + j) for j in range(1, k))))

    def least(values: Column) -> Column:
        if width == 1:
            return F.slice(values, 1, last)
        inside = F.slice(values, 1, last)
        return F.transform(inside, lambda v, i: F.least(v, *(F.get(values, i + j) for j in range(1, width))))

    hashed = F.transform(items, lambda w: F.xxhash64(w))
    return F.when(last > 0, let(hashed, lambda h: let(grams(h), least))).otherwise(F.array().cast("array<bigint>"))


def windows(items: Column, t: int) -> Column:
    """Each window of `t` words: its kept hash, place and words."""
    return F.transform(
        kept(items, t),
        lambda h, i: F.struct(h.alias("hash"), i.alias("place"), F.lit(t).alias("t"), F.array_join(F.slice(items, i + 1, t), " ").alias("window")),
    )


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of both, which tells rows of one doc_id apart."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.withColumn("row_key", F.xxhash64("doc_id", "text"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["row_key"] == b["row_key"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """The windows of each item once: hash, t, window, item_id."""
    own = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words")
    )
    t = F.least(F.size("words"), F.lit(WINDOW))
    each = F.lit(None)
    for n in range(WINDOW, 0, -1):
        each = F.when(t == n, windows(F.col("words"), n)).otherwise(each)
    found = own.where(F.size("words") > 0).select("item_id", F.explode(pin(each)).alias("w"))
    return found.select("w.hash", "w.t", "w.window", "item_id").distinct()


def occurrences(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Where the windows of `known` (hash, t, window) occur: doc_id, row_key, place, t, window; once for equal rows."""
    lengths = sorted(r.t for r in known.select("t").distinct().collect())  # ten at most
    docs = _keyed(documents)
    if not lengths:
        return docs.select("doc_id", "row_key", F.lit(0).alias("place"), F.lit(0).alias("t"), F.lit("").alias("window")).limit(0)
    hashes = let(words(F.col("text")), lambda w: F.concat(*(kept(w, t) for t in lengths)))
    prints = docs.select("doc_id", "row_key", F.explode(pin(F.array_distinct(hashes))).alias("hash"))
    touched = staged(prints.join(known.select("hash"), "hash", "left_semi").select("doc_id", "row_key").distinct(), "touched")
    near = docs.join(touched, _same(docs, touched), "left_semi")
    each = near.select("doc_id", "row_key", F.explode(pin(let(words(F.col("text")), lambda w: F.concat(*(windows(w, t) for t in lengths))))).alias("w"))
    flat = each.select("doc_id", "row_key", "w.hash", "w.place", "w.t", "w.window")
    return flat.join(known.select("hash", "t", "window"), ["hash", "t", "window"], "left_semi").drop("hash").distinct()


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, items that occur, their ids' digest, and whether any word is hit."""
    known = staged(item_windows(benchmark), "windows")
    hits = staged(occurrences(documents, known), "occurrences")
    # words under at least one window: each window adds what the windows before it have not reached
    before = W.partitionBy("doc_id", "row_key").orderBy("place", "t").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("place") + F.col("t")
    covered = (
        hits.select("doc_id", "row_key", "place", "t")
        .withColumn("reached", F.coalesce(F.max(end).over(before), F.lit(0)))
        .groupBy("doc_id", "row_key")
        .agg(F.sum(F.greatest(F.lit(0), end - F.greatest("place", "reached"))).alias("n_hit"))
    )
    named = hits.select("doc_id", "row_key", "t", "window").distinct().join(known.where("item_id is not null").select("t", "window", "item_id"), ["t", "window"])
    listed = (
        named.select("doc_id", "row_key", "item_id").distinct().groupBy("doc_id", "row_key")
        .agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("ids"))
    )
    both = covered.join(listed, _same(covered, listed), "left").select(covered["*"], "n_items", "ids")
    docs = _keyed(documents).select("doc_id", "row_key", n_pieces(F.col("text"), BETWEEN).alias("n_words"))
    return docs.join(both, _same(docs, both), "left").select(
        docs["doc_id"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
