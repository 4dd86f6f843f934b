"""Documents to packed training sequences, stage by stage.

All stages but the last return the columns of documents, whatever else the table has beside doc_id, text and lang, and whatever
those columns are called.  Rows of equal doc_id, or without one, are rows like others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.llm import language, near_dups, packing, pii, repeats
from quietlog.llm.common import table
from quietlog.llm.queries import TOKENIZER
from quietlog.session import made_here, release, staged


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters, or that look like no language learned, go.

    A null or empty text has no letters.  Rows without lang or doc_id teach nothing; where no row teaches, no language is known and
    nothing is kept.  Texts are judged whole; repeated rows are judged alike.
    """
    known = docs.where(~language.held_out() & F.col("doc_id").isNotNull())
    model = language.fit(known)
    return language.accepted(docs, model, most=language.norms(known, model))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; repeated rows are duplicates.

    Documents without words, null or empty texts among them, are in no group and stay.
    """
    return near_dups.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that come earlier in the corpus; characters that lose a byte go whole.

    A null text stays null, an empty one empty; a null doc_id comes first; n_chars is the length of the new text.
    """
    return repeats.removed(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with placeholders for personal data; null stays null."""
    return pii.redacted(docs, pii.train(pii.labelled()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in sequences; a null text is empty and has the closing id alone."""
    return packing.packed(docs, TOKENIZER)


_left: list[str] = []


def tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, which first removes the working folders of the one before: its result has been written by then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left)
        with made_here(spark) as made:
            out = stage(spark, docs, sf_dir)
        _left[:] = made
        return out

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", tidy(identify)),
    ("near_dups", tidy(deduplicate)),
    ("suffix_dedup", tidy(cut_repeats)),
    ("pii", tidy(redact)),
    ("packing", tidy(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: the stages fit models and merge text, which SQL can't express; tests/llm compares them with brute force
ORACLE_SQL = None
