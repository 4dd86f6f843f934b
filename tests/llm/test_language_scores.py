"""Language scores against naive Bayes spelled out, n-gram by n-gram."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from quietlog.llm import language
from quietlog.llm.common import table
from quietlog.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def hashed(gram, bins):
    h = 0x9E3779B9 * len(gram) & 0xFFFFFFFF
    for c in gram:  # signed, of 64 bits
        h = ((h ^ ord(c)) * 0x85EBCA6B + (1 << 63)) % (1 << 64) - (1 << 63)
        h ^= h >> 15
    return h % bins


def grams(text, bins):
    """Bins of the n-grams of a text: one to three characters, in a word with one gap on either side."""
    folded = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    for word in folded.split():
        padded = f" {word} "
        for n in language.ORDERS:
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram.strip() and (n > 1 or gram != " ") and " " not in gram[1:-1]:
                    yield hashed(gram, bins)


@pytest.fixture(scope="module")
def plain(spark):
    docs = [r for r in table(spark, SF, "documents").select("doc_id", "text", "lang").collect()]
    learned = [r for r in docs if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    count, n = defaultdict(Counter), Counter()
    for r in learned:
        count[r.lang].update(grams(r.text, language.BINS))
        n[r.lang] += 1
    return docs, count, n


def answer(text, count, n):
    found = list(grams(text or "", language.BINS))
    if not found:
        return "und", 0.0
    scores = {}
    for lang in sorted(n):
        total = sum(count[lang].values()) + 0.5 * language.BINS
        scores[lang] = math.log(n[lang] / sum(n.values())) + sum(math.log((count[lang][g] + 0.5) / total) for g in found)
    best = max(scores, key=scores.get)
    return best, 1 / sum(math.exp(s - scores[best]) for s in scores.values())


def test_query_equals_naive_bayes(spark, plain):
    docs, count, n = plain
    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        lang, score = answer(r.text, count, n)
        mine = got[r.doc_id]
        assert mine.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert mine.lang_pred == lang and math.isclose(mine.score, score, rel_tol=1e-9, abs_tol=1e-12), r.doc_id


def test_odd_texts(spark, plain):
    _, count, n = plain
    odd = [None, "", "  ", "1 2 3!", "a", "É", "ß ẞ İ ı", "zu", "the\n\nthe", "x" * 5000, "漢字 かな", "a1b2c3", "\U0001f600 ok"]
    known = table(spark, SF, "documents").where(~language.held_out())
    model = language.fit(known)
    for text, lang, score in zip(odd, *language.score(odd, model), strict=True):
        want = answer(text, count, n)
        assert lang == want[0] and math.isclose(score, want[1], rel_tol=1e-9, abs_tol=1e-12), text
