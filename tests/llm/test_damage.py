"""Stages leave clean text alone: whole characters around removed runs, and numbers that are no personal data."""

import random
from collections import Counter

import numpy as np
import pytest

from quietlog.llm import fingerprints, pii, repeats

KIND = "doc_id long, text string, n_chars long"


@pytest.mark.parametrize("letters", ["潠儽愽漢字仮名", "жщюяЖЩЮЯ", "😀😁🎉👍", "aé漢😀"])
def test_removed_runs_leave_no_halves(spark, letters):
    rng = random.Random(2)
    run = "".join(rng.choice(letters) for _ in range(90))
    texts = [f"{rng.choice(letters)}{i}{rng.choice(letters)}{run}{rng.choice(letters)}{i}x" for i in range(40)] + ["w潠" + "x" * 150 + "儽y", "w2潠" + "x" * 150 + "儽y2"]
    rows = [(i, t, len(t)) for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in repeats.removed(spark.createDataFrame(rows, KIND)).collect()}
    for i, t, _ in rows:
        left = out[i].text
        assert out[i].n_chars == len(left) and not Counter(left) - Counter(t)
        at = 0
        for c in left:  # in order, too
            at = t.index(c, at) + 1
    assert sum(len(r.text) for r in out.values()) < sum(map(len, texts)) / 2


def test_whole_characters():
    data = np.frombuffer("aé漢😀b".encode(), np.uint8)
    for k in range(len(data)):
        gone = np.zeros(len(data), bool)
        gone[k] = True
        wide = repeats.whole_characters(data, gone)
        assert data[~wide].tobytes().decode() == "".join(c for i, c in enumerate("aé漢😀b") if i != [0, 1, 1, 2, 2, 2, 3, 3, 3, 3, 4][k])
    assert len(repeats.whole_characters(data[:0], np.zeros(0, bool))) == 0


CLEAN = [
    "version 0.11.5 is out", "see section 7.39.9 below", "release 12.4.187 of the host", "server 4.19.0 is old", "chapter 1.2.3", "from 10.2.11:",
    "her number 123-45-6789 is filed", "on 2024-11-23 14:05:59 we met", "2023-01-02 03:04:05", "ISBN 978-3-16-148410-0 here", "isbn 9783161484100.",
    "call 111-111-1111 now", "meet at noon. we go", "look at the host", "at example we met", "1.2 at 3.4",
]


def test_harmless_numbers_stay():
    field = pii.train(pii.labelled())
    for text, (_, spans) in zip(CLEAN, pii.all_spans(CLEAN, field), strict=True):
        assert not [s for s in spans if s[2] in ("ip", "phone")], text


@pytest.mark.parametrize("kind,text,ok", [
    ("ip", "10.0.0.1", True), ("ip", "10 . 0 . 0 . 1", True), ("ip", "10 dot 0 dot 0 dot 1", True), ("ip", "10.0.1", False), ("ip", "10.0.0.256", False), ("ip", "1.2.3.4.5", False),
    ("phone", "123-45-6789", False), ("phone", "415-555-0134", True), ("phone", "0171 2345678", True), ("phone", "978-3-16-148410-0", False),
])
def test_checks(kind, text, ok):
    assert pii.passes(kind, text) is ok


def test_spelled_addresses_are_decoded():
    found = pii.stretches("please write john at example.org soon")
    assert any("example" in tokens and "john" in tokens for _, tokens in found)
    assert pii.stretches("we looked at the house and left") == []


def test_shared_terms_are_sampled_as_alone():
    """The samples of documents do not depend on what they are sampled with."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.choice([0, 1, 2, 50, 400]))) for _ in range(60)]
    both = fingerprints.fingerprints(texts)
    assert all((fingerprints.fingerprints([t])[0] == both[i]).all() for i, t in enumerate(texts))
