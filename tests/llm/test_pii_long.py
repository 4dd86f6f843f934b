"""Personal data in stretches of thousands of tokens."""

import random
import time

import numpy as np
import pytest

from quietlog.llm import pii


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled())


@pytest.mark.parametrize("shift", range(12))
def test_spans_over_every_cut(field, shift):
    """A list of phones without plus, moved on so that each place of a span comes to lie at a block's end."""
    numbers = [f"({200 + i % 700}) 555-{1000 + i % 9000}" for i in range(600)]
    text = "1 " * shift + "call " + " now call ".join(numbers) + " now"
    spans = pii.all_spans([text], field)[0][1]
    assert [text[a:b] for a, b, kind in spans if kind == "phone"] == numbers
    assert "555" not in pii.replaced(text, spans)
    assert len(pii.stretches(text)[0][1]) > 20 * pii.LONGEST


def test_blocks_are_as_one(field, monkeypatch):
    """Long sequences, some of them together, get the labels of one pass over all tokens."""
    r = random.Random(5)
    make = [t for t, _ in pii.labelled(300, seed=11)]
    sequences = [pii.TOKEN.findall(" ".join(r.choice(make) for _ in range(n))) for n in (1, 2, 40, 3, 300, 7, 41)]
    monkeypatch.setattr(pii, "LONGEST", 10**6)
    want = pii.decode(sequences, field)
    for longest in (5, 64, 256):
        monkeypatch.setattr(pii, "LONGEST", longest)
        assert all(np.array_equal(a, b) for a, b in zip(pii.decode(sequences, field), want, strict=True))


def test_long_lists_take_linear_time(field):
    text = "\n".join(f"+1 (743) 555-{i:04d}, (743) 555-{i:04d}" for i in range(4000))
    began = time.process_time()
    base, spans = pii.all_spans([text], field)[0]
    assert len(base) == 4000 and len(spans) > 4000 and time.process_time() - began < 60
