"""The memo of words, windows of exact lengths, and memory of workers."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from quietlog.llm import bpe, language, packing
from quietlog.llm.queries import TOKENIZER


def test_a_memo_that_starts_anew_changes_nothing(monkeypatch):
    rng = random.Random(5)
    words = ["plain", "don't", "x2y", "über", "12,5", "end.", "ſ", "<|", "Σας", "tab\there"] + ["w" * n for n in range(1, 70)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(60)] + ["", " \n"]
    one = bpe.Bpe(TOKENIZER)
    want = [b"".join(i.to_bytes(4, "little") for i in one.library.encode(t, add_special_tokens=False).ids) for t in texts]
    monkeypatch.setattr(bpe, "MEMO", 9)
    assert [x for k in range(0, len(texts), 4) for x in one.encode_all(texts[k : k + 4])] == want
    assert one.encode_all(texts) == want and one.encode_all([]) == []


def test_exact_windows_are_found():
    rng = random.Random(6)
    for width in (1, 2, 8, 100, 4096):
        place = [0, *sorted(rng.sample(range(1, 9000), 700))]
        found, upto = packing._exact(np.array(place), width)
        powers = [p for p in packing.POWERS if p < width]
        at = {p: i for i, p in enumerate(place)}
        assert [found[a:b] for a, b in zip(upto, upto[1:], strict=False)] == [[at[p - w] for w in powers if p - w in at] for p in place]


def test_language_tasks_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(language, "give_back", lambda: calls.append(1), raising=False)
    session = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
    docs = SimpleNamespace(schema=None, sparkSession=session, mapInArrow=lambda run, schema: run)
    run = language.accepted(docs, language.Model(("en",), np.zeros((language.BINS, 1)), np.zeros(1), np.zeros(1)))
    batch = pa.record_batch({"doc_id": [1, 2, 3], "text": ["some words", None, "12"]})
    assert [r["doc_id"] for b in run(iter([batch])) for r in b.to_pylist()] == [1]
    assert calls
