"""What Python workers of the pipeline hold: bounded steps and memo, memory given back."""

import random
from types import SimpleNamespace
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa

from quietlog.llm import bpe, language, near_dups, packing
from quietlog.llm.queries import TOKENIZER


def _ids(one, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in one.library.encode_batch(texts, add_special_tokens=False)]


def test_packing_tasks_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(packing, "give_back", lambda: calls.append(1), raising=False)
    monkeypatch.setattr(packing, "texts", lambda docs: docs)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    docs = SimpleNamespace(mapInArrow=lambda run, schema: run)
    docs.repartitionByRange = docs.sortWithinPartitions = lambda *names: docs
    batch = pa.record_batch({"doc_id": pa.array([1, 2], pa.int64()), "text": ["some words. " * 900, ""]})
    rows = [r for b in packing.packed(docs, TOKENIZER)(iter([batch])) for r in b.to_pylist()]
    assert rows[0]["sequence_id"] == 3 << 32 and sum(r["length"] for r in rows) == rows[0]["doc_tokens"] + 1
    assert calls == [1]


def test_texts_are_looked_up_in_steps(monkeypatch):
    one, sizes = bpe.Bpe(TOKENIZER), []
    plain = one._plain
    monkeypatch.setattr(bpe, "STEP", 100, raising=False)
    monkeypatch.setattr(one, "_plain", lambda values: sizes.append(sum(map(len, values))) or plain(values))
    rng = random.Random(8)
    texts = ["".join(rng.choices(["a", "bc ", "é", "<|", ". ", "<|endoftext|>", "漢"], k=rng.randint(0, 30))) for _ in range(80)] + ["one " * 90, "", ""]
    assert one.encode_all(texts) == _ids(one, texts)
    assert len(sizes) > 5 and sorted(sizes)[-2] <= 100 < sorted(sizes)[-1]  # only the text that is longer by itself
    assert one.encode_all([]) == [] and one.encode_all([""]) == [b""]


def test_pieces_that_come_again_stay_in_the_memo(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 12)
    one, learned = bpe.Bpe(TOKENIZER), []
    learn = one._learn
    monkeypatch.setattr(one, "_learn", lambda new: learned.extend(new) or learn(new))
    texts = [f"often too w{k} x{k}, y{k}." for k in range(40)]
    assert [one.encode(t) for t in texts] == _ids(one, texts)
    assert learned.count("often") == learned.count("too") == 1 and len(learned) == 2 + 3 * len(texts)
    assert len(one.memo) <= 12 and len(one.memo) == len(one.again) == len(one.ends) - 1


def test_a_memo_of_frequent_pieces_alone_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 6)
    one = bpe.Bpe(TOKENIZER)
    texts = ["a b c d e", "a b c d e", "a b c d e f1 g1", "h1 i1 a", "a b c d e f1 g1 h1 i1 j1"] * 3
    assert [one.encode(t) for t in texts] == _ids(one, texts)


def test_languages_are_weighed_in_small_steps(monkeypatch):
    sizes, weighed = [], language.weighed
    monkeypatch.setattr(language, "weighed", lambda values, model: sizes.append(sum(len(v or "") for v in values)) or weighed(values, model))
    session = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
    docs = SimpleNamespace(schema=None, sparkSession=session, mapInArrow=lambda run, schema: run)
    run = language.accepted(docs, language.Model(("en",), np.zeros((language.BINS, 1)), np.zeros(1), np.zeros(1)))
    batch = pa.record_batch({"doc_id": list(range(12)), "text": ["some words " * 9_000] * 11 + ["12"]})
    assert [r["doc_id"] for b in run(iter([batch])) for r in b.to_pylist()] == list(range(11))
    assert sum(sizes) == 11 * 99_000 + 2 and max(sizes) <= 1 << 19


def test_near_duplicates_are_sketched_in_small_steps(monkeypatch):
    sizes, shingles = [], near_dups.shingles
    monkeypatch.setattr(near_dups, "shingles", lambda values: sizes.append(sum(map(len, values))) or shingles(values))
    monkeypatch.setattr(near_dups, "F", MagicMock())
    docs = SimpleNamespace(mapInArrow=lambda run, schema: run)
    docs.select = lambda *columns: docs
    text = "one two three four five six " * 7_000
    batch = pa.record_batch({"doc_id": pa.array(range(9), pa.int64()), "text": [text] * 8 + [""]})
    rows = [r for b in near_dups.sketches(docs)(iter([batch])) for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(9)) and rows[-1]["node"] is None
    assert all({**r, "doc_id": 0} == rows[0] for r in rows[:-1])
    assert sum(sizes) == 8 * len(text) and max(sizes) <= 1 << 20
