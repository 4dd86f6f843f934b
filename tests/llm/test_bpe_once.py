"""A batch's pieces are looked up and merged once each, and the answers are those of the library."""

import random

import numpy as np

from quietlog.llm import bpe
from quietlog.llm.queries import TOKENIZER


class Counted(dict):
    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


def test_a_piece_is_looked_up_once_a_batch():
    one = bpe.Bpe(TOKENIZER)
    one.memo = Counted()
    texts = ["the cat sat. " * 500, "a cat, the cat " * 500, ""]
    want = [e.ids for e in one.library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        one.memo.asked = 0
        assert [np.frombuffer(x, "<u4").tolist() for x in one.encode_all(texts)] == want
        assert one.memo.asked <= 10  # five different pieces


def test_white_space_ends_pieces_as_split_does():
    one = bpe.Bpe(TOKENIZER)
    usual = [c for c in map(chr, range(0xD800)) if not one.odd.search(c)]
    spaces = [c for c in usual if c.isspace()]
    assert "\x00" not in usual and set(spaces) == set("\t\n\v\f\r \x85\xa0")
    r = random.Random(3)
    signs = [*spaces, "the", "é", "İ", "Σ", "ж", "漢", "한", "…", "’s", "'s", "x1", "\x7f", "\x9f", "\x00", "\x1c", "<|endoftext|>"]
    texts = ["".join(r.choices(signs[: r.choice([10, 19, len(signs)])], k=r.randint(0, 40))) for _ in range(400)]
    want = [e.ids for e in one.library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in one.encode_all(texts)] == want


def test_ranks_are_those_of_the_file():
    one = bpe.Bpe(TOKENIZER)
    a, b = (np.array(x) for x in zip(*one.rank, strict=True))
    assert one._rank_of(a, b).tolist() == list(one.rank.values())
    other = np.random.default_rng(1).integers(-1, 49_406, (2, 20_000))
    assert one._rank_of(*other).tolist() == [one.rank.get(p, bpe.NO) for p in zip(*other.tolist(), strict=True)]
