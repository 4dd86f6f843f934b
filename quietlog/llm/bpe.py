"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A text is cut at special tokens, normalised and split into words as the tokenizer file says; each word's bytes are
merged: the tree's root holds the lowest rank and, among equals, the leftmost pair; a merge changes three leaves, each
in logarithmic time; it ends when no pair can be merged. Short words of a batch have their trees in the rows of numpy
matrices and take their steps together; long ones have a tree of their own. What stands between white space is
remembered in a bounded memo, and looked up there once for each batch, however often it comes.

A null text is empty and has no ids. Any text can be encoded, since all bytes are in the vocabulary. Rows are
independent: repeated rows and doc_ids get equal answers, other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from quietlog.llm.common import pieces, texts

VOCABULARY = "word_bpe_49k.json"
#: pieces between white space kept by each Python worker, at some 180 bytes each; then those go that have not come again
MEMO = 500_000
#: bytes up to which words are merged side by side, and how many words at a time, so that their trees stay in the cache
SHORT, ROWS = 32, 4096
NONE = 1 << 62
#: no pair in the hash table
EMPTY = np.iinfo(np.int64).min
#: in the trees of short words: bits below the rank for the leaf, and no pair
LEAF, NO = 8, np.iinfo(np.int32).max
#: bytes of text whose ids are held at a time, and characters that are looked up together, which take numpy some 25 times as many bytes
BATCH_BYTES, STEP = 4 << 20, 2 << 20
#: fixed values: ranges in which all Unicode versions agree on letters and digits; other text is split by the library
AGREED = "\\t-\\r -\u024f\u0391-\u03ff\u0410-\u044f\u2010-\u2027\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabularies of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


def gathered(ids: np.ndarray, start: np.ndarray, n: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n[w] ids from start[w] on for each w, one after another, and the end of each."""
    n = n[which]
    ends = np.cumsum(n)
    return ids[np.repeat(start[which] - (ends - n), n) + np.arange(n.sum())], ends


def strings(column: pa.Array) -> list[str]:
    """The values of a column without nulls; to_pylist takes ten times as long."""
    return column.to_numpy(zero_copy_only=False).tolist()


def steps(values: list[str], limit: int) -> Iterator[list[str]]:
    """The values in stretches of about `limit` characters, at least one value each."""
    ends, start = np.cumsum([len(v) for v in values], dtype=np.int64), 0
    while start < len(values):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield values[start:end]
        start = end


class Bpe:
    """A tokenizer of the kind: NFC, white space, lower case; split by pattern; byte letters; BPE with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.first = [vocab[c] for c in byte_letters()]
        self.last = [vocab[c + end] for c in byte_letters()]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        words = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.odd = re.compile(f"[^{AGREED}]")
        # the same pattern with its classes spelled out for Latin letters, which the standard library runs faster; both find line ends
        kinds = {k: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        spelled = words
        for k, letters in kinds.items():
            spelled = spelled.replace(f"[\\p{{{k}}}]", f"[{letters}]").replace(f"\\p{{{k}}}", letters)
        self.latin, self.beyond = re.compile(spelled + "|\n"), re.compile("[^\0-\u024f]")
        self.any = regex.compile(words + "|\n")
        self.library = Tokenizer.from_file(path)
        self.bytes = {c: b for b, c in enumerate(byte_letters())}
        self._hash()
        self.made_of = np.array(self.made, np.int32)
        self.first_of, self.last_of = np.array(self.first, np.int32), np.array(self.last, np.int32)
        one, two = np.repeat(self.first_of, 256), np.tile(np.arange(256), 256)
        #: ranks of the pairs of two bytes inside a word, and of those at its end
        self.inner, self.outer = self._rank_of(one, self.first_of[two]), self._rank_of(one, self.last_of[two])
        self._forget()

    def _forget(self) -> None:
        """The memo: the number of each piece; its ids are those from one end to the next."""
        self.memo: dict[str, int] = {}
        self.ids, self.ends, self.again = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, bool)

    def _thin(self) -> None:
        """Forgets the pieces that have not come again since they were learned or last kept, and all if the others fill half the memo."""
        kept, found, ids, ends = np.flatnonzero(self.again), list(self.memo), self.ids, self.ends
        self._forget()
        if len(kept) <= MEMO // 2:
            self.memo = {found[i]: k for k, i in enumerate(kept.tolist())}
            self.ids, ends = gathered(ids, ends[:-1], np.diff(ends), kept)
            self.ends, self.again = np.concatenate([[0], ends]), np.zeros(len(kept), bool)

    def _hash(self) -> None:
        """Ranks by pair in a hash table that is probed in steps of one slot."""
        left = np.array([a << 32 | b for a, b in self.rank], np.int64)
        rank = np.array(list(self.rank.values()), np.int32)
        bits = max(4 * len(left), 2).bit_length()
        self.shift, self.keys, self.ranks = np.uint64(64 - bits), np.full(1 << bits, EMPTY), np.full(1 << bits, NO, np.int32)
        slot = self._slot(left)
        while len(left):
            free = self.keys[slot] == EMPTY
            self.keys[slot[free]] = left[free]
            there = self.keys[slot] == left
            self.ranks[slot[there]] = rank[there]
            left, rank, slot = left[~there], rank[~there], (slot[~there] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids, NO for those that are not merged; an id of -1 is in no pair."""
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], np.int32(NO))
        left = np.flatnonzero((found != key) & (found != EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            found = self.keys[slot]
            hit = found == key[left]
            out[left[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found != EMPTY)
            left, slot = left[on], slot[on]
        return out

    def merge(self, word: bytes) -> list[int]:
        ids = [self.first[b] for b in word[:-1]]
        ids.append(self.last[word[-1]])
        n = len(ids)
        if n == 1:
            return ids
        rank, size = self.rank, 1 << (n - 2).bit_length()
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            r = rank.get((ids[i], ids[i + 1]))
            if r is not None:
                tree[size + i] = r << 32 | i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            i = size + leaf
            tree[i] = value
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low

        while tree[1] != NONE:
            i = tree[1] & 0xFFFFFFFF
            gone = after[i]
            ids[i] = self.made[tree[1] >> 32]
            right = after[i] = after[gone]
            ids[gone] = -1
            if gone < n - 1:
                put(gone, NONE)
            r = None
            if right < n:
                before[right] = i
                r = rank.get((ids[i], ids[right]))
            put(i, NONE if r is None else r << 32 | i)
            left = before[i]
            if left >= 0:
                r = rank.get((ids[left], ids[i]))
                put(left, NONE if r is None else r << 32 | left)
        return [x for x in ids if x >= 0]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        ids, start, n = self._merged(words)
        data = ids.astype("<u4").tobytes()
        return [data[4 * a : 4 * (a + k)] for a, k in zip(start.tolist(), n.tolist(), strict=True)]

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in some order, where those of each word start, and how many they are."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start, n, ids, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.empty(0, np.uint32)], 0
        for i in np.flatnonzero(size > SHORT).tolist():
            ids.append(np.array(self.merge(words[i]), np.uint32))
            start[i], n[i] = at, len(ids[-1])
            at += len(ids[-1])
        width = 2
        while width <= SHORT:
            these = np.flatnonzero((size <= width) & (size > (width // 2 if width > 2 else 0)))
            for k in range(0, len(these), ROWS):
                some = these[k : k + ROWS]
                flat, count = self._side_by_side([words[i] for i in some.tolist()], size[some], width)
                ids.append(flat)
                start[some], n[some] = at + np.cumsum(count) - count, count
                at += len(flat)
            width *= 2
        return np.concatenate(ids), start, n

    def _side_by_side(self, words: list[bytes], size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of at most `width` bytes (a power of two): their ids, and how many each has.

        Rows of ids, and of the places of neighbours, have one column more, which is no id; the place before the first is that of the row above.
        """
        count, col, over = len(words), np.arange(width), width + 1
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(count, width)
        last = np.arange(count), size - 1
        ids = np.full((count, over), -1, np.int32)
        ids[:, :-1] = np.where(col < size[:, None], self.first_of[raw], -1)
        ids[last] = self.last_of[raw[last]]
        tree = np.full((count, 2 * width), NO, np.int32)
        pair = raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]
        end = size[:, None] - 2
        rank = np.where(col[:-1] < end, self.inner[pair], np.where(col[:-1] == end, self.outer[pair], NO))
        tree[:, width:-1] = np.where(rank == NO, NO, rank << LEAF | col[:-1])
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.tile(np.minimum(np.arange(1, over + 1), width), (count, 1))
        after[last] = width
        before = np.tile(np.arange(-1, width), (count, 1))
        row = np.flatnonzero(tree[:, 1] != NO)
        tree, flat, after, before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        while len(row):
            top, base, root = tree[2 * width * row + 1], over * row, 2 * width * row
            i = (top & (1 << LEAF) - 1).astype(np.int64)
            here = base + i
            gone = after[here]
            right = after[base + gone]
            mine = self.made_of[top >> LEAF]
            flat[here], flat[base + gone] = mine, -1
            after[here], before[base + right] = right, i
            left = before[here]
            some = left >= 0
            leaf = np.concatenate([i, left[some]])
            rank = self._rank_of(np.concatenate([mine, flat[(base + left)[some]]]), np.concatenate([flat[base + right], mine[some]]))
            value = np.where(rank == NO, NO, rank << LEAF | leaf.astype(np.int32))
            root = np.concatenate([root, root[some], root])
            node = np.concatenate([leaf, gone]) + width
            tree[root + node] = np.concatenate([value, np.full(len(row), NO, np.int32)])
            for _ in range(width.bit_length() - 1):
                node >>= 1
                child = root + 2 * node
                tree[root + node] = np.minimum(tree[child], tree[child + 1])
            row = row[tree[2 * width * row + 1] != NO]
        kept = ids >= 0
        return ids[kept].astype(np.uint32), kept.sum(1)

    def _learn(self, new: list[str]) -> None:
        """Adds pieces, which are different and hold no white space, to the memo."""
        far = set(filter(self.beyond.search, new)) if self.beyond.search("".join(new)) else set()
        near = [p for p in new if p not in far] if far else new
        new = [*near, *far]
        found = self.latin.findall("\n".join([*near, ""])) + self.any.findall("\n".join([*far, ""]))
        coded = pa.array(found, pa.large_string()).dictionary_encode()
        words, code = strings(coded.dictionary), coded.indices.to_numpy()
        line = words.index("\n")
        words[line] = ""
        ids, ends = gathered(*self._merged([w.encode() for w in words]), code)
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends[code == line]])
        self.again = np.concatenate([self.again, np.zeros(len(new), bool)])

    def _numbers(self, found: list[str]) -> np.ndarray:
        """The numbers in the memo of different pieces, which are added if they are new."""
        out = np.fromiter(map(self.memo.get, found, repeat(-1)), np.int64, len(found))
        self.again[out[out >= 0]] = True
        if len(self.memo) + np.count_nonzero(out < 0) > MEMO:
            self._thin()
            out = np.fromiter(map(self.memo.get, found, repeat(-1)), np.int64, len(found))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [found[i] for i in missing.tolist()]
            self._learn(new)
            out[missing] = np.fromiter(map(self.memo.__getitem__, new), np.int64, len(new))
        return out

    def _plain(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens and odd letters (and so without a zero), one after another, and the end of each text's."""
        text = "\0".join([*values, ""])
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
            text = text.replace("\x85", " ").replace("\xa0", " ")  # the only white space in AGREED above ASCII
        raw = np.frombuffer(text.lower().encode(), np.uint8)
        inside = raw > 0x20
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        start, stop = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        offsets = np.concatenate([[0], np.cumsum(stop - start)])
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]
        coded = pa.Array.from_buffers(pa.large_string(), len(start), buffers).dictionary_encode()
        number = self._numbers(strings(coded.dictionary))
        ids, ends = gathered(self.ids, self.ends[number], self.ends[number + 1] - self.ends[number], coded.indices.to_numpy())
        return ids, np.concatenate([[0], ends])[np.searchsorted(start, np.flatnonzero(raw == 0))]

    def encode_all(self, values: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        return [ids for some in steps(values, STEP) for ids in self._encoded(some)]

    def _encoded(self, values: list[str]) -> list[bytes]:
        odd = ["<|" in v or self.odd.search(v) is not None for v in values]
        ids, ends = self._plain([v for v, o in zip(values, odd, strict=True) if not o])
        ids, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        plain = map(ids.__getitem__, map(slice, [0, *ends], ends))
        return [self._odd(v) if o else next(plain) for v, o in zip(values, odd, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def _odd(self, text: str) -> bytes:
        """Text with special tokens, or with letters that are new to some Unicode version: split by the library."""
        out = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                out += self.merge_all([bytes(map(self.bytes.__getitem__, w)) for w, _ in words])
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens in sequence, special ones as well; the tokenizer file names no decoder, so spaces stand between."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text; path: the tokenizer file, on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in pieces(batches, "text", BATCH_BYTES):
            ids = bpe.encode_all(batch.column("text").to_pylist())
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
