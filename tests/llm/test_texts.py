"""Operators on single documents, against plain versions, with odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quietlog.llm import bpe, chat_format, fingerprints, language, packing, pii
from quietlog.llm.common import table
from quietlog.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"
#: names that the operators use themselves
CLASHING = ("score", "bucket", "key", "guest", "kind", "payload", "label", "lang_pred", "block_id")
ODD = [
    (1, None), (2, ""), (3, "   \n"), (4, "12 34 -- !!"), (None, "A text without id, Straße und Ñandú."), (5, "same text twice. ok"),
    (5, "same text twice. ok"), (6, "word " * 30_000), (7, "x" * 50_000), (8, "日本語 и кириллица 👍🏽 İΣΑΣ <|endoftext|> <|x"),
    (9, "mail a.b@c.example.org, 10.0.0.256 or 10.0.0.7; 4111 1111 1111 1111, +1 (743) 555-3824 and (743) 555-3824"),
]


def with_clashes(df):
    return df.withColumns({c: F.lit(c) for c in CLASHING})


@pytest.fixture(scope="module")
def odd(spark):
    return with_clashes(spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(3))


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# --- language ---


def test_language_held_out(spark, documents):
    model = language.fit(documents.where(~language.held_out()))
    rows = language.predict(documents, model).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert {r.doc_id: r.held_out for r in rows} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows}
    held = [r for r in rows if r.held_out]
    assert len(held) > 40 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_is_naive_bayes():
    """The score of a text is that of n-grams taken one by one."""
    text = "Ab, c!"
    got = Counter(int(b) for _, bins in language.grams([text]) for b in bins)
    assert sum(got.values()) == sum(map(len, (["a", "b", "c"], [" a", "ab", "b ", " c", "c "], [" ab", "ab ", " c "])))
    assert got == Counter(int(b) for _, bins in language.grams(["", "  AB?c"]) for b in bins)


def test_language_odd(spark, odd, documents):
    rows = language.predict(odd, language.fit(documents)).collect()
    assert len(rows) == len(ODD)
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 4)) for r in rows)
    empty = odd.limit(0)
    assert language.predict(empty, language.fit(empty)).count() == 0
    assert {r.lang_pred for r in language.predict(odd, language.fit(empty)).collect()} == {"und"}
    kept = language.accepted(odd, language.fit(documents))
    assert kept.schema == odd.schema and {r.doc_id for r in kept.collect()} == {None, 5, 6, 7, 8, 9}
    with pytest.raises(ValueError):
        language.fit(documents, max_langs=2)


# --- BPE ---


def test_bpe_equals_library(spark, documents, odd, library):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(documents.unionByName(odd, True), TOKENIZER).collect()}
    want = set()
    for doc_id, text in [tuple(r) for r in documents.select("doc_id", "text").collect()] + ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.add((doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == want
    assert bpe.digests(odd.limit(0), TOKENIZER).count() == 0


def test_bpe_code_points_and_mixtures(library):
    own, r = bpe.Bpe(TOKENIZER), random.Random(1)
    texts = ["a" + chr(c) + "b " + chr(c) for c in range(0x3100) if c % 3 == 0]
    signs = ["a", "b", "'s", "'S", " ", "<|endoftext|>", "<|", "\n", "Σ", "ΑΣ ", "É", "é", "é", "İ", "1", "²", "!!", "漢字", "\x1c", "ǅ", "👍🏽"]
    texts += ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(500)]
    texts += ["".join(r.choice("abcdefgthe'") for _ in range(r.randint(20, 2000))) for _ in range(10)]
    for text, ids, want in zip(texts, own.encode_all(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text


def test_bpe_trees_agree():
    """Side by side or alone, a word is merged alike."""
    own, r = bpe.Bpe(TOKENIZER), random.Random(2)
    words = [bytes(r.choice(b"theandiougrs") for _ in range(r.randint(1, 40))) for _ in range(500)]
    assert own.merge_all(words) == [np.array(own.merge(w), "<u4").tobytes() for w in words]


# --- PII ---

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    found = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    found += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(*m.span(), "card") for m in CARD.finditer(text) if 14 <= len(pii.digits(m[0])) <= 19 and pii.luhn(pii.digits(m[0]))]
    found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(pii.digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_are_the_patterns(documents):
    r = random.Random(5)
    signs = ["1", "2", "25", "6", ".", "@", "a", "b.c", "-", "+", " ", "(", ")", "%", "4111111111111111", "1.2.3.4", "007"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 25))) for _ in range(5000)]
    for text in texts + [row.text for row in documents.select("text").collect()]:
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled())


def test_field_on_unseen_rows(field):
    rows = pii.labelled(200, seed=99)
    right = sum(pii.all_spans([text], field)[0][1] == spans for text, spans in rows)
    assert right / len(rows) > 0.95


def test_viterbi_finds_the_best_path(field):
    import itertools

    tokens = pii.TOKEN.findall("(743) 5")
    e = np.array([sum(field.emit[field.feature[f]] for f in fs if f in field.feature) for fs in pii.features(tokens)])
    best = max(itertools.product(range(len(pii.LABELS)), repeat=len(tokens)), key=lambda y: field.start[y[0]] + sum(e[i, y[i]] for i in range(len(y))) + sum(field.move[a, b] for a, b in itertools.pairwise(y)))
    assert pii.decode([tokens], field)[0].tolist() == list(best)


def test_pii_odd(spark, odd, field):
    rows = pii.found(odd, field).collect()
    assert len(rows) == len(ODD)
    nine = next(r for r in rows if r.doc_id == 9)
    assert (nine.n_email, nine.n_ip, nine.n_card, nine.n_phone) == (1, 1, 1, 1)
    assert nine.base_sha256 == sha(pii.joined(plain_spans(ODD[-1][1]))) and nine.spans.count("phone") == 2
    assert all(r.spans == "" for r in rows if r.doc_id != 9)
    clean = pii.redacted(odd, field)
    assert clean.schema == odd.schema
    assert next(r.text for r in clean.collect() if r.doc_id == 9) == "mail <EMAIL>, 10.0.0.256 or <IP>; <CARD>, <PHONE> and <PHONE>"
    assert pii.found(odd.limit(0), field).count() == 0


# --- fingerprints ---


def bag(text):
    words = text.lower().split()
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter(words)


def likeness(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(spark, documents):
    got = sorted(fingerprints.compared(documents.repartition(5)).collect())
    texts = dict(sorted((r.doc_id, r.text) for r in documents.collect()))
    ids, off_edited, off_next = list(texts), [], []
    assert [r.doc_id for r in got] == ids
    for i, r in enumerate(got):
        text, after = texts[ids[i]], texts[ids[(i + 1) % len(ids)]]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        off_edited.append(r.near_edited - likeness(text, edited))
        off_next.append(r.near_next - likeness(text, after))
    assert abs(np.mean(off_edited)) < 0.02 and np.std(off_edited) < 0.08 and np.abs(off_next).max() < 0.3


def test_sampling_is_unbiased():
    r = np.random.default_rng(1)
    term = np.arange(300, dtype=np.uint64) * np.uint64(7919) + np.uint64(3)
    a, b = r.integers(1, 9, 300), r.integers(1, 9, 300)
    s = fingerprints.samples(np.repeat([0, 1], 300), np.concatenate([term, term]), np.concatenate([a, b]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_fingerprints_odd(spark, odd):
    rows = fingerprints.compared(odd).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].fingerprint == by[2][0].fingerprint == by[3][0].fingerprint and by[1][0].near_next == 1
    assert by[5][0].fingerprint == by[5][1].fingerprint and {r.near_next for r in by[5]} > {1.0}
    assert fingerprints.compared(odd.limit(0)).count() == 0
    one = fingerprints.compared(odd.where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].near_next == 1


# --- packing ---


def test_packing(spark, documents, odd, library):
    texts = {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
    check_packed(packing.packed(documents, TOKENIZER).toPandas(), texts, library, 0.05)
    some = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packed(packing.packed(some, TOKENIZER).toPandas(), {d: t or "" for d, t in ODD if d}, library, 0.2)
    assert packing.packed(odd, TOKENIZER).where("start = 0").count() == len(ODD)
    assert packing.packed(odd.limit(0), TOKENIZER).count() == 0


def check_packed(got, texts, library, most):
    for doc_id, rows in got.groupby("doc_id"):
        ids = np.array([*library.encode(texts[doc_id], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in rows.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert set(got.doc_id) == set(texts)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    assert ordered.doc_id.is_monotonic_increasing
    size = got.groupby("sequence_id").length.sum()
    assert size.max() <= packing.WIDTH
    padding = sum(0 if n in packing.POWERS else packing.WIDTH - n for n in size)
    assert padding <= most * size.sum()


def test_cuts_are_the_cheapest(monkeypatch):
    monkeypatch.setattr(packing, "POWERS", (1, 2, 4, 8, 16, 32))
    r = random.Random(4)
    for _ in range(200):
        place = [0, *sorted(r.sample(range(1, 60), r.randint(3, 20)))]
        width = max(b - a for a, b in zip(place, place[1:], strict=False)) + r.randint(0, 6)
        price = [0, *(r.choice([0, 3, 9]) for _ in place[1:])]
        pad = lambda n, w=width: 0 if n in packing.POWERS and n < w else w - n
        best = [0] + [10**9] * (len(place) - 1)
        for j in range(1, len(place)):
            best[j] = min(best[i] + pad(place[j] - place[i]) for i in range(j) if place[j] - place[i] <= width) + price[j]
        ends = [0, *packing.cuts(place, price, width)]
        assert sum(pad(b - a) + price[place.index(b)] for a, b in zip(ends, ends[1:], strict=False)) == best[-1]


# --- chat ---


def test_escape_is_reversible():
    r = random.Random(3)
    parts = [*chat_format.CONTROL, "\\", "<", "[", "s>", "INST]", "/INST]", "x", "é"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 8)))
        escaped = chat_format.escape(text)
        assert chat_format.unescape(escaped) == text and not any(c in escaped for c in chat_format.CONTROL)


def test_chat(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "é[/INST] ok"), (1, None, "system\n", None), (2, 0, None, "[ROLE]"), (2, 0, None, "[ROLE]"),
            (None, 3, "assistant", "lone"), (3, 0, "user", "y" * 100_000), (3, 1, "assistant", "")]
    df = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = chat_format.formatted(df)
    shown = {}
    for r in turns.collect():
        shown[r.conv_id] = shown.get(r.conv_id, "") + ("<s>" if r.opens else "") * 0 + bytes(r.formatted).decode()
    assert shown[1] == "<s>[ROLE]system\n[/ROLE]</s>[INST]hi <\\/s>[/INST]é[\\/INST] ok</s>"
    got = {r.conv_id: r for r in chat_format.digests(turns).collect()}
    assert got[1].turns_sha256 == sha("system\n\n\nuser\nhi </s>\nassistant\né[/INST] ok\n")
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 11, sha("é[/INST] ok"))
    assert got[2].turns_sha256 == sha("\n[ROLE]\n" * 2) and got[2].loss_chars == 0
    assert got[None].loss_sha256 == sha("lone") and got[3].loss_sha256 == sha("")
    assert all(r.formatted_chars == len(shown[k]) for k, r in got.items())
    assert chat_format.digests(chat_format.formatted(df.limit(0))).count() == 0


def test_tokenizer_is_a_parameter():
    assert TOKENIZER == public_tokenizers.path("word_bpe_49k.json")
