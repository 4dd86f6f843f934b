"""Personal data in text: fixed patterns, and a linear-chain conditional random field for what they miss.

Base spans are the fixed patterns' matches that pass their checks; they always stay. The field labels tokens (letter
runs, digit runs, white space, single signs) with begin or inside of a kind, or nothing, from features of token shapes
around them; it is trained by gradient on a small labelled table and decoded by Viterbi, all sequences of a batch side
by side in numpy; long ones in blocks, with scores carried over from block to block. A label other than nothing is possible only within `REACH` words of a digit or an at sign, so only
these stretches are decoded. Found spans that touch no base span and pass their kind's check are added.

Null text is empty and has no spans. Rows are independent: repeated rows and doc_ids get equal answers; other columns
are not read. Texts are looked at whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quietlog.llm.common import pieces, texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# fixed patterns of the base spans; guards in front keep a search from starting again inside a run that has failed
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns by start, then kind."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:  # an email has one at sign, and starts where the run before it does
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if any_digit(text):
        found += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split(".") if len(p) < 9) and max(map(len, (p.lstrip("0") for p in m[0].split(".")))) <= 3]
        found += [(*m.span(), "card") for m in CARD.finditer(text) if len(m[0]) > 13 and 14 <= len(n := digits(m[0])) <= 19 and luhn(n)]
        if "+" in text:
            found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_DIGIT = re.compile("[0-9]")


def any_digit(text: str) -> bool:
    return _DIGIT.search(text) is not None


# --- the field ---------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
#: digits, at signs, and "at" before what looks like a host
NEAR = re.compile(r"[0-9@]+|\bat\b(?=\s+[\w-]+(?:\.|\s+dot\s+)\w)")
REACH = 3
#: tokens of a block; longer stretches are decoded in several, as if in one
LONGEST = 256
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
CUES = frozenset("tel phone call mobile fax telephone téléphone appelez telefon anruf teléfono llame email mail card visa ip host server at dot".split())


class Field(NamedTuple):
    feature: dict[str, int]
    #: features x labels; labels x labels; labels
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray


def shape(token: str) -> str:
    if token[0].isdigit():
        return f"d{min(len(token), 9)}"
    if token.isspace():
        return "s" if len(token) == 1 else "S"
    if token.isalpha():
        return f"w:{token.lower()}" if token.lower() in CUES else ("X" if token[0].isupper() else "x")
    return token


def features(tokens: list[str]) -> list[list[str]]:
    s = ["<<", "<<", "<", *map(shape, tokens), ">", ">>", ">>"]
    out = []
    for i in range(3, len(s) - 3):
        a, b, c, d, e = s[i - 2 : i + 3]
        out.append([f"0{c}", f"-{b}", f"+{d}", f"={a}", f"#{e}", f"<{b}|{c}", f">{c}|{d}", f"({a}|{b}|{c}", f"){c}|{d}|{e}", f"~{b}|{c}|{d}", f"l{s[i - 3]}|{a}|{b}", f"r{d}|{e}|{s[i + 3]}"])
    return out


def stretches(text: str) -> list[tuple[int, list[str]]]:
    """Offset and tokens of what lies within REACH words of a digit, an at sign, or "at" and a host."""
    zones: list[list[int]] = []
    for m in NEAR.finditer(text):
        a, b = m.span()
        if zones and b + 64 * REACH <= zones[-1][1]:
            continue
        for _ in range(REACH + 1):  # the rest of its own word, then others; long words are cut
            a = text.rfind(" ", max(0, a - 65), max(0, a - 1)) + 1 or max(0, a - 65)
            end = text.find(" ", b + 1, b + 65)
            b = end if end >= 0 else min(len(text), b + 64)
        if zones and a <= zones[-1][1]:
            zones[-1][1] = max(b, zones[-1][1])
        else:
            zones.append([a, b])
    return [(a, TOKEN.findall(text[a:b])) for a, b in zones]


def _padded(found: list[list[list[int]]], width: int, nothing: int) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(f) for f in found])
    ids = np.full((len(found), length.max(), width), nothing)
    for i, f in enumerate(found):
        ids[i, : len(f)] = f
    return ids, length


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def train(rows: list[tuple[str, list[Span]]], rounds: int = 100, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood by gradient ascent (Adam) over all rows at once."""
    feature: dict[str, int] = {}
    found, gold = [], []
    for text, spans in rows:
        tokens = TOKEN.findall(text)
        found.append([[feature.setdefault(f, len(feature)) for f in fs] for fs in features(tokens)])
        at, labels = 0, []
        for t in tokens:
            own = next((s for s in spans if s[0] <= at < s[1]), None)
            labels.append(0 if own is None else LABELS.index(("B-" if at == own[0] else "I-") + own[2]))
            at += len(t)
        gold.append(labels)
    n, L = len(feature), len(LABELS)
    ids, length = _padded(found, len(found[0][0]), n)
    N, T, _ = ids.shape
    y = np.zeros((N, T), int)
    for i, g in enumerate(gold):
        y[i, : len(g)] = g
    inside = np.arange(T) < length[:, None]
    params = [np.zeros((n + 1, L)), np.zeros((L, L)), np.zeros(L)]
    mean, power = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    true = np.zeros((N, T, L))
    true[np.arange(N)[:, None], np.arange(T), y] = inside
    pairs = inside[:, 1:]
    for step in range(1, rounds + 1):
        emit, move, start = params
        e = emit[ids].sum(2)
        fore, back = np.empty((N, T, L)), np.zeros((N, T, L))
        fore[:, 0] = start + e[:, 0]
        for t in range(1, T):
            new = _log_sum(fore[:, t - 1, :, None] + move, 1) + e[:, t]
            fore[:, t] = np.where(inside[:, t, None], new, fore[:, t - 1])
        for t in range(T - 2, -1, -1):
            new = _log_sum(move + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(inside[:, t + 1, None], new, back[:, t + 1])
        z = _log_sum(fore[:, -1], 1)
        p = np.exp(fore + back - z[:, None, None]) * inside[..., None]
        both = np.exp(fore[:, :-1, :, None] + move + (e[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        off = true - p
        grads = [np.zeros((n + 1, L)), np.zeros((L, L)), off[:, 0].sum(0)]
        for k in range(ids.shape[2]):
            np.add.at(grads[0], ids[:, :, k], off)
        np.add.at(grads[1], (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
        grads[1] -= both.sum((0, 1))
        for i, g in enumerate(grads):
            g = g / N - decay * params[i]
            mean[i] = 0.9 * mean[i] + 0.1 * g
            power[i] = 0.999 * power[i] + 0.001 * g * g
            params[i] = params[i] + rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(power[i] / (1 - 0.999**step)) + 1e-8)
        params[0][n] = 0
    return Field(feature, *params)


def decode(sequences: list[list[str]], field: Field) -> list[np.ndarray]:
    """Best labels of each token sequence, by Viterbi over all sequences of like length at once."""
    none = len(field.feature)
    out: list[np.ndarray] = [np.empty(0, int)] * len(sequences)
    long = [i for i, s in enumerate(sequences) if len(s) > LONGEST]
    for i, labels in zip(long, _decode_long([sequences[i] for i in long], field), strict=True):
        out[i] = labels
    order = sorted((i for i, s in enumerate(sequences) if 0 < len(s) <= LONGEST), key=lambda i: len(sequences[i]))
    for at in range(0, len(order), 256):
        part = order[at : at + 256]
        ids, length = _padded([[[field.feature.get(f, none) for f in fs] for fs in features(sequences[i])] for i in part], 12, none)
        e = field.emit[ids].sum(2)
        best, came = field.start + e[:, 0], []
        for t in range(1, e.shape[1]):
            step = best[:, :, None] + field.move
            came.append(step.argmax(1))
            best = np.where((t < length)[:, None], step.max(1) + e[:, t], best)
        last = best.argmax(1)
        labels = np.zeros(e.shape[:2], int)
        for t in range(e.shape[1] - 1, -1, -1):
            on = t < length
            labels[on, t] = last[on]
            if t:
                last = np.where(on, came[t - 1][np.arange(len(part)), last], last)
        for row, i in enumerate(part):
            out[i] = labels[row, : length[row]]
    return out


def _block_features(tokens: list[str], at: int) -> list[list[str]]:
    """Features of the LONGEST tokens from `at`, which look three tokens beyond the block."""
    low = max(0, at - 3)
    return features(tokens[low : at + LONGEST + 3])[at - low : at - low + LONGEST]


def _decode_long(sequences: list[list[str]], field: Field) -> list[np.ndarray]:
    """The same by blocks of LONGEST tokens, side by side, for sequences of any length.

    First the best score through each block from every label before it to every label at its end; these are chained to
    the scores before each block, from which it is decoded for every label at its end; the right one comes from behind.
    """
    none, L = len(field.feature), len(LABELS)
    blocks = [(i, at) for i, s in enumerate(sequences) for at in range(0, len(s), LONGEST)]
    done: list[tuple[np.ndarray, np.ndarray, int]] = []  # tokens x end label; label before by first label; best end label
    after = np.zeros(L)
    for g in range(0, len(blocks), 256):
        part = blocks[g : g + 256]
        ids, length = _padded([[[field.feature.get(f, none) for f in fs] for fs in _block_features(sequences[i], at)] for i, at in part], 12, none)
        e = field.emit[ids].sum(2)
        B, T, _ = e.shape
        enter = np.where(np.array([at == 0 for _, at in part])[:, None, None], field.start, field.move)
        through = enter + e[:, 0, None, :]
        for t in range(1, T):
            new = (through[:, :, :, None] + field.move).max(2) + e[:, t, None, :]
            through = np.where((t < length)[:, None, None], new, through)
        before, ends = np.zeros((B, L)), []
        for b, (_, at) in enumerate(part):
            if at:
                before[b] = after
            after = (before[b][:, None] + through[b]).max(0)
            after -= after.max()
            ends.append(int(after.argmax()))
        step = before[:, :, None] + enter
        entry, best, came = step.argmax(1), step.max(1) + e[:, 0], []
        for t in range(1, T):
            step = best[:, :, None] + field.move
            came.append(step.argmax(1))
            best = np.where((t < length)[:, None], step.max(1) + e[:, t], best)
        last, path = np.tile(np.arange(L), (B, 1)), np.zeros((B, T, L), np.int8)
        for t in range(T - 1, -1, -1):
            path[:, t] = last
            if t:
                last = np.where((t < length)[:, None], np.take_along_axis(came[t - 1], last, 1), last)
        done += [(path[b, : length[b]].copy(), entry[b], ends[b]) for b in range(B)]
    found: list[list[np.ndarray]] = [[] for _ in sequences]
    label = 0
    for (i, _), (path, entry, end) in zip(reversed(blocks), reversed(done), strict=True):
        found[i].append(path[:, label if found[i] else end])
        label = int(entry[found[i][-1][0]])
    return [np.concatenate(f[::-1]) for f in found]


#: four numbers with a dot, or the word, between them
FOUR_PARTS = re.compile(r"([0-9]{1,3})" + 3 * r"(?:\s*(?:\.|\[\.\]|\(\.\)|dot)\s*([0-9]{1,3}))")
#: numbers as long as a phone's that are none: social security numbers, dates with a time, ISBNs, runs of one digit
NO_PHONE = re.compile(r"\d{3}-\d{2}-\d{4}|\d{4}[-./]\d{1,2}[-./]\d{1,2}\D?[\d: .-]*|97[89][- ]?(?:\d[- ]?){9}\d|(\d)(?:\D?\1)+")


def passes(kind: str, text: str) -> bool:
    """Checks of added spans, looser than those of the patterns."""
    n = digits(text)
    if kind == "phone":
        return 9 <= len(n) <= 15 and not NO_PHONE.fullmatch(text)
    if kind == "card":
        return 14 <= len(n) <= 19 and luhn(n)
    if kind == "ip":
        parts = FOUR_PARTS.fullmatch(text)
        return parts is not None and all(int(x) <= 255 for x in parts.groups())
    return "@" in text or re.search(r"\bat\b", text) is not None


def all_spans(values: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(v) for v in values]
    where, sequences = [], []
    for i, v in enumerate(values):
        for offset, tokens in stretches(v):
            where.append((i, offset))
            sequences.append(tokens)
    more: list[list[Span]] = [[] for _ in values]
    starts = [[s[0] for s in b] for b in base]
    reach = [np.maximum.accumulate([s[1] for s in b]).tolist() if b else [] for b in base]
    for (i, at), tokens, labels in zip(where, sequences, decode(sequences, field), strict=True):
        if not labels.any():
            continue
        now: list | None = None
        for token, label in zip([*tokens, ""], [*labels.tolist(), 0], strict=True):
            name = LABELS[label]
            if now and not (name[0] == "I" and name[2:] == now[2]):
                a, b, kind = now
                n = bisect_left(starts[i], b)
                touched = n > 0 and a < reach[i][n - 1]
                if not touched and passes(kind, values[i][a:b]):
                    more[i].append((a, b, kind))
                now = None
            if name[0] == "B":
                now = [at, at, name[2:]]
            at += len(token)
            if now:
                now[1] = at
    key = lambda s: (s[0], KINDS.index(s[2]), s[1])
    return [(b, sorted(b + m, key=key)) for b, m in zip(base, more, strict=True)]


# --- the labelled table ------------------------------------------------------------------------------------------

#: texts around the data; {} is where they stand
FRAMES = {
    "phone": ("call {} now", "tel. {}", "Phone: {}", "appelez le {} demain", "Telefon {} bitte", "llame al {}.", "or {}, thanks", "the erand {} onthe of", "fax {}"),
    "email": ("mail {} today", "write to {}.", "Email: {}", "erand the.{} onthe", "contact {} or"),
    "ip": ("host {} is down", "from {}:", "server {}.", "the erand {} onthe"),
    "card": ("card {} was charged", "visa {}", "with {} erand the"),
    "": ("on {} we met", "the price is {} today", "version {} is out", "see page {}.", "token = \"{}\"", "in {}, the", "{} of them", "at {} hours", "id {} onthe", "lines {} to end"),
}


def labelled(n: int = 400, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """The small labelled table: frames in four languages around data of each kind, and around harmless numbers."""
    r = random.Random(seed)
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = "4" + number(14)
        raw = body + next(c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", " ", "-"])
        return sep.join(raw[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = str(r.randint(200, 989)), number(3), number(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+49 {a} {b}{c}", f"+33 {r.randint(1, 9)} {number(2)} {number(2)} {number(2)} {number(2)}", f"0{r.randint(1, 9)} {number(2)} {number(2)} {number(2)} {number(2)}"])

    def email() -> str:
        name, host = r.choice(["ann", "b.lee", "the.19", "jo_x"]), r.choice(["mail1.example.com", "example.org", "uni.test.edu"])
        return r.choice([f"{name}@{host}", f"{name} @ {host}", f"{name}@localhost"])

    def harmless() -> str:
        return r.choice([f"20{number(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{number(2)}.{number(1)}.{number(2)}", f"${number(3)}.{number(2)}", number(r.randint(1, 8)), number(r.randint(9, 24)), f"{number(2)}:{number(2)}", f"{number(3)},{number(3)}", f"{number(3)}-{number(3)}", f"{r.randrange(1 << 64):016x}", f"{number(4)}-{number(4)}", f"{number(1)}/{number(2)}", f"({number(3)})"])

    make = {"phone": phone, "email": email, "card": card, "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "": harmless}
    rows = []
    for _ in range(n):
        kind = r.choice(["phone", "phone", "email", "card", "ip", "", "", "", ""])
        before, after = r.choice(FRAMES[kind]).split("{}")
        data = make[kind]()
        rows.append((before + data + after, [(len(before), len(before) + len(data), kind)] if kind else []))
    return rows


# --- Spark -------------------------------------------------------------------------------------------------------


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def found(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, number of base spans by kind, digest of the base spans, and all spans, for every row."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    names = [x.split()[0] for x in schema.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            spans = all_spans(batch.column("text").to_pylist(), shared.value)
            counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in spans], pa.int64()) for kind in KINDS]
            base = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in spans], pa.string())
            yield pa.record_batch([batch.column("doc_id"), *counts, base, pa.array([joined(s) for _, s in spans], pa.string())], names)

    return texts(docs).mapInArrow(run, schema)


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """The rows with each span, or overlapping spans together, replaced by the first's kind in angle brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            values = batch.column("text").to_pylist()
            new = [None if v is None else replaced(v, s) for v, (_, s) in zip(values, all_spans([v or "" for v in values], shared.value), strict=True)]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array(new, batch.column("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in new]).cast(columns["n_chars"].type)
            yield pa.record_batch(columns)

    return docs.mapInArrow(run, docs.schema)


def replaced(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text
