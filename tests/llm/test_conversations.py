"""Prefix trie and structure repair of conversations against plain versions, with odd input."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quietlog.llm import repair, trie, turns
from quietlog.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
KIND = "conv_id long, turn long, role string, text string"
CLASHING = ("place", "id", "words", "block", "node", "key", "level", "n", "h", "base", "chunk", "fault", "at", "copy", "damage", "_slice", "_tie")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    return df.withColumns({c: F.lit(c) for c in CLASHING})


# --- trie ---


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0), tie, (role, text)))
    own = {c: [t for *_, t in sorted(r, key=lambda x: x[:2])] for c, r in convs.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(set)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
    kids = defaultdict(set)
    for path in members:
        if path:
            kids[path[:-1]].add(path)

    def below(path):
        return [path, *itertools.chain.from_iterable(below(k) for k in kids[path])]

    def saved(path):
        return (len(members[path]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0

    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[b] for b in below(p)),
         sum(map(saved, below(p))), sha(",".join(str(c) for c in sorted(m) if len(made[c]) == len(p))))
        for p, m in list(members.items())
    )


def tree(spark, rows):
    return sorted(tuple(r) for r in trie.trie(*trie.rebuilt(trie.turn_rows(frame(spark, rows)))).collect())


def test_trie_of_random_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "a b", " c\td\n"])) for c in range(-45, 90) for t in range(rng.randint(1, 20))]
    assert tree(spark, rows) == plain_trie(rows)


def test_trie_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "LISTED", 4)
    monkeypatch.setattr(turns, "SPAN", 3)
    rows = [(None, 0, "user", "x"), (1, None, "user", "x"), (1, 0, None, None), (1, 0, "", ""), (1, 0, "", ""), (2, 5, "a", "b c"), (2, 5, "ab", " c"),
            (7, -3, "user", "w " * 50_000), (19, 0, "user", "x")]
    rows += [(20, t, "user", str(t // 2)) for t in range(70)] + [(c, t, "user", str(t // 2)) for c in (21, 22, 23, 39) for t in range(60 + c)]
    rows += [(1000 + c, 0, "user", "same") for c in range(40)]
    assert tree(spark, rows) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert tree(spark, []) == []


def test_trie_query(spark):
    got = QUERIES["op12_prefix_trie"](spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, got.collect())) == plain_trie(rows)


def test_sums_over_groups(spark, monkeypatch):
    monkeypatch.setattr(turns, "SPAN", 4)
    places = spark.createDataFrame([(k, i, 10 * i) for k in (None, 5) for i in range(23)], "k long, at long, v long")
    for r in turns.running(places, "k", "at", {"before": "v"}).collect():
        assert r.before == 10 * r.at * (r.at - 1) // 2


# --- repair ---

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(tokens):
    """Least (cost, audit, output) by trying edits in order, state by state."""
    def grown(best):
        for _ in range(4):
            for p in list(best):
                q, role = (3, "assistant") if p == 2 else (2, "user")
                c, a, o = best[p]
                best[q] = min(best.get(q, (1e9,)), (c + 2, a + "I", (*o, f"{role}:")))
        return best

    best = grown({0: (0, "", ())})
    for role, text, fault in tokens:
        nxt = {}

        def put(q, x, nxt=nxt):
            nxt[q] = min(nxt.get(q, (1e9,)), x)

        for p, (c, a, o) in best.items():
            put(p, (c + 3, a + "D", o))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            q, new = (3, "assistant") if p == 2 else (2, "user")
            put(q, (c + 2 + more, a + "R", (*o, f"{new}:{text}")))
            if (p, role[:1]) in STEP:
                put(STEP[p, role[:1]], (c + more, a + "K", (*o, f"{role}:{text}")))
        best = grown(nxt)
    return min(best[q] for q in (0, 3) if q in best)


def plain_repair(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            convs[c] += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    out = []
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, tokens = set(), []
        for _, role, text in own:
            stripped = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "" if stripped[-1] in ".!?" else "truncated"
            seen.add((role, text))
            tokens.append((role, text, fault))
        given = [t for t, *_ in own if t is not None]
        gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
        initials = [role[:1] or " " for _, role, _ in own]
        cost, audit, lines = cheapest(tokens)
        n = [sum(t[2] == f for t in tokens) for f in ("blank", "duplicate", "truncated")]
        out.append((c, gaps, *n, sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


def mended(spark, rows):
    return sorted((tuple(r) for r in repair.repair(frame(spark, rows)).collect()), key=repr)


def test_repair_of_random_conversations(spark):
    rng = random.Random(5)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "support"], ["a.", "b", "c! ", " ", "", None, "d?\n", "e.", "f.", "g."]
    rows = [(c, t, rng.choice(roles[: rng.choice([3, 7])]), rng.choice(texts) if t % 3 else f"{t}.") for c in range(150) for t in range(rng.randint(1, 14))]
    assert mended(spark, rows) == plain_repair(rows)


def test_repair_of_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "x."), (None, 3, "user", "x."), (1, None, "assistant", "q"), (1, None, None, "q."), (1, 9, "user", "é" * 300_000 + "."),
            (2, -4, "user", "x"), (2, 40, "assistant", "y.\x0b"), (2, 40, "assistant", "y. ")]
    gone = next(t for t in range(1000) if zlib.crc32(f"77:{t}".encode()) % 20 == 0)
    assert mended(spark, [*rows, (77, gone, "user", "x.")]) == plain_repair([*rows, (77, gone, "user", "x.")])
    assert mended(spark, []) == []


def test_repair_of_long_conversations(spark, monkeypatch):
    """More storeys than one: chunks of eight turns, eight by eight of them."""
    rng = random.Random(6)
    monkeypatch.setattr(repair, "CHUNK", 8)
    monkeypatch.setattr(repair, "CHART", 3)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{t}."])) for c, n in ((5, 700), (6, 72), (7, 73), (8, 3)) for t in range(n)]
    assert mended(spark, rows) == plain_repair(rows)


def test_cells_do_not_depend_on_brackets():
    rng = random.Random(8)
    for _ in range(200):
        kinds = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(1, 30)))
        at = rng.randint(0, len(kinds))
        whole = repair.parsed(kinds)
        if 0 < at < len(kinds):
            assert repair.product(repair.parsed(kinds[:at]), repair.parsed(kinds[at:])) == whole
        cells = [repair.short(k) for k in kinds]
        for q in repair.ACCEPTED:
            way = repair.passes(cells, 0, q)
            assert "".join(c[s][1] for c, s in zip(cells, way, strict=True)) == whole[0, q][1]


def test_repair_query(spark):
    got = QUERIES["op13_structure_repair"](spark, SF)
    with duckdb.connect() as con:
        con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
        want = con.execute(ORACLE["op13_structure_repair"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("parts", [["\na", "\nb"], ["", "\nab", ""], [""], ["\n"]])
def test_joined_digest(spark, parts):
    df = spark.createDataFrame([(None, i, p) for i, p in enumerate(parts)] + [(4, 0, "\nx")], "k long, at long, p string")
    got = {r.k: r.d for r in turns.joined_sha256(df, "k", "at", F.col("p"), "d").collect()}
    assert got == {None: sha("".join(parts)[1:]), 4: sha("x")}
