"""Operators across documents, pages and vectors, against brute force, with odd input."""

import base64
import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quietlog.llm import near_dups, neighbours, repeats, warc
from quietlog.llm.common import table
from quietlog.llm.queries import ORACLE, QUERIES
from quietlog.session import release, scratch

SF = "/root/testdata/sf0.001"
CLASHING = ("node", "a", "b", "label", "band", "rank", "key", "bucket", "kind", "payload", "sha", "first", "least", "group_id")


def with_clashes(df):
    return df.withColumns({c: F.lit(c) for c in CLASHING})


# --- WARC ---


def test_pages_come_back(spark):
    got = {r.page_id: r for r in warc.convert_pages(table(spark, SF, "pages")).collect()}
    pages = table(spark, SF, "pages").collect()
    assert len(got) == len(pages)
    first = {}
    for p in sorted(pages):
        first.setdefault(p.html, p.page_id)
    for p in pages:
        data, r = (p.html or "").encode(), got[p.page_id]
        own = first[p.html] == p.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", first[p.html])) and r.url == p.url


def test_pages_odd(spark):
    rows = [(3, "u v\n", "same"), (2, None, "same"), (7, "", None), (8, "é", ""), (None, "n", "same"), (-5, "x", "WARC/1.1\r\n\r\nx\r\n\r\n" * 2000),
            (2, None, "same"), (None, "m", "alone")]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.convert_pages(df).collect()), key=repr)
    want = [(3, 4, "revisit", 2), (2, 4, "response", None), (7, 0, "response", None), (8, 0, "revisit", 7), (None, 4, "revisit", 2),
            (-5, 34_000, "response", None), (2, 4, "response", None), (None, 5, "response", None)]
    assert got == sorted(want, key=repr)
    assert warc.convert_pages(df.limit(0)).count() == 0


def test_arc_versions():
    for version in (1, 2):
        data = warc.arc_head(version, "a.arc", "20240102030405") + warc.arc_record(version, "http://h/ü x", "20240102030405", b"one\n\ntwo") + warc.arc_record(version, "", "20240102030405", b"")
        one, two = warc.read_arc(data)
        assert (one.url, one.content, one.mime, one.status) == ("http://h/%C3%BC%20x", b"one\n\ntwo", "text/html", 200 if version == 2 else None)
        assert (two.url, two.content) == ("", b"")
        for broken in (data[:-5], data[10:], data.replace(b"text/html", b"text html")):
            with pytest.raises(ValueError):
                list(warc.read_arc(broken))


def test_record_ids():
    for page in (0, 1, -1, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_id(page, warc.digest(b"x"))) == page


# --- repeats ---


def plain_removal(rows):
    """Where strings of LENGTH bytes start first, by (doc_id, byte)."""
    n, first = repeats.LENGTH, {}
    key = lambda d: -(2**63) if d is None else d
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - n + 1):
            w = data[i : i + n]
            first[w] = min(first.get(w, (2**63, 0)), (key(d), i))
    out = []
    for d, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - n + 1):
            if first[data[i : i + n]] < (key(d), i):
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


SHARED = "the very same passage of words that is shared among all the documents of this little test and is long enough. "


def odd_documents():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(2, 8)))
    rows = [(100 + i, " ".join(word() for _ in range(r.randint(0, 30))) + SHARED + " ".join(word() for _ in range(20))) for i in range(120)]
    base = [word() for _ in range(200)]
    for i in range(40):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(200)] = word()
        rows.append((300 + i, " ".join(words)))
    rows += [(1, None), (2, ""), (3, "q" * 99), (4, "q" * 99), (5, "a" * 3000), (6, ("ab" * 7 + "x") * 40), (None, SHARED), (7, SHARED), (7, SHARED), (8, "é" * 400)]
    return rows


@pytest.mark.parametrize("block", [2 << 20, 2000])
def test_repeats(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "STEP", block)
    rows = odd_documents()
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = sorted((tuple(r) for r in repeats.digests(df).collect()), key=repr)
    assert got == plain_removal(rows)


def test_repeats_of_the_tables(spark):
    docs = table(spark, SF, "documents")
    got = sorted((tuple(r) for r in repeats.digests(docs).collect()), key=repr)
    assert got == plain_removal([(r.doc_id, r.text) for r in docs.collect()])


def test_repeats_removed(spark):
    df = with_clashes(spark.createDataFrame([(1, SHARED + "é one", 7), (2, SHARED + "two", 7), (3, None, None)], "doc_id long, text string, n_chars long"))
    out = repeats.removed(df)
    assert out.schema == df.schema
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, SHARED + "é one", len(SHARED) + 5), (2, "two", 3), (3, None, None)}
    assert repeats.removed(df.limit(0)).count() == 0


# --- near duplicates ---


def shingle_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(rows):
    sets = [shingle_set(t) for _, t in rows]
    holders, common, up = defaultdict(list), defaultdict(int), list(range(len(rows)))
    for i, s in enumerate(sets):
        for x in s:
            for j in holders[x]:
                common[j, i] += 1
            holders[x].append(i)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, j), n in common.items():
        if n / (len(sets[i]) + len(sets[j]) - n) >= near_dups.SIMILAR:
            up[top(i)] = top(j)
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        members[top(i)].append(d)
    return sorted(((d, min((x for x in m if x is not None), default=None), len(m)) for m in members.values() for d in m), key=repr)


def test_groups_of_odd_documents(spark):
    r = random.Random(3)
    base = [f"w{r.randint(0, 5000)}" for _ in range(200)]
    rows = odd_documents() + [(20, "a b"), (21, "A  b"), (22, " \xa0 "), (23, "word " * 40_000), (24, "word " * 39_000), (None, "a b"), (None, "alone here")]
    for i in range(150):  # many near copies, some of them like each other only by way of a third
        words = list(base)
        for _ in range(r.choice([0, 1, 3, 4, 5, 6, 9])):
            words[r.randrange(200)] = f"z{r.randint(0, 10**6)}"
        rows.append((1000 + i, " ".join(words)))
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted((tuple(x) for x in near_dups.groups(df).collect()), key=repr)
    assert got == plain_groups(rows)
    kept = near_dups.deduplicated(df)
    assert kept.schema == df.schema
    want = [d for d, g, _ in plain_groups(rows) if d is None or d == g]
    assert sorted((x.doc_id for x in kept.collect()), key=repr) == sorted(want, key=repr)


def test_groups_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dups.groups(df).count() == 0 and near_dups.deduplicated(df).count() == 0


def test_dart_signatures():
    r = np.random.default_rng(2)
    x = np.arange(300, dtype=np.uint64) * np.uint64(7919) + np.uint64(5)
    for a, b in ((r.integers(1, 9, 300), r.integers(1, 9, 300)), (r.random(300) * 3, r.random(300) * 3), (np.ones(300), np.r_[np.ones(250), np.full(50, 1e-9)])):
        s = near_dups.signatures(np.repeat([0, 1], 300), np.concatenate([x, x]), np.concatenate([a, b]), 2, 4096)
        assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.035


def test_components(spark):
    r = random.Random(6)
    pairs = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 80)] + [(r.randint(300, 400), r.randint(300, 400)) for _ in range(60)]
    up = {x: x for p in pairs for x in p}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {x.node: x.label for x in near_dups.components(spark.createDataFrame(pairs, "a long, b long").where("a <> b")).collect()}
    assert got == {x: top(x) for x in up if any(x in p and p[0] != p[1] for p in pairs)}


# --- neighbours ---


def test_neighbours_odd(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=6).round(1).tolist()) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(60)]  # a very common vector, near and far
    rows += [(500, None), (600, [0.0] * 6), (700, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (800, [float("nan")] * 6), (900, [float("inf")] * 6), (1000, [1.0, 2.0]), (1001, [2.0, 2.0]), (None, rows[0][1]), (7, rows[7][1])]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    usable = {d: np.array(v, np.float32).astype(float) for d, v in rows if d is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    want = []
    for q in (x for x in usable if x % 100 == 0):
        near = sorted((float(np.sqrt(((usable[q] - v) ** 2).sum())), d) for d, v in usable.items() if d != q and len(v) == len(usable[q]))
        want += [(q, i + 1, d) for i, (_, d) in enumerate(near[:10])]
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted((x.query_id, x.rank, x.vec_id) for x in got) == sorted(want)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 8)
    monkeypatch.setattr(neighbours, "TILE", 16)
    df = table(spark, SF, "embeddings")
    few = sorted(tuple(x) for x in neighbours.nearest(df, F.col("vec_id") % 5 == 0).collect())
    monkeypatch.undo()
    assert few == sorted(tuple(x) for x in neighbours.nearest(df, F.col("vec_id") % 5 == 0).collect())


# --- queries and pipeline ---


def test_entry_has_them():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations", "documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    keys = list(want.columns)[:2]
    want, got = (x.sort_values(keys).reset_index(drop=True) for x in (want, got))
    assert len(want) == len(got) > 0
    for c in want.columns:
        assert np.allclose(want[c], got[c]) if want[c].dtype.kind == "f" else (want[c] == got[c]).all(), c


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        path = scratch(spark, name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        steps[name] = {r.doc_id: r.text for r in docs.collect()}
    all_docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert steps["language_id"] == all_docs  # all have letters
    assert set(steps["near_dups"]) == {d for d, g, _ in plain_groups(list(all_docs.items())) if d == g}
    left = {d: n for d, n, *_ in plain_removal(list(steps["near_dups"].items()))}
    assert set(left) == set(steps["suffix_dedup"])
    assert all(len(steps["suffix_dedup"][d].encode()) <= n for d, n in left.items())
    assert not any("@mail" in t for t in steps["pii"].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    want = sorted(tuple(r) for r in packed.collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want
    assert {r[0] for r in want} == set(steps["pii"])


def test_release_removes_scratch(spark, tmp_path):
    import os

    path = scratch(spark, "gone")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.exists(local)
    release(spark)
    assert not os.path.exists(local)
