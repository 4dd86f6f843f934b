"""Decontamination against a plain search for windows, with odd input."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quietlog.llm import leaks
from quietlog.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KINDS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    known = []
    for item, text in items:
        w = words(text)
        t = min(len(w), 10)
        known += [(item, tuple(w[i : i + t])) for i in range(len(w) - t + 1) if t]
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for item, window in known:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    names |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    a, b = spark.createDataFrame(docs, KINDS[0]), spark.createDataFrame(items, KINDS[1])
    for df in ("hash", "place", "t", "window", "row_key", "words", "n_hit", "ids"):
        a, b = a.withColumn(df, F.lit(df)), b.withColumn(df, F.lit(df))
    return sorted((tuple(r) for r in leaks.contaminated(a, b).collect()), key=repr)


def text(rng, n, letters="ab"):
    return " ".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_every_shared_span_is_found(spark, seed):
    rng = random.Random(seed)
    letters = ["ab", "abcdef", [f"w{i}" for i in range(60)]][seed]
    docs = [(i, text(rng, rng.choice([0, 3, 9, 10, 11, 40, 300]), letters)) for i in range(30)]
    items = [(i, text(rng, rng.choice([1, 2, 4, 5, 9, 10, 11, 30]), letters)) for i in range(8)]
    if seed == 2:  # no short items, long ones planted at the ends and in the middle
        items = [(i, text(rng, 25, letters)) for i in range(4)]
        docs += [(100 + k, f"{text(rng, k, letters)}! {items[k % 4][1][: 60 + k]}") for k in range(12)]
    assert found(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    ten = "One two THREE four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (3, "!? --"), (None, ten), (None, ten.lower()), (5, ten), (5, ten), (5, "x"), (6, ten * 3000),
            (7, "É è " + ten.replace(" ", "\n—,")), (8, "Éa é" * 2), (-9, "a" * 200_000), (10, "a " * 5000), (11, ten[:-1])]
    items = [(30, ten), (4, ten + " eleven"), (4, ten), (None, "éa é"), (9, None), (12, "..."), (13, "a " * 40), (14, "É"), (15, "İ one")]
    assert found(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a b")], []), ([], []), ([(1, "a b")], [(1, None), (2, "")])])
def test_empty(spark, docs, items):
    assert found(spark, docs, items) == brute(docs, items)


def test_large_benchmarks_are_shuffled(spark):
    rng = random.Random(7)
    docs = [(i, text(rng, 60, [f"w{i}" for i in range(30)])) for i in range(20)]
    items = [(i, docs[i][1][20 : 90 + i]) for i in range(12)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found(spark, docs, items) == brute(docs, items)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_query_runs_no_python(spark, capsys):
    got = QUERIES["op11_decontaminate"](spark, SF)
    got.explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
    with duckdb.connect() as con:
        for t in ("documents", "benchmark"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.execute(ORACLE["op11_decontaminate"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
