"""Redaction, restore and normalisation on literal texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quietlog.functions import rules as R
from quietlog.functions.paths import looks_like_path, sensitive_path
from quietlog.functions.redact import mapping_of, redact
from quietlog.functions.restore import decode_token, encode_token, mapping_replacements, restore
from quietlog.functions.text import clean_text, is_blank, needs_normalizing, normalize, trim_space


def redacted(spark, texts, options=R.DEFAULT_ON, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", redact(F.col("t"), options, **kw).alias("r")).orderBy("i").collect()
    return [(r.r.text, [(x.original, x.tag) for x in r.r.replacements]) for r in rows]


CASES = [
    ("Contact me at user@example.com", "Contact me at [REDACTED:EMAIL]"),
    ("a@b.com1x@y.zz", "[REDACTED:EMAIL][REDACTED:EMAIL]"),
    ("my password is abc123", "my password is [REDACTED:PASSWORD]"),
    ("password is in", "password is [REDACTED:PASSWORD]"),
    ("password is [REDACTED:KEY]", "password is [REDACTED:KEY]"),
    ("password", "password"),
    ("secret sauce", "secret sauce"),
    ("secret: sauce", "secret: [REDACTED:SECRET]"),
    ("please inspect ~/.ssh/id_rsa now", "please inspect [REDACTED:PATH] now"),
    ("see ./notes.txt and /etcetera", "see ./notes.txt and [REDACTED:PATH]"),
    ("u&#64;example.com", "[REDACTED:EMAIL]"),
    ("u%40example.com", "[REDACTED:EMAIL]"),
    ("100% of u%40example.com", "100% of u%40example.com"),
    ("pass​word: x", "password: [REDACTED:PASSWORD]"),
    ("电话13800138000号", "电话[REDACTED:PHONE]号"),
    ("x13800138000", "x13800138000"),
    ("marks  from  outside", "marks  from  outside"),
    ("-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY----- x", "[REDACTED:PRIVATE_KEY] x"),
    ("-----BEGIN PRIVATE KEY----- no end", "-----BEGIN PRIVATE KEY----- no end"),
]


def test_golden(spark):
    got = [t for t, _ in redacted(spark, [c[0] for c in CASES])]
    assert got == [c[1] for c in CASES]


def test_options(spark):
    line = "host 10.1.2.3\nAPI_URL='v1'\ncard 4111 1111 1111 1111 id 11010119900101123X"
    plain, _ = redacted(spark, [line], options=())[0]
    assert plain == line
    full, hits = redacted(spark, [line], options=R.OPTION_NAMES)[0]
    # the 10 branch takes two more octets only; an 18-digit id that ends in X is no card
    assert full == "host [REDACTED:INTERNAL_IP].3\n[REDACTED:ENV_VAR]\ncard [REDACTED:CARD] id [REDACTED:ID]"
    assert [h[0] for h in hits] == ["10.1.2", "API_URL='v1'", "4111 1111 1111 1111", "11010119900101123X"]


def test_rule_order_and_mapping(spark):
    text = "token-aaaaaaaaaaaaaaaaaaaa password sk-bbbbbbbbbbbbbbbbbbbb token zz"
    out, hits = redacted(spark, [text])[0]
    assert out == "[REDACTED:KEY] password [REDACTED:KEY] token [REDACTED:TOKEN]"
    df = spark.createDataFrame([(hits + [("zz", "[REDACTED:LAST]")],)], "r array<struct<original:string,tag:string>>")
    mapping = df.select(mapping_of(F.col("r")).alias("m")).first().m
    assert mapping["zz"] == "[REDACTED:LAST]" and len(mapping) == 3


def test_size_limit(spark):
    ok, over = "a" * R.MAX_TEXT_BYTES, "a" * (R.MAX_TEXT_BYTES + 1)
    df = spark.createDataFrame([(0, ok), (1, over)], "i int, t string")
    rows = df.select("i", redact(F.col("t"))["text"].isNull().alias("refused")).orderBy("i").collect()
    assert [r.refused for r in rows] == [False, True]


def test_long_runs_stay_linear(spark):
    """Runs without an end marker must not blow up on a backtracking engine."""
    text = "a" * 300_000 + " @ " + "中" * 200_000 + " 号"
    out, _ = redacted(spark, [text], options=R.OPTION_NAMES)[0]
    assert out == text


def test_globs(spark):
    rules = R.Rules().configured(paths_s3=["/data/*.csv"])
    out = [t for t, _ in redacted(spark, ["get /data/x.csv", "get /data/a/x.csv", "get /etc/x"], rules=rules)]
    assert out == ["get [REDACTED:PATH]", "get /data/a/x.csv", "get /etc/x"]
    assert R.glob_regex("/plain") is None and R.glob_regex("/bad[") is None


def test_label_rules_against_python(spark):
    """Random label texts against a plain restatement of one rule."""
    rng = random.Random(7)
    parts = ["secret", "Secret", "secrets", "is", "are", "in", "for", ":", "=", " ", "  ", "\n", "x1", "[REDACTED:KEY]", "é", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    rule = next(r for r in R.LABEL_RULES if r.tag == "SECRET")
    compiled = re.compile("(?ai)" + rule.pattern + r"(\S+)")

    def plain(t):
        def swap(m):
            if re.search(R.PLACEHOLDER, m.group(1)):
                return m.group(0)
            return m.group(0)[: m.start(1) - m.start(0)] + "[REDACTED:SECRET]"

        return compiled.sub(swap, t)

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    from quietlog.functions.redact import _chain, apply

    only = R.LABEL_RULES
    try:
        R.LABEL_RULES = (rule,)
        _chain.cache_clear()
        from quietlog.functions.redact import redact_normalized

        got = [r.x for r in df.select("i", redact_normalized(F.col("t"), (), stages=("labels",))["text"].alias("x")).orderBy("i").collect()]
    finally:
        R.LABEL_RULES = only
        _chain.cache_clear()
    assert got == [plain(t) for t in texts]


def test_normalize(spark):
    texts = ["a&amp;b", "&lt;", "x%20y", "x%2", "ﬁ", "é", "Ａ", "​", "%ff%fe", "&#1;", "plain", "é ü ß", "a+b", "&notanentity", "ｱ"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", normalize(F.col("t")).alias("n"), needs_normalizing(F.col("t")).alias("need")).orderBy("i").collect()
    assert [r.n for r in rows] == [clean_text(t) for t in texts]
    assert [r.n for r in rows][:9] == ["a&b", "<", "x y", "x%2", "fi", "é", "A", "", "��"]
    assert all(r.need or r.n == t for r, t in zip(rows, texts))


def restored_plainly(text, replacements):
    queues = {}
    for original, tag in replacements:
        queues.setdefault(tag, []).append(original)
    return re.sub(R.PLACEHOLDER, lambda m: queues[m.group()].pop(0) if queues.get(m.group()) else m.group(), text)


def test_restore_against_python(spark):
    rng = random.Random(3)
    tags = [f"[REDACTED:{t}]" for t in ("KEY", "EMAIL", "CARD")]
    rows = []
    for i in range(200):
        text = "".join(rng.choice(tags + [" a ", "", "b\n"]) for _ in range(rng.randint(0, 12)))
        reps = [(f"o{k}$\\1", rng.choice(tags)) for k in range(rng.randint(0, 8))]
        rows.append((i, text, reps))
    df = spark.createDataFrame(rows, "i int, t string, r array<struct<original:string,tag:string>>")
    got = df.select("i", restore(F.col("t"), F.col("r")).alias("x")).orderBy("i").collect()
    assert [g.x for g in got] == [restored_plainly(t, r) for _, t, r in rows]


def test_restore_escapes_and_tokens(spark):
    df = spark.createDataFrame(
        [("x [REDACTED:KEY]", [("<a&b>", "[REDACTED:KEY]")])], "t string, r array<struct<original:string,tag:string>>"
    )
    row = df.select(
        restore(F.col("t"), F.col("r"), escape_html=True).alias("x"),
        encode_token(F.col("r")).alias("token"),
        decode_token(encode_token(F.col("r")))["replacements"].alias("back"),
        decode_token(F.lit("!!")).alias("bad"),
        mapping_replacements(F.create_map(F.lit("b"), F.lit("T"), F.lit("a"), F.lit("T"))).alias("m"),
    ).first()
    assert row.x == "x &lt;a&amp;b&gt;"
    assert re.fullmatch(r"[A-Za-z0-9_-]+", row.token)
    assert row.back[0].original == "<a&b>" and row.bad is None
    assert [x.original for x in row.m] == ["a", "b"]


def test_paths_and_trimming(spark):
    df = spark.createDataFrame([("~/.AWS/x",), ("a/b",), ("word",), ("key.pem",), ("./key.PEM",)], "p string")
    rows = df.select(looks_like_path(F.col("p")).alias("l"), sensitive_path(F.col("p")).alias("s")).collect()
    assert [(r.l, r.s) for r in rows] == [(True, True), (True, False), (False, False), (False, False), (True, True)]
    one = spark.range(1).select(
        trim_space(F.lit("　  a \x0b")).alias("t"), is_blank(F.lit("  ")).alias("b"), is_blank(F.lit(None)).alias("n")
    ).first()
    assert (one.t, one.b, one.n) == ("a", True, True)


@pytest.mark.parametrize("pattern,ok", [("[", False), ("(a|b)+", True), (r"\p{Han}+", True)])
def test_regex_check(spark, pattern, ok):
    assert R.pattern_compiles(pattern) is ok
