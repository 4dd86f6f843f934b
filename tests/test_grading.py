"""Grading, policy and the payload guard on literal cases."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quietlog.functions import detect as D
from quietlog.functions import payload as P
from quietlog.functions import rules as R
from quietlog.functions.redact import redact
from quietlog.operators.guard import audit_entries, decision_counts, guard, rollup_nodes, safe_session_id, session_of


def keyword_plainly(text, kw):
    low, k, at = text.lower(), kw.lower(), 0
    alnum = "abcdefghijklmnopqrstuvwxyz0123456789"
    while (i := low.find(k, at)) >= 0:
        before = kw.startswith(".") or i == 0 or low[i - 1] not in alnum
        after = i + len(k) >= len(low) or low[i + len(k)] not in alnum
        if before and after:
            return True
        at = i + 1
    return False


def test_keywords_against_python(spark):
    rng = random.Random(5)
    parts = ["token", "TOKEN", "_", "x", "1", " ", "é", ".env", ".", "auth", "ssh", "中"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    words = ["token", "auth_token", ".env", "ssh"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", *[D.keyword_matches(F.lower("t"), w).alias(f"k{n}") for n, w in enumerate(words)]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in rows] == [tuple(keyword_plainly(t, w) for w in words) for t in texts]


def detect(spark, policy=R.Policy(), **inputs):
    cols = {k: v if k == "paths" else F.lit(v) for k, v in inputs.items()}
    return spark.range(1).select(D.evaluate_policy(policy, **cols).alias("d")).first().d


def test_levels_and_reasons(spark):
    d = detect(spark, message="my password and id_rsa at postgres://x")
    assert (d.level, d.action) == ("S3", "block")
    assert d.reason.startswith("S3 keyword detected: id_rsa; S2 pattern matched: ")
    assert detect(spark, message="hello").reason is None
    assert detect(spark, message="  ", tool_name=" Sudo ").reason == "S3 tool detected:  Sudo "
    assert detect(spark, tool_name="my-exec.v2").level == "S2"
    assert detect(spark, tool_name="executor").level == "S1"
    paths = D.param_paths(F.lit('{"a": ["~/private/x", {"b": "k/server.pem"}], "c/d": 1}'))
    assert detect(spark, paths=paths).reason == "S2 path detected: ~/private/x"
    assert detect(spark, tool_result='{"token":1}').reason == "Result: S2 keyword detected: token"


def test_disabled_and_actions(spark):
    off = R.Policy(enabled=False)
    d = spark.range(1).select(D.detect_sensitivity(off, message=F.lit("password")).alias("d")).first().d
    assert (d.level, d.reason, d.confidence) == ("S1", "privacy detection disabled", 1.0)
    assert [R.Policy(handling_s2=x).action_for("S2") for x in ("", " Redact ", "review", "nonsense")] == ["allow", "redact", "review", "block"]


def test_rules(spark):
    merged = R.Rules().configured(keywords_s2=["project_secret"], keywords_s3=[])
    assert merged.keywords_s2 == ("project_secret",) and merged.keywords_s3 == R.Rules().keywords_s3
    assert detect(spark, R.Policy(rules=merged), message="project_secret").action == "redact"
    assert R.Rules().requested(spark, keywords_s3=[]).keywords_s3 == ()
    with pytest.raises(ValueError):
        R.Rules().requested(spark, patterns_s3=["["])
    ignored = R.Rules().configured(patterns_s3=["["]).usable(spark)
    assert detect(spark, R.Policy(rules=ignored), message="x").level == "S1"
    assert ("tools_s2", 1, "shell") in R.Rules().as_rows()


def test_json_strings(spark):
    body = '{"a":"x\\"y","b\\u0041":[1,"\\\\","z:"],"c" : {"d":"e/f"}}'
    got = spark.range(1).select(D.json_strings(F.lit(body)).alias("s")).first().s
    assert got == ['x"y', "\\", "z:", "e/f"]
    long = json.dumps({"k": "a\\n" * 200_000})
    df = spark.createDataFrame([(long,)], "b string")
    assert df.select(F.length(D.json_strings(F.col("b"))[0]).alias("n")).first().n == 600_000


ARGS = json.dumps({"password": "abc123", "path": "./notes.txt"})
BODIES = [
    {"messages": [{"role": "user", "content": "my password is abc123"}]},
    {"messages": [{"role": "user", "content": "read ~/.ssh/id_rsa now"}]},
    {"messages": [{"role": "assistant", "tool_calls": [{"id": "1", "function": {"name": "x", "arguments": ARGS}}]}]},
    {"tool_params": {"password": "abc123", "path": "./notes.txt"}},
    {"messages": [{"role": "user", "content": [{"type": "text", "text": "mail u@example.com"}, {"type": "image"}]}], "system": "be nice"},
    {"input": ["a", {"b#c/d~": "token=zzz", "d": [["deep"]]}], "messages": []},
    {"messages": [{"role": "user", "content": "nothing to see"}], "system": ["array is not scanned: password x"]},
]


@pytest.fixture(scope="module")
def guarded(spark):
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(BODIES)] + [(99, "[1]"), (98, "{bad")], "id int, body string")
    return {r.id: r for r in guard(df).collect()}


def test_guard_decisions(guarded):
    got = {i: (r.decision.level, r.decision.action, r.status_code) for i, r in guarded.items()}
    assert got == {
        0: ("S2", "redact", 200), 1: ("S3", "block", 403), 2: ("S2", "redact", 200), 3: ("S2", "redact", 200),
        4: ("S1", "redact", 200), 5: ("S2", "redact", 200), 6: ("S1", "allow", 200), 99: ("S1", "allow", 200), 98: ("S1", "allow", 200),
    }
    assert guarded[4].decision.reason == "redaction rule matched"


def test_guard_bodies(guarded):
    out = {i: r.body_out and json.loads(r.body_out) for i, r in guarded.items() if i < 90}
    assert out[0]["messages"][0]["content"] == "my password is [REDACTED:PASSWORD]"
    assert out[1] is None and guarded[1].entries[0].clean_text == "[PRIVATE]"
    args = out[2]["messages"][0]["tool_calls"][0]["function"]["arguments"]
    assert json.loads(args) == {"password": "[REDACTED:PASSWORD]", "path": "./notes.txt"}
    assert out[3]["tool_params"] == {"password": "[REDACTED:PASSWORD]", "path": "./notes.txt"}
    assert out[4]["messages"][0]["content"] == [{"type": "text", "text": "mail [REDACTED:EMAIL]"}, {"type": "image"}]
    assert out[5]["input"] == ["a", {"b#c/d~": "token=[REDACTED:TOKEN]", "d": [["deep"]]}]
    assert guarded[6].body_out == json.dumps(BODIES[6]) and guarded[98].body_out == "{bad"


def test_guard_switches(spark):
    df = spark.createDataFrame([(0, json.dumps(BODIES[0]))], "id int, body string")
    off = guard(df, R.Policy(enabled=False)).first()
    assert off.decision.action == "allow" and off.body_out == df.first().body
    review = guard(df, R.Policy(handling_s2="review")).first()
    assert review.status_code == 403 and review.entries[0].clean_text == "[REVIEW_REQUIRED]"


def test_deep_json(spark):
    """No depth limit: 300 levels of lists and objects."""
    doc = "bottom"
    for i in range(150):
        doc = [{"k": doc}]
    df = spark.createDataFrame([(json.dumps({"args": doc}),)], "body string")
    node = P.with_text_nodes(df).select(F.explode("nodes").alias("n")).first().n
    assert node.text == "bottom" and node.context_prefix == "args" + ".k" * 150


def test_audit_and_rollup(spark):
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(BODIES[:2])], "id int, body string")
    rows = audit_entries(guard(df), F.lit("s"), "id").collect()
    assert {(r.full_text, r.clean_text, r.metadata["decision"]) for r in rows} == {
        ("my password is abc123", "my password is [REDACTED:PASSWORD]", "redact"),
        ("read ~/.ssh/id_rsa now", "[PRIVATE]", "block"),
    }
    assert decision_counts(audit_entries(guard(df), F.lit("s"), "id")).count() == 2
    nodes = spark.createDataFrame([("p", 0, 1, None), ("p", 1, 3, "first"), ("p", 2, 3, "second"), ("q", 0, 1, None)], "k string, node_idx int, rank int, reason string")
    got = {r.k: (r.level, r.action, r.reason) for r in rollup_nodes(nodes, "k").collect()}
    assert got == {"p": ("S3", "block", "first"), "q": ("S1", "allow", None)}


def test_session_ids(spark):
    df = spark.createDataFrame([("////",), ("a" * 200,), ("  ",), ("A-b_9é",)], "s string")
    assert [r.x for r in df.select(safe_session_id(F.col("s")).alias("x")).collect()] == ["____", "a" * 128, "default", "A-b_9_"]
    headers = F.create_map(F.lit("X-Session-Id"), F.lit(" h "))
    none = F.create_map(F.lit("x"), F.lit("y"))
    v = P.parse_object(F.lit('{"session_id": 4, "thread_id": "t/1"}'))
    row = spark.range(1).select(session_of(headers, v, F.lit("f")).alias("a"), session_of(none, v, F.lit("f")).alias("b")).first()
    assert (row.a, row.b) == ("h", "t_1")


def test_request_options(spark):
    bodies = ['{"options": {"email": false, "pin": true, "env_var": "yes"}}', '{"redaction_options": {"pin": true}}', "{}"]
    df = spark.createDataFrame([(b,) for b in bodies], "b string").withColumn("v", P.parse_object(F.col("b")))

    def on(**kw):
        flags = P.request_options(F.col("v"), **kw)
        return [{k for k, x in r.asDict().items() if x} for r in df.select(*[c.alias(k) for k, c in flags.items()]).collect()]

    assert on() == [{"pin", "chinese_phone", "chinese_id"}, {"pin", *R.DEFAULT_ON}, set(R.DEFAULT_ON)]
    assert on(from_scratch=True) == [{"pin"}, {"pin"}, set(R.DEFAULT_ON)]


def test_guard_reads_what_it_can_and_holds_the_rest(spark):
    """Equal keys: the last counts. Too deep, or above the body limit: not released. No JSON: passed on as it is."""
    secret = '"messages": [{"role": "user", "content": "my password is hunter2 in ~/.ssh/id_rsa"}]'
    deep = "[" * 100_000 + "]" * 100_000
    bodies = {
        "plain": "{" + secret + "}",
        "twice": '{"a": 1, "a": 2, ' + secret + "}",
        "last": '{"input": "~/.ssh/id_rsa", "input": "fine"}',
        "deep": '{"x": ' + deep + ", " + secret + "}",
        "large": '{"x": "' + "y" * R.MAX_BODY_BYTES + '", ' + secret + "}",
        "broken": '{"a": ' + secret,
    }
    df = spark.createDataFrame(list(bodies.items()), "id string, body string")
    got = {r.id: r for r in guard(df).collect()}
    assert {k: (r.decision.action, r.status_code, r.body_out is None) for k, r in got.items()} == {
        "plain": ("block", 403, True), "twice": ("block", 403, True), "last": ("allow", 200, False), "deep": ("block", 403, True),
        "large": ("block", 413, True), "broken": ("allow", 200, False),
    }
    assert got["deep"].decision.level == "S3" and got["deep"].decision.reason == "payload not readable: depth"


def test_size_rule_is_on_raw_text(spark):
    """One test, on the bytes that come in: text that grows when normalised passes, text that shrinks does not."""
    grows, shrinks = "ﷺ" * 300_000, "%41" * 400_000
    texts = [grows[: R.MAX_TEXT_BYTES // 3], shrinks, "x" * R.MAX_TEXT_BYTES, "x" * (R.MAX_TEXT_BYTES + 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert [r.ok for r in df.select("id", redact(F.col("text"))["text"].isNotNull().alias("ok")).orderBy("id").collect()] == [True, False, True, False]
    body = spark.createDataFrame([(i, json.dumps({"input": t})) for i, t in enumerate(texts)], "id int, body string")
    assert {r.id: r.status_code for r in guard(body).collect()} == {0: 200, 1: 413, 2: 200, 3: 413}


def test_audit_order_and_request_metadata(spark):
    df = spark.createDataFrame([(2, json.dumps({"input": "c", "prompt": "d"})), (1, json.dumps({"input": "a", "prompt": "b"}))], "id long, body string")
    rows = audit_entries(guard(df), F.lit("s"), "id", order=F.col("id"), path=F.lit("/v1"), method=F.lit("POST")).orderBy("seq").collect()
    assert [r.full_text for r in rows] == ["a", "b", "c", "d"]
    assert all((r.metadata["path"], r.metadata["method"], r.metadata["decision"]) == ("/v1", "POST", "allow") for r in rows)


RE2_PATTERNS = [
    "pan [[:digit:]]{4}", "[[:^digit:]]x", "(?P<n>ab)+c", "[[]x", "[b&&c]", "[]a]b", "[^]a]b", r"\Qa.b\E", "[[:word:]]-", r"a\sb", r"[\s]z", "x[a-c[:upper:]]y",
    "(?i)KEY", r"^a.*z$", r"\bid\b", "[^[:space:]]@", r"[\]]w",
]
RE2_TEXTS = ["pan 1234", "pan abcd", "ax", "1x", "ababc", "[x", "b", "&", "c", "]b", "ab", "zb", "a.b", "axb", "w-", "--", "a b", "a\x0bb", " z", "xBy", "xdy", "key", "abz", "my id.", "idx", "u@", " @", "]w", "X", "cc"]


def test_user_patterns_mean_what_they_mean_in_re2(spark):
    con = duckdb.connect()
    df = spark.createDataFrame([(t,) for t in RE2_TEXTS], "t string")
    for p in RE2_PATTERNS:
        rules = R.Rules().configured(patterns_s3=[p])
        got = [r.x == 3 for r in df.select(D.detect_patterns(F.col("t"), rules)["rank"].alias("x")).collect()]
        want = [con.sql("select regexp_matches($t, $p)", params={"t": t, "p": "(?i)" + p}).fetchall()[0][0] for t in RE2_TEXTS]
        assert got == want, (p, [t for t, a, b in zip(RE2_TEXTS, got, want, strict=True) if a != b])


def test_invalid_patterns_are_ignored(spark):
    bad = ["[", "(a", "a++", "(?=x)x", r"(a)\1", "[[:nothing:]]", "*"]
    rules = R.Rules().configured(patterns_s3=[*bad, "zzz"])
    df = spark.createDataFrame([("a anything x",), ("zzz",)], "t string")
    assert [r.x for r in df.select(D.detect_patterns(F.col("t"), rules)["rank"].alias("x")).collect()] == [1, 3]
    for p in bad:
        with pytest.raises(ValueError):
            R.Rules().requested(spark, patterns_s3=[p])


def test_session_headers_in_any_case(spark):
    v = F.parse_json(F.lit('{"session_id": "body"}'))
    rows = spark.createDataFrame([({"x-session-id": "low"},), ({"X-SESSION-ID": " ", "X-Client-Request-Id": "r/1"},), ({"other": "x"},), ({},), (None,)], "h map<string,string>")
    assert [r.s for r in rows.select(session_of(F.col("h"), v, F.lit("f")).alias("s")).collect()] == ["low", "r_1", "body", "body", "body"]
