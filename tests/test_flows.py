"""Usage, tracks, context, conversation formats, captures and limits on literal cases."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quietlog.functions import chat as H
from quietlog.functions.payload import parse_object
from quietlog.functions.tokens import response_text, text_tokens
from quietlog.operators import capture, limits, usage
from quietlog.operators.context import select_context, tokenize
from quietlog.operators.ranks import top_n
from quietlog.session import scratch
from quietlog.sources import providers, request_log, tracks


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_rates(spark):
    now = datetime(2024, 5, 1, 12)
    rows = [(now - timedelta(minutes=2), 100, 50), (now - timedelta(seconds=30), 40, 10), (now - timedelta(minutes=10), 20, 5)]
    df = spark.createDataFrame(rows, "timestamp timestamp, input_tokens int, output_tokens int")
    s = usage.stats(df, F.lit(now)).first()
    assert (s.total_requests, s.total_tokens, s.requests_per_min, s.input_per_min, s.output_per_min) == (3, 225, 0.4, 28.0, 12.0)


def test_paths(spark):
    cases = {"/v1/models": "models", "/v1/chat/completions": "chat/completions", "/v2/assistants": "assistants", "/models": "models", "/v1": "", "/v1beta/files": "files"}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert [r.x for r in df.select(usage.strip_version(F.col("p")).alias("x")).collect()] == list(cases.values())
    paths = {"/models": True, "/models/": True, "/v1/models": True, "/v3/models/": True, "/v4/models": False, "/x/models": False, "/models//": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.x for r in df.select(usage.is_models_path(F.col("p")).alias("x")).collect()] == list(paths.values())


def test_masks_and_clients(spark):
    df = spark.createDataFrame([("sk-1234567890",), ("short",), ("é" * 5,)], "s string")
    assert [r.x for r in df.select(usage.mask(F.col("s")).alias("x")).collect()] == ["sk-1****7890", "****", "éé****éé"]
    df = spark.createDataFrame([(" 1.1.1.1 , 2", "r"), ("", "r"), (None, "r"), (",2", "r")], "x string, r string")
    assert [r.c for r in df.select(usage.client_of(F.col("x"), F.col("r")).alias("c")).collect()] == ["1.1.1.1", "r", "r", ""]


def test_failures_and_bodies(spark):
    df = spark.createDataFrame([("build",), ("cancelled",), ("upstream",)], "k string")
    got = [tuple(r.f) for r in df.select(request_log.failed(F.col("k"), F.lit("x")).alias("f")).collect()]
    assert [g[0] for g in got] == [500, 499, 502] and got[2][1].endswith(": x")
    bodies = spark.createDataFrame([('{"model": "m", "stream": true, "messages": [{"content": "你好a"}, {"content": []}]}',), ("[1]",), ("{",), ("",), (None,)], "request_body string")
    rows = request_log.parse_bodies(bodies).select("model", "stream", "input_tokens").collect()
    assert [tuple(r) for r in rows] == [("m", True, 3)] + [("", False, 0)] * 4


def test_tokens(spark):
    assert one(spark, text_tokens(F.lit("　你好，世界\n"))) == 2
    odd = {"content": [{"text": "a"}, {"content": {"text": "b"}}], "text": "c", "choices": [{"delta": {"content": "d"}}]}
    usual = {"choices": [{"message": {"content": "x"}}, {"delta": {"content": "y"}}, {}]}
    df = spark.createDataFrame([(json.dumps(d),) for d in (odd, usual, {"id": "z"})], "b string")
    assert [r.x for r in df.select(response_text(parse_object(F.col("b"))).alias("x")).collect()] == ["abcd", "xy", ""]


@pytest.fixture(scope="module")
def track_path(spark):
    path = scratch(spark, "tracks")
    rows = [
        ("s/1", 0, "user", "my password is abc123", None, "", 5, '{"n": 1.5, "b": true}', True),
        ("s/1", 1, "user", "x" * (128 * 1024), None, "[HIDDEN]", None, None, False),
        ("s2", 0, "assistant", "hi", "clean", "", None, "[]", True),
        ("s2", 1, "", "no role", None, "", None, None, False),
        ("s2", 2, "user", "both", "c", "p", None, None, False),
    ]
    schema = "session_id string, seq long, role string, full_text string, clean_text string, placeholder string, timestamp_ms long, metadata string, redact boolean"
    usable, refused = tracks.valid(spark.createDataFrame(rows, schema))
    assert refused.count() == 2
    tracks.append_tracks(tracks.ingest(usable, redact_flag="redact"), path)
    return path


def test_tracks(spark, track_path):
    full = tracks.load_session(spark, track_path, "s/1", "full").collect()
    clean = tracks.load_session(spark, track_path, "s/1").collect()
    assert [r.content for r in full] == ["my password is abc123", "x" * (128 * 1024)]
    assert [r.content for r in clean] == ["my password is [REDACTED:PASSWORD]", "[HIDDEN]"]
    assert clean[0].metadata == {"n": "1.5", "b": "true"} and clean[0].timestamp_ms == 5
    assert [r.content for r in tracks.load_session(spark, track_path, "s2", limit=1).collect()] == ["clean"]
    assert [r.session_id for r in tracks.list_sessions(spark, track_path).collect()] == ["s/1", "s2"]
    assert tracks.load_session(spark, track_path, "missing").count() == 0
    with pytest.raises(ValueError):
        tracks.read_track(spark, track_path, "other")


def test_track_reading_skips_bad_lines(spark, tmp_path):
    folder = tmp_path / "full"
    folder.mkdir()
    good = [json.dumps({"role": "user", "content": f"m{i}"}) for i in range(500)]
    lines = [x for i, g in enumerate(good) for x in ([g, "", "{broken"] if i % 7 == 0 else [g])]
    (folder / "one.jsonl").write_text("\n".join(lines))
    (folder / "two.jsonl").write_text(good[0])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")  # several blocks per file
    try:
        rows = tracks.import_track_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.track, r.session_id) for r in rows} == {("full", "one"), ("full", "two")}
    assert sorted((r.seq, r.content) for r in rows if r.session_id == "one") == [(i, f"m{i}") for i in range(500)]


def test_trim_and_top_n(spark):
    rows = [("full", "big", i, "user", "x" * 100, None) for i in range(50)] + [("full", "small", i, "user", "x", None) for i in range(50)]
    df = spark.createDataFrame(rows, "track string, session_id string, seq long, role string, content string, timestamp_ms long")
    df = df.withColumn("metadata", F.create_map(F.lit("a"), F.lit("b")))
    kept = tracks.trim(df, max_entries=5, min_bytes=5000).groupBy("session_id").agg(F.count("*").alias("n"), F.min("seq").alias("m"))
    assert {tuple(r) for r in kept.collect()} == {("big", 5, 45), ("small", 50, 0)}
    hot = spark.range(5000).select(F.lit("k").alias("k"), F.col("id"))
    assert [r.id for r in top_n(hot, ["k"], [F.desc("id")], 3, "rank").orderBy("rank").collect()] == [4999, 4998, 4997]


def test_tokenize(spark):
    got = one(spark, tokenize(F.lit("Ａb_9 中文 テスト é")))
    assert got == ["w:ab_9", "g:ab_", "g:b_9", "u:中", "u:文", "b:中文", "w:テスト", "g:テスト"]
    assert one(spark, tokenize(F.lit("abcdefghijklmnop")))[1:] == [f"g:{'abcdefghijklmnop'[i:i + 3]}" for i in range(8)]


def test_context(spark):
    docs = spark.createDataFrame(
        [("s", 0, "machine learning deployment strategy"), ("s", 1, "  "), ("s", 2, "gardening checklist"), ("e", 0, "x y z")], "session_id string, index long, text string"
    )
    ask = spark.createDataFrame([("s", "machine learning"), ("e", "é")], "session_id string, query string")
    top = select_context(docs, ask, top_k=1).collect()
    assert [(r.session_id, r["index"]) for r in top] == [("s", 0)]
    everything = select_context(docs, ask, top_k=0).orderBy("rank").collect()
    # the second text shares only the 3-grams nin and ing
    assert [(r["index"], r.score > 0.5) for r in everything] == [(0, True), (2, False)]
    assert select_context(docs, ask, min_score=0.5).count() == 1


def test_block_request(spark):
    body = {
        "model": "claude-3", "max_tokens": 9, "system": [{"type": "text", "text": "sys"}], "stop_sequences": ["x"],
        "tools": [{"name": "t", "description": "d", "input_schema": {"type": "object", "properties": None}}],
        "tool_choice": {"type": "tool", "name": "t"},
        "messages": [
            {"role": "user", "content": [{"type": "text", "text": "ping"}]},
            {"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "toolu_1", "name": "t", "input": {"q": "<1>"}}]},
            {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "toolu_1", "content": [{"type": "text", "text": "done"}]}]},
            {"content": {"content": [["deep"], {"text": "er"}]}},
        ],
    }
    df = spark.createDataFrame([(json.dumps(body),)], "body string")
    out = json.loads(H.with_chat_request(df).first().chat_body)
    assert out["messages"][0] == {"role": "system", "content": "sys"}
    assert out["messages"][1] == {"role": "user", "content": "ping"}
    call = out["messages"][2]["tool_calls"][0]
    assert call["id"] == "toolu_1" and json.loads(call["function"]["arguments"]) == {"q": "<1>"}
    assert out["messages"][3] == {"role": "tool", "tool_call_id": "toolu_1", "content": "done"}
    assert out["messages"][4] == {"role": "user", "content": "deep\ner"}
    assert out["tools"] == [{"type": "function", "function": {"name": "t", "description": "d", "parameters": {"type": "object", "properties": {}, "required": []}}}]
    assert out["tool_choice"] == {"type": "function", "function": {"name": "t"}}
    assert (out["stop"], out["max_tokens"], out["model"]) == (["x"], 9, "claude-3")


def test_schema_repair(spark):
    cases = [
        ({"required": None, "enum": None, "examples": None}, {"required": [], "enum": [], "examples": []}),
        ({"items": None}, {"items": {"type": "string"}}),
        ({"properties": None, "patternProperties": None}, {"properties": {}, "patternProperties": {}}),
        ({"additionalProperties": None}, {"additionalProperties": True}),
        ({"anyOf": None, "allOf": None, "oneOf": None}, {"anyOf": [], "allOf": [], "oneOf": []}),
        ({"default": None, "title": None}, {"title": None}),
        ({"type": "object"}, {"type": "object", "required": []}),
        ({"type": "object", "required": ["a"], "properties": {"a": {"type": "object"}}}, {"type": "object", "required": ["a"], "properties": {"a": {"type": "object", "required": []}}}),
    ]
    df = spark.createDataFrame([([json.dumps(c) for c, _ in cases],)], "s array<string>")
    assert [json.loads(x) for x in df.select(H.repair_schemas(F.col("s")).alias("x")).first().x] == [w for _, w in cases]


def test_chat_response(spark):
    body = {"id": "", "model": "m", "choices": [{"message": {"content": "pong", "tool_calls": [{"id": "c", "function": {"name": "f", "arguments": '{"a":1}'}}]}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}
    df = spark.createDataFrame([(json.dumps(body),), ('{"choices": []}',), ("nope",)], "b string")
    a, b, c = [r.x for r in df.select(H.block_message(F.col("b")).alias("x")).collect()]
    assert [json.loads(x) for x in a.content] == [{"type": "text", "text": "pong"}, {"type": "tool_use", "id": "c", "name": "f", "input": {"a": 1}}]
    assert (a.id, a.stop_reason, a.input_tokens, a.output_tokens, a.error) == ("msg_converted", "end_turn", 3, 2, None)
    assert (b.error, c.error) == ("missing choices", "invalid json")


def test_model_remap(spark):
    df = spark.createDataFrame([("Claude-3", "deepseek"), ("gpt-4", "deepseek"), ("claude-3", "custom"), ("claude-3", "unknown")], "model string, provider string")
    got = H.remap_models(df, providers.providers(spark)).collect()
    assert sorted(r.model for r in got) == ["claude-3", "claude-3", "deepseek-coder", "gpt-4"]


def test_capture(spark):
    lines = [
        'data: {"choices": [{"delta": {"content": "he"}}]}', "", ": note", "data: {broken", 'data: {"choices": [{"delta": {"content": "llo"}, "finish_reason": "stop"}], "usage": {"completion_tokens": 2}}',
        "data: [DONE]", 'data: {"choices": [{"delta": {"content": "late"}}]}',
    ]
    spaced = ['data: {"choices": [{"delta": {"content": "%s"}}]}' % t for t in (" ", "  ab ", " ", "cde", " ", "\\n")]
    rows = [(1, i, x) for i, x in enumerate(lines)] + [(2, i, x) for i, x in enumerate(spaced)] + [(3, 0, "data: [DONE]")]
    df = spark.createDataFrame(rows, "stream_id long, seq long, line string")
    assert {r.stream_id: r.output_tokens for r in capture.stream_usage(df).collect()} == {1: 2, 2: len("ab  cde") // 2}
    req = spark.createDataFrame([(s, f"msg_{s}", "m", 4) for s in (1, 3)], "stream_id long, message_id string, model string, input_tokens long")
    events = capture.block_events(df.filter("stream_id <> 2"), req).orderBy("stream_id", "phase", "seq").collect()
    names = [r.event for r in events if r.stream_id == 1]
    assert names == ["message_start", "content_block_start", "content_block_delta", "content_block_delta", "content_block_stop", "message_delta", "message_stop"]
    assert [json.loads(r.data)["delta"]["text"] for r in events if r.event == "content_block_delta"] == ["he", "llo"]
    end = json.loads(next(r.data for r in events if r.stream_id == 1 and r.event == "message_delta"))
    assert end == {"type": "message_delta", "delta": {"stop_reason": "end_turn", "stop_sequence": None}, "usage": {"output_tokens": 2}}
    assert [r.event for r in events if r.stream_id == 3] == ["message_start", "message_delta", "message_stop"]


def windows_plainly(times, size, most):
    start = count = None
    for t in times:
        if start is None or t - start > size:
            start, count = t, 0
        count += 1
        yield start, count <= most


def bucket_plainly(times, rate, burst):
    tokens, last = burst * 10**6, None
    for t in times:
        tokens = min(burst * 10**6, tokens + (0 if last is None else (t - last) * rate))
        last, ok = t, tokens >= 10**6
        tokens -= 10**6 * ok
        yield ok, tokens / 10**6


@pytest.mark.parametrize("chunk_rows", [7, 60, 10_000])
def test_limits_do_not_depend_on_chunks(spark, chunk_rows):
    rng = random.Random(11)
    events = {"hot": [], "cold": []}
    t = 0
    for _ in range(900):
        t += rng.choice([0, 1000, 90_000, 400_000, 1_000_000, 5_000_000])
        events["hot" if rng.random() < 0.9 else "cold"].append(t)
    rows = [(k, i, x) for k, xs in events.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "key string, id long, ts_us long")
    got = limits.window_limit(df, 4, 6, chunk_rows).orderBy("key", "id").collect()
    for k, xs in events.items():
        want = list(windows_plainly(xs, 6_000_000, 4))
        assert [(r.window_start_us, r.allowed) for r in got if r.key == k] == want
    got = limits.token_bucket(df, 30, 15, chunk_rows).orderBy("key", "id").collect()
    assert limits.bucket_settings(30, 15) == (2, 3) and limits.bucket_settings(5, 100) == (1, 1)
    for k, xs in events.items():
        assert [(r.allowed, r.tokens) for r in got if r.key == k] == list(bucket_plainly(xs, 2, 3))


def test_long_text_never_reaches_the_clean_track(spark):
    text = "my password is hunter2 " * 60_000
    rows = [("s", 0, "user", text, None, None, 0, None, True), ("s", 1, "user", text, None, None, 0, None, False), ("s", 2, "user", "my password is pw", None, None, 0, None, True)]
    df = spark.createDataFrame(rows, "session_id string, seq long, role string, full_text string, clean_text string, placeholder string, timestamp_ms long, metadata string, redact boolean")
    usable, refused = tracks.valid(df, "redact")
    assert [r.seq for r in refused.collect()] == [0]
    assert {r.seq: "hunter2" in r.clean_text for r in tracks.ingest(usable, redact_flag="redact").collect()} == {1: True, 2: False}
    with pytest.raises(Exception, match="redaction limit"):
        tracks.ingest(df, redact_flag="redact").collect()


def test_several_queries_of_a_session(spark):
    rows = [("s", 0, "red apples grow"), ("s", 1, "blue whales swim"), ("s", 2, "green apples fall"), ("t", 0, "red whales")]
    messages = spark.createDataFrame(rows, "session_id string, index long, text string")
    asked = spark.createDataFrame([("s", 7, "apples"), ("s", 8, "whales"), ("t", 7, "red")], "session_id string, query_id long, query string")
    got = {}
    for r in select_context(messages, asked, top_k=2, query_id="query_id").collect():
        got.setdefault((r.session_id, r.query_id), []).append((r.rank, r["index"]))
    alone = {}
    for s, q, text in asked.collect():
        one = spark.createDataFrame([(s, text)], "session_id string, query string")
        alone[s, q] = sorted((r.rank, r["index"]) for r in select_context(messages, one, top_k=2).collect())
    assert {k: sorted(v) for k, v in got.items()} == alone and alone["s", 8][0] == (1, 1)


def test_whole_requests_are_repaired(spark):
    given = {
        '{"a": 1}': {"a": 1}, "[null]": [None], '{"default": null, "a": {"default": null, "items": null}}': {"a": {"items": {"type": "string"}}},
        '{"tools": [{"name": "f", "description": "d", "cache": null, "input_schema": null}, 3, {"function": {"name": "g", "parameters": {"type": "object", "x": {"allOf": null}}}}]}':
            {"tools": [{"cache": None, "type": "function", "function": {"name": "f", "description": "d", "parameters": None}}, 3, {"function": {"name": "g", "parameters": {"type": "object", "required": [], "x": {"allOf": []}}}}]},
        '{"tools": null, "messages": [{"context": null, "type": "object"}]}': {"tools": None, "messages": [{"context": [], "type": "object", "required": []}]},
    }
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(given)] + [(90, None), (91, "null {"), (92, "{null"), (93, "")], "i long, b string")
    got = {r.b: r.f for r in rows.select("b", H.repair_request(F.col("b")).alias("f")).collect()}
    assert {b: json.loads(got[b]) for b in given} == given and all(got[b] == b for b in (None, "null {", "{null", ""))


def test_many_queries_share_one_index(spark):
    """As one query at a time, zero scores included; the texts are taken apart once and no text is copied for a query."""
    rng = random.Random(8)
    words = ["red", "apples", "grow", "blue", "whales", "swim", "über", "北京市", "x_1"]
    rows = [(f"s{s}", i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for s in range(3) for i in range(12)]
    messages = spark.createDataFrame(rows, "session_id string, index long, text string")
    asks = [(f"s{q % 4}", q, rng.choice([" ", "nothing here", "red whales", "北京 apples grow", "x_1 x_1"])) for q in range(6)]
    asked = spark.createDataFrame(asks, "session_id string, query_id long, query string")
    for k, least in ((3, 0.0), (20, 0.1)):
        got = {}
        for r in select_context(messages, asked, k, least, query_id="query_id").collect():
            got.setdefault(r.query_id, []).append((r.rank, r["index"], r.text, round(r.score, 9)))
        for s, q, query in asks:
            one = spark.createDataFrame([(s, query)], "session_id string, query string")
            want = sorted((r.rank, r["index"], r.text, round(r.score, 9)) for r in select_context(messages, one, k, least).collect())
            assert sorted(got.get(q, [])) == want, (q, query)
