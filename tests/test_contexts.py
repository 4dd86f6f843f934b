"""Contexts redacted and restored as a whole: text and messages, parts, errors, tokens, mappings."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from quietlog.functions.context import redact_context, restore_context
from quietlog.functions.payload import parse_object

TAG = "[REDACTED:PASSWORD]"


def redacted(spark, *payloads):
    rows = spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p, ensure_ascii=False)) for i, p in enumerate(payloads)], "id long, body string")
    return [r.redaction for r in redact_context(rows.withColumn("payload", parse_object(F.col("body")))).orderBy("id").collect()]


def restored(spark, *payloads, continued=False):
    rows = spark.createDataFrame([(i, json.dumps(p, ensure_ascii=False)) for i, p in enumerate(payloads)], "id long, body string")
    return [r.restoration for r in restore_context(rows.withColumn("payload", parse_object(F.col("body"))), continued=continued).orderBy("id").collect()]


def opened(token):
    return json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))


def test_text(spark):
    one, two = redacted(spark, {"context": "my password is abc123"}, {"text": "no secret &lt; here", "messages": "my password is q9"})
    assert (one.mode, one.redacted_context, one.mapping) == ("text", f"my password is {TAG}", {"abc123": TAG})
    assert (one.segments_processed, one.redacted_values, one.error) == (1, 1, None)
    assert opened(one.restore_token) == {"v": 1, "replacements": [{"original": "abc123", "tag": TAG}]}
    assert two.redacted_context == f"my password is {TAG}"  # messages come before text


MESSAGES = [
    {"role": "user", "content": "my password is abc123", "extra": [1, {"b": None}]},
    {"role": "user", "content": [{"type": "text", "text": "password: <zz&y>"}, {"type": "image", "url": "u", "text": None}, "plain password is free", 7, {"text": 5}]},
    {"role": "tool"}, {"role": "x", "content": None}, {"role": "y", "content": {"text": "password is kept"}}, {"content": "no secret"}, {"content": "his password is abc123"},
]


def test_messages(spark):
    (r,) = redacted(spark, {"messages": MESSAGES})
    want = json.loads(json.dumps(MESSAGES))
    want[0]["content"] = f"my password is {TAG}"
    want[1]["content"][0]["text"] = f"password: {TAG}"
    want[6]["content"] = f"his password is {TAG}"
    assert json.loads(r.redacted_context) == want and r.mode == "messages"
    assert r.mapping == {"abc123": TAG, "<zz&y>": TAG} and (r.segments_processed, r.redacted_values) == (4, 2)
    token = opened(r.restore_token)
    assert token["mapping"] == r.mapping and [x["original"] for x in token["replacements"]] == ["abc123", "<zz&y>", "abc123"]
    back = {"redacted_messages": json.loads(r.redacted_context), "restore_token": r.restore_token}
    fresh, on, html = *restored(spark, back), *restored(spark, back, continued=True), *restored(spark, back | {"html_escape": True}, continued=True)
    assert json.loads(on.restored_context) == MESSAGES and (on.segments_processed, on.mapping_size) == (4, 2)
    assert json.loads(fresh.restored_context)[1]["content"][0]["text"] == "password: abc123"  # each segment begins anew
    assert json.loads(html.restored_context)[1]["content"][0]["text"] == "password: &lt;zz&amp;y&gt;"


def test_nothing_to_redact_comes_back_unchanged(spark):
    bodies = [{"messages": []}, {"context": [{"content": "hello"}]}, {"messages": [{"content": []}, {}]}]
    for body, r in zip(bodies, redacted(spark, *bodies), strict=True):
        assert json.loads(r.redacted_context) == next(iter(body.values())) and r.mapping == {} and opened(r.restore_token)["replacements"] == []


LONG = "x" * (1024 * 1024 + 1)


@pytest.mark.parametrize("payload,error", [
    ({"other": 1}, "missing field: context"), ({"context": None, "text": "a"}, "context must be string or list"), ({"messages": {"a": 1}}, "context must be string or list"),
    ({"messages": [{"content": "a"}, "b"]}, "each message must be object"), ({"messages": [None]}, "each message must be object"),
    ({"text": LONG}, f"input text too long: {len(LONG)}"), ({"messages": [{"content": LONG}, 4]}, f"input text too long: {len(LONG)}"), ({"messages": [4, {"content": LONG}]}, "each message must be object"),
])
def test_errors(spark, payload, error):
    (r,) = redacted(spark, payload)
    assert r.error == error and [r.mode, r.redacted_context, r.mapping, r.restore_token, r.segments_processed, r.redacted_values] == [None] * 6


def test_payloads_that_are_no_objects(spark):
    assert [r.error for r in redacted(spark, "[]", "{", "")] == ["missing field: context"] * 3


def test_options_of_the_payload(spark):
    text = "mail ann@example.com now"
    on, off = redacted(spark, {"text": text}, {"text": text, "options": {"email": False}})
    assert off.redacted_context == text and on.redacted_context == "mail [REDACTED:EMAIL] now"


def test_restoring(spark):
    given = {"context": f"a {TAG} b {TAG} c {TAG}", "mapping": {"z": TAG, "b": TAG, "n": 5}}
    one, none, bad, blank, lost = restored(
        spark, given, {"text": "x"}, {"text": "x", "restore_token": "?!"}, {"text": f"{TAG}", "restore_token": " ", "mapping": {"q": TAG}}, {"mapping": {}}
    )
    assert (one.restored_context, one.mapping_size) == (f"a b b z c {TAG}", 3)
    assert (none.error, bad.error, lost.error) == ("missing field: mapping", "invalid restore_token", "missing field: context")
    assert blank.restored_context == "q"
    (r,) = restored(spark, {"messages": ["a"], "mapping": {}})
    assert r.error == "each message must be object"
