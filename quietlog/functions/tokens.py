"""Token estimates and response text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietlog.functions.text import let, trim_space


def text_tokens(text: Column) -> Column:
    """Characters of the trimmed text, halved."""
    return F.floor(F.coalesce(F.char_length(trim_space(text)), F.lit(0)) / 2).cast("int")


def message_bytes(content: Column) -> Column:
    """Bytes of the string content of one message; none without one."""
    return F.coalesce(F.octet_length(content), F.lit(0)).cast("long")


def input_tokens_of(payload: Column) -> Column:
    """Bytes of all string message contents of a request, halved; block contents do not count."""
    from quietlog.functions.payload import vget, vstring

    sizes = F.transform(vget(payload, "$.messages", "array<variant>"), lambda m: message_bytes(vstring(m, "$.content")))
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.floor(F.coalesce(total, F.lit(0).cast("long")) / 2).cast("int")


def whole(v: Column, path: str) -> Column:
    """JSON number truncated to an integer; null when it is not a number."""
    from quietlog.functions.payload import vget, vkind

    numeric = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    return let(vget(v, path), lambda x: F.when(vkind(x).isin(*numeric), vget(x, "$", "double").cast("long")))


TEXT_KEYS = ("output_text", "content", "text", "message", "delta")


# a message or delta, and a choice, with all fields that could hold text
PART = "struct<content:variant,output_text:variant,text:variant,message:variant,delta:variant,choices:variant>"
CHOICE = PART


@F.arrow_udf(T.StringType())
def _response_text_batch(bodies):
    """Depth-first text of responses of any shape."""
    import json

    import pyarrow as pa

    def text(v):
        if isinstance(v, str):
            return v
        if isinstance(v, list):
            return "".join(map(text, v))
        if isinstance(v, dict):
            return "".join(text(v[k]) for k in (*TEXT_KEYS, "choices") if k in v)
        return ""

    return pa.array([None if b is None else text(json.loads(b)) for b in bodies.to_pylist()], pa.string())


def response_text(v: Column) -> Column:
    """Text of a response in the order output_text, content, text, message, delta, then choices.

    The usual shape, choices[] > message or delta > content string, stays in the JVM; anything else,
    at whatever depth, goes through an Arrow function.
    """
    from quietlog.functions.payload import as_text, vget

    def absent(*values):
        return F.coalesce(*values).isNull()

    def piece(given, p):
        """Text of a message or delta; null where its shape is not the usual one."""
        text = as_text(p.content)
        flat = p.isNotNull() & absent(p.output_text, p.text, p.message, p.delta, p.choices)
        none = p.content.isNull() | F.is_variant_null(p.content)
        return F.when(given.isNull(), "").when(flat & none, "").when(flat, text)

    def choice_text(s):
        c = s.c
        flat = c.isNotNull() & absent(c.output_text, c.content, c.text, c.choices)
        return F.when(flat, F.concat(piece(c.message, s.m), piece(c.delta, s.d)))

    def opened(c):
        return F.struct(c.alias("c"), vget(c.message, "$", PART).alias("m"), vget(c.delta, "$", PART).alias("d"))

    # one flat step after the other: Arrow arguments must not hold lambdas inside lambdas
    plain = absent(*[vget(v, f"$.{k}") for k in TEXT_KEYS])
    texts = F.transform(F.transform(vget(v, "$.choices", f"array<{CHOICE}>"), opened), choice_text)
    usual_text = F.when(plain, F.aggregate(texts, F.lit(""), lambda a, t: F.concat(a, t)))
    odd = _response_text_batch(F.when(usual_text.isNull(), F.to_json(v)))
    return F.coalesce(usual_text, odd, F.lit(""))


def usage_tokens(v: Column) -> Column:
    """usage.completion_tokens, else usage.total_tokens; null without either."""
    return F.coalesce(whole(v, "$.usage.completion_tokens"), whole(v, "$.usage.total_tokens"))


def output_tokens(body: Column, v: Column) -> Column:
    """Reported tokens; 0 or none falls back to the response text, then to the raw body."""
    reported = F.nullif(usage_tokens(v), F.lit(0).cast("long"))
    from_text = F.nullif(text_tokens(response_text(v)).cast("long"), F.lit(0).cast("long"))
    return F.coalesce(reported, from_text, text_tokens(body).cast("long")).cast("int")
