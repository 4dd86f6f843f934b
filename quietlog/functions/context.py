"""Redaction of a whole context, text or messages, and its way back.

A context is the first of the context keys of a payload.  The texts of messages are segments with an address; they are
redacted or restored in the row, and go back to their addresses in one rewrite of the value, which is skipped where no
segment changes.  A payload that can't be handled gives an error instead of a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlog.functions import rules as R
from quietlog.functions.payload import context_payload, request_options, vget, vkind, vstring, write_back
from quietlog.functions.redact import OPEN, mapping_of, redact_normalized
from quietlog.functions.restore import decode_token, encode_token, mapping_replacements, restore
from quietlog.functions.text import is_blank, let, normalize_each, pin
from quietlog.schemas import REPLACEMENTS

SEGMENTS = "array<struct<addr:string,text:string>>"
#: fixed values: errors
NO_CONTEXT, BAD_CONTEXT, BAD_MESSAGE = "missing field: context", "context must be string or list", "each message must be object"
TOO_LONG, NO_MAPPING, BAD_TOKEN = "input text too long: ", "missing field: mapping", "invalid restore_token"
RESERVED = "text holds a reserved character"


def segments(messages: Column) -> Column:
    """The texts of a variant array of messages, by address: contents that are strings, and the text of content parts."""

    def one(addr: Column, text: Column) -> Column:
        return F.struct(addr.alias("addr"), text.alias("text"))

    def of_parts(parts: Column, at: Column) -> Column:
        found = F.transform(
            F.coalesce(parts, F.array().cast("array<variant>")),
            lambda p, j: F.when(vkind(p) == "OBJECT", one(F.concat(at, F.lit("/"), j.cast("string"), F.lit("/text")), vstring(p, "$.text"))),
        )
        return F.filter(found, lambda s: s.text.isNotNull())

    def of_message(m: Column, i: Column) -> Column:
        at = F.concat(F.lit("/"), i.cast("string"), F.lit("/content"))
        content = F.when(vkind(m) == "OBJECT", vget(m, "$.content"))
        return let(
            content,
            lambda c: F.when(vkind(c) == "STRING", F.array(one(at, vget(c, "$", "string"))))
            .when(vkind(c) == "ARRAY", of_parts(vget(c, "$", "array<variant>"), at))
            .otherwise(F.array().cast(SEGMENTS)),
        )

    items = vget(messages, "$", "array<variant>")
    return F.flatten(F.transform(F.coalesce(items, F.array().cast("array<variant>")), of_message))


def _opened(df: DataFrame, payload: str) -> DataFrame:
    """Add `_mode`, `_value` (variant) and `_segments` of the context, and `_bad`: the place of the first message that is no object."""
    picked = df.withColumn("_picked", pin(context_payload(F.col(payload)))).withColumns({"_mode": F.col("_picked.mode"), "_value": F.col("_picked.value")})
    text = F.array(F.struct(F.lit("").alias("addr"), vget(F.col("_value"), "$", "string").alias("text")))
    items = F.coalesce(vget(F.col("_value"), "$", "array<variant>"), F.array().cast("array<variant>"))
    bad = F.array_min(F.filter(F.transform(items, lambda m, i: F.when(vkind(m) != "OBJECT", i)), lambda i: i.isNotNull()))
    found = F.when(F.col("_mode") == "text", text).when(F.col("_mode") == "messages", segments(F.col("_value"))).otherwise(F.array().cast(SEGMENTS))
    return picked.withColumns({"_segments": pin(found), "_bad": F.when(F.col("_mode") == "messages", bad)}).drop("_picked")


def _context_error() -> Column:
    return F.when(F.col("_mode") == "missing", NO_CONTEXT).when(F.col("_mode") == "error", BAD_CONTEXT)


def _put_back(changes: Column) -> Column:
    """The context with new texts: a string as it is, messages as JSON."""
    return F.when(F.col("_mode") == "text", F.get(changes, F.lit(0)).text).otherwise(write_back(F.to_json(F.col("_value")), changes))


def _changed(segments: Column, new: Column) -> Column:
    """Of segments with new texts (array<string>), what differs."""
    pairs = F.zip_with(segments, new, lambda s, t: F.struct(s.addr.alias("addr"), t.alias("text"), (s.text != t).alias("differs")))
    return F.transform(F.filter(pairs, lambda p: p.differs | (p.addr == "")), lambda p: F.struct(p.addr.alias("addr"), p.text.alias("text")))


def redact_context(df: DataFrame, payload: str = "payload", configured=R.DEFAULT_ON, rules: R.Rules = R.Rules(), into: str = "redaction") -> DataFrame:
    """Add `into`: struct<mode, redacted_context, mapping, restore_token, segments_processed, redacted_values, error>.

    `payload` is a variant, whose own redaction options count over the configured ones.  Messages come back as JSON.  The
    first message that is no object, or text above the size limit, in reading order, is the error, and nothing else is given.
    """
    options = {n: pin(c) for n, c in request_options(F.col(payload), configured).items()}
    opened = _opened(df, payload).withColumns({f"_{n}": c for n, c in options.items()})
    columns = {n: F.col(f"_{n}") for n in options}
    sizes = F.transform("_segments", lambda s: F.struct(F.get(F.split(s.addr, "/"), F.lit(1)).cast("int").alias("at"), F.octet_length(s.text).alias("size")))
    long = let(F.filter(sizes, lambda s: s["size"] > R.MAX_TEXT_BYTES), lambda a: F.get(a, F.lit(0)))
    first_long = F.when(F.col("_bad").isNull() | (F.col("_long.at") < F.col("_bad")), F.concat(F.lit(TOO_LONG), F.col("_long.size").cast("string")))
    error = F.coalesce(_context_error(), first_long, F.when(F.col("_bad").isNotNull(), BAD_MESSAGE))
    read = opened.withColumn("_long", pin(long)).withColumn("_error", pin(error))
    usable = F.when(F.col("_error").isNull(), F.col("_segments"))
    read = read.withColumn("_texts", pin(normalize_each(F.transform(usable, lambda s: s.text))))
    done = read.withColumn("_done", pin(F.transform("_texts", lambda t: redact_normalized(t, (), rules, columns))))
    done = done.withColumn("_all", pin(F.flatten(F.transform("_done", lambda d: d.replacements))))
    done = done.withColumn("_mapping", pin(mapping_of(F.col("_all"))))
    token = F.when(F.col("_mode") == "text", encode_token(F.col("_all"))).otherwise(encode_token(F.col("_all"), F.col("_mapping")))
    changes = _changed(F.col("_segments"), F.transform("_done", lambda d: d.text))
    context = F.when(F.col("_error").isNull(), _put_back(changes))
    result = F.struct(
        F.when(F.col("_error").isNull(), F.col("_mode")).alias("mode"),
        F.col("_context").alias("redacted_context"),
        F.col("_mapping").alias("mapping"),
        F.when(F.col("_error").isNull(), token).alias("restore_token"),
        F.when(F.col("_error").isNull(), F.size("_segments")).cast("long").alias("segments_processed"),
        F.size("_mapping").cast("long").alias("redacted_values"),
        F.col("_error").alias("error"),
    )
    out = done.withColumn("_context", pin(context)).withColumn(into, result)
    return out.drop("_mode", "_value", "_segments", "_bad", "_long", "_error", "_texts", "_done", "_all", "_mapping", "_context", *(f"_{n}" for n in options))


def restore_context(df: DataFrame, payload: str = "payload", continued: bool = False, into: str = "restoration") -> DataFrame:
    """Add `into`: struct<mode, restored_context, segments_processed, mapping_size, error>.

    The payload brings a restore_token, or else a mapping, and may ask for html_escape.  Each segment takes the originals
    of a tag from the first one on; `continued` goes on where the segment before has ended, so that what `redact_context` made
    of several segments comes back as it was.
    """
    opened = _opened(df, payload)
    v = F.col(payload)
    token = vstring(v, "$.restore_token")
    given = let(vget(v, "$.mapping"), lambda m: F.when(vkind(m) == "OBJECT", m.cast("map<string,string>")))
    read = opened.withColumn("_token", pin(F.when(~is_blank(token), token))).withColumn("_decoded", pin(decode_token(F.col("_token"))))
    read = read.withColumn("_mapping", pin(F.when(F.col("_token").isNotNull(), F.col("_decoded.mapping")).otherwise(given)))
    listed = F.when(F.size(F.col("_decoded.replacements")) > 0, F.col("_decoded.replacements"))
    empty = F.array().cast(REPLACEMENTS)
    read = read.withColumn("_originals", pin(F.coalesce(listed, mapping_replacements(F.col("_mapping")), empty)))
    error = F.coalesce(
        _context_error(),
        F.when(F.col("_token").isNotNull() & F.col("_decoded").isNull(), BAD_TOKEN),
        F.when(F.col("_token").isNull() & given.isNull(), NO_MAPPING),
        F.when(F.col("_bad").isNotNull(), BAD_MESSAGE),
        F.when(F.exists("_segments", lambda s: s.text.contains(OPEN)), RESERVED) if continued else F.lit(None),
    )
    read = read.withColumn("_error", pin(error)).withColumn("_escape", F.coalesce(vget(v, "$.html_escape", "boolean"), F.lit(False)))
    texts = F.transform(F.when(F.col("_error").isNull(), F.col("_segments")), lambda s: s.text)

    def filled(escape: bool) -> Column:
        if continued:
            whole = restore(F.array_join(texts, OPEN), F.col("_originals"), escape)
            return F.when(F.size("_segments") > 0, F.split(whole, OPEN, -1)).otherwise(F.array().cast("array<string>"))
        return F.transform(texts, lambda t: restore(t, F.col("_originals"), escape))

    done = read.withColumn("_new", pin(F.when(F.col("_error").isNull(), F.when(F.col("_escape"), filled(True)).otherwise(filled(False)))))
    done = done.withColumn("_context", pin(F.when(F.col("_error").isNull(), _put_back(_changed(F.col("_segments"), F.col("_new"))))))
    ok = F.col("_error").isNull()
    result = F.struct(
        F.when(ok, F.col("_mode")).alias("mode"),
        F.col("_context").alias("restored_context"),
        F.when(ok, F.size("_segments")).cast("long").alias("segments_processed"),
        F.when(ok, F.coalesce(F.size("_mapping"), F.lit(0))).cast("long").alias("mapping_size"),
        F.col("_error").alias("error"),
    )
    return done.withColumn(into, result).drop("_mode", "_value", "_segments", "_bad", "_token", "_decoded", "_mapping", "_originals", "_error", "_escape", "_new", "_context")
