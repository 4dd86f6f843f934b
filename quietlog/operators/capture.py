"""Server-sent-event captures: lines (stream_id, seq, line) to chunks, usage and block events.

A stream may be of any length: nothing here gathers a stream into one row or one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlog.functions.chat import map_finish_reason
from quietlog.functions.payload import parse_object, vget, vkind, vstring
from quietlog.functions.text import SPACE_CHARS, let, pin
from quietlog.functions.tokens import response_text, usage_tokens, whole
from quietlog.session import staged

DATA, DONE = "data: ", "[DONE]"


def ends_stream(line: Column) -> Column:
    return F.coalesce(line == DATA + DONE, F.lit(True))


def chunk_of(line: Column) -> Column:
    """The object in a data line, as a variant; null for any other line."""
    return F.when(line.startswith(DATA) & (line != DATA + DONE), parse_object(F.substr(line, F.lit(len(DATA) + 1))))


def chunks(lines: DataFrame) -> DataFrame:
    """Parsed chunks (stream_id, seq, chunk variant) ahead of the first [DONE]; other lines are dropped.

    A null line, one too long to read, ends a stream as [DONE] does.
    """
    done = lines.filter(ends_stream(F.col("line"))).groupBy("stream_id").agg(F.min("seq").alias("done_seq"))
    return (
        lines.filter(F.col("line").startswith(DATA))
        .join(done, "stream_id", "left")
        .filter(F.col("done_seq").isNull() | (F.col("seq") < F.col("done_seq")))
        .select("stream_id", "seq", pin(chunk_of(F.col("line"))).alias("chunk"))
        .filter(F.col("chunk").isNotNull())
    )


def trimmed_chars(texts: DataFrame) -> DataFrame:
    """(stream_id, chars): characters of the trimmed concatenation of `text` over a stream, without building it.

    Outer white space is what stands before the first and after the last piece that is not blank.
    """
    t = F.col("text")
    pieces = texts.select(
        "stream_id",
        "seq",
        F.char_length(t).alias("len"),
        (F.btrim(t, F.lit(SPACE_CHARS)) == "").alias("blank"),
        (F.char_length(t) - F.char_length(F.ltrim(t, F.lit(SPACE_CHARS)))).alias("lead"),
        (F.char_length(t) - F.char_length(F.rtrim(t, F.lit(SPACE_CHARS)))).alias("trail"),
    ).filter("len > 0")
    at = F.when(~F.col("blank"), F.col("seq"))
    bounds = pieces.groupBy("stream_id").agg(
        F.sum("len").alias("total"),
        F.min(at).alias("first"),
        F.max(at).alias("last"),
        F.min_by("lead", at).alias("lead"),
        F.max_by("trail", at).alias("trail"),
    )
    outside = (
        pieces.filter("blank")
        .select("stream_id", "seq", "len")
        .join(bounds.select("stream_id", "first", "last"), "stream_id")
        .filter("seq < first OR seq > last")
        .groupBy("stream_id")
        .agg(F.sum("len").alias("outer"))
    )
    chars = F.col("total") - F.col("lead") - F.col("trail") - F.coalesce("outer", F.lit(0))
    return bounds.join(outside, "stream_id", "left").select("stream_id", F.coalesce(chars, F.lit(0)).alias("chars"))


def stream_usage(lines: DataFrame) -> DataFrame:
    """Output tokens per stream: the last reported usage, or half the characters of the text if that is 0."""
    parsed = chunks(lines).select(
        "stream_id", "seq", usage_tokens(F.col("chunk")).alias("tokens"), pin(response_text(F.col("chunk"))).alias("text")
    )
    parsed = staged(parsed, "chunks")  # JSON is parsed once for the passes below
    reported = parsed.groupBy("stream_id").agg(
        F.max_by("tokens", F.when(F.col("tokens").isNotNull(), F.col("seq"))).alias("reported"), F.count("*").alias("n_chunks")
    )
    return (
        reported.join(trimmed_chars(parsed.select("stream_id", "seq", "text")), "stream_id", "left")
        .select(
            "stream_id",
            "n_chunks",
            F.coalesce(
                F.nullif("reported", F.lit(0).cast("long")), F.floor(F.coalesce("chars", F.lit(0)) / 2), F.lit(0)
            ).cast("long").alias("output_tokens"),
        )
    )


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def block_pieces(rows: DataFrame) -> DataFrame:
    """Rows with a `chunk`, which becomes text (empty if none), finish and tokens."""
    first = let(vget(F.col("chunk"), "$.choices[0]"), lambda c: F.when(vkind(c) == "OBJECT", c))
    return rows.withColumn("choice", pin(first)).select(
        *(c for c in rows.columns if c != "chunk"),
        F.coalesce(vstring(F.col("choice"), "$.delta.content"), F.lit("")).alias("text"),
        let(
            vget(F.col("choice"), "$.finish_reason"),
            lambda r: F.when(r.isNotNull() & (vkind(r) != "VOID"), F.coalesce(F.when(vkind(r) == "STRING", vget(r, "$", "string")), F.lit(""))),
        ).alias("finish"),
        whole(F.col("chunk"), "$.usage.completion_tokens").alias("tokens"),
    )


def event_data() -> Column:
    """The data of a block event: from its name, text, finish, out (output tokens), message_id, model and input_tokens."""
    null = F.lit(None).cast("string")
    message = F.struct(
        F.array().cast("array<string>").alias("content"), F.col("message_id").alias("id"), F.col("model").alias("model"),
        F.lit("assistant").alias("role"), null.alias("stop_reason"), null.alias("stop_sequence"), F.lit("message").alias("type"),
        F.struct(F.col("input_tokens").alias("input_tokens"), F.lit(0).alias("output_tokens")).alias("usage"),
    )
    stop = F.when(F.col("finish").isNull(), "end_turn").otherwise(map_finish_reason(F.col("finish")))
    name = F.col("event")
    fields = {
        "message_start": {"message": message},
        "content_block_start": {"content_block": F.struct(F.lit("").alias("text"), F.lit("text").alias("type")), "index": F.lit(0)},
        "content_block_delta": {"delta": F.struct(F.col("text").alias("text"), F.lit("text_delta").alias("type")), "index": F.lit(0)},
        "content_block_stop": {"index": F.lit(0)},
        "message_delta": {"delta": F.struct(stop.alias("stop_reason"), null.alias("stop_sequence")), "usage": F.struct(F.col("out").alias("output_tokens"))},
        "message_stop": {},
    }
    out = F.lit(None).cast("string")
    for event, own in fields.items():
        named = dict(sorted((own | {"type": F.lit(event)}).items()))
        out = F.when(name == event, _json(**named)).otherwise(out)
    return out


def block_events(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """Block-style events of chat streams: rows (stream_id, phase, seq, event, data), in that order.

    `requests`: one row per stream with message_id, model and input_tokens.  Text pieces become
    delta rows where they are; the other events come from one aggregate per stream.
    """
    parsed = staged(block_pieces(chunks(lines).select("stream_id", "seq", "chunk")), "chunks")
    per_stream = parsed.groupBy("stream_id").agg(
        F.max_by("finish", F.when(F.col("finish").isNotNull(), F.col("seq"))).alias("finish"),
        F.max_by("tokens", F.when(F.col("tokens") > 0, F.col("seq"))).alias("tokens"),
        F.count_if(F.col("text") != "").alias("pieces"),
    )
    texts = parsed.filter(F.col("text") != "").select("stream_id", "seq", "text")
    frames = (
        requests.join(per_stream, "stream_id", "left")
        .join(trimmed_chars(texts), "stream_id", "left")
        .withColumn("out", F.coalesce("tokens", F.floor(F.coalesce("chars", F.lit(0)) / 2)).cast("long"))
    )
    started = F.coalesce("pieces", F.lit(0)) > 0
    event = lambda phase, name: F.struct(F.lit(phase).alias("phase"), F.lit(name).alias("event"))
    opening, closing = [event(0, "message_start")], [event(4, "message_delta"), event(5, "message_stop")]
    block = [event(1, "content_block_start"), event(3, "content_block_stop")]
    names = F.when(started, F.array(*opening, *block, *closing)).otherwise(F.array(*opening, *closing))
    null = F.lit(None).cast("string")
    frame_rows = frames.withColumn("e", F.explode(names)).select(
        "stream_id", "e.phase", F.lit(0).cast("long").alias("seq"), "e.event", null.alias("text"), "finish", "out", "message_id", "model", "input_tokens"
    )
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in frame_rows.schema.fields}
    delta_rows = texts.select(
        "stream_id", F.lit(2).alias("phase"), F.col("seq").cast("long").alias("seq"), F.lit("content_block_delta").alias("event"), "text",
        *(none[c] for c in ("finish", "out", "message_id", "model", "input_tokens")),
    )
    return frame_rows.unionByName(delta_rows).select("stream_id", "phase", "seq", "event", event_data().alias("data"))
