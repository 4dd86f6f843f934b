"""Queries over conversation formats and captures, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietlog.functions import chat as H
from quietlog.functions.payload import parse_object, vget, vstring
from quietlog.functions.text import pin
from quietlog.operators import capture
from quietlog.plans import data
from quietlog.session import scratch
from quietlog.sources.captures import numbered_lines, read_captures, stream_captures, write_captures
from quietlog.streaming import jobs

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# block-style requests, one per conversation turn
BLOCKS = """
select id, conv_id, turn, role, text,
  '{"model": "claude-3", "max_tokens": ' || turn || ', "temperature": 0.5, "stop_sequences": ["s' || turn || '"], '
  || case id % 3 when 0 then '"system": ' || {jq:text} || ', ' when 1 then '"system": [{"type": "text", "text": "sys"}, {"type": "text", "text": " "}, "tail"], ' else '' end
  || '"tools": [{"name": "t' || turn || '", "description": "does ' || turn || '", "input_schema": {"type": "object", "properties": null, "required": ["a"]}}], '
  || '"tool_choice": ' || case id % 4 when 0 then '{"type": "auto"}' when 1 then '{"type": "any"}' when 2 then '{"type": "tool", "name": "t' || turn || '"}' else '"none"' end
  || ', "messages": [{"role": ' || {jq:role} || ', "content": [{"type": "text", "text": ' || {jq:text} || '}, {"type": "text", "text": "more"}'
  || ', {"type": "tool_use", "id": "u' || id || '", "name": "n", "input": {"b": ' || turn || ', "a": "x"}}'
  || case id % 5 when 0 then '' when 1 then ', {"type": "tool_result", "tool_use_id": "r' || id || '", "content": "done"}'
    when 2 then ', {"type": "tool_result", "tool_use_id": "r' || id || '", "content": [{"type": "text", "text": "a"}, {"text": "b"}]}, {"type": "tool_result", "content": "two"}, {"text": "after"}'
    when 3 then ', "stray", {"type": "image"}, {"content": [{"content": {"text": "deep' || id || '"}}, " "]}' else ', {"text": "  "}' end
  || ']}, {"content": "plain ' || id || '"}, 5, {"role": "user", "content": []}]}' as body
from (select conv_id * 1000 + turn as id, conv_id, turn, role, text from conversations) c
"""


def blocks(spark, sf):
    return data._sql(spark, sf, data.spark_text(BLOCKS), "conversations")


# DuckDB: text of a block at any of the depths the requests above have
_ITEM = "coalesce(case when json_type({x}) = 'VARCHAR' then json_extract_string({x}, '$') end, json_extract_string({x}, '$.text'), case when json_type({x}, '$.content') = 'VARCHAR' then json_extract_string({x}, '$.content') end, json_extract_string({x}, '$.content.text'), '')"


def _content(x: str) -> str:
    def joined(arr):
        item = _ITEM.replace("{x}", "e")
        return f"array_to_string(list_filter(list_transform(json_extract({arr}, '$[*]'), lambda e: {item}), lambda v: trim(v) <> ''), chr(10))"

    inner = f"json_extract({x}, '$.content')"
    one = _ITEM.replace("{x}", x)
    return (
        f"case when {x} is null then '' when json_type({x}) = 'ARRAY' then {joined(x)}"
        f" when json_type({x}, '$.text') is null and json_type({x}, '$.content') = 'ARRAY' then {joined(inner)} else {one} end"
    )


REQ = f"""with blocks as ({data.duck_text(BLOCKS)}), msgs as (select id, unnest(json_extract(body, '$.messages[*]')) as m,
    generate_subscripts(json_extract(body, '$.messages[*]'), 1) as mi from blocks),
  bl as (select id, mi, coalesce(nullif(json_extract_string(m, '$.role'), ''), 'user') as role, unnest(json_extract(m, '$.content[*]')) as b,
    generate_subscripts(json_extract(m, '$.content[*]'), 1) as pos from msgs where json_type(m, '$.content') = 'ARRAY'),
  typed as (select *, coalesce(json_extract_string(b, '$.type'), '') as kind from bl where json_type(b) = 'OBJECT'),
  runs as (select *, sum(case when kind = 'tool_result' then 1 else 0 end) over (partition by id, mi order by pos) as run, {_content('b')} as txt from typed),
  texts as (select id, mi, any_value(role) as role, run, string_agg(txt, chr(10) order by pos) as txt from runs
    where kind not in ('tool_use', 'tool_result') and trim(txt) <> '' group by id, mi, run),
  results as (select id, mi, run, {_content("json_extract(b, '$.content')")} as content, coalesce(json_extract_string(b, '$.tool_use_id'), '') as call from runs where kind = 'tool_result'),
  uses as (select id, mi, string_agg(json_extract_string(b, '$.name') || ':' || json_extract_string(b, '$.id'), ',' order by pos) as calls from runs
    where kind = 'tool_use' and role = 'assistant' group by id, mi),
  last as (select id, mi, role, (select count(*) from results r where r.id = x.id and r.mi = x.mi) as run from
    (select distinct id, mi, coalesce(nullif(json_extract_string(m, '$.role'), ''), 'user') as role from msgs where json_type(m, '$.content') = 'ARRAY') x),
  rows as (select t.id, t.role, t.txt as content, '' as call, '' as calls from texts t join last l on l.id = t.id and l.mi = t.mi where t.run < l.run
    union all select id, 'tool', content, call, '' from results
    union all select l.id, l.role, coalesce(t.txt, ''), '', coalesce(u.calls, '') from last l left join texts t on t.id = l.id and t.mi = l.mi and t.run = l.run
      left join uses u on u.id = l.id and u.mi = l.mi where coalesce(t.txt, '') <> '' or u.calls is not null
    union all select id, coalesce(nullif(json_extract_string(m, '$.role'), ''), 'user'), json_extract_string(m, '$.content'), '', '' from msgs
      where json_type(m) = 'OBJECT' and json_type(m, '$.content') = 'VARCHAR'),
  sys as (select id, {_content("json_extract(body, '$.system')")} as content from blocks)"""


@query("message_blocks_flatten", f"{REQ} select id, role, content, call as tool_call_id, calls from rows")
def message_blocks_flatten(spark, sf):
    flat = blocks(spark, sf).withColumn("v", pin(H.flat_request(F.col("body"))))
    df = flat.select("id", F.explode(H.flatten_messages(F.col("v"))).alias("m"))
    def shown(call):
        v = F.try_parse_json(call)
        return F.concat(vget(v, "$.function.name", "string"), F.lit(":"), vget(v, "$.id", "string"))

    calls = F.transform("m.tool_calls", shown)
    return df.select(
        "id", "m.role", "m.content", F.coalesce("m.tool_call_id", F.lit("")).alias("tool_call_id"),
        F.coalesce(F.array_join(calls, ","), F.lit("")).alias("calls"),
    )


@query(
    "blocks_to_chat",
    f"""{REQ}, counts as (select id, count(*) as n from rows group by 1) select b.id, 'claude-3' as model, turn as max_tokens, 's' || turn as stop,
      (case when trim(s.content) <> '' then 1 else 0 end + coalesce(c.n, 0))::bigint as n_messages,
      case when trim(s.content) <> '' then s.content end as system, '0.5' as temperature
    from blocks b join sys s using (id) left join counts c using (id)""",
)
def blocks_to_chat(spark, sf):
    df = H.with_chat_request(blocks(spark, sf)).withColumn("v", pin(parse_object(F.col("chat_body"))))
    # some turns have the role system themselves; only the lead message is meant
    first = F.when((F.col("id") % 3 < 2) & (vstring(F.col("v"), "$.messages[0].role") == "system"), vstring(F.col("v"), "$.messages[0].content"))
    return df.select(
        "id",
        vstring(F.col("v"), "$.model").alias("model"),
        vget(F.col("v"), "$.max_tokens", "bigint").alias("max_tokens"),
        vget(F.col("v"), "$.stop[0]", "string").alias("stop"),
        F.size(vget(F.col("v"), "$.messages", "array<variant>")).cast("long").alias("n_messages"),
        first.alias("system"),
        vget(F.col("v"), "$.temperature", "string").alias("temperature"),
    )


@query(
    "content_text",
    f"""{REQ} select id, content as system, (select string_agg(txt, '|' order by mi, pos) from runs r where r.id = sys.id and kind not in ('tool_use', 'tool_result') and trim(txt) <> '') as texts from sys""",
)
def content_text(spark, sf):
    v = F.col("v")
    df = blocks(spark, sf).withColumn("v", pin(H.flat_request(F.col("body"))))
    parts = F.filter(
        vget(v, "$.messages[0].content", "array<variant>"),
        lambda b: ~F.coalesce(vstring(b, "$.type"), F.lit("")).isin("tool_use", "tool_result") & (F.schema_of_variant(b) != "STRING"),
    )
    texts = F.filter(F.transform(parts, H.content_text), lambda t: F.trim(t) != "")
    return df.select("id", F.coalesce(H.content_text(vget(v, "$.system")), F.lit("")).alias("system"), F.array_join(texts, "|").alias("texts"))


@query(
    "tool_schema_convert",
    "select conv_id * 1000 + turn as id, 'function' as type, 't' || turn as name, 'does ' || turn as description,"
    """ '{"properties":{},"required":["a"],"type":"object"}' as parameters from conversations""",
)
def tool_schema_convert(spark, sf):
    tools = H.tools_as_functions(F.transform(vget(parse_object(F.col("body")), "$.tools", "array<variant>"), lambda t: F.to_json(t)))
    df = blocks(spark, sf).select("id", F.explode(tools).alias("t")).withColumn("v", pin(F.try_parse_json("t")))
    return df.select(
        "id",
        vstring(F.col("v"), "$.type").alias("type"),
        vstring(F.col("v"), "$.function.name").alias("name"),
        vstring(F.col("v"), "$.function.description").alias("description"),
        F.to_json(vget(F.col("v"), "$.function.parameters")).alias("parameters"),
    )


@query(
    "tool_choice_convert",
    """select conv_id * 1000 + turn as id, case (conv_id * 1000 + turn) % 4 when 0 then '"auto"' when 1 then '"required"'
      when 2 then '{"type":"function","function":{"name":"t' || turn || '"}}' else '"none"' end as tool_choice from conversations""",
)
def tool_choice_convert(spark, sf):
    v = parse_object(F.col("body"))
    return blocks(spark, sf).select("id", H.tool_choice(vget(v, "$.tool_choice")).alias("tool_choice"))


@query(
    "schema_null_fix",
    """select case turn % 4 when 0 then '{"properties":{},"required":[],"type":"object"}'
      when 1 then '{"anyOf":[null,{"enum":[]}],"items":{"type":"string"},"type":"array"}'
      when 2 then '{"additionalProperties":true,"properties":{"a":{"required":[],"type":"object"}},"required":[],"type":"object"}'
      else '{"title":null,"x":' || conv_id || '}' end as fixed, count(*) as n from conversations group by 1""",
)
def schema_null_fix(spark, sf):
    """A schema per turn, drawn from a few shapes, all nulls repaired."""
    schema = F.expr(
        "case turn % 4 when 0 then '{\"type\": \"object\", \"properties\": null, \"required\": null, \"default\": null}' "
        "when 1 then '{\"type\": \"array\", \"items\": null, \"anyOf\": [null, {\"enum\": null}]}' "
        "when 2 then '{\"type\": \"object\", \"additionalProperties\": null, \"properties\": {\"a\": {\"type\": \"object\"}}}' "
        "else concat('{\"title\": null, \"x\": ', conv_id, '}') end"
    )
    df = data.turns_or_texts(spark, sf, "conversations").withColumn("fixed", F.get(H.repair_schemas(F.array(schema)), F.lit(0)))
    return df.groupBy("fixed").agg(F.count("*").alias("n"))


@query(
    "request_schema_fix",
    """select conv_id, turn, case turn % 5
      when 0 then '{"context":[],"messages":[{"content":"' || conv_id || '","items":{"type":"string"},"name":null}],"model":"m"}'
      when 1 then '{"tools":[{"function":{"name":"f' || conv_id || '","parameters":{"properties":{"a":{"enum":[]}},"required":[],"type":"object"}},"type":"function"},"x"],"x":null}'
      when 2 then '{"required":[],"tools":{"additionalProperties":true,"oneOf":[]},"type":"object"}'
      when 3 then '{"model": "m", "n": ' || turn || '}' else '[null]' end as fixed from conversations""",
)
def request_schema_fix(spark, sf):
    """A request body per turn, of a few shapes, repaired as a whole."""
    body = F.expr(
        "case turn % 5 when 0 then concat('{\"model\": \"m\", \"default\": null, \"context\": null, \"messages\": [{\"name\": null, \"items\": null, \"content\": \"', conv_id, '\"}]}') "
        "when 1 then concat('{\"x\": null, \"tools\": [{\"name\": \"f', conv_id, '\", \"description\": null, \"input_schema\": {\"type\": \"object\", \"properties\": {\"a\": {\"enum\": null}}}}, \"x\"]}') "
        "when 2 then '{\"type\": \"object\", \"tools\": {\"oneOf\": null, \"additionalProperties\": null}}' "
        "when 3 then concat('{\"model\": \"m\", \"n\": ', turn, '}') else '[null]' end"
    )
    return data.turns_or_texts(spark, sf, "conversations").select("conv_id", "turn", H.repair_request(body).alias("fixed"))


# chat responses of the assistant turns
CHAT = """
select id, text, turn, case id % 7 when 6 then '{"id": "e", "choices": []}' else
  '{' || case id % 2 when 0 then '"id": "r' || id || '", ' else '' end || '"model": "m' || turn || '", "choices": [{"message": {"content": '
  || case id % 3 when 2 then 'null' else {jq:text} end
  || case id % 4 when 1 then ', "tool_calls": [{"id": "k' || id || '", "function": {"name": "f", "arguments": "{\\"q\\": 1}"}}, {"function": {"name": "g", "arguments": "{bad"}}, 3]' else '' end
  || '}, "finish_reason": ' || case id % 5 when 0 then '"stop"' when 1 then '"length"' when 2 then '"tool_calls"' when 3 then 'null' else '"other"' end
  || '}], "usage": {"prompt_tokens": ' || turn || ', "completion_tokens": 2.9}}' end as body
from (select conv_id * 1000 + turn as id, turn, text from conversations where role = 'assistant') c
"""
CHAT_DUCK = f"chat as ({data.duck_text(CHAT)})"
REASON = "case id % 5 when 0 then 'end_turn' when 1 then 'max_tokens' when 2 then 'tool_use' when 3 then null else 'other' end"


def chat(spark, sf):
    return data._sql(spark, sf, data.spark_text(CHAT).replace("\\", "\\\\"), "conversations")


@query(
    "chat_to_blocks",
    f"""with {CHAT_DUCK} select id, case when id % 7 = 6 then 'missing choices' end as error,
      case when id % 7 = 6 then 'e' when id % 2 = 0 then 'r' || id else 'msg_converted' end as message_id,
      case when id % 7 = 6 then null else {REASON} end as stop_reason,
      case when id % 7 = 6 then 0 else turn end as input_tokens, case when id % 7 = 6 then 0 else 2 end::bigint as output_tokens,
      case when id % 7 = 6 or id % 3 = 2 then null else text end as text,
      case when id % 7 <> 6 and id % 4 = 1 then 'f{{"q":1}},g{{}}' else '' end as uses from chat""",
)
def chat_to_blocks(spark, sf):
    df = chat(spark, sf).withColumn("b", pin(H.block_message(F.col("body"))))
    parts = F.transform("b.content", F.try_parse_json)
    uses = F.filter(parts, lambda p: vstring(p, "$.type") == "tool_use")
    texts = F.filter(parts, lambda p: vstring(p, "$.type") == "text")
    return df.select(
        "id",
        "b.error",
        F.col("b.id").alias("message_id"),
        "b.stop_reason",
        "b.input_tokens",
        "b.output_tokens",
        vstring(F.get(texts, F.lit(0)), "$.text").alias("text"),
        F.array_join(F.transform(uses, lambda u: F.concat(vstring(u, "$.name"), F.to_json(vget(u, "$.input")))), ",").alias("uses"),
    )


@query(
    "finish_reason_report",
    f"with {CHAT_DUCK} select coalesce({REASON}, 'none') as stop_reason, count(*) as n from chat where id % 7 <> 6 group by 1",
)
def finish_reason_report(spark, sf):
    df = chat(spark, sf).withColumn("b", pin(H.block_message(F.col("body")))).filter("b.error is null")
    return df.groupBy(F.coalesce("b.stop_reason", F.lit("none")).alias("stop_reason")).agg(F.count("*").alias("n"))


# ---- captures

PARSED = f"""with {data.duck_sse()}, done as (select stream_id, min(seq) as d from sse where line = 'data: [DONE]' group by 1),
  chunks as (select stream_id, seq, substr(line, 7) as c from sse join done using (stream_id) where starts_with(line, 'data: ') and seq < d and json_valid(substr(line, 7))),
  texts as (select stream_id, seq, coalesce(json_extract_string(c, '$.choices[0].delta.content'), '') as txt, c from chunks),
  full_text as (select stream_id, length(trim(string_agg(txt, '' order by seq), ' ' || chr(10) || chr(9) || chr(13))) // 2 as half, count(*) as n_chunks from texts group by 1)"""


@query("sse_line_source", f"{PARSED} select stream_id, seq, txt as text from texts")
def sse_line_source(spark, sf):
    """Lines written as capture files, read back in byte ranges of 16 KB: long ones have several."""
    folder = scratch(spark, "captures")
    write_captures(data.sse_lines(spark, sf), folder)
    lines = numbered_lines(read_captures(spark, folder, split_bytes=16_384))
    df = capture.chunks(lines.withColumn("stream_id", F.col("stream_id").cast("long")))
    return df.select("stream_id", "seq", F.coalesce(vstring(F.col("chunk"), "$.choices[0].delta.content"), F.lit("")).alias("text"))


@query(
    "stream_usage",
    f"""{PARSED} select stream_id, n_chunks, case when stream_id % 4 = 0 and stream_id % 5 > 0 then stream_id % 5 else half end as output_tokens from full_text""",
)
def stream_usage(spark, sf):
    return capture.stream_usage(data.sse_lines(spark, sf))


@query(
    "stream_to_block_events",
    f"""{PARSED}, per as (select f.*, exists (select 1 from texts t where t.stream_id = f.stream_id and txt <> '') as started from full_text f)
    select stream_id, 0 as phase, 0::bigint as seq, 'message_start' as event, 'msg_' || stream_id || ':' || (stream_id % 9) as detail from per
    union all select stream_id, 1, 0, 'content_block_start', '' from per where started
    union all select stream_id, 2, seq, 'content_block_delta', txt from texts where txt <> ''
    union all select stream_id, 3, 0, 'content_block_stop', '' from per where started
    union all select stream_id, 4, 0, 'message_delta', coalesce(case stream_id % 3 when 0 then 'end_turn' when 1 then 'max_tokens' end, 'null') || ':' ||
      case when stream_id % 4 = 0 and stream_id % 5 > 0 then stream_id % 5 else half end from per
    union all select stream_id, 5, 0, 'message_stop', '' from per""",
)
def stream_to_block_events(spark, sf):
    return _told(capture.block_events(data.sse_lines(spark, sf), _asked(spark, sf)))


def _asked(spark, sf):
    return data.turns_or_texts(spark, sf, "conversations").filter("role = 'assistant'").select(
        F.expr("conv_id * 1000 + turn").alias("stream_id"),
        F.concat(F.lit("msg_"), F.expr("conv_id * 1000 + turn")).alias("message_id"),
        F.lit("m").alias("model"),
        F.expr("(conv_id * 1000 + turn) % 9").alias("input_tokens"),
    )


def _told(events):
    df = events.withColumn("v", F.try_parse_json("data"))
    v = F.col("v")
    start = F.concat(vstring(v, "$.message.id"), F.lit(":"), vget(v, "$.message.usage.input_tokens", "string"))
    end = F.concat(F.coalesce(vstring(v, "$.delta.stop_reason"), F.lit("null")), F.lit(":"), vget(v, "$.usage.output_tokens", "string"))
    detail = F.when(F.col("phase") == 0, start).when(F.col("phase") == 4, end).otherwise(F.coalesce(vstring(v, "$.delta.text"), F.lit("")))
    return df.select("stream_id", "phase", "seq", "event", detail.alias("detail"))


@query("block_events_stream", ORACLE["stream_to_block_events"])
def block_events_stream(spark, sf):
    """The same events from capture files that are read as a stream, by a state machine for each capture."""
    folder, out = scratch(spark, "captures"), scratch(spark, "block-events")
    write_captures(data.sse_lines(spark, sf), folder)
    lines = stream_captures(spark, folder).select(F.col("stream_id").cast("long").alias("stream_id"), F.col("offset").alias("seq"), "line", F.current_timestamp().alias("at"))
    events = jobs.block_event_stream(lines, _asked(spark, sf), count_lines=True)
    jobs.append_parquet(events, out, scratch(spark, "block-events-checkpoint")).awaitTermination()
    return _told(spark.read.schema(events.schema).parquet(out))
