"""Conversation formats: block-style messages <-> chat-style messages, tools and model names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietlog.functions.payload import parse_object, vget, vkind, vstring
from quietlog.functions.text import contains_any, is_blank, let, pin
from quietlog.functions.tokens import whole

# Finish reasons, and field names whose null means an empty list or object.
FINISH_REASONS = {"stop": "end_turn", "length": "max_tokens", "tool_calls": "tool_use"}
LIST_FIELDS = (
    "required", "enum", "examples", "prefixItems", "context", "anyOf", "allOf", "oneOf", "commands", "options",
    "arguments", "parameters", "variables", "includes", "excludes", "defs", "definitions", "$defs", "schemas",
    "security", "servers", "paths", "tags", "externalDocs", "discriminator", "xml", "deprecated", "readOnly",
    "writeOnly", "contentMediaType", "contentEncoding", "if", "then", "else",
)
OBJECT_FIELDS = (
    "properties", "patternProperties", "dependencies", "dependentSchemas", "propertyNames", "unevaluatedItems",
    "unevaluatedProperties", "contentSchema",
)
# id of messages that come without one; callers may give their own
DEFAULT_MESSAGE_ID = "msg_converted"
COPIED_KEYS = ("model", "max_tokens", "temperature", "top_p", "stream")


def json_text(v: Column) -> Column:
    """JSON of a variant with <, > and & escaped."""
    out = F.to_json(v)
    for ch in "<>&":
        out = F.replace(out, F.lit(ch), F.lit(f"\\u{ord(ch):04x}"))
    return out


def json_string(s: Column) -> Column:
    """A string as a JSON literal; null stays null."""
    return F.when(s.isNotNull(), F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]\z", ""))


def json_object(**fields: Column) -> Column:
    """JSON object from JSON values; null values are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def map_finish_reason(reason: Column) -> Column:
    out = F.when(reason == "", None)
    for chat, block in FINISH_REASONS.items():
        out = out.when(reason == chat, block)
    return out.otherwise(reason)


def tool_choice(v: Column) -> Column:
    """JSON of a chat-style tool choice."""
    kind = vstring(v, "$.type")
    named = json_object(
        type=F.lit('"function"'), function=json_object(name=json_string(F.coalesce(vstring(v, "$.name"), F.lit(""))))
    )
    return (
        F.when((vkind(v) == "OBJECT") & (kind == "auto"), '"auto"')
        .when((vkind(v) == "OBJECT") & (kind == "any"), '"required"')
        .when((vkind(v) == "OBJECT") & (kind == "tool"), named)
        .otherwise(json_text(v))
    )


def _repaired(v):
    """JSON Schema with nulls replaced by what their field stands for."""
    if isinstance(v, list):
        return [_repaired(x) for x in v]
    if not isinstance(v, dict):
        return v
    out = {}
    for k, x in v.items():
        if x is not None:
            out[k] = _repaired(x)
        elif k == "items":
            out[k] = {"type": "string"}
        elif k == "additionalProperties":
            out[k] = True
        elif k in LIST_FIELDS:
            out[k] = []
        elif k in OBJECT_FIELDS:
            out[k] = {}
        elif k != "default":
            out[k] = None
    if out.get("type") == "object":
        out.setdefault("required", [])
    return out


def _as_function(tool):
    """Tool definition in function form, schemas repaired."""
    if not isinstance(tool, dict):
        return tool
    out = dict(tool)
    if "input_schema" in out:
        head = {k: out.pop(k, None) for k in ("name", "description")}
        out["function"] = {k: x for k, x in head.items() if isinstance(x, str)}
        out["function"]["parameters"] = _repaired(out.pop("input_schema"))
        out["type"] = "function"
    if isinstance(out.get("function"), dict):
        out["function"] = {k: _repaired(x) if k == "parameters" else x for k, x in out["function"].items()}
    return out


def _fixed_request(body):
    """A whole request: nulls repaired wherever they stand, then its tools in function form."""
    out = _repaired(body)
    if isinstance(out.get("tools"), list):
        out["tools"] = [_as_function(t) for t in out["tools"]]
    return out


def _per_json(change):
    """Arrow function over array<string> of JSON; the few distinct texts of a corpus are worked once per worker."""

    def batch(lists):
        import json
        from functools import lru_cache

        import pyarrow as pa

        @lru_cache(maxsize=10_000)
        def one(text):
            out = json.dumps(change(json.loads(text)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            return out.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")

        return pa.array(
            [None if ts is None else [None if t is None else one(t) for t in ts] for ts in lists.to_pylist()],
            pa.list_(pa.string()),
        )

    return F.arrow_udf(batch, T.ArrayType(T.StringType()))


_repair_batch = _per_json(_repaired)
_function_batch = _per_json(_as_function)
_request_batch = _per_json(_fixed_request)
#: without any of these in its text a request has nothing to repair
REPAIRABLE = ("null", "object", "input_schema", "parameters")


def repair_schemas(schemas: Column) -> Column:
    """array<string> of JSON Schemas with null fields repaired; lists without any JSON are not sent to Python."""
    return _repair_batch(F.when(F.size(schemas) > 0, schemas))


def repair_request(body: Column) -> Column:
    """A request body with null fields repaired and tools in function form; what is no JSON object stays as it is.

    Bodies whose text holds nothing to repair stay in the JVM, the others are read and written once.
    """
    some = contains_any(body, REPAIRABLE) & parse_object(body).isNotNull()
    return F.coalesce(F.get(_request_batch(F.when(some, F.array(body))), F.lit(0)), body)


def tools_as_functions(tools: Column) -> Column:
    """array<string> of tool definitions in function form."""
    return F.coalesce(_function_batch(F.when(F.size(tools) > 0, tools)), F.when(tools.isNotNull(), F.array().cast("array<string>")))


def _flat(v: Column) -> Column:
    """Is the text of this content at most one list deep?"""

    def item_ok(x):
        return vkind(x).isin("STRING", "VOID", "BOOLEAN", "BIGINT", "DECIMAL", "DOUBLE") | (
            (vkind(x) == "OBJECT") & (vstring(x, "$.text").isNotNull() | vget(x, "$.content").isNull() | vstring(x, "$.content").isNotNull())
        )

    items = vget(v, "$", "array<variant>")
    return v.isNull() | (vkind(v) != "ARRAY") & item_ok(v) | (vkind(v) == "ARRAY") & F.coalesce(F.forall(items, item_ok), F.lit(True))


def content_text(v: Column) -> Column:
    """Text of flat content: a string, an object's text or content, or a list of these joined by newlines."""

    def one(x):
        return F.coalesce(
            F.when(vkind(x) == "STRING", vget(x, "$", "string")),
            F.when(vkind(x) == "OBJECT", F.coalesce(vstring(x, "$.text"), vstring(x, "$.content"))),
            F.lit(""),
        )

    parts = F.filter(F.transform(vget(v, "$", "array<variant>"), one), lambda t: ~is_blank(t))
    return F.when(vkind(v) == "ARRAY", F.array_join(parts, "\n")).otherwise(one(v))


@F.arrow_udf(T.StringType())
def _flatten_batch(bodies):
    """Requests whose contents nest deeper, with every content replaced by its text."""
    import json

    import pyarrow as pa

    def text(v):
        if isinstance(v, str):
            return v
        if isinstance(v, list):
            return "\n".join(t for t in map(text, v) if t.strip())
        if isinstance(v, dict):
            return v["text"] if isinstance(v.get("text"), str) else text(v.get("content"))
        return ""

    def block(b):
        if not isinstance(b, dict) or b.get("type") == "tool_use":
            return b
        if b.get("type") == "tool_result":
            return {**b, "content": text(b.get("content"))}
        return {"type": "text", "text": text(b)}

    def flat(body):
        doc = json.loads(body)
        doc["system"] = text(doc.get("system"))
        for m in doc.get("messages") or []:
            if isinstance(m, dict):
                c = m.get("content")
                m["content"] = [block(b) for b in c] if isinstance(c, list) else text(c)
        return json.dumps(doc)

    return pa.array([None if b is None else flat(b) for b in bodies.to_pylist()], pa.string())


def flat_request(body: Column) -> Column:
    """Request variant in which every content is flat; only deeper ones take the way through Python."""

    def deep_message(m):
        def deep_block(b):
            inner = F.when(vstring(b, "$.type") == "tool_result", vget(b, "$.content")).otherwise(b)
            return F.when(vstring(b, "$.type") == "tool_use", False).otherwise(~_flat(inner) | (vkind(b) == "ARRAY"))

        blocks = F.exists(vget(m, "$.content", "array<variant>"), deep_block)
        return F.when(vkind(vget(m, "$.content")) == "ARRAY", blocks).otherwise(~_flat(vget(m, "$.content")))

    def deep(v):
        messages = F.exists(vget(v, "$.messages", "array<variant>"), lambda m: F.coalesce(deep_message(m), F.lit(False)))
        return ~_flat(vget(v, "$.system")) | F.coalesce(messages, F.lit(False))

    odd = F.coalesce(let(parse_object(body), deep), F.lit(False))
    return parse_object(F.coalesce(_flatten_batch(F.when(odd, body)), body))


CHAT_MESSAGE = "struct<role:string,content:string,tool_call_id:string,tool_calls:array<string>>"


def _chat(role, content, call_id=None, calls=None) -> Column:
    return F.struct(
        role.alias("role"),
        content.alias("content"),
        (F.lit(None).cast("string") if call_id is None else call_id).alias("tool_call_id"),
        (F.lit(None).cast("array<string>") if calls is None else calls).alias("tool_calls"),
    )


def chat_messages(m: Column) -> Column:
    """Chat messages a flat block message gives rise to, in order.

    Text blocks are joined; tool uses of the assistant become calls; a tool result first lets out
    the text gathered so far and then becomes a message of its own.
    """
    role = F.coalesce(F.nullif(vstring(m, "$.role"), F.lit("")), F.lit("user"))

    def call(b):
        inner = json_object(
            arguments=json_string(F.coalesce(json_text(vget(b, "$.input")), F.lit("{}"))),
            name=json_string(F.coalesce(vstring(b, "$.name"), F.lit(""))),
        )
        return json_object(function=inner, id=json_string(F.coalesce(vstring(b, "$.id"), F.lit(""))), type=F.lit('"function"'))

    def step(s, b):
        kind = F.coalesce(vstring(b, "$.type"), F.lit(""))
        gathered = F.array_join(s.parts, "\n")
        flush = ~is_blank(gathered)
        result = _chat(
            F.lit("tool"), content_text(vget(b, "$.content")), F.coalesce(vstring(b, "$.tool_use_id"), F.lit(""))
        )
        no_parts = F.array().cast("array<string>")
        text = content_text(b)

        def state(out, parts, calls):
            return F.struct(out.alias("out"), parts.alias("parts"), calls.alias("calls"))

        flushed = F.concat(s.out, F.when(flush, F.array(_chat(role, gathered), result)).otherwise(F.array(result)))
        return (
            F.when(vkind(b) != "OBJECT", s)
            .when((kind == "tool_use") & (role == "assistant"), state(s.out, s.parts, F.concat(s.calls, F.array(call(b)))))
            .when(kind == "tool_use", s)
            .when(kind == "tool_result", state(flushed, F.when(flush, no_parts).otherwise(s.parts), s.calls))
            .when(~is_blank(text), state(s.out, F.concat(s.parts, F.array(text)), s.calls))
            .otherwise(s)
        )

    def finish(s):
        text = F.array_join(s.parts, "\n")
        calls = F.when(F.size(s.calls) > 0, s.calls)
        last = _chat(role, text, calls=calls)
        return F.when((text != "") | calls.isNotNull(), F.concat(s.out, F.array(last))).otherwise(s.out)

    start = F.expr(f"cast(named_struct('out', array(), 'parts', array(), 'calls', array()) as struct<out:array<{CHAT_MESSAGE}>,parts:array<string>,calls:array<string>>)")
    blocks = F.aggregate(vget(m, "$.content", "array<variant>"), start, step, finish)
    return let(
        vget(m, "$.content"),
        lambda c: F.when(vkind(m) != "OBJECT", F.expr(f"cast(array() as array<{CHAT_MESSAGE}>)"))
        .when(vkind(c) == "ARRAY", blocks)
        .otherwise(F.array(_chat(role, F.coalesce(content_text(c), F.lit(""))))),
    )


def flatten_messages(v: Column) -> Column:
    """Chat messages of all messages of a flat request."""
    rows = F.flatten(F.transform(vget(v, "$.messages", "array<variant>"), chat_messages))
    return F.coalesce(rows, F.expr(f"cast(array() as array<{CHAT_MESSAGE}>)"))


def message_json(m: Column) -> Column:
    return json_object(
        content=json_string(m.content),
        role=json_string(m.role),
        tool_call_id=json_string(m.tool_call_id),
        tool_calls=F.when(m.tool_calls.isNotNull(), json_list(m.tool_calls)),
    )


def with_chat_request(df: DataFrame, body: str = "body") -> DataFrame:
    """Add `chat_messages` (array of structs) and `chat_body` (JSON) for block-style request bodies."""
    v = F.col("_flat")
    system = content_text(vget(v, "$.system"))
    lead = F.when(~is_blank(system), F.array(_chat(F.lit("system"), system))).otherwise(
        F.expr(f"cast(array() as array<{CHAT_MESSAGE}>)")
    )
    copied = {k: json_text(vget(v, f"$.{k}")) for k in COPIED_KEYS}
    choice = vget(v, "$.tool_choice")
    out = (
        df.withColumn("_flat", pin(flat_request(F.col(body))))
        .withColumn("chat_messages", pin(F.concat(lead, flatten_messages(v))))
        .withColumn("_tools", tools_as_functions(F.transform(vget(v, "$.tools", "array<variant>"), lambda t: F.to_json(t))))
    )
    chat_body = json_object(
        **copied,
        stop=json_text(vget(v, "$.stop_sequences")),
        tools=json_list(F.col("_tools")),
        tool_choice=F.when(choice.isNotNull(), tool_choice(choice)),
        messages=json_list(F.transform("chat_messages", message_json)),
    )
    return out.withColumn("chat_body", chat_body).drop("_flat", "_tools")


def block_message(body: Column, default_id: str = DEFAULT_MESSAGE_ID) -> Column:
    """struct<error, id, model, content array<string>, stop_reason, input_tokens, output_tokens> of a chat response.

    `content` holds the JSON of the text block and the tool_use blocks.
    """

    def use(c):
        args = vstring(c, "$.function.arguments")
        parsed = F.when(args != "", F.try_parse_json(args))
        return F.when(
            vkind(c) == "OBJECT",
            json_object(
                id=json_string(F.coalesce(vstring(c, "$.id"), F.lit(""))),
                input=F.coalesce(json_text(parsed), F.lit("{}")),
                name=json_string(F.coalesce(vstring(c, "$.function.name"), F.lit(""))),
                type=F.lit('"tool_use"'),
            ),
        )

    def convert(v):
        text = vstring(v, "$.choices[0].message.content")
        text_block = F.when(text != "", F.array(json_object(text=json_string(text), type=F.lit('"text"'))))
        uses = F.filter(F.transform(vget(v, "$.choices[0].message.tool_calls", "array<variant>"), use), lambda b: b.isNotNull())
        none = F.array().cast("array<string>")
        reason = F.coalesce(vstring(v, "$.choices[0].finish_reason"), F.lit(""))
        zero = F.lit(0).cast("long")
        missing = vget(v, "$.choices[0]").isNull()
        return F.struct(
            F.when(v.isNull(), "invalid json").when(missing, "missing choices").alias("error"),
            F.coalesce(F.nullif(vstring(v, "$.id"), F.lit("")), F.lit(default_id)).alias("id"),
            F.coalesce(vstring(v, "$.model"), F.lit("")).alias("model"),
            F.concat(F.coalesce(text_block, none), F.coalesce(uses, none)).alias("content"),
            map_finish_reason(reason).alias("stop_reason"),
            F.coalesce(whole(v, "$.usage.prompt_tokens"), zero).alias("input_tokens"),
            F.coalesce(whole(v, "$.usage.completion_tokens"), zero).alias("output_tokens"),
        )

    return let(parse_object(body), convert)


def remap_models(df: DataFrame, providers: DataFrame, model: str = "model", provider: str = "provider") -> DataFrame:
    """Replace claude-* model names by the provider's last model; the dimension has a handful of rows."""
    dim = providers.select(F.col("provider").alias("_p"), F.try_element_at("models", F.lit(-1)).alias("_last"))
    hit = F.lower(F.col(model)).startswith("claude-") & F.col("_last").isNotNull()
    return (
        df.join(F.broadcast(dim), F.col(provider) == F.col("_p"), "left")
        .withColumn(model, F.when(hit, F.col("_last")).otherwise(F.col(model)))
        .drop("_p", "_last")
    )
