"""Text nodes of request payloads, entirely inside the row: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietlog.functions import detect as D
from quietlog.functions import rules as R
from quietlog.functions.redact import redact_normalized
from quietlog.functions.text import clean_text, in_steps, is_blank, let, needs_normalizing, pin

ARGS_PATH = "tool_calls.function.arguments"
PARAM_KEYS = ("tool_params", "parameters", "args")
CONTEXT_KEYS = ("context", "redacted_context", "redacted_messages", "messages", "redacted_text", "text")
SESSION_KEYS = ("session_id", "conversation_id", "thread_id")


def vkind(v: Column) -> Column:
    """OBJECT / ARRAY / STRING / ...: the head of the variant's schema."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def vget(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def as_text(v: Column) -> Column:
    """The string a variant holds, null when it holds anything else."""
    return F.when(F.schema_of_variant(v) == "STRING", vget(v, "$", "string"))


def vstring(v: Column, path: str) -> Column:
    return let(vget(v, path), as_text)


def parse_object(body: Column) -> Column:
    """Request body as a variant; null unless it is a JSON object (told by its first character)."""
    return F.when(F.ltrim(body, F.lit(" \t\n\r")).startswith("{"), F.try_parse_json(body))


@F.arrow_udf(T.StringType())
def _respelled_batch(bodies):
    """JSON objects spelled anew, the last of equal keys kept; null for what is no JSON, '' for what is too deep."""
    import json

    import pyarrow as pa

    def one(body):
        try:
            doc = json.loads(body)
            return json.dumps(doc, ensure_ascii=False) if isinstance(doc, dict) else None
        except RecursionError:
            return ""
        except ValueError:
            return None

    return in_steps(lambda some: [None if b is None else one(b) for b in some], pa.string(), bodies)


def with_payload(df: DataFrame, body: str = "body") -> DataFrame:
    """Add `payload` (variant, null if the body is no JSON object), `unread` ('size', 'depth' or null) and `read_body`.

    A body with equal keys is read with the last of them.  What is an object but can't be taken apart is
    `unread`, and must not be taken for one without text.
    """
    fits = F.coalesce(F.octet_length(body) <= R.MAX_BODY_BYTES, F.lit(True))
    first = parse_object(F.when(fits, F.col(body)))
    df = df.withColumn("_fits", fits).withColumn("_first", pin(first))
    again = F.when(F.col("_fits") & F.col("_first").isNull() & F.ltrim(F.col(body), F.lit(" \t\n\r")).startswith("{"), F.col(body))
    df = df.withColumn("_again", _respelled_batch(again))
    df = df.withColumn("payload", pin(F.coalesce("_first", F.try_parse_json("_again"))))
    deep = F.col("_again").isNotNull() & F.col("payload").isNull()
    unread = F.when(~F.col("_fits"), "size").when(deep, "depth")
    df = df.withColumn("unread", pin(unread)).withColumn("read_body", F.coalesce("_again", body))
    return df.drop("_fits", "_first", "_again")


def _root(role, kind, prefix, addr, text) -> Column:
    return F.struct(
        role.alias("role"), F.lit(kind).alias("kind"), F.lit(prefix).alias("prefix"), addr.alias("addr"), text.alias("text")
    )


def _list(*cs: Column) -> Column:
    return F.array(*cs)


NO_ROOTS = "cast(array() as array<struct<role:string,kind:string,prefix:string,addr:string,text:string>>)"


def text_roots(v: Column) -> Column:
    """Places of a payload that hold text, in reading order.

    kind 'text': the text itself; kind 'json': JSON to be walked for strings, at any depth.
    """
    empty = F.expr(NO_ROOTS)

    def text_at(role, path, addr):
        return let(vstring(v, path), lambda s: F.when(s.isNotNull(), _list(_root(F.lit(role), "text", "", F.lit(addr), s))))

    def json_at(role, path, prefix, addr, kinds=None):
        def body(x):
            test = x.isNotNull() if kinds is None else vkind(x).isin(*kinds)
            return F.when(test, _list(_root(F.lit(role), "json", prefix, F.lit(addr), F.to_json(x))))

        return let(vget(v, path), body)

    def message_roots(m, i):
        role = F.coalesce(vstring(m, "$.role"), F.lit(""))
        at = F.concat(F.lit("/messages/"), i.cast("string"))

        def content(c):
            whole = F.when(vkind(c) == "STRING", _list(_root(role, "text", "", F.concat(at, F.lit("/content")), vget(c, "$", "string"))))
            parts = F.transform(
                vget(c, "$", "array<variant>"),
                lambda p, k: _root(
                    role, "text", "", F.concat(at, F.lit("/content/"), k.cast("string"), F.lit("/text")), vstring(p, "$.text")
                ),
            )
            return F.coalesce(whole, F.when(vkind(c) == "ARRAY", F.filter(parts, lambda r: r.text.isNotNull())), empty)

        def call(t, k):
            where = F.concat(at, F.lit("/tool_calls/"), k.cast("string"), F.lit("/function/arguments"))

            def one(args):
                walk = vkind(F.try_parse_json(args)).isin("OBJECT", "ARRAY")
                return F.when(walk, _root(role, "json", ARGS_PATH, F.concat(where, F.lit("#")), args)).otherwise(
                    _root(role, "text", "", where, args)
                )

            return let(vstring(t, "$.function.arguments"), one)

        calls = F.filter(
            F.transform(vget(m, "$.tool_calls", "array<variant>"), call), lambda r: r.text.isNotNull()
        )
        return F.concat(let(vget(m, "$.content"), content), F.coalesce(calls, empty))

    heads = [
        text_at("system", "$.system", "/system"),
        text_at("system", "$.system_prompt", "/system_prompt"),
        text_at("user", "$.input", "/input"),
        json_at("user", "$.input", "", "/input", ("ARRAY", "OBJECT")),
        text_at("user", "$.prompt", "/prompt"),
    ] + [json_at("tool", f"$.{k}", k, f"/{k}") for k in PARAM_KEYS]
    messages = F.flatten(F.transform(vget(v, "$.messages", "array<variant>"), message_roots))
    return F.concat(*[F.coalesce(h, empty) for h in heads], F.coalesce(messages, empty))


FOUND = T.StructType([T.StructField(n, T.StringType()) for n in ("ptr", "path", "value", "clean")])
FOUND_LISTS = T.ArrayType(T.ArrayType(FOUND))


def _strings_of(doc):
    """(pointer, dotted key path, value) of every string in parsed JSON; keys in sorted order."""
    todo = [("", "", doc)]
    while todo:
        ptr, path, v = todo.pop()
        if isinstance(v, str):
            yield ptr, path, v
        elif isinstance(v, list):
            todo += [(f"{ptr}/{i}", path, x) for i, x in reversed(list(enumerate(v)))]
        elif isinstance(v, dict):
            for k in sorted(v, reverse=True):
                step = k.replace("~", "~0").replace("/", "~1").replace("#", "~2")
                todo.append((f"{ptr}/{step}", f"{path}.{k}" if path else k, v[k]))


@F.arrow_udf(FOUND_LISTS)
def _open_roots_batch(roots):
    """Per root its strings and their normalised form.

    Walking JSON of unbounded depth and NFKC are what needs Python; one call serves both.
    """
    import json

    import pyarrow as pa

    def opened(root):
        if root["kind"] == "text":
            yield {"ptr": "", "path": "", "value": root["text"], "clean": clean_text(root["text"])}
            return
        for ptr, path, value in _strings_of(json.loads(root["text"])):
            full = ".".join(p for p in (root["prefix"], path) if p)
            yield {"ptr": ptr, "path": full, "value": value, "clean": clean_text(f"{full}: {value}" if full else value)}

    item = pa.struct([(n, pa.string()) for n in ("ptr", "path", "value", "clean")])
    return in_steps(lambda some: [None if r is None else [list(opened(root)) for root in r] for r in some], pa.list_(pa.list_(item)), roots)


def open_roots(roots: Column) -> Column:
    """Strings per root; null, and nothing sent to Python, where all roots are plain text that is already normal."""
    need = F.exists(roots, lambda r: (r.kind == "json") | needs_normalizing(r.text))
    return _open_roots_batch(F.when(need, roots))


def text_nodes(roots: Column, opened: Column) -> Column:
    """array<struct<role, text, detect_text, context_prefix, clean, addr>>; blank texts dropped.

    `clean` is the normalised redaction input: key path and text.
    """

    def node(role, text, prefix, clean, addr):
        detect = F.when(prefix == "", text).otherwise(F.concat(prefix, F.lit(": "), text))
        return F.struct(
            role.alias("role"),
            text.alias("text"),
            detect.alias("detect_text"),
            prefix.alias("context_prefix"),
            clean.alias("clean"),
            addr.alias("addr"),
        )

    def expand(r, found):
        plain = F.array(node(r.role, r.text, F.lit(""), r.text, r.addr))
        several = F.transform(found, lambda s: node(r.role, s.value, s.path, s.clean, F.concat(r.addr, s.ptr)))
        return F.when(found.isNull(), plain).otherwise(several)

    # the Arrow result is an argument, never used inside a lambda
    return F.filter(
        F.flatten(F.zip_with(roots, F.coalesce(opened, F.array().cast(FOUND_LISTS)), expand)), lambda n: ~is_blank(n.text)
    )


def with_text_nodes(df: DataFrame, body: str = "body") -> DataFrame:
    """Add `payload` (variant, null if not an object), `unread`, `read_body` and `nodes`."""
    return (
        with_payload(df, body)
        .withColumn("_roots", pin(text_roots(F.col("payload"))))
        .withColumn("_opened", open_roots(F.col("_roots")))
        .withColumn("nodes", pin(text_nodes(F.col("_roots"), F.col("_opened"))))
        .drop("_roots", "_opened")
    )


def recursive_strings(json_text: Column, prefix: str = "") -> Column:
    """array<struct<ptr, path, value, clean>> of one JSON column: all non-blank strings with dotted key path."""
    root = _root(F.lit(""), "json", prefix, F.lit(""), json_text)
    found = F.get(_open_roots_batch(F.when(json_text.isNotNull(), F.array(root))), F.lit(0))
    return F.filter(found, lambda s: ~is_blank(s.value))


@F.arrow_udf(T.StringType())
def _write_back_batch(bodies, addrs, texts):
    """Put texts back at their addresses; '#' enters a string that is itself JSON."""
    import json

    import pyarrow as pa

    def dump(v):
        # keys sorted; <, > and & escaped as in the source format
        out = json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        for ch in "<>&\u2028\u2029":
            out = out.replace(ch, f"\\u{ord(ch):04x}")
        return out

    def put(v, steps, text):
        if not steps:
            return text
        head, rest = steps[0], steps[1:]
        if head == "#":
            return dump(put(json.loads(v), rest, text))
        key = int(head) if isinstance(v, list) else head.replace("~2", "#").replace("~1", "/").replace("~0", "~")
        v[key] = put(v[key], rest, text)
        return v

    def rewrite(body, at, new):
        doc = json.loads(body)
        for a, t in zip(at, new):
            doc = put(doc, a.replace("#", "/#").split("/")[1:], t)
        return dump(doc)

    rewritten = lambda *some: [None if b is None else rewrite(b, a, t) for b, a, t in zip(*some)]
    return in_steps(rewritten, pa.string(), bodies, addrs, texts)


def write_back(body: Column, changes: Column) -> Column:
    """Body with new texts at the addresses of `changes` (array<struct<addr, text>>); untouched if there are none."""
    changed = F.size(changes) > 0
    sent = F.when(changed, body)
    return F.coalesce(
        _write_back_batch(sent, F.transform(changes, lambda c: c.addr), F.transform(changes, lambda c: c.text)), body
    )


def request_options(v: Column, configured=R.DEFAULT_ON, from_scratch: bool = False) -> dict[str, Column]:
    """Redaction switches of a request: booleans below `options` (or `redaction_options`) over the configured ones.

    `from_scratch`: once a request brings options, all others are off.
    """

    def objects(path):
        return let(vget(v, path), lambda o: F.when(vkind(o) == "OBJECT", o))

    given = F.coalesce(objects("$.options"), objects("$.redaction_options"))

    def switch(name):
        asked = let(vget(given, f"$.{name}"), lambda b: F.when(vkind(b) == "BOOLEAN", vget(b, "$", "boolean")))
        default = F.lit(name in configured)
        return F.coalesce(asked, F.when(given.isNotNull(), False).otherwise(default) if from_scratch else default)

    return {name: switch(name) for name in R.OPTION_NAMES}


def context_payload(v: Column) -> Column:
    """struct<mode, value variant>: first present context key; mode 'text', 'messages', 'error' or 'missing'."""
    pick = F.coalesce(*[vget(v, f"$.{k}") for k in CONTEXT_KEYS])
    return let(
        pick,
        lambda x: F.struct(
            F.when(x.isNull(), "missing")
            .when(vkind(x) == "STRING", "text")
            .when(vkind(x) == "ARRAY", "messages")
            .otherwise("error")
            .alias("mode"),
            x.alias("value"),
        ),
    )


def node_decisions(nodes: Column, paths: Column, policy: R.Policy) -> Column:
    """array<struct<rank, reason>>: each node graded together with the paths of the whole payload."""
    params = F.array(D.detect_paths(paths, policy.rules))
    return let(
        params,
        lambda p: F.transform(
            nodes, lambda n: D.combine(F.concat(D.detector_results(policy.rules, message=n.detect_text), p))
        ),
    )


def policy_rollup(decisions: Column, policy: R.Policy) -> Column:
    """struct<level, action, reason> of a payload: highest rank, reason of the first node at that rank."""
    best = F.array_max(
        F.transform(decisions, lambda d, i: F.struct(d.rank.alias("rank"), (-i).alias("first"), d.reason.alias("reason")))
    )
    return let(
        best,
        lambda b: let(
            D.level_of(F.coalesce(b.rank, F.lit(1))),
            lambda level: F.struct(
                level.alias("level"),
                D.action_of(level, policy).alias("action"),
                F.when(b.rank > 1, b.reason).alias("reason"),
            ),
        ),
    )


def redact_nodes(nodes: Column, policy: R.Policy, forced: Column) -> Column:
    """array<struct<text, hits>>: redact with the key path in front, then take the path off again.

    `forced` (boolean) switches the three policy-forced rules on for the row.
    """
    per_row = {name: forced for name in R.FORCED_ON if name not in policy.options}

    def one(n):
        prefix = F.when(n.context_prefix == "", "").otherwise(F.concat(n.context_prefix, F.lit(": ")))
        fits = F.octet_length(n.detect_text) <= R.MAX_TEXT_BYTES  # path and raw text
        red = redact_normalized(F.when(fits, n.clean), tuple(sorted(policy.options)), policy.rules, per_row)
        return let(
            red,
            lambda r: F.struct(
                F.when(r.text.startswith(prefix), F.substring(r.text, F.length(prefix) + 1, F.length(r.text)))
                .otherwise(r.text)
                .alias("text"),
                F.size(r.replacements).alias("hits"),
            ),
        )

    return F.transform(nodes, one)
