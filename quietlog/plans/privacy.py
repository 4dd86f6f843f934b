"""Queries for grading, redaction and restore, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietlog.functions import detect as D
from quietlog.functions import rules as R
from quietlog.functions.context import redact_context, restore_context
from quietlog.functions.payload import parse_object, request_options
from quietlog.functions.redact import redact
from quietlog.functions.restore import decode_token, encode_token, html_escape
from quietlog.functions.text import is_blank, normalize, pin
from quietlog.operators import corpus as C
from quietlog.plans import data
from quietlog.plans import redact_sql as S
from quietlog.session import staged
from quietlog.sources.request_log import split_by_size

POLICY, RULES = R.Policy(), R.Rules()
CUSTOM = RULES.configured(keywords_s2=["haus", "house", "el"], paths_s2=["/var/*", "~/private"])
ALL = R.OPTION_NAMES
QUERIES, ORACLE = {}, {}
CORPUS = "with " + data.duck_corpus()


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def shown(replacements):
    return F.array_join(F.transform(replacements, lambda x: F.concat(x.original, F.lit("="), x.tag)), "|")


# ---- sizes

SIZE_LIMIT = 4096


@query(
    "size_quarantine",
    f"""{CORPUS} select source, sum(case when strlen(text) <= {SIZE_LIMIT} then 1 else 0 end)::bigint as kept,
      sum(case when strlen(text) > {SIZE_LIMIT} then 1 else 0 end)::bigint as quarantined,
      sum(case when strlen(text) > {SIZE_LIMIT} then strlen(text) else 0 end)::bigint as quarantined_bytes from corpus group by source""",
)
def size_quarantine(spark, sf):
    """A small limit, so that the test corpus has rows on both sides."""
    kept, over = split_by_size(data.corpus(spark, sf), "text", SIZE_LIMIT)
    zero = F.lit(0).cast("long")
    parts = kept.select("source", F.lit(1).cast("long").alias("k"), zero.alias("o"), zero.alias("b")).unionByName(
        over.select("source", zero.alias("k"), F.lit(1).cast("long").alias("o"), F.octet_length("text").cast("long").alias("b"))
    )
    return parts.groupBy("source").agg(
        F.sum("k").alias("kept"), F.sum("o").alias("quarantined"), F.sum("b").alias("quarantined_bytes")
    )


# ---- grading


@query(
    "keyword_match",
    f"{CORPUS} select lang, "
    + ", ".join(f"sum(case when {S.keyword_test('text', k)} then 1 else 0 end)::bigint as n_{i}" for i, k in enumerate(RULES.keywords_s3 + RULES.keywords_s2))
    + " from corpus group by lang",
)
def keyword_match(spark, sf):
    low = data.corpus(spark, sf).withColumn("low", pin(F.lower("text")))
    return low.groupBy("lang").agg(
        *[F.count_if(D.keyword_matches(F.col("low"), k)).alias(f"n_{i}") for i, k in enumerate(RULES.keywords_s3 + RULES.keywords_s2)]
    )


def _reasons(detector):
    def run(spark, sf):
        df = data.corpus(spark, sf).withColumn("d", pin(detector(F.col("text"))))
        return df.select("doc_id", "d.rank", "d.reason")

    return run


def _reason_sql(reason: str) -> str:
    return f"""{CORPUS}, g as (select doc_id, {reason} as reason from corpus)
      select doc_id, cast(substr({S.level_from('reason')}, 2) as int) as rank, reason from g"""


query("keyword_detect", _reason_sql(S.keyword_reason("text", RULES)))(_reasons(lambda c: D.detect_keywords(c, RULES)))
query("pattern_detect", _reason_sql(S.pattern_reason("text", RULES)))(_reasons(lambda c: D.detect_patterns(c, RULES)))

TOOL_SQL = "case event_id % 6 when 0 then 'exec' when 1 then ' My.Shell-' || user_id when 2 then 'sudo' when 3 then 'system_run' when 4 then 'system.run.now' else event_type end"


@query(
    "tool_name_detect",
    f"""with t as (select {TOOL_SQL} as tool from events), g as (select tool, {S.tool_reason('tool', RULES)} as reason from t)
    select {S.level_from('reason')} as level, reason, count(*) as n from g group by 1, 2""",
)
def tool_name_detect(spark, sf):
    tools = data.table(spark, sf, "events").select(F.expr(TOOL_SQL).alias("tool"))
    g = tools.withColumn("d", pin(D.detect_tool(F.col("tool"), RULES)))
    return g.groupBy(D.level_of(F.col("d.rank")).alias("level"), F.col("d.reason").alias("reason")).agg(F.count("*").alias("n"))


PATHS_SQL = """paths as (select p.payload_id, t.fullkey as k, json_extract_string(p.body, t.fullkey) as path, t.id as pos
  from payloads p, json_tree(p.body) t
  where t.type = 'VARCHAR' and (contains(json_extract_string(p.body, t.fullkey), '/') or contains(json_extract_string(p.body, t.fullkey), chr(92))))"""


@query(
    "param_paths",
    f"with {data.duck_payloads()}, {PATHS_SQL} select payload_id, path from paths",
)
def param_paths(spark, sf):
    return data.payloads(spark, sf).select("payload_id", F.explode(D.param_paths(F.col("body"))).alias("path"))


@query(
    "path_detect",
    f"""with {data.duck_payloads()}, {PATHS_SQL}, l as (select payload_id, list(path order by pos) as ps from paths group by 1),
    g as (select payload_id, {S.path_reason('ps', RULES)} as reason from l)
    select {S.level_from('reason')} as level, reason, count(*) as n from (
      select p.payload_id, g.reason from payloads p left join g using (payload_id)) group by 1, 2""",
)
def path_detect(spark, sf):
    g = data.payloads(spark, sf).withColumn("d", pin(D.detect_paths(D.param_paths(F.col("body")), RULES)))
    return g.groupBy(D.level_of(F.col("d.rank")).alias("level"), F.col("d.reason").alias("reason")).agg(F.count("*").alias("n"))


RESULT_SQL = "case when turn % 3 = 0 then null else '{\"out\": ' || {jq:text} || ', \"token\": ' || turn || '}' end"


@query(
    "tool_result_detect",
    f"""with r as (select conv_id, turn, {data.duck_text(RESULT_SQL)} as res from conversations),
    g as (select conv_id, turn, {S.keyword_reason('res', RULES, 'Result: ')} as keyword, {S.pattern_reason('res', RULES, 'Result: ')} as pattern from r)
    select conv_id, turn, case when keyword is null and pattern is null then null else concat_ws('; ', keyword, pattern) end as reason from g""",
)
def tool_result_detect(spark, sf):
    res = F.to_json(F.try_parse_json(F.expr(data.spark_text(RESULT_SQL))))
    df = data.turns_or_texts(spark, sf, "conversations").withColumn("res", pin(res))
    return df.select("conv_id", "turn", D.combine(D.detector_results(RULES, tool_result=F.col("res")))["reason"].alias("reason"))


DETECT_CTES = f"""k as (select doc_id, lang, source, {S.keyword_reason('text', RULES)} as a, {S.pattern_reason('text', RULES)} as b from corpus),
  g as (select doc_id, lang, source, {S.level_from('a', 'b')} as level,
    case when a is null and b is null then null else concat_ws('; ', a, b) end as reason from k)"""


@query(
    "detect_sensitivity",
    f"{CORPUS}, {DETECT_CTES} select doc_id, level, reason, 'ruleDetector' as detector_type, 1.0::double as confidence from g",
)
def detect_sensitivity(spark, sf):
    df = data.corpus(spark, sf).withColumn("d", pin(D.detect_sensitivity(POLICY, message=F.col("text"))))
    return df.select("doc_id", "d.*")


@query(
    "evaluate_policy",
    f"{CORPUS}, {DETECT_CTES} select doc_id, level, {S.action_from('level', 'review', 'block')} as action, reason from g",
)
def evaluate_policy(spark, sf):
    """Policy with S2 on review and an unknown S3 action, which blocks."""
    return C.grade(data.corpus(spark, sf), policy=R.Policy(handling_s2="Review ", handling_s3="explode")).select("doc_id", "graded.*")


@query(
    "rule_merge",
    f"""{CORPUS}, k as (select {S.keyword_reason('text', CUSTOM)} as a, {S.pattern_reason('text', CUSTOM)} as b from corpus),
    g as (select {S.level_from('a', 'b')} as level, concat_ws('; ', a, b) as reason from k)
    select level, {S.action_from('level')} as action, reason, count(*) as n from g group by 1, 2, 3""",
)
def rule_merge(spark, sf):
    """Grades under merged rules: two lists replaced, the rest at their defaults."""
    g = C.grade(data.corpus(spark, sf), policy=R.Policy(rules=CUSTOM))
    return g.groupBy("graded.level", "graded.action", F.coalesce("graded.reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query("corpus_grade_report", f"{CORPUS}, {DETECT_CTES} select level, lang, source, count(*) as n from g group by 1, 2, 3")
def corpus_grade_report(spark, sf):
    return C.grade_report(C.grade(data.corpus(spark, sf)), "lang", "source")


@query(
    "reason_concat",
    f"{CORPUS}, {DETECT_CTES} select unnest(string_split(reason, '; ')) as reason, count(*) as n from g where reason is not null group by 1",
)
def reason_concat(spark, sf):
    """Reasons joined per document, then counted one by one: the top rules of a corpus."""
    return C.rule_report(C.grade(data.corpus(spark, sf)).filter(F.col("graded.reason").isNotNull()))


# ---- redaction


@query("normalize_text", f"{CORPUS} select doc_id, {S.normalized('text')} as text from corpus")
def normalize_text(spark, sf):
    return data.corpus(spark, sf).select("doc_id", normalize(F.col("text")).alias("text"))


def _stage(stages, options=()):
    def run(spark, sf):
        df = data.corpus(spark, sf).withColumn("r", pin(redact(F.col("text"), options, stages=stages)))
        return df.select("doc_id", F.col("r.text").alias("redacted"), shown(F.col("r.replacements")).alias("replaced"))

    return run


def _stage_sql(stages, options=()) -> str:
    return f"{CORPUS}, {S.redaction_ctes('corpus', 'doc_id', options, stages=stages)} select doc_id, t as redacted, {S.shown()} as replaced from redacted"


for _name, _stages, _options in (
    ("redact_private_key", ("private_key",), ()),
    ("redact_keys", ("keys",), ()),
    ("redact_pii_optin", ("opt_in",), ALL),
    ("redact_context_values", ("labels",), ("pin",)),
    ("redact_paths", ("paths",), ()),
    ("redact_text", ("private_key", "keys", "opt_in", "labels", "paths"), ALL),
):
    query(_name, _stage_sql(_stages, _options))(_stage(_stages, _options))


@query(
    "redact_with_prefix",
    f"""{CORPUS}, pre as (select doc_id, 'config.password: ' as prefix, 'config.password: ' || text as text from corpus),
    {S.redaction_ctes('pre', 'doc_id', R.DEFAULT_ON)}
    select doc_id, case when starts_with(t, prefix) then substr(t, len(prefix) + 1) else t end as redacted from redacted""",
)
def redact_with_prefix(spark, sf):
    prefix = F.lit("config.password: ")
    df = data.corpus(spark, sf).withColumn("r", pin(redact(F.concat(prefix, "text"))["text"]))
    cut = F.when(F.col("r").startswith(prefix), F.substr("r", F.lit(18))).otherwise(F.col("r"))
    return df.select("doc_id", cut.alias("redacted"))


PER_ROW = {"credit_card": "doc_id % 2 = 0", "email": "doc_id % 64 < 32", "pin": "doc_id % 3 > 0"}


@query(
    "redaction_options",
    f"""{CORPUS}, {S.redaction_ctes('corpus', 'doc_id', ('chinese_phone', 'chinese_id'), per_row=PER_ROW)}
    select doc_id, t as redacted, {S.shown()} as replaced from redacted""",
)
def redaction_options(spark, sf):
    """Options brought along per row as JSON, over the defaults."""
    flags = F.struct(*[F.expr(v).alias(k) for k, v in PER_ROW.items()]).alias("options")
    df = data.corpus(spark, sf).withColumn("request", pin(parse_object(F.to_json(F.struct(flags)))))
    done = C.redact_corpus(df, options=(), option_columns=request_options(F.col("request")))
    return done.select("doc_id", "redacted", shown(F.col("replacements")).alias("replaced"))


@query(
    "redaction_report",
    f"""{CORPUS}, {S.redaction_ctes('corpus', 'doc_id', ALL)}, x as (select source, unnest(r) as e from redacted)
    select e.tag as tag, source, count(*) as n_values from x group by 1, 2""",
)
def redaction_report(spark, sf):
    return C.tag_report(C.redact_corpus(data.corpus(spark, sf), options=ALL), "source")


CONV = f"with conv as (select conv_id, turn, role, text || ' mail user' || (turn % 2) || '@example.com password: user' || (turn % 2) || '@example.com token pw' || turn as text from conversations), {S.redaction_ctes('conv', 'turn', R.DEFAULT_ON)}"


def _conv(spark, sf):
    tail = F.expr("' mail user' || (turn % 2) || '@example.com password: user' || (turn % 2) || '@example.com token pw' || turn")
    return data.turns_or_texts(spark, sf, "conversations").withColumn("text", F.concat("text", tail))


#: turns of a body; a client's request holds a window of a conversation, and a row stays bounded
WINDOW = 64


def _bodies(spark, sf):
    """Whole conversations as payloads (conv_id, part, body): contents are strings, or lists of parts for every third turn."""
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))
    content = F.when(F.col("turn") % 3 == 2, F.to_json(F.array(text, image))).otherwise(F.get_json_object(F.to_json(F.struct(F.array("text").alias("t"))), "$.t"))
    rows = _conv(spark, sf).select("conv_id", "turn", F.floor(F.col("turn") / WINDOW).alias("part"), "role", "text", content.alias("content"))
    # a string's JSON without the list around it
    json = F.when(F.col("turn") % 3 == 2, F.col("content")).otherwise(F.expr("substring(content, 2, length(content) - 2)"))
    message = F.concat(F.lit('{"content":'), json, F.lit(',"role":'), F.to_json(F.col("role").try_cast("string").try_cast("variant")), F.lit(',"turn":'), F.col("turn").cast("string"), F.lit("}"))
    each = rows.withColumn("message", message).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "message"))).alias("m"))
    return each.select("conv_id", "part", F.concat(F.lit('{"messages":['), F.array_join("m.message", ","), F.lit("]}")).alias("body"))


def _read_messages(df, context):
    """Messages as rows again: conv_id, turn, role, content."""
    items = F.explode(F.try_variant_get(F.parse_json(F.col(context)), "$", "array<variant>")).alias("m")
    rows = df.select("*", items)
    text = F.coalesce(F.when(F.col("turn_") % 3 == 2, F.try_variant_get("m", "$.content[0].text", "string")), F.try_variant_get("m", "$.content", "string"))
    return rows.withColumn("turn_", F.try_variant_get("m", "$.turn", "long")).withColumns({"turn": F.col("turn_"), "role": F.try_variant_get("m", "$.role", "string"), "content": text})


@query(
    "redact_messages",
    f"""{CONV}, counts as (select conv_id, turn // {WINDOW} as part, count(*) as segments_processed from conv group by 1, 2),
    vals as (select conv_id, turn // {WINDOW} as part, count(distinct e.original) as redacted_values, count(*) as n_values
      from (select conv_id, turn, unnest(r) as e from redacted) group by 1, 2)
    select redacted.conv_id, turn, role, t as content, segments_processed, redacted_values, n_values
    from redacted join counts on counts.conv_id = redacted.conv_id and counts.part = turn // {WINDOW}
      join vals on vals.conv_id = redacted.conv_id and vals.part = turn // {WINDOW}""",
)
def redact_messages(spark, sf):
    """Conversation bodies redacted as a whole, read back message by message."""
    df = _bodies(spark, sf).withColumn("payload", pin(parse_object(F.col("body"))))
    done = redact_context(df).select("conv_id", "part", "redaction.*")
    token = F.size(decode_token(F.col("restore_token"))["replacements"]).cast("long")
    rows = _read_messages(done.withColumn("n_values", token), "redacted_context")
    return rows.select("conv_id", "turn", "role", "content", "segments_processed", "redacted_values", "n_values")


@query(
    "restore_messages",
    f"""{CONV},
    q as (select conv_id, turn, unnest(r) as e, generate_subscripts(r, 1) as ord from redacted),
    queue as (select conv_id, turn // {WINDOW} as part, e.tag as tag, e.original as original, row_number() over (partition by conv_id, turn // {WINDOW}, e.tag order by turn, ord) as n from q),
    pieces as (select conv_id, turn, regexp_extract_all(t, {S.q(R.PLACEHOLDER)}) as tags, regexp_split_to_array(t, {S.q(R.PLACEHOLDER)}) as gaps from redacted),
    marks as (select conv_id, turn, unnest(tags) as tag, generate_subscripts(tags, 1) as pos from pieces),
    filled as (select m.conv_id, m.turn, m.pos, coalesce(q.original, m.tag) as v from (
      select *, turn // {WINDOW} as part, row_number() over (partition by conv_id, turn // {WINDOW}, tag order by turn, pos) as n from marks) m left join queue q using (conv_id, part, tag, n)),
    vs as (select conv_id, turn, list(v order by pos) as v from filled group by 1, 2)
    select p.conv_id, p.turn, case when v is null then p.gaps[1] else
      array_to_string(list_transform(list_zip(p.gaps, v), lambda z: z[1] || coalesce(z[2], '')), '') end as content
    from pieces p left join vs using (conv_id, turn)""",
)
def restore_messages(spark, sf):
    """Bodies out and back: redacted contexts with their tokens, restored with one queue for a body."""
    df = _bodies(spark, sf).withColumn("payload", pin(parse_object(F.col("body"))))
    out = staged(redact_context(df).select("conv_id", "redaction.redacted_context", "redaction.restore_token"), "contexts")
    asked = F.concat(F.lit('{"redacted_messages":'), "redacted_context", F.lit(',"restore_token":"'), "restore_token", F.lit('"}'))
    back = restore_context(out.withColumn("payload", pin(parse_object(asked))), continued=True).select("conv_id", "restoration.restored_context")
    return _read_messages(back, "restored_context").select("conv_id", "turn", "content")


@query(
    "mapping_merge",
    f"""{CONV}, x as (select conv_id, turn, unnest(r) as e, generate_subscripts(r, 1) as pos from redacted),
    m as (select conv_id, e.original as original, arg_max(e.tag, turn * 100000 + pos) as tag, count(*) as times from x group by 1, 2)
    select m.*, s.segments_processed, count(*) over (partition by conv_id) as redacted_values from m
    join (select conv_id, count(*) as segments_processed from conv group by 1) s using (conv_id)""",
)
def mapping_merge(spark, sf):
    done = staged(C.redact_corpus(_conv(spark, sf)).select("conv_id", "turn", "redacted", "replacements"), "redacted")
    merged = C.merged_mapping(done, "conv_id", "turn")
    return merged.join(C.redaction_counts(done, merged, "conv_id"), "conv_id")


@query(
    "replacement_vault",
    f"""{CORPUS}, {S.redaction_ctes('corpus', 'doc_id', ALL)}, x as (select doc_id, unnest(r) as e, generate_subscripts(r, 1) - 1 as ord from redacted)
    select doc_id, ord, e.original as original, e.tag as tag from x""",
)
def replacement_vault(spark, sf):
    """The vault by way of its tokens: encoded, decoded again, one row per replacement."""
    df = C.redact_corpus(data.corpus(spark, sf), options=ALL).select("doc_id", "replacements")
    back = df.select("doc_id", decode_token(encode_token(F.col("replacements")))["replacements"].alias("replacements"))
    rows = C.vault_rows(back, "doc_id")
    return rows.withColumn("ord", F.col("ord").cast("long"))


@query(
    "restore_text",
    f"""{CORPUS}, {S.redaction_ctes('corpus', 'doc_id', ALL)},
    q as (select doc_id, unnest(r) as e, generate_subscripts(r, 1) as ord from redacted),
    queue as (select doc_id, e.tag as tag, e.original as original, row_number() over (partition by doc_id, e.tag order by ord) as n from q),
    pieces as (select doc_id, regexp_extract_all(t, {S.q(R.PLACEHOLDER)}) as tags, regexp_split_to_array(t, {S.q(R.PLACEHOLDER)}) as gaps from redacted),
    marks as (select doc_id, unnest(tags) as tag, generate_subscripts(tags, 1) as pos from pieces),
    filled as (select m.doc_id, m.pos, coalesce(q.original, m.tag) as v from (
      select *, row_number() over (partition by doc_id, tag order by pos) as n from marks) m left join queue q using (doc_id, tag, n)),
    vs as (select doc_id, list(v order by pos) as v from filled group by 1)
    select p.doc_id, case when v is null then p.gaps[1] else
      array_to_string(list_transform(list_zip(p.gaps, v), lambda z: z[1] || coalesce(z[2], '')), '') end as restored
    from pieces p left join vs using (doc_id)""",
)
def restore_text(spark, sf):
    """Redact, keep text and vault apart, join them again and restore."""
    done = staged(C.redact_corpus(data.corpus(spark, sf), options=ALL).select("doc_id", "redacted", "replacements"), "redacted")
    out = C.restore_corpus(done.select("doc_id", "redacted"), C.vault(done, "doc_id"), "doc_id")
    return out.select("doc_id", "restored")
