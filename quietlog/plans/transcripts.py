"""Queries over payloads, session tracks and context selection, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietlog.functions import detect as D
from quietlog.functions import payload as P
from quietlog.functions import rules as R
from quietlog.functions.text import pin
from quietlog.operators import context as X
from quietlog.operators.guard import audit_entries, decision_counts, guard, rollup_nodes, safe_session_id
from quietlog.plans import data
from quietlog.plans import redact_sql as S
from quietlog.session import scratch
from quietlog.sources import tracks as T
from quietlog.sources.track_store import TrackStore

POLICY, RULES = R.Policy(), R.Rules()
QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# ---- payload text nodes

STR = "t.type = 'VARCHAR' and trim(json_extract_string(r.doc, t.fullkey)) <> ''"
KEY_PATH = "regexp_replace(regexp_replace(t.fullkey, '\\[\\d+\\]', '', 'g'), '^\\$\\.?', '')"


def _duck_nodes() -> str:
    def top(role, key):
        return f"select payload_id, '{role}' as role, json_extract_string(body, '$.{key}') as text, '' as prefix from payloads where json_type(body, '$.{key}') = 'VARCHAR'"

    plain = " union all ".join(top(r, k) for r, k in (("system", "system"), ("system", "system_prompt"), ("user", "input"), ("user", "prompt")))
    roots = " union all ".join(
        [f"select payload_id, 'user' as role, '' as root, json_extract(body, '$.input') as doc from payloads where json_type(body, '$.input') in ('ARRAY', 'OBJECT')"]
        + [f"select payload_id, 'tool', '{k}', json_extract(body, '$.{k}') from payloads where json_type(body, '$.{k}') is not null" for k in P.PARAM_KEYS]
        + [f"select payload_id, role, '{P.ARGS_PATH}', args::json from args where json_valid(args) and json_type(args) in ('ARRAY', 'OBJECT')"]
    )
    return f"""msgs as (select payload_id, unnest(json_extract(body, '$.messages[*]')) as m from payloads),
    args as (select payload_id, coalesce(json_extract_string(m, '$.role'), '') as role,
      json_extract_string(unnest(json_extract(m, '$.tool_calls[*]')), '$.function.arguments') as args from msgs where json_type(m) = 'OBJECT'),
    roots as ({roots}),
    nodes as (select * from (
      {plain}
      union all select payload_id, coalesce(json_extract_string(m, '$.role'), ''), json_extract_string(m, '$.content'), '' from msgs where json_type(m, '$.content') = 'VARCHAR'
      union all select payload_id, role, json_extract_string(c, '$.text'), '' from (select payload_id, coalesce(json_extract_string(m, '$.role'), '') as role,
        unnest(json_extract(m, '$.content[*]')) as c from msgs where json_type(m, '$.content') = 'ARRAY') p where json_type(c, '$.text') = 'VARCHAR'
      union all select payload_id, role, args, '' from args where not (json_valid(args) and json_type(case when json_valid(args) then args else '1' end) in ('ARRAY', 'OBJECT'))
      union all select r.payload_id, r.role, json_extract_string(r.doc, t.fullkey), concat_ws('.', nullif(r.root, ''), nullif({KEY_PATH}, ''))
        from roots r, json_tree(r.doc) t where {STR}
    ) n where trim(text) <> '')"""


NODES = f"with {data.duck_payloads()}, {_duck_nodes()}"
DETECT_TEXT = "case when prefix = '' then text else prefix || ': ' || text end"


@query("payload_text_nodes", f"{NODES} select payload_id, role, text, {DETECT_TEXT} as detect_text, prefix as context_prefix from nodes")
def payload_text_nodes(spark, sf):
    df = P.with_text_nodes(data.payloads(spark, sf))
    return df.select("payload_id", F.explode("nodes").alias("n")).select("payload_id", "n.role", "n.text", "n.detect_text", "n.context_prefix")


@query(
    "recursive_strings",
    f"""with {data.duck_payloads()}, r as (select payload_id, body::json as doc from payloads)
    select r.payload_id, {KEY_PATH} as path, json_extract_string(r.doc, t.fullkey) as value from r, json_tree(r.doc) t where {STR}""",
)
def recursive_strings(spark, sf):
    df = data.payloads(spark, sf).withColumn("s", P.recursive_strings(F.col("body")))
    return df.select("payload_id", F.explode("s").alias("s")).select("payload_id", "s.path", "s.value")


@query("json_argument_nodes", f"{NODES} select payload_id, text, prefix as context_prefix from nodes where starts_with(prefix, 'tool_calls') or text = 'plain token text'")
def json_argument_nodes(spark, sf):
    """Nodes of tool-call arguments only: walked where they are JSON, else one plain node."""
    df = P.with_text_nodes(data.payloads(spark, sf))
    return (
        df.select("payload_id", F.explode("nodes").alias("n"))
        .filter(F.col("n.addr").contains("/function/arguments"))
        .select("payload_id", "n.text", "n.context_prefix")
    )


GRADING = f"""paths as (select p.payload_id, json_extract_string(p.body, t.fullkey) as path, t.id as pos from payloads p, json_tree(p.body) t
    where t.type = 'VARCHAR' and (contains(json_extract_string(p.body, t.fullkey), '/') or contains(json_extract_string(p.body, t.fullkey), chr(92)))),
  pl as (select payload_id, list(path order by pos) as ps from paths group by 1),
  params as (select payload_id, {S.path_reason('ps', RULES)} as c from pl),
  node_reasons as (select n.payload_id, {S.keyword_reason(DETECT_TEXT, RULES)} as a, {S.pattern_reason(DETECT_TEXT, RULES)} as b, params.c as c
    from nodes n left join params using (payload_id)),
  node_levels as (select payload_id, {S.level_from('a', 'b', 'c')} as level from node_reasons),
  decided as (select p.payload_id, p.conv_id, coalesce(max(l.level), 'S1') as level, {S.action_from("coalesce(max(l.level), 'S1')")} as base
    from payloads p left join node_levels l using (payload_id) group by 1, 2),
  inputs as (select n.payload_id, n.role, n.text as full_text, case when n.prefix = '' then '' else n.prefix || ': ' end as pre,
    case when n.prefix = '' then n.text else n.prefix || ': ' || n.text end as text, d.level, d.base, d.base = 'redact' as forced
    from nodes n join decided d using (payload_id)),
  {S.redaction_ctes('inputs', 'payload_id', R.DEFAULT_ON, per_row=dict.fromkeys(R.FORCED_ON, 'forced'))},
  entries as (select payload_id, role, full_text, level, base,
    case when base = 'block' then '[PRIVATE]' when base = 'redact' or len(r) > 0 then case when starts_with(t, pre) then substr(t, len(pre) + 1) else t end
      else full_text end as clean_text,
    case when base = 'block' then 'block' when base = 'redact' or len(r) > 0 then 'redact' else 'allow' end as decision from redacted)"""
GRADED = f"{NODES}, {GRADING}"


@query(
    "payload_policy",
    f"""{GRADED}, hits as (select payload_id, count(*) as n_nodes, bool_or(decision = 'redact') as red from entries group by 1)
    select d.payload_id, d.level, case when base = 'allow' and coalesce(red, false) then 'redact' else base end as action,
      case when base = 'block' then 403 else 200 end as status_code, coalesce(n_nodes, 0) as n_nodes from decided d left join hits using (payload_id)""",
)
def payload_policy(spark, sf):
    g = guard(data.payloads(spark, sf))
    return g.select("payload_id", "decision.level", "decision.action", "status_code", F.size("entries").cast("long").alias("n_nodes"))


@query("payload_write_back", f"{GRADED} select payload_id, role, clean_text as text from entries where base <> 'block'")
def payload_write_back(spark, sf):
    """Released bodies, taken apart again."""
    path = scratch(spark, "released")
    guard(data.payloads(spark, sf)).select("payload_id", "body_out").filter("body_out is not null").write.parquet(path)
    df = P.with_text_nodes(spark.read.parquet(path), "body_out")
    return df.select("payload_id", F.explode("nodes").alias("n")).select("payload_id", "n.role", "n.text")


@query(
    "policy_action_stats",
    f"{GRADED} select decision, level, role, 'c' || (payload_id // 1000) as session_id, count(*) as n from entries group by 1, 2, 3, 4",
)
def policy_action_stats(spark, sf):
    g = guard(data.payloads(spark, sf))
    return decision_counts(audit_entries(g, F.concat(F.lit("c"), F.col("conv_id")), "payload_id"))


PLANTED_TURN = "text || case turn % 4 when 1 then ' my secret' when 2 then ' host 10.0.0.1' when 3 then ' id_rsa' else '' end"


@query(
    "policy_rollup",
    f"""with c as (select conv_id, turn, {PLANTED_TURN} as text from conversations),
    k as (select conv_id, turn, {S.keyword_reason('text', RULES)} as a, {S.pattern_reason('text', RULES)} as b from c),
    g as (select conv_id, turn, {S.level_from('a', 'b')} as level, concat_ws('; ', a, b) as reason from k)
    select conv_id, max(level) as level, {S.action_from('max(level)')} as action, case when max(level) > 'S1' then arg_max(reason, level || (1000 - turn)) end as reason
    from g group by conv_id""",
)
def policy_rollup(spark, sf):
    """Turns as nodes, folded per conversation."""
    df = data.turns_or_texts(spark, sf, "conversations").withColumn("text", F.expr(PLANTED_TURN))
    nodes = df.withColumn("d", pin(D.combine(D.detector_results(RULES, message=F.col("text")))))
    return rollup_nodes(nodes.select("conv_id", F.col("turn").alias("node_idx"), "d.rank", "d.reason"), "conv_id")


@query(
    "context_payload_select",
    f"""with {data.duck_payloads()} select payload_id, case when json_type(body, '$.messages') = 'ARRAY' then 'messages' else 'error' end as mode from payloads
    where payload_id % 3 = 0 union all
    select payload_id, 'text' from payloads where payload_id % 3 = 1 union all select payload_id, case when payload_id % 2 = 0 then 'error' else 'missing' end from payloads where payload_id % 3 = 2""",
)
def context_payload_select(spark, sf):
    body = F.expr(
        "case payload_id % 3 when 0 then body when 1 then concat('{\"context\": \"x\", ', substr(body, 2)) "
        "else case when payload_id % 2 = 0 then '{\"context\": null, \"text\": \"a\"}' else '{\"other\": 1}' end end"
    )
    v = P.parse_object(body)
    return data.payloads(spark, sf).select("payload_id", P.context_payload(v)["mode"].alias("mode"))


# ---- tracks

FEW = 8  # buckets for test data


def _entries(spark, sf):
    """Messages with an optional clean text or placeholder, some of them invalid."""
    return data.messages(spark, sf).select(
        "session_id",
        "seq",
        F.when(F.col("seq") == 6, " ").otherwise(F.col("role")).alias("role"),
        F.when(F.col("seq") == 5, None).otherwise(F.concat("text", F.lit(" token tk"))).alias("full_text"),
        F.when(F.col("seq").isin(1, 7), F.concat(F.lit("clean "), F.col("seq"))).alias("clean_text"),
        F.when(F.col("seq").isin(2, 7), "[HIDDEN]").otherwise("").alias("placeholder"),
        (F.col("seq") * 1000).alias("timestamp_ms"),
        F.concat(F.lit('{"n": '), F.col("seq"), F.lit(', "s": "x", "z": null}')).alias("metadata"),
        (F.col("seq") == 3).alias("redact"),
    )


DUCK_ENTRIES = """entries as (select conv_id::varchar as session_id, turn as seq, role, text || ' token tk' as full_text,
  case turn when 1 then 'clean 1' when 2 then '[HIDDEN]' when 3 then null else text || ' token tk' end as given from conversations where turn not in (5, 6, 7))"""
# the clean text of redacted turns needs the redaction chain
DUCK_CLEAN = f"""with {DUCK_ENTRIES}, src as (select *, full_text as text from entries),
  {S.redaction_ctes('src', 'seq', R.DEFAULT_ON)}, msgs as (select session_id, seq, role, full_text, coalesce(given, t) as clean_text from redacted)"""


def _stored(spark, sf):
    path = scratch(spark, "tracks")
    usable, _ = T.valid(_entries(spark, sf), "redact")
    T.append_tracks(T.ingest(usable, redact_flag="redact"), path, buckets=FEW)
    return path


def _store(spark, sf, size=None):
    usable, _ = T.valid(_entries(spark, sf), "redact")
    store = TrackStore(spark, scratch(spark, "track-store"), buckets=FEW, size=size)
    store.append(T.ingest(usable, redact_flag="redact"))
    return store


@query(
    "message_ingest",
    f"{DUCK_CLEAN} select session_id, seq, role, full_text, clean_text, '{{\"n\":\"' || seq || '\",\"s\":\"x\",\"z\":\"<nil>\"}}' as metadata, 'ok' as state from msgs"
    " union all select conv_id::varchar, turn, case turn when 6 then ' ' else role end, case turn when 5 then null else text || ' token tk' end,"
    " case turn when 7 then 'clean 7' end, null, 'refused' from conversations where turn in (5, 6, 7)",
)
def message_ingest(spark, sf):
    usable, refused = T.valid(_entries(spark, sf), "redact")
    done = T.ingest(usable, redact_flag="redact")
    cols = ["session_id", "seq", "role", "full_text", "clean_text"]
    return done.select(*cols, F.to_json("metadata").alias("metadata"), F.lit("ok").alias("state")).unionByName(
        refused.select(*cols, F.lit(None).cast("string").alias("metadata"), F.lit("refused").alias("state"))
    )


TRACK_ROWS = "select session_id, seq, role, 'full' as track, full_text as content from msgs union all select session_id, seq, role, 'clean', clean_text from msgs"


@query("audit_dual_append", f"{DUCK_CLEAN} select * from ({TRACK_ROWS}) x")
def audit_dual_append(spark, sf):
    path = _stored(spark, sf)
    both = T.read_track(spark, path, "full").unionByName(T.read_track(spark, path, "clean"))
    return both.select("session_id", "seq", "role", "track", "content")


@query("audit_track_scan", f"{DUCK_CLEAN} select session_id, seq, role, content, seq * 1000 as timestamp_ms from ({TRACK_ROWS}) x where track = 'full'")
def audit_track_scan(spark, sf):
    """JSONL files as the reference lays them out, blank and broken lines among them, numbered on reading."""
    path = scratch(spark, "jsonl")
    usable, _ = T.valid(_entries(spark, sf), "redact")
    rows = T.dual_rows(T.ingest(usable, redact_flag="redact")).filter("track = 'full'")
    line = F.to_json(F.struct("role", "content", "timestamp_ms", "metadata"))
    lines = F.when(F.col("seq") % 2 == 0, F.array(line, F.lit(""), F.lit("{broken"))).otherwise(F.array(line))
    (
        rows.select("session_id", "seq", F.posexplode(lines).alias("p", "value"))
        .repartition("session_id")
        .sortWithinPartitions("session_id", "seq", "p")
        .select("session_id", "value")
        .write.partitionBy("session_id")
        .text(f"{path}/full")
    )
    back = T.import_track_files(spark, path, layout="folders")
    return back.select("session_id", "seq", "role", "content", "timestamp_ms")


@query("session_list", f"{DUCK_CLEAN} select distinct session_id from msgs")
def session_list(spark, sf):
    return _store(spark, sf).sessions()


@query("session_load", f"{DUCK_CLEAN} select session_id, seq, role, 'clean' as track, clean_text as content from msgs where session_id = '3' order by seq desc limit 3")
def session_load(spark, sf):
    return _store(spark, sf).session("3", limit=3).select("session_id", "seq", "role", "track", "content")


@query(
    "track_trim",
    f"""{DUCK_CLEAN}, rows as ({TRACK_ROWS}), sized as (select *, sum(strlen(content) + strlen(role) + 90 + strlen((seq * 1000)::varchar)) over w as bytes, count(*) over w as n,
      row_number() over (partition by track, session_id order by seq desc) as back from rows window w as (partition by track, session_id))
    select session_id, seq, track, content from sized where n <= 3 or bytes < 3000 or back <= 3""",
)
def track_trim(spark, sf):
    """The last 3 rows of sessions above 3000 bytes (the defaults would not touch test data)."""
    store = _store(spark, sf, F.octet_length("content") + F.octet_length("role") + 90 + F.octet_length(F.col("timestamp_ms").cast("string")))
    store.trim(3, 2999)
    both = store.read("full").unionByName(store.read("clean"))
    return both.select("session_id", "seq", "track", "content")


# ---- context

CTX_TEXT = "case when turn = 3 then '  ' else text || case turn % 3 when 0 then ' 北京市 Ünit_7' when 1 then ' テスト 한국 part' else '' end end"
ASK = "text || ' 北京'"
TOKENS = """toks as (select s, i, unnest(case when regexp_matches(seg, '[\\x{3400}-\\x{9fff}]') then
    list_concat(list_transform(range(1, len(seg) + 1), lambda k: 'u:' || substr(seg, k, 1)), list_transform(range(1, len(seg)), lambda k: 'b:' || substr(seg, k, 2)))
    else list_concat(['w:' || seg], list_transform(range(1, least(len(seg) - 1, 9)), lambda k: 'g:' || substr(seg, k, 3))) end) as token
  from (select s, i, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+|[\\p{Han}]+|[\\p{Hiragana}\\p{Katakana}]+|[\\p{Hangul}]+')) as seg from src) x)"""
SRC = f"""src as (select s, i, text from (select conv_id as s, turn as i, {CTX_TEXT} as text from conversations) d where trim(text) <> ''
  union all select conv_id, -1, {ASK} from conversations where turn = 0)"""
WEIGHTED = f"""with {SRC}, {TOKENS}, w as (select s, i, token, count(*) * case substr(token, 1, 2) when 'u:' then 0.7 when 'g:' then 0.4 else 1.0 end::double as w from toks group by 1, 2, 3),
  df as (select s, token, count(*) as df from w where i >= 0 group by 1, 2), sizes as (select s, count(*) as n from src where i >= 0 group by 1),
  vec as (select w.s, w.i, w.token, w.w / sum(w.w) over (partition by w.s, w.i) * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) as x from w join sizes using (s) left join df using (s, token)),
  norms as (select s, i, sqrt(sum(x * x)) as norm from vec group by 1, 2),
  dots as (select d.s, d.i, sum(d.x * q.x) as dot from vec d join vec q on d.s = q.s and d.token = q.token and q.i = -1 where d.i >= 0 group by 1, 2),
  scored as (select src.s, src.i, text, coalesce(dot / (nd.norm * nq.norm), 0) as score from src join norms nq on nq.s = src.s and nq.i = -1
    left join norms nd on nd.s = src.s and nd.i = src.i left join dots on dots.s = src.s and dots.i = src.i where src.i >= 0)"""


def _docs(spark, sf):
    turns = data.turns_or_texts(spark, sf, "conversations")
    docs = turns.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("index"), F.expr(CTX_TEXT).alias("text"))
    asks = turns.filter("turn = 0").select(F.col("conv_id").alias("session_id"), F.expr(ASK).alias("query"))
    return docs, asks


@query("tokenize", f"with {SRC}, {TOKENS} select s as session_id, i as index, token, count(*) as n from toks where i >= 0 group by 1, 2, 3")
def tokenize(spark, sf):
    docs, _ = _docs(spark, sf)
    toks = docs.select("session_id", "index", F.explode(X.tokenize(F.col("text"))).alias("token"))
    return toks.groupBy("session_id", "index", "token").agg(F.count("*").alias("n"))


@query("doc_frequency", f"{WEIGHTED} select s as session_id, token, df from df")
def doc_frequency(spark, sf):
    docs, _ = _docs(spark, sf)
    return X.doc_frequency(X.postings(docs, ["session_id", "index"]), "session_id")


@query("tfidf_vector", f"{WEIGHTED} select s as session_id, i as index, token, round(x, 6) as x from vec where i >= 0")
def tfidf_vector(spark, sf):
    docs, _ = _docs(spark, sf)
    posts = X.postings(docs, ["session_id", "index"])
    totals = posts.groupBy("session_id", "index").agg(F.sum("weight").alias("total"))
    sizes = docs.filter(F.trim("text") != "").groupBy("session_id").agg(F.count("*").alias("n_docs"))
    vec = X.tfidf(posts, X.doc_frequency(posts, "session_id"), sizes, totals, ["session_id", "index"], "session_id")
    return vec.withColumn("x", F.round("x", 6))


@query("cosine_score", f"{WEIGHTED} select s as session_id, i as index, round(score, 6) as score from scored")
def cosine_score(spark, sf):
    return X.scores(*_docs(spark, sf)).select("session_id", "index", F.round("score", 6).alias("score"))


@query(
    "context_select",
    f"""{WEIGHTED} select s as session_id, rank, i as index, text, round(score, 6) as score from (
      select *, row_number() over (partition by s order by round(score, 12) desc, i) as rank from scored) x where rank <= 3""",
)
def context_select(spark, sf):
    out = X.select_context(*_docs(spark, sf), top_k=3)
    return out.select("session_id", "rank", "index", "text", F.round("score", 6).alias("score"))
