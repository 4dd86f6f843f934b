"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.llm import bpe, chat_format, fingerprints, language, leaks, near_dups, neighbours, packing, pii, repair, repeats, trie, warc
from quietlog.llm.common import table

#: the tokenizer's file on every executor
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.convert_pages(table(spark, folder, "pages"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.predict(docs, language.fit(docs.where(~language.held_out() & F.col("doc_id").isNotNull())))


def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digests(table(spark, folder, "documents"))


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), TOKENIZER)


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found(table(spark, folder, "documents"), pii.train(pii.labelled()))


#: a conversation that holds control strings of the template
PLANTED = ((-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"))


def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    planted = spark.createDataFrame(list(PLANTED), "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.digests(chat_format.formatted(rows))


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compared(table(spark, folder, "documents"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), TOKENIZER)


def op10_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.groups(table(spark, folder, "documents"))


def op11_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.trie(*trie.rebuilt(trie.turn_rows(table(spark, folder, "conversations"))))


def op13_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_neighbours": op3_neighbours,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_chat_format": op7_chat_format,
    "op8_fingerprints": op8_fingerprints,
    "op9_packing": op9_packing,
    "op10_near_dups": op10_near_dups,
    "op11_decontaminate": op11_decontaminate,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_structure_repair": op13_structure_repair,
}

def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII string."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ord(ch), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end"
    return f"xor(list_reduce(list_concat([4294967295], {steps}), lambda a, x: {step}), 4294967295)"


ORACLE: dict[str, str] = {
    "op3_neighbours": """
with v as (
  select vec_id, min(embedding) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
  group by vec_id
), d as (
  select q.vec_id as query_id, c.vec_id,
    sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (cast(p[1] as double) - p[2]) * (cast(p[1] as double) - p[2])))) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0
), r as (
  select *, cast(row_number() over (partition by query_id order by score, vec_id) as integer) as rank from d
)
select query_id, rank, vec_id, score from r where rank <= 10
""",
    "op7_chat_format": """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e as (
  select *, regexp_replace(text, '([<\\[])(\\\\*)(/?s>|/?INST\\]|/?ROLE\\])', '\\1\\\\\\2\\3', 'g') as esc,
    regexp_replace(role, '([<\\[])(\\\\*)(/?s>|/?INST\\]|/?ROLE\\])', '\\1\\\\\\2\\3', 'g') as esc_role from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(3 + sum(length(esc) + case role when 'user' then 13 when 'assistant' then 4 else 17 + length(esc_role) end) as bigint) as formatted_chars
from e group by conv_id
""",
    "op11_decontaminate": r"""
with d as (
  select doc_id, row_number() over () as r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), bi as (
  select item_id, w, least(len(w), 10) as t, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0
), bw as (
  select distinct item_id, t, array_to_string(list_slice(w, i, i + t - 1), ' ') as win from bi
), di as (
  select r, w, t, unnest(range(1, len(w) - t + 2)) as i from d, (select distinct t from bw)
), hit as (
  select distinct r, i, t, array_to_string(list_slice(w, i, i + t - 1), ' ') as win from di
  where array_to_string(list_slice(w, i, i + t - 1), ' ') in (select win from bw where bw.t = di.t)
), n as (
  select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + t)) as p from hit) group by r
), it as (
  select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
  from hit join bw using (t, win) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (r) left join it using (r)
""",
    "op12_prefix_trie": r"""
with r as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, id) as p, id, words from (
    select conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as id,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words
    from conversations where conv_id is not null)
), c as (
  select conv_id, CRC % 4 as h from (select distinct conv_id from r)
), reb as (
  select c.conv_id, r.p, 0 as own, id, words from c join r on r.conv_id = c.conv_id - c.conv_id % 20 and r.p <= c.h
  union all select c.conv_id, r.p, 1, id, words from c join r on r.conv_id = c.conv_id and r.p > c.h
), path as (
  select conv_id, list(id order by own, p) as ids, list(words order by own, p) as ws from reb group by conv_id
  union all select conv_id, [], [] from c where conv_id not in (select conv_id from reb)
), m as (
  select conv_id, d, array_to_string(list_slice(ids, 1, d), ',') as k, case when d > 0 then array_to_string(list_slice(ids, 1, d - 1), ',') end as pk,
    case when d > 0 then ws[d] else 0 end as w, len(ids) = d as last
  from (select *, unnest(range(0, len(ids) + 1)) as d from path)
), node as (
  select d, k, min(pk) as pk, min(conv_id) as conv_id, count(*) as n, max(w) as w,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where last), '')) as ends_sha256
  from m group by d, k
), kids as (
  select d - 1 as d, pk as k, count(*) as n_children from node where d > 0 group by d, pk
), full_node as (
  select node.*, coalesce(n_children, 0) as n_children, p.conv_id as parent_conv_id
  from node left join kids using (d, k) left join (select d + 1 as d, k as pk, conv_id from node) p using (d, pk)
)
select a.conv_id, a.d as depth, a.parent_conv_id, a.n as n_convs, a.n_children,
  count(*) filter (where b.n_children = 0) as n_leaves, cast(sum((b.n - 1) * b.w) as bigint) as saved_tokens, a.ends_sha256
from full_node a join full_node b on b.d >= a.d and (a.d = 0 or starts_with(b.k || ',', a.k || ','))
group by all
""".replace("CRC", _crc32("cast(conv_id as varchar)")),
    "op13_structure_repair": r"""
with recursive raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as id from conversations
), kinds as (
  select *, CRC % 20 as damage from raw
), rows_ as (
  select conv_id, turn, case when damage = 4 then 'user' else role end as role,
    case damage when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when damage = 3 then [0, 1] else [0] end) as copy
  from kinds where damage <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as place from rows_
), faults as (
  select *, coalesce(nullif(left(role, 1), ''), ' ') as initial, case
    when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
    when row_number() over (partition by conv_id, role, text order by place) > 1 then 'duplicate'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault
  from placed
), pairs as (
  select *, lag(initial) over (partition by conv_id order by place) || initial as pair from faults
), sums as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
    count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from pairs group by conv_id
), closure(p, q, c, a, o) as (
  values (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', 'Iu'), (0, 3, 4, 'II', 'IuIa'),
    (1, 2, 2, 'I', 'Iu'), (1, 3, 4, 'II', 'IuIa'), (2, 3, 2, 'I', 'Ia'), (3, 2, 2, 'I', 'Iu')
), made(p, q, o) as (
  values (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')
), next_(p, i, q) as (
  values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), kind as (
  select distinct initial as i, fault in ('blank', 'duplicate') as x, fault = 'truncated' as t from faults
), edit as (
  select i, x, t, p, p as q, 3 as c, 'D' as a, 'D ' as o from kind, (select distinct p from made)
  union all select i, x, t, p, q, 2 + cast(t as integer), 'R', 'R' || o from kind, made where not x
  union all select i, x, t, p, q, cast(t as integer), 'K', 'K ' from kind join next_ using (i) where not x
), step as (
  select i, x, t, e.p, k.q, min({'c': e.c + k.c, 'a': e.a || k.a, 'o': e.o || k.o}) as s
  from edit e join closure k on k.p = e.q group by all
), w as (
  select conv_id, cast(0 as bigint) as place, k.q as state, {'c': k.c, 'a': k.a, 'o': k.o} as s from (select distinct conv_id from faults), closure k where k.p = 0
  union all
  select w.conv_id, w.place + 1, step.q, min({'c': w.s.c + step.s.c, 'a': w.s.a || step.s.a, 'o': w.s.o || step.s.o})
  from w join faults f on f.conv_id is not distinct from w.conv_id and f.place = w.place + 1
  join step on step.p = w.state and step.i = f.initial and step.x = (f.fault in ('blank', 'duplicate')) and step.t = (f.fault = 'truncated')
  group by all
), best as (
  select w.conv_id, min(w.s) as s from w join sums on sums.conv_id is not distinct from w.conv_id and w.place = sums.n where state in (0, 3) group by w.conv_id
), units as (
  select conv_id, j, substr(s.o, cast(2 * j - 1 as bigint), 2) as u from (select *, unnest(range(1, len(s.o) // 2 + 1)) as j from best)
), at_ as (
  select *, sum(case when u in ('Iu', 'Ia') then 0 else 1 end) over (partition by conv_id order by j) as place from units
), lines as (
  select a.conv_id, j, case u when 'Iu' then 'user:' when 'Ia' then 'assistant:' when 'Ru' then 'user:' || text when 'Ra' then 'assistant:' || text
    when 'K ' then role || ':' || text end as line
  from at_ a left join faults f on f.conv_id is not distinct from a.conv_id and f.place = a.place
), whole as (
  select conv_id, sha256(coalesce(string_agg(line, chr(10) order by j) filter (where line is not null), '')) as repaired_sha256 from lines group by conv_id
)
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, cast(coalesce(s.c, 0) as bigint) as cost, coalesce(s.a, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) i left join sums on sums.conv_id is not distinct from i.conv_id
left join best on best.conv_id is not distinct from i.conv_id left join whole on whole.conv_id is not distinct from i.conv_id
""".replace("CRC", _crc32("id")),
}
