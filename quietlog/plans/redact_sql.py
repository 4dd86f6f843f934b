"""DuckDB SQL for the redaction and grading rules, used to check the Spark results."""

from __future__ import annotations

from quietlog.functions import rules as R
from quietlog.functions.text import INVISIBLE, SPACE_CHARS

OPEN, CLOSE = "\ue000", "\ue001"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# what normalisation can change in the planted corpus: entities, escapes, wide forms, invisibles
WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}


def normalized(t: str) -> str:
    t = f"replace({t}, '&#64;', '@')"
    t = (
        f"case when len(regexp_extract_all({t}, '%')) = len(regexp_extract_all({t}, '%[0-9A-Fa-f]{{2}}'))"
        f" then url_decode(replace({t}, '+', '%2B')) else {t} end"
    )
    return f"translate(translate(({t}), {q(''.join(WIDE))}, {q(''.join(WIDE.values()))}), {q(INVISIBLE)}, '')"


def _records(hits: str, tag: str) -> str:
    kept = f"list_filter({hits}, lambda o: trim(o, {q(SPACE_CHARS)}) <> '')"
    return f"list_transform({kept}, lambda o: {{'original': o, 'tag': {q(tag)}}})"


def contains_one(x: str, words) -> str:
    return "(" + " or ".join(f"contains(lower({x}), {q(w.lower())})" for w in words) + ")"


def sensitive(p: str, rules: R.Rules) -> str:
    marks = " or ".join(f"suffix(lower({p}), {q(s)})" for s in R.FILE_SUFFIXES)
    return (
        f"((contains({p}, '/') or contains({p}, {q(chr(92))})) and"
        f" ({contains_one(p, rules.paths_s3 + rules.paths_s2)} or {contains_one(p, R.FILE_WORDS)} or {marks}))"
    )


def redaction_ctes(
    source: str,
    key: str,
    options=(),
    rules: R.Rules = R.Rules(),
    stages=("private_key", "keys", "opt_in", "labels", "paths"),
    text: str = "text",
    per_row: dict[str, str] | None = None,
    name: str = "redacted",
    is_normal: bool = False,
) -> str:
    """CTE list ending in `<name>`(all source columns, t, r)."""
    per_row = per_row or {}
    first = text if is_normal else normalized(text)
    ctes = [f"{name}_0 as (select *, {first} as t, cast([] as struct(original varchar, tag varchar)[]) as r from {source})"]

    def add(t, r, gate=None):
        n = len(ctes)
        if gate:
            t, r = f"case when {gate} then {t} else t end", f"case when {gate} then {r} else [] end"
        ctes.append(f"{name}_{n} as (select * exclude (t, r), {t} as t, list_concat(r, {r}) as r from {name}_{n - 1})")

    for rule in R.PATTERN_RULES:
        stage = "opt_in" if rule.option else "private_key" if rule.tag == "PRIVATE_KEY" else "keys"
        on = rule.option is None or rule.option in options or rule.option in per_row
        if stage in stages and on:
            tag = f"[REDACTED:{rule.tag}]"
            add(
                f"regexp_replace(t, {q(rule.pattern)}, {q(tag)}, 'g')",
                _records(f"regexp_extract_all(t, {q(rule.pattern)})", tag),
                per_row.get(rule.option),
            )
    for rule in R.LABEL_RULES if "labels" in stages else ():
        if rule.option is None or rule.option in options or rule.option in per_row:
            tag, n, stop = f"[REDACTED:{rule.tag}]", len(ctes), rf"\s{OPEN}{CLOSE}"
            gate = per_row.get(rule.option)
            marked = f"regexp_replace(t, {q(f'(?i)({rule.pattern})' + chr(40) + chr(92) + 'S+)')}, {q(chr(92) + '1' + OPEN + chr(92) + '2' + CLOSE)}, 'g')"
            kept = f"regexp_replace({marked}, {q(f'{OPEN}([^{stop}]*{R.PLACEHOLDER}[^{stop}]*){CLOSE}')}, {q(chr(92) + '1')}, 'g')"
            ctes.append(f"{name}_{n} as (select *, {f'case when {gate} then {kept} else t end' if gate else kept} as m from {name}_{n - 1})")
            ctes.append(
                f"{name}_{n + 1} as (select * exclude (t, r, m), regexp_replace(m, {q(f'{OPEN}[^{CLOSE}]*{CLOSE}')}, {q(tag)}, 'g') as t,"
                f" list_concat(r, {_records(f'regexp_extract_all(m, {q(f"{OPEN}([^{CLOSE}]*){CLOSE}")}, 1)', tag)}) as r from {name}_{n})"
            )
    if "paths" in stages:
        n, tag = len(ctes), "[REDACTED:PATH]"
        ctes.append(
            f"{name}_{n} as (select *, regexp_extract_all(t, {q(R.PATH_TOKEN)}) as toks,"
            f" regexp_split_to_array(t, {q(R.PATH_TOKEN)}) as gaps from {name}_{n - 1})"
        )
        words = f"list_transform(toks, lambda p: case when {sensitive('p', rules)} then {q(tag)} else p end)"
        ctes.append(
            f"{name}_{n + 1} as (select * exclude (t, r, toks, gaps), case when len(toks) = 0 then t else"
            f" array_to_string(list_transform(list_zip(gaps, {words}), lambda z: z[1] || coalesce(z[2], '')), '') end as t,"
            f" list_concat(r, {_records(f'list_filter(toks, lambda p: {sensitive("p", rules)})', tag)}) as r from {name}_{n})"
        )
    ctes.append(f"{name} as (select * from {name}_{len(ctes) - 1})")
    return ",\n".join(ctes)


def shown(r: str = "r") -> str:
    return f"array_to_string(list_transform({r}, lambda x: x.original || '=' || x.tag), '|')"


def keyword_test(text: str, kw: str) -> str:
    left = "" if kw.startswith(".") else "(?:^|[^a-z0-9])"
    return f"regexp_matches(lower({text}), {q(left + __import__('re').escape(kw.lower()) + '(?:[^a-z0-9]|$)')})"


def ordered(cases: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when {t} then {v}" for t, v in cases) + " end"


def keyword_reason(text: str, rules: R.Rules, prefix: str = "") -> str:
    return ordered(
        [(keyword_test(text, k), q(f"{prefix}S{n} keyword detected: {k}")) for n, ks in ((3, rules.keywords_s3), (2, rules.keywords_s2)) for k in ks]
    )


def pattern_reason(text: str, rules: R.Rules, prefix: str = "") -> str:
    return ordered(
        [
            (f"regexp_matches({text}, {q('(?i)' + p)})", q(f"{prefix}S{n} pattern matched: {p}"))
            for n, ps in ((3, rules.patterns_s3), (2, rules.patterns_s2))
            for p in ps
        ]
    )


def tool_reason(name: str, rules: R.Rules) -> str:
    import re

    def test(t):
        return f"regexp_matches(lower(trim({name})), {q('(?:^|[._-])' + re.escape(t.lower()) + '(?:$|[._-])')})"

    return ordered(
        [(test(t), f"{q(f'S{n} tool detected: ')} || {name}") for n, ts in ((3, rules.tools_s3), (2, rules.tools_s2)) for t in ts]
    )


def path_reason(paths: str, rules: R.Rules) -> str:
    def first(test):
        return f"list_filter({paths}, lambda p: {test})[1]"

    marks = contains_one("p", R.FILE_WORDS) + " or " + " or ".join(f"suffix(lower(p), {q(s)})" for s in R.FILE_SUFFIXES)
    return (
        f"coalesce('S3 path detected: ' || {first(contains_one('p', rules.paths_s3))},"
        f" 'S2 path detected: ' || {first(contains_one('p', rules.paths_s2))},"
        f" 'Sensitive file extension detected: ' || {first(marks)})"
    )


def level_from(*reasons: str) -> str:
    s3 = " or ".join(f"coalesce(regexp_matches({r}, '^(Result: )?(S3|Sensitive)'), false)" for r in reasons)
    s2 = " or ".join(f"{r} is not null" for r in reasons)
    return f"case when {s3} then 'S3' when {s2} then 'S2' else 'S1' end"


def action_from(level: str, s2: str = "redact", s3: str = "block") -> str:
    return f"case {level} when 'S3' then {q(s3)} when 'S2' then {q(s2)} else 'allow' end"
