"""Redaction as Column expressions: text -> struct<text, replacements array<struct<original, tag>>>.

Each rule is one step over a (text, replacements) pair, and `aggregate` folds the steps in rule order.
A step may look at the text several times without evaluating the steps before it again, and the
whole chain can be used on a column, inside `transform` over an array, in batch or in a stream,
without a shuffle.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietlog.functions import rules as R
from quietlog.functions.paths import maybe_sensitive_sql, sensitive_path_sql
from quietlog.functions.sqltext import any_literal, apply, q
from quietlog.functions.text import SPACE_CHARS, contains_any, let, normalize

OPEN, CLOSE = "\ue000", "\ue001"
STATE = "struct<text:string,replacements:array<struct<original:string,tag:string>>>"


def tag_of(rule) -> str:
    return f"[REDACTED:{rule.tag}]"


# The steps below are SQL text over `s` (text, replacements) and `x` (the input: text, low, switches).


def _records(originals: str, tag: str) -> str:
    """Replacement records; white-space-only values are replaced but not recorded."""
    kept = f"filter({originals}, o -> btrim(o, {q(SPACE_CHARS)}) <> '')"
    return f"transform({kept}, o -> named_struct('original', o, 'tag', {q(tag)}))"


def _state(text: str, hits: str) -> str:
    return f"named_struct('text', {text}, 'replacements', concat(s.replacements, {hits}))"


def _pattern_step(rule: R.PatternRule) -> str:
    java = q(R.pattern_java(rule))
    cheap = any_literal("s.text", rule.anchors) if rule.anchors else f"rlike(s.text, {q(R.java_regex(rule.probe))})"
    hit = _state(
        f"regexp_replace(s.text, {java}, {q(tag_of(rule))})",
        _records(f"regexp_extract_all(s.text, {java}, 0)", tag_of(rule)),
    )
    return f"CASE WHEN {cheap} AND rlike(s.text, {java}) THEN {hit} ELSE s END"


def _label_step(rule: R.LabelRule) -> str:
    """Mark the word after each label, unmark words that hold a placeholder, then replace what is left."""
    java = R.java_regex(rule.pattern, "(?i)", word_edges=True)
    word = R.java_regex(r"(\S+)")
    stop = rf"\t\n\f\r {OPEN}{CLOSE}"
    marked = f"regexp_replace(s.text, {q(f'({java}){word}')}, {q(f'$1{OPEN}$2{CLOSE}')})"
    kept = f"regexp_replace({marked}, {q(f'{OPEN}([^{stop}]*{R.PLACEHOLDER}[^{stop}]*){CLOSE}')}, '$1')"
    hit = _state(
        f"regexp_replace(m, {q(f'{OPEN}[^{CLOSE}]*{CLOSE}')}, {q(tag_of(rule))})",
        _records(f"regexp_extract_all(m, {q(f'{OPEN}([^{CLOSE}]*){CLOSE}')}, 1)", tag_of(rule)),
    )
    found = f"{any_literal('x.low', rule.anchors)} AND rlike(s.text, {q(java)})"
    return f"CASE WHEN {found} THEN transform(array({kept}), m -> {hit})[0] ELSE s END"


def _path_step(rules: R.Rules) -> str:
    java, tag = q(R.java_regex(R.PATH_TOKEN)), "[REDACTED:PATH]"
    words = f"transform(tokens, p -> IF({sensitive_path_sql('p', rules)}, {q(tag)}, p))"
    gaps = f"split(s.text, {java}, -1)"
    joined = f"array_join(zip_with({gaps}, {words}, (g, w) -> concat(g, coalesce(w, ''))), '')"
    hit = _state(joined, _records(f"filter(tokens, p -> {sensitive_path_sql('p', rules)})", tag))
    bound = f"transform(array(regexp_extract_all(s.text, {java}, 0)), tokens -> {hit})[0]"
    return f"CASE WHEN {maybe_sensitive_sql('x.low', rules)} THEN {bound} ELSE s END"


STAGES = ("private_key", "keys", "opt_in", "labels", "paths")


@lru_cache(maxsize=64)
def _chain(options: frozenset[str], per_row: frozenset[str], rules: R.Rules, stages: tuple[str, ...]) -> str:
    """Lambda text: input struct -> (text, replacements)."""

    def gated(rule, step):
        return f"CASE WHEN x.{rule.option} THEN {step} ELSE s END" if rule.option in per_row else step

    def enabled(rule):
        return rule.option is None or rule.option in options or rule.option in per_row

    def stage(rule):
        return "opt_in" if rule.option else "private_key" if rule.tag == "PRIVATE_KEY" else "keys"

    steps = [gated(r, _pattern_step(r)) for r in R.PATTERN_RULES if enabled(r) and stage(r) in stages]
    steps += [gated(r, _label_step(r)) for r in R.LABEL_RULES if enabled(r) and "labels" in stages]
    steps += [_path_step(rules)] if "paths" in stages else []
    cases = " ".join(f"WHEN {i} THEN {step}" for i, step in enumerate(steps))
    order = ", ".join(map(str, range(len(steps))))
    return (
        f"x -> aggregate(array({order}), cast(named_struct('text', x.text, 'replacements', array()) as {STATE}),"
        f" (s, n) -> CASE n {cases} ELSE s END)"
    )


def redact_normalized(
    text: Column,
    options=R.DEFAULT_ON,
    rules: R.Rules = R.Rules(),
    option_columns: dict[str, Column] | None = None,
    stages: tuple[str, ...] = STAGES,
) -> Column:
    """Redact text that is already normalised.

    `options`: names switched on for all rows; `option_columns`: boolean columns deciding per row;
    `stages`: which groups of rules to run.
    The size limit is one of raw text, so it is the caller's to apply (`redact`, `payload.redact_nodes`).
    """
    per_row = option_columns or {}
    chain = _chain(frozenset(options).difference(per_row), frozenset(per_row), rules, tuple(stages))
    # private-use marks may not come in from outside
    clean = F.when(contains_any(text, (OPEN, CLOSE)), F.translate(text, OPEN + CLOSE, "")).otherwise(text)

    def run(t):
        # rules write only tags, and no tag is followed by a separator, so label guards can use the first text
        switches = [c.alias(name) for name, c in per_row.items()]
        return apply(F.struct(t.alias("text"), F.lower(t).alias("low"), *switches), chain)

    return let(clean, run)


def redact(text: Column, options=R.DEFAULT_ON, rules: R.Rules = R.Rules(), option_columns=None, stages=STAGES) -> Column:
    """Normalise and redact.  Raw text above the size limit gives null (`sources.request_log.split_by_size`)."""
    small = F.when(F.octet_length(text) <= R.MAX_TEXT_BYTES, text)
    return redact_normalized(normalize(small), options, rules, option_columns, stages)


def mapping_of(replacements: Column) -> Column:
    """original -> tag, the last replacement of an original wins."""
    ranked = F.array_sort(
        F.transform(replacements, lambda r, i: F.struct(r.original.alias("o"), i.alias("i"), r.tag.alias("t")))
    )
    last = let(
        ranked,
        lambda a: F.filter(a, lambda x, i: F.coalesce(F.get(a, i + 1).o != x.o, F.lit(True))),
    )
    return let(
        last,
        lambda a: F.map_from_arrays(F.transform(a, lambda x: x.o), F.transform(a, lambda x: x.t)),
    )
