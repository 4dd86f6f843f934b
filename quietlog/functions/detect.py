"""Sensitivity grading as Column expressions.

Every detector yields struct<rank int, reason string> (rank 1 = nothing found).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietlog.functions import rules as R
from quietlog.functions.paths import file_marker_sql, looks_like_path_sql, path_rule_sql
from quietlog.functions.sqltext import any_literal, apply, q, where
from quietlog.functions.text import contains_any, is_blank, let, trim_space

FOUND = "struct<rank:int,reason:string>"


def found(rank: int, reason: Column | None) -> Column:
    text = F.lit(None).cast("string") if reason is None else reason
    return F.struct(F.lit(rank).alias("rank"), text.alias("reason"))


# Detectors are SQL lambdas: some dozens of tests each, built as one text.


def _found_sql(rank: int, reason: str) -> str:
    return f"named_struct('rank', {rank}, 'reason', {reason})"


def _first_of(cases: list[tuple[str, str]]) -> str:
    """Value of the first case that holds, else 'nothing found'."""
    nothing = f"cast({_found_sql(1, 'cast(null as string)')} as {FOUND})"
    tests = "".join(f" WHEN {test} THEN {value}" for test, value in cases)
    return f"CASE{tests} ELSE {nothing} END" if cases else nothing


def _keyword_sql(low: str, keyword: str) -> str:
    """Keyword between ASCII non-alphanumerics, on lower-cased text; a leading dot frees the left side."""
    kw = keyword.lower()
    left = "" if keyword.startswith(".") else "(?<![A-Za-z0-9])"
    return f"(contains({low}, {q(kw)}) AND rlike({low}, {q(left + R.re.escape(kw) + '(?![A-Za-z0-9])')}))"


def keyword_matches(low: Column, keyword: str) -> Column:
    return apply(low, f"t -> {_keyword_sql('t', keyword)}")


def detect_keywords(text: Column, rules: R.Rules, prefix: str = "") -> Column:
    cases = [
        (_keyword_sql("t", kw), _found_sql(rank, q(f"{prefix}S{rank} keyword detected: {kw}")))
        for rank, words in ((3, rules.keywords_s3), (2, rules.keywords_s2))
        for kw in words
    ]
    return apply(F.lower(text), f"t -> {_first_of(cases)}")


def detect_patterns(text: Column, rules: R.Rules, prefix: str = "") -> Column:
    def test(pattern):
        regex = f"rlike(t.raw, {q(R.java_regex(pattern, '(?iu)'))})"
        anchors = R.PATTERN_ANCHORS.get(pattern)
        return f"({any_literal('t.low', anchors)} AND {regex})" if anchors else regex

    cases = [
        (test(p), _found_sql(rank, q(f"{prefix}S{rank} pattern matched: {p}")))
        for rank, patterns in ((3, rules.patterns_s3), (2, rules.patterns_s2))
        for p in patterns
        if R.pattern_compiles(p)  # others are ignored
    ]
    # the few letters that only Unicode folding maps to ASCII are folded for the anchors, too
    folded = F.translate(F.lower(text), "\u017f\u212a", "sk")
    low = F.when(contains_any(text, ("\u017f", "\u212a")), folded).otherwise(F.lower(text))
    return apply(F.struct(text.alias("raw"), low.alias("low")), f"t -> {_first_of(cases)}")


def detect_tool(tool_name: Column, rules: R.Rules) -> Column:
    """A tool hits as a whole segment of the name, segments being cut at . _ and -."""

    def test(tool):
        seg = tool.strip().lower()
        return f"(t.name = {q(seg)} OR rlike(t.name, {q('(?:^|[._-])' + R.re.escape(seg) + '(?:$|[._-])')}))"

    cases = [
        (test(tool), _found_sql(rank, f"concat('S{rank} tool detected: ', t.raw)"))
        for rank, tools in ((3, rules.tools_s3), (2, rules.tools_s2))
        for tool in tools
    ]
    return apply(F.struct(F.lower(trim_space(tool_name)).alias("name"), tool_name.alias("raw")), f"t -> {_first_of(cases)}")


def detect_paths(paths: Column, rules: R.Rules) -> Column:
    """Three passes over an array of paths: S3 rule, S2 rule, sensitive file name (S3)."""
    passes = (
        (3, "S3 path detected: ", path_rule_sql("p", rules.paths_s3)),
        (2, "S2 path detected: ", path_rule_sql("p", rules.paths_s2)),
        (3, "Sensitive file extension detected: ", file_marker_sql("p")),
    )
    cases = [
        (f"exists(ps, p -> {test})", _found_sql(rank, f"concat({q(label)}, filter(ps, p -> {test})[0])"))
        for rank, label, test in passes
    ]
    return apply(paths, f"ps -> {_first_of(cases)}")


def json_strings(body: Column) -> Column:
    """All string values of a valid JSON text, at any depth, in text order (keys left out).

    String literals are taken off the text one after the other, so a quote seen between matches
    cannot open a string; the kept literals are then decoded together as one JSON array.
    """
    literal = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:[\t\n\r ]*+:)?'
    values = F.filter(F.regexp_extract_all(body, F.lit(literal), F.lit(0)), lambda s: ~s.endswith(":"))
    return F.from_json(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>")


def param_paths(body: Column) -> Column:
    """Every path-looking string anywhere in a JSON text."""
    any_path = contains_any(body, ("/", "\\"))
    return F.when(any_path, where(json_strings(body), f"p -> {looks_like_path_sql('p')}")).otherwise(F.array().cast("array<string>"))


def combine(results: Column) -> Column:
    """Detector results in order -> struct<rank, reason>: highest rank, all reasons joined."""
    hit = F.filter(results, lambda r: r.rank > 1)
    return let(
        hit,
        lambda h: F.struct(
            F.coalesce(F.array_max(F.transform(h, lambda r: r.rank)), F.lit(1)).alias("rank"),
            F.when(F.size(h) > 0, reason_concat(h)).alias("reason"),
        ),
    )


def reason_concat(results: Column) -> Column:
    """Non-empty reasons, in detector order, joined by '; '."""
    reasons = F.filter(F.transform(results, lambda r: r.reason), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.array_join(reasons, "; ")


def detector_results(
    rules: R.Rules,
    message: Column | None = None,
    tool_name: Column | None = None,
    paths: Column | None = None,
    tool_result: Column | None = None,
) -> Column:
    """array<struct<rank, reason>>, one entry per detector that applies.

    `paths`: array of path-looking parameter strings; `tool_result`: the result as JSON text, null if absent.
    """
    nothing = found(1, None)
    out = []
    if message is not None:
        blank = is_blank(message)
        out += [
            F.when(blank, nothing).otherwise(detect_keywords(message, rules)),
            F.when(blank, nothing).otherwise(detect_patterns(message, rules)),
        ]
    if tool_name is not None:
        out.append(F.when(is_blank(tool_name), nothing).otherwise(detect_tool(tool_name, rules)))
    if paths is not None:
        out.append(detect_paths(paths, rules))
    if tool_result is not None:
        absent = tool_result.isNull()
        out += [
            F.when(absent, nothing).otherwise(detect_keywords(tool_result, rules, "Result: ")),
            F.when(absent, nothing).otherwise(detect_patterns(tool_result, rules, "Result: ")),
        ]
    return F.array(*out)


def level_of(rank: Column) -> Column:
    return F.concat(F.lit("S"), rank.cast("string"))


def detect_sensitivity(policy: R.Policy, **inputs: Column) -> Column:
    """struct<level, reason, detector_type, confidence>; inputs as in `detector_results`."""

    def shape(level, reason):
        return F.struct(
            level.alias("level"),
            reason.alias("reason"),
            F.lit("ruleDetector").alias("detector_type"),
            F.lit(1.0).alias("confidence"),
        )

    if not policy.enabled:
        return shape(F.lit("S1"), F.lit("privacy detection disabled"))
    return let(combine(detector_results(policy.rules, **inputs)), lambda c: shape(level_of(c.rank), c.reason))


def action_of(level: Column, policy: R.Policy) -> Column:
    return (
        F.when(level == "S3", policy.action_for("S3"))
        .when(level == "S2", policy.action_for("S2"))
        .otherwise("allow")
    )


def evaluate_policy(policy: R.Policy, **inputs: Column) -> Column:
    """struct<level, action, reason>."""
    return let(
        detect_sensitivity(policy, **inputs),
        lambda d: F.struct(d.level.alias("level"), action_of(d.level, policy).alias("action"), d.reason.alias("reason")),
    )
