"""Path tests: does a string look like a path, and does it touch a sensitive one."""

from __future__ import annotations

from pyspark.sql import Column

from quietlog.functions import rules as R
from quietlog.functions.sqltext import any_literal, apply, q


def looks_like_path_sql(p: str) -> str:
    """A slash or backslash anywhere; the prefixes / ~/ ./ ../ all hold one."""
    return any_literal(p, ("/", "\\"))


def path_rule_sql(p: str, path_rules) -> str:
    """A rule hits as a lower-cased substring, or as a glob over the whole path."""
    tests = [any_literal(f"lower({p})", [r.lower() for r in path_rules])]
    tests += [f"rlike(lower({p}), {q(g)})" for g in (R.glob_regex(r.lower()) for r in path_rules) if g]
    return "(" + " OR ".join(tests) + ")"


def file_marker_sql(p: str) -> str:
    tests = [any_literal(f"lower({p})", R.FILE_WORDS)] + [f"endswith(lower({p}), {q(s)})" for s in R.FILE_SUFFIXES]
    return "(" + " OR ".join(tests) + ")"


def sensitive_path_sql(p: str, rules: R.Rules) -> str:
    return (
        f"({looks_like_path_sql(p)} AND ({path_rule_sql(p, rules.paths_s3 + rules.paths_s2)} OR {file_marker_sql(p)}))"
    )


def maybe_sensitive_sql(low: str, rules: R.Rules) -> str:
    """Cheap test on a whole lower-cased text: could any token in it be a sensitive path?"""
    paths = rules.paths_s3 + rules.paths_s2
    slashes = any_literal(low, ("/", "\\"))
    if any(R.glob_regex(p.lower()) for p in paths):
        return slashes
    words = [p.lower() for p in paths] + list(R.FILE_WORDS) + list(R.FILE_SUFFIXES)
    return f"({slashes} AND {any_literal(low, words)})"


def looks_like_path(c: Column) -> Column:
    return apply(c, f"p -> {looks_like_path_sql('p')}")


def sensitive_path(c: Column, rules: R.Rules = R.Rules()) -> Column:
    return apply(c, f"p -> {sensitive_path_sql('p', rules)}")
