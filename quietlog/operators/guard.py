"""Whole-payload guard: grade every text node, fold, then block, redact or allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlog.functions import detect as D
from quietlog.functions import payload as P
from quietlog.functions import rules as R
from quietlog.functions.text import is_blank, let, pin, trim_space

DEFAULT_REASON = "redaction rule matched"


def guard(df: DataFrame, policy: R.Policy = R.Policy(), body: str = "body") -> DataFrame:
    """Add `decision` (level, action, reason), `status_code`, `entries` and `body_out`.

    `entries`: array<struct<role, full_text, clean_text, decision>>, one per text node, for the audit
    tracks.  `body_out` is null when the payload is held back (403).  A node above the redaction size
    limit, or a body above the body limit, fails the payload with 413.  An object that is nested too deep
    to be read is held back unread.  Everything happens inside the row.
    """
    if not policy.enabled:
        allow = F.struct(F.lit("S1").alias("level"), F.lit("allow").alias("action"), F.lit(None).cast("string").alias("reason"))
        return df.select(
            "*", allow.alias("decision"), F.lit(200).alias("status_code"), F.expr(NO_ENTRIES).alias("entries"), F.col(body).alias("body_out")
        )

    graded = P.with_text_nodes(df, body).withColumn("nodes", F.coalesce("nodes", F.expr(NO_NODES)))
    graded = graded.withColumn(
        "_policy",
        pin(P.policy_rollup(P.node_decisions(F.col("nodes"), D.param_paths(F.col("read_body")), policy), policy)),
    )
    too_large = F.col("unread").eqNullSafe("size")
    level_action = F.when(F.col("unread").isNotNull(), "block").otherwise(F.col("_policy.action"))
    held = level_action.isin("review", "block")
    graded = graded.withColumn(
        "_redacted", P.redact_nodes(F.when(~held, F.col("nodes")), policy, level_action == "redact")
    )
    hold_text = F.when(level_action == "review", policy.placeholder_review).otherwise(policy.placeholder_s3)

    def entry(n, r):
        replaced = (level_action == "redact") | (r.hits > 0)
        return F.struct(
            n.role.alias("role"),
            n.addr.alias("addr"),
            n.text.alias("full_text"),
            # no redacted text: the node is above the limit, and has no clean text either
            F.when(held, hold_text).when(replaced, r.text).when(r.text.isNotNull(), n.text).alias("clean_text"),
            F.when(held, level_action).when(replaced, "redact").otherwise("allow").alias("decision"),
        )

    redacted = F.coalesce("_redacted", F.expr("cast(array() as array<struct<text:string,hits:int>>)"))
    graded = graded.withColumn("entries", pin(F.zip_with("nodes", redacted, entry)))
    too_long = F.exists("entries", lambda e: e.clean_text.isNull())
    any_redacted = F.exists("entries", lambda e: e.decision == "redact")
    changes = F.transform(
        F.filter("entries", lambda e: e.decision == "redact"),
        lambda e: F.struct(e.addr.alias("addr"), e.clean_text.alias("text")),
    )
    decision = F.struct(
        F.when(F.col("unread").isNotNull(), "S3").otherwise(F.col("_policy.level")).alias("level"),
        F.when((level_action == "allow") & any_redacted, "redact").otherwise(level_action).alias("action"),
        F.when((level_action == "allow") & any_redacted, F.coalesce("_policy.reason", F.lit(DEFAULT_REASON)))
        .otherwise(F.coalesce(F.concat(F.lit("payload not readable: "), F.col("unread")), F.col("_policy.reason")))
        .alias("reason"),
    )
    pass_on = ~held & ~too_long
    # held and oversize payloads have nothing to rewrite
    rewritten = P.write_back(F.col(body), F.when(pass_on, changes).otherwise(F.expr(NO_CHANGES)))
    return graded.select(
        *[F.col(c) for c in df.columns],
        decision.alias("decision"),
        F.when(too_large, 413).when(held, 403).when(too_long, 413).otherwise(200).alias("status_code"),
        "entries",
        F.when(pass_on, rewritten).alias("body_out"),
    )


NO_NODES = "cast(array() as array<struct<role:string,text:string,detect_text:string,context_prefix:string,clean:string,addr:string>>)"
NO_ENTRIES = "cast(array() as array<struct<role:string,addr:string,full_text:string,clean_text:string,decision:string>>)"
NO_CHANGES = "cast(array() as array<struct<addr:string,text:string>>)"


#: bits of `seq` for the place of an entry in its payload: a text takes three bytes of a body at least, and a comma
PLACE_BITS = 22


def audit_entries(
    guarded: DataFrame, session: Column, key: str, order: Column | None = None, path: Column | None = None, method: Column | None = None
) -> DataFrame:
    """Audit rows of guarded payloads, ready for `sources.tracks.append_tracks`.

    `order`: a payload's place in its session (0 and up, below 2^41); with it, `seq` is the order of the whole
    session, without it, of the entries of a payload.  `path` and `method` of the request go into the metadata.
    Entries of a payload that failed for size have no clean text and are not kept.
    """
    given = [F.map_from_entries(F.array(F.struct(F.lit(n), F.coalesce(c, F.lit(""))))) for n, c in (("path", path), ("method", method)) if c is not None]
    place = F.col("place") if order is None else F.shiftleft(F.col("order"), PLACE_BITS) + F.col("place")
    rows = guarded.select(
        F.col(key),
        session.alias("session_id"),
        "decision",
        (F.lit(0) if order is None else order).cast("long").alias("order"),
        (F.map_concat(*given) if given else F.expr("cast(map() as map<string,string>)")).alias("request"),
        F.posexplode("entries").alias("place", "e"),
    ).filter(F.col("e.clean_text").isNotNull())
    held = F.col("decision.action").isin("review", "block")
    meta = F.create_map(F.lit("decision"), F.col("e.decision"), F.lit("level"), F.col("decision.level"))
    reason = F.create_map(F.lit("reason"), F.coalesce("decision.reason", F.lit("")))
    return rows.select(
        key,
        "session_id",
        place.cast("long").alias("seq"),
        F.col("e.role").alias("role"),
        F.col("e.full_text").alias("full_text"),
        F.col("e.clean_text").alias("clean_text"),
        F.map_concat("request", F.when(held, F.map_concat(meta, reason)).otherwise(meta)).alias("metadata"),
    )


def rollup_nodes(nodes: DataFrame, key: str, policy: R.Policy = R.Policy()) -> DataFrame:
    """The payload fold for a table with one row per node (`rank`, `reason`, `node_idx`).

    A plain aggregate: partial results are merged before the shuffle, whatever the size of a group.
    """
    best = F.max_by(F.struct("rank", "reason"), F.struct("rank", (-F.col("node_idx")).alias("first")))
    return (
        nodes.groupBy(key)
        .agg(best.alias("b"))
        .select(
            key,
            D.level_of(F.col("b.rank")).alias("level"),
            D.action_of(D.level_of(F.col("b.rank")), policy).alias("action"),
            F.when(F.col("b.rank") > 1, F.col("b.reason")).alias("reason"),
        )
    )


def session_of(headers: Column, payload: Column, fallback: Column, session_header: str = "X-Session-Id") -> Column:
    """Session id: four headers in turn, in any case, then three body keys, then `fallback`; made safe for file names."""
    # fixed values: header names, in the order in which they are tried
    names = (session_header, "X-Claude-Code-Session-Id", "X-Session-Id", "x-client-request-id")

    def filled(c):
        return F.when(~is_blank(c), c)

    def header(name):
        return F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name)), F.lit(0))

    given = [let(header(n), lambda h: filled(trim_space(h))) for n in dict.fromkeys(n.lower() for n in names)]
    given += [let(P.vstring(payload, f"$.{k}"), filled) for k in P.SESSION_KEYS]
    return safe_session_id(F.coalesce(*given, fallback))


def safe_session_id(c: Column) -> Column:
    """Blank becomes 'default'; characters other than ASCII letters, digits, _ and - become _; 128 at most."""
    return F.when(is_blank(c), "default").otherwise(F.substring(F.regexp_replace(c, "[^A-Za-z0-9_-]", "_"), 1, 128))


def decision_counts(entries: DataFrame) -> DataFrame:
    """Audit rows by decision, level, role and session."""
    return entries.groupBy(
        F.col("metadata")["decision"].alias("decision"), F.col("metadata")["level"].alias("level"), "role", "session_id"
    ).agg(F.count("*").alias("n"))
