"""Relevant context of a session by TF-IDF cosine, as joins on (session, token)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlog.functions.text import is_blank, let, normalize
from quietlog.operators.ranks import top_n
from quietlog.session import staged

TOKEN = r"[a-z0-9_]+|\p{IsHan}+|[\p{IsHiragana}\p{IsKatakana}]+|\p{IsHangul}+"
# Feature weights, and the range that counts as Han when choosing the split.
WEIGHTS = {"w:": 1.0, "b:": 1.0, "u:": 0.7, "g:": 0.4}
HAN = "[㐀-鿿]"
NGRAM, MAX_NGRAMS = 3, 8


def tokenize(text: Column, normalized: bool = False) -> Column:
    """Features of a text: words (w:) with leading character 3-grams (g:), Han characters (u:) and pairs (b:)."""
    low = F.lower(text if normalized else nfkc(text))

    def windows(s, prefix, size, count):
        return F.when(
            count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit(prefix), F.substring(s, i, size)))
        ).otherwise(F.array().cast("array<string>"))

    def word(w):
        grams = windows(w, "g:", NGRAM, F.least(F.length(w) - (NGRAM - 1), F.lit(MAX_NGRAMS)))
        return F.concat(F.array(F.concat(F.lit("w:"), w)), grams)

    def features(seg):
        n = F.length(seg)
        han = F.concat(windows(seg, "u:", 1, n), windows(seg, "b:", 2, n - 1))
        # kana segments may hold marks that are neither letter nor number
        letters = F.regexp_replace(seg, r"[^\p{L}\p{N}_-]", "")
        other = let(letters, lambda w: F.when(w != "", word(w)).otherwise(F.array().cast("array<string>")))
        return F.when(seg < "\u0080", word(seg)).when(seg.rlike(HAN), han).otherwise(other)

    return F.flatten(F.transform(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)), features))


def nfkc(text: Column) -> Column:
    from quietlog.functions.text import STABLE, nfkc_batch

    odd = (F.octet_length(text) != F.char_length(text)) & ~text.rlike(STABLE)
    return F.coalesce(nfkc_batch(F.when(odd, text)), text)


def weight_of(token: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for prefix, weight in WEIGHTS.items():
        out = out.when(token.startswith(prefix), F.lit(weight))
    return out.otherwise(0.5)


def postings(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys + token, weight: summed feature weights.  A text's tokens meet in its own task, before any shuffle."""
    tokens = docs.select(*keys, F.explode(tokenize(F.col(text))).alias("token"))
    return tokens.groupBy(*keys, "token").agg(F.count("*").alias("n")).select(
        *keys, "token", (weight_of(F.col("token")) * F.col("n")).alias("weight")
    )


def doc_frequency(posts: DataFrame, session: str) -> DataFrame:
    """Texts per (session, token); postings are distinct per text already."""
    return posts.groupBy(session, "token").agg(F.count("*").alias("df"))


def tfidf(posts: DataFrame, df: DataFrame, sizes: DataFrame, totals: DataFrame, keys: list[str], session: str) -> DataFrame:
    """keys + token, x: weight share times smoothed idf.  Tokens never seen in a text have df 0."""
    idf = F.log((1 + F.col("n_docs")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    return (
        posts.join(df, [session, "token"], "left")
        .join(sizes, session)
        .join(totals, keys)
        .select(*keys, "token", (F.col("weight") / F.col("total") * idf).alias("x"))
    )


def scores(messages: DataFrame, queries: DataFrame, session: str = "session_id", index: str = "index", text: str = "text") -> DataFrame:
    """Cosine of every non-blank message with its session's query; messages sharing no token score 0.

    Indexes are positions, 0 and up; queries ride along with index -1.
    """
    docs = messages.filter(~is_blank(F.col(text))).select(session, index, text)
    asked = queries.filter(~is_blank(F.col("query"))).select(session, F.lit(-1).cast("long").alias(index), F.col("query").alias(text))
    wanted = docs.join(asked.select(session), session, "left_semi")
    is_query = F.col(index) < 0

    # texts and queries are taken apart in one pass and kept, as both the table below and the scores read them
    posts = staged(postings(wanted.unionByName(asked), [session, index], text), "postings")
    sizes = wanted.groupBy(session).agg(F.count("*").alias("n_docs"))
    # weight shares have one divisor per text, which cancels in the cosine
    idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
    table = (
        posts.groupBy(session, "token")
        .agg(F.count_if(~is_query).alias("df"), F.max(F.when(is_query, F.col("weight"))).alias("qw"))
        .join(sizes, session)
        .select(session, "token", idf.alias("idf"), (F.col("qw") * idf).alias("qx"))
    )
    q_norm = table.groupBy(session).agg(F.sqrt(F.sum(F.col("qx") * F.col("qx"))).alias("q_norm"))
    x = F.col("weight") * F.col("idf")
    per_doc = (
        posts.filter(~is_query)
        .join(table, [session, "token"])
        .groupBy(session, index)
        .agg(F.sqrt(F.sum(x * x)).alias("norm"), F.coalesce(F.sum(x * F.col("qx")), F.lit(0.0)).alias("dot"))
    )
    score = F.coalesce(F.col("dot") / (F.nullif("norm", F.lit(0.0)) * F.col("q_norm")), F.lit(0.0))
    return (
        wanted.join(q_norm.filter(F.col("q_norm") > 0), session)
        .join(per_doc, [session, index], "left")
        .select(session, index, text, score.alias("score"))
    )


def score_queries(messages: DataFrame, queries: DataFrame, query_id: str, session: str = "session_id", index: str = "index", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scores above 0 of the messages of a session for each of its queries, and the queries that have a score at all.

    Messages are taken apart once into postings, whatever the number of queries; queries are a second set of postings, which
    meets the first on (session, token).  So only pairs that share a token are ever made, from weights and not from texts.
    """
    docs = messages.filter(~is_blank(F.col(text))).select(session, index, text)
    asked = queries.filter(~is_blank(F.col("query"))).select(session, query_id, F.col("query").alias(text))
    wanted = docs.join(asked.select(session), session, "left_semi")
    posts = staged(postings(wanted, [session, index], text), "postings")
    sizes = wanted.groupBy(session).agg(F.count("*").alias("n_docs"))
    weighed = F.log((1 + F.col("n_docs")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    idf = doc_frequency(posts, session).join(sizes, session).select(session, "token", weighed.alias("idf"))
    indexed = staged(posts.join(idf, [session, "token"]).select(session, "token", index, (F.col("weight") * F.col("idf")).alias("x")), "index")
    norms = indexed.groupBy(session, index).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    df = doc_frequency(posts, session)
    asking = staged(
        postings(asked, [session, query_id], text).join(df, [session, "token"], "left").join(sizes, session)
        .select(session, query_id, "token", (F.col("weight") * weighed).alias("qx")),
        "asked",
    )
    q_norms = asking.groupBy(session, query_id).agg(F.sqrt(F.sum(F.col("qx") * F.col("qx"))).alias("q_norm"))
    dots = indexed.join(asking, [session, "token"]).groupBy(session, query_id, index).agg(F.sum(F.col("x") * F.col("qx")).alias("dot"))
    scored = dots.join(norms, [session, index]).join(q_norms, [session, query_id])
    return scored.select(session, query_id, index, (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("score")), q_norms.select(session, query_id)


def _select_for_queries(messages: DataFrame, queries: DataFrame, k: int, min_score: float, session: str, index: str, text: str, query_id: str) -> DataFrame:
    scored, known = score_queries(messages, queries, query_id, session, index, text)
    # a query with fewer than k messages above 0 goes on with the first ones that it shares nothing with: they are among the first 2k
    first = top_n(messages.filter(~is_blank(F.col(text))).select(session, index), [session], [F.asc(index)], 2 * k)
    rest = known.join(first, session).join(scored.select(session, query_id, index), [session, query_id, index], "left_anti").withColumn("score", F.lit(0.0))
    both = scored.unionByName(rest).filter(F.col("score") >= min_score).withColumn("_s", F.round("score", 12))
    ranked = top_n(both, [session, query_id], [F.desc("_s"), F.asc(index)], k, "rank")
    return ranked.join(messages.select(session, index, text), [session, index]).select(session, query_id, "rank", index, text, "score")


def select_context(
    messages: DataFrame,
    queries: DataFrame,
    top_k: int = 5,
    min_score: float = 0.0,
    session: str = "session_id",
    index: str = "index",
    text: str = "text",
    query_id: str | None = None,
) -> DataFrame:
    """Best `top_k` messages per session, ties by index; `index` is the position in the track, blanks included.

    `query_id`: the column of `queries` that tells a session's queries apart; without it a session has one query.
    """
    k = top_k if top_k > 0 else 5
    if query_id is not None:
        return _select_for_queries(messages, queries, k, min_score, session, index, text, query_id)
    scored = scores(messages, queries, session, index, text).filter(F.col("score") >= min_score)
    # equal scores must tie exactly, whatever the order of summation was
    ranked = top_n(
        scored.select(session, index, "score", F.round("score", 12).alias("_s")),
        [session],
        [F.desc("_s"), F.asc(index)],
        k,
        "rank",
    )
    # texts join only for the winners
    return ranked.join(messages.select(session, index, text), [session, index]).select(session, "rank", index, text, "score")
