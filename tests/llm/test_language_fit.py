"""The pipeline's language stage turns away what no learned language explains."""

import random

import corpus_pipeline
from quietlog.llm.common import table

SF = "/root/testdata/sf0.001"
FOREIGN = {
    "ru": "Это просто русский текст, который никто не учил раньше. ",
    "it": "La casa è molto bella e gli amici della famiglia vengono spesso a trovarci quando il tempo è buono. ",
    "nl": "Het huis van mijn ouders staat aan de rand van het dorp en de tuin is erg groot. ",
    "pl": "Dom moich rodziców stoi na skraju wsi, a ogród jest bardzo duży i piękny. ",
    "ja": "日本語の文章はここにあります。",
}


def gibberish(letters, words, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(words))


def identified(spark, planted):
    docs = table(spark, SF, "documents")
    more = spark.createDataFrame(planted, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'planted' as source", "cast(length(text) as long) as n_chars")
    return {r.doc_id for r in corpus_pipeline.identify(spark, docs.unionByName(more), SF).collect()}, {r.doc_id for r in docs.collect()}


def test_gibberish_and_unlearned_languages_go(spark):
    texts = [t * 5 for t in FOREIGN.values()] + [gibberish(a, n, n) for a in ("abcdefghijklmnopqrstuvwxyz", "etaoinshrdlu") for n in (30, 100, 3000)] + ["x" * 3000]
    kept, clean = identified(spark, [(10_000 + i, t, None) for i, t in enumerate(texts)])
    assert kept == clean


def test_gibberish_with_a_language_does_not_make_way_for_more(spark):
    """Mislabelled training rows widen what is accepted only up to a limit."""
    kept, clean = identified(spark, [(10_000 + i, gibberish("abcdefghijklmnopqrstuvwxyz", 100, i), "en") for i in range(6)])
    assert kept == clean
