"""Topic discovery with latent Dirichlet allocation."""

from __future__ import annotations

import math

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.operators.terms import doc_frequency, filter_extremes, n_rows
from vocalis.session import materialize

# Rounds of the fit that stand for one pass of an online fit.
ROUNDS = 10


def term_vectors(
    df: DataFrame, id_col: str, tokens: str = "tokens", no_below: int = 15, no_above: float = 1.0,
    keep_n: int = 10_000, tfidf: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Sparse count vectors over a filtered dictionary and its terms in order; with ``tfidf`` the
    counts times ``log2(N / df)``, scaled to unit length.

    The dictionary has at most ``keep_n`` terms, so it fits the driver."""
    kept = filter_extremes(doc_frequency(df, tokens), n_rows(df), no_below, no_above, keep_n)
    found = kept.select("term", "df").collect()
    words = [r["term"] for r in found]
    counter = CountVectorizerModel.from_vocabulary(words, inputCol=tokens, outputCol="features")
    counts = materialize(counter.transform(df.select(id_col, tokens)).select(id_col, "features"))
    if not tfidf:
        return counts, words
    total = counts.count()
    weights = Vectors.dense([math.log2(total / r["df"]) for r in found])
    weighted = ElementwiseProduct(scalingVec=weights, inputCol="features", outputCol="_weighted").transform(counts)
    unit = Normalizer(inputCol="_weighted", outputCol="_unit", p=2.0).transform(weighted)
    return unit.select(id_col, F.col("_unit").alias("features")), words


def fit_lda(vectors: DataFrame, k: int = 10, passes: int = 2, seed: int = 1234):
    """LDA by expectation-maximisation: every round reads every document, so none is left out.

    (The online optimizer draws its batches with replacement and so misses documents.)"""
    return LDA(k=k, optimizer="em", maxIter=passes * ROUNDS, seed=seed).fit(vectors).toLocal()


def describe_topics(model, words: list[str], top: int = 10) -> DataFrame:
    """``topic, rank, term, weight`` of the strongest words of every topic."""
    topics = model.describeTopics(top)
    names = topics.sparkSession.createDataFrame(list(enumerate(words)), "term_index int, term string")
    pairs = topics.select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "_t")
    )
    return (
        pairs.select("topic", "rank", F.col("_t.termIndices").alias("term_index"), F.col("_t.termWeights").alias("weight"))
        .join(names, "term_index")
        .select("topic", "rank", "term", "weight")
    )
