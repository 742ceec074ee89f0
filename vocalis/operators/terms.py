"""Term counts, dictionaries, weights and rankings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalis.functions.text import explode_each
from vocalis.operators.hashorder import hash_rank, order_key
from vocalis.session import BROADCAST_ROWS, has_at_most, materialize, stored


def term_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Corpus total ``n`` of every term."""
    return explode_each(df, tokens, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def top_terms(counts: DataFrame, k: int, by: str = "n") -> DataFrame:
    return counts.orderBy(F.desc(by), "term").limit(k)


def bag_of_words(df: DataFrame, id_col: str, tokens: str = "tokens") -> DataFrame:
    """``(id, term, tf)``.  Tokens of one row are adjacent, so they are counted before the
    shuffle; an input already placed by id is not shuffled at all."""
    return explode_each(df, tokens, "term", id_col).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_frequency(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``df``: rows that contain the term; ``weight``: its plain reciprocal.

    Each row contributes a term once, so a plain count replaces a distinct count."""
    once = df.select(F.array_distinct(tokens).alias("_t"))
    counts = explode_each(once, "_t", "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.withColumn("weight", F.lit(1.0) / F.col("df"))


def dictionary(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(term, df, term_id)`` with dense ids from 0, dealt in hash order of the terms so that
    no task has to sort the whole vocabulary."""
    # Ranking reads the vocabulary twice, the corpus only once.
    counts = materialize(doc_frequency(df, tokens).drop("weight"))
    ranked = hash_rank(counts, order_key("dictionary", "term"), "term_id")
    return ranked.withColumn("term_id", F.col("term_id") - 1)


def n_rows(df: DataFrame) -> Column:
    """The number of rows, as a lazily computed scalar."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def filter_extremes(
    frequencies: DataFrame, n_docs: Column, no_below: int = 15, no_above: float = 1.0, keep_n: int = 10_000
) -> DataFrame:
    """Terms in at least ``no_below`` documents and at most the share ``no_above`` of them,
    then the ``keep_n`` most frequent."""
    kept = frequencies.where(
        (F.col("df") >= no_below) & (F.col("df") <= F.floor(F.lit(float(no_above)) * n_docs))
    )
    return kept.orderBy(F.desc("df"), "term").limit(keep_n)


def vocabulary(df: DataFrame, tokens: str = "tokens", max_size: int = 25_000) -> DataFrame:
    """The ``max_size`` most frequent tokens with ids from 2; 0 is unknown, 1 is padding."""
    top = top_terms(term_counts(df, tokens), max_size)
    # Only ``max_size`` rows reach this window.
    ids = F.row_number().over(Window.orderBy(F.desc("n"), "term")) + 1
    special = df.sparkSession.createDataFrame(
        [("<unk>", 0, 0), ("<pad>", 0, 1)], "term string, n bigint, term_id bigint"
    )
    return top.withColumn("term_id", ids.cast("long")).unionByName(special)


#: Tokens whose counts one task makes at a time.
TASK_TOKENS = 1_000_000


def placed_by(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """``id, tokens`` placed by id over as many partitions as hold TASK_TOKENS tokens each: what a task
    needs to count them does not grow with the rows."""
    total = df.agg(F.sum(F.greatest(F.size(tokens), F.lit(0)))).first()[0] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_TOKENS))
    return df.select(id_col, tokens).repartition(parts, F.col(id_col))


def hot_terms(bags: DataFrame, partitions: int) -> DataFrame:
    """The terms of the most rows: all with more than a quarter of a mean shuffle partition's, fewer
    than four times ``partitions``, and by steps of a quarter of a binary order the next ones, while
    all together are at most BROADCAST_ROWS."""
    counts = bags.groupBy("term").agg(F.count(F.lit(1)).alias("_rows"))
    counts = materialize(counts.withColumn("_level", F.floor(4 * F.log2("_rows")).cast("int")))
    # At most 256 levels.
    levels = counts.groupBy("_level").agg(F.count(F.lit(1)).alias("terms"), F.sum("_rows").alias("rows")).orderBy(F.desc("_level")).collect()
    total, seen, least = sum(r["rows"] for r in levels), 0, None
    for r in levels:
        seen += r["terms"]
        if seen > BROADCAST_ROWS:
            break
        least = r["_level"]
    hot = F.col("_rows") * (4 * partitions) > total
    return materialize(counts.where(hot if least is None else hot | (F.col("_level") >= least)).select("term"))


def join_weights(bags: DataFrame, weights: DataFrame) -> DataFrame:
    """Look up the weight of every term; terms without one drop.

    A counted-small table is broadcast.  Of a larger one the weights of the hot terms are, whose
    number is bounded; the rows of all other terms are joined by a shuffle in which no term makes
    more than a quarter of a mean partition."""
    weights = materialize(weights)
    if has_at_most(weights, BROADCAST_ROWS):
        return bags.join(F.broadcast(weights), "term")
    bags = stored(bags, "bags")
    hot = hot_terms(bags, int(bags.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    head = materialize(weights.join(F.broadcast(hot), "term", "left_semi"))
    cold = bags.join(F.broadcast(hot), "term", "left_anti").join(weights, "term")
    return bags.join(F.broadcast(head), "term").unionByName(cold)


def _normalized(weights: DataFrame, id_col: str) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return weights.withColumn("_norm", norm).select(
        id_col, "term", "tf", F.when(F.col("_norm") > 0, F.col("_w") / F.col("_norm")).otherwise(0.0).alias("tfidf")
    )


def fit_idf(df: DataFrame, tokens: str, weight: Callable[[Column, Column], Column], min_df: float, n_docs: Column | None = None) -> DataFrame:
    """``term, df, idf`` of the terms in at least the share ``min_df`` of the rows;
    ``weight(rows, df)`` is the idf."""
    n_docs = n_rows(df) if n_docs is None else n_docs
    frequencies = doc_frequency(df, tokens).where(F.col("df") >= F.lit(min_df) * n_docs)
    return frequencies.select("term", "df", weight(n_docs, F.col("df")).alias("idf"))


def apply_idf(df: DataFrame, idf: DataFrame, id_col: str, tokens: str = "tokens") -> DataFrame:
    """``(id, term, tf, tfidf)`` of the terms that ``idf`` knows, unit length per document."""
    # Placed by id once: counting per document and the norm need no further shuffle.
    placed = placed_by(df, id_col, tokens)
    weights = join_weights(bag_of_words(placed, id_col, tokens), idf.select("term", F.col("idf").alias("_idf")))
    return _normalized(weights.withColumn("_w", F.col("tf") * F.col("_idf")), id_col)


def smooth_idf(n_docs: Column, df: Column) -> Column:
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + F.lit(1.0)


def tfidf_smooth(
    df: DataFrame, id_col: str, tokens: str = "tokens", min_df: float = 1e-4, n_docs: Column | None = None
) -> DataFrame:
    """``(id, term, tf, tfidf)``: smoothed idf ``ln((1+n)/(1+df)) + 1``, unit length per
    document; terms below the share ``min_df`` of documents are left out.  Give ``n_docs``
    when the tokens are costly and the rows can be counted on something cheaper."""
    return apply_idf(df, fit_idf(df, tokens, smooth_idf, min_df, n_docs), id_col, tokens)


def tfidf_log2(df: DataFrame, id_col: str, tokens: str = "tokens") -> DataFrame:
    """``(id, term, tf, tfidf)``: ``tf * log2(n/df)``, unit length per document."""
    return apply_idf(df, fit_idf(df, tokens, lambda n, d: F.log2(n / d), 0.0), id_col, tokens)


def _top_per_cell(scored: DataFrame, cell: Sequence[str], score: str, k: int) -> DataFrame:
    # The limit is applied before the shuffle as well, so a hot cell sends k rows per task.
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc(score), "term"))
    return scored.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def cell_counts(df: DataFrame, tokens: str = "tokens", topics: str = "topics") -> DataFrame:
    """Term totals per (topic, group, class); rows without a group take no part."""
    rows = df.where(F.col("group") != "").select("group", "class", topics, tokens)
    by_topic = explode_each(rows, topics, "topic", "group", "class", tokens)
    terms = explode_each(by_topic, tokens, "term", "topic", "group", "class")
    return terms.groupBy("topic", "group", "class", "term").agg(F.count(F.lit(1)).alias("n"))


def top_words_per_group(df: DataFrame, k: int = 10, tokens: str = "tokens", topics: str = "topics") -> DataFrame:
    """The ``k`` most frequent terms of every (topic, group, class); ties by term."""
    return _top_per_cell(cell_counts(df, tokens, topics), ["topic", "group", "class"], "n", k)


def top_tfidf_per_group(df: DataFrame, k: int = 10, tokens: str = "tokens", topics: str = "topics") -> DataFrame:
    """As :func:`top_words_per_group`, ranked by count times the reciprocal document frequency
    over all rows; the weight is looked up by term."""
    rows = materialize(df.select("group", "class", topics, tokens))  # read twice, made once
    weights = doc_frequency(rows, tokens).select("term", "weight")
    scored = cell_counts(rows, tokens, topics).join(weights, "term")
    scored = scored.select("topic", "group", "class", "term", (F.col("n") * F.col("weight")).alias("score"))
    return _top_per_cell(scored, ["topic", "group", "class"], "score", k)
