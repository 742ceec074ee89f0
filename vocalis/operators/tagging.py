"""Topics through a bigram lexicon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalis.functions.text import explode_each, with_once
from vocalis.session import LITERAL_ROWS, broadcast_if_small, materialize, with_row_id

IGNORED = "x"


def topic_map(lexicon: DataFrame) -> DataFrame:
    """One row per tagged bigram.  Ignored rows and NULL bigrams go first; of several rows for
    one bigram the last one (by ``ord``) wins, then, or without ``ord``, the greatest topic."""
    tagged = lexicon.where((F.col("topic") != IGNORED) & F.col("bigram").isNotNull())
    place = F.struct("ord", "topic") if "ord" in lexicon.columns else F.col("topic")
    return tagged.groupBy("bigram").agg(F.max_by("topic", place).alias("topic"))


def _small_map(lexicon: DataFrame) -> dict[str, str] | None:
    """The lexicon as a dictionary if it is small enough for a literal, else None."""
    rows = topic_map(lexicon).limit(LITERAL_ROWS + 1).collect()
    return {r["bigram"]: r["topic"] for r in rows} if len(rows) <= LITERAL_ROWS else None


def _looked_up(df: DataFrame, grams: str, lexicon: DataFrame) -> DataFrame:
    """``df`` with ``topics`` by a join of every bigram with the lexicon.

    Rows are put together again by a row number, and their other columns travel on the first
    bigram only; equal, NULL or missing ids make no difference."""
    keep = [c for c in df.columns if c != "topics"]
    rest = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_rest")
    rows = with_row_id(df.select(rest, F.array_distinct(grams).alias("_g"))).repartition(F.col("_row"))
    each = rows.select("_row", "_rest", F.posexplode_outer("_g").alias("_pos", "bigram"))
    each = each.withColumn("_rest", F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_rest")))
    found = each.join(broadcast_if_small(topic_map(lexicon)), "bigram", "left").groupBy("_row").agg(
        F.array_sort(F.collect_set("topic")).alias("topics"), F.first("_rest", ignorenulls=True).alias("_rest"))
    return found.select("_rest.*", "topics")


def match_topics(df: DataFrame, grams: str, lexicon: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``ids`` and the sorted distinct ``topics`` of every row that has at least one, by a
    join with the lexicon; rows with equal ids count as one.  Only matched bigrams are shuffled."""
    rows = explode_each(df.select(*ids, F.array_distinct(grams).alias(grams)), grams, "bigram", *ids)
    hits = rows.join(broadcast_if_small(topic_map(lexicon)), "bigram")
    return hits.groupBy(*ids).agg(F.array_sort(F.collect_set("topic")).alias("topics"))


def tag_topics(df: DataFrame, grams: str, lexicon: DataFrame) -> DataFrame:
    """Add ``topics``, the sorted distinct topics of the row's bigrams (empty if none).

    A lexicon of checked size becomes a literal of a narrow expression, so nothing is
    shuffled; a larger one is joined, with the same result.
    """
    mapping = _small_map(lexicon)
    if mapping is None:
        return _looked_up(df, grams, lexicon)
    if not mapping:
        return df.withColumn("topics", F.array().cast("array<string>"))
    keys = F.array(*[F.lit(b) for b in mapping])
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    hits = F.array_intersect(F.col(grams), keys)
    topics = F.array_sort(F.array_distinct(F.transform(hits, lambda b: F.element_at(pairs, b))))
    return with_once(df, topics=F.coalesce(topics, F.array().cast("array<string>")))


def has_lexicon_bigram(df: DataFrame, grams: str, lexicon: DataFrame, name: str) -> DataFrame:
    """Boolean column: does the row share a bigram with the lexicon?"""
    mapping = _small_map(lexicon)
    if mapping is None:
        rest = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row_of")
        hit = _looked_up(df.select(rest, F.col(grams).alias("_grams")), "_grams", lexicon)
        return hit.select("_row_of.*", (F.size("topics") > 0).alias(name))
    keys = F.array(*[F.lit(b) for b in mapping]).cast("array<string>")
    return with_once(df, **{name: F.coalesce(F.arrays_overlap(F.col(grams), keys), F.lit(False))})


def filter_tagged(df: DataFrame, grams: str, lexicon: DataFrame, labelled: bool = False) -> DataFrame:
    """Keep rows with at least one lexicon bigram; labelled training rows all pass."""
    if labelled:
        return df
    marked = has_lexicon_bigram(df, grams, lexicon, "_tagged")
    return marked.where(F.col("_tagged")).drop("_tagged")


def binarize_topics(df: DataFrame, topics: Sequence[str]) -> DataFrame:
    """One boolean column per topic of a fixed list, so every table gets the same schema."""
    return df.select("*", *[F.array_contains("topics", t).alias(t) for t in sorted(topics)])


def topic_array(topics: Sequence[str]):
    """The inverse of :func:`binarize_topics`: array of the topics whose flag is set."""
    flags = [F.when(F.col(t), F.lit(t)) for t in sorted(topics)]
    return F.filter(F.array(*flags), lambda t: t.isNotNull())


def distinct_topics(df: DataFrame, topics: str = "topics") -> DataFrame:
    return explode_each(df, topics, "topic").distinct().orderBy("topic")


#: Buckets that bound the frequency of the bigrams in them, and those looked into for a rank.
GRAM_BUCKETS, FULLEST_BUCKETS = 1 << 20, 4


def bigram_ranks(df: DataFrame, grams: str, upto: int) -> DataFrame:
    """The ``upto`` bigrams of highest document frequency with their rank from 0.

    Most bigrams are rare, and a count of each would be as large as the corpus.  So the rows of
    hash buckets are counted first: no bigram has more than its bucket.  The bigrams of the fullest
    buckets give a frequency that ``upto`` of them reach, and only buckets of as many rows, ties
    too, can hold one of the answer; their bigrams are counted each."""
    each = explode_each(df.select(F.array_distinct(grams).alias("_g")), "_g", "bigram")
    keyed = each.withColumn("_bucket", F.pmod(F.xxhash64("bigram"), F.lit(GRAM_BUCKETS)).cast("int"))
    counts = lambda rows: rows.groupBy("bigram").agg(F.count(F.lit(1)).alias("df"))
    buckets = materialize(keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows")))
    fullest = buckets.orderBy(F.desc("_rows"), "_bucket").limit(FULLEST_BUCKETS * upto).select("_bucket")
    some = counts(keyed.join(F.broadcast(fullest), "_bucket", "left_semi")).orderBy(F.desc("df")).limit(upto)
    found = some.agg(F.count(F.lit(1)).alias("n"), F.min("df").alias("least")).first()
    least = found["least"] if found["n"] == upto else 0
    able = buckets.where(F.col("_rows") >= F.lit(least or 0)).select("_bucket")
    top = counts(keyed.join(F.broadcast(able), "_bucket", "left_semi")).orderBy(F.desc("df"), "bigram").limit(upto)
    # Only ``upto`` rows reach this window.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("df"), "bigram")) - 1)
