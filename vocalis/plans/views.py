"""The engine's inputs, derived from the provided tables.

``posts``, ``accounts`` and ``training`` play the raw tables; ``lexicon``, ``valences``,
``lemmas`` and ``vectors`` the lookups a user would bring; ``master`` the stored result of
cleaning and assembling.  Everything is computed by Spark from whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalis.functions import text as T
from vocalis.functions.rows import group_label
from vocalis.functions.words import BOOSTERS_DOWN, BOOSTERS_UP, NEGATIONS
from vocalis.operators import assemble, clean, lexicon_sentiment, sampling, tagging, terms
from vocalis.sources import tables
from vocalis.session import new_shared_path

BRANCHES = ["democrat", "republican", "house", "senate"]
LEADERSHIP = ["senate", "house"]
TOPICS = [f"topic_{i}" for i in range(5)]
SELECT_TAGS = ["#OF"]
LEXICON_RANKS = (200, 280)
VALENCE_WORDS = 400
VECTOR_SIZE = 64
LOGISTIC = {"reg": 0.001, "rounds": 6}

_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write a derived table once per session to the shared folder and read it from there."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = new_shared_path(spark, name)
        build().write.parquet(path)
        _stored[key] = spark.read.parquet(path)
    return _stored[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_parquet(spark, f"{sf_dir}/documents.parquet")


def marked(text):
    """The corpus has no handles or hashtags, so two of its words become some."""
    return F.replace(F.replace(text, F.lit(" the "), F.lit(" @the ")), F.lit(" of "), F.lit(" #of "))


def voiced(text):
    """Text in which every sentiment rule has work: boosters, negations, 'but', capitals, marks."""
    for old, new in ((" of ", " very "), (" to ", " not "), (" was ", " but "), (" and ", "! "), (" in ", " IN ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = F.element_at(
        F.array(*[F.lit(b) for b in BRANCHES]), (F.floor(F.col("doc_id") / 20) % 4 + 1).cast("int")
    )
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("post_id"),
        F.date_add(F.lit("2018-01-01").cast("date"), (F.col("doc_id") % 500).cast("int")).alias("post_date"),
        marked(F.col("text")).alias("text"),
        F.col("source").alias("user_id"),
        (F.col("n_chars") % 100).alias("retweet_count"),
        (F.col("doc_id") % 37).alias("favorite_count"),
        branch.alias("branch"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("user_id")).distinct()
    number = F.substring("user_id", 4, 10).cast("int") % 4
    party = F.when(number == 0, "D").when(number == 1, "R").when(number == 2, "O")
    return names.where(F.col("user_id") != "src19").select(
        F.concat(F.lit("t_"), F.col("user_id")).alias("token"),
        "user_id",
        F.concat(F.lit("https://example.org/"), F.col("user_id")).alias("link"),
        party.alias("party_affiliation"),
    )


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, 4).otherwise(F.lit(0)).alias("label")
    )
    return labels.join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = (F.col("doc_id") * 7919 % 1000) / F.lit(1000.0)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("post_id"), raw.alias("prediction_raw"), (raw > 0.5).cast("int").alias("prediction_class")
    )


def both_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with ``raw`` tokens and those left without stop words, found in one pass and stored by
    column, so that a reader of one does not read the other."""
    def build() -> DataFrame:
        raw = raw_tokens(spark, sf_dir).withColumnRenamed("tokens", "raw")
        return T.with_once(raw, tokens=T.remove_stopwords(F.col("raw")))
    return stored(spark, sf_dir, "tokens", build)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``term``: every word of the posts as it stands, lemmas and stop words included."""
    def build() -> DataFrame:
        return terms.term_counts(both_tokens(spark, sf_dir), "raw").select("term")
    return stored(spark, sf_dir, "words", build)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with their cleaned tokens, as a stored table."""
    return both_tokens(spark, sf_dir).drop("raw")


def grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post ids with tokens and bigrams after hashtags are gone."""
    words = T.with_once(tokens(spark, sf_dir), words=T.strip_hashtags(F.col("tokens"), "all"))
    return T.with_once(words, grams=T.tokens_plus_bigrams(F.col("words")))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bigram, topic, ord``: frequent bigrams of the corpus, dealt over the topics."""
    def build() -> DataFrame:
        words = T.with_once(tokens(spark, sf_dir), words=T.strip_hashtags(F.col("tokens"), "all"))
        pairs = T.with_once(words, pairs=T.bigrams(F.col("words")))
        low, high = LEXICON_RANKS
        rank = F.col("rank")
        return tagging.bigram_ranks(pairs, "pairs", high).where(rank >= low).select(
            "bigram",
            F.when(rank % 8 == 7, "x").otherwise(F.concat(F.lit("topic_"), (rank % 5).cast("string"))).alias("topic"),
            rank.alias("ord"),
        )
    return stored(spark, sf_dir, "lexicon", build)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post with tokens and its sorted topics (possibly none)."""
    return stored(
        spark, sf_dir, "tagged",
        lambda: tagging.tag_topics(grams(spark, sf_dir), "grams", lexicon(spark, sf_dir)).drop("grams"),
    )


def cleaned(spark: SparkSession, sf_dir: str, branch: str) -> DataFrame:
    """The cleaned table of one branch."""
    rows = tagged(spark, sf_dir).where((F.col("branch") == branch) & (F.size("topics") > 0))
    led = F.lit(branch in LEADERSHIP).alias("leadership")
    kept = rows.select(
        "post_id", "post_date", "text", "user_id", "retweet_count", "favorite_count", "tokens", led, "topics"
    )
    return tagging.binarize_topics(kept, TOPICS).drop("topics")


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        acc = accounts(spark, sf_dir)
        return assemble.make_master(*[cleaned(spark, sf_dir, b) for b in BRANCHES], acc, acc)
    return stored(spark, sf_dir, "master", build)


def scored_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master rows with group, topic array and predictions."""
    rows = master(spark, sf_dir).withColumn("topics", tagging.topic_array(TOPICS))
    rows = rows.withColumn("group", group_label(F.col("democrat"), F.col("leadership")))
    joined = assemble.join_predictions(rows, predictions(spark, sf_dir), "post_id")
    return joined.withColumn("class", F.col("prediction_class"))


def valences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token, valence``: the most widespread words that are not rule words."""
    def build() -> DataFrame:
        words = T.with_once(
            documents(spark, sf_dir), words=lexicon_sentiment.sentiment_words(voiced(F.col("text")))
        )
        lower = words.select(F.transform("words", F.lower).alias("words"))
        counts = terms.doc_frequency(lower, "words")
        free = counts.where(~F.col("term").isin(BOOSTERS_UP + BOOSTERS_DOWN + NEGATIONS + ["but"]))
        top = terms.top_terms(free, VALENCE_WORDS, by="df")
        rank = F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1
        return top.select(F.col("term").alias("token"), (rank % 9 - 4).cast("double").alias("valence"))
    return stored(spark, sf_dir, "valences", build)


def sentiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment of every master row with party, leadership, topics and group."""
    def build() -> DataFrame:
        rows = master(spark, sf_dir).select(
            "post_id", "democrat", "leadership", tagging.topic_array(TOPICS).alias("topics"), voiced(F.col("text")).alias("text")
        )
        scored = lexicon_sentiment.lexicon_sentiment(
            rows, valences(spark, sf_dir), ["post_id", "democrat", "leadership"], "text", ["topics"]
        )
        return scored.withColumn("group", group_label(F.col("democrat"), F.col("leadership")))
    return stored(spark, sf_dir, "sentiments", build)


def raw_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with tokens as they are before lemmas and stop words."""
    plain = T.strip_urls(T.strip_punctuation(F.col("text")))
    return T.with_once(posts(spark, sf_dir), tokens=T.tokenize(plain))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token, pos``: words in -ing count as verbs."""
    def build() -> DataFrame:
        known = words(spark, sf_dir).select(F.col("term").alias("token"))
        return known.where(F.col("token").endswith("ing")).select("token", F.lit("v").alias("pos"))
    return stored(spark, sf_dir, "tags", build)


def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token, pos, lemma``: an ending is cut where the corpus knows the rest as a word."""
    def build() -> DataFrame:
        known = words(spark, sf_dir)
        cut = [
            known.where(F.col("term").endswith(end) & (F.length("term") > len(end) + 2)).select(
                F.col("term").alias("token"), F.lit(pos).alias("pos"),
                F.substring("term", F.lit(1), F.length("term") - len(end)).alias("lemma"),
            )
            for end, pos in (("s", "n"), ("ing", "v"))
        ]
        return assemble.union_all(cut).join(known.select(F.col("term").alias("lemma")), "lemma", "left_semi")
    return stored(spark, sf_dir, "lemmas", build)


def tagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with tags by rule: words in -ing are verbs unless an article stands
    before them, other words after an article or in -s nouns, the rest adjectives."""
    words = T.with_once(table(spark, sf_dir, "conversations"), tokens=T.tokenize(T.strip_punctuation(F.col("text"))))
    before = F.concat(F.array(F.lit("")), F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))))
    article = lambda b: b.isin("the", "an", "a")
    tag = F.zip_with(before, "tokens", lambda b, t: F.when(t.isNull(), None).when(t.endswith("ing") & ~article(b), "V").when(article(t), "D").when(
        article(b) | t.endswith("s"), "N").otherwise("J"))
    return words.select("tokens", F.slice(tag, 1, F.size("tokens")).alias("tags"))


def clean_options(spark: SparkSession, sf_dir: str) -> dict:
    return {"lemmas": lemmas(spark, sf_dir), "tags": tags(spark, sf_dir)}


def labelled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts with tokens, label 0/1 and the part they belong to, as a stored table."""
    def build() -> DataFrame:
        rows = clean.clean_tokens(training(spark, sf_dir)).where(F.size("tokens") > 0)
        rows = rows.withColumn("label", F.when(F.col("label") == 4, 1).otherwise(F.col("label")))
        # The split reads its rows three times, so they are cleaned and stored before.
        kept = stored(spark, sf_dir, "labelled_rows", lambda: rows.select("doc_id", "label", "tokens"))
        return sampling.stratified_split(kept, "label", ["doc_id"])
    return stored(spark, sf_dir, "labelled", build)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token, vector``: the most frequent labelled words share the provided vectors."""
    def build() -> DataFrame:
        known = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"))
        ids = terms.vocabulary(labelled_tokens(spark, sf_dir)).where(F.col("term_id") >= 2)
        words = ids.select(F.col("term").alias("token"), (F.col("term_id") - 2).alias("vec_id"))
        return words.join(known, "vec_id").select("token", "vector")
    return stored(spark, sf_dir, "vectors", build)
