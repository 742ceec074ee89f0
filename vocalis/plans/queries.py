"""One query per operator: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.functions import rows as R
from vocalis.functions import text as T
from vocalis.operators import (
    assemble, clean, context_tags, lexicon_sentiment, models, online_lda, report, sampling, table_models, tagging, terms, trainer,
)
from vocalis.plans import views as V
from vocalis.session import new_shared_path
from vocalis.sources import tables
from vocalis.streaming import master_stream

# Order and line number alone do not identify a line item here.
LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def _flat(c: str):
    return F.array_join(c, " ").alias(c)


def _r(c, digits: int = 10):
    return F.round(c, digits)


def _rounded(df: DataFrame, *names: str, digits: int = 10) -> DataFrame:
    return df.select(*[_r(F.col(f"`{c}`"), digits).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


# ---- scans, sources, sinks -------------------------------------------------------------
@query
def scan_csv_typed(spark, d):
    path = new_shared_path(spark, "posts-csv")
    rows = V.posts(spark, d).select(
        F.col("post_id").cast("string").alias("tweet_id"), F.col("post_date").alias("tweet_date"),
        F.col("text").alias("tweet_text"), "user_id",
        F.col("retweet_count").cast("int"), F.col("favorite_count").cast("int"),
    )
    tables.write_csv(rows, path)
    back = tables.read_csv(spark, path, tables.schema_of(tables.POSTS), multi_line=True, rules=tables.POSTS)
    return back.select("tweet_id", _day("tweet_date"), "tweet_text", "user_id", "retweet_count", "favorite_count")


@query
def scan_lookup(spark, d):
    path = new_shared_path(spark, "accounts-csv")
    tables.write_csv(V.accounts(spark, d), path)
    return tables.read_accounts(spark, path)


@query
def scan_id_list(spark, d):
    path = new_shared_path(spark, "ids")
    V.table(spark, d, "labels").select(F.col("doc_id").cast("string")).write.text(path)
    return tables.read_id_list(spark, path)


@query
def hydrate_ids(spark, d):
    archive = V.posts(spark, d).withColumn(
        "reshared", F.when(F.col("post_id") % 10 == 3, F.col("post_id") - 1)
    )
    labels = V.table(spark, d, "labels").select(F.col("doc_id").alias("post_id"))
    ids = labels.union(labels.select(F.col("post_id") + 1_000_000_000))
    columns = ["post_id", "post_date", "text", "user_id", "retweet_count", "favorite_count"]
    found = assemble.hydrate_ids(archive, ids, "post_id", columns, "reshared")
    return found.withColumn("post_date", _day("post_date"))


@query
def scan_projected(spark, d):
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query
def sink_replace_table(spark, d):
    path = new_shared_path(spark, "posts-table")
    rows = V.posts(spark, d).select("post_id", _day("post_date"), "user_id", "branch", "retweet_count")
    tables.replace_table(rows.where(F.col("branch") == "house"), "posts", path)
    return tables.replace_table(rows, "posts", path)


@query
def sink_csv(spark, d):
    path = new_shared_path(spark, "tokens-csv")
    tables.write_csv(V.tokens(spark, d).select("post_id", "tokens"), path)
    back = spark.read.csv(path, schema="post_id long, tokens string", header=True, escape='"')
    return back.select("post_id", F.array_join(F.from_json("tokens", "array<string>"), " ").alias("tokens"))


@query
def check_constraints(spark, d):
    rows = V.posts(spark, d).select(
        F.when(F.col("post_id") % 17 != 0, F.col("post_id").cast("string")).alias("tweet_id"),
        F.col("text").alias("tweet_text"), "user_id",
    )
    rules = [("tweet_id", None, 2, True), ("tweet_text", None, 1500, False), ("user_id", None, 4, True)]
    return tables.check_constraints(rows, rules)


# ---- projections, filters, predicates --------------------------------------------------
@query
def rename_columns(spark, d):
    return V.table(spark, d, "customer").toDF("id", "name", "nation", "balance", "segment")


@query
def drop_columns(spark, d):
    return V.table(spark, d, "customer").drop("c_name", "c_mktsegment")


@query
def cast_columns(spark, d):
    return V.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_totalprice").cast("int").alias("price_int"),
        F.col("o_orderkey").cast("double").alias("key_double"),
        (F.col("o_orderstatus") == "F").cast("int").alias("finished"),
        F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd").alias("day"),
        F.expr("try_cast(o_orderpriority as int)").alias("not_a_number"),
    )


@query
def recode_label(spark, d):
    return V.training(spark, d).select("doc_id", R.recode_label(F.col("label")).alias("label"))


@query
def filter_date_range(spark, d):
    rows = V.posts(spark, d).where(F.col("post_date").between("2018-01-01", "2019-01-01"))
    return rows.select("post_id", _day("post_date"))


@query
def filter_keyword(spark, d):
    rows = V.tokens(spark, d).where(
        F.col("post_date").between("2018-01-01", "2019-01-01")
        & F.exists("tokens", lambda t: t.contains("th"))
    )
    return sampling.first_n(rows, 10_000, "post_id").select("post_id", _flat("tokens"))


@query
def filter_nonempty_tokens(spark, d):
    only = T.with_once(V.tokens(spark, d), kept=F.filter("tokens", lambda t: t.startswith("#")))
    return only.where(F.size("kept") > 0).select("post_id", F.size("kept").alias("n"))


@query
def filter_topic(spark, d):
    return V.master(spark, d).where(F.col("topic_2")).select("post_id", "user_id", "leadership")


@query
def filter_tagged(spark, d):
    kept = tagging.filter_tagged(V.grams(spark, d), "grams", V.lexicon(spark, d))
    return kept.select("post_id", "branch")


@query
def filter_in_list(spark, d):
    long = report.melt_scores(V.sentiments(spark, d), ["post_id", "group"], report.SCORES)
    return long.where(F.col("variable").isin("negative", "positive"))


@query
def flag_leadership(spark, d):
    return V.posts(spark, d).select(
        "post_id", R.is_leadership(F.col("branch"), V.LEADERSHIP).cast("int").alias("leadership")
    )


@query
def map_party(spark, d):
    return V.accounts(spark, d).select(
        "user_id", R.party_flag(F.col("party_affiliation")).cast("int").alias("democrat")
    )


@query
def assign_group(spark, d):
    return V.master(spark, d).select(
        "post_id", R.group_label(F.col("democrat"), F.col("leadership")).alias("group")
    )


@query
def class_indicators(spark, d):
    p = F.col("prediction_class")
    return V.predictions(spark, d).select(
        "post_id", R.class_indicator(p, 0).alias("negative"), R.class_indicator(p, 1).alias("positive")
    )


@query
def threshold_prediction(spark, d):
    score = (F.col("doc_id") % 201 - 100) / F.lit(25.0)
    p = R.sigmoid(score)
    return V.table(spark, d, "documents").select("doc_id", _r(p, 6).alias("p"), R.threshold(p).alias("prediction"))


@query
def parse_token_list(spark, d):
    printed = V.tokens(spark, d).select("post_id", T.print_token_list(
        F.transform("tokens", lambda t: F.when(t.contains("th"), F.concat(t, F.lit("'s"))).otherwise(t))
    ).alias("printed"))
    return T.with_once(printed, tokens=T.parse_token_list(F.col("printed"))).select("post_id", _flat("tokens"))


# ---- joins -----------------------------------------------------------------------------
@query
def join_accounts(spark, d):
    joined = assemble.join_accounts(V.posts(spark, d), V.accounts(spark, d))
    return joined.select("post_id", "user_id", "branch", F.col("democrat").cast("int").alias("democrat"))


@query
def join_predictions(spark, d):
    joined = assemble.join_predictions(V.master(spark, d), V.predictions(spark, d), "post_id")
    return joined.select("post_id", "user_id", "prediction_raw", "prediction_class")


@query
def join_lexicon(spark, d):
    found = tagging.match_topics(V.grams(spark, d), "grams", V.lexicon(spark, d), ["post_id"])
    return found.select("post_id", _flat("topics"))


@query
def join_idf(spark, d):
    words = V.tokens(spark, d)
    bags = terms.bag_of_words(words, "post_id")
    weights = terms.doc_frequency(words).select("term", "weight")
    return terms.join_weights(bags, weights).select("post_id", "term", "tf", "weight")


@query
def join_embeddings(spark, d):
    rows = models.join_embeddings(
        V.labelled_tokens(spark, d), V.vectors(spark, d), ["doc_id"], "tokens", V.VECTOR_SIZE
    )
    first = F.get("vector", F.lit(0)).cast("double")
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum((first != 0).cast("int")).alias("n_known"),
        _r(F.sum(first), 4).alias("sum_first"),
    )


@query
def anti_join_stopwords(spark, d):
    """The long form of stop-word removal: no word of the list survives among the terms."""
    stop = spark.createDataFrame([(w,) for w in T.STOP_WORDS + T.EXTRA_STOP_WORDS], "term string")
    rows = T.explode_each(V.raw_tokens(spark, d), "tokens", "term")
    return rows.join(F.broadcast(stop), "term", "left_anti").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


# ---- aggregations and reshapes ---------------------------------------------------------
@query
def agg_sentiment_by_group(spark, d):
    out = report.sentiment_by_group(V.sentiments(spark, d))
    return _rounded(out, *[c for c in out.columns if c.endswith(("_mean", "_std"))])


@query
def count_by_topic(spark, d):
    return report.count_by_topic(V.master(spark, d), V.TOPICS)


@query
def class_size(spark, d):
    return report.class_size(V.predictions(spark, d))


@query
def group_mean(spark, d):
    return _rounded(report.group_mean(V.scored_master(spark, d)), "mean_prediction_class")


@query
def topic_group_stats(spark, d):
    stats = report.topic_group_stats(V.scored_master(spark, d), V.TOPICS + ["topic_without_posts"])
    return _rounded(stats, "Mean_Class", "Std")


@query
def pivot_topic_group(spark, d):
    wide = report.pivot_topic_group(report.topic_group_stats(V.scored_master(spark, d), V.TOPICS))
    return _rounded(wide.toDF(*[c.replace("-", "_") for c in wide.columns]), *[
        c.replace("-", "_") for c in wide.columns if c != "Topic"
    ])


@query
def melt_scores(spark, d):
    return report.melt_scores(V.sentiments(spark, d), ["post_id", "group"], report.SCORES)


@query
def multilabel_binarize(spark, d):
    flags = tagging.binarize_topics(V.tagged(spark, d).select("post_id", "topics"), V.TOPICS)
    return flags.select("post_id", *[F.col(t).cast("int").alias(t) for t in V.TOPICS])


@query
def distinct_topics(spark, d):
    return tagging.distinct_topics(V.tagged(spark, d))


@query
def term_counts(spark, d):
    return terms.term_counts(V.tokens(spark, d))


@query
def bag_of_words(spark, d):
    return terms.bag_of_words(V.tokens(spark, d), "post_id")


@query
def doc_frequency(spark, d):
    return terms.doc_frequency(V.tokens(spark, d))


@query
def dictionary_build(spark, d):
    return terms.dictionary(V.tokens(spark, d))


@query
def dictionary_filter_extremes(spark, d):
    words = V.tokens(spark, d)
    counts = terms.doc_frequency(words).drop("weight")
    return terms.filter_extremes(counts, terms.n_rows(words), no_below=15, no_above=0.8, keep_n=10_000)


@query
def vocab_topn(spark, d):
    return terms.vocabulary(V.tokens(spark, d))


@query
def split_sizes(spark, d):
    parts = sampling.split(
        V.table(spark, d, "documents").select("doc_id"), {"train": 0.7, "test": 0.2, "valid": 0.1}, ["doc_id"]
    )
    return parts.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _labelled_predictions(spark, d):
    p = V.predictions(spark, d).select(F.col("post_id").alias("doc_id"), F.col("prediction_class").alias("prediction"))
    return V.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")).join(p, "doc_id")


@query
def binary_metrics(spark, d):
    return _rounded(report.binary_metrics(_labelled_predictions(spark, d)), "accuracy", "precision", "recall")


@query
def mean_with_ci(spark, d):
    long = report.melt_scores(V.sentiments(spark, d), ["post_id", "group"], report.SCORES)
    return _rounded(report.mean_with_ci(long), "mean", "low", "high")


@query
def mean_by_variable_group(spark, d):
    long = report.melt_scores(V.sentiments(spark, d), ["post_id", "group"], report.SCORES)
    return _rounded(report.mean_by_cell(long), "mean").select("variable", "group", "mean")


@query
def mean_with_ci_by_topic(spark, d):
    """Means per topic, and whether the interval holds them."""
    rows = T.explode_each(V.sentiments(spark, d), "topics", "topic", "post_id", "group", *report.SCORES)
    long = report.melt_scores(rows, ["post_id", "group", "topic"], report.SCORES)
    out = report.mean_with_ci(long, ("topic", "variable", "group"))
    inside = (F.col("low") <= F.col("mean") + 1e-9) & (F.col("mean") <= F.col("high") + 1e-9)
    return out.select("topic", "variable", "group", _r(F.col("mean")).alias("mean"), inside.cast("int").alias("inside"))


# ---- rankings --------------------------------------------------------------------------
@query
def top_words_per_group(spark, d):
    return terms.top_words_per_group(V.scored_master(spark, d))


@query
def top_tfidf_per_group(spark, d):
    return _rounded(terms.top_tfidf_per_group(V.scored_master(spark, d)), "score", digits=6)


# ---- sort, limit, sampling -------------------------------------------------------------
@query
def topn_terms(spark, d):
    clean_pairs = T.with_once(
        V.tokens(spark, d), pairs=T.filter_marked_bigrams(T.bigrams(F.col("tokens")))
    )
    return terms.top_terms(terms.term_counts(clean_pairs, "pairs"), 1000)


@query
def sample_n(spark, d):
    rows = sampling.sample_n(V.table(spark, d, "lineitem"), 20_000, LINE_ID, seed=7)
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query
def sample_n_per_source(spark, d):
    posts = V.posts(spark, d).where(F.col("post_date").between("2018-01-01", "2019-01-01"))
    rows = sampling.sample_n_per_group(posts, 100, ["branch"], ["post_id"], seed=5)
    return rows.select("branch", "post_id")


@query
def sample_large_per_source(spark, d):
    """Samples too large for a ranking window: cut at the exact key of rank n."""
    items = V.table(spark, d, "lineitem").select("l_returnflag", *LINE_ID)
    return sampling.sample_n_per_group(items, 15_000, ["l_returnflag"], LINE_ID, seed=5).select(
        "l_returnflag", "l_orderkey", "l_linenumber"
    )


@query
def sample_lines_per_file(spark, d):
    path = new_shared_path(spark, "lines")
    V.posts(spark, d).select("branch", F.col("post_id").cast("string")).repartition("branch").write.partitionBy("branch").text(path)
    picked = sampling.sample_lines_per_file(tables.read_lines(spark, path), 5)
    return picked.select(F.regexp_extract("file", "branch=([a-z]+)", 1).alias("branch"), "value")


@query
def sample_n_per_group(spark, d):
    rows = V.sentiments(spark, d).where(F.col("group") != "")
    return sampling.sample_n_per_group(rows, 10, ["group"], ["post_id"], seed=3).select("group", "post_id")


@query
def preview(spark, d):
    return V.posts(spark, d).orderBy("post_id").limit(5).select("post_id", _day("post_date"), "user_id", "text")


# ---- set operations --------------------------------------------------------------------
@query
def union_distinct_master(spark, d):
    acc = V.accounts(spark, d)
    doubled = assemble.union_all([acc, acc])
    parts = [V.cleaned(spark, d, b) for b in V.BRANCHES]
    out = assemble.make_master(*parts, doubled, acc)
    flags = [F.col(t).cast("int").alias(t) for t in ["leadership", "democrat", *V.TOPICS]]
    return out.select("post_id", _day("post_date"), "user_id", "retweet_count", "favorite_count", _flat("tokens"), *flags)


@query
def master_by_chunks(spark, d):
    """The master table of ``union_distinct_master``, grown from files in chunks: every chunk is
    cleaned, tagged, given its party and added."""
    acc, lexicon = V.accounts(spark, d), V.lexicon(spark, d)

    def build(chunk):
        words = T.with_once(clean.clean_tokens(chunk), words=T.strip_hashtags(F.col("tokens"), "all"))
        pairs = T.with_once(words, grams=T.tokens_plus_bigrams(F.col("words")))
        rows = tagging.tag_topics(pairs, "grams", lexicon).where(F.size("topics") > 0).withColumn("leadership", R.is_leadership(F.col("branch"), V.LEADERSHIP))
        flagged = tagging.binarize_topics(rows.drop("words", "grams"), V.TOPICS).drop("topics")
        return assemble.make_master(*[flagged.where(F.col("branch") == b).drop("branch") for b in V.BRANCHES], acc, acc)

    posts = V.posts(spark, d)
    source, target, state = (new_shared_path(spark, n) for n in ("chunks", "grown", "state"))
    posts.repartition(4, "post_id").write.parquet(source)
    master_stream.grow_master(spark, source, posts.schema, build, target, state, files_per_chunk=2)
    flags = [F.col(t).cast("int").alias(t) for t in ["leadership", "democrat", *V.TOPICS]]
    out = master_stream.read_master(spark, target)
    return out.select("post_id", _day("post_date"), "user_id", "retweet_count", "favorite_count", _flat("tokens"), *flags)


@query
def union_all_docs(spark, d):
    return assemble.union_all([
        V.documents(spark, d).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("chars")),
        V.table(spark, d, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), F.length("text").cast("long").alias("chars")),
        V.table(spark, d, "conversations").select(F.lit("conversations").alias("origin"), F.col("conv_id").alias("id"), F.length("text").cast("long").alias("chars")),
    ])


@query
def bigram_lexicon_intersect(spark, d):
    hit = tagging.has_lexicon_bigram(V.grams(spark, d), "grams", V.lexicon(spark, d), "political")
    return hit.select("post_id", F.col("political").cast("int").alias("political"))


# ---- text ------------------------------------------------------------------------------
@query
def strip_punctuation(spark, d):
    return V.documents(spark, d).select("doc_id", T.strip_punctuation(F.col("text")).alias("text"))


@query
def strip_urls(spark, d):
    page = F.concat_ws(" ", "url", "html")
    return V.table(spark, d, "pages").select(
        "page_id", T.strip_urls(page).alias("text"), T.strip_urls(T.strip_punctuation(page)).alias("glued")
    )


@query
def tokenize_text(spark, d):
    return V.raw_tokens(spark, d).select("post_id", _flat("tokens"))


@query
def strip_handles(spark, d):
    return V.posts(spark, d).select("post_id", T.strip_handles(F.col("text")).alias("text"))


@query
def strip_hashtags(spark, d):
    rows = V.raw_tokens(spark, d)
    both = T.with_once(
        rows,
        none=T.strip_hashtags(F.col("tokens"), "all"),
        unlisted=T.strip_hashtags(F.col("tokens"), "select", V.SELECT_TAGS),
    )
    return both.select("post_id", F.size("tokens").alias("n"), _flat("none"), _flat("unlisted"))


@query
def remove_stopwords(spark, d):
    return V.raw_tokens(spark, d).select("post_id", T.join_tokens(T.remove_stopwords(F.col("tokens"))).alias("tokens"))


@query
def lemmatize_lookup(spark, d):
    raw = V.raw_tokens(spark, d).select("post_id", "tokens")
    out = clean.lemmatize(raw, "tokens", V.lemmas(spark, d), V.tags(spark, d))
    return out.select("post_id", _flat("tokens"))


@query
def make_bigrams(spark, d):
    pairs = T.with_once(V.tokens(spark, d), pairs=T.bigrams(F.col("tokens")))
    return pairs.select("post_id", F.size("pairs").alias("n"), _flat("pairs"))


@query
def tokens_plus_bigrams(spark, d):
    return V.grams(spark, d).select("post_id", _flat("grams"))


@query
def filter_marked_bigrams(spark, d):
    pairs = T.with_once(V.tokens(spark, d), pairs=T.filter_marked_bigrams(T.bigrams(F.col("tokens"))))
    return pairs.where(F.size("pairs") > 0).select("post_id", _flat("pairs"))


@query
def join_tokens(spark, d):
    return V.tokens(spark, d).select("post_id", T.join_tokens(F.col("tokens")).alias("doc"))


@query
def token_length(spark, d):
    return V.tokens(spark, d).select("post_id", F.size("tokens").alias("len"))


@query
def tag_topics(spark, d):
    out = tagging.tag_topics(V.grams(spark, d), "grams", V.lexicon(spark, d))
    return out.select("post_id", _flat("topics"))


@query
def clean_chain(spark, d):
    out = clean.clean_documents(
        V.posts(spark, d), V.lexicon(spark, d), V.TOPICS, source="branch", leadership_sources=V.LEADERSHIP,
        strip_handles=True, hashtags="select", select_tags=V.SELECT_TAGS, **V.clean_options(spark, d),
    )
    flags = [F.col(t).cast("int").alias(t) for t in ["leadership", *V.TOPICS]]
    return out.select("post_id", "user_id", "branch", _flat("tokens"), *flags)


@query
def lemmas_in_context(spark, d):
    """Lemmas of the posts' words by the part of speech they have where they stand."""
    tagger = context_tags.fit_tagger(V.tagged_rows(spark, d))
    rows = V.raw_tokens(spark, d).select("post_id", "tokens")
    # The words alone are stored, not the texts' tokens as for the other queries.
    words = V.stored(spark, d, "raw_words", lambda: terms.term_counts(rows, "tokens").select("term"))
    vocabulary = words.select(F.col("term").alias("word"), F.explode(F.array(*[F.lit(p) for p in "nva"])).alias("pos"))
    return context_tags.lemmatize_in_context(rows, tagger, vocabulary).select("post_id", _flat("tokens"))


# ---- weights, splits, sentiment --------------------------------------------------------
@query
def tfidf_features(spark, d):
    rows = T.with_once(V.tokens(spark, d), words=T.vector_words(F.col("tokens")))
    n_docs = terms.n_rows(V.tokens(spark, d))
    return _rounded(terms.tfidf_smooth(rows, "post_id", "words", 1e-4, n_docs), "tfidf", digits=6)


@query
def tfidf_log2(spark, d):
    return _rounded(terms.tfidf_log2(V.tokens(spark, d), "post_id"), "tfidf", digits=6)


@query
def stratified_split(spark, d):
    labels = V.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return sampling.stratified_split(labels, "label", ["doc_id"])


@query
def random_split(spark, d):
    items = V.table(spark, d, "orders").select("o_orderkey")
    return sampling.split(items, {"train": 0.7, "test": 0.2, "valid": 0.1}, ["o_orderkey"], seed=11)


@query
def stratified_folds(spark, d):
    labels = V.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return sampling.stratified_folds(labels, "label", ["doc_id"])


@query
def evaluate_splits(spark, d):
    rows = sampling.stratified_split(_labelled_predictions(spark, d), "label", ["doc_id"])
    held = rows.where(F.col("split") != "train").withColumn("family", F.lit("fixed"))
    return _rounded(models.evaluate_splits(held), "accuracy", "precision", "recall")


@query
def lexicon_sentiment_scores(spark, d):
    rows = V.documents(spark, d).select("doc_id", V.voiced(F.col("text")).alias("text"))
    return lexicon_sentiment.lexicon_sentiment(rows, V.valences(spark, d), ["doc_id"])


QUERIES["lexicon_sentiment"] = QUERIES.pop("lexicon_sentiment_scores")


def _turns(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "text")


@query
def sentiment_repeated_ids(spark, d):
    """Turns of conversations: ids repeat, and every turn has a row of its own."""
    rows = _turns(spark, d).select("conv_id", V.voiced(F.col("text")).alias("text"))
    return lexicon_sentiment.lexicon_sentiment(rows, V.valences(spark, d), ["conv_id"])


@query
def tags_repeated_ids(spark, d):
    rows = T.with_once(_turns(spark, d), tokens=F.split("text", " "))
    pairs = T.with_once(rows, grams=T.bigrams(F.col("tokens")))
    return tagging.tag_topics(pairs, "grams", V.lexicon(spark, d)).select("conv_id", F.size("tokens").alias("n"), _flat("topics"))


@query
def lemmas_repeated_ids(spark, d):
    rows = T.with_once(_turns(spark, d), tokens=F.split("text", " ")).select("conv_id", "tokens")
    return clean.lemmatize(rows, "tokens", V.lemmas(spark, d), V.tags(spark, d)).select("conv_id", _flat("tokens"))


@query
def lexicon_sentiment_by_topic(spark, d):
    out = lexicon_sentiment.sentiment_by_topic(V.sentiments(spark, d))
    return _rounded(out, *[c for c in out.columns if c.endswith(("_mean", "_std"))])


# ---- models ----------------------------------------------------------------------------
# --- fixed values: the configuration of the supervised job --------------------------------
CONFIG = {
    "min_df": 0.0001,
    "folds": 5,
    "scoring": "accuracy",
    "grid": {
        "LR": {"type": "LogisticRegression()", "grid": {"penalty": ["l1", "l2"], "C": [0.01, 0.001]}},
        "NB": {"type": "GaussianNB()", "grid": {}},
    },
}


def _features(spark, d):
    def build():
        rows = V.labelled_tokens(spark, d)
        model = models.fit_tfidf(rows.where(F.col("split") == "train"), "tokens", CONFIG["min_df"])
        return models.add_tfidf(model, rows).select("doc_id", "label", "split", "features")
    return V.stored(spark, d, "features", build)


def _fit(spark, d, kind: str, **params):
    train = _features(spark, d).where(F.col("split") == "train")
    return models.estimator(kind, params, train.count()).fit(train)


def _logreg(spark, d):
    return _fit(spark, d, "LogisticRegression()", penalty="l2", C=1.0)


@query
def train_logreg(spark, d):
    out = models.predict(_logreg(spark, d), _features(spark, d), "doc_id", "split", "label")
    return _rounded(report.binary_metrics(out, ["split"]), "accuracy", "precision", "recall")


def _long_features(spark, d):
    """``doc_id, term, tfidf`` of the labelled texts, fitted on the training part."""
    def build():
        rows = T.with_once(V.labelled_tokens(spark, d), words=T.vector_words(F.col("tokens")))
        idf = terms.fit_idf(rows.where(F.col("split") == "train"), "words", terms.smooth_idf, CONFIG["min_df"])
        return terms.apply_idf(rows, idf, "doc_id", "words")
    return V.stored(spark, d, "long_features", build)


def _labelled(spark, d):
    rows = V.labelled_tokens(spark, d).select("doc_id", "label", "split")
    return rows, rows.where(F.col("split") == "train")


@query
def train_gaussian_nb(spark, d):
    values, (rows, train) = _long_features(spark, d), _labelled(spark, d)
    model = table_models.fit_gaussian(values, train, "doc_id")
    out = table_models.score_gaussian(model, values, rows, "doc_id")
    return _rounded(report.binary_metrics(out, ["split"]), "accuracy", "precision", "recall")


def _logistic_scores(spark, d):
    values, (rows, train) = _long_features(spark, d), _labelled(spark, d)
    weights = table_models.fit_logistic(values, train, "doc_id", reg=V.LOGISTIC["reg"], rounds=V.LOGISTIC["rounds"])
    return table_models.score_logistic(weights, values, rows, "doc_id")


@query
def grid_search_cv(spark, d):
    spec = CONFIG["grid"]["LR"]
    train = _features(spark, d).where(F.col("split") == "train")
    model, _ = models.grid_search(train, spec["type"], spec["grid"], ["doc_id"])
    return models.predict(model, _features(spark, d).where(F.col("split") == "test"), "doc_id", "label")


@query
def cv_results(spark, d):
    """Scores of every setting of every family of the configuration."""
    return models.run_baseline(V.labelled_tokens(spark, d), CONFIG, ["doc_id"])[1]


@query
def model_save_load(spark, d):
    path = new_shared_path(spark, "model")
    model = _logreg(spark, d)
    models.save_model(model, path)
    before = models.predict(model, _features(spark, d), "doc_id")
    after = models.predict(LogisticRegressionModel.load(path), _features(spark, d), "doc_id")
    both = before.join(after.withColumnsRenamed({"prediction": "_p", "probability": "_q"}), "doc_id")
    same = (F.col("prediction") == F.col("_p")) & (F.abs(F.col("probability") - F.col("_q")) < 1e-9)
    return both.select("doc_id", same.cast("int").alias("same"))


@query
def predict_class(spark, d):
    return _logistic_scores(spark, d).select("doc_id", "prediction")


@query
def predict_proba(spark, d):
    return _logistic_scores(spark, d).select("doc_id", F.round("probability", 6).alias("p"))


def _topics(spark, d, tfidf: bool):
    docs = online_lda.prepare(V.tokens(spark, d), "post_id", no_above=0.8, tfidf=tfidf)
    return docs, online_lda.fit_online(docs, k=10, passes=2)


@query
def lda_topics(spark, d):
    mixed = online_lda.mixtures(*_topics(spark, d, tfidf=False))
    share = F.array_max("mix")
    return mixed.select("post_id", (F.array_position("mix", share) - 1).alias("topic"), _r(share).alias("share"))


@query
def lda_describe(spark, d):
    return online_lda.describe(spark, _topics(spark, d, tfidf=True)[1])


@query
def lda_comparison(spark, d):
    """Perplexity of held-out posts for numbers of topics and passes."""
    docs = online_lda.prepare(V.tokens(spark, d), "post_id", no_above=0.8, held_out=0.1)
    return online_lda.compare(docs, [10, 20], [2, 5])


def _pooled(spark, d):
    def build():
        rows = V.labelled_tokens(spark, d)
        means = models.mean_vectors(rows, V.vectors(spark, d), ["doc_id", "label", "split"], "tokens", V.VECTOR_SIZE)
        return means
    return V.stored(spark, d, "pooled", build)


@query
def embedding_classifier(spark, d):
    """A network trained by Adam scores every text."""
    rows, setting = _pooled(spark, d), trainer.Setting()
    networks, _ = trainer.train_networks(rows, [setting], ["doc_id"])
    return trainer.score_network(networks[setting], rows, "doc_id")


# --- fixed values: the settings to compare ------------------------------------------------
SWEEP = {"optimizer": ["Adam", "Adagrad"], "rate": [0.01, 0.001], "decay": [0.0, 0.01], "epochs": [5, 25]}


def _sweep(spark, d):
    return trainer.sweep_networks(_pooled(spark, d), SWEEP, ["doc_id"])


@query
def hyperparameter_sweep(spark, d):
    """Loss and accuracy on the validation part of every setting."""
    return _sweep(spark, d)[1]


@query
def epoch_losses(spark, d):
    """Loss and accuracy on the validation part after every epoch of every run."""
    return _sweep(spark, d)[2]


# The survey's name of the chain.
QUERIES["clean_pipeline"] = QUERIES["clean_chain"]
