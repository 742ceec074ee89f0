import re

from pyspark.sql import functions as F

from vocalis.operators import terms
from vocalis.operators.clean import clean_documents
from vocalis.plans import views as V
from vocalis.plans.queries import QUERIES
from vocalis.streaming.clean_stream import clean_new_files


def test_new_files_are_cleaned_once(spark, tmp_path):
    posts = spark.createDataFrame([(1, "aa bb"), (2, "zz"), (3, "aa bb cc")], "id long, text string")
    lexicon = spark.createDataFrame([("aa_bb", "health")], "bigram string, topic string")
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    clean = lambda df: clean_documents(df, lexicon, ["health"])
    for part in (posts.where("id < 3"), posts.where("id = 3")):
        part.coalesce(1).write.mode("append").parquet(source)
        clean_new_files(spark, source, posts.schema, clean, target, state)
    got = spark.read.parquet(target)
    assert sorted(r["id"] for r in got.collect()) == [1, 3]
    assert got.columns == clean(posts).columns


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_limit_runs_before_the_shuffle(spark, small):
    for name in ("top_words_per_group", "top_tfidf_per_group"):
        assert re.search(r"WindowGroupLimit.*Partial", plan(QUERIES[name](spark, small))), name


def test_no_plan_multiplies_rows_by_rows(spark, small):
    for name in ("clean_chain", "tag_topics", "union_distinct_master", "topic_group_stats", "tfidf_features",
                 "lexicon_sentiment", "stratified_split", "sample_large_per_source", "dictionary_build"):
        text = plan(QUERIES[name](spark, small))
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name


def test_scans_read_only_what_they_need(spark, small):
    text = plan(QUERIES["filter_topic"](spark, small))
    assert "PushedFilters: [IsNotNull(topic_2), EqualTo(topic_2,true)]" in text
    assert "tokens" not in text.split("ReadSchema")[1]


def test_tokens_are_made_once(spark, small):
    text = plan(terms.term_counts(V.raw_tokens(spark, small)))
    assert text.count("regexp_extract_all") == 1


def test_tagging_and_sampling_need_no_shuffle(spark, small):
    assert "Exchange" not in plan(QUERIES["tag_topics"](spark, small))
    assert "Exchange" not in plan(QUERIES["sample_n"](spark, small))


def test_one_shuffle_for_weights(spark, small):
    rows = V.tokens(spark, small)
    text = plan(terms.tfidf_log2(rows, "post_id"))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert F.col is not None


def test_labelled_texts_are_cleaned_once(spark, small):
    assert V.labelled_tokens(spark, small).count()
    assert (spark.sparkContext.applicationId, small, "labelled_rows") in V._stored
