"""Row numbers, and the operators that regroup by them, when the input comes in another order."""

import random

import pytest
from pyspark.sql import functions as F

from vocalis.operators import assemble, clean, lexicon_sentiment, tagging
from vocalis.session import with_row_id


def test_numbers_are_the_same_on_every_evaluation(spark):
    rows = with_row_id(spark.range(500, numPartitions=4).select((F.col("id") % 7).alias("k"), F.rand().alias("r")).repartition(6))
    first, again = ({r["_row"]: (r["k"], r["r"]) for r in rows.collect()} for _ in range(2))
    assert first == again and len(first) == 500  # also of rows that no second run would make
    assert "Rand" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(1)
    rows = [(i % 9 if i % 5 else None, [rng.choice(["cats", "dogs", "running", "x", None, "good", "bad"]) for _ in range(rng.randint(0, 6))]) for i in range(200)]
    rows += [(1, None), (1, [])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    return rows, df


def outcome(frame):
    return sorted(map(str, frame.collect()))


def test_lemmas_of_both_paths_in_any_order(spark, made, monkeypatch):
    rows, df = made
    lemmas = spark.createDataFrame([("cats", "n", "cat"), ("dogs", "n", "dog"), ("running", "v", "run"), ("bad", "n", "bad")], "token string, pos string, lemma string")
    tags = spark.createDataFrame([("running", "v")], "token string, pos string")
    known = {"cats": "cat", "dogs": "dog", "running": "run"}
    wanted = sorted(str((i, [known.get(t, t) for t in x or [] if t is not None])) for i, x in rows)
    orders = [df, df.repartition(7), df.orderBy(F.rand(3))]
    narrow = clean.lemmatize(df, "tokens", lemmas, tags)
    assert "Exchange" not in narrow._jdf.queryExecution().executedPlan().toString()
    for d in orders:
        assert sorted(str(tuple(r)) for r in clean.lemmatize(d, "tokens", lemmas, tags).collect()) == wanted
    monkeypatch.setattr(clean, "LITERAL_ROWS", 0)
    for d in orders:
        assert sorted(str(tuple(r)) for r in clean.lemmatize(d, "tokens", lemmas, tags).collect()) == wanted


def test_marks_of_the_literal_in_tokens(spark):
    df = spark.createDataFrame([(1, ["a\x01b", "c", "d\x02"])], "id long, tokens array<string>")
    lemmas = spark.createDataFrame([("a\x01b", "n", "x"), ("c", "n", "y\x02z")], "token string, pos string, lemma string")
    assert clean.lemmatize(df, "tokens", lemmas).first()["tokens"] == ["x", "y\x02z", "d\x02"]
    empty = clean.lemmatize(df, "tokens", lemmas.limit(0))
    assert empty.first()["tokens"] == ["a\x01b", "c", "d\x02"]


def test_tags_of_the_large_path_in_any_order(spark, made, monkeypatch):
    _, df = made
    lexicon = spark.createDataFrame([("cats", "t1"), ("bad", "t2"), ("good", "t1")], "bigram string, topic string")
    near = outcome(tagging.tag_topics(df, "tokens", lexicon))
    monkeypatch.setattr(tagging, "LITERAL_ROWS", 0)
    for d in (df, df.repartition(7), df.orderBy(F.rand(4))):
        assert outcome(tagging.tag_topics(d, "tokens", lexicon).select(*df.columns, "topics")) == near


def test_sentiment_in_any_order(spark, made):
    rows, df = made
    texts = df.select("id", F.array_join(F.coalesce("tokens", F.array().cast("array<string>")), " ").alias("text"))
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "token string, valence double")
    for size in (10, 0):
        found = [outcome(lexicon_sentiment.lexicon_sentiment(d, lexicon, ["id"], literal_rows=size)) for d in (texts, texts.repartition(7), texts.orderBy(F.rand(5)))]
        assert len(found[0]) == len(rows) and found[0] == found[1] == found[2]


def test_union_moves_repeated_rows_only(spark):
    """Rows that come once are not shuffled whole; of the others one is left."""
    kinds = "id long, text string, value double, tokens array<string>"
    a = spark.createDataFrame([(i, f"text {i}", None, [str(i), None]) for i in range(50)], kinds)
    b = spark.createDataFrame([(7, "text 7", None, ["7", None]), (None, None, 0.0, None), (None, None, -0.0, None), (51, "", 1.0, [])] + [(60, "hot", 2.0, ["x"])] * 40, kinds)
    both = assemble.union_distinct([a, b.select("tokens", "value", "id", "text"), b])
    assert sorted(map(str, both.collect())) == sorted(map(str, a.unionByName(b).distinct().collect())) and both.count() == 53
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan


def test_lemmas_of_a_larger_dictionary_need_no_shuffle(spark, made, monkeypatch):
    """One beyond a literal is looked up row by row; one beyond a broadcast joins, with the same rows."""
    rows, df = made
    lemmas = spark.createDataFrame([("cats", "n", "cat"), ("dogs", "n", "dog")], "token string, pos string, lemma string")
    monkeypatch.setattr(clean, "LITERAL_ROWS", 0)
    found = clean.lemmatize(df, "tokens", lemmas)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    wanted = sorted(str((i, [{"cats": "cat", "dogs": "dog"}.get(t, t) for t in x or [] if t is not None])) for i, x in rows)
    assert sorted(str(tuple(r)) for r in found.collect()) == wanted
    monkeypatch.setattr(clean, "BROADCAST_ROWS", 0)
    assert sorted(str(tuple(r)) for r in clean.lemmatize(df, "tokens", lemmas).collect()) == wanted
