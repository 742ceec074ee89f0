import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vocalis.operators import models, sampling, topicmodel


@pytest.fixture(scope="module")
def rows(spark):
    good, bad = ["great", "lovely", "#win"], ["awful", "poor", "sad"]
    data = [
        (i, i % 2, [(good if i % 2 else bad)[i % 3], f"w{i % 7}", "day"] + (["x1"] if i % 5 == 0 else []))
        for i in range(120)
    ]
    df = spark.createDataFrame(data, "id long, label int, tokens array<string>")
    return sampling.stratified_split(df, "label", ["id"]).cache()


def test_tfidf_vectors_match_the_formula(spark):
    df = spark.createDataFrame([(0, ["a1", "b1", "a1", "x"]), (1, ["b1"])], "id long, tokens array<string>")
    model = models.fit_tfidf(df)
    vocab = model.stages[0].vocabulary
    assert sorted(vocab) == ["a1", "b1"]
    got = models.add_tfidf(model, df).where("id = 0").select(vector_to_array("features")).first()[0]
    idf = {"a1": math.log(3 / 2) + 1, "b1": 1.0}
    raw = {"a1": 2 * idf["a1"], "b1": idf["b1"]}
    norm = math.hypot(*raw.values())
    assert dict(zip(vocab, got)) == pytest.approx({k: v / norm for k, v in raw.items()})


def test_baseline_run(rows, tmp_path):
    config = {"grid": {
        "LR": {"type": "LogisticRegression()", "grid": {"penalty": ["l1", "l2"], "C": [0.01, 10]}},
        "NB": {"type": "GaussianNB()", "grid": {}},
    }, "folds": 3}
    metrics, table, fitted = models.run_baseline(rows, config, ["id"])
    got = {(r["family"], r["split"]): r["accuracy"] for r in metrics.collect()}
    assert set(got) == {(f, s) for f in ("LR", "NB") for s in ("valid", "test")}
    assert got["LR", "test"] > 0.9 and got["NB", "test"] > 0.9
    scores = table.collect()
    assert len(scores) == 5 and {r["rank"] for r in scores if r["family"] == "LogisticRegression()"} == {1, 2, 3, 4}
    models.save_models(fitted, str(tmp_path / "m"))
    again, no_table, _ = models.run_baseline(rows, {**config, "run_type": "load", "model_obj_path": str(tmp_path / "m")}, ["id"])
    assert no_table is None and sorted(again.collect()) == sorted(metrics.collect())
    loaded = models.load_models(config, str(tmp_path / "m"))["LR"]
    featured = models.add_tfidf(fitted["tfidf"], rows)
    a = models.predict(fitted["LR"], featured, "id").orderBy("id").collect()
    assert a == models.predict(loaded, featured, "id").orderBy("id").collect()
    assert all(0 <= r["probability"] <= 1 and r["prediction"] == int(r["probability"] > 0.5) for r in a)


def test_prepare_training(spark):
    table = spark.createDataFrame(
        [(i, 4 if i % 2 else 0, "['a', 'b']" if i % 10 else "[]", "unused") for i in range(100)],
        "id long, sentiment int, tokens string, other string",
    )
    config = {"reqd_cols": ["sentiment", "tokens"], "label_col": "sentiment", "test_frac": 0.1, "val_frac": 0.2, "sample_rows": 80}
    out = models.prepare_training(table, config, ["id"])
    rows = out.collect()
    assert out.columns == ["id", "sentiment", "tokens", "label", "split"]
    assert len(rows) <= 80 and {r["label"] for r in rows} == {0, 1} and all(r["tokens"] == ["a", "b"] for r in rows)
    assert {r["split"] for r in rows} == {"train", "valid", "test"}


def test_penalty_scale():
    lr = models.estimator("LogisticRegression()", {"penalty": "l1", "C": 0.01}, 1000)
    assert (lr.getRegParam(), lr.getElasticNetParam()) == (0.1, 1.0)
    with pytest.raises(ValueError):
        models.estimator("eval me", {}, 1)


def test_mean_vectors_count_unknown_tokens_as_zero(spark):
    df = spark.createDataFrame([(1, ["a", "b", "?"]), (2, ["?"])], "id long, tokens array<string>")
    vectors = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 6.0])], "token string, vector array<float>")
    got = {r["id"]: r["mean"] for r in models.mean_vectors(df, vectors, ["id"], "tokens", 2).collect()}
    assert got == {1: [1.0, 2.0], 2: [0.0, 0.0]}


def test_sweep_beats_the_majority(spark):
    df = spark.range(200).select(
        (F.col("id") % 2).cast("int").alias("label"), F.array((F.col("id") % 2) * 2.0 - 1.0, F.rand(1)).alias("mean")
    )
    model, table = models.sweep(df, df, {"max_iter": [1, 20], "reg": [0.0, 0.1]})
    assert table.count() == 4 and table.agg(F.max("valid_accuracy")).first()[0] > 0.9
    scored = models.score_embeddings(model, df, "label")
    assert scored.columns == ["label", "prediction_raw", "prediction_class"] and scored.count() == 200


def test_topics(spark):
    a, b = ["tax", "budget", "money"], ["court", "judge", "law"]
    df = spark.createDataFrame([(i, (a if i % 2 else b) * 3) for i in range(60)], "id long, tokens array<string>")
    for tfidf in (False, True):
        vectors, words = topicmodel.term_vectors(df, "id", no_below=2, no_above=0.8, tfidf=tfidf)
        assert sorted(words) == sorted(a + b)
        model = topicmodel.fit_lda(vectors, k=2, passes=1)
        top = topicmodel.describe_topics(model, words, top=3)
        assert top.count() == 6
    vectors, words = topicmodel.term_vectors(df, "id", no_below=2, keep_n=4)
    assert len(words) == 4


def test_no_term_is_left_out(spark, monkeypatch):
    df = spark.createDataFrame([(0, ["a1", "b1", "c1"]), (1, ["b1"])], "id long, tokens array<string>")
    monkeypatch.setattr(models, "MAX_TERMS", 2)
    with pytest.raises(ValueError, match="3 terms"):
        models.fit_tfidf(df)
    assert models.fit_tfidf(df, min_df=0.9).stages[0].vocabulary == ["b1"]


def test_grid_searches_every_parameter(rows):
    featured = models.add_tfidf(models.fit_tfidf(rows), rows).select("id", "label", "features")
    scores = []
    for order in ([0, 50], [50, 0]):
        _, table = models.grid_search(featured, "LogisticRegression()", {"max_iter": order, "C": [10]}, ["id"], folds=3)
        scores.append({r["params"]: r["mean_score"] for r in table.collect()})
    assert scores[0] == scores[1] and len(set(scores[0].values())) == 2
    for grid in ({"solver": ["x"]}, {"penalty": ["none"]}):
        with pytest.raises(ValueError):
            models.grid_search(featured, "LogisticRegression()", grid, ["id"])


def test_weights_of_topic_vectors(spark):
    df = spark.createDataFrame([(0, ["a", "a", "b"]), (1, ["b", "c"]), (2, ["c", "b"]), (3, ["d"])], "id long, tokens array<string>")
    vectors, words = topicmodel.term_vectors(df, "id", no_below=1, tfidf=True)
    got = {r["id"]: dict(zip(words, r["v"])) for r in vectors.select("id", vector_to_array("features").alias("v")).collect()}
    raw = {"a": 2 * math.log2(4 / 1), "b": math.log2(4 / 3), "c": 0.0, "d": 0.0}
    norm = math.hypot(*raw.values())
    assert got[0] == pytest.approx({k: v / norm for k, v in raw.items()})
    model = topicmodel.fit_lda(vectors, k=2, passes=1)
    mixes = model.transform(vectors).select(F.aggregate(vector_to_array("topicDistribution"), F.lit(0.0), lambda a, x: a + x)).collect()
    assert len(mixes) == 4 and all(r[0] == pytest.approx(1) for r in mixes)


def test_mean_vectors_of_both_paths(spark, monkeypatch):
    """Sums row by row equal the join with every token, also of NULLs, repeated ids and rows without tokens."""
    rows = [(1, ["a", "b", "q"]), (1, ["b"]), (None, ["a", None]), (2, []), (3, None), (4, [None]), (None, ["c"] * 5)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3)
    vectors = spark.createDataFrame([("a", [0.1, 2.0]), ("b", [0.7, -1.0]), ("c", [0.3, 0.3]), (None, [9.0, 9.0])], "token string, vector array<float>")
    result = lambda v: sorted(map(str, models.mean_vectors(df, v, ["id"], "tokens", 2).select("id", F.transform("mean", lambda x: F.round(x, 12))).collect()))
    fast = result(vectors)
    assert len(fast) == 2 and "join" not in models.mean_vectors(df, vectors, ["id"], "tokens", 2)._jdf.queryExecution().executedPlan().toString().lower()
    odd = vectors.unionByName(spark.createDataFrame([("a", [1.0, None]), ("x", [1.0])], "token string, vector array<float>"))
    twice = result(odd)  # by the join: one row per match, missing numbers left out
    assert twice != fast and len(twice) == 2
    monkeypatch.setattr(models, "BROADCAST_ROWS", 0)
    assert result(vectors) == fast and result(odd) == twice


def test_fits_have_as_many_partitions_as_cores(rows, monkeypatch):
    seen = []
    fit = models.CrossValidator.fit
    monkeypatch.setattr(models.CrossValidator, "fit", lambda self, data: (seen.append(data.rdd.getNumPartitions()), fit(self, data))[1])
    train = models.add_tfidf(models.fit_tfidf(rows, "tokens"), rows, "tokens").repartition(40)
    models.grid_search(train, "LogisticRegression()", {"C": [1.0]}, ["id"], folds=2)
    assert 1 <= seen[0] <= rows.sparkSession.sparkContext.defaultParallelism
