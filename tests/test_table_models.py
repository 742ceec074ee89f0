"""Table classifiers against Spark's own, and the joins they stand on without broadcasts."""

import random

import pytest
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from vocalis.operators import table_models, terms


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows = random.Random(5), []
    for i in range(160):
        label, values = i % 2, {}
        for t in range(12):
            if rng.random() < (0.6 if t % 2 == label or t > 7 else 0.25):
                values[f"t{t:02d}"] = rng.random()
        norm = sum(v * v for v in values.values()) ** 0.5 or 1.0
        rows.append((i, label, {k: v / norm for k, v in values.items()}))
    rows.append((160, None, {"t00": 1.0}))  # no label
    rows.append((161, 1, {}))  # no term
    long = spark.createDataFrame([(i, k, v) for i, _, x in rows for k, v in x.items()], "id long, term string, tfidf double")
    docs = spark.createDataFrame([(i, y, "x") for i, y, _ in rows], "id long, label int, term string")
    dense = spark.createDataFrame([(i, float(y), Vectors.dense([x.get(f"t{t:02d}", 0.0) for t in range(12)])) for i, y, x in rows if y is not None], ["id", "label", "features"])
    return long, docs, dense


def test_gaussian_equals_the_dense_model(spark, corpus, tmp_path):
    long, docs, dense = corpus
    model = table_models.fit_gaussian(long, docs, "id", smoothing=1e-9)
    got = {r["id"]: r for r in table_models.score_gaussian(model, long, docs, "id").collect()}
    other = NaiveBayes(modelType="gaussian").fit(dense).transform(dense).select("id", "prediction", vector_to_array("probability").alias("p")).collect()
    assert len(got) == 162 and all(got[r["id"]]["prediction"] == r["prediction"] for r in other)
    assert all(got[r["id"]]["probabilities"] == pytest.approx(r["p"], abs=1e-6) for r in other)
    model.save(str(tmp_path / "nb"))
    again = table_models.GaussianTable.load(spark, str(tmp_path / "nb"))
    assert sorted(table_models.score_gaussian(again, long, docs, "id").collect()) == sorted(got.values())
    with pytest.raises(ValueError):
        table_models.fit_gaussian(long, docs.where("label is null"), "id")


def test_logistic_equals_the_dense_model(corpus):
    long, docs, dense = corpus
    weights = table_models.fit_logistic(long, docs, "id", reg=0.2, rounds=45, tol=1e-6)
    w = {r["term"]: r["weight"] for r in weights.collect()}
    other = LogisticRegression(regParam=0.2, standardization=False, tol=1e-10, maxIter=500).fit(dense)
    assert w.pop(table_models.INTERCEPT) == pytest.approx(other.intercept, abs=1e-4)
    assert [w[t] for t in sorted(w)] == pytest.approx(other.coefficients.toArray().tolist(), abs=1e-4)
    scored = table_models.score_logistic(weights, long, docs, "id").collect()
    p = {r["id"]: r["p"] for r in other.transform(dense).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    assert len(scored) == 162 and all(r["probability"] == pytest.approx(p[r["id"]], abs=1e-4) for r in scored if r["id"] in p)
    assert all(r["prediction"] == int(r["probability"] > 0.5) for r in scored)


def test_models_without_broadcasts(corpus, monkeypatch):
    long, docs, _ = corpus
    nb, lr = (f(long, docs, "id") for f in (table_models.fit_gaussian, lambda *a: table_models.fit_logistic(*a, reg=0.1, rounds=3)))
    near = sorted(map(str, table_models.score_gaussian(nb, long, docs, "id").select("id", "prediction").collect()))
    margin = {r["id"]: r["probability"] for r in table_models.score_logistic(lr, long, docs, "id").collect()}
    monkeypatch.setattr(terms, "BROADCAST_ROWS", 0)
    assert sorted(map(str, table_models.score_gaussian(nb, long, docs, "id").select("id", "prediction").collect())) == near
    far = table_models.fit_logistic(long, docs, "id", reg=0.1, rounds=3)
    got = table_models.score_logistic(far, long, docs, "id").collect()
    assert len(got) == 162 and all(r["probability"] == pytest.approx(margin[r["id"]], abs=1e-9) for r in got)


def test_split_join_is_even_and_whole(spark, monkeypatch):
    rng = random.Random(3)
    bags = spark.createDataFrame([(i, f"w{int(rng.paretovariate(0.7)) % 4000}") for i in range(30_000)], "id long, term string")
    weights = bags.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("term <> 'w3'").withColumn("w", F.length("term"))
    near = terms.join_weights(bags, weights)
    monkeypatch.setattr(terms, "BROADCAST_ROWS", 0)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        far = terms.join_weights(bags, weights)
        assert sorted(far.collect()) == sorted(near.select(*far.columns).collect())
        plan = far._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 2
        hot = terms.hot_terms(bags, 8)
        assert 0 < hot.count() < 32
        cold = bags.join(hot, "term", "left_anti").repartition(8, "term").groupBy(F.spark_partition_id()).count().collect()
        sizes = [r["count"] for r in cold]
        assert max(sizes) <= 2 * sum(sizes) / 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
