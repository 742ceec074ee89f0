import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalis.functions import rows as R
from vocalis.operators import assemble, report, terms


def test_groups_are_three_valued(spark):
    df = spark.createDataFrame(
        [(d, l) for d in (True, False, None) for l in (True, False, None)], "democrat boolean, leadership boolean"
    )
    got = {(r[0], r[1]): r[2] for r in df.select("*", R.group_label(F.col("democrat"), F.col("leadership"))).collect()}
    assert got[True, True] == "dem-lead" and got[False, False] == "rep-base"
    assert {got[k] for k in got if None in k} == {""}


def test_half_goes_to_class_zero(spark):
    p = spark.createDataFrame([(0.5,), (0.500001,)], "p double").select(R.threshold(F.col("p"))).collect()
    assert [r[0] for r in p] == [0, 1]


def test_null_groups_are_left_out(spark):
    df = spark.createDataFrame([(True, True, 1.0), (True, True, 2.0), (None, True, 9.0), (False, True, 3.0)],
                               "democrat boolean, leadership boolean, s double")
    got = {r["democrat"]: (r["s_mean"], r["s_std"], r["s_count"]) for r in report.sentiment_by_group(df, ["s"]).collect()}
    assert got[False] == (3.0, None, 1) and got[True][0] == 1.5 and None not in got


def test_empty_cells_and_pivot(spark):
    df = spark.createDataFrame(
        [(["t1"], "dem-lead", 1, 0.9), (["t1", "t2"], "dem-lead", 0, 0.2), (["t1"], "", 1, 0.7)],
        "topics array<string>, group string, prediction_class int, prediction_raw double",
    )
    stats = report.topic_group_stats(df, ["t1", "t2", "t3"])
    cells = {(r["Topic"], r["Group"]): (r["Mean_Class"], r["Std"]) for r in stats.collect()}
    assert len(cells) == 12 and cells["t1", "dem-lead"][0] == 0.5 and cells["t3", "rep-base"] == (None, None)
    assert cells["t2", "dem-lead"] == (0.0, None)
    wide = {r["Topic"]: r.asDict() for r in report.pivot_topic_group(stats).collect()}
    for (topic, group), (mean, std) in cells.items():
        assert wide[topic][f"Mean_Class_{group}"] == mean and wide[topic][f"Std_{group}"] == std


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    assert report.binary_metrics(df).first().asDict() == {"n": 2, "accuracy": 1.0, "precision": 0.0, "recall": 0.0}


def test_interval_equals_a_row_bootstrap(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(0.2, 0.4, 400), 2)
    df = spark.createDataFrame([("v", "g", float(x)) for x in values], "variable string, group string, value double")
    got = report.mean_with_ci(df, rounds=2000).first()
    means = [rng.choice(values, 400).mean() for _ in range(2000)]
    assert got["mean"] == pytest.approx(values.mean())
    assert got["low"] == pytest.approx(np.percentile(means, 2.5), abs=0.006)
    assert got["high"] == pytest.approx(np.percentile(means, 97.5), abs=0.006)
    again = report.mean_with_ci(df.repartition(3), rounds=2000).first()
    assert again["low"] == pytest.approx(got["low"])


def test_weights_are_poisson():
    for mean in (1, 2, 9, 400, 2_000_000):
        low, upto = report.poisson_table(mean)
        assert upto[-1] == pytest.approx(1) and (np.diff(upto) >= 0).all()
        if mean < 10:
            assert low == 0 and upto[:3] == pytest.approx([np.exp(-mean), np.exp(-mean) * (1 + mean), np.exp(-mean) * (1 + mean + mean**2 / 2)])
        w = low + np.searchsorted(upto[:-1], report.uniforms(np.arange(40) * 977 - 5, 1000), side="right")
        assert w.mean() == pytest.approx(mean, rel=0.02) and w.var() == pytest.approx(mean, rel=0.05)
    u = report.uniforms(np.array([7, -7]), 50_000)
    assert 0 <= u.min() and u.max() < 1 and abs(np.corrcoef(u)[0, 1]) < 0.02
    assert (report.uniforms(np.array([3, 7]), 10)[1] == u[0, :10]).all()


def test_intervals_do_not_depend_on_blocks(spark, monkeypatch):
    df = spark.range(300).select(F.lit("v").alias("variable"), (F.col("id") % 2).cast("string").alias("group"), (F.col("id") % 37 / 37.0).alias("value"))
    whole = sorted(report.mean_with_ci(df, rounds=200).collect())
    monkeypatch.setattr(report, "VALUES_AT_ONCE", 5)
    small = sorted(report.mean_with_ci(df.repartition(5), rounds=200).collect())
    assert [tuple(r)[:2] for r in whole] == [tuple(r)[:2] for r in small]
    assert [x for r in whole for x in r[2:]] == pytest.approx([x for r in small for x in r[2:]])


def test_union_drops_whole_copies_only(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id long, t string")
    b = a.select("t", "id")
    once = assemble.union_distinct([a, b])
    assert once.count() == 2 and assemble.union_distinct([once, once]).count() == 2
    assert assemble.union_all([a, b]).count() == 6


def test_accounts_multiply_and_drop(spark):
    posts = spark.createDataFrame([(1, "u"), (2, "v"), (3, None)], "id long, user_id string")
    acc = spark.createDataFrame([("u", "D"), ("u", "O"), (None, "R")], "user_id string, party_affiliation string")
    out = assemble.join_accounts(posts, acc)
    assert sorted(((r["id"], r["democrat"]) for r in out.collect()), key=str) == [(1, None), (1, True)]


def test_hydrate(spark):
    archive = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", None)], "id long, text string, re long")
    ids = spark.createDataFrame([(1,), (1,), (2,), (9,)], "id long")
    assert [r["id"] for r in assemble.hydrate_ids(archive, ids, "id", ["id", "text"], "re").collect()] == [1]


def test_terms_against_python(spark):
    docs = [["a", "b", "a"], ["b"], [], ["c", "b"]]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, tokens array<string>")
    assert {r["term"]: r["df"] for r in terms.doc_frequency(df).collect()} == {"a": 1, "b": 3, "c": 1}
    ids = sorted(r["term_id"] for r in terms.dictionary(df).collect())
    assert ids == [0, 1, 2]
    kept = terms.filter_extremes(terms.doc_frequency(df), terms.n_rows(df), 1, 0.5, 10)
    assert [r["term"] for r in kept.collect()] == ["a", "c"]
    for f in (terms.tfidf_smooth, terms.tfidf_log2):
        norms = {}
        for r in f(df, "id").collect():
            norms[r["id"]] = norms.get(r["id"], 0) + r["tfidf"] ** 2
        assert all(n == pytest.approx(1) for n in norms.values())


def test_tasks_of_bounded_tokens(spark, monkeypatch):
    """Counting goes over more partitions as the tokens grow, with the same weights; ids may repeat."""
    rows = [(i % 40 if i % 7 else None, [f"w{(i * k) % 13}" for k in range(i % 9)] + [None]) for i in range(300)] + [(5, None)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    result = lambda: sorted(map(str, terms.tfidf_log2(df, "id").withColumn("tfidf", F.round("tfidf", 9)).collect()))
    plain = result()
    monkeypatch.setattr(terms, "TASK_TOKENS", 20)
    assert terms.placed_by(df, "id", "tokens").rdd.getNumPartitions() == -(-sum(len(t or []) for _, t in rows) // 20)
    assert result() == plain
    monkeypatch.setattr(terms, "BROADCAST_ROWS", 4)
    assert result() == plain  # some weights by broadcast, some by a join
