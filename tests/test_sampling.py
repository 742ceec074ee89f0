import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vocalis.operators import hashorder, sampling


def digest(seed, *ids):
    return hashlib.md5(":".join(map(str, (seed, *ids))).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    # One stratum holds most rows, one has three, one is NULL.
    label = F.expr("case when id % 10 < 8 then 'hot' when id < 2500 then 'warm' when id % 2 = 0 then null else 'cool' end")
    return spark.range(3000).withColumn("label", label).cache()


def by_label(rows):
    out = defaultdict(list)
    for r in rows.collect():
        out[r["label"]].append(r["id"])
    return out


@pytest.mark.parametrize("n", [0, 5, 700, 1500, 100_000])
def test_sample_sizes_and_members(rows, n):
    got = by_label(sampling.sample_n_per_group(rows, n, ["label"], ["id"], seed=3))
    for label, ids in by_label(rows).items():
        assert sorted(got[label]) == sorted(sorted(ids, key=lambda i: digest(3, i))[:n])
    whole = [r["id"] for r in sampling.sample_n(rows, n, ["id"], seed=3).collect()]
    assert sorted(whole) == sorted(sorted(range(3000), key=lambda i: digest(3, i))[:n])


def test_stratified_split_is_exact(rows):
    out = sampling.stratified_split(rows, "label", ["id"])
    assert out.count() == 3000 and out.select("id").distinct().count() == 3000
    sizes = Counter((r["label"], r["split"]) for r in out.collect())
    for label, ids in by_label(rows).items():
        n = len(ids)
        test, upto = int(0.1 * n + 0.5), int(0.3 * n + 0.5)
        assert [sizes[label, p] for p in ("test", "valid", "train")] == [test, upto - test, n - upto]


def test_tiny_strata_go_to_the_last_part(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, label string")
    out = {r["id"]: r["split"] for r in sampling.stratified_split(df, "label", ["id"]).collect()}
    assert out[1] == "train" and sorted(out.values())[0] == "train"


def test_hash_rank_is_dense(rows):
    ranked = hashorder.hash_rank(rows, hashorder.order_key("s", "id"), "r", ["label"]).collect()
    for label, ids in by_label(rows).items():
        want = {i: k + 1 for k, i in enumerate(sorted(ids, key=lambda i: digest("s", i)))}
        assert {r["id"]: r["r"] for r in ranked if r["label"] == label} == want


def test_folds_are_even(rows):
    sizes = Counter((r["label"], r["fold"]) for r in sampling.stratified_folds(rows, "label", ["id"]).collect())
    for label in by_label(rows):
        per = [sizes[label, f] for f in range(5)]
        assert max(per) - min(per) <= 1


def test_lines_per_file(spark, tmp_path):
    for name, n in (("a", 3), ("b", 50)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{i % 7}\n" for i in range(n)))
    from vocalis.sources.tables import read_lines

    got = Counter(r["file"][-5] for r in sampling.sample_lines_per_file(read_lines(spark, str(tmp_path)), 20).collect())
    assert got == {"a": 3, "b": 20}


@pytest.mark.parametrize("n", [0, 1, 40, 41, 299, 300, 301, 999, 1000, 1001, 5000])
def test_repeated_and_null_ids_fill_the_sample(spark, n):
    """Ids repeat seven times, a third are NULL, some rows are alike in everything."""
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 > 0, F.floor(F.col("id") / 21)).alias("k"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("other"),
        (F.col("id") % 2).alias("g"))
    got = sampling.sample_n(rows, n, ["k"], seed=1)
    assert got.columns == rows.columns
    assert got.count() == min(n, 900) and got.exceptAll(rows).isEmpty()
    again = sampling.sample_n(rows.repartition(7), n, ["k"], seed=1)
    assert again.exceptAll(got).isEmpty() and again.count() == min(n, 900)
    each = sampling.sample_n_per_group(rows, n, ["g"], ["k"], seed=1)
    assert sorted(r["count"] for r in each.groupBy("g").count().collect()) == [min(n, 450)] * (2 if n else 0)


def test_keys_of_different_ids_differ(spark):
    rows = spark.createDataFrame([("a:b", "c"), ("a", "b:c"), ("a\\", "b:c"), (None, "x"), ("x", None), ("\\N", "x")], "a string, b string")
    assert rows.select(hashorder.order_key(1, "a", "b")).distinct().count() == 6


def test_lines_do_not_depend_on_partitions(spark):
    lines = spark.range(60).select((F.col("id") % 2).cast("string").alias("file"), (F.col("id") % 7).cast("string").alias("value"))
    picks = [sorted(tuple(r) for r in sampling.sample_lines_per_file(lines.repartition(k), 11, seed=2).collect()) for k in (1, 2, 5)]
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 22


@pytest.mark.parametrize("n", [0, 1, 7, 50, 2999, 3000, 5000])
def test_first_rows(spark, monkeypatch, n):
    rng = range(3000)
    values = [None if i % 500 == 0 else (i * 7919) % 3001 for i in rng]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "k long, id long").repartition(6)
    wanted = sorted(values, key=lambda v: (v is not None, v or 0))[:n]
    for accuracy in (10_000, 40):
        monkeypatch.setattr(sampling, "ACCURACY", accuracy)
        assert [r["k"] for r in sampling.first_n(df, n, "k").collect()] == wanted
    same = spark.range(500).select(F.lit(3).alias("k"))
    assert sampling.first_n(same, 20, "k").count() == 20 and sampling.first_n(same.where("k < 0"), 5, "k").count() == 0


def test_few_rows_reach_the_sort(spark):
    df = spark.range(200_000).select((F.col("id") * 48271 % 200_003).alias("k"))
    out = sampling.first_n(df, 10, "k")
    limit = out._jdf.queryExecution().optimizedPlan().toString()
    assert "<= " in limit and [r["k"] for r in out.collect()] == sorted(i * 48271 % 200_003 for i in range(200_000))[:10]
