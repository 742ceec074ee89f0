"""References and limits come from every document labelled good, in every language."""

from pyspark.sql import functions as F

from vocalis.llm import quality


def test_every_good_document_counts(spark):
    ids = spark.range(4_100).select(F.col("id").alias("doc_id"))
    last = {r["doc_id"] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").collect()[4_000:]}
    plain, odd = " ".join(["alpha", "beta"] * 25), " ".join(["OMEGA", "9"] * 25)
    docs = spark.createDataFrame([(i, odd if i in last else plain, "en") for i in range(4_100)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    refs = quality.fit_references(docs, labels)
    assert refs.words["en"]["OMEGA"] == round(100 / 8_200, 6)
    got = quality.with_distances(quality.measure(docs), refs).agg(F.max("class_distance").alias("c"), F.max("word_distance").alias("w")).first()
    assert got["c"] <= refs.class_limit and got["w"] <= refs.word_limit


def test_every_language_has_a_reference(spark):
    names = [f"l{i:02d}" for i in range(40)]
    docs = spark.createDataFrame([(20 * i + j, " ".join([f"w{i}"] * 50), n) for i, n in enumerate(names) for j in range(20)], "doc_id long, text string, lang string")
    assert sorted(quality.fit_references(docs, docs.selectExpr("doc_id", "1 as quality", "0 as toxic")).words) == names


def test_words_are_split_once(spark):
    """A filter on the number of words does not split the text again; words end at six characters only."""
    from vocalis.llm import quality

    df = spark.createDataFrame([("a b\x0bc\x0cd\te\nf\rg\x1ch\x85i j k",), ("",), (None,)], "text string")
    rows = quality.measure(df, once=True)
    assert rows.where("n_words >= 1")._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 1
    assert rows.first()["_words"] == ["a", "b", "c", "d", "e", "f", "g\x1ch\x85i j k"]
    assert quality.measure(df).drop("_classes").collect() == rows.select(quality.measure(df).drop("_classes").columns).collect()
