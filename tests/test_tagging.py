import pytest
from pyspark.sql import functions as F

from vocalis.operators import tagging
from vocalis.operators.clean import clean_documents

LEXICON = [("a_b", "health", 1), ("c_d", "x", 2), ("a_b", "taxes", 3), ("e_f", "guns", 4), ("g_h", "guns", 5), ("a_b", "x", 6)]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "bigram string, topic string, ord long")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, ["a_b", "e_f", "a_b"]), (2, ["c_d"]), (3, []), (4, ["g_h", "e_f"])]
    return spark.createDataFrame(rows, "id long, grams array<string>")


@pytest.mark.parametrize("literal_rows", [0, 10_000])
def test_both_ways_of_tagging(docs, lexicon, monkeypatch, literal_rows):
    monkeypatch.setattr(tagging, "LITERAL_ROWS", literal_rows)
    got = {r["id"]: r["topics"] for r in tagging.tag_topics(docs, "grams", lexicon).collect()}
    # The last tagged row of a bigram wins; an ignored row never does.
    assert got == {1: ["guns", "taxes"], 2: [], 3: [], 4: ["guns"]}
    assert sorted(r["id"] for r in tagging.filter_tagged(docs, "grams", lexicon).collect()) == [1, 4]
    assert tagging.filter_tagged(docs, "grams", lexicon, labelled=True).count() == 4


def test_flags_round_trip(docs, lexicon):
    tagged = tagging.tag_topics(docs, "grams", lexicon)
    flags = tagging.binarize_topics(tagged, ["taxes", "guns", "rural"])
    assert flags.columns[-3:] == ["guns", "rural", "taxes"]
    same = flags.where(tagging.topic_array(["taxes", "guns", "rural"]) != F.col("topics"))
    assert same.count() == 0


def test_clean_documents(spark, lexicon):
    posts = spark.createDataFrame(
        [(1, "the A b. #xy", "senate"), (2, "aa bb", "senate"), (3, "!!", "house"), (4, "ee ff gg", "base")],
        "id long, text string, source string",
    )
    words = spark.createDataFrame([("aa_bb", "health"), ("ee_ff", "guns")], "bigram string, topic string")
    out = clean_documents(posts, words, ["guns", "health"], source="source", leadership_sources=["senate", "house"])
    assert sorted((r["id"], r["leadership"], r["guns"], r["health"]) for r in out.collect()) == [
        (2, True, False, True), (4, False, True, False),
    ]
    labelled = posts.withColumn("label", F.when(F.col("id") == 1, 4).otherwise(0))
    kept = clean_documents(labelled, words, ["guns", "health"], labelled=True)
    assert {r["id"]: r["label"] for r in kept.collect()} == {1: 1, 2: 0, 4: 0}


@pytest.mark.parametrize("order", [True, False])
def test_one_result_at_every_size(spark, monkeypatch, order):
    """Repeated and NULL ids, NULL grams, NULL and doubled lexicon keys: both paths row by row."""
    lexicon = spark.createDataFrame(
        [("taxes", "health", 2), ("taxes", "taxes", 1), ("guns", "x", 3), (None, "guns", 4), ("law", None, 5), ("law", "guns", 6)],
        "bigram string, topic string, ord long")
    lexicon = lexicon if order else lexicon.drop("ord")
    rows = [(1, ["taxes"], "a"), (1, ["law"], "b"), (None, ["taxes", "law"], "c"), (None, None, "d"), (2, [], "e"), (2, [None, "guns"], "f"), (1, ["taxes"], "a")]
    docs = spark.createDataFrame(rows, "id long, grams array<string>, other string")
    got = []
    for size in (0, 10_000):
        monkeypatch.setattr(tagging, "LITERAL_ROWS", size)
        tagged, hit = tagging.tag_topics(docs, "grams", lexicon), tagging.has_lexicon_bigram(docs, "grams", lexicon, "hit")
        assert tagged.columns == [*docs.columns, "topics"] and hit.columns == [*docs.columns, "hit"]
        got.append((sorted((r["other"], r["topics"]) for r in tagged.collect()), sorted((r["other"], r["hit"]) for r in hit.collect())))
    first = "health" if order else "taxes"
    assert got[0] == got[1]
    assert got[0][0] == [("a", [first]), ("a", [first]), ("b", ["guns"]), ("c", sorted(["guns", first])), ("d", []), ("e", []), ("f", [])]
    assert [h for _, h in got[0][1]] == [True, True, True, True, False, False, False]


def test_ranks_by_buckets(spark, monkeypatch):
    """The ranks are those of a full count, and bigrams of buckets too small for a rank are not counted."""
    rows = [(["the_cat", "the_cat", *[f"w{i}_{j}" for j in range(i % 7)], f"rare_{i}"],) for i in range(600)] + [(None,), ([],), ([None, "the_cat"],)]
    df = spark.createDataFrame(rows, "g array<string>").repartition(3)
    want = {}
    for (g,) in rows:
        for b in {x for x in g or () if x is not None}:
            want[b] = want.get(b, 0) + 1
    ranked = sorted(want.items(), key=lambda x: (-x[1], x[0]))
    for buckets, upto in ((1 << 20, 1), (1 << 20, 40), (7, 5), (1 << 20, 5_000)):
        monkeypatch.setattr(tagging, "GRAM_BUCKETS", buckets)
        got = [(r["bigram"], r["df"]) for r in tagging.bigram_ranks(df, "g", upto).orderBy("rank").collect()]
        assert got == ranked[:upto]
    monkeypatch.setattr(tagging, "GRAM_BUCKETS", 1 << 20)
    plan = tagging.bigram_ranks(df, "g", 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "_bucket" in plan
