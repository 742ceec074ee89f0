import ast

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vocalis.functions import text as T
from vocalis.functions.words import STOP_WORDS
from vocalis.operators.clean import clean_tokens, lemmatize

CHAIN = [
    ("Don’t cut health-care! https://t.co/AbC #VoteBlue @some_one", "dont cut healthcare #voteblue @someone"),
    ("HTTP://x.y http", "httpxy http"),
    ("xhttpfoo bar", "bar"),
    ("mail me a.b@c.org", "mail ab @corg"),
    ("#only #tags", "#only #tags"),
    ("", ""),
    (None, ""),
    ("a", ""),
    ("right to vote", "right vote"),
    ("“great” news😀now covid19", "great news covid 19"),
    ("call 555 1234 ok", "call 555 1234 ok"),
    ("#####tag éééééé eeeeee", "###tag ééé eeeeee"),
]


def test_chain(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CHAIN)], "id long, text string")
    got = {r["id"]: " ".join(r["tokens"]) for r in clean_tokens(df).collect()}
    assert [got[i] for i in range(len(CHAIN))] == [want for _, want in CHAIN]


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text, want", [
    ("hi @bob and @al_2, bye", "hi   and  , bye"),
    ("mail a.b@c.org now", "mail a.b@c.org now"),
    ("@a@b", "@a@b"),
    ("@" + "x" * 25, " " + "x" * 5),
])
def test_handles(spark, text, want):
    assert one(spark, text, T.strip_handles) == want


def test_emoticons_keep_case(spark):
    assert one(spark, "SO 8D big", lambda c: T.join_tokens(T.tokenize(c))) == "so 8D big"


def test_hashtag_modes(spark):
    df = spark.createDataFrame([(["#dogday", "#x", "#", "y"],)], "t array<string>")
    row = df.select(
        T.strip_hashtags(F.col("t"), "all").alias("a"),
        T.strip_hashtags(F.col("t"), "select", ["#DogDay", "#lakes"]).alias("s"),
        T.strip_hashtags(F.col("t"), None).alias("n"),
    ).first()
    assert (row["a"], row["s"], len(row["n"])) == (["y"], ["#x", "#", "y"], 4)
    with pytest.raises(ValueError):
        T.strip_hashtags(F.col("t"), "some")


def test_stop_words():
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 179


def test_repeated_tokens_survive_stop_words(spark):
    df = spark.createDataFrame([(["up", "vote", "amp", "vote", "x"],)], "t array<string>")
    assert df.select(T.remove_stopwords(F.col("t"))).first()[0] == ["vote", "vote"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("ab'\"\\ ,#é", max_size=6), max_size=5), min_size=1, max_size=20))
def test_bigrams_and_printed_lists(spark, docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i long, t array<string>")
    rows = df.select("i", "t", T.bigrams(F.col("t")).alias("b"), T.print_token_list(F.col("t")).alias("p"))
    for r in T.with_once(rows, back=T.parse_token_list(F.col("p"))).collect():
        assert r["b"] == ["_".join(p) for p in zip(r["t"], r["t"][1:])]
        assert ast.literal_eval(r["p"]) == r["t"] == r["back"]


def test_marked_bigrams(spark):
    df = spark.createDataFrame([(["#a_b", "a_#b", "@a_b", "a_@b", "a_b", "a#_b"],)], "t array<string>")
    assert df.select(T.filter_marked_bigrams(F.col("t"))).first()[0] == ["a_b", "a#_b"]


def test_lemmas(spark):
    docs = spark.createDataFrame(
        [(1, "x", ["cats", "running", "cats", "it"]), (2, None, []), (3, "z", ["running"])],
        "id long, other string, tokens array<string>",
    )
    lemmas = spark.createDataFrame(
        [("cats", "n", "cat"), ("running", "v", "run"), ("running", "n", "running-noun")], "token string, pos string, lemma string"
    )
    tags = spark.createDataFrame([("running", "v")], "token string, pos string")
    out = {r["id"]: (r["other"], r["tokens"]) for r in lemmatize(docs, "tokens", lemmas, tags).collect()}
    assert out == {1: ("x", ["cat", "run", "cat", "it"]), 2: (None, []), 3: ("z", ["run"])}
    untagged = lemmatize(docs, "tokens", lemmas).where("id = 3").first()
    assert untagged["tokens"] == ["running-noun"]


@pytest.mark.parametrize("rows", [0, 200_000])
def test_lemmas_row_by_row(spark, monkeypatch, rows):
    from vocalis import session
    from vocalis.operators import clean

    monkeypatch.setattr(clean, "broadcast_if_small", lambda df: session.broadcast_if_small(df, rows))
    docs = spark.createDataFrame(
        [(1, "x", ["cats", "a"]), (1, "y", ["dogs", "b"]), (None, "n", ["cats"]), (None, "m", None), (2, "e", []), (1, "x", ["cats", "a"])],
        "id long, other string, tokens array<string>")
    lemmas = spark.createDataFrame([("cats", "n", "cat"), ("dogs", "n", "dog"), ("dogs", "v", "chase"), (None, "n", "z")], "token string, pos string, lemma string")
    tags = spark.createDataFrame([("dogs", "v"), ("dogs", "w")], "token string, pos string")
    got = clean.lemmatize(docs, "tokens", lemmas, tags)
    assert got.columns == docs.columns
    assert sorted((r["other"], r["tokens"]) for r in got.collect()) == [
        ("e", []), ("m", []), ("n", ["cat"]), ("x", ["cat", "a"]), ("x", ["cat", "a"]), ("y", ["chase", "b"])]


ODD = ["aa 😀😀😀😀😀 b", "call 1 555 123 4567 or 5551234", "8D d8 xD 8op P8", "##ab #a ##", "@@you @x_1 @", "héé٣٣٣٣ covid19 a1 ab1 abc1", "Ⅷ½½½ _a__ --", "x y z", "ééé!!!!! \t\t\t\t\t\tq", "𝔸𝔹𝔻 𝟘𝟙𝟚", "漢字漢字 １２３ １２３４"]


def test_fast_patterns_find_the_same(spark):
    """Java's own pattern equals the common one, and runs are cut as by the plain class; raw and cleaned
    tokens come from one pass."""
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    slow, fast = (F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (T.TOKEN, T.JAVA_TOKEN))
    cut = lambda p: F.regexp_replace("t", p, "$1$1$1")
    for r in df.select("t", slow.alias("a"), fast.alias("b"), cut(r"([^a-zA-Z0-9])\1{3,}").alias("c"), cut(T.LONG_RUN).alias("d")).collect():
        assert r["a"] == r["b"] and r["c"] == r["d"], r["t"]


def test_one_pass_makes_words_and_tokens(spark, small):
    from vocalis.plans import views as V

    for frame in (V.tags(spark, small), V.lemmas(spark, small), V.words(spark, small)):
        frame.count()
    assert {"raw", "tokens"} <= set(V.both_tokens(spark, small).columns) and "raw" not in V.tokens(spark, small).columns
    raw = {r["post_id"]: r["tokens"] for r in V.raw_tokens(spark, small).collect()}
    assert all(raw[r["post_id"]] == r["raw"] for r in V.both_tokens(spark, small).collect())
