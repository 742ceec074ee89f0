import datetime

import pytest
from pyspark.sql import functions as F

from vocalis.sources import tables

HEADER = "tweet_id,tweet_date,tweet_text,user_id,retweet_count,favorite_count\n"


def test_typed_csv(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text(HEADER + '1,2018-01-02,"say ""hi"",\nbye",u1,3,\n2,,,u2,,4\n')
    rows = tables.read_csv(spark, str(path), tables.schema_of(tables.POSTS), multi_line=True, rules=tables.POSTS).orderBy("tweet_id").collect()
    assert rows[0]["tweet_text"] == 'say "hi",\nbye' and rows[0]["tweet_date"] == datetime.date(2018, 1, 2)
    assert (rows[1]["tweet_text"], rows[1]["retweet_count"], rows[1]["favorite_count"]) == (None, None, 4)


@pytest.mark.parametrize("bad", ["1,not-a-date,t,u,1,2\n", "1,2018-01-01,t,u,many,2\n"])
def test_bad_row_fails_the_file(spark, tmp_path, bad):
    path = tmp_path / "posts.csv"
    path.write_text(HEADER + "1,2018-01-01,t,u,1,2\n" + bad)
    with pytest.raises(Exception):
        tables.read_csv(spark, str(path), tables.schema_of(tables.POSTS)).collect()


def test_accounts_with_carriage_returns(spark, tmp_path):
    path = tmp_path / "accounts.csv"
    path.write_bytes(b"token,user_id,link,party_affiliation\r\na,1,l,D\r\nb,2,l,\r\nc,3,l,O")
    got = {r["user_id"]: r["party_affiliation"] for r in tables.read_accounts(spark, str(path)).collect()}
    assert got == {"1": "D", "2": None, "3": "O"}


def test_lexicon_order(spark, tmp_path):
    path = tmp_path / "lexicon.csv"
    path.write_text("Bigram,Topic\na_b,health\nc_d,x\na_b,taxes\n")
    from vocalis.operators.tagging import topic_map

    assert [tuple(r) for r in topic_map(tables.read_lexicon(spark, str(path))).collect()] == [("a_b", "taxes")]


def test_id_list(spark, tmp_path):
    (tmp_path / "ids.txt").write_bytes(b"12\r\n\n34\n56")
    assert sorted(r["id"] for r in tables.read_id_list(spark, str(tmp_path)).collect()) == ["12", "34", "56"]


def test_replace_table_reading_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    first = tables.replace_table(spark.range(10), "t", path)
    again = tables.replace_table(first.where("id > 6"), "t", path)
    assert sorted(r["id"] for r in again.collect()) == [7, 8, 9]


def test_csv_sink_keeps_empty_and_null(spark, tmp_path):
    df = spark.createDataFrame([(1, "", ["a", 'b"c']), (2, None, [])], "i int, s string, t array<string>")
    back = spark.read.csv(tables.write_csv(df, str(tmp_path / "c")), header=True, escape='"', schema="i int, s string, t string")
    rows = {r["i"]: r["t"] for r in back.collect()}
    assert rows == {1: '["a","b\\"c"]', 2: "[]"}


def test_constraints(spark):
    df = spark.createDataFrame([("1", "abcdef"), (None, "ab"), ("333", None)], "tweet_id string, user_id string")
    rules = [("tweet_id", None, 2, True), ("user_id", None, 4, True)]
    got = {(r["column"], r["rule"]): r["violations"] for r in tables.check_constraints(df, rules).collect()}
    assert got == {
        ("tweet_id", "not_null"): 1, ("user_id", "not_null"): 1,
        ("tweet_id", "max_length_2"): 1, ("user_id", "max_length_4"): 1,
    }
    empty = tables.check_constraints(df.where(F.lit(False)), rules)
    assert {r["violations"] for r in empty.collect()} == {0}


def test_few_files_are_dealt_out(spark, small):
    assert tables.read_parquet(spark, f"{small}/documents.parquet").rdd.getNumPartitions() == 4


@pytest.mark.parametrize("bad", [",2018-01-01,t,u,1,2\n", "2,2018-01-01,t," + "u" * 40 + ",1,2\n", "2,2018-01-01,t,u,xx,2\n", "123456789012345678901,,t,u,1,2\n"])
def test_load_fails_whatever_is_read(spark, tmp_path, bad):
    path = tmp_path / "posts.csv"
    path.write_text(HEADER + "1,2018-01-01,t,u,1,2\n" + bad)
    rows = tables.read_csv(spark, str(path), tables.schema_of(tables.POSTS), rules=tables.POSTS)
    for read in (rows, rows.select("tweet_id", "user_id"), rows.select("favorite_count"), rows.groupBy().count()):
        with pytest.raises(Exception):
            read.collect()


def test_replace_a_table_from_itself(spark, tmp_path):
    spark.range(3).write.mode("overwrite").saveAsTable("own_rows")
    try:
        out = tables.replace_table(spark.table("own_rows").where("id > 0"), "own_rows")
        assert sorted(r["id"] for r in out.collect()) == [1, 2]
    finally:
        spark.sql("DROP TABLE IF EXISTS own_rows")
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    assert tables.replace_table(spark.read.parquet(path).where("id > 1"), "t", path).count() == 1


def test_lexicon_order_over_parts_of_a_file(spark, tmp_path):
    path = tmp_path / "lexicon.csv"
    path.write_text("Bigram,Topic\n" + "".join(f"a_b,t{i}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = tables.read_lexicon(spark, str(path))
        assert rows.rdd.getNumPartitions() > 2
        assert [r["topic"] for r in rows.orderBy("ord").collect()] == [f"t{i}" for i in range(4000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
