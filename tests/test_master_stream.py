"""A master table grown chunk by chunk against one run."""

import pytest
from pyspark.sql import functions as F

from vocalis.operators import tagging
from vocalis.operators.clean import clean_documents
from vocalis.streaming import master_stream

KINDS = "id long, text string, branch string, leadership boolean, democrat boolean"


@pytest.fixture(scope="module")
def posts(spark):
    rows = [(i % 40, ["aa bb", "aa bb cc", "zz", "cc dd ee", None][i % 5], ["house", "democrat"][i % 2], None, [True, None][i % 2]) for i in range(90)]
    return spark.createDataFrame(rows, KINDS)


def chain(spark):
    lexicon = spark.createDataFrame([("aa_bb", "health"), ("cc_dd", "tax"), ("dd_ee", "tax")], "bigram string, topic string")
    return lambda df: clean_documents(df.drop("leadership"), lexicon, ["health", "tax"], source="branch", leadership_sources=["house"])


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("literal_rows, broadcast_rows", [(10_000, 200_000), (0, 0)])
def test_chunks_give_the_master_of_one_run(spark, posts, tmp_path, monkeypatch, literal_rows, broadcast_rows):
    monkeypatch.setattr(tagging, "LITERAL_ROWS", literal_rows)  # 0: the lexicon is joined, as one of any size is
    monkeypatch.setattr(master_stream, "BROADCAST_ROWS", broadcast_rows)
    build = chain(spark)
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i, part in enumerate((F.col("id") < 12, F.col("id") < 30, F.col("id") >= 25)):  # rows come twice
        posts.where(part).coalesce(2).write.mode("append").parquet(source)
        master_stream.grow_master(spark, source, posts.schema, build, target, state, files_per_chunk=1 if i else 1000)
    got = master_stream.read_master(spark, target)
    assert rows_of(got) == rows_of(build(posts).distinct())
    master_stream.grow_master(spark, source, posts.schema, build, target, state)
    assert got.count() == master_stream.read_master(spark, target).count()


def test_a_chunk_that_runs_again(spark, posts, tmp_path):
    target = str(tmp_path / "m")
    first, second = posts.where("id < 20"), posts.where("id >= 10")
    master_stream.add_chunk(first, target, 0)
    master_stream.add_chunk(second, target, 1)
    whole = rows_of(posts.distinct())
    assert rows_of(master_stream.read_master(spark, target)) == whole
    for chunk, rows in ((1, second.repartition(3)), (0, first)):
        master_stream.add_chunk(rows, target, chunk)
        assert rows_of(master_stream.read_master(spark, target)) == whole


def test_keys(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "b", None), (None, "b", "a"), (1, None, "a")], "x int, y string, z string")
    assert df.select(master_stream.row_key(df)).distinct().count() == 3
    turned = df.select("z", "x", "y")
    assert sorted(r[0] for r in df.select(master_stream.row_key(df)).collect()) == sorted(r[0] for r in turned.select(master_stream.row_key(turned)).collect())
    assert master_stream.new_rows(df.limit(0), None).count() == 0
