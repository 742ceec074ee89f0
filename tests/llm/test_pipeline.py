"""The pipeline against brute force on a small table."""

import corpus_pipeline
import pytest
from conftest import SMALL
from helpers import KINDS, classes, encoding, fingerprint, measures, sha, spans
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SMALL}/documents.parquet")
    return own.selectExpr("*", "doc_id as kept", "text as spans", "lang as _k")


def test_stages(spark, docs):
    from vocalis.llm.common import stored

    have = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, have, SMALL), name)
        assert out.schema.simpleString() == have.schema.simpleString()
        before = {r.doc_id: r for r in have.collect()}
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and out.count() == len(after)
        gone = {i: before[i].text for i in set(before) - set(after)}
        if name == "quality_rules":
            assert all(not measures(r.text)[-1] for r in after.values())
        elif name == "near_duplicates":
            prints = {i: fingerprint(r.text) for i, r in before.items()}
            root, least = classes(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 4), {}
            for i, f in prints.items():
                least[root[f]] = min(i, least.get(root[f], i))
            assert gone and set(after) == set(least.values()) and all(after[i] == before[i] for i in after)
        elif name == "benchmark_passages":
            items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert gone and not any(t in r.text for t in items for r in after.values())
            assert all(any(t in x for t in items) for x in gone.values())
        else:
            assert not gone
            for i, r in after.items():
                assert not spans(r.text) and r.n_chars == len(r.text)
                if not spans(before[i].text):
                    assert r == before[i] or "[secret]" in r.text
        have = out
    own = encoding()
    rows = corpus_pipeline.STAGES[-1][1](spark, have, SMALL).collect()
    texts = {r.doc_id: r.text for r in have.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.ids) == own.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == sha(texts[r.doc_id])


def test_odd_tables(spark, docs):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "x " * 30, "en", "s", 60), (3, "y", "xx", "s", 1), (3, "y", "xx", "s", 1)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for have in (spark.createDataFrame(rows, kinds), spark.createDataFrame([], kinds)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, have, SMALL).collect()


@pytest.mark.parametrize("rows_in_a_broadcast", [200_000, 0])
def test_one_row_of_a_group(spark, monkeypatch, rows_in_a_broadcast):
    from vocalis import session
    from vocalis.llm import simhash

    monkeypatch.setattr(session, "BROADCAST_ROWS", rows_in_a_broadcast)
    monkeypatch.setattr(session.broadcast_if_small, "__defaults__", (rows_in_a_broadcast,))
    long = " ".join(f"w{i}" for i in range(300))
    rows = [
        (5, long), (4, long + " end"), (9, long.upper()), (None, long), (None, None), (None, ""), (7, " \n"), (8, "other words here now"),
        (8, "other words here now"), (8, "and quite another text under that id"), (None, "a text without any id"), (None, "a text without any id"),
    ]
    extra = spark.createDataFrame(rows, KINDS).selectExpr("*", "1 as _k", "2 as _same", "3 as fp", "4 as root").repartition(3)
    got = simhash.one_of_each_group(extra)
    assert got.columns == extra.columns
    prints = [fingerprint(t) for _, t in rows]
    root = classes(set(prints), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), f in zip(rows, prints, strict=True):
        place = (i is None, i or 0)
        least[root[f]] = min(place, least.get(root[f], place))
    found = {}
    for r in got.collect():
        found.setdefault(root[fingerprint(r.text)], []).append((r.doc_id is None, r.doc_id or 0))
    assert found == {k: [v] for k, v in least.items()}
    assert simhash.one_of_each_group(extra.limit(0)).count() == 0


def test_many_groups_move_few_rows(spark, monkeypatch):
    """With more groups than a broadcast holds, rows that surely stay are told by a map of bits."""
    from vocalis.llm import simhash

    texts = [f"w{i} x{i * 7} y{i * 13} z{i % 5} v{i * 31}" for i in range(300)] + [f"w{i} x{i * 7} y{i * 13} z{i % 5} v{i * 31}" for i in range(40)] + [None, "", None]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    near = sorted(map(str, simhash.one_of_each_group(df).collect()))
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    assert sorted(map(str, simhash.one_of_each_group(df).collect())) == near
    keys = df.select(F.xxhash64("doc_id", "text").alias("_k"), "doc_id")
    special = keys.where("doc_id % 9 = 0").select("_k")
    clear, rest = simhash._split_off(keys, special)
    known = {r["_k"] for r in special.collect()}
    assert clear.count() > 200 and clear.count() + rest.count() == df.count()
    assert not known & {r["_k"] for r in clear.collect()} and known <= {r["_k"] for r in rest.collect()}
