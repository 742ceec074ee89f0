"""The thin queries against plain Python, over the smallest tables and odd rows."""

import math
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from conftest import SMALL
from helpers import KINDS, ODD, classes, encoding, fingerprint, joined, measures, packed, sha, spans, words

from vocalis.llm import bpe, lm, quality, queries, secret_scan, shards, simhash, urls


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, KINDS)


def run(spark, name):
    return {r[0]: r for r in queries.QUERIES[name](spark, SMALL).collect()}


def test_secrets(spark, texts, odd):
    got = run(spark, "op1_markov_secrets")
    assert set(got) == set(texts)
    rows = [(r, texts[i]) for i, r in got.items()]
    chains = secret_scan.train(secret_scan.labelled_samples(odd))
    rows += [(r, t) for r, (_, t) in zip(secret_scan.secret_report(odd, chains).collect(), ODD, strict=True)]
    for r, text in rows:
        base = spans(text)
        assert r.base_sha256 == sha(joined(base))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert set(joined(base).split(",")) <= set(r.spans.split(",")) | {""}


def test_chains_tell_keys_from_names(spark):
    docs = queries.table(spark, SMALL, "documents")
    chains = secret_scan.train(secret_scan.labelled_samples(docs, strings=500))
    keys = ["wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY9", "ghp_x7Kq2LmZ9vRt4WsY8bNc3QdF6hJ1gTpA", "Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZg9Kx3"]
    names = ["user_account_settings_page_2", "the_quick_brown_fox_jumped_over_1", "information_retention_2019_standards", "another_ordinary-section-title-10"]
    rows = spark.createDataFrame([(i, f"see {x} here") for i, x in enumerate(keys + names)], KINDS)
    found = [r.n_markov for r in secret_scan.secret_report(rows, chains).orderBy("doc_id").collect()]
    assert found == [1] * len(keys) + [0] * len(names)


def test_masking_and_clashing_columns(spark, odd):
    chains = secret_scan.train(secret_scan.labelled_samples(odd, strings=50))
    extra = odd.selectExpr("*", "1 as base", "2 as spans", "3 as _found0")
    out = secret_scan.scan(extra, chains)
    masked = out.select("doc_id", secret_scan.mask("text", out["spans"]).alias("m")).collect()
    by = {r.doc_id: r.m for r in masked}
    assert by[1] is None and by[2] == "" and by[4] == "one"
    assert by[12] == "éé [secret]" and by[10].startswith("[secret]")


def test_fingerprints_and_components(spark, texts, odd):
    got = run(spark, "op2_simhash_components")
    prints = {i: fingerprint(t) for i, t in texts.items()}
    root = classes(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, f in prints.items():
        least[root[f]] = min(i, least.get(root[f], i))
    for i, f in prints.items():
        assert (got[i].fingerprint, got[i].component_id) == (f"{f:016x}", least[root[f]])
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_scores(spark, texts, odd):
    got = run(spark, "op3_bilinear_scores")
    tokens = {i: [*words(t), b""] for i, t in texts.items()}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total, floor = sum(count.values()), math.log10(sum(count.values()) + 0.5 * (len(count) + 1))
    gain = 0.0
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(ws), sum(count[w] > 0 for w in ws), total)
        base = sum(math.log10(count[w] + 0.5) - floor for w in ws)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0  # better than the counts on documents it has not seen
    rows = lm.score(odd).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) for r in rows)
    assert lm.score(odd.limit(0)).count() == 0


def test_model_is_normalised():
    import numpy as np

    table = lm.train_model(np.array([0, 4, 7]), np.array([3, 1, 9]), closed=3, steps=20)
    assert np.allclose((10**table).sum(1), 1)


def test_urls(spark):
    rows = [
        (1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.COM/en/x?y#z"), (4, "http://a.example.com/en/1"), (5, "http://example.com/fr"),
        (6, "http://x.www.example.com/en/"), (7, "http://b.net/es/1"), (8, "http://b.net/de/1"), (9, "x://net/fr/"), (10, "http://notexample.org/en/"),
        (11, "http://badnet/es/"), (12, "http://casino-win.example.org/en/1"), (12, "http://casino-win.example.org/en/1"), (13, "http://city-library.example.org/de/1"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    model = urls.train(urls.labelled_urls(pages))
    got = {r.page_id: r for r in urls.judge(pages, model).collect()}
    assert (got[1].host, got[1].path, got[1].rule) == ("", "", None)
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert [got[i].rule for i in (4, 5, 6, 7, 8, 9, 10, 11)] == [
        "example.com/en/", "com/", "www.example.com/en/", "net/es/", None, "net/fr/", None, None]
    assert (got[12].verdict, got[13].verdict) == ("block", "allow")
    assert len(urls.judge(pages, model).collect()) == len(rows)
    assert urls.judge(pages.limit(0), urls.train([])).count() == 0


def test_url_model_on_held_out_names():
    import random

    rows = [(f"{n}.{t}", "/en/1", b) for b, names in ((1, urls.BLOCKED_NAMES), (0, urls.ALLOWED_NAMES)) for n in names for t in ("com", "net", "org")]
    names = sorted({r[0].split(".")[0] for r in rows})
    random.Random(3).shuffle(names)
    test = set(names[: len(names) // 5])
    model = urls.train([r for r in rows if r[0].split(".")[0] not in test])
    held = [r for r in rows if r[0].split(".")[0] in test]
    z = urls.scores(model, [r[0].encode() for r in held], [r[1].encode() for r in held])
    assert sum((s > 0) == r[2] for s, r in zip(z, held, strict=True)) / len(held) >= 0.75


def test_quality(spark, texts, odd):
    got = run(spark, "op5_divergence_quality")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    rows = [(r, texts[i]) for i, r in got.items()]
    rows += [(r, t) for r, (_, t) in zip(quality.quality_report(odd.selectExpr("*", "null as lang"), quality.References({}, {})).collect(), ODD, strict=True)]
    for r, text in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measures(text)
        assert not (r.kept and r.base_failed)
    assert all(got[i].kept or got[i].base_failed for i in good)
    assert sum(not r.kept for r in got.values()) > sum(r.base_failed for r in got.values())


def test_tokens(spark, texts, odd):
    own = encoding()
    got = run(spark, "op6_bpe_tokens")
    rows = [(r, texts[i]) for i, r in got.items()]
    rows += [(r, t) for r, (_, t) in zip(bpe.token_digests(odd).collect(), ODD, strict=True)]
    for r, text in rows:
        ids = own.encode_ordinary(text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(packed(ids)), sha(text or ""))
    back = bpe.decoded(bpe.with_tokens(odd.selectExpr("*", "1 as ids", "2 as offsets"))).collect()
    for r, (_, t) in zip(back, ODD, strict=True):
        assert bytes(r.decoded).decode() == (t or "") and len(r.offsets) == len(r.ids) + 1 and r.offsets[-1] == len((t or "").encode())


def test_shards(spark, texts):
    got = run(spark, "op7_rendezvous_shards")
    for i, r in got.items():
        raw = (texts[i] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw)) and 0 <= r.shard < 24
        assert r.grown_shard in (r.shard, 24)
    by = {}
    for r in got.values():
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_shards_of_odd_rows(spark, odd):
    rows = odd.unionAll(odd).withColumnRenamed("doc_id", "k").selectExpr("*", "1 as size", "2 as shard").repartition(3)
    got = shards.shard_records(rows, key="k", weights=[1.0, 3.0]).collect()
    assert len(got) == 2 * len(ODD) and len({r.shard for r in got if r.k is None}) == 1
    for s in (0, 1):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    many = spark.range(4000).select(shards.shard_of(F.col("id"), [1.0, 3.0]).alias("s"))
    assert 0.7 < many.where("s = 1").count() / 4000 < 0.8
    assert shards.shard_records(odd.limit(0)).count() == 0
