"""Online topic discovery against its formulas."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalis.operators import online_lda as lda


@pytest.fixture(scope="module")
def texts(spark):
    rng, themes = random.Random(2), [["tax", "budget", "money", "bank"], ["court", "judge", "law", "trial"], ["ball", "goal", "team", "match"]]
    rows = [(i, [rng.choice(themes[i % 3]) if rng.random() < 0.9 else "also" for _ in range(rng.randint(5, 30))]) for i in range(240)]
    rows += [(240, []), (241, None), (242, ["unseen"])]
    return spark.createDataFrame(rows, "id long, tokens array<string>").repartition(4)


def test_special_functions():
    x = np.array([0.01, 0.3, 1.0, 2.5, 7.0, 400.0])
    h = 1e-5 * x
    slope = (lda.lgamma(x + h) - lda.lgamma(x - h)) / (2 * h)
    assert lda.digamma(x) == pytest.approx(slope, rel=1e-6, abs=1e-6) and lda.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649)


def test_every_document_once_per_pass(texts):
    docs = lda.prepare(texts, "id", no_below=2, held_out=0.2, batches=5)
    sizes = {r["_batch"]: r["count"] for r in docs.rows.groupBy("_batch").count().collect()}
    assert docs.rows.select("id").distinct().count() == sum(sizes.values()) == 243 and len(docs.words) == 13
    topics = lda.fit_online(docs, k=3, passes=2)
    assert topics.seen == [[sizes.get(b, 0) for b in range(5)]] * 2 and docs.total == 243 - sizes[-1]


def test_themes_are_found_and_likelihood_rises(spark, texts):
    docs = lda.prepare(texts, "id", no_below=2, no_above=0.9, held_out=0.2, batches=2)
    topics = lda.fit_online(docs, k=3, passes=6, measure=True)
    assert topics.perplexity[-1] < topics.perplexity[0] < 40
    top = {}
    for r in lda.describe(spark, topics, top=4).collect():
        top.setdefault(r["topic"], set()).add(r["term"])
    assert set(map(frozenset, top.values())) == {frozenset(t) for t in (("tax", "budget", "money", "bank"), ("court", "judge", "law", "trial"), ("ball", "goal", "team", "match"))}
    mixes = {r["id"]: r["mix"] for r in lda.mixtures(docs, topics).collect()}
    assert len(mixes) == 243 and all(sum(m) == pytest.approx(1) for m in mixes.values())
    assert mixes[240] == mixes[241] == mixes[242] == pytest.approx([1 / 3] * 3)
    assert all(np.argmax(mixes[i]) == np.argmax(mixes[i % 3]) for i in range(240))


def test_step_equals_the_formula(texts):
    docs = lda.prepare(texts, "id", no_below=2, batches=1, tfidf=True)
    got = lda.fit_online(docs, k=2, passes=1, seed=5)
    rows = docs.rows.collect()
    start = np.random.default_rng(5).gamma(100.0, 0.01, (2, len(docs.words)))
    total = np.zeros_like(start)
    for r in rows:
        assert not r["_counts"] or sum(c * c for c in r["_counts"]) == pytest.approx(1)
        if r["_ids"]:
            i = np.array(r["_ids"])
            total[:, i] += lda.mixture(i, np.array(r["_counts"]), np.exp(lda.expected_logs(start)), 0.5)[1]
    assert got.weights == pytest.approx(0.5 + total)  # the first step takes all


def test_bound_is_below_the_likelihood():
    rng = np.random.default_rng(3)
    weights = rng.gamma(1.0, 5.0, (2, 4)) + 200
    logs = lda.expected_logs(weights)
    ids, counts, alpha = np.array([0, 2, 3]), np.array([2.0, 1.0, 3.0]), 0.7
    gamma, stats = lda.mixture(ids, counts, np.exp(logs), alpha)
    assert stats.sum() == pytest.approx(counts.sum()) and gamma.sum() == pytest.approx(2 * alpha + counts.sum())
    x = (np.arange(20_000) + 0.5) / 20_000
    density = x ** (alpha - 1) * (1 - x) ** (alpha - 1) * math.gamma(2 * alpha) / math.gamma(alpha) ** 2
    terms = np.exp(logs)[:, ids]
    exact = math.log(np.mean(density * np.prod((x[:, None] * terms[0] + (1 - x)[:, None] * terms[1]) ** counts, axis=1)))
    bound = lda.document_bound(ids, counts, gamma, logs, alpha)
    assert bound <= exact + 1e-3 and bound > exact - 1


def test_comparison(texts):
    docs = lda.prepare(texts, "id", no_below=2, held_out=0.25)
    table = lda.compare(docs, [2, 3], [1, 3]).collect()
    assert [(r["k"], r["passes"]) for r in table] == [(2, 1), (2, 3), (3, 1), (3, 3)] and all(r["perplexity"] > 1 for r in table)
    empty = lda.prepare(texts.where(F.col("id") < 0), "id")
    assert empty.words == [] and lda.fit_online(empty, k=2, passes=1).weights.shape == (2, 0)


def test_mixtures_side_by_side(monkeypatch):
    """Each document's mixture is the one it has alone, and the logarithms of many are one call."""
    rng = np.random.default_rng(5)
    weights = rng.gamma(1.0, 1.0, (4, 30))
    means = np.exp(lda.expected_logs(weights))
    sizes = [0, 1, 30, *rng.integers(0, 30, 600).tolist()]
    ids = [rng.choice(30, n, replace=False).tolist() for n in sizes]
    counts = [rng.integers(1, 50, n).astype(float).tolist() for n in sizes]
    calls, real = [], lda.expected_logs
    monkeypatch.setattr(lda, "expected_logs", lambda p: calls.append(1) or real(p))
    found = list(lda.each_mixture(ids, counts, means, 0.25))
    assert len(calls) <= -(-len(ids) // lda.DOCS_AT_ONCE) * (lda.ROUNDS + 1)
    assert len(found) == len(ids)
    for i, c, (own_ids, own_counts, gamma, share, norm) in zip(ids, counts, found, strict=True):
        alone, gives = lda.mixture(np.array(i, np.int64), np.array(c, float), means, 0.25)
        assert own_ids.tolist() == i and gamma == pytest.approx(alone, rel=1e-12)
        assert np.outer(share, own_counts / norm) * means[:, own_ids] == pytest.approx(gives, rel=1e-9)


def test_fits_share_a_reading(texts, monkeypatch):
    """Several numbers of topics are fitted in one reading of a batch, each as it would be alone."""
    docs, ks = lda.prepare(texts, "id", no_below=2, held_out=0.25, batches=2), [2, 3]
    alone = [lda.fit_online(docs, k, passes=2, measure=True) for k in ks]
    jobs, real = [], lda._statistics
    monkeypatch.setattr(lda, "_statistics", lambda rows, models: jobs.append(len(models)) or real(rows, models))
    table = {(r["k"], r["passes"]): r["perplexity"] for r in lda.compare(docs, ks, [1, 2]).collect()}
    assert jobs == [2] * (2 * docs.batches)
    assert table == {(k, p): pytest.approx(t.perplexity[p - 1], rel=1e-9) for k, t in zip(ks, alone, strict=True) for p in (1, 2)}


def test_blocks_of_equal_width(monkeypatch):
    """Documents are filled up within blocks of bounded size; a long one lies alone."""
    monkeypatch.setattr(lda, "CELLS", 200)
    rng = np.random.default_rng(6)
    means = np.exp(lda.expected_logs(rng.gamma(1.0, 1.0, (4, 90))))
    sizes = [3, 0, 90, 10, 11, 4, 0, 25]
    cut = list(lda._by_cells(np.sort(sizes), 4))
    assert np.concatenate(cut).tolist() == list(range(len(sizes))) and [len(x) for x in cut] == [5, 2, 1]
    ids = [rng.choice(90, n, replace=False) for n in sizes]
    counts = [rng.integers(1, 9, n).astype(float) for n in sizes]
    for i, c, (_, _, gamma, _, _) in zip(ids, counts, lda.each_mixture(ids, counts, means, 0.25), strict=True):
        assert gamma == pytest.approx(lda.mixture(i, c, means, 0.25)[0], rel=1e-12)
