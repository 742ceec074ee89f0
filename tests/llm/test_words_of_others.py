"""Words outside the closed vocabulary in the language model of op3."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalis.llm import lm


@pytest.fixture(scope="module")
def pairs(spark):
    """Text of 126 frequent words and 80 pairs: after the word a_i comes b_i.  Held out are pairs that
    occur so, and the same words mixed up."""
    rng, rows, common = np.random.default_rng(1), [], [f"c{i}" for i in range(lm.CLOSED)]
    def line(shift):
        words = []
        for i in rng.permutation(80).tolist():
            words += [*rng.choice(common, 4).tolist(), f"a{i}", f"b{(i + shift) % 80}"]
        return " ".join(words)
    held = [r["id"] for r in spark.range(4_000).where(lm.held_out("id")).collect()]
    train = sorted(set(range(4_000)) - set(held))
    rows = [(i, line(0)) for i in train[:400]] + [(held[0], line(0)), (held[1], line(7)), (None, None), (held[2], "never seen words"), (held[2], "never seen words")]
    return spark.createDataFrame(rows, "doc_id long, text string"), held[:3]


def test_a_word_of_others_depends_on_its_context(pairs):
    docs, (right, mixed, unseen) = pairs
    rows = lm.score(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 405 and [r.score for r in rows if r.doc_id == unseen] == pytest.approx([got[unseen].score] * 2)
    # Both have the same words in the same classes: with one class for all of them the scores hardly differ.
    assert got[right].base_score == pytest.approx(got[mixed].base_score, rel=0.02)
    assert got[right].score > got[mixed].score + 80 * 0.3


def test_shares_add_to_one():
    share, contexts = np.array([9.0, 5.0, 5.0, 2.5, 1.5, 1.5, 0.5]), 10
    own = lm.own_start(share, contexts)
    learn, hits = lm.learner(own)
    rng = np.random.default_rng(2)
    learn(rng.integers(0, contexts, 5_000), rng.integers(0, contexts, 5_000), rng.integers(0, len(share), 5_000))
    x, y = np.repeat(np.arange(contexts), len(share)), np.repeat(np.arange(contexts)[::-1], len(share))
    logs = lm.own_logs(own)(x, y, np.tile(np.arange(len(share)), contexts))
    assert (10**logs).reshape(contexts, -1).sum(1) == pytest.approx(1, abs=1e-5)
    assert hits[:contexts].sum() == 2 * 5_000 and len(set(own.group.tolist())) > 1


def test_every_word_outside_the_head_is_in_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 3)
    monkeypatch.setattr(lm, "BUCKET_WORDS", 2)
    rows = [("x x x x y y y z z " + " ".join(f"w{i}" for i in range(9)),), ("v" * 100,), ("",)]
    train = spark.createDataFrame(rows, "text string").select(F.col("text").cast("binary").alias("text"))
    counts = lm.count_words(train)
    masses = lm.bucket_masses(counts)
    assert counts.head == [b"x", b"y", b"z"] and len(masses) == 5 and masses.sum() == pytest.approx(10 * 1.5 + 5 * 0.5)
    words = [f"w{i}".encode() for i in range(9)] + [b"v" * 100]
    places = lm._places(words, np.full(10, -1), 3, 5)
    assert Counter((places - 3).tolist()) == Counter({i: round((m - 0.5) / 1.5) for i, m in enumerate(masses) if m > 0.5})
