"""Ranked search, toxic spans and periodic runs against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from compare import connection, difference
from conftest import SMALL
from helpers import KINDS, ODD
from pyspark.sql import functions as F

from vocalis.llm import periodic, queries, ranked_search, toxic_spans

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, KINDS)


# ---- ranked search ----------------------------------------------------------------------
def ranked(docs, items, k=20):
    terms = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df, out = Counter(t for _, c in terms for t in c), []
    for item, text in items:
        asked, scored = Counter(TERM.findall((text or "").translate(UPPER))), []
        for i, c in terms:
            if not c:
                continue
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // length
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i, s))
        scored.sort(key=lambda r: r[:2] + ((r[2],) if r[2] is not None else ()))
        out += [(item, rank, i, s) for rank, (_, _, i, s) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_search_equals_sql(spark):
    assert difference(queries.QUERIES["op11_ranked_search"](spark, SMALL), connection(SMALL), queries.ORACLE["op11_ranked_search"]) is None


@pytest.mark.parametrize("together, width, block", [(256, 512, 1 << 15), (2, 3, 3)])
def test_search_of_random_rows(spark, monkeypatch, together, width, block):
    monkeypatch.setattr(ranked_search, "TOGETHER", together)
    monkeypatch.setattr(ranked_search, "WIDTH", width)
    monkeypatch.setattr(ranked_search, "ITEMS", block)
    rng = random.Random(together)
    some = lambda n: " ".join(rng.choice(["a", "B", "c'd", "é", "E", "ff", "中文", "x-y"]) for _ in range(rng.randint(0, n)))
    docs = [(i, some(30)) for i in range(120)] + [(7, "a B"), (None, "a ff"), (300, None), (301, "")]
    items = [(i, some(6)) for i in range(8)] + [(1, "a"), (50, None), (51, "nowhere"), (52, "")]
    left = spark.createDataFrame(docs, KINDS).repartition(5).selectExpr("*", "1 as n", "2 as score")
    right = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "3 as doc_id")
    assert found(ranked_search.search(left, right, k=5)) == ranked(docs, items, 5)


def test_search_of_odd_rows(spark, odd):
    items = [(1, "words two"), (2, "word"), (3, "É naïve")]
    right = spark.createDataFrame(items, "item_id long, text string")
    assert found(ranked_search.search(odd, right)) == ranked(ODD, items)
    assert ranked_search.search(odd.limit(0), right).count() == 0
    assert ranked_search.search(odd, right.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search.search(odd.where("doc_id < 3"), right).count() == 0


def test_bounds_skip_strata_without_loss():
    rng = np.random.default_rng(4)
    n = np.concatenate([np.full(200, 10), np.arange(1, 800)])
    ends = np.concatenate([[0], np.cumsum(rng.integers(1, 4, len(n)))])
    terms = np.concatenate([rng.choice(50, b - a, replace=False) for a, b in itertools.pairwise(ends)])
    tfs = rng.integers(1, 9, len(terms))
    strata = ranked_search.strata_of(np.arange(len(n)), n, ends, terms, tfs, len(n), int(n.sum()))
    wanted = rng.integers(0, 9000, (6, 50)).astype(float) * (rng.random((6, 50)) < 0.1)
    best = ranked_search.Best(6, 5)
    done = ranked_search.visit(strata, wanted, np.arange(6), best)
    assert sum(len(s.ids) for s in strata) == len(n) and done < 6 * len(n) * 0.7
    whole = np.zeros((6, len(n)), np.int64)
    for s in strata:
        for ids, scores in s.scores(wanted):
            whole[:, ids] = scores
    for i in range(6):
        order = np.lexsort((np.arange(len(n)), -whole[i]))[:5]
        assert best.ids[i].tolist() == order.tolist() and best.scores[i].tolist() == whole[i][order].tolist()


def test_sums_beyond_doubles_stay_whole():
    block = [Counter({b"a": 1 << 40, b"b": 3})]
    wanted = ranked_search.wanted_of(block, {b"a": 0, b"b": 1}, np.array([9, 7]))
    assert wanted.dtype == np.int64 and wanted.tolist() == [[9 << 40, 21]]


# ---- toxic spans ------------------------------------------------------------------------
def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(1, 6, 3)
        n = int(sizes.sum())
        starts = np.zeros(n, bool)
        starts[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
        score, steps, first = rng.normal(0, 2, n), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
        toxic, pairs = toxic_spans.marginals(toxic_spans.matrices(score, starts, steps, first))
        weight, at, both = 0.0, np.zeros(n), np.zeros((4, n))
        for tags in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(score[t] * y + (first[y] if starts[t] else steps[tags[t - 1], y]) for t, y in enumerate(tags)))
            weight += w
            at += w * np.array(tags)
            for t in range(1, n):
                both[2 * tags[t - 1] + tags[t], t] += w
        assert np.allclose(toxic, at / weight)
        assert np.allclose(pairs[:, 1:][:, ~starts[1:]], (both / weight)[:, 1:][:, ~starts[1:]])


def test_long_chains_equal_short_steps():
    rng = np.random.default_rng(2)
    m = rng.random((4, 30_011)) ** 3 + 1e-6
    a, b = 1.0, 1.0
    out = toxic_spans._chain(m)
    for t, (w, x, y, z) in enumerate(m.T.tolist()):
        a, b = a * w + b * y, a * x + b * z
        a, b = a / max(a, b), b / max(a, b)
        assert out[0, t] == pytest.approx(a, rel=1e-9) and out[1, t] == pytest.approx(b, rel=1e-9)


def test_gradient_is_that_of_the_likelihood():
    tokens = toxic_spans.Tokens([b"aaaa bbbb cccc", b"bbbb aaaa", b"cccc"])
    y = np.array([1, 0, 0, 0, 1, 0], bool)
    tokens.read_features()
    model = toxic_spans.fit_field([tokens], [y], rounds=200)
    p = toxic_spans.tagged(model, tokens, {})
    assert np.abs(p - y).max() < 0.2


def toxic_rows(n, seed):
    rng = random.Random(seed)
    words = ["river", "stone", "lamp", "green", "walk", "paper", "tree", "glass"]
    rows = []
    for i in range(n):
        text, bad = [rng.choice(words) + str(rng.randint(0, 40)) for _ in range(rng.randint(5, 60))], i % 4 == 0
        if bad:
            for _ in range(rng.randint(2, 6)):
                text.insert(rng.randint(0, len(text)), rng.choice(["Vile", "nasty", "grumpf" + rng.choice("aeiou")]))
        rows.append((" ".join(text), int(bad)))
    return rows


@pytest.fixture(scope="module")
def fitted():
    texts, labels = zip(*toxic_rows(800, 1), strict=True)
    return toxic_spans.fit([t.encode() for t in texts], labels)


def test_held_out_documents_and_offsets(spark, fitted):
    rows = toxic_rows(300, 2)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, (t, _) in enumerate(rows)], KINDS + ", score int, spans string")
    got = {r.doc_id: r for r in toxic_spans.score(docs, fitted).collect()}
    assert sum((got[i].score >= 0.7) == y for i, (_, y) in enumerate(rows)) >= 290
    hit = said = have = 0
    for i, (t, _) in enumerate(rows):
        true = {m.span() for m in re.finditer(r"Vile|nasty|grumpf\w", t)}
        mine = {m.span() for s in got[i].spans for m in re.finditer(r"\w+", t) if s.start <= m.start() and m.end() <= s.end}
        hit, said, have = hit + len(true & mine), said + len(mine), have + len(true)
    assert hit / said > 0.95 and hit / have > 0.95


def test_score_equals_the_field_word_by_word(spark, fitted, odd):
    rows = toxic_rows(20, 3)
    for r, (t, _) in zip(toxic_spans.score(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], KINDS), fitted).collect(), rows, strict=True):
        words = re.findall(r"[0-9A-Za-z]+", t.lower())
        own = [[fitted.word[b] for b in toxic_spans.features(w.encode())] for w in words]
        side = [toxic_spans.features(w.encode())[0] for w in words]
        u = [sum(map(float, x)) + (float(fitted.before[side[k - 1]]) if k else 0) + (float(fitted.after[side[k + 1]]) if k + 1 < len(words) else 0) for k, x in enumerate(own)]
        f = [fitted.first + np.array([0, u[0]])]
        for s in u[1:]:
            f.append(np.logaddexp(f[-1][0] + fitted.steps[0], f[-1][1] + fitted.steps[1]) + np.array([0, s]))
        b = [np.zeros(2)]
        for s in u[:0:-1]:
            b.append(np.array([np.logaddexp(*(fitted.steps[i] + np.array([0, s]) + b[-1])) for i in (0, 1)]))
        joint = np.array(f) + np.array(b[::-1])
        p = 1 / (1 + np.exp(joint[:, 0] - joint[:, 1]))
        x = toxic_spans.document_features(p, np.zeros(len(p), int), np.array([len(p)]))
        assert r.score == pytest.approx(float((1 / (1 + np.exp(-x @ fitted.document)))[0]), abs=1e-6) and r.n_words == len(words)
    got = toxic_spans.toxicity_report(toxic_spans.score(odd, fitted)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1 and not any(r.held_out for r in got if r.doc_id is None)


def test_fit_without_labels(spark, odd):
    labels = spark.createDataFrame([(4, None), (5, 1), (5, 0)], "doc_id long, toxic int")
    texts, marks = toxic_spans.labelled_texts(odd.selectExpr("*", "0 as toxic", "1 as _toxic"), labels)
    assert marks == [1] * (zlib.crc32(b"5") % 3 != 1)
    assert {r.score for r in toxic_spans.score(odd, toxic_spans.fit(texts, marks)).collect()} == {float(bool(marks))}
    assert {r.score for r in toxic_spans.score(odd, toxic_spans.fit([], [])).collect()} == {0.0}
    assert toxic_spans.score(odd.limit(0), toxic_spans.fit([], [])).count() == 0


def test_toxicity_query(spark):
    got = queries.QUERIES["op12_toxic_spans"](spark, SMALL).collect()
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_only_texts_decide(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    held = toxic_spans.held_out("doc_id")
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxic_spans.labelled_texts(docs, labels) == toxic_spans.labelled_texts(docs.withColumn("lang", F.lit("x")), turned)


# ---- periodic runs ----------------------------------------------------------------------
def plain_runs(x, least=24, exponent=3):
    out = []
    for q in range(1, len(x) // exponent + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            part = x[i : j + q]
            if len(part) >= max(least, exponent * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        k, x = rng.choice([1, 2, 2, 3, 5]), []
        while len(x) < rng.randint(0, 200):
            if rng.random() < 0.5 or not x:
                x += [rng.randrange(k) for _ in range(rng.randint(1, 6))]
            else:
                x += (x[-rng.randint(1, min(len(x), 30)) :] * rng.randint(2, 5))[: rng.randint(1, 120)]
        least, exponent = rng.choice([(24, 3), (24, 3), (3, 3), (10, 4), (7, 3)])
        assert periodic.runs_of(np.array(x, np.int64), least, exponent) == plain_runs(x, least, exponent)


def test_runs_of_periods_made_of_squares():
    a, b = list(range(1, 18)), [*range(1, 9), *range(30, 45)]
    for block in (a * 2 + b * 2, a + b + a + a + b, [0] * 17 + [1], [0] * 40 + [1] + [0] * 40 + [2]):
        x = [9] * 3 + block * 4 + [8]
        assert periodic.runs_of(np.array(x), 24, 3) == plain_runs(x)


def test_long_repeats_in_time():
    assert periodic.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    x = np.tile(np.arange(50_000), 4)
    assert periodic.runs_of(x) == [(0, 200_000, 50_000)]
    with pytest.raises(ValueError):
        periodic.runs_of(x, 24, 2)


def expected(key, text, loop):
    w = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if loop and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (key, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r.text) < 9000]
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, SMALL).collect()}
    assert sum(got[i][1] > 0 for i, _ in docs) > 10
    assert [got[i] for i, _ in docs] == [expected(i, t, True) for i, t in docs]


def test_runs_of_odd_rows(spark, odd, monkeypatch):
    extra = odd.unionAll(odd).selectExpr("*", "1 as runs", "2 as start", "3 as _best").repartition(2)
    got = periodic.run_report(periodic.with_runs(extra)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(i, t, False)) for i, t in ODD * 2)
    assert periodic.run_report(periodic.with_runs(odd.limit(0))).count() == 0
