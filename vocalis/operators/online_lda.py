"""Latent Dirichlet allocation by online variational inference (Hoffman, Blei and Bach 2010).

Documents are dealt once, by the hash of their ids, into disjoint batches that are stored apart.
A pass reads every batch once: the tasks find the topic mixtures of its documents under the current
topics and sum what each term contributes to each topic; these sums, one number per term of the
dictionary and topic, are added up in a shuffle by term and move the topics by a decaying share.
Nothing else moves, and no document is drawn twice in a pass or left out.  A share of the documents
can be held out to measure the perplexity after every pass.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.operators.terms import doc_frequency, filter_extremes, n_rows
from vocalis.session import new_shared_path

BATCH_DOCS, MOST_BATCHES = 2_000, 16
#: Documents whose mixtures are found side by side.
DOCS_AT_ONCE = 256
#: Cells of a block of documents, terms and topics.
CELLS = 1 << 18
DECAY, OFFSET, ROUNDS, CLOSE, SEED = 0.5, 1.0, 50, 1e-3, 1234


@dataclass(frozen=True)
class Documents:
    """``rows`` (``_batch``, id, ``_ids``, ``_counts``): the documents' terms by number.  Batch -1 is
    held out.  ``words``: the dictionary in the order of its numbers."""

    rows: DataFrame
    id_col: str
    words: list[str]
    batches: int
    total: int


@dataclass
class Topics:
    """``weights`` (topics, terms): parameters of the topics; ``alpha``: prior of the mixtures.
    ``seen``: per pass, the documents of every batch; ``perplexity``: per pass, of the held-out
    documents."""

    weights: np.ndarray
    alpha: float
    words: list[str]
    seen: list[list[int]] = field(default_factory=list)
    perplexity: list[float] = field(default_factory=list)


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 6, then the asymptotic series."""
    x, out = np.array(x, float), 0.0
    for _ in range(6):
        small = x < 6
        out = out - np.where(small, 1 / x, 0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def lgamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def expected_logs(p: np.ndarray) -> np.ndarray:
    return digamma(p) - digamma(p.sum(axis=-1, keepdims=True))


def mixture(ids: np.ndarray, counts: np.ndarray, topics: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of a document's mixture, and what its terms give to the topics; ``topics`` is
    exp(E[log P(term | topic)])."""
    k = len(topics)
    gamma = np.full(k, alpha + counts.sum() / k)
    own = topics[:, ids]
    for _ in range(ROUNDS):
        share = np.exp(expected_logs(gamma))
        norm = share @ own + 1e-100
        new = alpha + share * (own @ (counts / norm))
        close, gamma = np.abs(new - gamma).mean() < CLOSE, new
        if close:
            break
    share = np.exp(expected_logs(gamma))
    return gamma, np.outer(share, counts / (share @ own + 1e-100)) * own


def each_mixture(ids: Sequence, counts: Sequence, topics: np.ndarray, alpha: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`mixture` of many documents: ``ids, counts, parameters, share, norm`` of each, in their
    order; ``norm`` is what the shares make of its terms.

    DOCS_AT_ONCE documents of similar length go through the rounds side by side, so the logarithms are
    worked out for all of them at once, and their products by blocks of equal width; a document leaves
    when its own parameters stand still."""
    sizes = np.array([len(x) for x in ids], np.int64)
    order, found = np.argsort(sizes, kind="stable"), [None] * len(ids)
    for start in range(0, len(ids), DOCS_AT_ONCE):
        at = order[start : start + DOCS_AT_ONCE]
        i = [np.asarray(ids[d], np.int64) for d in at.tolist()]
        c = [np.asarray(counts[d], float) for d in at.tolist()]
        gamma = np.stack([np.full(len(topics), alpha + x.sum() / len(topics)) for x in c])
        live, blocks = np.ones(len(i), bool), [_block(b, i, c, topics) for b in _by_cells(sizes[at], len(topics))]
        for _ in range(ROUNDS):
            shares = np.empty_like(gamma)
            shares[live] = np.exp(expected_logs(gamma[live]))
            for n, (docs, own, count) in enumerate(blocks):
                on = live[docs]
                if 2 * on.sum() <= len(docs):  # those that left are carried along until they are half
                    docs, own, count = blocks[n] = docs[on], own[on], count[on]
                    on = live[docs]
                if not len(docs):
                    continue
                s = np.where(on[:, None], shares[docs], 1.0)
                norm = np.matmul(s[:, None, :], own)[:, 0] + 1e-100
                new = alpha + s * np.matmul(own, (count / norm)[:, :, None])[:, :, 0]
                far = np.abs(new - gamma[docs]).mean(axis=1) >= CLOSE
                gamma[docs[on]] = new[on]
                live[docs[on & ~far]] = False
            if not live.any():
                break
        for d, x, n, g, s in zip(at.tolist(), i, c, gamma, np.exp(expected_logs(gamma)), strict=True):
            found[d] = x, n, g, s, s @ topics[:, x] + 1e-100
    yield from found


def _by_cells(sizes: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Neighbouring documents whose terms together fill at most CELLS cells when made as long as the
    longest; ``sizes`` ascend."""
    start = 0
    while start < len(sizes):
        to = start + 1
        while to < len(sizes) and (to + 1 - start) * sizes[to] * k <= CELLS:
            to += 1
        yield np.arange(start, to)
        start = to


def _block(docs: np.ndarray, ids: list[np.ndarray], counts: list[np.ndarray], topics: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, their terms' chances (documents, topics, width) and counts, filled up with zeros."""
    width = max(len(ids[d]) for d in docs.tolist())
    own, count = np.zeros((len(docs), len(topics), width)), np.zeros((len(docs), width))
    for n, d in enumerate(docs.tolist()):
        own[n, :, : len(ids[d])], count[n, : len(ids[d])] = topics[:, ids[d]], counts[d]
    return docs, own, count


def document_bound(ids: np.ndarray, counts: np.ndarray, gamma: np.ndarray, logs: np.ndarray, alpha: float) -> float:
    """Lower bound of the log-likelihood of a document's terms; ``logs`` is E[log P(term | topic)]."""
    own = expected_logs(gamma)
    joint = own[:, None] + logs[:, ids]
    top = joint.max(axis=0) if len(ids) else np.empty(0)
    words = float(counts @ (top + np.log(np.exp(joint - top).sum(axis=0)))) if len(ids) else 0.0
    prior = float(((alpha - gamma) * own).sum() + (lgamma(gamma) - math.lgamma(alpha)).sum())
    return words + prior + math.lgamma(alpha * len(gamma)) - math.lgamma(gamma.sum())


def prepare(
    df: DataFrame, id_col: str, tokens: str = "tokens", no_below: int = 15, no_above: float = 1.0, keep_n: int = 10_000,
    tfidf: bool = False, held_out: float = 0.0, batches: int | None = None, seed: int = SEED,
) -> Documents:
    """Number the terms of a filtered dictionary (at most ``keep_n``, so it fits the driver and
    the tasks) and deal the documents into batches of at least BATCH_DOCS, MOST_BATCHES at most.
    With ``tfidf`` counts are weighted by ``log2(N / df)`` and scaled to unit length.  NULL tokens are
    an empty document."""
    kept = filter_extremes(doc_frequency(df, tokens), n_rows(df), no_below, no_above, keep_n).select("term", "df").collect()
    words, total = [r["term"] for r in kept], df.count()
    batches = batches or min(MOST_BATCHES, max(1, -(-total // BATCH_DOCS)))
    number = {w: i for i, w in enumerate(words)}
    weight = np.array([math.log2(total / r["df"]) for r in kept])

    def work(frames):
        for frame in frames:
            ids, counts = [], []
            for text in frame["_tokens"]:
                found = Counter(number[t] for t in (text if text is not None else ()) if t in number)
                i = np.array(sorted(found), np.int64)
                c = np.array([found[j] for j in i.tolist()], float)
                if tfidf:
                    c = c * weight[i]
                    norm = math.sqrt(float(c @ c))
                    c = c / norm if norm else c
                ids.append(i[c > 0].tolist())
                counts.append(c[c > 0].tolist())
            yield frame.drop(columns="_tokens").assign(_ids=ids, _counts=counts)

    dealt = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.lit(1_000_000))
    held = F.lit(int(round(held_out * 1_000_000)))
    rows = df.select(F.when(dealt < held, F.lit(-1)).otherwise(F.pmod(dealt, F.lit(batches))).cast("int").alias("_batch"), F.col(id_col), F.col(tokens).alias("_tokens"))
    kind = df.schema[id_col].dataType.simpleString()
    path = new_shared_path(df.sparkSession, "lda")
    rows.mapInPandas(work, f"_batch int, `{id_col}` {kind}, _ids array<int>, _counts array<double>").write.partitionBy("_batch").parquet(path)
    stored = df.sparkSession.read.schema(f"`{id_col}` {kind}, _ids array<int>, _counts array<double>, _batch int").parquet(path)
    fitted = stored.where("_batch >= 0").count()
    return Documents(stored, id_col, words, batches, fitted)


def _statistics(rows: DataFrame, models: Sequence[Topics]) -> tuple[list[np.ndarray], int]:
    """Summed contributions (topics, terms) of some documents to each model, and their number; the
    models share one reading."""
    given = [(np.exp(expected_logs(m.weights)), m.alpha) for m in models]
    most = max(len(means) for means, _ in given)

    def work(frames):
        # A term's row lies together; its chances are the same in every document.
        totals, docs = [np.zeros(means.T.shape) for means, _ in given], 0
        seen = np.zeros(given[0][0].shape[1], bool)
        for frame in frames:
            docs += len(frame)
            for total, (means, alpha) in zip(totals, given, strict=True):
                for i, c, _, share, norm in each_mixture(frame["_ids"], frame["_counts"], means, alpha):
                    if len(i):
                        total[i] += np.outer(c / norm, share)
                        seen[i] = True
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"model": [0], "term": [-1], "docs": [docs], "parts": [[0.0] * most]})
        for m, (total, (means, _)) in enumerate(zip(totals, given, strict=True)):
            yield pd.DataFrame({"model": m, "term": at, "docs": 0, "parts": list(total[at] * means.T[at])})

    parts = rows.select("_ids", "_counts").mapInPandas(work, "model int, term int, docs long, parts array<double>")
    sums = parts.groupBy("model", "term").agg(F.sum("docs").alias("docs"), *[F.sum(F.get("parts", F.lit(i))).alias(f"_{i}") for i in range(most)]).toPandas()
    out = [np.zeros_like(means) for means, _ in given]
    for m, found in enumerate(out):
        real = sums[(sums["term"] >= 0) & (sums["model"] == m)]
        found[:, real["term"].to_numpy(int)] = real[[f"_{i}" for i in range(len(found))]].to_numpy(float).T
    return out, int(sums["docs"].sum())


def perplexity(rows: DataFrame, topics: Topics) -> float:
    """exp of minus the bound per term over documents that took no part in the fit (without the
    topics' own divergence, which no document changes); NaN without any term."""
    return _perplexities(rows, [topics])[0]


def _perplexities(rows: DataFrame, models: Sequence[Topics]) -> list[float]:
    given = [(expected_logs(m.weights), m.alpha) for m in models]

    def work(frames):
        bounds, sizes = [0.0] * len(given), [0.0] * len(given)
        for frame in frames:
            for m, (logs, alpha) in enumerate(given):
                for i, c, gamma, _, _ in each_mixture(frame["_ids"], frame["_counts"], np.exp(logs), alpha):
                    if len(i):
                        bounds[m] += document_bound(i, c, gamma, logs, alpha)
                        sizes[m] += float(c.sum())
        yield pd.DataFrame({"model": range(len(given)), "bound": bounds, "size": sizes})

    found = rows.select("_ids", "_counts").mapInPandas(work, "model int, bound double, size double").groupBy("model").agg(
        F.sum("bound").alias("bound"), F.sum("size").alias("size")).collect()
    out = [math.nan] * len(given)
    for r in found:
        if r["size"]:
            out[r["model"]] = math.exp(-r["bound"] / r["size"])
    return out


def fit_online(docs: Documents, k: int = 10, passes: int = 2, seed: int = SEED, measure: bool = False) -> Topics:
    """``passes`` times over all batches; with ``measure`` the perplexity of the held-out
    documents after every pass."""
    return fit_each(docs, [k], passes, seed, measure)[0]


def fit_each(docs: Documents, ks: Sequence[int], passes: int = 2, seed: int = SEED, measure: bool = False) -> list[Topics]:
    """:func:`fit_online` for several ``k``, side by side: every batch is read once a pass for all."""
    models = [Topics(np.random.default_rng(seed).gamma(100.0, 0.01, (k, len(docs.words))), 1.0 / k, docs.words) for k in ks]
    held = docs.rows.where("_batch = -1")
    t = 0
    for _ in range(passes):
        seen = []
        for b in range(docs.batches):
            stats, n = _statistics(docs.rows.where(F.col("_batch") == b), models)
            seen.append(n)
            if n:
                rate = (OFFSET + t) ** -DECAY
                for topics, own in zip(models, stats, strict=True):
                    topics.weights = (1 - rate) * topics.weights + rate * (topics.alpha + own * (docs.total / n))
                t += 1
        for topics in models:
            topics.seen.append(list(seen))
        if measure:
            for topics, value in zip(models, _perplexities(held, models), strict=True):
                topics.perplexity.append(value)
    return models


def mixtures(docs: Documents, topics: Topics) -> DataFrame:
    """``id, mix``: topic shares of every document, held out or not; without terms they are equal."""
    means, alpha = np.exp(expected_logs(topics.weights)), topics.alpha

    def work(frames):
        for frame in frames:
            found = each_mixture(frame["_ids"], frame["_counts"], means, alpha)
            mixes = [(gamma / gamma.sum()).tolist() for _, _, gamma, _, _ in found]
            yield frame.drop(columns=["_ids", "_counts"]).assign(mix=mixes)

    kind = docs.rows.schema[docs.id_col].dataType.simpleString()
    return docs.rows.select(docs.id_col, "_ids", "_counts").mapInPandas(work, f"`{docs.id_col}` {kind}, mix array<double>")


def describe(spark, topics: Topics, top: int = 10) -> DataFrame:
    """``topic, rank, term, weight`` of the strongest terms of every topic; ties by term."""
    share = topics.weights / topics.weights.sum(axis=1, keepdims=True)
    rows = []
    for i, row in enumerate(share):
        order = sorted(range(len(row)), key=lambda j: (-row[j], topics.words[j]))[:top]
        rows += [(i, rank, topics.words[j], float(row[j])) for rank, j in enumerate(order)]
    return spark.createDataFrame(rows, "topic int, rank int, term string, weight double")


def compare(docs: Documents, ks: Sequence[int], passes: Sequence[int], seed: int = SEED) -> DataFrame:
    """``k, passes, perplexity`` of the held-out documents: one fit per ``k``, all side by side, measured
    on their way."""
    models = fit_each(docs, ks, max(passes), seed, measure=True)
    rows = [(k, p, topics.perplexity[p - 1]) for k, topics in zip(ks, models, strict=True) for p in passes]
    return docs.rows.sparkSession.createDataFrame(rows, "k int, passes int, perplexity double")
