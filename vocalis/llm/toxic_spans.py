"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Words (runs of ASCII letters and digits and of all bytes beyond ASCII, A-Z lower-cased) are tagged
ordinary or toxic.  A tag's score sums hashed features of the word (itself, its first 4 to 8 and last 4
bytes) and of its two neighbours; four weights hold the transitions, two the first tag.  The chains of
all texts of a slice are one product of 2 x 2 matrices, a text's first matrix having equal rows, which cuts
it from the text before; products of blocks, their prefixes and then all places give the forward and
backward vectors without a loop over words.

Training: labels mark documents, so tokens are labelled first.  A feature is toxic where, over the
documents of the fitting part, it is frequent in toxic ones beyond chance (``LEAST_DOCS``, ``LEAST_RATIO``,
``LEAST_GAIN``); a token of a toxic document is labelled toxic when one of its features is, all
other tokens are ordinary.  The field is fitted to these labels by gradient steps on the
log-likelihood.  Documents of the other part then fit a logistic regression of the document's label
on sums of the marginals.  Both parts come from at most ``SAMPLE`` labelled documents of at most
``SAMPLE_BYTES`` (those of the smallest hash; equal texts count once): bounds of the fit alone.  Every
document is scored whole, whatever its length.

Defined results: a NULL or empty text has no words, so its score is that of marginals that are all zero;
NULL labels do not train, of several labels of one id the greatest counts, a NULL id is neither
labelled nor held out; repeated documents are scored each; where the sample lacks one of the labels, every
score is its share of toxic documents (0 without any); other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.llm.common import chunks, smallest_ids, utf8

SAMPLE, SAMPLE_BYTES, FITTED = 5_000, 1 << 15, 0.7
LEAST_DOCS, LEAST_RATIO, LEAST_GAIN = 5, 6.0, 20.0
FEATURES, ROUNDS, STEPS, RATE, DECAY = 1 << 18, 8, 60, 0.1, 2e-6
#: Bytes of texts in one gradient step.
SLICE = 1 << 20
THRESHOLD = 0.7
#: Words of a task whose scores are kept for its next texts.
KNOWN = 500_000
PREFIXES, SUFFIX = (4, 5, 6, 7, 8), 4
BLOCK = 64
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


@dataclass(frozen=True)
class Model:
    """``word``, ``before``, ``after``: weights of hashed features of a word and its neighbours;
    ``steps``: transition weights [from, to]; ``first``: weights of the first tag; ``document``:
    coefficients of the document's score; ``share``: a score where nothing could be fitted."""

    word: np.ndarray
    before: np.ndarray
    after: np.ndarray
    steps: np.ndarray
    first: np.ndarray
    document: np.ndarray | None
    share: float = 0.0


def features(word: bytes) -> list[int]:
    """Buckets of a word's features, its own first."""
    parts = [b"=" + word, *(b"<" + word[:n] for n in PREFIXES if len(word) >= n)]
    if len(word) >= SUFFIX:
        parts.append(b">" + word[-SUFFIX:])
    return [zlib.crc32(p) % FEATURES for p in parts]


def feature_rows(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, and the word each belongs to."""
    rows = [features(w) for w in words]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.array([b for r in rows for b in r], np.int64), np.repeat(np.arange(len(rows)), sizes)


def _scaled(a: list[np.ndarray]) -> list[np.ndarray]:
    top = np.maximum.reduce(a)
    return [x / top for x in a]


def _chain(m: np.ndarray) -> np.ndarray:
    """``m`` (4, n): matrices (00, 01, 10, 11) of a chain; the vector behind every place, scaled, that
    starts from (1, 1): shape (2, n)."""
    n = m.shape[1]
    if n <= 2 * BLOCK:
        out, a, b = np.empty((2, n)), 1.0, 1.0
        for t, (w, x, y, z) in enumerate(m.T.tolist()):
            a, b = a * w + b * y, a * x + b * z
            top = max(a, b)
            out[0, t], out[1, t] = a, b = a / top, b / top
        return out
    blocks = -(-n // BLOCK)
    padded = np.empty((4, blocks * BLOCK))
    padded[:, :n] = m
    padded[:, n:] = np.array([[1.0], [0.0], [0.0], [1.0]])
    steps = np.ascontiguousarray(padded.reshape(4, blocks, BLOCK).transpose(2, 0, 1))
    whole = list(steps[0])
    for w, x, y, z in steps[1:]:
        p, q, r, s = whole
        whole = _scaled([p * w + q * y, p * x + q * z, r * w + s * y, r * x + s * z])
    behind = _chain(np.stack(whole))
    a, b = (np.concatenate([[1.0], v[:-1]]) for v in behind)
    out = np.empty((BLOCK, 2, blocks))
    for t, (w, x, y, z) in enumerate(steps):
        a, b = _scaled([a * w + b * y, a * x + b * z])
        out[t, 0], out[t, 1] = a, b
    return out.transpose(1, 2, 0).reshape(2, -1)[:, :n]


def matrices(score: np.ndarray, starts: np.ndarray, steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The chain's matrices: ``score`` favours the toxic tag, ``starts`` marks first words."""
    toxic = np.exp(np.clip(score, -30, 30))
    trans, begin = np.exp(steps), np.exp(first)
    m = np.empty((4, len(score)))
    for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        m[k] = np.where(starts, begin[j], trans[i, j]) * (toxic if j else 1.0)
    return m / m.max(axis=0)


def marginals(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``P(toxic)`` at every place, and of every pair (tag before, tag) as (4, n); where a text
    starts, the tag before is that of no word and only the sums over it mean something."""
    n = m.shape[1]
    if not n:
        return np.empty(0), np.empty((4, 0))
    forward = _chain(m)
    # Behind place t the chain goes on with the matrix of t + 1, read from its end.
    turned = _chain(m[[0, 2, 1, 3]][:, :0:-1])[:, ::-1] if n > 1 else np.empty((2, 0))
    backward = np.concatenate([turned, np.ones((2, 1))], axis=1)
    before = np.concatenate([np.ones((2, 1)), forward[:, :-1]], axis=1)
    pairs = np.stack([before[k // 2] * m[k] * backward[k % 2] for k in range(4)])
    pairs /= pairs.sum(axis=0)
    return pairs[1] + pairs[3], pairs


def _neighbours(score: np.ndarray, before: np.ndarray, after: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Scores of words plus what their neighbours within the text add."""
    total = score.copy()
    inner = ~starts[1:]
    total[1:][inner] += before[:-1][inner]
    total[:-1][inner] += after[1:][inner]
    return total


def _adam(p: dict[str, np.ndarray], g: dict[str, np.ndarray], state: dict, step: int, rate: float) -> None:
    for k in p:
        a, b = state.setdefault(k, (np.zeros_like(p[k]), np.zeros_like(p[k])))
        a += 0.1 * (g[k] - a)
        b += 0.01 * (g[k] * g[k] - b)
        p[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)


class Tokens:
    """Words of some texts in a row, and the features of its different words."""

    def __init__(self, texts: Sequence[bytes]):
        lists = [t.translate(LOWER).split() for t in texts]
        number: dict[bytes, int] = {}
        self.ids = np.array([number.setdefault(w, len(number)) for words in lists for w in words], np.int64)
        self.words = list(number)
        self.sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.owner = np.repeat(np.arange(len(lists)), self.sizes)
        self.starts = np.ones(len(self.ids), bool)
        self.starts[1:] = self.owner[1:] != self.owner[:-1]

    def read_features(self) -> None:
        self.buckets, self.word = feature_rows(self.words)
        self.upto = np.searchsorted(self.word, np.arange(len(self.words) + 1))


def slices(texts: Sequence[bytes]) -> list[Tokens]:
    """Words of neighbouring texts of about ``SLICE`` bytes each."""
    groups: list[list[bytes]] = []
    size = SLICE
    for t in texts:
        if size >= SLICE:
            groups.append([])
            size = 0
        groups[-1].append(t)
        size += len(t)
    return [Tokens(g) for g in groups]


def label_tokens(parts: Sequence[Tokens], toxic: Sequence[np.ndarray]) -> list[np.ndarray]:
    """True for tokens of toxic documents that have a feature frequent there beyond chance."""
    a, b = np.zeros(FEATURES), np.zeros(FEATURES)
    for t, y in zip(parts, toxic, strict=True):
        n = len(t.words)
        doc, w = np.divmod(np.unique(t.owner * n + t.ids), max(n, 1))
        size = np.diff(t.upto)[w]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        doc, bucket = np.divmod(np.unique(np.repeat(doc, size) * FEATURES + t.buckets[np.repeat(t.upto[w], size) + inside]), FEATURES)
        a += np.bincount(bucket[y[doc]], minlength=FEATURES)
        b += np.bincount(bucket[~y[doc]], minlength=FEATURES)
    n1, n0 = (sum(float((y == k).sum()) for y in toxic) for k in (True, False))
    share = (a + b) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.where(a > 0, a * np.log(a / (n1 * share)), 0) + np.where(b > 0, b * np.log(b / (n0 * share)), 0))
    marked = (a >= LEAST_DOCS) & ((a + 0.5) / (n1 + 1) >= LEAST_RATIO * (b + 0.5) / (n0 + 1)) & (gain >= LEAST_GAIN)
    found = []
    for t, y in zip(parts, toxic, strict=True):
        of_word = np.zeros(len(t.words), bool)
        np.logical_or.at(of_word, t.word, marked[t.buckets])
        found.append(of_word[t.ids] & y[t.owner])
    return found


def fit_field(parts: Sequence[Tokens], labels: Sequence[np.ndarray], rounds: int = ROUNDS) -> Model:
    """Maximise the penalised log-likelihood of the token labels, a step for every slice in every
    round, and at least ``STEPS``."""
    p = {k: np.zeros(FEATURES) for k in ("word", "before", "after")} | {"steps": np.zeros((2, 2)), "first": np.zeros(2)}
    state: dict = {}
    whole = [(t, y) for t, y in zip(parts, labels, strict=True) if len(y)]
    steps = max(rounds * len(whole), STEPS) if whole else 0
    for step in range(steps):
        t, y = whole[step % len(whole)]
        own, inner, count = t.buckets[t.upto[:-1]], ~t.starts[1:], len(t.words)
        of_word = np.bincount(t.word, weights=p["word"][t.buckets], minlength=count)
        score = _neighbours(of_word[t.ids], p["before"][own][t.ids], p["after"][own][t.ids], t.starts)
        toxic, pairs = marginals(matrices(score, t.starts, p["steps"], p["first"]))
        error, tags = toxic - y, y.astype(np.int64)
        by_word = np.bincount(t.ids, weights=error, minlength=count)
        before = np.bincount(t.ids[:-1], weights=error[1:] * inner, minlength=count)
        after = np.bincount(t.ids[1:], weights=error[:-1] * inner, minlength=count)
        moved = np.bincount((tags[:-1] * 2 + tags[1:])[inner], minlength=4).reshape(2, 2)
        began = np.bincount(tags[t.starts], minlength=2)
        g = {
            "word": np.bincount(t.buckets, weights=by_word[t.word], minlength=FEATURES), "before": np.bincount(own, weights=before, minlength=FEATURES),
            "after": np.bincount(own, weights=after, minlength=FEATURES), "steps": pairs[:, 1:][:, inner].sum(axis=1).reshape(2, 2) - moved,
            "first": np.array([(1 - toxic)[t.starts].sum(), toxic[t.starts].sum()]) - began}
        _adam(p, {k: v / len(y) + DECAY * p[k] for k, v in g.items()}, state, step + 1, RATE * (1 - 0.9 * step / steps))
    return Model(**p, document=None)


def document_features(toxic: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of marginals per document: constant, log of the expected number, its share of the
    words, the chance that any word is toxic, log of the length."""
    total = np.bincount(owner, weights=toxic, minlength=len(sizes))
    none = np.bincount(owner, weights=np.log1p(-np.minimum(toxic, 1 - 1e-9)), minlength=len(sizes))
    return np.stack([np.ones(len(sizes)), np.log1p(total), np.minimum(10 * total / np.maximum(sizes, 1), 1), 1 - np.exp(none), np.log1p(sizes) / 10], axis=1)


def fit_documents(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(curve, x.T @ (p - y) + ridge * w)
    return w


def fit(texts: Sequence[bytes], toxic: Sequence[int], rounds: int = ROUNDS) -> Model:
    """Field and document score from labelled texts; equal texts count once, the greatest label."""
    merged: dict[bytes, int] = {}
    for t, y in zip(texts, toxic, strict=True):
        merged[t] = max(y, merged.get(t, 0))
    order = sorted(merged, key=zlib.crc32)
    y = np.array([merged[t] for t in order], bool)
    cut = int(len(order) * FITTED)
    share = float(y.mean()) if len(y) else 0.0
    if not all(0 < part.sum() < len(part) for part in (y[:cut], y[cut:])):
        return Model(*(np.zeros(FEATURES) for _ in range(3)), np.zeros((2, 2)), np.zeros(2), None, share)
    parts = slices(order[:cut])
    for t in parts:
        t.read_features()
    field = fit_field(parts, label_tokens(parts, np.split(y[:cut], np.cumsum([len(t.sizes) for t in parts])[:-1])), rounds)
    del parts
    rest = slices(order[cut:])
    x = np.concatenate([document_features(tagged(field, t, {}), t.owner, t.sizes) for t in rest])
    small = {k: getattr(field, k).astype(np.float32) for k in ("word", "before", "after")}
    return Model(**small, steps=field.steps, first=field.first, document=fit_documents(x, y[cut:].astype(float)), share=share)


def tagged(model: Model, tokens: Tokens, known: dict[bytes, tuple[float, float, float]]) -> np.ndarray:
    """``P(toxic)`` of every token; ``known`` keeps scores of words."""
    new = [w for w in tokens.words if w not in known]
    if new:
        buckets, word = feature_rows(new)
        own = buckets[np.searchsorted(word, np.arange(len(new)))]
        of_word = np.bincount(word, weights=model.word[buckets], minlength=len(new))
        known.update(zip(new, zip(of_word.tolist(), model.before[own].tolist(), model.after[own].tolist(), strict=True), strict=True))
    table = np.array([known[w] for w in tokens.words]).reshape(-1, 3)
    if len(known) > KNOWN:
        known.clear()
    score = _neighbours(*(table[tokens.ids, k] for k in range(3)), tokens.starts)
    return marginals(matrices(score, tokens.starts, model.steps, model.first))[0]


def offsets_of(text: bytes, toxic: np.ndarray) -> list[tuple[int, int, float]]:
    """Code-point spans of neighbouring words that are likelier toxic than not, with the greatest
    marginal."""
    spans, last = [], -2
    points = np.cumsum(np.concatenate([[0], (np.frombuffer(text, np.uint8) & 0xC0) != 0x80]))
    for i, m in enumerate(WORD.finditer(text)):
        if toxic[i] <= 0.5:
            continue
        start, end, p = int(points[m.start()]), int(points[m.end()]), float(toxic[i])
        if i == last + 1:
            spans[-1] = (spans[-1][0], end, max(p, spans[-1][2]))
        else:
            spans.append((start, end, p))
        last = i
    return spans


def held_out(key: str) -> Column:
    """A third of the documents by the checksum of the id."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE):
    """Texts and labels of at most ``rows`` labelled documents that are not held out."""
    marks = labels.where(~held_out(key) & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_toxic"))
    texts = docs.select(F.col(key).alias("_key"), utf8(text).alias("_text")).where(F.octet_length("_text") <= SAMPLE_BYTES)
    # The ids that both tables have, so that the sample is full; at most ``rows`` of them are broadcast.
    ids = smallest_ids(texts.select("_key").join(marks, "_key", "left_semi"), rows, "_key")
    chosen = F.broadcast(marks.join(F.broadcast(ids), "_key"))
    found = texts.join(chosen, "_key").groupBy("_key").agg(F.min("_text").alias("_text"), F.max("_toxic").alias("_toxic")).orderBy("_key").collect()
    return [bytes(r["_text"]) for r in found], [r["_toxic"] for r in found]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, n_words, spans``: chance that a document is toxic, and the code-point offsets
    ``start, end, p`` of its toxic spans."""

    def work(batches):
        import pyarrow as pa

        known: dict[bytes, tuple[float, float, float]] = {}
        for part in chunks(batches):
            texts = [raw.as_py() for raw in part.column("text")]
            tokens = Tokens(texts)
            toxic = tagged(model, tokens, known)
            if model.document is None:
                found = np.full(len(texts), model.share)
            else:
                z = document_features(toxic, tokens.owner, tokens.sizes) @ model.document
                found = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            upto, spans, ends = np.cumsum([0, *tokens.sizes]), [], [0]
            bad = np.bincount(tokens.owner[toxic > 0.5], minlength=len(texts))
            for i, t in enumerate(texts):
                if bad[i]:
                    spans += offsets_of(t, toxic[upto[i] : upto[i + 1]])
                ends.append(len(spans))
            kinds = (("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64()))
            items = pa.StructArray.from_arrays([pa.array([s[k] for s in spans], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(found, pa.float64()), pa.array(tokens.sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)],
                ["key", "score", "n_words", "spans"])

    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(work, f"key {kind}, score double, n_words long, spans array<struct<start:long,end:long,p:double>>").withColumnRenamed("key", key)


def toxicity_report(scored: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``key, held_out, score, predicted, spans``; spans as ``start:end``, joined by commas."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scored.select(F.col(key), held_out(key).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), spans.alias("spans"))
