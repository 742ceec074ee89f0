"""Language-model scores: smoothed unigrams, and a log-bilinear model over frequent words.

Corpus statistics cover every training document: counts of all words, and counts of (word, word,
word) over a closed vocabulary of the ``CLOSED`` most frequent words, one class for all others and
the end.  The log-bilinear model predicts a class from the sum of the two context words' vectors,
each times the matrix of its position; numpy trains it on the triples, drawn by their counts, with
noise-contrastive estimation against the unigram distribution.  Batched matrix products then give
normalised log-probabilities of every class after every context.

The class of others is divided by a second log-bilinear model in which every word takes part, as
context and as what is predicted: a word of the head has vectors of its own, the words outside the
head share those of buckets by checksum, whose number grows with them, and divide a bucket by their
smoothed counts.  Tasks pass once over every training triple that ends in a word of others, with
noise-contrastive estimation, and their vectors are averaged by how often each was moved.  It is
normalised in two steps, group and word in group, over groups of neighbouring frequency.

Words among the ``HEAD`` most frequent are looked up in the task, so no hot word is shuffled; the
rest of a document's words join the counts by word.

Defined results: a NULL or empty text is the end alone; a NULL id trains; repeated rows count and
are scored each; ties of frequency are left out of the head together, of the closed vocabulary go
by word; without training documents a token has probability one over nothing known (base 0) and
the model is uniform; other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.llm.common import chunks, stored, utf8

CLOSED, HEAD, HEAD_BYTES = 126, 200_000, 64
#: Words counted in one task before their counts move on.
COUNTED = 300_000
DIM, STEPS, BATCH, NOISE, RATE, SEED = 24, 2_000, 1_024, 12, 0.15, 7
#: Words outside the head that share a vector, and the most such vectors that a task holds.
BUCKET_WORDS, BUCKETS = 64, 65_536
#: Training tokens of a task for every vector it sends, and vectors sent as one row.
ROW_TOKENS, BLOCK = 64, 4_096
#: Triples learned at a time and noise words they share; cells of a product at a time.
PART, SHARED, OWN_RATE, OWN_SEEN, CELLS = 2_048, 32, 0.15, 1.0, 1 << 20
END = b""  # no word is empty


@dataclass
class Counts:
    """``words`` (word binary, c): all training words and the end.  ``head``: the frequent words,
    most frequent first, the first ``closed`` of them the closed vocabulary."""

    words: DataFrame
    total: int
    distinct: int
    ends: int
    head: list[bytes]
    head_counts: np.ndarray
    cut: int | None  # the least count of the head

    @property
    def closed(self) -> int:
        return min(CLOSED, len(self.head))


def held_out(key: str) -> Column:
    """A fifth of the documents by the checksum of the id."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z and the separators 9 to 13 and 32 alone


def count_words(train: DataFrame) -> Counts:
    """Counts over all rows of ``text`` (binary); pre-aggregated in tasks before the shuffle."""

    def work(batches):
        import pyarrow as pa

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        found, ends = Counter(), 0
        for part in chunks(batches):
            for raw in part.column("text"):
                found.update(words_of(raw.as_py() or b""))
                ends += 1
            if len(found) > COUNTED:
                yield out(found)
                found.clear()
        if ends:
            found[END] = ends
        yield out(found)

    words = stored(train.select("text").mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "words")
    row = words.agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("distinct"), F.max(F.when(F.col("word") == F.lit(END), F.col("c"))).alias("ends")).first()
    short = words.where((F.col("word") != F.lit(END)) & (F.octet_length("word") <= HEAD_BYTES))
    # How many words have each count: the least count that at most HEAD words reach.
    cut, above = None, 0
    for r in short.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).toLocalIterator():
        if above + r["n"] > HEAD:
            break
        above, cut = above + r["n"], r["c"]
    head = [] if cut is None else short.where(F.col("c") >= cut).collect()
    head.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    return Counts(words, row["total"] or 0, row["distinct"], row["ends"] or 0, [bytes(r["word"]) for r in head], np.array([r["c"] for r in head], np.int64), cut)


def _classes(text: bytes, number: dict[bytes, int], closed: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, their place in the head (-1: not there), and their classes with two starts before
    and the end behind."""
    w = words_of(text)
    at = np.fromiter(map(number.get, w, repeat(-1)), np.int64, len(w))
    line = np.empty(len(w) + 3, np.int64)
    line[:2], line[-1] = closed + 2, closed + 1
    line[2:-1] = np.where((at < 0) | (at >= closed), closed, at)
    return w, at, line


def count_triples(train: DataFrame, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of class triples; at most (closed + 3) ** 3 reach the driver."""
    closed = counts.closed
    number, base = {w: i for i, w in enumerate(counts.head[:closed])}, closed + 3

    def work(batches):
        import pyarrow as pa

        total = np.zeros(base**3, np.int64)
        for part in chunks(batches):
            codes = []
            for raw in part.column("text"):
                line = _classes(raw.as_py() or b"", number, closed)[2]
                codes.append((line[:-2] * base + line[1:-1]) * base + line[2:])
            total += np.bincount(np.concatenate(codes), minlength=base**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])

    found = train.select("text").mapInArrow(work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toPandas()
    return found["code"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def _vectors(rng: np.random.Generator, outputs: int) -> dict[str, np.ndarray]:
    small = lambda *s: rng.normal(0, 0.1, s)
    return {"r": small(outputs + 1, DIM), "q": small(outputs, DIM), "c1": np.eye(DIM) + small(DIM, DIM), "c2": np.eye(DIM) * 0.5 + small(DIM, DIM)}


def train_model(codes: np.ndarray, n: np.ndarray, closed: int, steps: int = STEPS, seed: int = SEED) -> np.ndarray:
    """``log10 P(class | two classes before)`` as an array (contexts, classes): the trained model,
    normalised.  Classes: the closed vocabulary, others, the end; contexts also the start."""
    outputs, base = closed + 2, closed + 3
    if not len(codes):
        return np.full((base * base, outputs), -np.log10(outputs))
    rng = np.random.default_rng(seed)
    a, b, w = codes // (base * base), codes // base % base, codes % base
    share = np.bincount(w, weights=n, minlength=outputs)[:outputs] + 0.5
    share /= share.sum()
    p, bias = _vectors(rng, outputs), np.log(share)
    p["b"] = bias.copy()
    seen = {k: np.full_like(v, 1e-6) for k, v in p.items()}
    upto, log_noise = np.cumsum(n), np.log(NOISE * share)
    noise_upto = np.cumsum(share)
    for step in range(steps):
        pick = np.searchsorted(upto, rng.integers(0, upto[-1], BATCH), side="right")
        x, y = a[pick], b[pick]
        noise = np.minimum(np.searchsorted(noise_upto, rng.random((BATCH, NOISE))), outputs - 1)
        cand = np.concatenate([w[pick][:, None], noise], axis=1)  # true class first
        rx, ry, q = p["r"][x], p["r"][y], p["q"][cand]
        h = rx @ p["c2"] + ry @ p["c1"]
        s = np.einsum("bd,bkd->bk", h, q) + p["b"][cand] - log_noise[cand]
        g = 1 / (1 + np.exp(-np.clip(s, -30, 30)))  # d loss / d s of a noise class
        g[:, 0] -= 1
        g /= BATCH
        gh = np.einsum("bk,bkd->bd", g, q)
        one_hot = np.zeros_like(p["q"])
        np.add.at(one_hot, cand.ravel(), (g[:, :, None] * h[:, None, :]).reshape(-1, DIM))
        gr = np.zeros_like(p["r"])
        np.add.at(gr, x, gh @ p["c2"].T)
        np.add.at(gr, y, gh @ p["c1"].T)
        grads = {"q": one_hot, "r": gr, "c1": ry.T @ gh, "c2": rx.T @ gh, "b": np.bincount(cand.ravel(), weights=g.ravel(), minlength=outputs)}
        rate = RATE * (1 - step / steps) + 0.01
        for k, d in grads.items():
            seen[k] += d * d
            p[k] -= rate * d / np.sqrt(seen[k])
    context = (p["r"] @ p["c2"])[:, None, :] + (p["r"] @ p["c1"])[None, :, :]
    s = context.reshape(-1, DIM) @ p["q"].T + p["b"]
    s -= s.max(axis=1, keepdims=True)
    return (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)


def _places(words: list[bytes], at: np.ndarray, head: int, buckets: int) -> np.ndarray:
    """The place in the head, or behind it the bucket, of every word."""
    out, far = at.copy(), np.flatnonzero(at < 0)
    out[far] = [head + zlib.crc32(words[i]) % buckets for i in far.tolist()]
    return out


def bucket_masses(counts: Counts) -> np.ndarray:
    """Smoothed counts of the words outside the head by bucket, with half a word for those unseen."""
    tail = max(counts.distinct - len(counts.head) - (counts.ends > 0), 0)
    buckets = min(BUCKETS, max(1, -(-tail // BUCKET_WORDS)))
    out = np.full(buckets, 0.5)
    outside = (F.octet_length("word") > HEAD_BYTES) | (F.lit(True) if counts.cut is None else F.col("c") < counts.cut)
    rows = counts.words.where((F.col("word") != F.lit(END)) & outside)
    for r in rows.groupBy((F.crc32("word") % buckets).alias("at")).agg((F.sum("c") + 0.5 * F.count(F.lit(1))).alias("mass")).collect():
        out[r["at"]] += float(r["mass"])
    return out


@dataclass
class Own:
    """The model inside the class of others.  ``table``: the vectors of all contexts (head, buckets,
    start), of all words predicted (head beyond the closed vocabulary, buckets), of their groups, each with
    its bias behind, and the matrices of the two positions.  ``share``: of every word predicted;
    ``group``: its group, in ascending order."""

    table: np.ndarray
    share: np.ndarray
    group: np.ndarray
    contexts: int

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = np.cumsum([self.contexts, len(self.share), self.group[-1] + 1, DIM, DIM])
        r, q, g, c2, c1 = np.split(self.table, at[:-1])
        return r[:, :DIM], q, g, c2[:, :DIM], c1[:, :DIM]


def own_start(share: np.ndarray, contexts: int, seed: int = SEED) -> Own:
    """A model that knows the shares alone.  Groups have equal sums of the roots of their words' shares,
    which makes a word's group and place cheapest to normalise."""
    share = share / share.sum()
    upto = np.cumsum(np.sqrt(share))
    group = np.unique(np.ceil(upto / upto[-1] * np.ceil(upto[-1])), return_inverse=True)[1]
    table = np.zeros((contexts + len(share) + group[-1] + 1 + 2 * DIM, DIM + 1), np.float32)
    own = Own(table, share, group, contexts)
    r, q, g, c2, c1 = own.parts()
    r[:] = np.random.default_rng(seed).normal(0, 0.3, r.shape)
    q[:, DIM], g[:, DIM] = np.log(share), np.log(np.bincount(group, weights=share))
    c2[:], c1[:] = 0.5 * np.eye(DIM), np.eye(DIM)
    return own


def _move(table: np.ndarray, seen: np.ndarray, hits: np.ndarray, at: np.ndarray, grads: np.ndarray) -> None:
    """One step of the rows ``at`` of ``table``, which may repeat."""
    np.add.at(seen, at, np.einsum("nd,nd->n", grads, grads) / grads.shape[1])
    np.add.at(hits, at, np.float32(1))
    grads *= (-OWN_RATE / np.sqrt(seen[at]))[:, None]
    np.add.at(table.reshape(-1), (at[:, None] * table.shape[1] + np.arange(grads.shape[1])).ravel(), grads.ravel())


def learner(own: Own, seed: int | list[int] = SEED) -> tuple[Callable[[np.ndarray, np.ndarray, np.ndarray], None], np.ndarray]:
    """A function that moves ``own`` by triples (two contexts, a word predicted), and how often it has
    moved each row of the table."""
    table = own.table
    r, q, g, c2, c1 = own.parts()
    rng, hits = np.random.default_rng(seed), np.zeros(len(table), np.float32)
    seen = np.full(len(table), OWN_SEEN, np.float32)
    words, groups = len(r), len(r) + len(q)
    upto = np.cumsum(own.share)
    noise_q = np.log(SHARED * own.share).astype(np.float32)
    noise_g = np.log(SHARED * np.bincount(own.group, weights=own.share)).astype(np.float32)

    def chance(s):
        """The logistic function, in place."""
        with np.errstate(over="ignore"):  # then the limit is right
            np.exp(np.negative(s, out=s), out=s)
        s += 1
        return np.reciprocal(s, out=s)

    def learn(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        order = rng.permutation(len(x))
        for lo in range(0, len(x), PART):
            pick = order[lo : lo + PART]
            a, b, u = x[pick], y[pick], w[pick]
            rx, ry = r[a], r[b]
            h = np.ones((len(pick), DIM + 1), np.float32)
            h[:, :DIM] = rx @ c2 + ry @ c1
            drawn = np.minimum(np.searchsorted(upto, rng.random(SHARED) * upto[-1]), len(upto) - 1)
            gh = np.zeros_like(h)
            for p, start, log_noise, one, others in ((q, words, noise_q, u, drawn), (g, groups, noise_g, own.group[u], own.group[drawn])):
                true, noise = p[one], p[others]
                gt = chance(np.einsum("bd,bd->b", h, true) - log_noise[one]) - 1  # d loss / d s
                gn = chance(h @ noise.T - log_noise[others])
                gh += gt[:, None] * true + gn @ noise
                # The biases stay: they are the smoothed shares.
                _move(table, seen, hits, start + np.concatenate([one, others]), np.concatenate([gt[:, None] * h[:, :DIM], gn.T @ h[:, :DIM]]))
            gh = gh[:, :DIM]
            moves = [(c2, rx.T @ gh), (c1, ry.T @ gh)]
            _move(table, seen, hits, np.concatenate([a, b]), np.concatenate([gh @ c2.T, gh @ c1.T]))
            for k, (c, d) in enumerate(moves):
                rows = slice(len(table) + (k - 2) * DIM, len(table) + (k - 1) * DIM)
                seen[rows] += (d * d).mean(axis=1)
                hits[rows] += len(pick)
                c -= OWN_RATE * d / np.sqrt(seen[rows])[:, None]

    return learn, hits


def own_logs(own: Own) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives ``log10 P(word | others, two contexts)``, normalised over all words of others."""
    r, q, g, c2, c1 = own.parts()
    first = np.searchsorted(own.group, np.arange(len(g) + 1))

    def logs(h: np.ndarray, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.empty(0)
        out, step, one = np.empty(len(h)), max(1, CELLS // len(p)), np.ones(len(p), np.float32)
        longest = lambda v: float(np.sqrt(np.einsum("nd,nd->n", v[:, :DIM], v[:, :DIM]).max()))
        # The products and biases stay within what float32 has.
        safe = longest(h) * longest(p) < 40 and p[:, DIM].min() > -40
        for lo in range(0, len(h), step):
            s = h[lo : lo + step] @ p.T
            if not safe:
                s -= s.max(axis=1, keepdims=True)
            hit = s[np.arange(len(s)), at[lo : lo + step]]
            out[lo : lo + step] = hit - np.log(np.exp(s, out=s) @ one)
        return out

    def found(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.empty(len(w))
        order = np.argsort(w, kind="stable")
        h = np.ones((len(w), DIM + 1), np.float32)
        h[:, :DIM] = r[x[order]] @ c2 + r[y[order]] @ c1
        line = w[order]
        value = logs(h, g, own.group[line])
        cuts = np.searchsorted(line, first)
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            rows = slice(cuts[k], cuts[k + 1])
            value[rows] += logs(h[rows], q[first[k] : first[k + 1]], line[rows] - first[k])
        out[order] = value / np.log(10)
        return out

    return found


def train_own(train: DataFrame, counts: Counts, masses: np.ndarray) -> Own:
    """One pass of tasks over every training triple that ends in a word of others.  A task begins
    with the same vectors and sends those it moved, so there are only as many tasks that each has
    ROW_TOKENS tokens a vector; a vector becomes the mean of theirs, weighted by their moves."""
    closed, head, buckets = counts.closed, len(counts.head), len(masses)
    share, contexts = np.concatenate([counts.head_counts[closed:] + 0.5, masses]), head + buckets + 1
    own, number = own_start(share, contexts), {w: i for i, w in enumerate(counts.head)}
    rows, width = len(own.table), DIM + 1
    tasks = max(1, counts.total // (ROW_TOKENS * rows))

    def work(batches):
        import pyarrow as pa

        mine = own_start(share, contexts)
        at_start = mine.table.copy()
        learn, hits = learner(mine, [SEED, TaskContext.get().partitionId()])
        for part in chunks(batches):
            lines = []
            for raw in part.column("text"):
                w, at, _ = _classes(raw.as_py() or b"", number, closed)
                lines += [np.full(2, contexts - 1), _places(w, at, head, buckets)]
            line = np.concatenate(lines)
            to = np.flatnonzero((line >= closed) & (line < contexts - 1))
            learn(line[to - 2], line[to - 1], line[to] - closed)
        for k in range(0, rows, BLOCK):
            n = hits[k : k + BLOCK]
            if n.any():
                moved = (mine.table[k : k + BLOCK] - at_start[k : k + BLOCK]) * n[:, None]
                yield pa.RecordBatch.from_pydict({"block": [k], "n": [n.tobytes()], "moved": [moved.tobytes()]})

    def total(key, parts):
        import pyarrow as pa

        n, moved = 0.0, 0.0
        for one, by in zip(parts.column("n"), parts.column("moved"), strict=True):
            n = n + np.frombuffer(one.as_py(), np.float32)
            moved = moved + np.frombuffer(by.as_py(), np.float32).astype(float).reshape(-1, width)
        mean = (moved / np.maximum(n, 1)[:, None]).astype(np.float32)
        return pa.Table.from_pydict({"block": [key[0].as_py()], "mean": [mean.tobytes()]})

    sent = train.select("text").coalesce(tasks).mapInArrow(work, "block long, n binary, moved binary")
    for r in sent.groupBy("block").applyInArrow(total, "block long, mean binary").collect():
        mean = np.frombuffer(r["mean"], np.float32).reshape(-1, width)
        own.table[r["block"] : r["block"] + len(mean)] += mean
    return own


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row per document."""
    rows = docs.select(F.col(key).alias("key"), held_out(key).alias("held_out"), utf8(text).alias("text"))
    train = rows.where(~F.col("held_out"))
    counts = count_words(train)
    table = train_model(*count_triples(train, counts), counts.closed).astype(np.float32)
    closed, total, ends = counts.closed, counts.total, counts.ends
    number = {w: i for i, w in enumerate(counts.head)}
    logs = np.log10(counts.head_counts + 0.5)
    floor = float(np.log10(total + 0.5 * (counts.distinct + 1)))
    masses = bucket_masses(counts)
    own, head, buckets = train_own(train, counts, masses), len(counts.head), len(masses)
    bucket_logs, contexts = np.log10(masses), own.contexts
    end_log, base = float(np.log10(ends + 0.5)), closed + 3

    def work(batches):
        import pyarrow as pa

        inside = own_logs(own)
        for part in chunks(batches):
            n, known, summed, scored, offsets, tail, tail_n, lines = [], [], [], [], [0], [], [], []
            for raw in part.column("text"):
                w, at, line = _classes(raw.as_py() or b"", number, closed)
                inner = at[at >= 0]
                rest = Counter([w[i] for i in np.flatnonzero(at < 0).tolist()])
                n.append(len(w) + 1)
                known.append(len(inner) + (ends > 0))
                summed.append(float(logs[inner].sum()) + end_log)
                steps = table[line[:-2] * base + line[1:-1], line[2:]]
                scored.append(float(steps.sum(dtype=np.float64)))
                lines += [np.full(2, contexts - 1), _places(w, at, head, buckets)]
                tail += rest.keys()
                tail_n += rest.values()
                offsets.append(len(tail))
            places = np.concatenate(lines)
            to = np.flatnonzero((places >= closed) & (places < contexts - 1))
            value = inside(places[to - 2], places[to - 1], places[to] - closed)
            # A word of a bucket has its share of it; its own count follows by the join.
            far = places[to] >= head
            value[far] -= bucket_logs[places[to][far] - head]
            doc = np.repeat(np.arange(len(n)), np.array(n) + 1)[to]  # two starts, no end
            scored = np.array(scored) + np.bincount(doc, weights=value, minlength=len(n))
            pairs = pa.StructArray.from_arrays([pa.array(tail, pa.binary()), pa.array(tail_n, pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("key"), part.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(summed), pa.array(scored), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)],
                ["row", "key", "held_out", "n_tokens", "known", "summed", "scored", "tail"])

    kind = docs.schema[key].dataType.simpleString()
    near = stored(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        work, f"row long, key {kind}, held_out boolean, n_tokens long, known long, summed double, scored double, "
              "tail array<struct<word:binary,n:long>>"), "scored")
    tails = near.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    far = tails.join(counts.words, "word", "left").select(
        "row", F.when(F.col("c") > 0, F.col("n")).otherwise(F.lit(0)).alias("known"),
        (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("summed"))
    parts = near.select("row", "key", "held_out", "n_tokens", "known", "summed", "scored").unionByName(
        far.select("row", F.lit(None).cast(kind).alias("key"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"),
                   "known", "summed", F.col("summed").alias("scored")))
    whole = parts.groupBy("row").agg(
        F.max("key").alias(key), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"),
        F.sum("summed").alias("summed"), F.sum("scored").alias("score"))
    return whole.select(
        key, "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("summed") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score")
