"""Ranked lexical search over an index stratified by document length.

A document's score for an item sums, over the item's terms with repeats, the term's weight times an
impact that depends on the term's count in the document (``tf``) and a normaliser ``m`` that grows
with the document's length; all but the weight's logarithm is integer arithmetic.

1. Forward rows: one pass over the texts keeps every document's number of terms and its counts of
   the items' terms (no other term adds to a score).  They are stored; number and length of the
   documents and the document frequencies are aggregates of them.
2. Index: every task groups the documents of a batch by equal ``m`` into strata and the postings of
   a stratum by ``tf``; the impact of a ``tf`` is computed once in its stratum.
3. Visits: the bound of a stratum for an item takes every term at the greatest ``tf`` it has there.
   Strata are visited from the highest bound down, for the items whose bound reaches the score at
   their rank ``k`` so far, which the task carries on from batch to batch.  A stratum below it cannot
   change a result, ties included, so results are exact.

Every task sends at most ``k`` rows an item; they are merged in two rounds.  Items are read in blocks of
at most ``ITEM_BYTES`` of text, each block one pass: the number of passes grows with the items alone.

Defined results: NULL and empty texts, of items too, have no terms; an item without terms or hits has
no rows, each of several rows of one item id gets results of its own; repeated documents are
documents each; documents of equal score go by id, a NULL id last; ids are 64-bit integers, of which the
greatest stands for NULL; other columns are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalis.llm.common import chunks, stored, utf8

K = 20
#: Bytes of item texts, and items, that one pass takes; items scored together.
ITEM_BYTES, ITEMS, TOGETHER = 8 << 20, 1 << 15, 256
#: Documents of one stratum scored together.
WIDTH = 512
#: First-round groups of an item when the tasks' rows are merged.
MERGES = 64
NO_ID = (1 << 63) - 1
#: Bytes outside terms become spaces, A-Z lower case; all bytes beyond ASCII belong to terms.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


def blocks_of(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[object, Counter]]]:
    """The items in blocks that fit the driver and a task: id and counts of terms."""
    block, size = [], 0
    for r in items.select(F.col(key), utf8(text)).toLocalIterator():
        if block and (size + len(r[1]) > ITEM_BYTES or len(block) == ITEMS):
            yield block
            block, size = [], 0
        block.append((r[0], Counter(terms_of(bytes(r[1])))))
        size += len(r[1])
    if block:
        yield block


def forward_rows(docs: DataFrame, vocabulary: Sequence[bytes], key: str, text: str) -> DataFrame:
    """``key, n, terms, tfs``: terms of every document in all, and places in the vocabulary and
    counts of those it has."""
    number = {w: i for i, w in enumerate(vocabulary)}

    def work(batches):
        import pyarrow as pa

        for part in chunks(batches):
            n, terms, tfs, ends = [], [], [], [0]
            for raw in part.column("text"):
                words = terms_of(raw.as_py())
                found = Counter(map(number.get, words))
                found.pop(None, None)
                n.append(len(words))
                terms += found.keys()
                tfs += found.values()
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["key", "n", "terms", "tfs"])

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("key"), utf8(text).alias("text"))
    return rows.mapInArrow(work, "key long, n long, terms array<int>, tfs array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def normalisers(n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    return 100 - 25 + (25 * n * n_docs) // length


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Stratum:
    """Documents of one normaliser: their ids, and postings ``(term, document, tf)`` grouped by
    tf, with the impact of every tf."""

    def __init__(self, m: int, ids: np.ndarray, terms: np.ndarray, owners: np.ndarray, tfs: np.ndarray):
        self.ids = ids
        self.present, self.term = np.unique(terms, return_inverse=True)
        self.owner = owners
        values, group = np.unique(tfs, return_inverse=True)
        by_tf = impacts(values, m)
        self.impact = by_tf[group]
        self.most = np.zeros(len(self.present), np.int64)  # impacts rise with tf
        np.maximum.at(self.most, self.term, self.impact)

    def bounds(self, wanted: np.ndarray) -> np.ndarray:
        """Per item, no document here scores more (``wanted``: items by terms)."""
        return wanted[:, self.present] @ self.most.astype(wanted.dtype)

    def scores(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores (items by documents), some documents at a time."""
        own = wanted[:, self.present]
        for at in range(0, len(self.ids), WIDTH):
            here = (self.owner >= at) & (self.owner < at + WIDTH)
            ids = self.ids[at : at + WIDTH]
            table = np.zeros((len(self.present), len(ids)), wanted.dtype)
            table[self.term[here], self.owner[here] - at] = self.impact[here]
            yield ids, (own @ table).astype(np.int64)


def strata_of(key: np.ndarray, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, length: int) -> list[Stratum]:
    """Strata of a batch of forward rows; documents without any wanted term are in none."""
    if not len(terms):
        return []
    sizes = np.diff(ends)
    m = normalisers(n, n_docs, length)
    owner = np.repeat(np.arange(len(key)), sizes)
    order = np.argsort(m[owner], kind="stable")
    values, first = np.unique(m[owner][order], return_index=True)
    found = []
    for value, part in zip(values.tolist(), np.split(order, first[1:]), strict=True):
        docs, local = np.unique(owner[part], return_inverse=True)
        found.append(Stratum(value, key[docs], terms[part], local, tfs[part]))
    return found


class Best:
    """The ``k`` best documents of every item so far, equal scores by id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores = [np.empty(0, np.int64) for _ in range(items)]
        self.ids = [np.empty(0, np.int64) for _ in range(items)]
        self.least = np.ones(items, np.int64)  # only scores above zero count

    def add(self, items: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least[items][:, None]
        for row in np.flatnonzero(good.any(axis=1)).tolist():
            i, some = int(items[row]), good[row]
            s, d = np.concatenate([self.scores[i], scores[row][some]]), np.concatenate([self.ids[i], ids[some]])
            order = np.lexsort((d, -s))[: self.k]
            self.scores[i], self.ids[i] = s[order], d[order]
            if len(order) == self.k:
                self.least[i] = s[order[-1]]


def visit(strata: Sequence[Stratum], wanted: np.ndarray, items: np.ndarray, best: Best) -> int:
    """Score the strata that can matter, highest bound first; the number of (item, document)
    pairs scored."""
    if not strata:
        return 0
    bounds = np.stack([s.bounds(wanted) for s in strata]).astype(np.int64)
    done = 0
    for at in np.argsort(-bounds.max(axis=1), kind="stable").tolist():
        can = np.flatnonzero(bounds[at] >= best.least[items])
        if not len(can):
            continue
        for ids, scores in strata[at].scores(wanted[can]):
            best.add(items[can], ids, scores)
            done += scores.size
    return done


def wanted_of(block: Sequence[Counter], number: dict[bytes, int], weights: np.ndarray) -> np.ndarray:
    """Items by terms: weight times repeats.  Doubles hold every sum exactly below 2 ** 53;
    beyond, 64-bit integers do."""
    table = np.zeros((len(block), len(weights)), np.int64)
    for i, counts in enumerate(block):
        for w, c in counts.items():
            table[i, number[w]] = c * weights[number[w]]
    return table.astype(np.float64) if not table.size or int(table.sum(axis=1).max()) * 10**6 < 2**53 else table


def _search_block(docs: DataFrame, block: list[tuple[object, Counter]], kind, k: int, key: str, text: str) -> DataFrame | None:
    vocabulary = sorted(set().union(*(c for _, c in block)))
    if not vocabulary:
        return None
    forward = stored(forward_rows(docs, vocabulary, key, text), "forward")
    seen = forward.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.sum("n").alias("length")).first()
    n_docs, length = seen["n_docs"], seen["length"] or 0
    if not length:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        df[r["t"]] = r["n"]
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    ids, counts = [i for i, _ in block], [c for _, c in block]
    number = {w: i for i, w in enumerate(vocabulary)}

    def work(batches):
        import pyarrow as pa

        groups = []
        for at in range(0, len(counts), TOGETHER):
            some = counts[at : at + TOGETHER]
            local = np.unique([number[w] for c in some for w in c]).astype(np.int64)
            names = {vocabulary[t]: i for i, t in enumerate(local.tolist())}
            groups.append((np.arange(at, at + len(some)), local, wanted_of(some, names, weights[local])))
        best = Best(len(counts), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            key_, n, lists, tfs = (batch.column(c) for c in ("key", "n", "terms", "tfs"))
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            terms, counted = (x.flatten().to_numpy().astype(np.int64) for x in (lists, tfs))
            key_, n = key_.to_numpy(), n.to_numpy()
            for items, local, wanted in groups:
                place = np.full(len(vocabulary), -1, np.int64)
                place[local] = np.arange(len(local))
                mine = place[terms]
                keep = mine >= 0
                upto = np.concatenate([[0], np.cumsum(keep)])[ends]
                visit(strata_of(key_, n, upto, mine[keep], counted[keep], n_docs, length), wanted, items, best)
        rows = [len(s) for s in best.scores]
        place = np.repeat(np.arange(len(rows)), rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place), pa.array([ids[i] for i in place.tolist()], kind), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))],
            ["place", "item", "doc", "score"])

    from pyspark.sql.pandas.types import from_arrow_type

    out = forward.mapInArrow(work, f"place long, item {from_arrow_type(kind).simpleString()}, doc long, score long")
    for cell in (["place", "_part"], ["place"]):
        order = F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("score"), "doc"))
        out = (out.withColumn("_part", F.spark_partition_id() % MERGES) if "_part" in cell else out).withColumn("rank", order).where(F.col("rank") <= k)
    return out.select("item", "rank", "doc", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``item_key, rank, key, score``: the ``k`` documents of the highest score above zero for every
    item, rank from 1."""
    from pyspark.sql.pandas.types import to_arrow_type

    item_kind = items.schema[item_key].dataType
    results = None
    for block in blocks_of(items, item_key, item_text):
        found = _search_block(docs, block, to_arrow_type(item_kind), k, key, text)
        if found is not None:
            results = found if results is None else results.unionAll(found)
    if results is None:
        return docs.sparkSession.createDataFrame([], f"`{item_key}` {item_kind.simpleString()}, rank int, `{key}` long, score long")
    return results.select(F.col("item").alias(item_key), "rank", F.nullif("doc", F.lit(NO_ID)).alias(key), "score")
