"""Benchmark decontamination: rare n-grams as seeds that join documents to test items,
Smith-Waterman alignment of what they join.

Words are what is left of a text with A-Z lower-cased and ASCII punctuation taken as space.  A
filter of the items' 3-grams (at most ``FILTER_BITS`` bits, whatever the benchmark holds) goes to
the tasks; the documents' grams that pass it are counted by document.  A gram is a seed when some
document holds it and at most ``RARE_DOCS`` documents or one in ``RARE_PART`` do.  A stretch of
``STRETCH`` grams of an item without such a gram keeps its rarest, ties together.  So a copy is
found if three words in a row of it are rare, or a whole stretch is intact; what has neither is not
found.  An item of fewer words than a seed is one seed itself.

Seeds join the documents by a shuffle on the gram, those of many documents as a broadcast head;
the pairs bring the item to the document, whose text travels once, and are aligned around their
seeds (match 2, mismatch and gap -1).  Nothing is capped: a document may match any number of items,
an item any number of documents, and neither table reaches the driver.

A passage counts when its score reaches half of the item's, or that of 50 matching words; items
of fewer than 8 words must be matched wholly.

Defined results: NULL and empty texts hold nothing, NULL and empty items are in nothing; repeated
documents and items are reported each; of equal alignments the first is taken; other columns are
ignored.  With an empty table on either side there are no rows.  Words that repeat in an item and
a document make one range of places a gram, so memory follows the texts' lengths.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalis.llm.common import chunks, stored, utf8
from vocalis.session import broadcast_if_small

SEED_WORDS, STRETCH = 3, 3
RARE_DOCS, RARE_PART = 100, 100
MATCH, MISS = 2, -1
SHARE, LONG_WORDS, SHORT_WORDS = 0.5, 50, 8
FILTER_BITS, BITS_A_GRAM, PROBES = 26, 32, 4
#: Word hashes a task remembers.
REMEMBERED = 300_000
#: ASCII letters lower-cased, punctuation and control characters to spaces.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
START_BITS = 32
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Hashes(dict):
    """Words to 64-bit hashes."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def gram_codes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code of the ``size`` words that start at every place but the last ones."""
    n = max(len(hashes) - size + 1, 0)
    code = np.full(n, size, np.uint64)
    for k in range(size):
        code = (code ^ hashes[k : k + n]) * ODD[k]
        code ^= code >> np.uint64(31)
    return code


def probes(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of a filter of ``2 ** bits`` that a code sets."""
    return [(codes * odd) >> np.uint64(64 - bits) for odd in ODD[:PROBES]]


def passing(codes: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """Places of the codes whose bits the filter all holds."""
    at = np.arange(len(codes))
    for odd in ODD[:PROBES]:
        bit = (codes[at] * odd) >> np.uint64(64 - bits)
        at = at[(words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
    return at


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: (score, start, stop) of the best local alignment within ``text``.

    A cell holds its score and, in the low bits, the earlier the start the larger, so one
    maximum decides both.  Gaps along the text are a running maximum."""
    one, low = 1 << START_BITS, (1 << START_BITS) - 1
    n = len(text)
    j = np.arange(n, dtype=np.int64)
    fresh = low - j  # an alignment that would start at j
    slope = -MISS * one * j
    above = np.append(fresh, low - n)  # row before the first: column j stands before word j
    best = (0, 0, 0)
    for word in item.tolist():
        step = np.where(text == word, MATCH * one, MISS * one)
        row = np.maximum(above[:-1] + step, above[1:] + MISS * one)
        row = np.maximum.accumulate(row + slope) - slope
        row = np.maximum(row, low - (j + 1))
        k = int(np.argmax(row >> START_BITS))
        score = int(row[k] >> START_BITS)
        if score > best[0]:
            best = (score, low - int(row[k] & low), k + 1)
        above = np.append(np.int64(low), row)
    return best


def needed(words: int) -> float:
    """Least score of an item of so many words."""
    return MATCH * (words if words < SHORT_WORDS else min(SHARE * words, LONG_WORDS))


def ranges(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, first, last) of the places ``at``; one code at neighbouring places is one range."""
    if not len(at):
        return np.empty(0, np.uint64), at, at
    same = (np.diff(at) == 1) & (codes[at][1:] == codes[at][:-1])
    first, last = np.append(True, ~same), np.append(~same, True)
    return codes[at[first]], at[first], at[last]


def stretches(hits: list[tuple[int, int, int, int]], size: int, limit: int) -> list[tuple[int, int]]:
    """Parts of a text of ``limit`` words that seeds of an item of ``size`` words speak for, joined
    where they overlap.

    A seed at p in the text and q in the item speaks for words p - q - size/2 to p - q + 3 size/2.
    These overlap for neighbouring places, so the first and last of either give their union."""
    out: list[list[int]] = []
    for lo, hi in sorted((max(p - last - size // 2 - 1, 0), min(to - first + size + size // 2 + 1, limit)) for p, to, first, last in hits):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def passages(item: np.ndarray, numbers: np.ndarray, hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(score, start, stop) of every passage of an item around its seeds, in words; ``hits`` are
    the first and last place of a seed in the text and in the item."""
    size = len(item)
    if size < SEED_WORDS:
        return [(MATCH * size, p, p + size) for a, b, _, _ in hits for p in range(a, b + 1) if (numbers[p : p + size] == item).all()]
    out, least, todo = [], needed(size), stretches(hits, size, len(numbers))
    own, often = np.unique(item[item >= 0], return_counts=True)
    if MATCH * len(item[item >= 0]) < least:
        return []
    while todo:
        lo, hi = todo.pop()
        part = numbers[lo:hi]
        there = np.bincount(part, minlength=own[-1] + 1)[own]
        if MATCH * int(np.minimum(there, often).sum()) < least:
            continue  # every word matches once at most: an upper bound of the score
        score, start, stop = align(item, part)
        if score >= least:
            out.append((score, lo + start, lo + stop))
            todo += [(lo, lo + start), (lo + stop, hi)]
    return out


def _item_grams(items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """``item, item_key, words, size, grams``: the plain words of every item that has any, and
    its grams in order."""

    def work(batches):
        import pyarrow as pa

        known = Hashes()
        for part in chunks(batches):
            words = [words_of(raw.as_py()) for raw in part.column("text")]
            grams = [gram_codes(np.array([known[x] for x in w], np.uint64), min(len(w), SEED_WORDS)).view(np.int64) if w else [] for w in words]
            yield pa.RecordBatch.from_arrays(
                [part.column("item"), part.column("item_key"), pa.array([b" ".join(w) for w in words], pa.binary()),
                 pa.array([len(w) for w in words], pa.int32()), pa.array(grams, pa.list_(pa.int64()))],
                ["item", "item_key", "words", "size", "grams"])

    kind = items.schema[item_key].dataType.simpleString()
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_key).alias("item_key"), utf8(item_text).alias("text"))
    return stored(rows.mapInArrow(work, f"item long, item_key {kind}, words binary, size int, grams array<long>").where("size > 0"), "items")


def _filter(grams: DataFrame, bits: int) -> np.ndarray:
    """The filter of the grams as 64-bit words; the tasks' parts are united by a shuffle."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            bit = np.concatenate(probes(batch.column(0).to_numpy().view(np.uint64), bits))
            slots, at = np.unique(bit >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(slots), np.uint64)
            np.bitwise_or.at(value, at, np.uint64(1) << (bit & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(value.view(np.int64))], ["slot", "value"])

    found = grams.mapInArrow(work, "slot long, value long").groupBy("slot").agg(F.expr("bit_or(value)").alias("value")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["slot"].to_numpy(np.int64)] = found["value"].to_numpy(np.int64).view(np.uint64)
    return out


def _near(rows: DataFrame, words: np.ndarray, bits: int, sizes: list[int]) -> DataFrame:
    """The rows with a gram that passes the filter: ``row, key, text, hits`` (gram, first, last)."""

    def work(batches):
        import pyarrow as pa

        known = Hashes()
        for part in chunks(batches):
            keep, counts, found = [], [], []
            for i, raw in enumerate(part.column("text")):
                w = words_of(raw.as_py())
                own = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
                hits = []
                for size in sizes:
                    codes = gram_codes(own, size)
                    at = passing(codes, words, bits)
                    if len(at):
                        hits.append(ranges(codes, at))
                if hits:
                    keep.append(i)
                    counts.append(sum(len(h[0]) for h in hits))
                    found += hits
            if not keep:
                continue
            columns = [np.concatenate([h[k] for h in found]) for k in range(3)]
            pairs = pa.StructArray.from_arrays(
                [pa.array(columns[0].view(np.int64)), pa.array(columns[1].astype(np.int32)), pa.array(columns[2].astype(np.int32))], ["gram", "first", "last"])
            hits = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pairs)
            some = part.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([some.column("row"), some.column("key"), some.column("text"), hits], ["row", "key", "text", "hits"])

    kind = rows.schema["key"].dataType.simpleString()
    return stored(rows.mapInArrow(work, f"row long, key {kind}, text binary, hits array<struct<gram:long,first:int,last:int>>"), "near")


def choose_seeds(grams: DataFrame, counts: DataFrame, rare: int) -> DataFrame:
    """``gram, item, q_first, q_last, n``: the seeds of every item.

    ``grams``: ``item, at, gram``; ``counts``: ``gram, n``, the documents that hold a gram.  Seeds
    are the grams of at most ``rare`` documents, and the rarest ones of stretches without."""
    line = Window.partitionBy("item").orderBy("at")
    n = F.col("n")
    out = grams.join(counts, "gram", "left")
    for k in range(STRETCH):
        out = out.withColumn(f"_{k}", F.min("n").over(line.rowsBetween(-k, STRETCH - 1 - k)))
    rarest = F.greatest(*[F.col(f"_{k}") for k in range(STRETCH)]) == n
    return out.where(n.isNotNull() & ((n <= rare) | rarest)).groupBy("gram", "item").agg(
        F.min("at").alias("q_first"), F.max("at").alias("q_last"), F.first("n").alias("n"))


def _pairs(near: DataFrame, items: DataFrame, documents: int) -> DataFrame:
    """``row, item, hits``: the documents and items that share seeds, and where."""
    hits = near.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    counts = near.select(F.explode(F.array_distinct("hits.gram")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = max(RARE_DOCS, documents // RARE_PART)
    seeds = stored(choose_seeds(items.select("item", F.posexplode("grams").alias("at", "gram")), counts, rare), "seeds")
    common = F.col("n") > rare
    # A gram of many documents would make one hot partition; such seeds are few, and checked to be.
    parts = [hits.join(seeds.where(~common), "gram"), hits.join(broadcast_if_small(seeds.where(common)), "gram")]
    return parts[0].unionByName(parts[1]).groupBy("row", "item").agg(
        F.collect_list(F.struct("first", "last", "q_first", "q_last")).alias("hits"))


def _found(rows: DataFrame, items: DataFrame, item_key: str, item_text: str) -> DataFrame | None:
    """``key, item, score, similarity, start, stop`` of every passage in ``row, key, text``; None
    without any item."""
    from pyspark.sql.pandas.types import to_arrow_type

    lines = _item_grams(items, item_key, item_text)
    whole = lines.agg(F.sum(F.size("grams")).alias("n"), F.collect_set(F.least("size", F.lit(SEED_WORDS))).alias("sizes")).first()
    if not whole["n"]:
        return None
    bits = int(np.clip(int(whole["n"] * BITS_A_GRAM - 1).bit_length(), 10, FILTER_BITS))
    words = _filter(lines.select(F.explode("grams").alias("gram")), bits)
    near = _near(rows, words, bits, sorted(whole["sizes"]))
    pairs = stored(_pairs(near, lines, rows.count()), "pairs")
    asked = pairs.join(broadcast_if_small(lines.select("item", "item_key", "words")), "item")
    texts = near.join(broadcast_if_small(pairs.select("row").distinct()), "row", "left_semi").drop("hits")
    both = texts.unionByName(asked, allowMissingColumns=True).select("row", "key", "text", "item", "item_key", "words", "hits")
    key_type, item_type = (to_arrow_type(both.schema[c].dataType) for c in ("key", "item_key"))

    def work(batches):
        import re

        import pyarrow as pa

        word = re.compile(rb"[^ ]+")
        row = key = body = numbers = known = None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                if not batch.column("item")[i].is_valid:  # the document comes before its items
                    row, key, body = (batch.column(c)[i].as_py() for c in ("row", "key", "text"))
                    known = {}
                    numbers = np.array([known.setdefault(x, len(known)) for x in words_of(body)], np.int64)
                    continue
                assert batch.column("row")[i].as_py() == row
                own = np.array([known.get(x, -1) for x in batch.column("words")[i].as_py().split()], np.int64)
                hits = [(h["first"], h["last"], h["q_first"], h["q_last"]) for h in batch.column("hits")[i].as_py()]
                found = sorted(passages(own, numbers, hits), key=lambda x: x[1])
                if not found:
                    continue
                at = [m.span() for m in word.finditer(body.translate(PLAIN))]
                points = lambda b, body=body: len(body[:b].decode("utf-8", "replace"))
                out += [(key, batch.column("item_key")[i].as_py(), score, score / (MATCH * len(own)), points(at[lo][0]), points(at[hi - 1][1])) for score, lo, hi in found]
            if out:
                types = (key_type, item_type, pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                    ["key", "item", "score", "similarity", "start", "stop"])

    kinds = [both.schema[c].dataType.simpleString() for c in ("key", "item_key")]
    return both.repartition("row").sortWithinPartitions("row", F.asc_nulls_first("item")).mapInArrow(
        work, f"key {kinds[0]}, item {kinds[1]}, score long, similarity double, start long, stop long")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                 item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, item_key, score, similarity, start, stop``: one row per passage of a document that
    aligns with an item; ``similarity`` is the share of the item's full score, ``start`` and
    ``stop`` are code points of the document's text."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), utf8(text).alias("text"))
    found = _found(rows, items, item_key, item_text)
    if found is None:
        kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
        found = docs.sparkSession.createDataFrame([], f"key {kinds[0]}, item {kinds[1]}, score long, similarity double, start long, stop long")
    return found.withColumnsRenamed({"key": key, "item": item_key})


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` less those that hold a passage of an item.  The rows are stored with a number."""
    number = "_row"
    while number in docs.columns:
        number += "_"
    whole = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = _found(whole.select(F.col(number).alias("row"), F.col(number).alias("key"), utf8(text).alias("text")), items, item_key, item_text)
    if found is None:
        return whole.drop(number)
    bad = stored(found.select(F.col("key").alias(number)).distinct(), "contaminated")
    return whole.join(broadcast_if_small(bad), number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
