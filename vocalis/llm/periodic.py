"""Periodic runs of words inside a document, by seeds and extension on diagonals.

A run is a stretch of consecutive words whose words ``period`` apart are identical, ``period``
being the smallest such number, that is at least ``min_length`` words and ``min_exponent``
periods long and that no neighbouring word extends.

On its diagonal (the pairs of words one period apart) a run matches for ``length - period`` words,
so at least ``k`` words for periods up to ``k``, where ``k`` is the least overlap that the limits
guarantee, and at least twice the period beyond.  Grams of ``k``, ``2k``, ``4k`` ... words are
indexed, each built from two overlapping grams of the size before; a gram found once in its
document cannot start a larger one that repeats and leaves the index.  Grams of ``g`` words seed the
periods in ``(g / 2, g]`` (the shortest grams all up to ``k``).  Of a gram's occurrences only
neighbours are paired: where a run starts, its gram comes again one period later and, two periods
that overlap so far having their common divisor as a period too, not before.  The pairs of a
document are thus at most its words times the number of gram sizes, also for one word repeated.
A pair is a seed on the diagonal of its lag; the per-lag table of the furthest place covered
suppresses seeds inside a stretch already extended.

Documents are independent; a task holds the words of about ``CHUNK_BYTES`` of texts, or of one
longer text, at a time.

Defined results: a NULL or empty text has no words and no runs; repeated rows and NULL ids are kept
and treated each for itself; runs are ordered by start, then period; other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.common import chunks, utf8

MIN_LENGTH, MIN_EXPONENT = 24, 3
RUNS = "array<struct<start:long,length:long,period:long>>"


def guaranteed_overlap(min_length: int, min_exponent: int) -> int:
    """Words that every run matches with itself one period on."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, max(min_length, 1) + 1))


def _repeated(codes: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose code occurs again, and a dense number of the code at every place of ``size``
    (-1: none)."""
    _, number, count = np.unique(codes, return_inverse=True, return_counts=True)
    keep = count[number] > 1
    rank = np.full(size, -1, np.int64)
    rank[places[keep]] = number[keep]
    return places[keep], rank


def _longer(places: np.ndarray, rank: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """The index of grams ``by`` words longer than those of ``rank``."""
    n = len(rank)
    places = places[places + by < n]
    places = places[rank[places + by] >= 0]
    return _repeated(rank[places] * n + rank[places + by], places, n)


def _equal_ahead(x: np.ndarray, a: int, b: int) -> int:
    """How many words from ``a`` on equal those from ``b`` on (``a < b``)."""
    done, block = 0, 64
    while b + done < len(x):
        m = min(block, len(x) - b - done)
        differ = np.flatnonzero(x[a + done : a + done + m] != x[b + done : b + done + m])
        if len(differ):
            return done + int(differ[0])
        done, block = done + m, block * 2
    return done


def _equal_behind(x: np.ndarray, a: int, b: int) -> int:
    """How many words before ``a`` equal those before ``b`` (``a < b``)."""
    done, block = 0, 64
    while done < a:
        m = min(block, a - done)
        differ = np.flatnonzero(x[a - done - m : a - done] != x[b - done - m : b - done])
        if len(differ):
            return done + m - 1 - int(differ[-1])
        done, block = done + m, block * 2
    return done


def runs_of(x: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run in the numbered words ``x``, ordered by start and
    period.  Words of different documents must bear different numbers."""
    if min_exponent < 3:
        raise ValueError("runs of fewer than three periods have no guaranteed overlap of one period")
    gram, found = guaranteed_overlap(min_length, min_exponent), []
    places, rank = _repeated(x, np.arange(len(x)), len(x))
    size = 1
    while size < gram and len(places):
        by = min(size, gram - size)
        places, rank = _longer(places, rank, by)
        size += by
    shortest = 0  # periods up to here belong to shorter grams
    while len(places):
        order = np.argsort(rank[places], kind="stable")
        at = places[order]
        same = rank[at[1:]] == rank[at[:-1]]
        first, lag = at[:-1][same], (at[1:] - at[:-1])[same]
        fits = (lag > shortest) & (lag <= gram)
        first, lag = first[fits], lag[fits]
        order = np.argsort(first, kind="stable")
        furthest: dict[int, int] = {}
        for i, d in zip(first[order].tolist(), lag[order].tolist(), strict=True):
            if i < furthest.get(d, 0):
                continue
            start = i - _equal_behind(x, i, i + d)
            end = i + d + gram + _equal_ahead(x, i + gram, i + d + gram)
            furthest[d] = end - d
            if end - start >= max(min_length, min_exponent * d):
                found.append((start, end - start, d))
        shortest = gram
        places, rank = _longer(places, rank, gram)
        gram *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _numbered(documents: list[list[bytes]]) -> np.ndarray:
    """Words of all documents in a row, numbered; no two documents share a number."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for words in documents for w in words], np.int64)
    owner = np.repeat(np.arange(len(documents)), [len(words) for words in documents])
    return owner * max(len(known), 1) + ids


def with_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
    words: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``key, n_words, runs, collapsed``: one row per document.  ``runs`` holds start, length and
    period in words; ``collapsed`` is the text (UTF-8) of the words, joined by one space, without
    those that any run contains after its first period.  ``words(key, words)`` may change the words
    of a document first."""

    def work(batches):
        import pyarrow as pa

        for part in chunks(batches):
            documents = [(raw.as_py() or b"").split() for raw in part.column("text")]  # separators 9 to 13 and 32
            if words is not None:
                documents = [words(k.as_py(), w) for k, w in zip(part.column("key"), documents, strict=True)]
            upto = np.cumsum([0, *map(len, documents)])
            found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
            for start, length, period in runs_of(_numbered(documents), min_length, min_exponent):
                doc = int(np.searchsorted(upto, start, side="right")) - 1
                found[doc].append((start - int(upto[doc]), length, period))
            collapsed = []
            for w, runs in zip(documents, found, strict=True):
                if runs:
                    keep = np.ones(len(w), bool)
                    for start, length, period in runs:
                        keep[start + period : start + length] = False
                    w = [w[i] for i in np.flatnonzero(keep).tolist()]
                collapsed.append(b" ".join(w))
            flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array([len(w) for w in documents], pa.int64()), pa.ListArray.from_arrays(ends, items), pa.array(collapsed, pa.binary())],
                ["key", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(work, f"key {kind}, n_words long, runs {RUNS}, collapsed binary").withColumnRenamed("key", key)


def looped(key: object, words: list[bytes]) -> list[bytes]:
    """Words of a document whose tail repeats, for one document in ten by the checksum of its id;
    a NULL id changes nothing."""
    import zlib

    if key is None or not words:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * ((n - a) // p + 1))[: n - a]


def run_report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests of ``with_runs``: number of runs, the run of the greatest length over period (ties
    by smallest start, then period), and checksums of the list of runs and the collapsed text."""
    better = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    # The runs are ordered by start and period, so the first of equals stays.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), better)
    rows = found.select(F.col(key), F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.sha2(lines, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * _best.length div _best.period").alias("exponent_milli")
    return rows.select(key, "n_runs", "_best.start", "_best.length", "_best.period", exponent, "runs_sha256", "collapsed_sha256")
