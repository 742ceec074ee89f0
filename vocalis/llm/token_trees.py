"""Edit-aware token counts: a segment tree of pre-tokens per document.

A leaf holds ``LEAF`` pre-tokens, as bytes and tokens; inner nodes hold sums.  A pre-token starts
the same way whatever came before, and whether it starts depends on no more than the two code
points behind it.  So an edit re-encodes from the leaf that holds the third code point before it
to the first old leaf boundary behind it that is still a boundary; the new counts go into the
first leaf of that stretch, the other leaves of the stretch become empty, and only the sums above
them change.

Edits of a document are ``array<struct<start, stop, text>>`` in code points of its text, put in
from the last to the first; positions beyond the text mean its end, an edit that begins before
the end of an earlier one is left out, of equal starts the one with the smaller stop, then text,
comes first.

Defined results: a NULL text counts as empty, NULL edits as none, a NULL new text as empty;
repeated rows are counted each; a column named like a result is replaced.  An empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.llm import secret_scan
from vocalis.llm.bpe import NONE, Coder, coder, default_ranks
from vocalis.llm.common import chunks, utf8

LEAF = 32
#: Code points an edit can reach back over.
CONTEXT = 3
#: Bytes of the two code points and more that are looked at behind a stretch.
AHEAD = 12
EDITS = "array<struct<start:int,stop:int,text:string>>"
RESULTS = ["n_tokens", "n_edits", "n_tokens_edited", "n_bytes_edited", "n_bytes_encoded", "leaf_bytes", "leaf_tokens"]


class Tree:
    """Sums of bytes and tokens over leaves; node k has the children 2k and 2k + 1."""

    def __init__(self, leaf_bytes: list[int], leaf_tokens: list[int]) -> None:
        self.leaves = len(leaf_bytes)
        self.width = 1 << max(0, (self.leaves - 1).bit_length())
        rest = [0] * (self.width - self.leaves)
        self.sizes = [0] * self.width + list(leaf_bytes) + rest
        self.counts = [0] * self.width + list(leaf_tokens) + rest
        for k in range(self.width - 1, 0, -1):
            self.sizes[k] = self.sizes[2 * k] + self.sizes[2 * k + 1]
            self.counts[k] = self.counts[2 * k] + self.counts[2 * k + 1]

    @property
    def tokens(self) -> int:
        return self.counts[1]

    @property
    def bytes(self) -> int:
        return self.sizes[1]

    def at(self, byte: int) -> tuple[int, int]:
        """(leaf that holds a byte, its first byte); the last leaf for the end of the text."""
        k, before = 1, 0
        while k < self.width:
            k *= 2
            if byte - before >= self.sizes[k] and self.sizes[k + 1] > 0:
                before += self.sizes[k]
                k += 1
        return k - self.width, before

    def size(self, leaf: int) -> int:
        return self.sizes[self.width + leaf]

    def put(self, leaf: int, size: int, tokens: int) -> None:
        """Sets a leaf and the sums above it."""
        k = self.width + leaf
        more, tokens = size - self.sizes[k], tokens - self.counts[k]
        while k:
            self.sizes[k] += more
            self.counts[k] += tokens
            k //= 2

    def arrays(self) -> tuple[list[int], list[int]]:
        """Leaves that are not empty."""
        live = [k for k in range(self.width, self.width + self.leaves) if self.sizes[k]]
        return [self.sizes[k] for k in live], [self.counts[k] for k in live]


class Text:
    """A text that is edited from its end to its start: the part before the last edit is still that
    of the given text, what follows is a stack of pieces, so no edit copies the text."""

    def __init__(self, text: bytes) -> None:
        self.given, self.cut = text, len(text)
        self.pieces: list[bytes] = []  # the last one comes first in the text

    def edit(self, start: int, stop: int, new: bytes) -> None:
        self.pieces += [x for x in (self.given[stop : self.cut], new) if x]
        self.cut = start

    def read(self, lo: int, hi: int) -> bytes:
        """Bytes of the edited text, from before its last edit."""
        out, left = [self.given[lo : min(self.cut, hi)]], hi - max(self.cut, lo)
        for piece in reversed(self.pieces):
            if left <= 0:
                break
            out.append(piece[:left])
            left -= len(piece)
        return b"".join(out)

    def whole(self) -> bytes:
        return b"".join([self.given[: self.cut], *reversed(self.pieces)])


def leaves_together(texts: list[bytes], own: Coder) -> list[tuple[list[int], list[int]]]:
    """Bytes and tokens of the leaves of every text."""
    first, sizes, packed = own.packed_pieces(texts)
    counts = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
    out, cuts = [], first.tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        at = np.arange(a, b, LEAF) - a
        out.append((np.add.reduceat(sizes[a:b], at).tolist(), np.add.reduceat(counts[a:b], at).tolist()) if b > a else ([], []))
    return out


def leaves_of(text: bytes, own: Coder) -> tuple[list[int], list[int]]:
    """Bytes and tokens of the leaves of a text."""
    return leaves_together([text], own)[0]


def _back(text: bytes, at: int, points: int) -> int:
    """The byte ``points`` code points before ``at``."""
    while points and at > 0:
        at -= 1
        while at > 0 and text[at] & 0xC0 == 0x80:
            at -= 1
        points -= 1
    return at


def _starts(own: Coder, region: bytes, ahead: bytes) -> tuple[np.ndarray, bool]:
    """Starts of pre-tokens in ``region`` (which begins one), and whether what follows begins one."""
    both = np.frombuffer((region + ahead).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    n = len(region.decode("utf-8", "replace"))
    symbols = own.pretokens.symbols(both[: n + 1], both[n + 1 : n + 3])
    begins, _ = own.pretokens.scan(symbols, NONE)
    width = 1 + (both[:n] > 0x7F).astype(np.int64) + (both[:n] > 0x7FF) + (both[:n] > 0xFFFF)
    first = np.concatenate([[0], np.cumsum(width)])[:-1]
    return first[begins[:n]], len(both) == n or bool(begins[n])


def apply_edit(tree: Tree, text: Text, start: int, stop: int, new: bytes, own: Coder) -> tuple[Tree, int]:
    """The tree after one edit (in bytes) that begins before all earlier ones, and the bytes
    encoded for it."""
    text.edit(start, stop, new)
    if not tree.leaves:
        edited = text.whole()
        return Tree(*leaves_of(edited, own)), len(edited)
    end, shift = tree.bytes, len(new) - (stop - start)
    first, lo = tree.at(_back(text.given, start, CONTEXT))
    last, hi = tree.at(stop)
    hi += tree.size(last)
    while True:
        region = text.read(lo, hi + shift)
        ahead = text.read(lo, hi + shift + AHEAD)[len(region) :]
        starts, clean = _starts(own, region, ahead) if region else (np.empty(0, np.int64), hi >= end)
        if clean or hi >= end:
            break
        for _ in range(4):  # the next leaves that are not empty
            last, hi = tree.at(hi)
            hi += tree.size(last)
            if hi >= end:
                break
    bounds = [*starts.tolist(), len(region)]
    count = sum(own.count(region[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)) if region else 0
    for leaf in range(first, last + 1):
        tree.put(leaf, len(region) if leaf == first else 0, count if leaf == first else 0)
    return tree, len(region)


def apply_edits(tree: Tree, text: bytes, edits: list[tuple[int, int, str]], own: Coder) -> tuple[Tree, bytes, int, int]:
    """The tree and text after all edits (in code points), how many took effect, bytes encoded."""
    points = len(text.decode("utf-8", "replace"))
    offset = None
    if len(text) != points:
        widths = np.frombuffer(text, np.uint8)
        offset = np.append(np.flatnonzero((widths & 0xC0) != 0x80), len(text))
    byte = lambda p: int(p if offset is None else offset[p])
    taken, end = [], 0
    for start, stop, new in sorted((min(max(a, 0), points), min(max(a, b, 0), points), s or "") for a, b, s in edits):
        if start >= end:
            taken.append((byte(start), byte(stop), new.encode()))
            end = max(stop, end)
    encoded, edited = 0, Text(text)
    for start, stop, new in reversed(taken):
        tree, n = apply_edit(tree, edited, start, stop, new, own)
        encoded += n
    return tree, edited.whole(), len(taken), encoded


def _edits(column: list) -> list[tuple[int, int, str]]:
    return [(e["start"], e["stop"], e["text"]) for e in column or [] if e is not None and e["start"] is not None and e["stop"] is not None]


def with_trees(docs: DataFrame, text: str = "text", ranks: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` and the leaves ``leaf_bytes, leaf_tokens`` (array<int>)."""
    path = ranks or default_ranks()
    keep = [c for c in docs.columns if c not in ("n_tokens", "leaf_bytes", "leaf_tokens")]

    def work(batches):
        import pyarrow as pa

        own, kind = coder(path), pa.list_(pa.int32())
        for part in chunks(batches, column="_text"):
            found = leaves_together([x or b"" for x in part.column("_text").to_pylist()], own)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array([sum(t) for _, t in found], pa.int64()),
                 pa.array([s for s, _ in found], kind), pa.array([t for _, t in found], kind)],
                [*keep, "n_tokens", "leaf_bytes", "leaf_tokens"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], utf8(text).alias("_text"))
    return rows.mapInArrow(work, f"{fields}n_tokens long, leaf_bytes array<int>, leaf_tokens array<int>")


def with_edits(trees: DataFrame, edits: str = "edits", text: str = "text", ranks: str | None = None) -> DataFrame:
    """Applies a column of edits to rows of ``with_trees``: ``text`` and the leaves are those after
    the edits, ``n_tokens`` those before; adds ``n_edits, n_tokens_edited, n_bytes_edited,
    n_bytes_encoded``."""
    path = ranks or default_ranks()
    keep = [c for c in trees.columns if c not in (*RESULTS, text, edits)]

    def work(batches):
        import pyarrow as pa

        own, kind = coder(path), pa.list_(pa.int32())
        for part in chunks(batches, column="_text"):
            rows = []
            for raw, sizes, tokens, todo in zip(*(part.column(c).to_pylist() for c in ("_text", "leaf_bytes", "leaf_tokens", "_edits")), strict=True):
                tree, new, n, encoded = apply_edits(Tree(sizes, tokens), raw, _edits(todo), own)
                rows.append((new, n, tree.tokens, tree.bytes, encoded, *tree.arrays()))
            kinds = (pa.binary(), *[pa.int64()] * 4, kind, kind)
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), part.column("n_tokens"), *made],
                                             [*keep, "n_tokens", "_new", *RESULTS[1:]])

    fields = "".join(f"`{c}` {trees.schema[c].dataType.simpleString()}, " for c in keep)
    rows = trees.select(*[F.col(f"`{c}`") for c in keep], "n_tokens", "leaf_bytes", "leaf_tokens", utf8(text).alias("_text"),
                        F.col(edits).cast(EDITS).alias("_edits"))
    out = rows.mapInArrow(work, f"{fields}n_tokens long, _new binary, n_edits long, n_tokens_edited long, n_bytes_edited long, "
                                "n_bytes_encoded long, leaf_bytes array<int>, leaf_tokens array<int>")
    return out.withColumn(text, F.col("_new").cast("string")).drop("_new")


def edited_counts(docs: DataFrame, edits: str = "edits", key: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """``key, n_tokens, n_edits, n_tokens_edited, n_bytes_edited, n_bytes_encoded``: ``with_trees`` and
    ``with_edits`` in one pass where neither trees nor edited texts are kept."""
    path = ranks or default_ranks()

    def work(batches):
        import pyarrow as pa

        own = coder(path)
        for part in chunks(batches):
            texts, rows = [x or b"" for x in part.column("text").to_pylist()], []
            for raw, leaves, todo in zip(texts, leaves_together(texts, own), part.column("edits").to_pylist(), strict=True):
                tree = Tree(*leaves)
                before = tree.tokens
                tree, _, n, encoded = apply_edits(tree, raw, _edits(todo), own)
                rows.append((before, n, tree.tokens, tree.bytes, encoded))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["key", *RESULTS[:5]])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("text"), F.col(edits).cast(EDITS).alias("edits"))
    return rows.mapInArrow(work, f"key {kind}, " + ", ".join(f"{c} long" for c in RESULTS[:5])).withColumnRenamed("key", key)


#: What the query masks: mail addresses, and runs of 12 or more digits and letters a to f.
PRIVATE = r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+|[0-9a-f]{12,}"


def masking_edits(text: Column, source: Column) -> Column:
    """Edits that a training set needs: every private string masked, and a tag of the source put
    in front."""
    body = F.coalesce(text, F.lit(""))
    found = F.transform(secret_scan.places(body, PRIVATE, 0), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("stop"), F.lit("[masked]").alias("text")))
    tag = F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.concat(F.lit("<"), F.coalesce(source, F.lit("")), F.lit("> ")).alias("text"))
    return F.concat(F.array(tag), found)
