"""Byte-level BPE: encoding by public ranks, and decoding with offsets.

Pre-tokens are found without regex.  Every code point gets a symbol from its class and the few
code points after it; a symbol is a transition function of a small automaton, functions are
composed associatively through a table, and a blockwise prefix scan over whole chunks yields the
state at every code point and so the starts of pre-tokens.  The texts of a chunk are scanned
together, a reset between two.  Slices of bytes between starts go through a cache of pair merges;
those it lacks are merged side by side, one merge of each a step.

Defined results: a NULL text counts as empty and has no tokens; repeated rows are encoded each;
texts of any length are read in chunks with the state carried over.  An empty table gives no
rows; other columns are ignored by ``token_digests``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.common import chunks, utf8

#: Code points scanned at once.
SCAN = 1 << 18
#: Pre-tokens whose ids are remembered, in each of two generations.
CACHE = 150_000
#: Steps of the blockwise scan, of short texts and of long ones.
SHORT_BLOCK, LONG_BLOCK = 16, 64
#: Pre-tokens up to so many bytes are remembered; so many are merged side by side.
KEPT_BYTES, TOGETHER = 64, 1 << 13
#: Bytes of text in a slice whose ids and offsets are kept together.
ROWS_BYTES = 1 << 19
#: Tokens decoded at once.
DECODED = 1 << 16

# classes of code points
SPACE, BLANK, LETTER, NUMBER, OTHER, MARK, END = range(7)  # ' ', other white space, ..., apostrophe, end of a text
#: Stands between two texts; no code point.
BETWEEN = 0x110000
# symbols: a white-space code point that more white space (or the end) follows; the last one of
# a run, blank or space; letter; number; other; apostrophe of a contraction of 1 or 2 letters
S_MORE, S_LAST, S_GLUE, S_LETTER, S_NUMBER, S_OTHER, S_ONE, S_TWO, S_RESET = range(9)
# states: nothing open; an open run of letters, numbers, others or white space; an open space
# that joins what follows; one or two letters of a contraction to come
NONE, LETTERS, NUMBERS, OTHERS, BLANKS, GLUED, ONE, TWO = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """``step[symbol, state]`` and ``begins[symbol, state]`` (does the symbol start a pre-token)."""
    step, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    step[S_MORE], step[S_LAST], step[S_GLUE], step[S_RESET] = BLANKS, NONE, GLUED, NONE
    begins[S_MORE, BLANKS] = False
    begins[S_RESET] = False
    step[S_LETTER], step[S_NUMBER], step[S_OTHER] = LETTERS, NUMBERS, OTHERS
    begins[S_LETTER, [LETTERS, GLUED, ONE, TWO]] = False
    step[S_LETTER, TWO], step[S_LETTER, ONE] = ONE, NONE
    begins[S_NUMBER, [NUMBERS, GLUED]] = False
    for s, to in ((S_OTHER, OTHERS), (S_ONE, ONE), (S_TWO, TWO)):
        step[s] = to
        step[s, [OTHERS, GLUED]] = OTHERS
        begins[s, [OTHERS, GLUED]] = False
    return step, begins


def _monoid(step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the steps: number of each symbol's function, ``after[f, g]`` (first f,
    then g), and what each function does to each state."""
    known: dict[bytes, int] = {}
    functions: list[np.ndarray] = []

    def number(f: np.ndarray) -> int:
        k = f.tobytes()
        if k not in known:
            known[k] = len(functions)
            functions.append(f)
        return known[k]

    symbols = np.array([number(f) for f in step], np.uint8)
    at = 0
    while at < len(functions):
        for f in step:
            number(f[functions[at]])
        at += 1
    after = np.array([[number(g[f]) for g in functions] for f in functions], np.uint8)
    return symbols, after, np.array(functions, np.uint8)


def _classes() -> np.ndarray:
    """Class of every code point, from the same Unicode tables as the public pattern."""
    out = np.full(BETWEEN + 1, OTHER, np.uint8)
    # Code points of the surrogate range are in no text.
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(lo, hi)))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
            for m in regex.finditer(pattern, every):
                out[lo + m.start() : lo + m.end()] = kind
    out[0x20], out[0x27], out[BETWEEN] = SPACE, MARK, END
    return out


class Pretokens:
    """Starts of pre-tokens by composing transition functions."""

    def __init__(self) -> None:
        self.step, self.begins = _automaton()
        self.functions, self.after, self.does = _monoid(self.step)
        self.count, self.flat_after, self.flat_does = len(self.does), self.after.ravel(), self.does.ravel()
        self.classes = _classes()

    def symbols(self, points: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """Symbols of ``points``; ``ahead`` holds up to two code points that follow."""
        n = len(points)
        kind = np.full(n + 2, END, np.uint8)
        joined = np.zeros(n + 2, np.uint32)
        joined[:n], joined[n : n + len(ahead)] = points, ahead
        kind[: n + len(ahead)] = self.classes[joined[: n + len(ahead)]]
        here, after = kind[:n], kind[1 : n + 1]
        out = np.array([S_GLUE, S_LAST, S_LETTER, S_NUMBER, S_OTHER, S_OTHER, S_RESET], np.uint8)[here]
        out[(here <= BLANK) & ((after <= BLANK) | (after == END))] = S_MORE
        marks = np.flatnonzero(here == MARK)
        if len(marks):
            a, b = joined[marks + 1], joined[np.minimum(marks + 2, n + 1)]
            two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))  # re ve ll
            one = (a == 115) | (a == 116) | (a == 109) | (a == 100)  # s t m d
            out[marks[two]], out[marks[one]] = S_TWO, S_ONE
        return out

    def compose(self, f: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Numbers of the functions: first f, then g."""
        return self.flat_after[f.astype(np.intp) * self.count + g]

    def scan(self, symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """Whether each symbol begins a pre-token, and the state after the last one."""
        n = len(symbols)
        block = SHORT_BLOCK if n < 1 << 16 else LONG_BLOCK
        rows = -(-n // block)
        f = np.zeros(rows * block, np.uint8)
        f[:n] = self.functions[symbols]
        f[n:] = self.functions[S_RESET]
        f = f.reshape(rows, block).T.copy()  # column = block, so that one step covers all blocks
        for k in range(1, block):  # prefix of every block
            f[k] = self.compose(f[k - 1], f[k])
        whole = f[-1].copy()
        shift = 1
        while shift < rows:  # prefix over blocks, doubling
            whole[shift:] = self.compose(whole[:-shift], whole[shift:])
            shift *= 2
        enter = np.empty(rows, np.uint8)
        enter[0], enter[1:] = state, self.does[whole[:-1], state]
        states = self.flat_does[f.astype(np.intp) * self.does.shape[1] + enter].T.reshape(-1)[:n]
        before = np.empty(n, np.uint8)
        before[0], before[1:] = state, states[:-1]
        return self.begins[symbols, before], int(states[-1])

    def starts(self, text: bytes) -> Iterator[np.ndarray]:
        """Byte offsets of the starts of pre-tokens, chunk by chunk."""
        return self._starts(np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32))

    def starts_together(self, texts: list[bytes], whole: bytes) -> np.ndarray:
        """Byte offsets of the starts of pre-tokens in ``whole``, the valid texts joined."""
        points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
        sizes = [len(t.decode("utf-8")) for t in texts]
        points = np.insert(points, np.cumsum(sizes[:-1], dtype=np.int64), BETWEEN)
        found = list(self._starts(points))
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def _starts(self, points: np.ndarray) -> Iterator[np.ndarray]:
        width = (1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)) * (points != BETWEEN)
        state, at_byte, n = NONE, 0, len(points)
        for lo in range(0, n, SCAN):
            here = points[lo : lo + SCAN]
            where = at_byte + np.cumsum(width[lo : lo + SCAN], dtype=np.int64)
            first = np.empty(len(here), np.int64)
            first[0], first[1:] = at_byte, where[:-1]
            symbols = self.symbols(here, points[lo + len(here) : lo + len(here) + 2])
            begins, state = self.scan(symbols, state)
            at_byte = int(where[-1])
            yield first[begins]


class Coder:
    """Ids of byte strings by rank: merges of one pre-token at a time, remembered."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        ranks = self.ranks
        self.none = len(self.tokens)
        self.single = [ranks[bytes([b])] for b in range(256)]
        # A token is named by its rank, so a pair of ids leads to the id of the merged token.
        self.pairs = {
            ranks[t[:k]] << 32 | ranks[t[k:]]: i
            for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        }
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.fromiter(self.pairs.values(), np.int32, len(keys))[order]
        self.singles = np.array(self.single, np.int32)
        self.byte_pairs = self._lookup(np.repeat(self.singles, 256), np.tile(self.singles, 256))
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.all_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        # Two generations: where the younger is full it becomes the older, which answers once more.
        self.limit, self.packed, self.older = cache, {}, {}
        self.pretokens = Pretokens()

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the merged tokens of pairs, ``none`` where a pair does not merge."""
        if not len(self.keys):
            return np.full(a.shape, self.none, np.int32)
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], np.int32(self.none))

    def merge_together(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens of two bytes or more: each step merges the pair of least rank in
        every one of them, leftmost among equals."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out: list[bytes] = [b""] * len(pieces)
        order = np.argsort(size, kind="stable")
        for lo in range(0, len(order), TOGETHER):
            rows = order[lo : lo + TOGETHER]
            n, width = size[rows], int(size[rows[-1]])
            raw = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in rows.tolist()]), np.uint8).reshape(-1, width)
            ids = self.singles[raw]
            pairs = self.byte_pairs[raw[:, :-1].astype(np.intp) * 256 + raw[:, 1:]]
            pairs[np.arange(width - 1) >= (n - 1)[:, None]] = self.none
            while len(rows):
                best = pairs.argmin(1) if pairs.shape[1] else np.zeros(len(rows), np.intp)
                merged = pairs[np.arange(len(rows)), best] if pairs.shape[1] else np.full(len(rows), self.none)
                done = merged == self.none
                if done.any():
                    packed, step = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                    for k, (i, m) in enumerate(zip(rows[done].tolist(), n[done].tolist(), strict=True)):
                        out[i] = packed[k * step : k * step + 4 * m]
                    live = ~done
                    rows, n, ids, pairs, best, merged = rows[live], n[live], ids[live], pairs[live], best[live], merged[live]
                    if not len(rows):
                        break
                every, n = np.arange(len(rows)), n - 1
                ids[every, best] = merged
                column = np.arange(ids.shape[1] - 1)
                ids = np.take_along_axis(ids, column + (column > best[:, None]), 1)
                column = column[:-1]
                pairs = np.take_along_axis(pairs, column + (column >= best[:, None]), 1)
                left = np.flatnonzero(best > 0)
                at = best[left]
                pairs[left, at - 1] = self._lookup(ids[left, at - 1], ids[left, at])
                right = np.flatnonzero(best < n - 1)
                at = best[right]
                pairs[right, at] = self._lookup(ids[right, at], ids[right, at + 1])
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: the pair of least rank merges first, leftmost among equals."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 200:
            return self._merge_long(piece)
        get, none = self.pairs.get, self.none
        ids = [self.single[b] for b in piece]
        pairs = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [best]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(best << 32 | ids[i + 1], none)
            if i:
                pairs[i - 1] = get(ids[i - 1] << 32 | best, none)
        return ids

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and linked neighbours, for pre-tokens of any length."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        prev, live = list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not live[i] or j >= n or end[j] != stop:
                continue
            live[j], end[i] = False, stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = prev[i]
            if p >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _remember(self, found: dict[bytes, bytes]) -> None:
        if len(self.packed) + len(found) > self.limit:
            self.older, self.packed = self.packed, {}
        self.packed.update(found)

    def pack(self, piece: bytes) -> bytes:
        """Ids of a pre-token as little-endian 32-bit integers."""
        got = self.packed.get(piece)
        if got is None:
            got = self.older.get(piece) or np.array(self.merge(piece), "<u4").tobytes()
            if len(piece) <= KEPT_BYTES:
                self._remember({piece: got})
        return got

    def pack_together(self, pieces: list[bytes]) -> list[bytes]:
        """``pack`` of many pre-tokens."""
        packed = list(map(self.packed.get, pieces))
        lacking = {p for p, got in zip(pieces, packed, strict=True) if got is None}
        if lacking:
            found, fresh, ranks, older = {}, [], self.ranks, self.older
            for p in lacking:
                got = older.get(p)
                if got is not None:
                    found[p] = got
                elif p in ranks:
                    found[p] = ranks[p].to_bytes(4, "little")
                elif len(p) <= KEPT_BYTES:
                    fresh.append(p)
                else:
                    found[p] = np.array(self.merge(p), "<u4").tobytes()
            found.update(zip(fresh, self.merge_together(fresh), strict=True))
            packed = [found[p] if got is None else got for p, got in zip(pieces, packed, strict=True)]
            self._remember({p: got for p, got in found.items() if len(p) <= KEPT_BYTES})
        return packed

    def count(self, piece: bytes) -> int:
        """Tokens of a pre-token."""
        return len(self.pack(piece)) >> 2

    def pieces(self, text: bytes) -> Iterator[bytes]:
        """Pre-tokens of a text in order; nothing but the text is held whole."""
        open_at = 0
        for starts in self.pretokens.starts(text):
            bounds = starts.tolist()
            if bounds and bounds[0] == 0:
                bounds = bounds[1:]
            for to in bounds:
                yield text[open_at:to]
                open_at = to
        if open_at < len(text):
            yield text[open_at:]

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of a whole text."""
        return np.frombuffer(b"".join(map(self.pack, self.pieces(text))), "<u4")

    def packed_pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Pre-tokens of texts one after another: for every text and the end the number of its first
        one, their sizes in bytes, and their packed ids."""
        whole = b"".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        try:
            starts = self.pretokens.starts_together(texts, whole)
        except UnicodeDecodeError:  # texts that are no UTF-8 are read one by one
            each = [np.concatenate([*self.pretokens.starts(t), np.empty(0, np.int64)]) for t in texts]
            starts = np.concatenate([np.empty(0, np.int64), *(x[x < n] + to - n for x, n, to in zip(each, sizes, ends, strict=True))])
        bounds = np.append(starts, len(whole))
        at = bounds.tolist()
        packed = self.pack_together([whole[a:b] for a, b in zip(at, at[1:], strict=False)])
        return np.append(np.searchsorted(starts, ends - sizes), len(starts)), np.diff(bounds), packed

    def encode_together(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of whole texts; a long one that comes alone is read in chunks."""
        if len(texts) == 1 and len(texts[0]) > SCAN:
            return [self.encode(texts[0])]
        first, _, packed = self.packed_pieces(texts)
        return [np.frombuffer(b"".join(packed[a:b]), "<u4") for a, b in zip(first.tolist(), first.tolist()[1:], strict=False)]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offsets of every token and of the end."""
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.sizes[ids], out=out[1:])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens, gathered from those of all tokens in a row."""
        out = []
        for lo in range(0, len(ids), DECODED):
            part = ids[lo : lo + DECODED]
            size = self.sizes[part]
            upto = np.cumsum(size)
            at = np.repeat(self.places[part] - upto + size, size)
            at += np.arange(len(at))
            out.append(self.all_bytes[at].tobytes())
        return b"".join(out)


def coder(path: str) -> Coder:
    """The coder of this Python process; workers are used again by later tasks, which bring their
    own copy of this module's variables."""
    import sys

    kept = sys.__dict__.setdefault("_kept_coders", {})
    if path not in kept:
        kept[path] = Coder(path)
    return kept[path]


def default_ranks() -> str:
    """The public ranks of the production query, where every executor has them installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def token_digests(docs: DataFrame, ranks: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``: one row per document."""
    path = ranks or default_ranks()

    def work(batches):
        import pyarrow as pa

        own = coder(path)
        for part in chunks(batches):
            rows = []
            for ids in own.encode_together([x or b"" for x in part.column("text").to_pylist()]):
                rows.append((len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), utf8(text).alias("text")).mapInArrow(
        work, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


def with_tokens(docs: DataFrame, ranks: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>), ``offsets`` (byte offset of every token and of the end)
    and ``decoded_sha256`` (digest of the bytes the ids decode to); a column of one of these names
    is replaced."""
    path = ranks or default_ranks()
    keep = [c for c in docs.columns if c not in ("ids", "offsets", "decoded_sha256")]

    def work(batches):
        import pyarrow as pa

        own = coder(path)
        for part in chunks(batches, ROWS_BYTES, "_text"):
            ids = own.encode_together([x or b"" for x in part.column("_text").to_pylist()])
            columns = [part.column(i) for i in range(len(keep))]
            columns += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
            columns += [pa.array([own.offsets(x).astype(np.int64) for x in ids], pa.list_(pa.int64()))]
            columns += [pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", "offsets", "decoded_sha256"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep], utf8(text).alias("_text")).mapInArrow(
        work, f"{fields}, ids array<int>, offsets array<long>, decoded_sha256 string")


def decoded(rows: DataFrame, ranks: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of their ids as column ``out``."""
    path = ranks or default_ranks()
    keep = [c for c in rows.columns if c != out]

    def work(batches):
        import pyarrow as pa

        own = coder(path)
        for part in batches:
            raw = [own.decode(np.array(x.as_py() or [], np.uint32)) for x in part.column(ids)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(raw, pa.binary())], [*keep, out])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(work, f"{fields}, `{out}` binary")
