"""SimHash near-duplicates, candidates by chains of segments around the fingerprint.

A fingerprint of ``BITS`` bits is a ring of ``limit + 1`` segments.  Of two fingerprints that
differ in at most ``limit`` bits some segment starts a chain whose first ``l`` segments differ
in at most ``l * limit / (limit + 1)`` bits together, for every ``l``.  So the first segment is
equal, the second differs in one bit at most, the third brings the sum to two at most, ...  A
bucket key is the start, its segment, one half of the second segment (one half is equal), one
third of the third (one third is equal), as deep as ``depth`` says; the pairs of a bucket must
keep the budgets of the whole chain before all their bits are compared.

Exact copies are one fingerprint.  A bucket of more than ``SMALL`` fingerprints gives the links
of a spanning forest, found by search from one fingerprint to all it reaches, in place of all
pairs; one of more than ``LARGE`` is cut into blocks, and every two blocks form a group of their
own.  Nothing is capped, and no bucket meets in one task beyond twice ``LARGE`` numbers.

``one_of_each`` takes such links between word fingerprints as a cheap start only; what decides is
an exact join of shingle sets.  In one order of all shingles, two sets of Jaccard similarity ``t``
share one of the first ``n - ceil(t n) + 1`` of each.  So the texts of one shingle form a bucket,
and every pair of a bucket is checked unless it is connected already or cannot be similar by its
sizes or bitmaps.  Shingles frequent in a sample come last in the order, which changes the work,
not the links; buckets of more than ``SMALL`` texts are worked off in rounds of more and more
pivots, between which links are contracted.

Defined results: a NULL or empty text has fingerprint 0, which links like any other; repeated
rows get a row each; component ids ignore NULL ids (NULL if a component has no other); other
columns are ignored by ``near_duplicates`` and kept by ``one_of_each``, which keeps one of rows
equal in id and text.  An empty table gives no
rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.common import chunks, stored, utf8
from vocalis.llm.components import components
from vocalis.session import BROADCAST_ROWS, broadcast_if_small, has_at_most

BITS, WORDS, LIMIT, SEED = 64, 4, 4, 42
#: Seeds of word fingerprints: texts that one pulls apart, another may hold together.
SEEDS = (42, 43, 44)
SMALL, LARGE = 64, 20_000
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16
#: Texts and number of frequent shingles that set the order of shingles; pivots grow by ``STEP``.
SAMPLE_TEXTS, FREQUENT, STEP = 2000, 100_000, 16
SIGN_BITS = 1024
#: Fingerprints of a bucket to expect at most; keys are made so deep.
EXPECTED = 16


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Majority of the bits of XXH64 over all shingles, repeats included."""
    import xxhash

    w = text.lower().split()  # bytes: A-Z and the separators 9 to 13 and 32 alone
    if not w:
        return 0
    plain, hash64 = b" ".join(w), xxhash.xxh64_intdigest
    n = max(1, len(w) - words + 1)
    starts = [0]
    for x in w[:-1]:
        starts.append(starts[-1] + len(x) + 1)
    if n == 1:
        hashes = [hash64(plain, seed)]
    else:
        ends = starts[words:]
        hashes = [hash64(plain[a : b - 1], seed) for a, b in zip(starts, ends, strict=False)]
        hashes.append(hash64(plain[starts[n - 1] :], seed))
    total = np.zeros(BITS, np.int64)
    for lo in range(0, n, COUNTED):
        part = np.array(hashes[lo : lo + COUNTED], np.uint64).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", words: int = WORDS) -> DataFrame:
    """``keys, fp`` (the 64 bits as a long)."""

    def work(batches):
        import pyarrow as pa

        for part in chunks(batches, column="_text"):
            fp = np.array([fingerprint(x.as_py() or b"", words) for x in part.column("_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keys))), pa.array(fp)], [*keys, "fp"])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, utf8(text).alias("_text")).mapInArrow(work, f"{fields}, fp long")


def segments(limit: int = LIMIT) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments around the ring."""
    m = limit + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bits(low: int, width: int) -> int:
    mask = ((1 << width) - 1) << low
    return mask - (1 << 64) if mask >> 63 else mask  # as a signed long


def key_masks(limit: int, depth: int) -> list[tuple[int, int]]:
    """(start, mask) of every kind of bucket: the parts of the fingerprint that are equal."""
    ring, kinds = segments(limit), []
    for start in range(len(ring)):
        masks = [_bits(*ring[start])]
        for d in range(1, depth):
            low, width = ring[(start + d) % len(ring)]
            budget = (d + 1) * limit // (limit + 1)
            cuts = [width * i // (budget + 1) for i in range(budget + 2)]
            masks = [m | _bits(low + a, b - a) for m in masks for a, b in zip(cuts, cuts[1:], strict=False)]
        kinds += [(start, m) for m in masks]
    return kinds


def depth_for(rows: int, limit: int) -> int:
    """Segments a bucket key needs so that evenly spread fingerprints give small buckets; it
    changes the work, not the links."""
    for depth in range(2, limit + 1):
        if rows <= EXPECTED << min((m & (1 << 64) - 1).bit_count() for _, m in key_masks(limit, depth)):
            return depth
    return max(1, limit)


def chain_masks(limit: int) -> list[list[tuple[int, int]]]:
    """For every start the (mask, budget) of its chains, shortest first."""
    ring, out = segments(limit), []
    for start in range(len(ring)):
        mask, chain = 0, []
        for d in range(len(ring)):
            low, width = ring[(start + d) % len(ring)]
            mask |= ((1 << width) - 1) << low
            chain.append((mask, (d + 1) * limit // (limit + 1)))
        out.append(chain)
    return out


def _kept(x: np.ndarray, chain: list[tuple[int, int]]) -> np.ndarray:
    """Indices of differences ``x`` that keep every budget; the last one is the whole limit."""
    at = np.arange(len(x))
    for mask, budget in chain:
        at = at[np.bitwise_count(x[at] & np.uint64(mask)) <= budget]
    return at


def bucket_links(kind: np.ndarray, value: np.ndarray, pair: np.ndarray, fp: np.ndarray,
                 chains: list[list[tuple[int, int]]], start_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of sorted rows; equal (kind, value, pair) is one bucket."""
    n = len(fp)
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | (value[1:] != value[:-1]) | (pair[1:] != pair[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    a, b = [], []
    few = np.repeat(size <= SMALL, size)
    left = np.flatnonzero(few & (np.repeat(first + size, size) - 1 > np.arange(n)))  # not last of its bucket
    end = np.repeat(first + size, size)
    for d in range(1, SMALL):
        left = left[left + d < end[left]]
        if not len(left):
            break
        for s, chain in enumerate(chains):
            at = left[start_of[kind[left]] == s]
            ok = at[_kept(fp[at] ^ fp[at + d], chain)]
            a.append(fp[ok]), b.append(fp[ok + d])
    for k in np.flatnonzero(size > SMALL):
        rest, chain = fp[first[k] : first[k] + size[k]], chains[start_of[kind[first[k]]]]
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                x = front.pop()
                near = _kept(rest ^ x, chain)
                a.append(np.full(len(near), x)), b.append(rest[near])
                front += list(rest[near])
                rest = np.delete(rest, near)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(prints: DataFrame, limit: int = LIMIT, depth: int = 2, large: int = LARGE) -> DataFrame:
    """``a, b``: links that connect whatever differs in at most ``limit`` bits; ``prints`` holds
    distinct ``fp``."""
    kinds, chains = key_masks(limit, depth), chain_masks(limit)
    keys = F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, (_, m) in enumerate(kinds)])
    rows = prints.select("fp", F.explode(keys).alias("k")).select("k.kind", "k.value", "fp")
    hot = rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large)
    cut = rows.join(hot, ["kind", "value"], "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / large).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    with_each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    dealt = (
        cut.withColumn("pair", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(with_each)))
        .select("kind", "value", "pair", "fp").repartition("kind", "value", "pair").sortWithinPartitions("kind", "value", "pair", "fp")
    )
    start_of = np.array([s for s, _ in kinds])

    def work(batches):
        import pyarrow as pa

        kept = None  # the rows of the last, still open bucket
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if kept is not None:
                now = [np.concatenate([x, y]) for x, y in zip(kept, now, strict=True)]
            if not len(now[0]):
                continue
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
            cut_at = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            kept = [x[cut_at:] for x in now]
            if cut_at:
                yield out(*[x[:cut_at] for x in now])
        if kept is not None:
            yield out(*kept)

    def out(kind, value, pair, fp):
        import pyarrow as pa

        a, b = bucket_links(kind, value, pair, fp.view(np.uint64), chains, start_of)
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return dealt.mapInArrow(work, "a long, b long")


def groups(prints: DataFrame, limit: int = LIMIT, depth: int | None = None) -> DataFrame:
    """``fp, root``: distinct fingerprints of ``prints`` with the root of their component."""
    distinct = stored(prints.select("fp").distinct(), "fingerprints")
    depth = depth or depth_for(distinct.count(), limit)
    roots = components(links(distinct, limit, depth)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """``key, fingerprint, component_id``: one row per document."""
    prints = stored(fingerprints(docs, [key], text, words), "prints")
    first = prints.groupBy("fp").agg(F.min(key).alias("least"))
    roots = stored(groups(prints, limit).join(first, "fp"), "roots")
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = stored(roots.join(ids, "root").select("fp", "component_id"), "components")
    return prints.join(by_print, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_fingerprint(text: bytes, seed: int = SEED) -> int:
    """Majority of the bits of XXH64 over the distinct words: an edited word moves one feature,
    not all the shingles around it."""
    import xxhash

    w = set(text.lower().split())
    if not w:
        return 0
    total = np.zeros(BITS, np.int64)
    hashes = [xxhash.xxh64_intdigest(x, seed) for x in w]
    for lo in range(0, len(hashes), COUNTED):
        part = np.array(hashes[lo : lo + COUNTED], np.uint64).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(w), bitorder="little").view(np.uint64)[0])


def shingles(text: bytes, words: int) -> np.ndarray:
    """Distinct hashes of the shingles of a text; of fewer words, of the whole sequence."""
    import xxhash

    w = text.lower().split()
    if not w:
        return np.empty(0, np.int64)
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), SEED) for i in range(max(1, len(w) - words + 1))]
    return np.unique(np.array(hashes, np.uint64)).view(np.int64)


def rare_first(own: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The part of a sorted shingle set of which every similar set holds a member: by hash, the
    ``frequent`` (sorted by hash, with their rank) last."""
    n = len(own)
    wanted = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
    if not len(frequent):
        return own[:wanted]
    at = np.minimum(np.searchsorted(frequent[:, 0], own), len(frequent) - 1)
    late = frequent[at, 0] == own
    return np.concatenate([own[~late], own[late][np.argsort(frequent[at[late], 1])]])[:wanted]


def bitmap(own: np.ndarray) -> bytes:
    bits = np.zeros(SIGN_BITS, np.uint8)
    bits[own.view(np.uint64) % np.uint64(SIGN_BITS)] = 1
    return np.packbits(bits).tobytes()


def frequent_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """(hash, rank) of the shingles of many texts of a sample, sorted by hash."""

    def work(batches):
        import pyarrow as pa

        for part in chunks(batches):
            for x in part.column("text"):
                own = shingles(x.as_py() or b"", words)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), hash_of(x.as_py() or b""))), pa.array(own)], ["node", "h"])

    one_in = max(1, texts.count() // SAMPLE_TEXTS)
    some = texts.where(F.pmod("_k", F.lit(one_in)) == 0).select(utf8("_text").alias("text")).mapInArrow(work, "node long, h long")
    often = some.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    rows = often.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    ranked = np.array([(r["h"], -i) for i, r in enumerate(rows)], np.int64).reshape(-1, 2)
    return ranked[np.argsort(ranked[:, 0])]


def hash_of(text: bytes) -> np.int64:
    """Hash of the lower-cased words in order."""
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED)).astype(np.int64)


def _text_prints(docs: DataFrame, keys: list[str], text: str, words: int, similarity: float, frequent: np.ndarray) -> DataFrame:
    """``keys, node, fps, n, rare, sign``: a hash of the lower-cased words in order, a word
    fingerprint for every seed, and the number, the rarest and a bitmap of the shingles."""

    def work(batches):
        import pyarrow as pa

        for part in chunks(batches, column="_body"):
            raw = [x.as_py() or b"" for x in part.column("_body")]
            node = np.array([hash_of(x) for x in raw], np.int64)
            fps = [np.array([word_fingerprint(x, s) for s in SEEDS], np.uint64).view(np.int64) for x in raw]
            sets = [shingles(x, words) for x in raw]
            rare = [rare_first(x, frequent, similarity) for x in sets]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(len(keys))), pa.array(node), pa.array(fps, longs), pa.array([len(x) for x in sets], pa.int64()),
                 pa.array(rare, longs), pa.array([bitmap(x) for x in sets], pa.binary())], [*keys, "node", "fps", "n", "rare", "sign"])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, utf8(text).alias("_body")).mapInArrow(work, f"{fields}, node long, fps array<long>, n long, rare array<long>, sign binary")


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    def work(batches):
        import pyarrow as pa

        for part in chunks(batches):
            sets = [shingles(x.as_py() or b"", words) for x in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    return texts.select("node", "text").mapInArrow(work, "node long, set array<long>")


def _candidates(texts: DataFrame, limit: int) -> DataFrame:
    """``a, b``: nodes whose fingerprints link."""
    stands = stored(texts.groupBy("fp").agg(F.min("node").alias("stand")), "stands")
    far = links(stands.select("fp"), limit, depth_for(stands.count(), limit)).distinct()
    a, b = (stands.select(F.col("fp").alias(x), F.col("stand").alias(f"_{x}")) for x in "ab")
    apart = far.join(a, "a").join(b, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    same = texts.join(stands, "fp").where(F.col("node") != F.col("stand"))
    return apart.unionByName(same.select(F.col("stand").alias("a"), F.col("node").alias("b")))


def _alike(pairs: DataFrame, texts: DataFrame, keyed: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (``a, b``) whose shingles have a Jaccard similarity of ``similarity``."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    rows = needed.join(texts, "node").select("node", "one._k", "one._l")
    # Equal (_k, _l) are equal rows; one of them is enough.
    found = keyed.select("_k", "_l", utf8(text).alias("text")).join(rows, ["_k", "_l"])
    sets = stored(_shingle_sets(found, words).dropDuplicates(["node"]), "shingles")
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "set": "_a"}), "a").join(sets.withColumnsRenamed({"node": "b", "set": "_b"}), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.where(shared >= similarity * (F.size("_a") + F.size("_b") - shared)).select("a", "b")


def whole_buckets(batches, columns: int):
    """Columns of Arrow batches sorted by the first as numpy arrays, cut between its values; a
    binary column comes as an array of bytes."""
    kept = None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if kept is not None:
            now = [np.concatenate([x, y]) for x, y in zip(kept, now, strict=True)]
        if not len(now[0]):
            continue
        cut_at = int(np.searchsorted(now[0], now[0][-1]))
        kept = [x[cut_at:] for x in now]
        if cut_at:
            yield [x[:cut_at] for x in now]
    if kept is not None:
        yield kept


def _bounds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of every run of equal values."""
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return first, np.diff(np.append(first, len(h)))


def _shared(texts: DataFrame) -> DataFrame:
    """``h, node``: the rare shingles that more than one text has."""

    def work(batches):
        import pyarrow as pa

        for h, node in whole_buckets(batches, 2):
            _, size = _bounds(h)
            some = np.repeat(size > 1, size)
            yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(node[some])], ["h", "node"])

    rows = texts.select(F.explode("rare").alias("h"), "node")
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(work, "h long, node long")


def bucket_pairs(h: np.ndarray, node: np.ndarray, n: np.ndarray, root: np.ndarray, sign: np.ndarray,
                 similarity: float, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of buckets (rows sorted by ``h, node``) that may be similar and have different roots:
    all of small buckets if ``lo`` is 0, of large ones those of the members ``lo`` to ``hi`` with
    later ones."""
    first, size = _bounds(h)
    end = np.repeat(first + size, size)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        ok = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
        i, j = i[ok], j[ok]
        # A bit that one has alone is at least one shingle the other lacks.
        least = np.ceil(similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9)
        ok = np.bitwise_count(sign[i] & ~sign[j]).sum(1) <= n[i] - least
        i, j, least = i[ok], j[ok], least[ok]
        ok = np.bitwise_count(sign[j] & ~sign[i]).sum(1) <= n[j] - least
        a.append(node[i[ok]]), b.append(node[j[ok]])

    if lo == 0:
        left = np.flatnonzero(np.repeat(size <= SMALL, size))
        for d in range(1, SMALL):
            left = left[left + d < end[left]]
            if not len(left):
                break
            for part in range(0, len(left), COUNTED):
                add(left[part : part + COUNTED], left[part : part + COUNTED] + d)
    for k in np.flatnonzero(size > SMALL):
        for i in range(first[k] + lo, first[k] + min(hi, size[k] - 1)):
            for at in range(i + 1, first[k] + size[k], COUNTED):
                j = np.arange(at, min(at + COUNTED, first[k] + size[k]))
                add(np.full(len(j), i), j)
    return np.concatenate(a), np.concatenate(b)


def _open_pairs(shared: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float, lo: int, hi: int) -> DataFrame:
    """``a, b``: what ``bucket_pairs`` finds in the buckets that hold more than one root."""
    rooted = shared.join(roots, "node", "left").select("h", "node", F.coalesce("root", "node").alias("root"))
    live = rooted.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("h")
    rows = rooted.join(live, "h", "left_semi").join(texts.select("node", "n", "sign"), "node").select("h", "node", "n", "root", "sign")

    def work(batches):
        import pyarrow as pa

        for h, node, n, root, sign in whole_buckets(batches, 5):
            bits = np.frombuffer(b"".join(sign), np.uint64).reshape(-1, SIGN_BITS // 64)
            a, b = bucket_pairs(h, node, n, root, bits, similarity, lo, hi)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return rows.repartition("h").sortWithinPartitions("h", "node").mapInArrow(work, "a long, b long").distinct()


def similar_links(keyed: DataFrame, prints: DataFrame, text: str, limit: int, words: int, similarity: float) -> DataFrame:
    """``a, b``: links that connect whatever texts (``node``) have shingles of a Jaccard similarity
    of at least ``similarity``; ``keyed`` and ``prints`` share ``_k, _l``.

    Links between fingerprints come first, so that the exact join meets large groups connected."""
    one = [F.min(F.struct("_k", "_l")).alias("one"), *[F.min(c).alias(c) for c in ("fps", "n", "rare", "sign")]]
    texts = stored(prints.groupBy("node").agg(*one), "texts")
    each = [_candidates(texts.select("node", F.get("fps", F.lit(i)).alias("fp")), limit) for i in range(len(SEEDS))]
    pairs = stored(reduce(DataFrame.unionByName, each).distinct(), "pairs")
    found = stored(_alike(pairs, texts, keyed, text, words, similarity), "near")
    shared = stored(_shared(texts), "shared")
    largest = shared.groupBy("h").count().agg(F.max("count")).first()[0] or 0
    lo, hi = 0, 1
    while lo < largest:
        pairs = stored(_open_pairs(shared, texts, components(found), similarity, lo, hi), "pairs")
        if not pairs.isEmpty():
            found = stored(found.union(_alike(pairs, texts, keyed, text, words, similarity)), "near")
        lo, hi = (hi, hi * STEP) if largest > SMALL else (largest, largest)
    return found


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 5, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of every group of near-duplicates: that of the smallest id, NULL ids
    last.

    Groups are components of links between all texts that share ``similarity`` of their
    ``words``-word shingles.  Texts of the same words in the same order, but for case and white
    space, are one text.  ``limit`` bits of the fingerprints change the work, not the groups."""
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(key).alias("_id"), F.col(text).alias("_text"),
        F.xxhash64(key, body, F.lit(1)).alias("_k"), F.xxhash64(F.lit(2), body, key).alias("_l"))
    frequent = frequent_shingles(keyed, words)
    prints = stored(_text_prints(keyed, ["_id", "_k", "_l"], "_text", words, similarity, frequent), "prints")
    roots = components(similar_links(keyed, prints, "_text", limit, words, similarity))
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "_k", "_l")
    first = prints.groupBy("node").agg(F.min(place).alias("least"))
    chosen = first.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    chosen = stored(chosen.select("least._k", "least._l"), "chosen")
    return keyed.join(chosen, ["_k", "_l"], "left_semi").dropDuplicates(["_k", "_l"]).select("_doc.*")


#: Bits a hash has in a map, and the greatest map that is broadcast.
MAP_BITS, MAP_MOST, BUCKET_BITS = 16, 1 << 28, 1 << 15


def _split_off(keyed: DataFrame, special: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """``keyed`` in two: rows whose hash ``_k`` is surely none of ``special``, and all others, among
    them one in MAP_BITS by chance.  Either is None when it must be empty or is not told apart."""
    special = stored(special, "special")
    n = special.count()
    if not n:
        return keyed, None
    width = max(BUCKET_BITS, 1 << (MAP_BITS * n - 1).bit_length())
    if width > MAP_MOST:
        return None, keyed
    slot = F.pmod(F.col("_k"), F.lit(width))
    of = lambda c: F.floor(c / BUCKET_BITS).cast("int")
    bits = special.select(of(slot).alias("_bucket"), F.pmod(slot, F.lit(BUCKET_BITS)).alias("_at"))
    maps = bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    placed = keyed.withColumns({"_bucket": of(slot), "_at": F.pmod(slot, F.lit(BUCKET_BITS)).cast("int")}).join(F.broadcast(maps), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(F.coalesce(byte, F.lit(0)), F.pmod("_at", F.lit(8)))
    return tuple(placed.where(bit == found).select(*keyed.columns) for found in (0, 1))


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """``docs`` with one row of every component of ``near_duplicates``: that of the smallest id,
    NULL ids last, of rows with that id the least by a hash of their text; one of rows equal in
    both.  Texts without words are one group.  All columns are kept.

    Only fingerprints and hashes of the rows are grouped.  No row is moved while the hashes of those
    that stay are few (counted); of more, a map of bits tells most rows that stay, and only the others
    are moved, once."""
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(key).alias("_id"), F.col(text).alias("_text"),
        F.xxhash64(key, body, F.lit(1)).alias("_k"), F.xxhash64(F.lit(2), body, key).alias("_l"))
    prints = stored(fingerprints(keyed, ["_id", "_k", "_l"], "_text", words), "prints")
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "_k", "_l")
    first = prints.groupBy("fp").agg(F.min(place).alias("least"))
    least = groups(prints, limit).join(first, "fp").groupBy("root").agg(F.min("least").alias("least")).select("least._k", "least._l")
    same = prints.groupBy("_k", "_l").agg(F.count(F.lit(1)).alias("_same"))
    chosen = stored(least.join(same, ["_k", "_l"]), "chosen")
    clear = None
    if not has_at_most(chosen, BROADCAST_ROWS):
        clear, keyed = _split_off(keyed, same.join(chosen.where("_same = 1").select("_k", "_l"), ["_k", "_l"], "left_anti").select("_k"))
    if keyed is None:
        return clear.select("_doc.*")
    kept = keyed.join(broadcast_if_small(chosen.select("_k", "_l", "_same")), ["_k", "_l"])
    alone = kept.where("_same = 1").select("_doc.*")
    if clear is not None:
        alone = clear.select("_doc.*").unionByName(alone)
    if chosen.where("_same > 1").isEmpty():
        return alone
    return alone.unionByName(kept.where("_same > 1").dropDuplicates(["_k", "_l"]).select("_doc.*"))
