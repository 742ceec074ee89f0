"""Seeds of items and documents whose words repeat: same passages, bounded memory."""

import random
import time
import tracemalloc

import numpy as np

from vocalis.llm import decontam


def hits_of(item, text):
    """Places of every gram of an item in a text, as the operator joins them."""
    hashes = [np.array([hash(("word", x)) & (1 << 64) - 1 for x in w], np.uint64) for w in (item, text)]
    own, codes = (decontam.gram_codes(h, decontam.SEED_WORDS) for h in hashes)
    places = {}
    for q, code in enumerate(own.tolist()):
        places[code] = (places.get(code, (q, q))[0], q)
    at = np.flatnonzero(np.isin(codes, own))
    return [(a, b, *places[code]) for code, a, b in zip(*(x.tolist() for x in decontam.ranges(codes, at)), strict=True)]


def by_all_places(item, text):
    """The stretches around seeds from every single pair of places."""
    size, out = len(item), []
    spans = sorted(
        [max(p - q - size // 2 - 1, 0), min(p - q + size + size // 2 + 1, len(text))]
        for p in range(len(text) - 2) for q in range(size - 2) if text[p : p + 3] == item[q : q + 3])
    for lo, hi in spans:
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def test_stretches_equal_those_of_all_places():
    rng = random.Random(2)
    for _ in range(450):
        item = [rng.choice("abc") for _ in range(rng.randint(3, 14))]
        text = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 120))]
        assert decontam.stretches(hits_of(item, text), len(item), len(text)) == by_all_places(item, text)


def test_one_word_repeated():
    item, text = ["word"] * 2_000, ["word"] * 20_000
    tracemalloc.start()
    began = time.time()
    found = decontam.passages(np.zeros(2_000, np.int64), np.zeros(20_000, np.int64), hits_of(item, text))
    took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 60 and peak < 100 << 20
    assert [x for x in sorted(found, key=lambda x: x[1])] == [(4_000, k, k + 2_000) for k in range(0, 20_000, 2_000)]


def test_filter_holds_every_gram(spark):
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    grams = spark.createDataFrame([(int(x),) for x in codes[:5_000].view(np.int64)], "gram long")
    bits = int(5_000 * decontam.BITS_A_GRAM - 1).bit_length()
    at = decontam.passing(codes, decontam._filter(grams, bits), bits)
    assert at[:5_000].tolist() == list(range(5_000)) and len(at) < 5_100


def test_seeds_are_rare_or_the_rarest_of_their_stretch(spark):
    rng = random.Random(6)
    lines = {i: [rng.randint(0, 9) for _ in range(rng.randint(1, 12))] for i in range(40)}
    counts = {0: 3, 1: 4, 2: 9, 3: 9, 4: 12, 5: 20, 6: 20, 7: 31}  # 8 and 9: in no document
    want = set()
    for i, line in lines.items():
        for at, gram in enumerate(line):
            around = [[counts[x] for x in line[max(s, 0) : s + decontam.STRETCH] if x in counts] for s in range(at - decontam.STRETCH + 1, at + 1)]
            if gram in counts and (counts[gram] <= 4 or any(counts[gram] == min(x) for x in around)):
                want.add((i, gram))
    grams = spark.createDataFrame([(i, at, g) for i, line in lines.items() for at, g in enumerate(line)], "item long, at int, gram long")
    got = decontam.choose_seeds(grams, spark.createDataFrame(list(counts.items()), "gram long, n long"), 4).collect()
    assert len(got) == len(want) and {(r.item, r.gram) for r in got} == want
