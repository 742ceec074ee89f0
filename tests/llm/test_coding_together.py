"""Texts coded together give what each gives alone."""

import random

import numpy as np
import pytest

from vocalis.llm import bpe, token_trees

ALPHABET = ["a", "b", "s", "the", "re", "ve", "ll", "d", "'", " ", "  ", "\n", "1", "२", "é", "!", "中", "😀", "'s", "\r\n", "́", "\x85", "\U0010ffff", "\0"]


@pytest.fixture(scope="module")
def own():
    return bpe.coder(bpe.default_ranks())


def some(rng, most):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most)))


@pytest.mark.parametrize("scan", [5, 64, 1 << 18])
def test_together_equals_alone(own, monkeypatch, scan):
    monkeypatch.setattr(bpe, "SCAN", scan)
    rng = random.Random(scan)
    for _ in range(60):
        texts = [some(rng, 40).encode() for _ in range(rng.randint(1, 9))]
        want = [own.encode(t).tolist() for t in texts]
        assert [x.tolist() for x in own.encode_together(texts)] == want
        assert [sum(t) for _, t in token_trees.leaves_together(texts, own)] == [len(x) for x in want]
        assert [own.decode(np.array(x, np.uint32)) for x in want] == texts
    assert [x.tolist() for x in own.encode_together([b"", b"", b""])] == [[], [], []] and own.encode_together([]) == []


def test_invalid_bytes_stay_apart(own):
    texts = [b"good one", b"bad \xff\xfe bytes", b"'s", b""]
    alone = own.encode_together([b"good one"]) + own.encode_together([b"'s"])
    got = own.encode_together(texts)
    assert got[0].tolist() == alone[0].tolist() and got[2].tolist() == alone[1].tolist() and len(got[3]) == 0
    assert own.decode(got[1]) == texts[1]


def test_merges_side_by_side(own, monkeypatch):
    monkeypatch.setattr(bpe, "TOGETHER", 7)
    rng = random.Random(4)
    pieces = list({bytes(rng.choices(b"aeinrst \xc3\xa9\x00", k=rng.randint(2, 64))) for _ in range(300)})
    pieces = [p for p in pieces if p not in own.ranks]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.merge_together(pieces)] == [own.merge(p) for p in pieces]


def test_two_generations(monkeypatch):
    small, want = bpe.Coder(bpe.default_ranks(), cache=5), bpe.coder(bpe.default_ranks())
    rng = random.Random(9)
    for _ in range(40):
        texts = [some(rng, 30).encode() for _ in range(3)]
        assert [x.tolist() for x in small.encode_together(texts)] == [want.encode(t).tolist() for t in texts]
        assert len(small.older) <= 200


def test_long_text_is_decoded_in_parts(own, monkeypatch):
    monkeypatch.setattr(bpe, "DECODED", 11)
    text = ("some words and 中文 again " * 300).encode()
    ids = own.encode(text)
    assert own.decode(ids) == text and own.offsets(ids)[-1] == len(text)


def test_one_pass_equals_two(spark):
    from helpers import KINDS, ODD

    rows = spark.createDataFrame([(*r, [(1, 3, None), (0, 99999, "é"), (None, 2, "x"), None, (5, 2, " a")] if i % 2 else None) for i, r in enumerate(ODD)],
                                 f"{KINDS}, edits array<struct<start:int,stop:int,text:string>>")
    got = token_trees.edited_counts(rows)
    want = token_trees.with_edits(token_trees.with_trees(rows)).select("doc_id", *token_trees.RESULTS[:5])
    assert got.columns == want.columns and [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert token_trees.edited_counts(rows.limit(0)).count() == 0


def test_many_edits_of_a_long_text_in_time(own):
    import time

    text = b"mail some.one@example.com for more " * 60_000
    tree = token_trees.Tree(*token_trees.leaves_of(text, own))
    edits = [(35 * k + 5, 35 * k + 25, "[masked]") for k in range(0, 60_000, 3)]
    began = time.time()
    tree, new, n, _ = token_trees.apply_edits(tree, text, edits, own)
    assert time.time() - began < 30 and n == 20_000
    assert tree.tokens == len(own.encode(new)) and tree.bytes == len(new) and new.count(b"[masked]") == 20_000
