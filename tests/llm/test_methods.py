"""Methods of single operators: scans, trees, alignments, labellers, bucket links."""

import random
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from helpers import KINDS, ODD, classes, encoding, fingerprint

from vocalis.llm import bpe, components, decontam, html_blocks, simhash, token_trees

ALPHABET = ["a", "b", "s", "the", "re", "ve", "ll", "d", "m", "'", " ", "  ", "\n", "\t", "1", "२", "é", "!", "-", "中", "😀", " ", "'s", "'S", "\r\n", "́", "\x85"]


@pytest.fixture(scope="module")
def own():
    return bpe.coder(bpe.default_ranks())


@pytest.fixture(scope="module")
def public():
    return encoding()


def some(rng, most):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most)))


def test_pretokens_of_random_texts(own, public):
    rng = random.Random(1)
    for _ in range(4000):
        text = some(rng, 14)
        assert own.encode(text.encode()).tolist() == public.encode_ordinary(text)


def test_chunks_carry_their_state(own, public, monkeypatch):
    rng = random.Random(2)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(bpe, "SCAN", size)
        for _ in range(150):
            text = some(rng, 14)
            assert own.encode(text.encode()).tolist() == public.encode_ordinary(text)


def test_long_pretokens(own, public):
    text = "ab" * 4000 + " " * 999 + "zq'" * 700
    assert own.encode(text.encode()).tolist() == public.encode_ordinary(text)


@pytest.mark.parametrize("leaf", [1, 2, 32])
def test_edited_counts(own, public, monkeypatch, leaf):
    monkeypatch.setattr(token_trees, "LEAF", leaf)
    rng = random.Random(leaf)
    for _ in range(700):
        text = some(rng, 60)
        edits = [(a, a + rng.choice([0, 0, 1, 2, 5, 30]), some(rng, 4)) for a in (rng.randint(0, len(text) + 2) for _ in range(rng.randint(0, 4)))]
        tree = token_trees.Tree(*token_trees.leaves_of(text.encode(), own))
        tree, new, _, _ = token_trees.apply_edits(tree, text.encode(), edits, own)
        taken, end = [], 0
        for a, b, x in sorted((min(a, len(text)), min(b, len(text)), x) for a, b, x in edits):
            if a >= end:
                taken.append((a, b, x))
                end = max(b, end)
        for a, b, x in reversed(taken):
            text = text[:a] + x + text[b:]
        assert new.decode() == text and tree.tokens == len(public.encode_ordinary(text)) and tree.bytes == len(new)


def test_edits_touch_little(own):
    text = ("some ordinary words in a row, " * 2000).encode()
    tree = token_trees.Tree(*token_trees.leaves_of(text, own))
    _, _, n, encoded = token_trees.apply_edits(tree, text, [(30_000, 30_004, "other")], own)
    assert n == 1 and encoded < 1000


def test_edited_query(spark, public):
    from vocalis.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op9_edited_counts"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    import re

    for r in docs.collect():
        new = f"<{r.source}> " + re.sub(token_trees.PRIVATE, "[masked]", r.text)
        x = got[r.doc_id]
        assert (x.n_tokens, x.n_tokens_edited, x.n_bytes_edited) == (
            len(public.encode_ordinary(r.text)), len(public.encode_ordinary(new)), len(new.encode()))


def test_edits_of_odd_rows(spark, public):
    rows = spark.createDataFrame([(*r, 7, None if i % 2 else [(1, 3, None), (0, 99999, "é"), (None, 2, "x")]) for i, r in enumerate(ODD)],
                                 f"{KINDS}, n_edits int, edits array<struct<start:int,stop:int,text:string>>")
    got = token_trees.with_edits(token_trees.with_trees(rows)).collect()
    for i, (r, (_, t)) in enumerate(zip(got, ODD, strict=True)):
        want = (t or "") if i % 2 else "é" if True else t
        assert r.text == want and r.n_tokens_edited == len(public.encode_ordinary(want)) == sum(r.leaf_tokens)
    assert token_trees.with_edits(token_trees.with_trees(rows.limit(0))).count() == 0


def plain_score(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment():
    rng = random.Random(0)
    for _ in range(800):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, n))] for n in (12, 20))
        score, start, stop = decontam.align(np.array(a), np.array(b))
        assert score == plain_score(a, b) and (not score or plain_score(a, b[start:stop]) == score)


def test_passages(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    item = rng.sample(vocabulary, 40)
    filler = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    edited = [w if i % 8 else "changed" for i, w in enumerate(item)]
    docs = [
        (1, " ".join(filler(200) + item + filler(100))), (2, " ".join(filler(50) + edited + filler(50))), (3, " ".join(filler(300))),
        (4, " ".join(item[:12] + filler(200))), (5, ", ".join(w.upper() for w in item)), (6, " ".join(item + filler(90) + item)),
        (7, None), (8, ""), (1, " ".join(item)), (None, " ".join(item)), (9, "tiny one"), (10, "not tiny two"),
    ]
    rows = spark.createDataFrame([(*d, 0) for d in docs], f"{KINDS}, score int")
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "tiny one")], "item_id int, text string")
    got = decontam.contaminated(rows, items).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in got) == [(-1, 1), (1, 1), (1, 1), (2, 1), (5, 1), (6, 1), (6, 1), (9, 4)]
    first = next(r for r in got if r.doc_id == 6)
    assert docs[5][1][first.start : first.stop] == " ".join(item) and first.similarity == 1
    left = decontam.without_contaminated(rows, items)
    assert left.columns == rows.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 7, 8, 10]
    assert decontam.contaminated(rows.limit(0), items).count() == 0 and decontam.contaminated(rows, items.limit(0)).count() == 0
    assert decontam.without_contaminated(rows, items.limit(0)).count() == len(docs)


def test_repeated_passage_still_has_seeds(spark):
    """A passage in most documents is found in all of them."""
    words = [f"p{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, f"start{i} " + " ".join(words) + f" end{i}") for i in range(60)], KINDS)
    items = spark.createDataFrame([(1, " ".join(words))], "item_id int, text string")
    assert decontam.contaminated(docs, items).count() == 60


def test_edited_passages(spark):
    """Copies edited at every 4th to 6th word and at random, alone, beside exact copies, and beside
    documents that hold the edited 3-grams."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    items, docs, want = [], [], set()
    for k in range(120):
        item = rng.sample(vocabulary, rng.choice([15, 38]))
        items.append((k, " ".join(item)))
        if k % 3 == 1:
            docs.append((10_000 + k, " ".join(item)))
            want.add((10_000 + k, k))
        for every in (4, 5, 6, 0):
            changed = set(range(every - 1, len(item), every)) if every else set(rng.sample(range(len(item)), round(len(item) * rng.uniform(0.15, 0.3))))
            copy = [f"new{k}" if i in changed else w for i, w in enumerate(item)]
            whole = any(not changed & {i, i + 1, i + 2} for i in range(len(item) - 2))
            number = {w: i for i, w in enumerate(dict.fromkeys(item + copy))}
            score = decontam.align(np.array([number[w] for w in item]), np.array([number[w] for w in copy]))[0]
            key = 10 * k + every
            if whole and score >= decontam.needed(len(item)):
                want.add((key, k))
            docs.append((key, " ".join([*rng.sample(vocabulary, 40), *copy, *rng.sample(vocabulary, 40)])))
        if k % 3 == 2:
            docs += [(20_000 + 100 * k + i, " ".join(item[i : i + 3])) for i in range(len(item) - 2)]
    got = decontam.contaminated(spark.createDataFrame(docs, KINDS), spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) > 450 and {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_chain_budgets_keep_every_link():
    """Every pair within the limit shares a bucket and keeps the chain of its start."""
    rng = random.Random(9)
    for limit in (4, 5):
        for depth in (1, 2, 3):
            kinds, chains = simhash.key_masks(limit, depth), simhash.chain_masks(limit)
            for _ in range(300):
                a = rng.getrandbits(64)
                x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, limit)))
                assert any(not x & (m & (1 << 64) - 1) and all((x & c).bit_count() <= n for c, n in chains[s]) for s, m in kinds), (a, x)


@pytest.mark.parametrize("small,large", [(64, 20_000), (2, 3)])
def test_links_connect_all(spark, monkeypatch, small, large):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(small)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(prints)]
    rows = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(rows, 4, 2, large)).collect()}
    left, number, k = set(prints), {}, 0
    while left:
        todo = [left.pop()]
        while todo:
            x = todo.pop()
            number[x] = k
            near = {y for y in left if (x ^ y).bit_count() <= 4}
            left -= near
            todo += near
        k += 1
    same = {}
    for x, s in zip(sorted(prints), signed, strict=True):
        assert same.setdefault(number[x], roots.get(s, s)) == roots.get(s, s)
    assert len(set(same.values())) == k


def test_components_of_paths_and_stars(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 200)] + [(7, 7), (3, 2), (300, 301), (300, 301)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 200)}) == 1 and len(set(got.values())) == 3
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark):
    rng = random.Random(3)
    base = [f"word{rng.randint(0, 9999)}" for _ in range(150)]
    near, far = list(base), list(base)
    near[70] = "changed"
    for i in range(0, 150, 4):
        far[i] = f"new{i}"
    rows = [(3, " ".join(base)), (2, " ".join(near)), (1, " ".join(far)), (4, " ".join(base).upper()), (2, " ".join(near)), (None, " ".join(base)),
            (5, None), (6, ""), (7, "alone here")]
    got = simhash.one_of_each(spark.createDataFrame([(*r, "x") for r in rows], f"{KINDS}, node string"))
    assert got.columns == ["doc_id", "text", "node"] and sorted(r.doc_id for r in got.collect()) == [1, 2, 5, 7]
    assert simhash.one_of_each(spark.createDataFrame([], KINDS)).count() == 0


def kept_by_hand(rows):
    """Ids ``one_of_each`` keeps, over all pairs."""
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for _, t in rows]
    up = classes(range(len(rows)), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[up[k]] = min(i, least.get(up[k], i))
    return sorted(least.values())


@pytest.mark.parametrize("small", [64, 3])
def test_pairs_of_dissimilar_stands(spark, monkeypatch, small):
    """Texts of one bag of words have one fingerprint, whose stand resembles few of them; a common
    passage, and large buckets."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(small)
    bag = [f"word{i}" for i in range(150)]
    texts = []
    for _ in range(40):
        rng.shuffle(bag)
        turned = list(bag)
        turned[70], turned[71] = turned[71], turned[70]
        texts += [list(bag), turned]
    passage = [f"common{i}" for i in range(60)]
    for k in range(80):
        texts.append([*passage, *(f"own{k}x{i}" for i in range(15 if k % 2 else 12))])
    chain = [f"link{i}" for i in range(120)]
    for k in range(80):
        texts.append([f"late{k - j}" if j <= k else w for j, w in enumerate(chain)] if k < 60 else chain[k - 60 :])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = simhash.one_of_each(spark.createDataFrame(rows, KINDS))
    want = kept_by_hand(rows)
    assert 40 < len(want) < 200 and sorted(r.doc_id for r in got.collect()) == want


def test_kinds_of_copies(spark):
    """Cut, extended and edited copies of texts of Zipf words."""
    rng = random.Random(21)
    words = [f"z{i}" for i in range(5000)]
    weights = [1 / (i + 1) for i in range(5000)]
    rows, kind = [], {}
    for k in range(180):
        n, share = rng.choice([60, 200, 600]), rng.uniform(0.02, 0.24)
        base = rng.choices(words, weights, k=n)
        copies = {
            "cut": base[: n - int(n * min(share, 0.19))], "extended": base + rng.choices(words, weights, k=int(n * share)),
            "edited": [rng.choice(words) if rng.random() < share / 6 else w for w in base],
        }
        name = list(copies)[k % 3]
        kind[2 * k + 1] = name
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copies[name]))]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, KINDS)).collect()}
    want = set(kept_by_hand(rows))
    drops = Counter(v for i, v in kind.items() if i not in want)
    missed = Counter(v for i, v in kind.items() if i in kept - want)
    assert min(drops.values()) > 20 and len(drops) == 3
    assert kept == want, f"missed {dict(missed)} of {dict(drops)}"


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>no</title><script>var t="</p>";</script></head><body><p>One &lt;b&gt;<b>two
      <br>three<p>four &amp five<!-- <p>no --><ul><li>a<li>b</ul><div title=">">c</div><textarea>no</textarea>&eacute;&nbsp;x"""
    assert [b.text for b in html_blocks.blocks(page)] == ["One <b>two three", "four & five", "a", "b", "c", "é x"]
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<p") == [] and [b.text for b in html_blocks.blocks("<p>a<")] == ["a<"]


def test_gradients():
    rng = np.random.default_rng(0)
    x, mask, y = rng.normal(size=(4, 3, html_blocks.INPUT)), np.ones((4, 3)), (rng.random((4, 3)) > 0.5) * 1.0
    mask[2:, 1] = 0
    net = html_blocks.Labeller(1)

    def loss():
        z, _ = net.logits(x, mask)
        return float(((np.log1p(np.exp(z)) - y * z) * mask).sum() / mask.sum())

    for name, g in net.gradients(x, mask, y).items():
        i = tuple(rng.integers(s) for s in g.shape)
        was = net.p[name][i]
        net.p[name][i] = was + 1e-5
        up = loss()
        net.p[name][i] = was - 1e-5
        down = loss()
        net.p[name][i] = was
        assert (up - down) / 2e-5 == pytest.approx(g[i], abs=1e-6)


def test_labeller_on_new_layouts(spark):
    pages = [r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").orderBy("page_id").collect()]
    model = html_blocks.train(pages[:35], layouts=400)
    rng = np.random.default_rng(5)
    texts = [[b.text for b in html_blocks.blocks(p) if "article" in b.path] for p in pages[35:]]
    others = [b.text for p in pages[35:] for b in html_blocks.blocks(p) if "article" not in b.path]
    right = n = 0
    for k in range(120):
        found = html_blocks.blocks(html_blocks.layout(rng, texts[k % len(texts)], others))
        z = model.label([html_blocks.vectors(found)])[0]
        right += sum((v > 0 and not b.barred) == b.main for v, b in zip(z, found, strict=True))
        n += len(found)
    assert right / n > 0.97
    rows = spark.createDataFrame([(1, "u", None, 9), (1, "u", None, 9), (2, None, "", 9), (None, "v", "<p>" + "x " * 50_000, 9), (3, "w", pages[0], 9)],
                                 "page_id long, url string, html string, n_chars int")
    got = html_blocks.extract(rows, model).collect()
    assert len(got) == 5 and [r.text for r in got[:3]] == ["", "", ""] and all(r.n_chars == len(r.text) for r in got)
    assert html_blocks.extract(rows.limit(0), model).count() == 0


def test_extracted_article(spark):
    import html
    import re

    from vocalis.llm.queries import QUERIES

    got = {r.page_id: r.text for r in QUERIES["op8_block_labeller"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", article)]
        assert got[r.page_id] == "\n\n".join(x for x in parts if x)


def test_fingerprint_of_long_texts():
    text = "some words over and over again " * 15_000
    assert simhash.fingerprint(text.encode()) == fingerprint(text)
