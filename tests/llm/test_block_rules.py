"""Which blocks a page has, which elements bar them, and pages whose markup misleads."""

import time

import numpy as np
import pytest

from vocalis.llm import html_blocks
from vocalis.llm.html_blocks import blocks

SMALL = "/root/testdata/sf0.001"


def texts(page):
    return [b.text for b in blocks(page)]


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(pages):
    return html_blocks.train(pages[:35], layouts=400)


def test_formulas_are_text():
    assert texts("<p>Let <math><mi>x</mi><annotation>\\x</annotation></math> be</p>") == ["Let x be"]
    assert texts("<p>a</p><math><p>b</p></article><p>tail</p>") == ["a", "b", "tail"]


def test_graphics_end():
    assert texts("<p>a<svg><title>x</title><svg></svg>y</svg>b") == ["ab"]
    assert texts("<p>a<svg/>b") == ["ab"]
    assert texts("<p>a<svg>x<p>b") == ["a", "b"]
    assert texts("<p>a<svg><foreignObject><div>x</div></foreignObject>y</svg>b") == ["ab"]
    assert texts("<div>a<svg>x</div>b") == ["a", "b"]


def test_scripts_are_no_text():
    assert texts("<script src=/a/>var leak=1;</script><p>k") == ["k"]
    assert texts('<script src="a"/>var leak=1;</script><p>k') == ["k"]
    assert texts('<script src="a"/><p>k</p><script>no</script>') == ["k"]
    assert texts('<script src="a"/><p>k') == ["k"]
    assert texts("<p>a<script>no") == ["a"] and texts("<p>a<object>b") == ["ab"] and texts("<p>a<object>no</object>b") == ["ab"]


def test_what_is_barred():
    def barred(page):
        return {b.text: b.barred for b in blocks(page)}

    assert barred("<form><nav>m</nav><div><article><p>a</p><form>in</form></article></div>z</form>") == {"m": True, "a": False, "in": True, "z": False}
    assert barred("<aside>x<article><p>a</p></article><footer>f") == {"x": False, "a": False, "f": True}
    assert barred("<aside>x</aside><main>a<aside>y</aside></main>") == {"x": True, "a": False, "y": True}
    assert barred("<form><p>most of the text<nav>m</nav></form>z") == {"most of the text": False, "m": True, "z": False}
    assert barred("<p>most of the text</p><form>few</form>") == {"most of the text": False, "few": True}


def test_names_far_above_are_seen():
    near, far = (blocks(f'<div class="comments">{"<div>" * k}<p>a') for k in (1, 30))
    bare = blocks(f'<div>{"<div>" * 30}<p>a')
    slot = html_blocks._slot(".comments") % html_blocks.PATH
    x = [html_blocks.vectors(p)[0, slot] for p in (near, far, bare)]
    assert x[0] > x[1] == pytest.approx(html_blocks.FAR) and x[2] == 0
    assert not any(b.around >> slot & 1 for b in blocks('<div class="comments"><p>a</div><p>b')[1:])


@pytest.mark.parametrize("piece", ["<div>x", "<p><button><div>x", "<object>x", "<script/>x", "<svg><desc>", "<li>x", "<form><article>x", "</div>x"])
def test_time_follows_length(piece):
    began = time.time()
    found = blocks(piece * 100_000)
    assert time.time() - began < 20
    assert "svg" in piece or sum(len(b.text) for b in found) >= 100_000


def kept(model, page):
    found = blocks(page)
    return html_blocks.main_text(found, model.label([html_blocks.vectors(found)])[0])


def test_page_in_one_form(pages, model):
    """The article of a page is found whole where a form, or an aside that nothing closes, is around it."""
    for page in pages[35:]:
        plain = kept(model, page)
        assert plain == [b.text for b in blocks(page) if "article" in b.path]
        for around in ("<form id=f>", "<aside>"):
            assert kept(model, page.replace("<body>", f"<body>{around}")) == plain


def test_form_without_article(pages, model):
    """Layouts below one form, with neither article nor main: labels as right as elsewhere."""
    rng, right, n = np.random.default_rng(3), 0, 0
    own = [[b.text for b in blocks(p) if "article" in b.path] for p in pages[35:]]
    others = [b.text for p in pages[35:] for b in blocks(p) if "article" not in b.path]
    for k in range(150):
        page = html_blocks.layout(rng, own[k % len(own)], others)
        if "<article" in page or "<main" in page or "<form>" in page:
            continue
        found = blocks(page.replace("<body>", "<body><form>"))
        z = model.label([html_blocks.vectors(found)])[0]
        right += sum((v > 0 and not b.barred) == b.main for v, b in zip(z, found, strict=True))
        n += len(found)
    assert n > 200 and right / n > 0.93

