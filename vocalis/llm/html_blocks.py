"""Main text of web pages: a recurrent labeller of text blocks.

A page is cut into leaf blocks: text that no block-level tag interrupts.  Every block becomes a
vector of its hashed tag path (tag names, words of classes and ids), its hashed words and a few
measures; a bidirectional LSTM in numpy reads the sequence of the whole page and labels every
block.  It is trained on a bounded sample of pages, labelled by their own semantic tags, and on
their texts laid out anew in other kinds of pages, whose labels are known by construction.

Block text: character references decoded after the markup is gone, white space to one space,
trimmed.  Text of script, style, title and the like, of graphics and of comments is no text;
formulas are.  Blocks below nav, footer, aside, form or dialog are no main text, unless that
element is around an article or main, or on a page without these around more than half of the
text: then the page is read as if the element were not there, and the model decides.

Defined results: NULL or empty html gives an empty text; broken markup is read as far as it goes,
in time that grows with its length whatever its depth; repeated rows are read each; other columns
are ignored.  An empty table gives no rows, and a model trained on no page with an article or
main labels by an untrained network.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.common import chunks, utf8

# --- fixed values: kinds of tags ----------------------------------------------------------
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split())
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style title textarea template noscript svg annotation annotation-xml object canvas audio video iframe".split())
# Start tags that end a graphic, besides those of blocks.
NOT_IN_GRAPHICS = frozenset("b big br code em embed i img meta nobr ruby s small span strong strike sub sup tt u var".split())
CLOSES_P = BLOCK_TAGS - {"html", "head", "body", "button", "option", "optgroup", "caption", "legend"}
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
NEVER = frozenset("nav footer aside form dialog select button".split())
ARTICLES = frozenset(["article", "main"])
# ----------------------------------------------------------------------------------------
PATH, WORDS, MEASURES, HIDDEN = 128, 64, 8, 24
#: Elements whose tokens count by nearness, and the weight of all others above a block.
NEAR, FAR = 6, 0.4
INPUT = PATH + WORDS + MEASURES
SAMPLE_PAGES, LAYOUTS, EPOCHS, RATE, SEED = 300, 700, 10, 0.01, 11
#: Pages labelled together, and padded blocks of a group.
TOGETHER, PADDED = 256, 1 << 14
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
MARKS = re.compile(r"""\b(class|id|role|data-main)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[a-z]+")
OPEN_VALUE = re.compile(r"=\s*[^\s\"'>]+/\Z")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # tokens of the nearest elements, last those of a barrier
    around: int  # bits of the slots that the tokens of all elements around it fall into
    link_chars: int
    main: bool  # below an element that says so; for training only
    article: bool  # below an article or main
    barred: bool


@dataclass
class Element:
    tag: str
    tokens: tuple[str, ...]
    main: bool
    slots: tuple[int, ...]
    barrier: int  # the nearest barrier, itself included; -1 for none
    is_barrier: bool


class Stack:
    """Open elements.  Names, slots and marks are counted as elements open and close, so that
    neither a block nor a tag walks the stack, however deep the markup is.

    Elements of the kinds in ``NEVER`` are barriers, numbered as they open.  What they are around
    is known at the end of the page only, so their names are kept apart from the others'."""

    def __init__(self) -> None:
        self.open: list[Element] = []
        self.plain: list[Element] = []  # those that are no barriers
        self.places: dict[str, list[int]] = {}  # tag -> its places in ``open``
        self.counts, self.around, self.mains, self.within = [0] * PATH, 0, 0, 0
        self.barriers: list[Element] = []
        self.outer: list[int] = []  # barrier -> the barrier around it
        self.chars: list[int] = []
        self.holds: list[bool] = []  # an article or main opens below it
        self.articles, self.total = 0, 0  # of the whole page; characters of its blocks

    def push(self, tag: str, tokens: tuple[str, ...], main: bool) -> None:
        barrier, slots = self.barrier(), tuple({_slot(t) % PATH for t in tokens})
        if tag in ARTICLES:
            self.articles += 1
            self.within += 1
            if barrier >= 0:
                self.holds[barrier] = True
        if tag in NEVER:
            self.outer.append(barrier)
            self.chars.append(0)
            self.holds.append(False)
            new = Element(tag, tokens, main, slots, len(self.barriers), True)
            self.barriers.append(new)
        else:
            for k in slots:
                self.counts[k] += 1
                self.around |= 1 << k
            new = Element(tag, tokens, main, slots, barrier, False)
            self.plain.append(new)
        self.places.setdefault(tag, []).append(len(self.open))
        self.mains += main
        self.open.append(new)

    def barrier(self) -> int:
        return self.open[-1].barrier if self.open else -1

    def close(self, tag: str, within: tuple[str, ...] = ()) -> None:
        """Closes the nearest element of this tag and all in it, unless one of ``within`` is nearer."""
        own = self.places.get(tag)
        if not own or any((other := self.places.get(w)) and other[-1] > own[-1] for w in within):
            return
        to = own[-1]
        while len(self.open) > to:
            x = self.open.pop()
            self.places[x.tag].pop()
            self.mains -= x.main
            self.within -= x.tag in ARTICLES
            if x.is_barrier:
                continue
            self.plain.pop()
            for k in x.slots:
                self.counts[k] -= 1
                if not self.counts[k]:
                    self.around &= ~(1 << k)

    def bars(self) -> list[int]:
        """For every barrier the nearest one, itself included, that keeps its blocks out of the main
        text, or -1: all do but those around an article or main, or, on a page without, around
        more than half of its text."""
        holds, chars = list(self.holds), list(self.chars)
        for k in range(len(chars) - 1, -1, -1):
            if self.outer[k] >= 0:
                holds[self.outer[k]] |= holds[k]
                chars[self.outer[k]] += chars[k]
        out: list[int] = []
        for k, o in enumerate(self.outer):
            around = holds[k] if self.articles else 2 * chars[k] > self.total
            out.append(k if not around else out[o] if o >= 0 else -1)
        return out

    def masks(self, bars: list[int]) -> list[int]:
        """Bits of the slots of every barrier and those around it, of those that bar."""
        out: list[int] = []
        for k, o in enumerate(self.outer):
            own = sum(1 << j for j in self.barriers[k].slots) if bars[k] == k else 0
            out.append(own | (out[o] if o >= 0 else 0))
        return out

def _skip(page: str, at: int, tag: str, slash: bool, unclosed: set[str]) -> int:
    """Where reading goes on after the start tag of an element whose text is none.

    Graphics end at their end tag, or at a tag that cannot stand in one.  Scripts and styles without
    an end tag run to the end of the page; of other elements without one only the tag is left out.
    A start tag with a slash counts as closed if another one comes before the next end tag."""
    if tag == "svg":
        depth, html_below = 0 if slash else 1, 0
        while depth:
            m = TAG.search(page, at)
            if not m:
                return len(page)
            name, shut = (m[2] or "").lower(), m[3] and m[3].endswith("/")
            if name == "svg":
                depth += -1 if m[1] else 0 if shut else 1
            elif name in ("foreignobject", "desc", "title"):
                html_below = max(html_below + (-1 if m[1] else 0 if shut else 1), 0)
            elif not html_below and (name in BLOCK_TAGS or (name in NOT_IN_GRAPHICS and not m[1])):
                return m.start()
            at = m.end()
        return at
    if tag in unclosed:
        return at
    m = re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>?" if slash else rf"<(/){re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
    if m:
        return m.end() if m[1] else at
    unclosed.add(tag)
    return len(page) if tag in ("script", "style") and not slash else at


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, none empty."""
    out: list[Block] = []
    below: list[int] = []  # nearest barrier of every block
    stack, parts, unclosed = Stack(), [], set()
    linked = links = 0

    def flush() -> None:
        nonlocal links
        if not parts:
            return
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            tokens = tuple(t for x in stack.plain[-NEAR:] for t in x.tokens)
            out.append(Block(text, tokens, stack.around, min(links, len(text)), stack.mains > 0, stack.within > 0, False))
            below.append(stack.barrier())
            stack.total += len(text)
            if below[-1] >= 0:
                stack.chars[below[-1]] += len(text)
        links = 0

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if linked:
                links += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
                stack.close(tag)
            elif tag == "a":
                linked = 0
            continue
        if tag in SILENT_TAGS:
            # A slash that ends an unquoted value belongs to the value.
            at = _skip(page, at, tag, m[3].endswith("/") and not OPEN_VALUE.search(m[3]), unclosed)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            linked = 1
        elif tag in BLOCK_TAGS:
            flush()
            if tag in CLOSES_P:
                stack.close("p", ("button", "td", "th", "caption", "body"))
            if tag in CLOSED_BY_SAME:
                stack.close(tag, CLOSED_BY_SAME[tag])
            if tag not in EMPTY_TAGS:
                tokens, main = [tag], False
                for name, value in MARKS.findall(m[3]) if m[3] else ():
                    if name.lower() == "data-main":
                        main = True
                    else:
                        tokens += [f".{w}" for w in WORD.findall(value.lower())]
                stack.push(tag, tuple(dict.fromkeys(tokens)), main)
    flush()
    bars = stack.bars()
    masks = stack.masks(bars)
    for b, k in zip(out, below, strict=True):
        if k >= 0 and bars[k] >= 0:
            b.path, b.barred = b.path + stack.barriers[bars[k]].tokens, True
        if k >= 0:
            b.around |= masks[k]
    return out


_slots: dict[str, int] = {}


def _slot(word: str) -> int:
    got = _slots.get(word)
    if got is None:
        if len(_slots) > 200_000:
            _slots.clear()
        got = _slots[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return got


def vectors(page: list[Block]) -> np.ndarray:
    """One row of ``INPUT`` numbers per block."""
    x = np.zeros((len(page), INPUT), np.float32)
    for i, b in enumerate(page):
        for k, token in enumerate(reversed(b.path)):
            x[i, _slot(token) % PATH] += 1 / (1 + 0.1 * k)
        above = np.frombuffer(b.around.to_bytes(PATH // 8, "little"), np.uint8)
        np.maximum(x[i, :PATH], FAR * np.unpackbits(above, bitorder="little"), out=x[i, :PATH])
        words = b.text.split(" ")
        count = np.bincount([_slot(w) % WORDS for w in words], minlength=WORDS)
        x[i, PATH : PATH + WORDS] = count / np.sqrt((count * count).sum())
        size = len(b.text)
        x[i, PATH + WORDS :] = (
            np.log1p(size) / 5, np.log1p(len(words)) / 4, b.link_chars / size, i / len(page), (len(page) - i) / len(page),
            b.text[-1] in ".!?", b.text[0].isupper(), 1.0)
    return x


class Labeller:
    """A bidirectional LSTM with a logistic output for every block."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {"o": rng.normal(0, 0.1, 2 * HIDDEN), "c": np.zeros(1)}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, 0.08, (INPUT, 4 * HIDDEN))
            self.p[f"u{d}"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
            self.p[f"a{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # input, forget, output, cell

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (time, page, HIDDEN) of one direction; padding keeps the state."""
        steps, pages, _ = x.shape
        kind = self.p["o"].dtype
        h, c, mask = np.zeros((pages, HIDDEN), kind), np.zeros((pages, HIDDEN), kind), mask.astype(kind)
        out, saved = np.empty((steps, pages, HIDDEN), kind), []
        given = x.astype(kind, copy=False) @ self.p[f"w{d}"] + self.p[f"a{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.p[f"u{d}"]
            gate = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = np.split(gate, 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                saved.append((t, h, c, i, f, o, g, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * new + (1 - m) * c
            out[t] = h
        return out, saved

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = True) -> tuple[np.ndarray, tuple]:
        hf, sf = self._run(x, mask, "f", keep)
        hb, sb = self._run(x, mask, "b", keep)
        both = np.concatenate([hf, hb], axis=2)
        return both @ self.p["o"] + self.p["c"], (both, sf, sb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, (both, sf, sb) = self.logits(x, mask)
        dz = (1 / (1 + np.exp(-z)) - y) * mask / mask.sum()
        g = {"o": np.einsum("tp,tph->h", dz, both), "c": np.array([dz.sum()])}
        dboth = dz[:, :, None] * self.p["o"]
        for d, saved, dh_out in (("f", sf, dboth[:, :, :HIDDEN]), ("b", sb, dboth[:, :, HIDDEN:])):
            u = self.p[f"u{d}"]
            dz_all, gu = np.zeros((*mask.shape, 4 * HIDDEN)), np.zeros_like(u)
            dh, dc = np.zeros_like(saved[0][1]), np.zeros_like(saved[0][1])
            for t, h, c, i, f, o, gg, tc, m in reversed(saved):
                dh = dh + dh_out[t]
                live = dh * m
                dnew = dc * m + live * o * (1 - tc * tc)
                dgate = np.concatenate([dnew * gg * i * (1 - i), dnew * c * f * (1 - f), live * tc * o * (1 - o), dnew * i * (1 - gg * gg)], axis=1)
                dz_all[t] = dgate
                gu += h.T @ dgate
                dh, dc = dgate @ u.T + dh * (1 - m), dnew * f + dc * (1 - m)
            g[f"u{d}"], g[f"a{d}"] = gu, dz_all.sum((0, 1))
            g[f"w{d}"] = x.reshape(-1, INPUT).T @ dz_all.reshape(-1, 4 * HIDDEN)
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Labeller:
        """Adam over groups of 32 pages of like length."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, order = 0, sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        groups = [order[k : k + 32] for k in range(0, len(order), 32)]
        for epoch in range(epochs):
            for k in rng.permutation(len(groups)):
                x, mask = padded([pages[i][0] for i in groups[k]])
                y = np.zeros(mask.shape)
                for j, i in enumerate(groups[k]):
                    y[: len(pages[i][1]), j] = pages[i][1]
                step += 1
                for name, d in self.gradients(x, mask, y).items():
                    d = np.clip(d, -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * d
                    v[name] = 0.99 * v[name] + 0.01 * d * d
                    self.p[name] -= rate * (1 - epoch / epochs) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Log-odds of main text for every block of every page."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at + 1) * len(pages[order[to]]) <= PADDED:
                to += 1
            x, mask = padded([pages[i] for i in order[at:to]])
            z, _ = self.logits(x, mask, keep=False)
            for j, i in enumerate(order[at:to]):
                out[i] = z[: len(pages[i]), j]
            at = to
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, page, INPUT) and the mask of real blocks."""
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)))
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


# --- fixed values: names that pages give to their parts -----------------------------------
MAIN_NAMES = ["content", "post-body", "entry-content", "article-body", "story", "main-text", "post", "page-content"]
OTHER_PARTS = {
    "menu": ["menu", "navbar", "top-nav", "breadcrumb", "site-nav"], "header": ["site-header", "masthead", "branding"],
    "footer": ["site-footer", "copyright", "legal"], "sidebar": ["sidebar", "widget", "related", "rail"],
    "notice": ["cookie-notice", "banner", "alert", "consent", "notice"], "ad": ["ad", "advert", "sponsored", "promo"],
    "form": ["newsletter", "search-form", "login", "subscribe"], "comments": ["comments", "comment-list", "replies", "disqus", "reader-comments"],
}
OTHER_TAGS = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div"],
              "notice": ["div", "section"], "ad": ["div", "aside", "section"], "form": ["form", "div"], "comments": ["section", "div", "ul"]}
# ----------------------------------------------------------------------------------------


def layout(rng: np.random.Generator, article: list[str], snippets: list[str]) -> str:
    """A page of a random kind around the paragraphs of an article."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    escaped = lambda s: html.escape(s)

    def part(kind: str) -> str:
        tag, name = pick(OTHER_TAGS[kind]), pick(OTHER_PARTS[kind])
        named = f' {pick(["class", "id"])}="{name}"' if tag in ("div", "section", "ul") or rng.random() < 0.5 else ""
        texts = [escaped(pick(snippets)) for _ in range(int(rng.integers(1, 6)))]
        if kind == "menu" or (kind == "sidebar" and rng.random() < 0.5):
            items = "".join(f'<li><a href="#">{" ".join(t.split()[:3])}</a></li>' for t in texts)
            inner = items if tag == "ul" else f"<ul>{items}</ul>"
        elif kind == "form":
            inner = f"<label>{texts[0]}</label><input name=q><button>{texts[-1].split(' ')[0]}</button>"
        elif kind == "comments":
            inner = "".join((f'<li class="comment"><p>{t}</p></li>' if tag == "ul" else f'<div class="comment"><p>{t}</p></div>') for t in texts)
        elif kind == "footer":
            inner = f"&copy; {texts[0]}" if rng.random() < 0.5 else f"<p>&copy; {texts[0]}</p>"
        else:
            inner = texts[0] if rng.random() < 0.5 else "".join(f"<p>{t}</p>" for t in texts[:2])
        if rng.random() < 0.15 and tag != "ul":  # named far above its text
            deep = int(rng.integers(1, 10))
            inner = "<div>" * deep + inner + "</div>" * deep
        return f"<{tag}{named}>{inner}</{tag}>"

    tag = pick(["article", "main", "div", "section", "div", "article"])
    named = f' class="{pick(MAIN_NAMES)}"' if rng.random() < (0.85 if tag in ("div", "section") else 0.3) else ""
    inside: list[str] = []
    if article and rng.random() < 0.8:
        inside.append(f"<{pick(['h1', 'h2'])}>{escaped(article[0])}</{'h1'}>")
    for i, text in enumerate(article[1:] or article):
        kind = rng.random()
        body = escaped(text)
        if kind < 0.05:
            inside.append(f"<blockquote>{body}</blockquote>")
        elif kind < 0.1:
            inside.append("<ul>" + "".join(f"<li>{x}</li>" for x in body.split(". ")) + "</ul>")
        elif kind < 0.15:
            inside.append(f"<h2>{' '.join(body.split()[:4])}</h2><p>{body}")
        elif kind < 0.2:
            inside.append(f"<div>{body}</div>")
        else:
            inside.append(f"<p>{body}" + ("</p>" if rng.random() < 0.8 else ""))
    marked = "".join(inside)
    before = [part(k) for k in ("notice", "header", "menu", "ad", "form", "sidebar") if rng.random() < 0.45]
    after = [part(k) for k in ("comments", "ad", "sidebar", "form", "menu", "footer", "notice") if rng.random() < 0.45]
    if rng.random() < 0.4 and inside:  # a part of another kind amid the article
        cut = int(rng.integers(1, len(inside) + 1))
        other = part(pick(["ad", "form", "comments", "notice", "sidebar"]))
        core = f'<div data-main>{"".join(inside[:cut])}</div>{other}' + (f'<div data-main>{"".join(inside[cut:])}</div>' if inside[cut:] else "")
        core = f"<{tag}{named}>{core}</{tag}>"
    else:
        core = f"<{tag}{named} data-main>{marked}</{tag}>"
    if rng.random() < 0.3:
        core = f'<div class="{pick(["wrapper", "container", "page"])}">{core}</div>'
    return f"<html><head><title>{escaped(article[0]) if article else ''}</title></head><body>{''.join(before)}{core}{''.join(after)}</body></html>"


def train(pages: list[str], layouts: int = LAYOUTS, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller from sample pages: those with an ``article`` or ``main`` as they are, and new
    layouts of their texts."""
    rng, data, articles, snippets = np.random.default_rng(seed), [], [], []
    for page in pages:
        found = blocks(page)
        main = [b.article and not b.barred and not any(t in (".ad", ".advert", ".comments", ".comment") for t in b.path) for b in found]
        if found and any(main):
            data.append((vectors(found), np.array(main, float)))
            articles.append([b.text for b, k in zip(found, main, strict=True) if k])
            snippets += [b.text for b, k in zip(found, main, strict=True) if not k]
    if articles:
        snippets += [t for a in articles for t in a[:1]]
        for k in range(layouts):
            found = blocks(layout(rng, articles[k % len(articles)][:40], snippets))
            data.append((vectors(found), np.array([b.main for b in found], float)))
    return Labeller(seed).fit(data, epochs, seed=seed) if data else Labeller(seed)


def sample_pages(pages: DataFrame, key: str = "page_id", text: str = "html", rows: int = SAMPLE_PAGES) -> list[str]:
    """Whole html of at most ``rows`` pages of the smallest hash, each of at most 64 kB."""
    short = pages.where(F.octet_length(text) <= 1 << 16)
    ids = short.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(rows)
    return [r[1] for r in short.join(F.broadcast(ids), key, "left_semi").select(key, text).dropDuplicates([key]).orderBy(key).collect()]


def main_text(page: list[Block], odds: np.ndarray) -> list[str]:
    return [b.text for b, z in zip(page, odds, strict=True) if z > 0 and not b.barred]


def extract(pages: DataFrame, model: Labeller, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """``key, url, text, n_chars, n_blocks, n_main``: one row per page."""
    weights = {k: v.astype(np.float32) for k, v in model.p.items()}

    def work(batches):
        import pyarrow as pa

        own = Labeller()
        own.p = weights
        for part in chunks(batches, column="html"):
            for lo in range(0, part.num_rows, TOGETHER):
                group = part.slice(lo, TOGETHER)
                found = [blocks((x.as_py() or b"").decode("utf-8", "replace")) for x in group.column("html")]
                odds = own.label([vectors(f) for f in found])
                kept = [main_text(f, z) for f, z in zip(found, odds, strict=True)]
                texts = ["\n\n".join(k) for k in kept]
                yield pa.RecordBatch.from_arrays(
                    [group.column(0), group.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([len(f) for f in found], pa.int64()), pa.array([len(k) for k in kept], pa.int64())],
                    ["key", "url", "text", "n_chars", "n_blocks", "n_main"])

    kinds = pages.schema
    schema = f"key {kinds[key].dataType.simpleString()}, url {kinds[url].dataType.simpleString()}, text string, n_chars long, n_blocks long, n_main long"
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), utf8(text).alias("html")).mapInArrow(work, schema)
    return rows.withColumnsRenamed({"key": key, "url": url})
