"""Main text of HTML pages by a tree-structured graphical model.

Every node of a page's tree of blocks is main text or not. A node has a potential from what is seen
of it (tag, words of class, id and role, length, links, punctuation), a pair of parent and child one
from the kind of both. Sum-product messages, from the leaves up and from the root down, give each
node's exact marginal; blocks of text with a marginal of a half or more are the main text.

The potentials are fitted by maximum likelihood on labelled pages: a bounded sample of the given
pages that mark their main text themselves (`article`, `main`), and layouts composed from the text
of that sample, in which menus, notices, adverts, comments and the like are labelled and their tags
and names vary. No feature looks at words of the text, so the model doesn't depend on its language.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .kernels import small
from .runtime import others, sample, ship, table

#: Pages that the model is fitted on at most, characters that each of them may have, and composed layouts.
SAMPLE, SAMPLE_CHARS, LAYOUTS = 300, 20_000, 1200
#: An element is labelled main text if more than one of so many characters in it is.
SHARE = 20
#: Steps and weight of the penalty of the fit, and pages of a step.
STEPS, PENALTY, BATCH = 600, 0.001, 64
#: Pages and characters whose trees pass messages together.
PAGES, CHARS = 128, 4_000_000
_KINDS = 12
_SECTIONS = (dom.ROOT, dom.CONTAINER, dom.MAIN_TAG, dom.FURNITURE_TAG, dom.HEADER_TAG, dom.INLINE)
#: Blocks of text of one section whose evidence counts in full.
KIN = 8
_SIZES = np.array([1, 12, 25, 50, 100, 200, 500, 1000, 3000])
_SHARES = np.array([0.001, 0.15, 0.35, 0.6, 0.9])
_MARKS = np.array([1, 2, 4, 8])


class Forest:
    """The trees of several pages: parents, levels, and the features of each node as indices of potentials."""

    def __init__(self, pages: list[dom.Page]):
        self.pages = pages
        starts = np.cumsum([0, *(len(p.kind) for p in pages)])
        self.starts = starts
        at = lambda name: np.concatenate([np.array(getattr(p, name), np.int64) for p in pages])
        kind, hint, depth = at("kind"), at("hint"), at("depth")
        shift = np.repeat(starts[:-1], np.diff(starts))
        parent = at("parent")
        self.parent = np.where(parent < 0, -1, parent + shift)
        self.kind, self.hint = kind, hint
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        n = len(kind)
        chars, linked, marks, blocks = (np.zeros(n) for _ in range(4))
        ends = np.zeros(n, bool)
        self.texts = np.flatnonzero(kind == dom.TEXT)
        said = [t for p in pages for t in p.text.values()]
        chars[self.texts] = [len(t) for t in said]
        linked[self.texts] = [x for p in pages for x in p.linked.values()]
        marks[self.texts] = [sum(t.count(c) for c in ".!?…;:。！？") for t in said]
        ends[self.texts] = [t[-1] in ".!?…:»”\"。！？" for t in said]
        legal = np.zeros(n, bool)
        legal[self.texts] = ["©" in t or "(c)" in t[:40].lower() for t in said]
        blocks[self.texts] = 1
        for level in reversed(self.levels[1:]):
            for x in (chars, linked, marks, blocks):
                np.add.at(x, self.parent[level], x[level])
        share = linked / np.maximum(chars, 1)
        part = chars / np.maximum(chars[shift], 1)
        text = kind == dom.TEXT
        above = np.maximum(self.parent, 0)
        own = np.where(text, kind[above], kind)
        hinted = hint & 7
        # every column is one feature of each node, as the index of its value in a table of its own
        columns = [
            (text * _KINDS + np.where(text, own, kind), 2 * _KINDS),
            (np.where(text, 8, hinted), 9),
            (np.where(text, 0, 1 + kind * 8 + hinted), 1 + _KINDS * 8),
            (text * 10 + np.searchsorted(_SIZES, chars, "right"), 20),
            (text * 6 + np.searchsorted(_SHARES, share, "right"), 12),
            (text * 5 + np.searchsorted(_MARKS, marks, "right"), 10),
            (np.where(text, 1 + ends, 0), 3),
            (np.where(text, 1 + legal, 0), 3),
            (np.where(text, 0, 1 + np.searchsorted(_SHARES, part, "right")), 7),
            (np.where(text, 0, 1 + np.searchsorted(_MARKS, blocks, "right")), 6),
            (np.where(text, 0, 1 + (hint >> 3)), 3),
        ]
        offset = np.cumsum([0, *(size for _, size in columns)])
        self.features = np.stack([c + o for (c, _), o in zip(columns, offset)], 1)
        self.n_features = int(offset[-1])
        # pairs: the child's kind, and whether its attributes name furniture
        self.pair = (np.where(text, _KINDS - 1, kind) * 3 + np.where(text, 0, np.where(hinted & 1, 1, np.where(hinted & 2, 2, 0)))).astype(np.int64)
        # text in one section speaks no louder than KIN blocks of it, however many there are
        strong = np.isin(kind, _SECTIONS) | ((hint & 3) > 0)
        section = np.where(strong, np.arange(n), 0)
        for level in self.levels[1:]:
            section[level] = np.where(strong[level], level, section[self.parent[level]])
        kin = np.bincount(section[self.texts], minlength=n)
        self.voice = np.where(strong, 1.0, np.minimum(1, KIN / np.maximum(kin[section], 1)))
        self.unseen = (kind == dom.UNSEEN_TAG) | ((hint & dom.HIDDEN) > 0)

    def semantic(self) -> np.ndarray:
        """1 for blocks of text below article or main and no furniture inside it, 0 for others, of pages that have one; -1 for the rest."""
        state = np.zeros(len(self.kind), np.int64)
        for level in self.levels[1:]:
            up = state[self.parent[level]]
            k = self.kind[level]
            state[level] = np.where(k == dom.MAIN_TAG, np.maximum(up, 1) * (up >= 0), np.where((k == dom.FURNITURE_TAG) | (k == dom.UNSEEN_TAG) | (up > 0) & (self.hint[level] & dom.SAYS_FURNITURE > 0), -1, up))
        known = np.add.reduceat((self.kind == dom.MAIN_TAG).astype(int), self.starts[:-1]) > 0
        out = np.where(np.repeat(known, np.diff(self.starts)), (state == 1).astype(int), -1)
        return out[self.texts]


PAIRS = _KINDS * 3


def messages(forest: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product on the trees: log beliefs (node, label) and log beliefs of the pairs (node, label of the parent, own label).

    unary: (node, 2) log potentials; pair: (node, 2, 2), that of a node and its parent.
    """
    n = len(forest.kind)
    total, up = unary.copy(), np.zeros((n, 2))
    for level in reversed(forest.levels[1:]):
        x = total[level][:, None, :] + pair[level]
        up[level] = np.logaddexp(x[:, :, 0], x[:, :, 1])
        np.add.at(total, forest.parent[level], up[level])
    belief, joint = total.copy(), np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        rest = belief[forest.parent[level]] - up[level]
        x = rest[:, :, None] + pair[level]
        belief[level] = total[level] + np.logaddexp(x[:, 0], x[:, 1])
        joint[level] = x + total[level][:, None, :]
    return belief, joint


class Model:
    """Log potentials: `unary` by feature, for main text; `pair` by kind of pair, label of the parent and own label."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def potentials(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        own = np.zeros((len(forest.kind), 2))
        own[:, 1] = self.unary[forest.features].sum(1) * forest.voice
        own[forest.unseen, 1] = -50.0
        return own, self.pair[forest.pair]

    def marginals(self, forest: Forest) -> np.ndarray:
        """The probability of main text for each node."""
        belief, _ = messages(forest, *self.potentials(forest))
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


class _Labelled:
    """Labelled trees, and how often each potential is seen in them."""

    def __init__(self, pages: list[dom.Page], text_labels: list[np.ndarray]):
        self.forest = forest = Forest(pages)
        weight, main = (np.zeros(len(forest.kind)) for _ in range(2))
        weight[forest.texts] = [len(t) for p in pages for t in p.text.values()]
        main[forest.texts] = weight[forest.texts] * np.concatenate(text_labels)
        for level in reversed(forest.levels[1:]):
            for x in (weight, main):
                np.add.at(x, forest.parent[level], x[level])
        label = (SHARE * main > weight).astype(int)
        self.children = children = np.flatnonzero(forest.parent >= 0)
        self.unary = np.bincount(forest.features.ravel(), np.repeat(label * forest.voice, forest.features.shape[1]), forest.n_features)
        self.pair = np.bincount(forest.pair[children] * 4 + label[forest.parent[children]] * 2 + label[children], minlength=4 * PAIRS).reshape(PAIRS, 2, 2).astype(float)

    def slopes(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Those of the log likelihood of one page, on average: seen less expected."""
        forest, children = self.forest, self.children
        belief, joint = messages(forest, *model.potentials(forest))
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        q = joint[children].reshape(-1, 4)
        q = np.exp(q - q.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        expected = np.bincount(forest.features.ravel(), np.repeat(p * forest.voice, forest.features.shape[1]), forest.n_features)
        pairs = np.stack([np.bincount(forest.pair[children], q[:, i], PAIRS) for i in range(4)], 1).reshape(PAIRS, 2, 2)
        return (self.unary - expected) / len(forest.pages), (self.pair - pairs) / len(forest.pages)


def fit(pages: list[dom.Page], text_labels: list[np.ndarray]) -> Model:
    """The model of about the greatest likelihood, by steps over batches of pages; an element is main text if more than a twentieth of the characters in it is."""
    order = np.random.Generator(np.random.PCG64(3)).permutation(len(pages))
    groups = [_Labelled([pages[i] for i in own], [text_labels[i] for i in own]) for own in np.array_split(order, max(1, len(pages) // BATCH))]
    model = Model(np.zeros(groups[0].forest.n_features), np.zeros((PAIRS, 2, 2)))
    first, second = [np.zeros_like(model.unary), np.zeros_like(model.pair)], [np.zeros_like(model.unary), np.zeros_like(model.pair)]
    for step in range(1, STEPS + 1):
        rate = 0.1 * (1 - step / (STEPS + 1))
        for x, slope, a, b in zip((model.unary, model.pair), groups[step % len(groups)].slopes(model), first, second):  # Adam
            slope = slope - PENALTY * x
            a += 0.1 * (slope - a)
            b += 0.01 * (slope * slope - b)
            x += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


# labelled layouts

_FILLER = "lor em ip sum dol or sit am et con sec te tur ad ip is cing el it sed do eius mod tem por".split()
_MAIN_CLASSES = "article article-body post post-content entry entry-content content main main-content story story-body page-content text body-text blog-post".split()
_PLAIN_CLASSES = "wrap container row col inner outer box site grid layout clearfix left center c1 x7".split()
_NAMES = {
    "menu": "nav navbar menu main-menu main-nav site-nav navigation breadcrumb breadcrumbs top-menu nav-links pager toc".split(),
    "head": "header site-header masthead topbar page-header banner head".split(),
    "foot": "footer site-footer page-footer colophon bottom copyright legal foot article-footer".split(),
    "side": "sidebar side-bar rail aside widget widget-area right-sidebar related related-posts popular recommended trending teaser-list content-sidebar".split(),
    "note": "notice cookie-notice cookie-banner consent gdpr alert warning notification popup modal overlay toast".split(),
    "ad": "ad ads advert advertisement ad-slot sponsor sponsored promo banner-ad ad-content".split(),
    "form": "newsletter subscribe subscription search search-box login signup-form contact-form".split(),
    "talk": "comments comment-list comment comment-body discussion responses reader-comments disqus post-comments replies".split(),
    "share": "share social share-buttons social-links tags tag-list post-meta byline author-bio".split(),
}
_TAGS = {"menu": ("nav", "menu", "ul", "div"), "head": ("header", "div"), "foot": ("footer", "div", "p"), "side": ("aside", "div", "section", "td"), "note": ("div", "section", "p", "dialog"), "ad": ("div", "aside", "section", "p"), "form": ("form",), "talk": ("section", "div", "ol", "ul"), "share": ("div", "ul", "p")}
#: What a label looks like at the start of a block's text.
_LABEL = {1: "\ue000", 0: "\ue001"}


class _Composer:
    def __init__(self, rng: random.Random, prose: list[str], short: list[str]):
        self.rng, self.prose, self.short = rng, prose, short

    def pick(self, *options):
        return self.rng.choice(options)

    def words(self, least: int, most: int) -> str:
        text = self.rng.choice(self.short).split()
        n = self.rng.randint(least, most)
        return " ".join((text * (n // max(len(text), 1) + 1))[:n]) or "x"

    def sentences(self, most: int = 60) -> str:
        """Running text of 6 words up to `most`, short runs as often as long ones."""
        words = self.rng.choice(self.prose).split()
        n = round(6 * (most / 6) ** self.rng.random())
        at = self.rng.randrange(max(1, len(words) - n))
        text = " ".join((words[at:] * (n // max(1, len(words) - at) + 1))[:n])
        return text if self.rng.random() < 0.2 else text.rstrip(",;:") + "."

    def tag(self, tag: str, inside: str, name: str = "", close: bool = True) -> str:
        attr = f' {self.pick("class", "class", "id")}="{name}"' if name else ""
        return f"<{tag}{attr}>{inside}</{tag}>" if close else f"<{tag}{attr}>{inside}"

    def text(self, label: int, text: str, linked: bool = False) -> str:
        said = _LABEL[label] + escape(text, quote=False)
        return f'<a href="/x">{said}</a>' if linked else said

    def group(self, kind: str, inside: str, tag: str | None = None) -> str:
        """Furniture, told by its tag, by its name or by both."""
        tag = tag or self.rng.choice(_TAGS[kind])
        told = tag in ("nav", "menu", "header", "footer", "aside", "form", "dialog")
        name = self.rng.choice(_NAMES[kind]) if not told or self.rng.random() < 0.6 else ""
        return self.tag(tag, inside, name)

    def links(self, least: int = 2, most: int = 9) -> str:
        items = [self.text(0, self.words(1, 4), True) for _ in range(self.rng.randint(least, most))]
        if self.rng.random() < 0.7:
            close = self.rng.random() < 0.8
            return self.tag("ul", "".join(self.tag("li", x, close=close) for x in items))
        return self.pick(" | ", " ", " &middot; ").join(items)

    def header(self) -> str:
        name = self.tag(self.pick("h1", "h2", "p", "div", "a"), self.text(0, self.words(1, 4)))
        return self.group("head", name + (self.menu() if self.rng.random() < 0.5 else "") + (self.form() if self.rng.random() < 0.2 else ""))

    def menu(self) -> str:
        return self.group("menu", self.links(3, 12))

    def form(self) -> str:
        inside = self.tag("label", self.text(0, self.words(1, 6))) + '<input name="q">' + self.tag("button", self.text(0, "OK"))
        if self.rng.random() < 0.6:
            inside = self.tag("p", self.text(0, self.sentences())) + inside
        return self.group("form", inside)

    def note(self) -> str:
        inside = "".join(self.tag("p", self.text(0, self.sentences())) for _ in range(self.rng.randint(1, 2)))
        if self.rng.random() < 0.4:
            inside = self.text(0, self.sentences())
        return self.group(self.pick("note", "ad"), inside + (self.tag("button", self.text(0, "OK")) if self.rng.random() < 0.4 else ""))

    def share(self) -> str:
        return self.group("share", self.links(2, 5) if self.rng.random() < 0.6 else self.text(0, self.words(2, 8)))

    def side(self) -> str:
        parts = [self.tag(self.pick("h2", "h3", "h4"), self.text(0, self.words(1, 4)))]
        for _ in range(self.rng.randint(1, 3)):
            parts.append(self.links() if self.rng.random() < 0.5 else self.tag("p", self.text(0, self.sentences())))
        return self.group("side", "".join(parts))

    def foot(self) -> str:
        said = self.text(0, f"© 2020 {self.words(2, 8)}") if self.rng.random() < 0.6 else self.text(0, self.sentences())
        return self.group("foot", (self.links(2, 6) if self.rng.random() < 0.4 else "") + self.tag("p", said) if self.rng.random() < 0.6 else said)

    def talk(self) -> str:
        one = lambda: self.tag("div" if self.rng.random() < 0.6 else "li", (self.tag(self.pick("b", "h4", "span"), self.text(0, self.words(1, 2))) if self.rng.random() < 0.5 else "") + "".join(self.tag("p", self.text(0, self.sentences())) for _ in range(self.rng.randint(1, 2))), self.pick("comment", "reply", ""))
        head = self.tag(self.pick("h2", "h3"), self.text(0, self.words(1, 3))) if self.rng.random() < 0.7 else ""
        return self.group("talk", head + "".join(one() for _ in range(self.rng.randint(1, 6))) + (self.form() if self.rng.random() < 0.3 else ""))

    def main(self) -> str:
        rng, parts = self.rng, []
        title = self.tag("h1", self.text(1, self.words(2, 10)))
        if rng.random() < 0.8:
            parts.append(self.tag("header", title, self.pick("", "entry-header", "article-header")) if rng.random() < 0.25 else title)
        close, alike = rng.random() < 0.8, rng.random() < 0.15  # a text may be one line again and again
        line = self.words(1, 12).capitalize() + "."
        for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 30])):
            roll = rng.random()
            if roll < 0.62 or alike:
                said = self.text(1, line if alike else self.sentences(200) if rng.random() < 0.85 else self.words(1, 3))
                if rng.random() < 0.25:
                    said += f' <a href="/y">{self.words(1, 4)}</a> {self.words(2, 8)}.'
                parts.append(self.tag("p", self.tag("b", said, close=close) if rng.random() < 0.1 else said, close=close))
            elif roll < 0.70:
                parts.append(self.tag("ul", "".join(self.tag("li", self.text(1, self.sentences() if rng.random() < 0.5 else self.words(2, 8)), close=close) for _ in range(rng.randint(2, 5)))))
            elif roll < 0.77:
                parts.append(self.tag(self.pick("h2", "h3"), self.text(1, self.words(1, 7))))
            elif roll < 0.82:
                parts.append(self.tag(self.pick("blockquote", "pre", "figcaption"), self.text(1, self.sentences())))
            elif roll < 0.86:
                parts.append(self.tag("table", "".join(self.tag("tr", "".join(self.tag("td", self.text(1, self.words(1, 4))) for _ in range(2))) for _ in range(rng.randint(1, 4)))))
            elif roll < 0.92:
                parts.append(self.tag("div", self.text(1, self.sentences())))
            else:
                parts.append(rng.choice([self.note, self.share, self.side, self.form])())
        if rng.random() < 0.2:
            parts.append(self.share())
        if rng.random() < 0.2:
            parts.append(self.talk())
        inside = "".join(parts)
        roll = rng.random()
        if roll < 0.45:
            inside = self.tag(self.pick("article", "main"), inside, rng.choice(_MAIN_CLASSES) if rng.random() < 0.4 else "")
        elif roll < 0.8:
            inside = self.tag(self.pick("div", "section", "td"), inside, rng.choice(_MAIN_CLASSES))
        elif roll < 0.93:
            inside = self.tag(self.pick("div", "section"), inside, rng.choice(["", *_PLAIN_CLASSES]))
        return self.tag(self.pick("article", "main", "div"), inside, rng.choice(["", *_PLAIN_CLASSES])) if rng.random() < 0.3 else inside

    def page(self) -> str:
        rng = self.rng
        before = [self.header() if rng.random() < 0.6 else "", self.menu() if rng.random() < 0.6 else "", self.note() if rng.random() < 0.5 else "", self.side() if rng.random() < 0.2 else ""]
        after = [self.talk() if rng.random() < 0.4 else "", self.side() if rng.random() < 0.4 else "", self.note() if rng.random() < 0.3 else "", self.form() if rng.random() < 0.2 else "", self.foot() if rng.random() < 0.8 else ""]
        inside = "".join(before) + (self.main() if rng.random() < 0.97 else "") + "".join(after)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            inside = self.tag(self.pick("div", "div", "section", "center"), inside, rng.choice(["", *_PLAIN_CLASSES]))
        if rng.random() < 0.05:
            inside = self.tag("form", inside)
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{inside}</body></html>"


def _texts(pages: list[dom.Page]) -> tuple[list[str], list[str]]:
    """Longer and shorter runs of words that layouts are composed of."""
    said = [t[:1500] for p in pages for t in p.text.values()]
    prose, short = [t for t in said if len(t) > 60], [t for t in said if len(t) <= 60]
    own = [" ".join(_FILLER[i : i + n]).capitalize() + "." for n in (9, 14, 20) for i in range(4)]
    return prose or own, short or own


def labelled(layouts: list[str]) -> tuple[list[dom.Page], list[np.ndarray]]:
    """The trees of composed layouts, and the labels of their blocks of text."""
    pages, labels = [dom.Page(x) for x in layouts], []
    for p in pages:
        labels.append(np.array([int(_LABEL[1] in text) for text in p.text.values()], int))
        for node, text in p.text.items():
            p.text[node] = text.replace(_LABEL[0], "").replace(_LABEL[1], "").strip() or "x"
    return pages, labels


def learn(pages: DataFrame, html: str = "html", seed: int = 17) -> Model:
    """The model, fitted on at most SAMPLE pages of up to SAMPLE_CHARS characters, first by a hash of the row, and LAYOUTS layouts of their texts."""
    rows = sample(pages.where(F.length(html) <= SAMPLE_CHARS), SAMPLE, *pages.columns).select(html).collect()
    own = [dom.Page(x) for x in sorted(r[0] for r in rows)]
    marked = []
    if own:
        forest = Forest(own)
        labels, at = forest.semantic(), 0
        for p in own:
            one = labels[at : at + len(p.text)]
            at += len(p.text)
            if len(one) and one.min() >= 0:
                marked.append((p, one))
    rng = random.Random(seed)
    composer = _Composer(rng, *_texts(own))
    made = labelled([composer.page() for _ in range(LAYOUTS)])
    return fit([*(p for p, _ in marked), *made[0]], [*(x for _, x in marked), *made[1]])


def main_texts(sources: list[str], model: Model) -> list[str]:
    """The main text of each page; of one without any element, all of its text."""
    out = [""] * len(sources)
    at, n = 0, len(sources)
    while at < n:
        upto, size = at, 0
        while upto < n and (upto == at or upto - at < PAGES and size + len(sources[upto]) <= CHARS):
            size += len(sources[upto])
            upto += 1
        pages = [dom.Page(s) for s in sources[at:upto]]
        forest = Forest(pages)
        p = model.marginals(forest)
        for i, page in enumerate(pages):
            own = p[forest.starts[i] : forest.starts[i + 1]]
            bare = len(page.kind) == 1 + len(page.text)
            out[at + i] = " ".join(t for node, t in page.text.items() if bare or own[node] >= 0.5)
        at = upto
    return out


def extract(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """Adds text and n_chars (code points) to pages; no shuffle.

    text: the blocks of main text in page order, joined by one space; white space inside a block is
    one space, character references are decoded. A null or empty page, and one without main text,
    has an empty text; one without any element is main text as a whole. Columns of pages with the
    outputs' names, in upper or lower case, are replaced, others stay. Repeated rows are extracted
    each; an empty table gives an empty table. The time is linear in a page's length.
    """
    ship(pages.sparkSession)
    kept = others(pages, ("text", "n_chars"))
    schema = pages.select(*kept).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = main_texts([x or "" for x in batch.column(kept.index(html)).to_pylist()], model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.select(*kept).mapInArrow(run, schema)


def op11_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, learn(pages)).select("page_id", "url", "text", "n_chars")
