"""Pages as trees of blocks: a linear, forgiving reader of HTML for use inside tasks.

Nodes are block elements, inline elements that look like page furniture, and blocks of text: runs of
text between two borders of blocks, with character references decoded and white space turned into
one space. A node's parent comes before it. Elements that are never closed end with their parent.
"""

from __future__ import annotations

import html as _html
import re

#: Fixed values of the format.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = set("noscript template object svg math canvas audio video select button datalist head".split())
CONTAINERS = set("html body div section center details summary hgroup fieldset address figure".split())
PROSE = set("p blockquote pre figcaption".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
LISTS = set("ul ol dl li dt dd dir".split())
TABLES = set("table caption thead tbody tfoot tr td th".split())
MAIN = set("article main".split())
FURNITURE = set("nav aside footer menu form dialog search".split())
BLOCKS = CONTAINERS | PROSE | HEADINGS | LISTS | TABLES | MAIN | FURNITURE | {"header", "legend", "hr"}
_ENDS_P = (BLOCKS - {"html", "body", "legend", "li", "dt", "dd"}) - TABLES | {"table"}
_SCOPE = set("html table td th caption object template button".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "dir", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "caption"}, {"table"}))}

#: Words of class, id and role that name page furniture, whole or within longer ones, and those that name the main text.
SHORT_FURNITURE = set("ad ads adv nav menu toc tag tags tool tools rail side bar alert legal login search form meta byline share social more next prev pager reply replies skip top bottom aside foot popup note gdpr bio author promo toast".split())
LONG_FURNITURE = re.compile("advert|banner|breadcrumb|comment|complementary|contentinfo|cookie|consent|copyright|colophon|dialog|discuss|disqus|dropdown|footer|masthead|modal|navbar|navig|newsletter|notice|notification|overlay|pagina|popular|privacy|recommend|related|respon[ds]|share|sharing|sidebar|social|sponsor|subscri|taboola|teaser|toolbar|trending|widget|warning")
MAIN_WORDS = set("article content main post story entry body text page prose hentry articlebody maincontent blog news".split())
_HEADER_WORDS = set("header heading head title headline".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""[\s/]*([^\s=>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
#: Elements that may be open at a time; more of them are not told from the one around them.
DEEPEST = 512

ROOT, CONTAINER, MAIN_TAG, FURNITURE_TAG, HEADER_TAG, HEADING, PROSE_TAG, LIST, TABLE, INLINE, UNSEEN_TAG, TEXT = range(12)
_KIND = {**dict.fromkeys(CONTAINERS, CONTAINER), **dict.fromkeys(MAIN, MAIN_TAG), **dict.fromkeys(FURNITURE, FURNITURE_TAG), "header": HEADER_TAG, **dict.fromkeys(HEADINGS, HEADING), **dict.fromkeys(PROSE, PROSE_TAG), **dict.fromkeys(LISTS, LIST), **dict.fromkeys(TABLES, TABLE), "legend": FURNITURE_TAG, **dict.fromkeys(UNSEEN, UNSEEN_TAG)}
#: Hints of an element's attributes, as bits.
SAYS_FURNITURE, SAYS_MAIN, SAYS_HEADER, HIDDEN = 1, 2, 4, 8


def hints(value: str) -> int:
    """What the words of a class, id or role say."""
    words = [w.lower() for w in _SPLIT.findall(value)]
    out = SAYS_FURNITURE if any(w in SHORT_FURNITURE for w in words) or LONG_FURNITURE.search(value.lower()) else 0
    if any(w in MAIN_WORDS for w in words):
        out |= SAYS_MAIN
    if any(w in _HEADER_WORDS for w in words):
        out |= SAYS_HEADER
    return out


class Page:
    """parent, kind, hint, depth of each node; for blocks of text also their text and characters in links."""

    def __init__(self, source: str):
        self.parent, self.kind, self.hint, self.depth = [-1], [ROOT], [0], [0]
        self.text: dict[int, str] = {}
        self.linked: dict[int, int] = {}
        self._known: dict[str, int] = {}
        self._open: list[tuple[str, int]] = []  # tag and node, -1 for plain inline elements
        self._at, self._buffer, self._in_links, self._links = 0, [], 0, 0
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join("".join(self._buffer).split())
            if text:
                node = self._node(TEXT, 0)
                self.text[node], self.linked[node] = text, min(self._in_links, len(text))
            self._buffer, self._in_links = [], 0

    def _node(self, kind: int, hint: int) -> int:
        at = self._at
        self.parent.append(at)
        self.kind.append(kind)
        self.hint.append(hint)
        self.depth.append(self.depth[at] + 1)
        return len(self.kind) - 1

    def _say(self, text: str) -> None:
        if "&" in text:
            text = _html.unescape(text)
        self._buffer.append(text)
        if self._links:
            self._in_links += len(text.strip())

    def _pop(self, n: int) -> None:
        """Closes all open elements from number n on."""
        for tag, node in reversed(self._open[n:]):
            if node >= 0:
                self._flush()
                self._at = self.parent[node]
            if tag == "a":
                self._links -= 1
        del self._open[n:]

    def _close(self, tags: set[str], borders: set[str]) -> None:
        for n in range(len(self._open) - 1, -1, -1):
            tag = self._open[n][0]
            if tag in tags:
                return self._pop(n)
            if tag in borders:
                return None

    def _start(self, tag: str, hint: int) -> None:
        if tag in VOID:
            if tag == "hr":
                self._close({"p"}, _SCOPE)
                self._flush()
            elif tag == "br":
                self._buffer.append("\n")
            return
        if tag in _ENDS_P:
            self._close({"p"}, _SCOPE)
        if len(self._open) >= DEEPEST:  # no deeper; its text is that of the element around it
            if tag in BLOCKS:
                self._flush()
            return
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag in HEADINGS and self._open and self._open[-1][0] in HEADINGS:
            self._pop(len(self._open) - 1)
        if tag == "a":
            self._close({"a"}, BLOCKS)
        if tag in ("body", "html") or tag in BLOCKS and any(t == "head" for t, _ in self._open):
            self._close({"head"}, set())
        kind = _KIND.get(tag)
        if kind is None and hint & (SAYS_FURNITURE | HIDDEN):
            kind = INLINE
        node = -1
        if kind is not None:
            self._flush()
            node = self._node(kind, hint)
            self._at = node
        self._links += tag == "a"
        self._open.append((tag, node))

    def _end(self, tag: str) -> None:
        if tag in ("body", "html"):
            return
        plain = tag not in BLOCKS and tag not in UNSEEN
        for n in range(len(self._open) - 1, -1, -1):
            other, node = self._open[n]
            if other == tag:
                if plain and node < 0:  # what it holds stays open
                    del self._open[n]
                    self._links -= tag == "a"
                else:
                    self._pop(n)
                return
            if other in ("td", "th", "table") and tag not in TABLES:
                return

    def _tag(self, source: str, at: int) -> tuple[int, int]:
        """The position after a tag whose attributes start at `at`, and what they say."""
        hint, n = 0, len(source)
        while at < n:
            if source[at] == ">":
                return at + 1, hint
            m = _ATTR.match(source, at)
            if m is None or m.end() == at:
                at += 1
                continue
            at = m.end()
            name = m[1].lower()
            value = m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                found = self._known.get(value)
                if found is None:
                    found = self._known[value] = hints(value)
                hint |= found
            elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
                hint |= HIDDEN
        return n, hint

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                return self._say(source[at:])
            if lt > at:
                self._say(source[at:lt])
            c = source[lt + 1 : lt + 2]
            if c.isascii() and c.isalpha():
                m = _NAME.match(source, lt + 1)
                tag = m[0].lower()
                at, hint = self._tag(source, m.end())
                if tag in RAW:
                    end = _RAW_END[tag].search(source, at)
                    at = n if end is None else self._tag(source, end.end())[0]
                elif tag == "plaintext":
                    return self._say(source[at:])
                else:
                    self._start(tag, hint)
            elif c == "/" and (m := _NAME.match(source, lt + 2)):
                self._end(m[0].lower())
                at = self._tag(source, m.end())[0]
            elif source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif c in ("!", "?", "/") and c:
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                self._say("<")
                at = lt + 1
        return None
