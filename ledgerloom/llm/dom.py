"""A small tolerant HTML reader: pages as trees of blocks.

Only block elements become nodes; inline elements are transparent, their text belongs to the block around them, and
``br`` or a table cell is white space.  Character references are decoded, comments, declarations, scripts, styles and
other elements without readable text are dropped, missing end tags of paragraphs, list items, table parts and the like
are supplied, end tags that match nothing are ignored, and an unfinished tag at the end is dropped.  Below ``LEVELS``
levels of blocks no further nodes are made: texts there are blocks of the last level.  Reading is linear in the page's
length.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

LEVELS = 100

# Element names by their role in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "search section summary table caption tbody thead tfoot tr ul".split()
)
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BARRED = frozenset("aside audio button canvas datalist dialog footer form head iframe map menu nav noscript object search select svg template video".split())
BLANK = frozenset(("br", "td", "th"))
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "caption", "tbody", "thead", "tfoot", "tr"}
#: What a start tag closes, and where the search for it stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
# Words in class, id and role that tell what isn't the article.
BARRED_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adslot adsense adbox banner billboard sponsor sponsored promo promoted promotion taboola outbrain "
    "nav navbar navigation menu breadcrumb breadcrumbs crumbs pager pagination paging toc skip "
    "sidebar aside rail widget widgets complementary related recommended recommendations trending popular "
    "footer contentinfo copyright colophon legal disclaimer "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe subscription signup paywall "
    "comment comments commentlist disqus discussion respond reply replies "
    "share sharing social login search searchform toolbar masthead hidden".split()
)
#: Barred unless they stand in the article, where they hold its title.
HEADER_WORDS = frozenset("header topbar".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article content entry main post story".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_MARK = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Text:
    __slots__ = ("text", "linked", "constant")

    def __init__(self, text: str, linked: int):
        self.text, self.linked, self.constant = text, linked, False


class Block:
    """An element; ``kids`` are Text and Block in page order."""

    __slots__ = ("tag", "label", "words", "barred", "kids", "main")

    def __init__(self, tag: str, words: frozenset[str] = frozenset(), barred: bool = False, main: bool = False, named: frozenset[str] = frozenset()):
        """``named``: the words that pages of one kind have in common, which ids need not be."""
        self.tag, self.words, self.barred, self.main = tag, words, barred, main
        self.label = f"{tag} {' '.join(sorted(named))}" if named else tag
        self.kids: list[Text | Block] = []

    def blocks(self) -> list[Block]:
        return [x for x in self.kids if isinstance(x, Block)]

    def texts(self):
        """Text of the block in page order, without what lies in barred blocks."""
        todo = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, Text):
                yield x
            elif not x.barred or x is self:
                todo.extend(reversed(x.kids))


def _marks(attributes: str) -> tuple[frozenset[str], frozenset[str], bool]:
    """The words of class, id and role; those of class and role; whether the element is hidden."""
    words, named, hidden = set(), set(), False
    for name, *values in _MARK.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            own = {x.lower() for start in _NAME.findall(value) for x in _WORD.findall(start)}
            words |= own
            if name != "id":
                named |= own
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return frozenset(words), frozenset(named), hidden


class _Reader:
    """``stack`` has an open element's tag, the block that takes its text, and whether it's in the article."""

    def __init__(self, html: str):
        self.html, self.root = html, Block("#page")
        self.stack, self.buffer, self.links, self.linked = [("#page", self.root, False)], [], 0, 0
        self.open: Counter[str] = Counter()

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.stack[-1][1].kids.append(Text(text, self.linked))
            self.buffer, self.linked = [], 0

    def text(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        self.buffer.append(text)
        if self.links:
            self.linked += len(text)

    def close(self, depth: int) -> None:
        self.flush()
        self.open.subtract(tag for tag, _, _ in self.stack[depth:])
        del self.stack[depth:]
        self.links = 0

    def find(self, tags: set[str] | frozenset[str], limits: set[str] | frozenset[str] = frozenset()) -> int:
        """The depth of the innermost open element with one of the tags, 0 if there is none before a limit."""
        if not any(self.open[x] for x in tags):
            return 0
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                return i
            if self.stack[i][0] in limits:
                return 0
        return 0

    def start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCKS
        if block:
            if tag in ENDS_PARAGRAPH and (at := self.find({"p"}, {"td", "th", "button"})):
                self.close(at)
            if tag in CLOSES and (at := self.find(*CLOSES[tag])):
                self.close(at)
        words, named, hidden = _marks(attributes) if attributes and ("=" in attributes or "hidden" in attributes) else (frozenset(), frozenset(), False)
        top = tag in ("html", "body") or tag in MAIN_TAGS and not words & {"comment", "comments", "reply", "related", "sidebar", "widget"}
        _, around, inside = self.stack[-1]
        barred = tag in BARRED or hidden or not top and bool(words & BARRED_WORDS)
        if not inside and not top:
            barred |= tag == "header" or bool(words & HEADER_WORDS)
        if block or barred:
            self.flush()
            main = not barred and (tag in MAIN_TAGS or "main" in words)
            node = around
            if len(self.stack) < LEVELS or barred and not around.barred:
                node = Block(tag, words, barred, main, named)
                around.kids.append(node)
            if tag not in VOID:
                self.stack.append((tag, node, inside or main))
                self.open[tag] += 1
        elif tag in BLANK:
            self.buffer.append(" ")
        elif tag == "a":
            self.links = 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag in BLANK:
            self.buffer.append(" ")
        if at := self.find({tag}):
            self.close(at)

    def read(self) -> Block:
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            i = html.find("<", at)
            if i < 0:
                self.text(html[at:])
                break
            if i > at:
                self.text(html[at:i])
            if html.startswith("<!--", i):
                stop = html.find("-->", i + 4)
                at = n if stop < 0 else stop + 3
                continue
            m = _TAG.match(html, i) or _LOOSE.match(html, i)
            if m is None:
                following = html[i + 1 : i + 2]
                if following in ("!", "?", "/") or following.isalpha() and following.isascii() or not following:
                    stop = html.find(">", i)
                    at = n if stop < 0 else stop + 1
                else:
                    self.text("<")
                    at = i + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self.end(tag)
            elif tag in RAW:
                stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                if stop is None:
                    break
                end = html.find(">", stop.end())
                at = n if end < 0 else end + 1
            else:
                self.start(tag, m[3])
        self.flush()
        return self.root


def read(html: str | None) -> Block:
    """The page's tree; its root holds everything."""
    return _Reader(html or "").read()
