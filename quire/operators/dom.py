"""A tree of HTML elements from the standard tokenizer, with the end tags that HTML lets authors leave out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Opening one of these ends an open paragraph.
BLOCKS = frozenset("address article aside blockquote div dl fieldset figcaption figure footer form header hr main nav ol p pre section table ul".split()) | HEADINGS
#: Opening the key ends these, if open in the innermost of the scope.
ENDS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tr", "td", "th", "thead", "tbody"), ("table",)), "option": (("option",), ("select",))}

_SPACES = re.compile(r"[ \t\r\n　]+")


def collapse(s: str) -> str:
    return _SPACES.sub(" ", s).strip()


class Node:
    """An element; kids are nodes and strings."""

    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []

    def has(self, word: str) -> bool:
        return word in self.attrs.get("class", "")

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def within(self, skip: Callable[[Node], bool] | None = None) -> Iterator[Node]:
        """The element and those inside it in document order, without what is inside the skipped ones. No recursion, so depth is no matter."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            if skip is None or not skip(n):
                stack += reversed(n.elements())

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.within() if test(n)), None)

    def text(self) -> str:
        """Text with line ends for br, back-ticks around code, and no permalinks."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag == "a" and n.has("headerlink"):
                continue
            elif n.tag == "br":
                out.append("\n")
            elif n.tag == "code":
                parts = [k.strip() for m in n.within() for k in m.kids if isinstance(k, str) and k.strip()]
                out.append("`" + " ".join(parts) + "`")
            else:
                stack += reversed(n.kids)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end(("p",), ("table", "td", "th", "li", "dd", "blockquote", "div", "section", "article"))
        if tag in ENDS:
            for _ in range(3):
                self._end(*ENDS[tag])
        n = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].kids.append(n)
        if tag not in VOID:
            self.open.append(n)

    def _end(self, tags, scope):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in scope:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        kids = self.open[-1].kids
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root
