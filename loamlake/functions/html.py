"""A tolerant HTML tree on the standard library, with the selectors and the Markdown form that pages need."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key closes an open one of these.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = frozenset("address article aside blockquote body div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
# What isn't part of an article's body.
NOISE = (
    "script", "style", "noscript", "svg", "iframe", "form", "nav", "footer", "header", "aside", ".sharedaddy", ".jp-relatedposts", ".post-navigation",
    ".navigation", ".newsletter", ".elementor-share-buttons-wrapper", ".addtoany_share_save_container",
)
_HEADING = frozenset(f"h{i}" for i in range(1, 7))
_SILENT = frozenset("img script style head title meta link".split())


class Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))

    def text(self, sep: str = "") -> str:
        parts: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if x.strip():
                    parts.append(x.strip())
            elif x.tag not in ("script", "style") or x is self:
                stack.extend(reversed(x.kids))
        return sep.join(parts)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.open: Counter[str] = Counter()  # tags from here up to the root: an end tag of none of them costs nothing

    def _leave(self) -> None:
        self.open[self.at.tag] -= 1
        self.at = self.at.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.at.tag in CLOSES.get(tag, ()) or (self.at.tag == "p" and tag in BLOCKS):
            self._leave()
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag] > 0:
            while self.at.tag != tag:
                self._leave()
            self._leave()

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_STEP = re.compile(r"([a-zA-Z0-9]+)|\.([\w-]+)|\[([\w-]+)=['\"]([^'\"]*)['\"]\]")


@lru_cache(maxsize=256)
def _steps(simple: str) -> tuple[tuple[str, str, str, str], ...]:
    return tuple(_STEP.findall(simple))


@lru_cache(maxsize=256)
def _compound(selector: str) -> tuple[str, ...]:
    return tuple(re.findall(r"(?:[^\s\[]|\[[^\]]*\])+", selector))


def _matches(node: Node, simple: str) -> bool:
    for tag, cls, attr, value in _steps(simple):
        if (tag and node.tag != tag) or (cls and cls not in node.classes) or (attr and node.attrs.get(attr) != value):
            return False
    return True


def select(root: Node, selector: str) -> Iterator[Node]:
    """Nodes for tag, .class, [attr='value'], joins of them, and descendants by a space, in document order."""
    *outer, last = _compound(selector)
    for node in root.walk():
        if node is root or not _matches(node, last):
            continue
        up, need = node.parent, len(outer)
        while up is not None and need:
            need -= _matches(up, outer[need - 1])
            up = up.parent
        if not need:
            yield node


def first(root: Node, selector: str) -> Node | None:
    return next(select(root, selector), None)


def remove(root: Node, selectors: Sequence[str]) -> None:
    """Drops what any of the selectors, each without descendants, matches; one pass."""
    tags, others = {s for s in selectors if s.isalnum()}, [s for s in selectors if not s.isalnum()]
    gone = lambda x: isinstance(x, Node) and (x.tag in tags or (bool(x.attrs) and any(_matches(x, s) for s in others)))
    stack = [root]
    while stack:
        node = stack.pop()
        node.kids = [k for k in node.kids if not gone(k)]
        stack.extend(k for k in node.kids if isinstance(k, Node))


def to_html(node: Node) -> str:
    """The node as markup again."""
    out: list[str] = []
    stack: list[tuple[Node | str, bool]] = [(node, False)]  # what comes next, and whether it is text as it is
    while stack:
        x, raw = stack.pop()
        if isinstance(x, str):
            out.append(x if raw else escape(x, quote=False))
            continue
        inside = x.tag in ("script", "style")
        if x.tag != "#root":
            out.append(f"<{x.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in x.attrs.items()) + ">")
            if x.tag not in VOID:
                stack.append((f"</{x.tag}>", True))
        stack.extend((k, inside) for k in reversed(x.kids))
    return "".join(out)


class _Open:
    """A node whose children are being rendered."""

    __slots__ = ("items", "kids", "node", "number", "parts", "pre")

    def __init__(self, node: Node, pre: bool, number: int) -> None:
        self.node, self.pre, self.number = node, pre or node.tag == "pre", number
        self.kids, self.parts, self.items = iter(node.kids), [], 0


def markdown(node: Node) -> str:
    """ATX headings, - bullets, links, emphasis and quotes; images are left out, * and _ in text are escaped.

    Each node is rendered once, after its children, on a stack of its own: neither time nor depth explodes.
    """
    stack = [_Open(node, False, 0)]
    while True:
        top = stack[-1]
        kid = next(top.kids, None)
        if isinstance(kid, str):
            top.parts.append(kid if top.pre else re.sub(r"([*_])", r"\\\1", re.sub(r"\s+", " ", kid)))
        elif kid is not None:
            number = 0
            if kid.tag == "li" and top.node.tag == "ol":
                number = top.items = top.items + 1
            if kid.tag not in _SILENT:
                stack.append(_Open(kid, top.pre, number))
        else:
            stack.pop()
            done = _rendered(top, "".join(top.parts))
            if not stack:
                return done.strip()
            stack[-1].parts.append(done)


def _rendered(x: _Open, raw: str) -> str:
    """The Markdown of a node; raw: that of its children."""
    t, text = x.node.tag, raw.strip()
    if t == "br":
        return "  \n"
    if t == "hr":
        return "\n\n---\n\n"
    if t in _HEADING:
        return f"\n\n{'#' * int(t[1])} {re.sub(r'\s+', ' ', text)}\n\n" if text else ""
    if t in ("b", "strong", "i", "em"):
        mark = "**" if t in ("b", "strong") else "*"
        return f"{raw[: len(raw) - len(raw.lstrip())]}{mark}{text}{mark}{raw[len(raw.rstrip()) :]}" if text else raw
    if t == "a":
        return f"[{text}]({x.node.attrs['href']})" if text and x.node.attrs.get("href") else text
    if t == "pre":
        return f"\n\n```\n{raw.strip(chr(10))}\n```\n\n"
    if t == "code":
        return raw if x.pre else f"`{text}`"
    if t == "blockquote":
        return "\n\n" + "\n".join(f"> {line}".rstrip() for line in text.split("\n")) + "\n\n" if text else ""
    if t == "li":
        return f"\n{f'{x.number}.' if x.number else '-'} " + text.replace("\n", "\n  ") if text else ""
    if t in ("ul", "ol"):
        return f"\n\n{raw.strip(chr(10))}\n\n"
    if t in ("td", "th"):
        return f" {text} |"
    if t == "tr":
        return f"\n|{raw}"
    if t in BLOCKS or t == "#root":
        return f"\n\n{text}\n\n" if text else ""
    return raw
