"""A small document tree with CSS selectors, for pages that are read in the executors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What an opening tag closes if it is still open.
_CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_CLOSES |= {t: {"p"} for t in ("div", "ul", "ol", "dl", "table", "section", "article", "aside", "header", "footer", "nav", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "main")}
#: Elements out of which nothing is closed.
_SCOPE = {"table", "ul", "ol", "dl", "div", "section", "article", "body", "html"}


class Node:
    """An element with its attributes and children (elements and texts)."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """The elements below this one, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self, skip: frozenset[str] = frozenset()) -> Iterator[str]:
        todo: list[Node | str] = list(reversed(self.children))
        while todo:
            child = todo.pop()
            if isinstance(child, str):
                yield child
            elif child.tag not in skip:
                todo += reversed(child.children)

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        """All texts below, trimmed and joined by one space."""
        return " ".join(t for s in self.strings(skip) if (t := " ".join(s.split())))

    def select(self, selector: str) -> list[Node]:
        chains = _parse(selector)
        return [n for n in self.walk() if any(_matches(n, chain, self) for chain in chains)] if chains else []

    def first(self, selector: str) -> Node | None:
        chains = _parse(selector)
        return next((n for n in self.walk() if any(_matches(n, chain, self) for chain in chains)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag)
        if closes:
            node = self.at
            while node.parent is not None and node.tag not in closes and node.tag not in _SCOPE:
                node = node.parent
            if node.tag in closes:
                self.at = node.parent
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; anything that is no markup is text."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"([\w-]+|\*)|([.#])([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+)))?\s*\]|:(first-child|last-child)")


@lru_cache(maxsize=1024)
def _parse(selector: str) -> tuple:
    """Chains of (combinator, tests), read from the right; an unreadable selector selects nothing."""
    chains = []
    for one in re.split(r",(?![^\[]*\])", selector or ""):
        parts, chain, link = re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", one.strip()), [], " "
        for part in parts:
            if part == ">":
                link = ">"
                continue
            tests, at = [], 0
            while at < len(part):
                m = _SIMPLE.match(part, at)
                if not m:
                    return ()
                tests.append(m.groups())
                at = m.end()
            chain.append((link, tests))
            link = " "
        if chain:
            chains.append(tuple(reversed(chain)))
    return tuple(chains)


def _passes(node: Node, tests: list) -> bool:
    for tag, sign, name, attr, how, a, b, c, place in tests:
        if tag:
            if tag != "*" and node.tag != tag.lower():
                return False
        elif sign == "#":
            if node.attrs.get("id") != name:
                return False
        elif sign == ".":
            if name not in node.attrs.get("class", "").split():
                return False
        elif place:
            siblings = [x for x in node.parent.children if isinstance(x, Node)] if node.parent else [node]
            if siblings[0 if place == "first-child" else -1] is not node:
                return False
        else:
            value, wanted = node.attrs.get(attr.lower()), a if a is not None else b if b is not None else c
            if value is None:
                return False
            if how and not {"=": value == wanted, "*=": wanted in value, "^=": value.startswith(wanted or "\0"), "$=": value.endswith(wanted or "\0"), "~=": wanted in value.split(), "|=": value == wanted or value.startswith(f"{wanted}-")}[how]:
                return False
    return True


def _matches(node: Node, chain: tuple, top: Node) -> bool:
    if not _passes(node, chain[0][1]):
        return False
    if len(chain) == 1:
        return True
    above = node.parent
    if chain[0][0] == ">":
        return above is not None and above is not top and _matches(above, chain[1:], top)
    while above is not None and above is not top:
        if _matches(above, chain[1:], top):
            return True
        above = above.parent
    return False
