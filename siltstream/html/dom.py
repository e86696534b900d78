"""Trees from HTML as it is found: unclosed, misnested, with void and raw-text elements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape, unescape

# Fixed values of the HTML standard: elements without content, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}), "thead": ({"tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul body html".split()
)
#: Open elements at once; deeper ones become siblings.
DEEPEST = 2_000

# A comment, declaration or instruction; an end tag; a start tag. Possessive, so a quote left open costs one look ahead.
_TOKEN = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|/([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)
    |([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+)>)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""", re.S)
# An element closed where it opens; the slash of a value without quotes is part of it.
_EMPTY = re.compile(r"""(?:^|[\s"'/])/\Z""")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "measure")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None") -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator["Node"]:
        """This element and all below, in document order, without recursion."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            if node.children:
                todo.extend([c for c in reversed(node.children) if type(c) is Node])

    def find_all(self, *tags: str) -> list["Node"]:
        return [n for n in self.walk() if n.tag in tags and n is not self]

    def strings(self, skip: frozenset[str] = RAW) -> Iterator[str]:
        todo: list[Node | str] = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in skip:
                todo.extend(reversed(node.children))

    def text(self, separator: str = " ", skip: frozenset[str] = RAW) -> str:
        return separator.join(s for s in (x.strip() for x in self.strings(skip)) if s)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        value = double or single or bare
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


def _opened(at: Node, tag: str) -> Node:
    """Where an element ``tag`` that opens at ``at`` goes, after it has closed what it closes."""
    if tag in CLOSES:
        tags, stop = CLOSES[tag]
        node, last = at, None
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                last = node
            node = node.parent
        at = last.parent if last is not None else at
    return at.parent if tag in BLOCKS and at.tag == "p" else at


def _closed(at: Node, tag: str) -> Node:
    """Where to go on after an end tag: an inline one does not reach over a block that holds it."""
    node, inline = at, tag not in BLOCKS
    while node.parent is not None and node.tag != tag:
        if inline and node.tag in BLOCKS:
            return at
        node = node.parent
    return node.parent or at


def parse(html: str) -> Node:
    root = at = Node("#root", {}, None)
    place, depth = 0, 0
    while True:
        found = _TOKEN.search(html, place)
        text = html[place : found.start() if found else len(html)]
        if text:
            at.children.append(unescape(text) if "&" in text else text)
        if not found:
            return root
        place = found.end()
        end, start, attributes = found.groups()
        if end:
            after = _closed(at, end.lower())
            depth -= after is not at
            at = after
        elif start:
            tag = start.lower()
            at = _opened(at, tag)
            node = Node(tag, _attributes(attributes) if attributes else {}, at)
            at.children.append(node)
            if tag in RAW:
                close = _RAW_END[tag].search(html, place)
                if inner := html[place : close.start() if close else len(html)]:
                    node.children.append(inner)
                place = close.end() if close else len(html)
            elif tag not in VOID and depth < DEEPEST and not _EMPTY.search(attributes):
                at, depth = node, depth + 1


def serialize(node: Node) -> str:
    out: list[str] = []
    todo: list[Node | str | tuple[str]] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(escape(x, quote=False))
        elif x.tag in RAW:
            out.append(f"<{x.tag}>{''.join(c for c in x.children if isinstance(c, str))}</{x.tag}>")
        else:
            if x.tag != "#root":
                attrs = "".join([f' {k}="{escape(v)}"' for k, v in x.attrs.items()]) if x.attrs else ""
                out.append(f"<{x.tag}{attrs}>")
                if x.tag in VOID:
                    continue
                todo.append((f"</{x.tag}>",))
            todo.extend(reversed(x.children))
    return "".join(out)
