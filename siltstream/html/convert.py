"""Markdown from a tree, with simpler ways where that yields too little."""

from __future__ import annotations

import re

from siltstream.functions.text import repaired
from siltstream.html.clean import cleaned
from siltstream.html.dom import BLOCKS, Node

#: Fewer characters call for the next way; the plain way must give more than PLAIN_LEAST.
LEAST, PLAIN_LEAST = 100, 50
_BLANKS = re.compile(r"[ \t\r\n\f]+")
_LINE_BREAK = re.compile(r" *\n *")
_SKIP = frozenset("script style head template noscript".split())
_UNSEEN = frozenset("script style nav footer header".split())


# How inline elements are written around their text.
_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~", "code": "`", "kbd": "`", "samp": "`", "tt": "`"}
_CODE = frozenset("code kbd samp tt".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("ul ol menu".split())


def _inline(node: Node | str, pre: bool = False) -> str:
    """The text of an inline element, with a stack of those that are open: their tag, target and pieces so far."""
    if isinstance(node, str):
        return node if pre else _BLANKS.sub(" ", node)
    whole: list[str] = []
    todo: list = [node]
    open_: list[tuple[Node, list[str]]] = []
    out = whole
    while todo:
        x = todo.pop()
        if x is None:
            node, own = open_.pop()
            out = open_[-1][1] if open_ else whole
            out.append(_wrapped(node, "".join(own), pre))
        elif isinstance(x, str):
            out.append(x if pre else _BLANKS.sub(" ", x))
        elif x.tag in _SKIP:
            continue
        elif x.tag == "br":
            out.append("  \n")
        elif x.tag == "img":
            if src := x.attrs.get("src"):
                out.append(f"![{x.attrs.get('alt', '')}]({src})")
        elif x.tag in _MARKS or x.tag == "a":
            open_.append((x, []))
            out = open_[-1][1]
            todo.append(None)
            todo.extend(reversed(x.children))
        else:
            todo.extend(reversed(x.children))
    return "".join(whole)


def _wrapped(node: Node, inner: str, pre: bool) -> str:
    text = inner.strip()
    if not text:
        return " " if inner else ""
    if node.tag == "a":
        left, right = ("[", f"]({node.attrs['href']})") if node.attrs.get("href") else ("", "")
    else:
        left = right = "" if pre and node.tag in _CODE else _MARKS[node.tag]
    if not left:
        return inner
    at = inner.index(text)
    return f"{inner[:at]}{left}{text}{right}{inner[at + len(text) :]}"


def _table(node: Node) -> str:
    rows = [[_BLANKS.sub(" ", _inline(c)).strip().replace("|", "\\|") for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")] for tr in node.find_all("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])


class _Open:
    """An element whose blocks are being gathered: those done, and the inline text since the last one."""

    __slots__ = ("node", "children", "blocks", "line", "number")

    def __init__(self, node: Node) -> None:
        self.node, self.blocks, self.line = node, [], []
        self.children = iter(node.children)
        start = node.attrs.get("start") or "1"
        self.number = int(start or 1) if start.isdecimal() else 1

    def end_line(self) -> None:
        if self.line:
            text = _LINE_BREAK.sub(lambda m: "  \n" if m.group().startswith("  ") else "\n", "".join(self.line)).strip()
            self.line.clear()
            if text:
                self.blocks.append(text)

    def take(self, child: Node, blocks: list[str]) -> None:
        """The blocks of a child that is done."""
        blocks = [b for b in blocks if b]
        if self.node.tag in _LISTS:
            mark = f"{self.number}. " if self.node.tag == "ol" else "- "
            self.number += 1
            if child.tag == "blockquote":
                blocks = [_as_quote(blocks)]
            body = "\n".join(blocks).strip() if child.tag == "li" else "\n".join(blocks)
            if body:
                self.blocks.append(mark + body.replace("\n", "\n" + " " * len(mark)))
        elif child.tag in _LISTS:
            self.blocks.append("\n".join(blocks))
        elif child.tag == "blockquote":
            self.blocks.append(_as_quote(blocks))
        else:
            self.blocks.extend(blocks)


def _as_quote(blocks: list[str]) -> str:
    return "\n>\n".join("\n".join(f"> {x}" for x in b.split("\n")) for b in blocks)


def _with_blocks(root: Node) -> set[int]:
    """The elements (by ``id``) that are blocks or have blocks below them."""
    found: set[int] = set()
    for node in reversed(list(root.walk())):
        if node.tag in BLOCKS or id(node) in found:
            found.add(id(node))
            if node.parent is not None:
                found.add(id(node.parent))
    return found


def to_markdown(root: Node) -> str:
    """The page as blocks of Markdown. Elements are kept on a stack, so depth is no limit."""
    blocky, stack = _with_blocks(root), [_Open(root)]
    while True:
        top = stack[-1]
        child = next(top.children, None)
        if child is None:
            top.end_line()
            if len(stack) == 1:
                return "\n\n".join(b for b in top.blocks if b)
            stack.pop()
            stack[-1].take(top.node, top.blocks)
        elif top.node.tag in _LISTS:
            if isinstance(child, Node) and child.tag not in _SKIP:
                stack.append(_Open(child))
        elif isinstance(child, str) or id(child) not in blocky:
            top.line.append(_inline(child))
        else:
            top.end_line()
            if child.tag in _SKIP:
                continue
            if child.tag in _HEADINGS:
                text = _BLANKS.sub(" ", _inline(child)).strip()
                if text:
                    top.blocks.append(f"{'#' * int(child.tag[1])} {text}")
            elif child.tag == "pre":
                text = "".join([_inline(c, True) for c in child.children]).strip("\n")
                top.blocks.append(f"```\n{text}\n```")
            elif child.tag == "hr":
                top.blocks.append("---")
            elif child.tag == "table":
                top.blocks.append(_table(child))
            else:
                stack.append(_Open(child))


def tidy(text: str | None) -> str:
    """Repaired, with at most one blank line in a row and none at the ends."""
    return re.sub(r"\n{3,}", "\n\n", repaired(text) or "").strip()


def extract(html: str | None, root: Node | None = None, most_lines: int | None = None) -> tuple[str, str]:
    """(Markdown, way): ``markdown``, ``plain`` text if that gives too little, or ``lines`` of visible text.

    Null and empty pages give ('', 'none'). ``most_lines`` limits the last way.
    """
    if not html:
        return "", "none"
    root = root if root is not None else cleaned(html)
    text = to_markdown(root)
    if len(text) >= LEAST:
        return tidy(text), "markdown"
    plain = root.text("\n")
    if len(plain) > PLAIN_LEAST:
        return tidy(plain), "plain"
    shown = root.text("\n", skip=_UNSEEN)
    lines = [x.strip() for x in shown.splitlines() if x.strip()]
    return tidy("\n".join(lines[:most_lines])), "lines"
