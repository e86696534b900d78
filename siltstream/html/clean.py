"""Removal of page furniture and of unsafe markup, each in one pass over the tree."""

from __future__ import annotations

from siltstream.html.dom import RAW, Node, parse, serialize

# What is removed, by tag, class and id.
TAGS = frozenset(("script", "style", "iframe", "svg", "meta", "link", "noscript", "form", "footer", "header", "nav"))
CLASSES = frozenset(("cookie-consent", "ads", "sidebar", "popup", "menu"))
IDS = frozenset(("menu",))
# Kinds of element that are looked at, in turn; characters from which on they are; and rules of (share of
# text in links above, characters below, whether an image saves it), of which the first that holds decides.
PRUNED = ("div", "section", "ul", "table", "aside")
SHORTEST = 10
RULES = ((0.6, 300, True), (0.9, 800, False))
#: Characters of a page that the cleaned text is read from where a limit is asked for.
LONGEST_HTML = 5 * 1024 * 1024
# Tags and attributes that are safe to keep.
SAFE_TAGS = frozenset(
    """a abbr acronym area article aside b bdi bdo blockquote br caption center cite code col colgroup data dd del details dfn div dl dt em
    figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr i img ins kbd li map mark nav ol p pre q rp rt rtc ruby s samp small span
    strike strong sub summary sup table tbody td th thead time tr tt u ul var wbr""".split()
)
SAFE_ATTRS = {"*": {"lang", "title"}, "a": {"href", "hreflang"}, "img": {"align", "alt", "height", "src", "width"}, "ol": {"start"}, "td": {"align", "colspan", "rowspan"}, "th": {"align", "colspan", "rowspan", "scope"}, "time": {"datetime"}, "data": {"value"}, "q": {"cite"}, "blockquote": {"cite"}}
SAFE_SCHEMES = frozenset("http https mailto tel ftp bitcoin irc magnet news sms ssh webcal xmpp".split())


def capped(html: str, longest: int | None = None) -> str:
    """The page, or with ``longest`` that many characters of it, up to the last tag that ends in their last tenth."""
    if longest is None or len(html) <= longest:
        return html
    return html[: html.rfind(">", int(longest * 0.9) + 1, longest) + 1 or longest]


def measured(root: Node) -> list[Node]:
    """All elements in document order, each with ``measure``: [characters, pieces, characters in links, images].

    Characters are those of the pieces of text without outer blanks; joined, there is a blank between two of them.
    """
    nodes = list(root.walk())
    for node in reversed(nodes):
        size = pieces = linked = images = 0
        if node.tag not in RAW:
            for child in node.children:
                if type(child) is Node:
                    below = child.measure
                    size, pieces, linked, images = size + below[0], pieces + below[1], linked + below[2], images + below[3]
                elif text := child.strip():
                    size, pieces = size + len(text), pieces + 1
            if node.tag == "a" and pieces:
                linked += size + pieces - 1
        node.measure = [size, pieces, linked, images + (node.tag == "img")]
    return nodes


def _shares(node: Node) -> tuple[int, float]:
    """Characters of an element's text, and the share of them that stands in links below it."""
    size, pieces, linked, _ = node.measure
    total = size + max(0, pieces - 1)
    own = total if node.tag == "a" else 0
    return total, (linked - own) / total if total else 0.0


def link_density(node: Node) -> float:
    """The share of an element's text that stands in links; 0 without text."""
    measured(node)
    return _shares(node)[1]


def remove_furniture(root: Node) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        kept = [c for c in node.children if type(c) is not Node or not _is_furniture(c)]
        if len(kept) < len(node.children):
            for gone in node.children:
                if type(gone) is Node and _is_furniture(gone):
                    gone.parent = None
            node.children = kept
        todo.extend([c for c in kept if type(c) is Node])


def _is_furniture(node: Node) -> bool:
    if node.tag in TAGS:
        return True
    attrs = node.attrs
    return bool(attrs) and (attrs.get("id") in IDS or ("class" in attrs and not CLASSES.isdisjoint(attrs["class"].split())))


def prune_links(root: Node) -> None:
    """Remove elements that are mostly links, kind after kind.

    Lengths are summed up once from the leaves, and taken off the elements above when one goes.
    """
    by_kind: dict[str, list[Node]] = {kind: [] for kind in PRUNED}
    for node in measured(root):
        if node.tag in by_kind and node is not root:
            by_kind[node.tag].append(node)
    for node in (n for kind in PRUNED for n in by_kind[kind]):
        total, share = _shares(node)
        rule = next((images for least, most, images in RULES if share > least and total < most), None) if total >= SHORTEST else None
        if rule is None or (rule and node.measure[3]):
            continue
        above, path = node.parent, []
        while above is not None:
            path.append(above)
            above = above.parent
        if path and path[-1] is root:
            for x in path:
                x.measure = [a - b for a, b in zip(x.measure, node.measure)]
            node.remove()


def sanitize(root: Node) -> None:
    """Unwrap tags that are not safe, and drop attributes and addresses that are not."""
    for node in reversed(list(root.walk())):
        if any(type(c) is Node and c.tag not in SAFE_TAGS for c in node.children):
            kept: list[Node | str] = []
            for child in node.children:
                if type(child) is not Node or child.tag in SAFE_TAGS:
                    kept.append(child)
                elif child.tag not in RAW:
                    for moved in child.children:
                        if type(moved) is Node:
                            moved.parent = node
                    kept.extend(child.children)
            node.children = kept
        if node.attrs:
            own = SAFE_ATTRS.get(node.tag, ())
            node.attrs = {k: v for k, v in node.attrs.items() if (k in own or k in SAFE_ATTRS["*"]) and not (k in ("href", "src", "cite") and _unsafe(v))}
        if node.tag == "a":
            node.attrs["rel"] = "noopener noreferrer"


def _unsafe(url: str) -> bool:
    compact = "".join(url.split()).lower()
    scheme, colon, _ = compact.partition(":")
    return bool(colon) and not set("/?#") & set(scheme) and scheme not in SAFE_SCHEMES


def cleaned(html: str, longest: int | None = None) -> Node:
    root = parse(capped(html, longest))
    remove_furniture(root)
    prune_links(root)
    sanitize(root)
    return root


def clean_html(html: str | None, longest: int | None = None) -> str:
    """HTML without furniture, link lists and unsafe markup; '' for null and empty."""
    return serialize(cleaned(html, longest)) if html else ""
