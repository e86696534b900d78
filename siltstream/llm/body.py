"""The main body of a page in Markdown (problem 1), by tag-path ratios.

1. Each line that is not blank is a leaf with its text (the labels of links weigh nothing) and its punctuation.
   Leaves of one list, table, quote, code block or wrapped paragraph are one node.
2. Prose whose text and punctuation reach a share of what the page has, lists of whole phrases, tables and code
   span the article: nodes are before its title, in it, or behind it. A heading, the lines under the title and a
   line that ends in a colon are labels, which weigh as much as what they introduce.
3. A node's root-to-leaf path is (part of the page, kind of node, share of links, how it ends, worded or not). Text
   and punctuation are averaged per path and per part (as logarithms, so one giant table or paragraph does not
   dwarf the rest), smoothed over paths that differ in one step, and fused; the part pulls its paths up or down.
4. Paths under a share of the ratio that the page's own prose reaches are outside the body.

Known wording of page furniture (see ``roles``) only lowers the weight of a leaf's text; with ``wording=False`` it
is not looked at, and the ratios decide alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.llm.residue import is_message
from siltstream.llm.roles import LINK, bare, role_of
from siltstream.session import spread

#: Paths below this share of the (logarithmic) ratio of the page's prose are not content.
SHARE = 0.74
#: How far the ratio of a part of the page pulls those of its paths, and the weight of a path that differs in a step.
PULL, NEIGHBOUR = 0.5, 0.02
#: Prose is part of the article from this share of the page's mean on, or from this text and punctuation on.
PROSE_SHARE, PROSE = 0.3, 350
#: Characters of a list of phrases: in all, and an item; an item that says something of a link, or stands behind a
#: line that introduces it, needs fewer.
LIST, PHRASE, ANNOTATED, INTRODUCED = 100, 25, 12, 15
#: Weight of text in a wording known as page furniture.
WORDED = 0.1

PUNCTUATION = re.compile(r"[.,;:!?¿¡…]")
TABLE = re.compile(r"^\|.*\|$")
SENTENCE_END = re.compile(r"[.!?…][\"'”»)\]*_ ]*$")
#: A line without an end mark that is this long goes on in the next line.
WRAPPED = 50


class Leaf(NamedTuple):
    number: int
    kind: str  # code, table, heading, item, quote, line
    links: str  # none, some, only
    ending: str  # sentence, colon, open
    size: int
    marks: int
    worded: bool
    after_blank: bool
    level: int


class Node(NamedTuple):
    leaves: list[Leaf]
    size: float
    marks: float

    @property
    def head(self) -> Leaf:
        return self.leaves[0]

    @property
    def ending(self) -> str:
        return self.leaves[-1].ending


def leaves(text: str, wording: bool = True) -> Iterator[Leaf]:
    fenced, blank = False, True
    for number, line in enumerate(text.split("\n"), 1):
        stripped = line.strip()
        if not stripped:
            blank = True
            continue
        fence = stripped.startswith(("```", "~~~"))
        if fence or fenced:
            fenced ^= fence
            yield Leaf(number, "code", "none", "open", len(stripped), 1, False, blank, 0)
        elif TABLE.match(stripped) and "](" not in stripped:
            yield Leaf(number, "table", "none", "open", len(stripped), stripped.count("|") - 1, False, blank, 0)
        else:
            own, quoted, listed, level = bare(line)
            kind = "heading" if level else "item" if listed else "quote" if quoted else "line"
            ending = "sentence" if SENTENCE_END.search(own) else "colon" if own.endswith(":") else "open"
            plain = LINK.sub("", own) if "](" in own else own
            links, size = "none", len(plain)
            if plain is not own:
                size = sum(map(str.isalnum, plain))
                links = "some" if size else "only"
            worded = wording and role_of(own, listed, level) is not None
            yield Leaf(number, kind, links, ending, size, len(PUNCTUATION.findall(plain)), worded, blank, level)
        blank = False


def _joined(last: Leaf, leaf: Leaf) -> bool:
    """Whether a leaf goes on in the node of the leaf before it."""
    if last.kind != leaf.kind or leaf.kind == "heading" or last.worded or leaf.worded:
        return False
    if leaf.kind in ("line", "quote"):
        return not leaf.after_blank and last.ending == "open" and last.size >= WRAPPED and last.links == leaf.links == "none"
    return leaf.kind != "item" or (last.links == "only") == (leaf.links == "only")


def nodes_of(found: Iterator[Leaf]) -> list[Node]:
    groups: list[list[Leaf]] = []
    for leaf in found:
        if groups and _joined(groups[-1][-1], leaf):
            groups[-1].append(leaf)
        else:
            groups.append([leaf])
    weight = lambda leaf: WORDED if leaf.worded else 1.0
    return [Node(g, sum(x.size * weight(x) for x in g), sum(x.marks * weight(x) for x in g)) for g in groups]


def article_nodes(nodes: list[Node]) -> list[int]:
    """Places of the nodes that are prose, lists of phrases, tables or code by their own text, and so span the article."""
    prose = [i for i, n in enumerate(nodes) if n.head.kind in ("line", "quote", "item") and n.ending == "sentence" and n.head.links != "only" and not n.head.worded]
    if not prose:
        return []
    fused = {i: nodes[i].size * (1 + nodes[i].marks) for i in prose}
    mean = sum(fused[i] * nodes[i].size for i in prose) / max(1.0, sum(nodes[i].size for i in prose))
    found = {i for i in prose if nodes[i].head.kind != "item" and fused[i] >= min(PROSE, PROSE_SHARE * mean)}
    for i, node in enumerate(nodes):
        if node.head.kind in ("table", "code") and i > min(prose):
            found.add(i)
        if node.head.kind in ("item", "quote") and node.ending == "sentence" and node.head.links == "none" and not node.head.worded and i - 1 in found:
            found.add(i)  # listed or quoted sentences that follow the article's own text
        if node.head.kind == "item" and node.head.links == "none" and node.size >= max(LIST, PHRASE * len(node.leaves)):
            found.add(i)
        if node.head.kind == "item" and node.head.links == "some" and node.size >= ANNOTATED * len(node.leaves):
            found.add(i)
        if node.head.kind in ("item", "quote") and node.head.links != "only" and i and node.size >= INTRODUCED * len(node.leaves):
            # Introduced by the node before, or by the one before that where only a stray line stands between.
            for before in nodes[max(0, i - 2) : i]:
                if before.ending == "colon" and before.head.kind in ("line", "quote") and before.head.links == "none" and not before.head.worded:
                    found.add(i)
    return sorted(found)


def parts_of(nodes: list[Node], article: list[int]) -> tuple[list[str], int]:
    """The part of the page of each node, and the place of the title (or -1)."""
    if not article:
        return ["article"] * len(nodes), -1
    heads = [i for i in range(article[0]) if nodes[i].head.kind == "heading"]
    title = next((i for i in heads if nodes[i].head.level == 1), heads[0] if heads else article[0])
    last = article[-1]
    parts = ["before" if i < title else "article" if i <= last else "behind" for i in range(len(nodes))]
    return parts, title


def weights(nodes: list[Node], parts: list[str], title: int, first: int) -> list[tuple[float, float]]:
    """(text, punctuation) of each node; labels have those of the weightiest node that they introduce."""
    own = [(n.size, n.marks) for n in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        head = nodes[i].head
        if head.worded or head.links != "none":
            continue
        if head.kind == "heading":
            j = i + 1
            if j < len(nodes) and nodes[j].head.kind == "item" and nodes[j].head.links == "only":
                continue  # over a list of links
            while j < len(nodes) and not (nodes[j].head.kind == "heading" and nodes[j].head.level <= head.level):
                if parts[j] == parts[i]:
                    own[i] = max(own[i], own[j])
                j += 1
        elif nodes[i].ending == "colon":
            for j in range(i + 1, min(i + 3, len(nodes))):
                if nodes[j].head.kind in ("item", "quote", "table", "code") and nodes[j].head.links != "only":
                    own[i] = max(own[i], own[j])
        elif title < i < first and head.kind != "item":
            own[i] = max(own[i], own[first])
    return own


def ratios(paths: list[tuple], own: list[tuple[float, float]], nodes: list[Node]) -> dict[tuple, float]:
    """The fused ratio of each path. The first step of a path is the part of the page, the last whether it is worded."""

    def mean(values: list[tuple[float, float]]) -> tuple[float, float]:
        return tuple(math.expm1(sum(math.log1p(v[k]) for v in values) / len(values)) for k in (0, 1))

    by_path: dict[tuple, list] = {}
    by_part: dict[str, list] = {}
    for path, weight, node in zip(paths, own, nodes):
        by_path.setdefault(path, []).append(weight)
        by_part.setdefault(path[0], []).append((node.size, node.marks))
    means = {path: mean(values) for path, values in by_path.items()}
    pulls = {part: mean(values) for part, values in by_part.items()}
    fused = {}
    for path, (text, marks) in means.items():
        weight = 1.0
        for other, (t, m) in means.items():
            # Neither another part of the page, another share of links nor another wording is a neighbour.
            if (other[0], other[2], other[4]) == (path[0], path[2], path[4]) and (other[1] == path[1]) != (other[3] == path[3]):
                weight, text, marks = weight + NEIGHBOUR, text + NEIGHBOUR * t, marks + NEIGHBOUR * m
        size, punctuation = pulls[path[0]]
        fused[path] = (1 - PULL) * math.log1p(text / weight * (1 + marks / weight)) + PULL * math.log1p(size * (1 + punctuation))
    return fused


def outside(text: str | None, wording: bool = True) -> list[int]:
    """Numbers, from 1, of the lines of ``text`` that are not blank and stand outside its main body."""
    if not text or not text.strip() or is_message(text):
        return []
    nodes = nodes_of(leaves(text, wording))
    article = article_nodes(nodes)
    parts, title = parts_of(nodes, article)
    own = weights(nodes, parts, title, article[0] if article else 0)
    paths = []
    for part, node, weight in zip(parts, nodes, own):
        head = node.head
        label = head.kind == "heading" or weight != (node.size, node.marks)
        ending = node.ending if head.kind in ("line", "quote", "item") else ""
        paths.append((part, "label" if label else head.kind, head.links, ending, head.worded))
    fused = ratios(paths, own, nodes)
    own_text = [fused[paths[i]] for i in article if nodes[i].head.kind not in ("table", "code")]
    least = SHARE * max(own_text, default=max(fused.values()))
    return [leaf.number for path, node in zip(paths, nodes) if fused[path] < least for leaf in node.leaves]


def lines_outside(df: DataFrame, id_column: str, text_column: str, wording: bool = True) -> DataFrame:
    """(id, line_no) of each line outside the main body.

    Null, empty and blank texts have no lines; a page that is only a message is all body. Repeated rows each give
    their lines. A text of any length is read whole. Without ``wording`` only the ratios decide.
    """
    texts = spread(df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")).filter("text IS NOT NULL"))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = outside(text, wording)
                rows.extend([row] * len(found))
                numbers.extend(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int64())], ["id", "line_no"])

    return texts.mapInArrow(run, f"id {kind}, line_no bigint")


def main_body(df: DataFrame, id_column: str, text_column: str, into: str = "body") -> DataFrame:
    """(id, ``into``, ``lines_cut``): the main body of every text; null texts stay null.

    Blank lines that cutting leaves side by side become one.
    """
    texts = spread(df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, counts = [], []
            for text in batch.column(1).to_pylist():
                drop = set(outside(text)) if text is not None else set()
                if drop:
                    text = "\n".join(line for no, line in enumerate(text.split("\n"), 1) if no not in drop)
                    text = re.sub(r"\n\s*\n\s*\n+", "\n\n", text).strip("\n")
                bodies.append(text)
                counts.append(len(drop))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string()), pa.array(counts, pa.int32())], ["id", into, "lines_cut"])

    return texts.mapInArrow(run, f"id {kind}, `{into}` string, lines_cut int")
