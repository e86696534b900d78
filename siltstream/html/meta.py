"""Metadata of a page as one nested record."""

from __future__ import annotations

import json
from urllib.parse import urlparse

from siltstream import __version__
from siltstream.html.dom import Node

# What stands for a missing title, author and date; and the name of this engine.
TITLE, AUTHOR, DATE, ENGINE = "Documento", "Desconocido", "N/A", f"siltstream {__version__}"


def first_json_ld(blocks: list[str]) -> str | None:
    """The first block that parses, as it stands: objects and lists alike."""
    for block in blocks:
        try:
            json.loads(block)
            return block.strip()
        except ValueError:
            continue
    return None


def metadata(root: Node, url: str | None) -> dict:
    named: dict[str, str] = {}
    blocks, title, headers = [], None, []
    for node in root.walk():
        if node.tag == "meta":
            name = (node.attrs.get("property") or node.attrs.get("name") or "").strip().lower()
            if name and node.attrs.get("content"):
                named.setdefault(name, node.attrs["content"])
        elif node.tag == "title" and title is None:
            title = node.text()
        elif node.tag == "script" and node.attrs.get("type", "").strip().lower() == "application/ld+json":
            blocks.append("".join(c for c in node.children if isinstance(c, str)))
        elif len(node.tag) == 2 and node.tag[0] == "h" and node.tag[1] in "123456":
            text = " ".join(node.text().split())
            if text:
                headers.append({"level": int(node.tag[1]), "text": text, "id": node.attrs.get("id") or None})
    og = {k: named.get(f"og:{k}") for k in ("title", "description", "image", "type", "site_name")}
    shown = og["title"] or title or TITLE
    return {
        "url": url, "title": shown.split("|")[0].split(" - ")[0].strip(), "author": named.get("author") or AUTHOR,
        "date": named.get("article:published_time") or named.get("date") or DATE,
        "sitename": og["site_name"] or (urlparse(url).netloc if url else ""), "ingestion_engine": ENGINE, "description": named.get("description"),
        "keywords": [k.strip() for k in (named.get("keywords") or "").split(",") if k.strip()],
        "og_title": og["title"], "og_description": og["description"], "og_image": og["image"], "og_type": og["type"],
        "twitter_card": named.get("twitter:card"), "twitter_site": named.get("twitter:site"), "twitter_title": named.get("twitter:title"),
        "json_ld": first_json_ld(blocks), "headers": headers,
    }
