"""HTML: links and passages of known sites."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

from .text import DURATION, runs

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[_Node | str] = []

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self):
        for c in self.children:
            if isinstance(c, _Node):
                yield c
                yield from c.walk()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.at.tag == "p":
            self.at = self.at.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parsed(page: str) -> _Node:
    tree = _Tree()
    tree.feed(page)
    tree.close()
    return tree.root


def links(page: str | None, url: str, pattern: str | None = None) -> list[str]:
    """Same-host links of a page in order, each once, as host and decoded path.

    Query and fragment are dropped; with a pattern only matching paths stay.
    """
    base, out = urlsplit(url), {}
    for node in parsed(page or "").walk():
        if node.tag == "a" and node.attrs.get("href"):
            try:
                target = urlsplit(urljoin(url, node.attrs["href"]))
            except ValueError:
                continue
            path = unquote(target.path)
            if target.scheme in ("http", "https") and target.netloc == base.netloc and (pattern is None or re.search(pattern, path)):
                out[f"{target.scheme}://{target.netloc}{path}"] = None
    return list(out)


def split_paragraphs(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"\n[\t\n\f\r ]*\n", text) if p.strip()]


def _passage(text: str, url: str, product: str = "", category: str = "") -> dict:
    found = re.search(DURATION, text)
    return {"text": text, "source_url": url, "product": product, "product_category": category, "skin_tone": "", "climate": "", "duration_of_use": found.group() if found else ""}


def review_passages(page: str, url: str) -> list[dict]:
    """Reviews: the paragraphs of each, with the product's data attributes."""
    out = []
    for review in parsed(page).walk():
        if "review" in review.classes():
            body = [p.text().strip() for box in review.walk() if "review-text" in box.classes() for p in box.walk() if p.tag == "p"]
            out += [_passage(t, url, review.attrs.get("data-product", ""), review.attrs.get("data-category", "")) for t in split_paragraphs("\n\n".join(b for b in body if b))]
    return out


def article_passages(page: str, url: str, selector: str = "entry-content") -> list[dict]:
    """Paragraphs of the first element of a class (or tag) that have any term."""
    for node in parsed(page).walk():
        if selector in node.classes() or node.tag == selector:
            body = "\n\n".join(p.text().strip() for p in node.walk() if p.tag == "p")
            return [_passage(t, url) for t in split_paragraphs(body) if runs(t)]
    return []


Extractor = Callable[[str, str], list[dict]]


class Extractors:
    """Extractors by host."""

    def __init__(self, by_host: dict[str, Extractor] | None = None, default: Extractor | None = None):
        self.by_host, self.default = dict(by_host or {}), default

    def register(self, host: str, extractor: Extractor) -> None:
        self.by_host[host] = extractor

    def passages(self, page: str | None, url: str | None) -> list[dict]:
        """None of a page whose host isn't known."""
        try:
            host = urlsplit(url or "").hostname or ""
        except ValueError:
            return []
        extractor = self.by_host.get(host, self.default)
        return extractor(page or "", url) if extractor else []
