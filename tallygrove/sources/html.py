"""HTML as rows: anchors by pattern, and one parse of a page for its repeating blocks and its details."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIPPED = {"nav", "aside", "header", "footer"}
BODY_ORDER = ("article", "main", "section", "body")


def anchors(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page, pos (from 1), href, text of every link."""
    whole = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    pair = F.arrays_zip(F.regexp_extract_all(html, F.lit(whole), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(whole), F.lit(2)).alias("inner"))
    rows = pages.select(page, F.posexplode(pair).alias("p", "a"))
    return rows.select(page, (F.col("p") + 1).alias("pos"), F.col("a.href").alias("href"), F.trim(F.regexp_replace(F.regexp_replace("a.inner", "<[^>]+>", " "), r"\s+", " ")).alias("text"))


def title(html: str) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


class _Tree(HTMLParser):
    """Elements as [tag, class, parent, children, texts, href]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = {"tag": "", "cls": "", "up": None, "kids": [], "text": [], "href": None}

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        node = {"tag": tag, "cls": " ".join((found.get("class") or "").split()[:1]), "up": self.now, "kids": [], "text": [], "href": found.get("href")}
        self.now["kids"].append(node)
        if tag not in VOID:
            self.now = node

    def handle_endtag(self, tag):
        node = self.now
        while node is not None and node["tag"] != tag:
            node = node["up"]
        if node is not None and node["up"] is not None:
            self.now = node["up"]

    def handle_data(self, data):
        if data.strip():
            self.now["text"].append(data.strip())


def _walk(node):
    yield node
    for kid in node["kids"]:
        yield from _walk(kid)


def _text(node) -> str:
    return " ".join(t for n in _walk(node) if n["tag"] not in ("script", "style") for t in n["text"])


def _inside(node, tags) -> bool:
    while node is not None:
        if node["tag"] in tags:
            return True
        node = node["up"]
    return False


def repeating_blocks(pages: DataFrame, page: str, html: str, least: int = 2, skipped: frozenset[str] = frozenset(SKIPPED)) -> DataFrame:
    """page, signature, pos, href, text: the rows of every list, table or block of like siblings outside the skipped elements."""

    def run(frames):
        for frame in frames:
            out = []
            for key, source in zip(frame.iloc[:, 0], frame.iloc[:, 1].fillna(""), strict=True):
                tree = _Tree()
                tree.feed(source)
                for node in _walk(tree.root):
                    kinds = Counter((k["tag"], k["cls"]) for k in node["kids"] if k["tag"] in ("li", "tr", "div", "article"))
                    if not kinds or _inside(node, skipped):
                        continue
                    kind, n = min(kinds.items(), key=lambda x: (-x[1], x[0]))
                    if n < least:
                        continue
                    rows = [k for k in node["kids"] if (k["tag"], k["cls"]) == kind]
                    for pos, row in enumerate(rows, 1):
                        links = [a for a in _walk(row) if a["tag"] == "a" and a["href"]]
                        best = max(links, key=lambda a: len(_text(a)), default=None)
                        out.append((key, f"{node['tag']}.{node['cls']}>{kind[0]}.{kind[1]}", pos, best and best["href"], _text(row)))
            yield pd.DataFrame(out, columns=["page", "signature", "pos", "href", "text"])

    return pages.select(F.col(page).alias("page"), F.col(html).alias("html")).mapInPandas(run, "page long, signature string, pos int, href string, text string")


def details(pages: DataFrame, page: str, html: str, least: int = 30, limit: int = 20_000) -> DataFrame:
    """page, title, body (first of article, main, section, body with least characters), links, of every page."""

    def run(frames):
        for frame in frames:
            out = []
            for key, source in zip(frame.iloc[:, 0], frame.iloc[:, 1].fillna(""), strict=True):
                tree = _Tree()
                tree.feed(source)
                nodes = list(_walk(tree.root))
                name = next((_text(n) for n in nodes if n["tag"] == "title"), None)
                bodies = (_text(n) for tag in BODY_ORDER for n in nodes if n["tag"] == tag)
                out.append((key, name, next((b[:limit] for b in bodies if len(b) >= least), None), len([n for n in nodes if n["tag"] == "a" and n["href"]])))
            yield pd.DataFrame(out, columns=["page", "title", "body", "links"])

    return pages.select(F.col(page).alias("page"), F.col(html).alias("html")).mapInPandas(run, "page long, title string, body string, links int")
