"""Pages read as element trees, one parse for each: details of a posting, and the links of the rows of repeating blocks.

Tasks take Arrow batches, which Spark bounds by bytes; a page's tree is dropped before the next one is read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import postings, text

# Where bodies are, best first; what is no part of a posting; comment areas; file names of attachments.
BODIES = [
    "#bo_v_atc", ".bo_v_atc", "#bo_v_con", ".bo_v_con", ".__boardView", ".board_view", ".board-view", ".bbs_view", ".bbs-view", ".view_content", ".view-content", ".view_cont", ".board-content",
    ".cont_view", ".board_cont", ".board_content", "article", ".entry-content", ".post-content", ".article-content", ".body-body-", ".body-center-", ".job-body-", "#print", "#normal_page", "#contents",
    ".job-detail-left", ".job-detail", ".view-tab-wrap", ".wjobDerailveiw", ".job-info", ".jd-v2-card", "main", "#content", "#main",
]
NOISE = [
    ".__recHead", ".__boardPn", ".boardPn", ".board_pn", ".bbs_pn", ".bbs-pn", ".prev-next", ".prevnext", ".pager", ".paging", ".pagination", ".notice-area", ".board-notice", ".disclaimer", ".caution",
    ".sns-share", ".share-area", ".btn-area", ".button-area", "#snb", "#lnb", "#gnb", "#header", "#footer", "#left", "#right", ".header", ".footer", ".footer-part1", ".footer-part2",
    ".job-detail-right", ".categoryJobs", "#categoryJobs", "#ai-summary-section", ".ai-job-reference", ".ajr-foot", "#modal-share-label", ".modal-share", ".share-modal", ".job-detail__list",
    "#bo_vc", ".bo_vc", "#bo_v_top", "#bo_v_btm", ".bo_v_top", ".bo_v_btm", ".btn_bo_user", ".bo_v_nb", "#bo_v_nb", "#bo_v_share", ".bo_v_share", "#bo_v_info", ".bo_v_info", "#bo_v_meta", ".bo_v_meta",
    "#bo_v_link", ".bo_v_link", "#bo_v_data", ".bo_v_data", ".sns_share", ".sns-share-area", ".share-buttons", ".share_buttons", ".social-share", ".social_share", "#sns_share_modal", ".sns_share_modal",
    ".bottom_menu", ".bottom-menu--", ".copyright",
]
COMMENTS = ["#comments", ".comments", ".comments-area", ".comment-list", "ol.commentlist", "#respond", ".comment-respond", ".pingback", ".reply", "#disqus_thread", ".fb-comments"]
NOISE_TAGS = ["script", "style", "noscript", "nav", "header", "footer", "aside"]
IMAGE_AREAS, FILE_AREAS = ["#bo_v_img", ".bo_v_img"], ["#bo_v_file", ".bo_v_file"]
FILE_TYPES = "pdf|hwp|hwpx|doc|docx|xls|xlsx|ppt|pptx|zip|rar|7z|txt|csv|jpg|jpeg|png|gif|svg|webp|mp4|mov|avi"
SCALED = re.compile(r"-\d+x\d+(?=\.[a-zA-Z]{2,5}(?:\?|$))")  # a scaled copy of an image
MOST_TEXT, MOST_LINKS, MOST_TABLES, MOST_CELLS, MOST_JSONLD = 20_000, 200, 50, 500, 500_000
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

LINK = pa.struct([("url", pa.string()), ("text", pa.string())])
DETAIL = pa.schema([
    ("page", pa.int64()), ("title", pa.string()), ("body", pa.string()), ("sections", pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string())]))), ("tables", pa.list_(pa.list_(pa.list_(pa.string())))),
    ("jsonld", pa.list_(pa.struct([("valid", pa.bool_()), ("text", pa.string())]))), ("meta", pa.map_(pa.string(), pa.string())), ("images", pa.list_(pa.string())), ("links", pa.list_(LINK)),
    ("attachments", pa.list_(pa.struct([("url", pa.string()), ("text", pa.string()), ("ext", pa.string())]))), ("iframes", pa.list_(pa.string())), ("videos", pa.list_(pa.string())),
])
DETAIL_DDL = (
    "page long, title string, body string, sections array<struct<heading: string, text: string>>, tables array<array<array<string>>>, jsonld array<struct<valid: boolean, text: string>>, meta map<string, string>, images array<string>, "
    "links array<struct<url: string, text: string>>, attachments array<struct<url: string, text: string, ext: string>>, iframes array<string>, videos array<string>"
)


class Node:
    """An element: kids are elements and strings, in the order of the page."""

    __slots__ = ("attrs", "kids", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []

    def walk(self) -> Iterator[Node | str]:
        """Itself and all below it, without recursion: pages that close nothing are deep."""
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            yield n
            if isinstance(n, Node):
                stack.extend(reversed(n.kids))

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if isinstance(n, Node) and n.tag in tags and n is not self]

    def text(self) -> str:
        """Its strings, parted by single spaces."""
        return " ".join(" ".join(s for s in self.walk() if isinstance(s, str)).split())

    def walk_text(self) -> Iterator[str]:
        return (s.strip() for s in self.walk() if isinstance(s, str))

    def get(self, name: str) -> str:
        return (self.attrs.get(name) or "").strip()

    def is_any(self, selectors: frozenset[str]) -> bool:
        own = {self.tag, f"#{self.attrs.get('id')}"}
        for c in (self.attrs.get("class") or "").split():
            own |= {f".{c}", f"{self.tag}.{c}"}
        return not selectors.isdisjoint(own)

    def drop(self) -> None:
        if self.up is not None:
            self.up.kids = [k for k in self.up.kids if k is not self]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.kids.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.now.tag == tag:
            self.now = self.now.up

    def handle_endtag(self, tag):
        node = self.now
        while node is not None and node.tag != tag:
            node = node.up
        if node is not None and node.up is not None:
            self.now = node.up

    def handle_data(self, data):
        self.now.kids.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _absolute(base: str, address: str) -> str:
    if not address or address.startswith(("data:", "javascript:", "#")):
        return ""
    try:
        return urljoin(base, address)
    except ValueError:  # no address at all
        return ""


def _images(node: Node, base: str) -> list[str]:
    """Addresses of all images and their stand-ins, without the suffix of scaled copies, once each."""
    found: dict[str, None] = {}
    for img in node.all("img"):
        sources = [img.get(a) for a in ("src", "data-src", "data-lazy-src", "data-original")] + [p.strip().split(" ")[0] for p in img.get("srcset").split(",")]
        found |= dict.fromkeys(SCALED.sub("", u) for u in (_absolute(base, s) for s in sources) if u)
    return list(found)[:MOST_LINKS]


def _file_type(url: str, words: str) -> str:
    """The type of file that a link leads to, by its path, then its text; bin for downloads that say so; empty for others."""
    found = re.search(rf"(?i)\.({FILE_TYPES})(?:\?|$)", urlparse(url).path) or re.search(rf"(?i)\.({FILE_TYPES})\b", words)
    if found:
        return found[1].lower()
    loads = any(mark in url.lower() for mark in ("/download", "download.php", "download.do"))
    return "bin" if loads and ("다운로드" in words or "download" in words.lower()) else ""


def _links(node: Node, base: str) -> tuple[list[dict], list[dict]]:
    """(links, attachments), each address once."""
    links, files, seen = [], [], set()
    for a in node.all("a"):
        url = _absolute(base, a.get("href"))
        if not url or url in seen:
            continue
        seen.add(url)
        words = a.text()[:200]
        if kind := _file_type(url, words):
            files.append({"url": url, "text": words, "ext": kind})
        links.append({"url": url, "text": words})
    return links[:MOST_LINKS], files


def _span(cell: Node, name: str) -> int:
    return min(int(s), MOST_CELLS) if (s := cell.get(name)).isdigit() and int(s) > 0 else 1


def grid(table: Node) -> list[list[str]]:
    """A table's rows of cell texts; a cell that spans columns or rows stands in each of them. Rows of tables inside it are its own too."""
    rows: list[list[str]] = []
    carried: dict[int, tuple[str, int]] = {}  # by column: what stands there in rows to come, and in how many
    for tr in table.all("tr"):
        row: list[str] = []
        onward: dict[int, tuple[str, int]] = {}

        def put(words: str, left: int) -> None:
            if left > 1:
                onward[len(row)] = words, left - 1
            row.append(words)

        for cell in [*(c for c in tr.kids if isinstance(c, Node) and c.tag in ("td", "th")), None]:
            while len(row) in carried:
                put(*carried.pop(len(row)))
            for _ in range(_span(cell, "colspan") if cell is not None else 0):
                put(cell.text(), _span(cell, "rowspan"))
        carried = onward
        if row:
            rows.append(row)
        if sum(map(len, rows)) >= MOST_CELLS:
            break
    return rows


def _sections(body: Node) -> list[dict]:
    """The body's text under its headings (h1 to h6); what stands before the first has no heading."""
    out = [{"heading": None, "text": []}]
    stack: list[Node | str] = [body]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out[-1]["text"].append(n)
        elif re.fullmatch("h[1-6]", n.tag):
            out.append({"heading": n.text(), "text": []})
        else:
            stack.extend(reversed(n.kids))
    read = [{"heading": s["heading"], "text": " ".join(" ".join(s["text"]).split())} for s in out]
    return [s for s in read if s["heading"] or s["text"]]


def _json_ld(root: Node) -> list[dict]:
    out, total = [], 0
    for s in root.all("script"):
        words = "".join(k for k in s.kids if isinstance(k, str)).strip()
        if s.get("type") != "application/ld+json" or not words:
            continue
        total += len(words)
        if total > MOST_JSONLD:
            break
        try:
            json.loads(words)
            out.append({"valid": True, "text": words})
        except ValueError:
            out.append({"valid": False, "text": words})
    return out


def _body(root: Node) -> Node:
    """The first element of the best kind that there is with 30 characters or more, else the whole page."""
    first: dict[str, Node] = {}
    for n in root.walk():
        if isinstance(n, Node):
            for s in (n.tag, f"#{n.attrs.get('id')}", *(f".{c}" for c in (n.attrs.get("class") or "").split())):
                first.setdefault(s, n)
    long_enough = (first[s] for s in BODIES if s in first and len("".join(first[s].walk_text())) >= 30)
    return next(long_enough, root)


def read_detail(html: str, base: str) -> dict:
    """What a page says of a posting, as the columns of DETAIL but page."""
    root = tree(html)
    heads = root.all("title") or root.all("h1")
    meta = {}
    for m in root.all("meta"):
        if (key := m.get("property") or m.get("name") or m.get("itemprop")) and m.get("content"):
            meta[key] = m.get("content")[:1000]
    out = {"title": heads[0].text() if heads else None, "jsonld": _json_ld(root), "meta": meta}
    for n in [n for n in root.walk() if isinstance(n, Node) and (n.tag in NOISE_TAGS or n.is_any(frozenset(COMMENTS)))]:
        n.drop()
    for area in root.all("textarea"):  # bodies that scripts copy from an escaped field
        inside = "".join(area.walk_text())
        if "<" in inside and ">" in inside:
            area.kids = tree(inside).kids
            for k in area.kids:
                if isinstance(k, Node):
                    k.up = area
    extra = [n for n in root.walk() if isinstance(n, Node) and n.is_any(frozenset(IMAGE_AREAS))], [n for n in root.walk() if isinstance(n, Node) and n.is_any(frozenset(FILE_AREAS))]
    for n in [n for n in root.walk() if isinstance(n, Node) and n.is_any(frozenset(NOISE))]:
        n.drop()
    body = _body(root)
    links, files = _links(body, base)
    known = {f["url"] for f in files}
    files += [f for n in extra[1] for f in _links(n, base)[1] if not (f["url"] in known or known.add(f["url"]))]
    images = list(dict.fromkeys([*_images(body, base), *(u for n in extra[0] for u in _images(n, base))]))[:MOST_LINKS]
    addresses = lambda nodes: list(dict.fromkeys(u for n in nodes if (u := _absolute(base, n.get("src")))))
    videos = [v for n in body.all("video") for v in (n, *n.all("source"))]
    tables = [g for t in body.all("table")[:MOST_TABLES] if (g := grid(t))]
    return out | {"body": body.text()[:MOST_TEXT], "sections": _sections(body), "tables": tables, "images": images, "links": links, "attachments": files, "iframes": addresses(body.all("iframe")), "videos": addresses(videos)}


def page_details(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    """The columns of DETAIL, emails, phones and error for every page; body is without the navigation at its end. error: what makes a detail empty, else null.

    Null HTML is an empty page, and has an error. Fixed limits: 20,000 characters of body, 200 images and links, 50 tables of about 500 cells, 500,000
    characters of JSON-LD.
    """

    def run(batches):
        for batch in batches:
            for key, base, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = {"page": key} | read_detail(source, base)
                found["meta"] = list(found["meta"].items())
                yield pa.RecordBatch.from_pylist([found], schema=DETAIL)

    rows = pages.select(F.col(page).cast("long").alias("page"), F.coalesce(url, F.lit("")).alias("url"), F.coalesce(html, F.lit("")).alias("html")).mapInArrow(run, DETAIL_DDL)
    rows = rows.withColumn("body", postings.without_trailing_navigation("body")).withColumns({"emails": text.emails("body"), "phones": text.phones("body")})
    empty = (F.length("body") < 50) & (F.greatest(*(F.size(c) for c in ("images", "attachments", "iframes", "videos", "jsonld"))) == 0)
    return rows.withColumn("error", F.when(empty, F.concat(F.lit("empty detail (body="), F.length("body"), F.lit("c, no media/jsonld)"))))


def stored(listed: DataFrame, details: DataFrame, *, key: str, list_only: bool = False) -> DataFrame:
    """Listed rows with what their detail says; those without a detail, or with one in error, are kept only if list_only, where no detail is looked at."""
    if list_only:
        return listed
    return listed.join(details.filter("error IS NULL").withColumnRenamed("page", key).drop("error"), key)


BLOCK = pa.schema([("page", pa.int64()), ("block", pa.int32()), ("signature", pa.string()), ("row", pa.int32()), ("pos", pa.int32()), ("href", pa.string()), ("text", pa.string()), ("row_text", pa.string())])


def block_anchors(pages: DataFrame, page: str, html: str, *, least: int = 2, skipped: tuple[str, ...] = ("nav", "aside", "header", "footer"), rows: tuple[str, ...] = ("li", "tr", "div", "article")) -> DataFrame:
    """page, block, signature, row, pos, href, text, row_text: all links in the rows of every repeating block (an element with least or more children of one tag
    and first class), outside the skipped elements. block, row and pos count from 1."""

    def read(key, source):
        root, block = tree(source), 0
        hidden = {id(n) for s in root.all(*skipped) for n in s.walk()} if skipped else set()
        for node in root.walk():
            if not isinstance(node, Node) or id(node) in hidden:
                continue
            kind_of = lambda k: (k.tag, " ".join(k.get("class").split()[:1]))
            kids = [k for k in node.kids if isinstance(k, Node) and k.tag in rows]
            kinds = Counter(map(kind_of, kids))
            kind, n = min(kinds.items(), key=lambda x: (-x[1], x[0]), default=(None, 0))
            if n < least:
                continue
            block += 1
            for i, row in enumerate([k for k in kids if kind_of(k) == kind], 1):
                for pos, a in enumerate(row.all("a"), 1):
                    yield key, block, f"{node.tag}>{kind[0]}.{kind[1]}", i, pos, a.attrs.get("href"), a.text(), row.text()[:400]

    def run(batches):
        for batch in batches:
            for key, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if found := list(read(key, source)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), BLOCK, strict=True)], schema=BLOCK)

    return pages.select(F.col(page).cast("long"), F.coalesce(html, F.lit(""))).mapInArrow(run, "page long, block int, signature string, row int, pos int, href string, text string, row_text string")
