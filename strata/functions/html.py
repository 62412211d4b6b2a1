"""HTML: native expressions for what a regular expression can tell, and one Arrow UDF for the rest.

parse_page() reads a page once and returns everything the engine needs of the DOM. Its main
text follows rules of its own: the page's text is cut into blocks, those in junk containers and those that
are mostly links are left out, loose text outside of paragraphs stays if it or its neighbours read like prose, and
if little stays all that is not chrome does. What stays is written as Markdown, links in place
and tables of data as tables.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection
from functools import cache
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .text import clean

# The ids on which single-page applications mount, and the tags that hold headings,
# content and what is never text.
MOUNT_IDS = ("app", "__nuxt", "__next", "root", "q-app", "___gatsby", "svelte")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CONTENT = ("p", "li", "td", "th", "blockquote", "figcaption", "dd", "dt")
JUNK = ("script", "style", "noscript", "template")
CHROME = ("nav", "footer", "aside", "form", "button", "select", "header", "menu", "dialog")
#: Words in an element's class or id that tell that it is not text of the page.
NOT_TEXT = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comments consent cookie cookies menu modal navbar navigation newsletter pagination popup promo related share sharing sidebar social sponsored subscribe toolbar widget".split())
#: Elements that are text of the page whatever they are called.
WHOLE = frozenset(("html", "body", "main", "article"))
#: What an image's surrounding text is taken from.
AROUND = frozenset(("figure", "p", "div", "section"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LINE = frozenset((*HEADINGS, *CONTENT, "div", "section", "article", "main", "tr", "table", "ul", "ol", "dl", "pre", "figure", "body"))


BLOCK = LINE | set(CHROME)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
#: What parse_page() returns; written out, as workers import it without a session.
PAGE = _struct(
    title=_TEXT, lang=_TEXT, has_body=T.BooleanType(), body_text=_TEXT, ids=_TEXTS,
    sequence=T.ArrayType(_struct(pos=T.IntegerType(), kind=_TEXT, level=T.IntegerType(), text=_TEXT)), markdown=_TEXT, links=_TEXTS,
    images=T.ArrayType(_struct(src=_TEXT, alt=_TEXT, caption=_TEXT, surrounding_text=_TEXT)),
)


#: Cells of a table of data have so many characters at most, on average; a cell spans so many rows and columns at most,
#: and all of a table no more than these and twenty a cell, or none does.
LONG_CELL, MOST_SPANNED = 200, 1000
#: Main text of fewer words is looked for again among all that is not chrome.
LITTLE = 25
#: Where a paragraph left open cannot have begun outside of.
ENDS_P = frozenset("body div section article main td th li blockquote figure nav header footer aside form dd dt".split())
#: Elements that end when one of their like begins: what ends, and the containers that keep it open.
LIKE = {
    "li": [("li", {"ul", "ol", "menu"})],
    "tr": [("tr", {"table"})],
    **dict.fromkeys(("td", "th"), [("td", {"tr", "table"}), ("th", {"tr", "table"})]),
    **dict.fromkeys(("dt", "dd"), [("dt", {"dl"}), ("dd", {"dl"})]),
}


class _Node:
    """An element: where its text lies in the page's, and what is known of the elements around it."""

    __slots__ = ("tag", "attrs", "start", "end", "linked", "is_body", "in_body", "chrome", "in_chrome", "in_content", "in_item", "figure", "around", "caption", "block", "anchor", "item", "quote", "table", "outer", "row", "depth")

    def __init__(self, tag: str, attrs: dict[str, str], up: "_Node | None", start: int, linked: int):
        self.tag, self.attrs, self.start, self.end, self.linked = tag, attrs, start, None, linked
        self.caption: _Node | None = None
        named = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
        self.chrome = tag in CHROME or tag not in WHOLE and not NOT_TEXT.isdisjoint(re.split("[^a-z]+", named))
        self.is_body = False  # true of a page's first body
        near = lambda name, tags: self if tag in tags else getattr(up, name) if up else None
        self.block, self.anchor = near("block", BLOCK) or self, near("anchor", ("a",))
        self.depth = (up.depth if up else 0) + (tag in ("ul", "ol"))
        self.item, self.quote = near("item", ("li",)), near("quote", ("blockquote",))
        # A table in a cell is a table of its own.
        self.outer, self.table = up.table if up else None, near("table", ("table",))
        self.row = None if tag == "table" else near("row", ("tr",))
        if up is None:
            self.in_body = self.in_chrome = self.in_content = self.in_item = False
            self.figure = self.around = None
            return
        self.in_body = up.in_body or up.is_body
        self.in_chrome = up.in_chrome or up.chrome
        self.in_content = up.in_content or up.tag in CONTENT
        self.in_item = up.in_item or up.tag == "li"
        self.figure = up if up.tag == "figure" else up.figure
        self.around = up if up.tag in AROUND else up.around


class _Page(HTMLParser):
    """Keeps the open elements and one list of texts, in which each element has a beginning and an end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.linked, self.has_body = [], 0, False
        #: Of each part of the text, the element that it stands in; and the parts that a line break stands before.
        self.owners, self.breaks = [], set()
        self.open, self.all, self.count = [_Node("", {}, None, 0, 0)], [], Counter()

    def handle_starttag(self, tag, attrs):
        if tag in LINE:
            self._end("p", ENDS_P)
        for own, stop in LIKE.get(tag, ()):
            self._end(own, stop)
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.open[-1], len(self.parts), self.linked)
        self.all.append(node)
        if tag == "body" and not self.has_body:
            node.is_body = self.has_body = True
        figure = node.figure if tag == "figcaption" else None
        while figure is not None and figure.caption is None:
            figure.caption, figure = node, figure.figure
        if tag in VOID:
            if tag == "br":
                self.breaks.add(len(self.parts))
            self._done(node)
        else:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _done(self, node):
        node.end, node.linked = len(self.parts), self.linked - node.linked

    def _cut(self, k):
        """Ends the open elements from the k-th on."""
        while len(self.open) > k:
            node = self.open.pop()
            self.count[node.tag] -= 1
            self._done(node)

    def _end(self, tag, stop):
        """An element that cannot hold what begins now ends first, if no container is in between."""
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                return self._cut(k)
            if self.open[k].tag in stop:
                return None

    def handle_endtag(self, tag):
        if self.count[tag]:
            while self.open[-1].tag != tag:
                self._cut(len(self.open) - 1)
            self._cut(len(self.open) - 1)

    def handle_data(self, data):
        if not any(self.count[t] for t in JUNK):
            self.parts.append(data)
            self.owners.append(self.open[-1])
            if self.count["a"]:
                self.linked += len(data)

    def close(self):
        super().close()
        self._cut(1)

    def text(self, node: _Node | None) -> str:
        return "".join(self.parts[node.start : node.end]) if node else ""


def _clean(s: str) -> str:
    return " ".join(s.split())


class _Block:
    """A run of text in one block element: its Markdown, its words, and how much of it is links."""

    __slots__ = ("owner", "text", "words", "density")

    def __init__(self, page: _Page, owner: _Node, start: int, stop: int, base: str):
        self.owner = owner
        self.text, plain, linked = _linked_text(page, start, stop, base)
        self.words = len(plain.split())
        self.density = linked / max(1, len(plain))

    def reads(self) -> bool:
        """Like prose."""
        return self.words >= 10 and self.density <= 1 / 3


def _linked_text(page: _Page, start: int, stop: int, base: str) -> tuple[str, str, int]:
    """(Markdown with links in place, the same without them, characters of links) of a run of parts."""
    out, plain, linked, k = [], [], 0, start
    while k < stop:
        anchor, j = page.owners[k].anchor, k
        while j < stop and page.owners[j].anchor is anchor:
            j += 1
        raw = "".join((" " if i in page.breaks else "") + page.parts[i] for i in range(k, j))
        plain.append(raw)
        text = _clean(raw)
        target = _target(anchor, base) if anchor is not None and text else ""
        if anchor is not None:
            linked += len(text)
        if target:
            lead, tail = (" " if raw[:1].isspace() else ""), (" " if raw[-1:].isspace() else "")
            raw = f"{lead}[{text.replace('[', '(').replace(']', ')')}]({target}){tail}"
        out.append(raw)
        k = j
    return _clean("".join(out)), _clean("".join(plain)), linked


def _target(anchor: _Node, base: str) -> str:
    """Where a link leads, resolved against the page; empty for places in the page and for what is no address."""
    href = anchor.attrs.get("href", "").strip()
    if not href or href.startswith("#"):
        return ""
    try:
        whole = urljoin(base, href) if base else href
        good = not urlsplit(whole).scheme or whole.startswith(("http://", "https://", "mailto:"))
    except ValueError:
        return ""
    return whole.replace(" ", "%20").replace("(", "%28").replace(")", "%29") if good else ""


def _blocks(page: _Page, has_body: bool, base: str) -> list[_Block]:
    """The blocks of the body in reading order. Text inside a paragraph, an item or a cell belongs to it; other text to the element around it."""
    out, k, n = [], 0, len(page.parts)
    while k < n:
        owner, j = page.owners[k].block, k
        while j < n and page.owners[j].block is owner:
            j += 1
        if not has_body or owner.in_body or owner.is_body:
            out.append(_Block(page, owner, k, j, base))
        k = j
    return [b for b in out if b.words]


def _grid(page: _Page, cells: list[_Node], base: str) -> list[list[str]]:
    """The texts of a table's cells by row and column; a cell that spans several has its text in the first."""
    rows: dict[int, int] = {}
    for c in cells:
        rows.setdefault(id(c.row), len(rows))
    grid: list[dict[int, str]] = [{} for _ in rows]
    spans = [(_span(c, "colspan"), min(_span(c, "rowspan"), len(rows) - rows[id(c.row)])) for c in cells]
    if sum(w * h for w, h in spans) > MOST_SPANNED + 20 * len(cells):  # no table that anyone could read
        spans = [(1, 1)] * len(cells)
    free = [0] * len(rows)
    for c, (wide, high) in zip(cells, spans, strict=True):
        r = rows[id(c.row)]
        col = free[r]
        while col in grid[r]:
            col += 1
        free[r] = col
        text = _linked_text(page, c.start, c.end, base)[0].replace("|", "\\|")
        for y in range(r, min(r + high, len(grid))):
            for x in range(col, col + wide):
                grid[y].setdefault(x, text if (y, x) == (r, col) else "")
    width = max((max(g) + 1 for g in grid if g), default=0)
    return [[g.get(x, "") for x in range(width)] for g in grid]


def _span(cell: _Node, name: str) -> int:
    value = cell.attrs.get(name, "").strip()
    return min(max(int(value), 1), MOST_SPANNED) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def _tables(page: _Page) -> dict[int, list[_Node]]:
    """The cells of each table of data, by the table. Tables with others in them, with headings, or whose cells are long, lay out a page."""
    cells: dict[int, list[_Node]] = {}
    layout: set[int] = set()
    for n in page.all:
        if n.tag in ("td", "th") and n.table is not None and n.row is not None:
            cells.setdefault(id(n.table), []).append(n)
        elif n.tag in HEADINGS and n.table is not None:
            layout.add(id(n.table))
        elif n.tag == "table" and n.outer is not None:
            layout.add(id(n.outer))
    out = {}
    for t, own in cells.items():
        lengths = [len(_clean(page.text(c))) for c in own]
        rows = Counter(id(c.row) for c in own)
        if t not in layout and len(rows) > 1 and max(rows.values()) > 1 and sum(lengths) <= LONG_CELL * len(own):
            out[t] = own
    return out


def _markdown(page: _Page, has_body: bool, base: str = "") -> str:
    blocks = _blocks(page, has_body, base)
    chrome = [b.owner.in_chrome or b.owner.chrome for b in blocks]
    kept = []
    for k, b in enumerate(blocks):
        if chrome[k]:
            kept.append(False)
        elif b.owner.tag in HEADINGS:
            kept.append(True)
        elif b.density > 0.6 and b.words < 40:
            kept.append(False)
        elif b.owner.tag in CONTENT or b.owner.tag == "pre" or b.owner.in_content:
            kept.append(True)
        else:  # loose text: prose, or between blocks that are
            near = [blocks[j] for j in (k - 1, k + 1) if 0 <= j < len(blocks) and not chrome[j]]
            kept.append(b.reads() or b.density <= 1 / 3 and b.words > 1 and any(x.reads() for x in near))
    told = lambda marks: sum(b.words for b, m in zip(blocks, marks, strict=True) if m and b.owner.tag not in HEADINGS)
    if told(kept) < LITTLE:  # all but chrome and lists of links, if that is more
        more = [not c and (b.owner.tag in HEADINGS or b.density <= 0.6) for b, c in zip(blocks, chrome, strict=True)]
        kept = more if told(more) > 2 * told(kept) else kept
    data = _tables(page)
    out: list[str] = []
    done: set[int] = set()
    item: _Node | None = None
    for b, stays in zip(blocks, kept, strict=True):
        n = b.owner
        if n.table is not None and id(n.table) in data and not n.in_chrome:
            if id(n.table) not in done:
                done.add(id(n.table))
                grid = _grid(page, data[id(n.table)], base)
                rows = ["| " + " | ".join(r) + " |" for r in grid]
                out.append("\n".join([rows[0], "|" + " --- |" * len(grid[0]), *rows[1:]]))
                item = None
            continue
        if not stays:
            continue
        holder = n.item
        if n.tag in HEADINGS:
            out.append("#" * int(n.tag[1]) + " " + b.text)
        elif holder is not None:
            if holder is item:  # more of the same item
                out[-1] += " " + b.text
            else:
                out.append("  " * max(0, holder.depth - 1) + "- " + b.text)
        elif n.quote is not None:
            out.append("> " + b.text)
        else:
            out.append(b.text)
        item = holder
    return "\n\n".join(out)


def _closed_only(html: str) -> str:
    """The page with every & that begins no reference closed by a semicolon written out, so that it is read as it stands."""
    return re.sub(r"&(#(?:[0-9]+|[xX][0-9a-fA-F]+);|\w+;)?", lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + (m[1] or ""), html)


def _these_only(html: str, references: Collection[str]) -> str:
    """The page with every & that begins none of these references written out."""
    return re.sub(f"&(?!{'|'.join(map(re.escape, references))})" if references else "&", "&amp;", html)


def read_page(html: str | None, url: str | None = None, only: Collection[str] | None = None, closed: bool = False, references: Collection[str] | None = None) -> dict:
    """The fields of PAGE, or `only` those named. Like browsers it reads some references without a semicolon (&amp, &copy), unless only `closed` ones are wanted, or only some `references`, given as they are written after the &."""
    if references is not None:
        html = _these_only(html or "", references)
    wanted = PAGE.fieldNames() if only is None else only
    page = _Page()
    page.feed(_closed_only(html or "") if closed else html or "")
    page.close()
    first = lambda tag: next((n for n in page.all if n.tag == tag), None)
    body = first("body")

    def sequence():
        out = []
        for n in page.all:
            if body is not None and not n.in_body:
                continue
            if n.tag in HEADINGS:
                if text := _clean(page.text(n)):
                    out.append({"pos": len(out), "kind": "h", "level": int(n.tag[1]), "text": text})
            elif n.tag in CONTENT:
                out.append({"pos": len(out), "kind": "c", "level": None, "text": page.text(n)})
        return out

    def images():
        out = []
        for n in page.all:
            if n.tag == "img" and (src := n.attrs.get("src") or n.attrs.get("data-src")):
                caption = n.figure.caption if n.figure else None
                out.append({"src": src, "alt": _clean(n.attrs.get("alt", "")), "caption": _clean(page.text(caption)), "surrounding_text": _clean(page.text(n.around))[:500]})
        return out

    top = first("html")
    fields = {
        "title": lambda: _clean(page.text(first("title"))) or _clean(page.text(first("h1"))),
        "lang": lambda: top.attrs.get("lang", "") if top else "",
        "has_body": lambda: body is not None,
        "body_text": lambda: _clean(page.text(body)),
        "ids": lambda: [n.attrs["id"] for n in page.all if "id" in n.attrs],
        "sequence": sequence,
        "markdown": lambda: _markdown(page, body is not None, url or ""),
        "links": lambda: [n.attrs["href"] for n in page.all if n.tag == "a" and "href" in n.attrs],
        "images": images,
    }
    return {k: fields[k]() for k in wanted}


#: Pages read at a time: what Python makes of more is not held, only their results as Arrow has them.
PAGES_AT_ONCE = 32


@cache
def _reader(only: tuple[str, ...], closed: bool, references: tuple[str, ...] | None):
    """The UDF of those fields."""
    kind = to_arrow_type(T.StructType([PAGE[k] for k in only]))

    # Called non-deterministic, or Spark reads each page again for each use of a field (a filter before an explode, say).
    def parsed(html: pa.Array, url: pa.Array) -> pa.Array:
        parts = []
        for k in range(0, len(html), PAGES_AT_ONCE):
            rows = zip(html.slice(k, PAGES_AT_ONCE).to_pylist(), url.slice(k, PAGES_AT_ONCE).to_pylist(), strict=True)
            parts.append(pa.array([read_page(h, u, only, closed, references) for h, u in rows], kind))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(parsed, T.StructType([PAGE[k] for k in only])).asNondeterministic()


def parse_page(html: Column | str, url: Column | str | None = None, only: Collection[str] | None = None, closed: bool = False, references: Collection[str] | None = None) -> Column:
    """The page as a struct (PAGE), or of `only` the fields named: the others are not worked out. With its URL, links in the Markdown are whole. closed, references: as for read_page()."""
    return _reader(tuple(only or PAGE.fieldNames()), closed, None if references is None else tuple(references))(html, F.lit(None).cast("string") if url is None else url)


def read_pages(pages: DataFrame, base: str | None = None, only: Collection[str] | None = None, closed: bool = False, references: Collection[str] | None = None) -> DataFrame:
    """pages (html, ...) with the fields of PAGE, or `only` those named, in place of html; `base` names the column of URLs that make links in the Markdown whole.

    What is read is given on every PAGES_AT_ONCE pages, so a worker holds no more results, however many pages its task has.
    """
    fields = tuple(only or PAGE.fieldNames())
    rest = [c for c in pages.columns if c != "html"]
    kind = T.StructType([PAGE[k] for k in fields])
    arrow = to_arrow_type(kind)

    def read(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, PAGES_AT_ONCE):
                b = whole.slice(k, PAGES_AT_ONCE)
                addresses = b[base].to_pylist() if base is not None else [None] * b.num_rows
                rows = pa.array([read_page(h, u, fields, closed, references) for h, u in zip(b["html"].to_pylist(), addresses, strict=True)], arrow)
                yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), *rows.flatten()], [*rest, *fields])

    return pages.mapInArrow(read, T.StructType([*(pages.schema[c] for c in rest), *kind.fields]))


def spa_shell(page: Column, threshold: int = 1500) -> Column:
    """True for a parsed page with a mount id and little text of its own."""
    return page["has_body"] & (F.length(page["body_text"]) < threshold) & F.arrays_overlap(page["ids"], F.array(*map(F.lit, MOUNT_IDS)))


# Native expressions, for queries that need no DOM.


def without_junk(html: Column) -> Column:
    for tag in JUNK:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    return html


def text_of(html: Column) -> Column:
    """Text of the body's tags, entities as written."""
    return clean(F.regexp_replace(without_junk(html), "<[^>]*>", " "))


def title_of(html: Column) -> Column:
    """The title's text with the common entities read, or 'Untitled'."""
    t = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = clean(t)
    return F.when(t == "", F.lit("Untitled")).otherwise(t)


def lang_of(html: Column) -> Column:
    lang = F.regexp_extract(html, r"""(?i)<html[^>]*\blang=["']?([A-Za-z-]+)""", 1)
    return F.when(lang == "", F.lit("en")).otherwise(lang)


def hrefs_of(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
