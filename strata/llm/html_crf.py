"""HTML extraction (operator 8): a linear-chain conditional random field over DOM leaf blocks.

A page is read into blocks: runs of text without a block-level tag inside. A block is described
by its ancestors' tags and class names, and by its text; the field labels the blocks of a page
together (Lafferty et al. 2001), and Viterbi's algorithm finds the likeliest labels. It is
trained on pages made by labelled_pages(), whose parts are known by construction.

Edge cases: null or empty html gives an empty text; unclosed and stray tags are borne; scripts,
styles, comments and the head are never text; an unclosed one of these reaches to the end, but a
head to the first text or tag that cannot stand in one; a quote that nothing closes, or that no
= stands before, is a letter; a < without a > after it is text; long pages are read whole, in time and memory that
grow as their length; repeated rows are rows; an empty table gives no rows; columns beside
the named ones play no part.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_chunks

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
#: What ends a tag, or begins a quoted value in it.
_STOP = re.compile(r"""[<>]|=\s*+["']""")
#: Elements whose content is not read.
OPAQUE = frozenset("script style noscript template svg iframe object canvas title textarea select".split())
_ENDS = {t: re.compile(rf"</{t}\s*+>", re.I) for t in OPAQUE}
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What can stand in a head; any other tag, and text, ends one that is open.
IN_HEAD = frozenset("base basefont bgsound command head html link meta".split())
#: The outermost of these says most about what is inside.
HOLDERS = frozenset("nav header footer aside form article main section".split())
#: What a tag that begins ends of its own group, and the containers that keep it open.
GROUPS = (
    ({"p"}, {"div", "article", "section", "td", "li", "body", "blockquote"}),
    ({"li"}, {"ul", "ol", "menu"}),
    ({"td", "th"}, {"tr", "table"}),
    ({"tr"}, {"table"}),
    ({"dt", "dd"}, {"dl"}),
    ({"option"}, {"select"}),
)
OF_GROUP = {tag: i for i, (group, _) in enumerate(GROUPS) for tag in group}
GROUPED = frozenset().union(*(group | stop for group, stop in GROUPS))
#: Names in classes, ids and roles that tell something.
TELLING = frozenset("ad ads advert advertisement article author banner bio body bottom breadcrumb breadcrumbs byline caption comment commentlist comments content cookie consent copyright entry footer foot form header hero inner legal links login logo main masthead menu meta nav navbar navigation newsletter notice notification page pagination popup post promo promotion related reply respond search share sharing sidebar signup social sponsor sponsored story subscribe tag tags text toc top widget wrapper alert contentinfo complementary discussion reader disclaimer rail teaser".split())

#: Those of them, and the tags, that an article's own blocks are not inside of.
NEVER = frozenset("ad ads advert advertisement breadcrumb breadcrumbs comment commentlist comments cookie consent copyright footer form login menu nav navbar navigation newsletter pagination popup promo promotion related reply search share sharing sidebar signup social sponsor sponsored subscribe contentinfo complementary discussion respond aside".split())


class Tags:
    """The marks of a page, in one pass: no place is looked at more than a few times, whatever stands there."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.quoted = True  # until a quoted value has run to the end of the page

    def end_of_tag(self, at: int) -> int:
        """The place of the > of a tag whose name ends at `at`; -1 if another tag begins before it."""
        page, start = self.page, at
        while m := _STOP.search(page, at):
            c = m[0][-1]
            if c == ">":
                return m.start()
            if c == "<":
                return -1
            at = m.end()
            if self.quoted and at <= self.quotes[c]:
                at = page.index(c, at) + 1
        if not self.quoted:
            return -1
        self.quoted = False
        return self.end_of_tag(start)

    def __iter__(self):
        """(start, end, name, whether it is an end tag, attributes); the name is None for what is no element and for elements that are not read."""
        page, at = self.page, 0
        while (m := _OPEN.search(page, at)) and m.start() < self.last:
            name = (m[4] or "").lower()
            if m[1]:
                end = page.find("-->", m.end())
                at = len(page) if end < 0 else end + 3
                yield m.start(), at, None, False, ""
            elif m[2]:
                at = page.index(">", m.end()) + 1
                yield m.start(), at, None, False, ""
            elif (end := self.end_of_tag(m.end())) < 0:
                at = m.end()
            elif not m[3] and name in OPAQUE:
                close = _ENDS[name].search(page, end + 1)
                at = close.end() if close else len(page)
                yield m.start(), at, None, False, ""
            else:
                at = end + 1
                yield m.start(), at, name, bool(m[3]), page[m.end() : end]
        if m and m[1]:  # a comment that nothing ends
            yield m.start(), len(page), None, False, ""


@dataclass(frozen=True, eq=False)
class Place:
    """An open element and what is open above it, told once for all blocks inside."""

    tag: str = ""
    up: "Place | None" = None
    depth: int = 0
    names: frozenset[str] = frozenset()
    inner: tuple[str, ...] = ()  # the last three block-level tags
    blocks: int = 0  # how many of these there are
    within: frozenset[str] = frozenset()  # all of these but the last
    holder: str = "none"
    last: frozenset[str] = frozenset()  # names of the nearest element that has any
    junk: frozenset[str] = frozenset()  # names and tags of what is open that are never an article's
    body: bool = False
    path: int = 0  # the same for the same tags
    near: tuple["Place | None", ...] = (None,) * len(GROUPS)  # by group: what is open of it


ROOT = Place()


@dataclass
class Block:
    text: str
    place: Place
    linked: int  # characters inside links


class _Open:
    """The open elements of a page; every step costs the same however deep they stand."""

    def __init__(self):
        self.top, self.count, self.paths, self.links = ROOT, Counter(), {}, 0
        self.heads: list[Place] = []

    def begin(self, tag: str, names: frozenset[str]) -> None:
        up = self.top
        block = tag in BLOCKS
        within = up.within
        if block and up.inner and up.inner[-1] not in within:
            within = within | {up.inner[-1]}
        path = self.paths.setdefault((up.path, tag), len(self.paths) + 1)
        place = Place(tag, up, up.depth + 1, up.names if names <= up.names else up.names | names, (*up.inner, tag)[-3:] if block else up.inner, up.blocks + block, within, tag if up.holder == "none" and tag in HOLDERS else up.holder, names or up.last, up.junk | (names & NEVER) | ({tag} & NEVER), up.body or tag == "body", path)
        object.__setattr__(place, "near", up.near if tag not in GROUPED else tuple(place if tag in group else None if tag in stop else n for n, (group, stop) in zip(up.near, GROUPS, strict=True)))
        self.top = place
        self.count[tag] += 1
        self.links += tag == "a"
        if tag == "head" and place.depth <= 2:
            self.heads.append(place)

    def pop(self) -> Place:
        out, self.top = self.top, self.top.up
        self.count[out.tag] -= 1
        self.links -= out.tag == "a"
        if self.heads and self.heads[-1] is out:
            self.heads.pop()
        return out

    def end(self, tag: str) -> None:
        while self.count[tag] and self.pop().tag != tag:
            pass

    def end_like(self, tag: str) -> None:
        """What cannot hold the tag that begins ends first."""
        place = self.top.near[OF_GROUP[tag]]
        while place is not None and place.depth <= self.top.depth:
            self.pop()


def leaf_blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    parts: list[str] = []
    stack, linked = _Open(), 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and (stack.top.body or not stack.heads):
                out.append(Block(text, stack.top, linked))
            parts.clear()
        linked = 0

    def end_head() -> None:
        if stack.heads:
            flush()
            stack.end("head")

    def add(text: str) -> None:
        nonlocal linked
        if not text.isspace():
            end_head()
        parts.append(text)
        linked += len(text) if stack.links else 0

    at, page = 0, page or ""
    for start, end, name, ended, rest in Tags(page):
        if start > at:
            add(page[at:start])
        at = end
        if name is None:
            continue
        if not ended and name not in IN_HEAD:
            end_head()
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if ended:
            stack.end(name)
        elif name not in VOID and not rest.endswith("/"):
            if name in OF_GROUP:
                stack.end_like(name)
            names = frozenset(w for x in _NAMES.findall(rest) for w in _WORDS.findall("".join(x).lower()) if w in TELLING) if rest else frozenset()
            stack.begin(name, names)
    if at < len(page):
        add(page[at:])
    flush()
    return out


def describe(blocks: list[Block]) -> list[list[str]]:
    """Feature names of each block."""
    out = []
    lengths = [b.text.count(" ") + 1 for b in blocks]
    dense = [3 * b.linked > len(b.text) for b in blocks]
    # Words of sentences by the tags, and by the element, that they stand under: where most are, an article's blocks are.
    told, beside = Counter(), Counter()
    for b, n, d in zip(blocks, lengths, dense, strict=True):
        if n >= 6 and not d and not b.place.junk:
            told[b.place.path] += n
            beside[id(b.place.up)] += n
    whole = max(1, sum(told.values()))
    for i, b in enumerate(blocks):
        place = b.place
        inner = place.inner
        own = inner[-1] if inner else "none"
        words = b.text.count(" ") + 1
        f = ["bias", f"own={own}", f"parent={inner[-2] if len(inner) > 1 else 'none'}", f"words={min(words.bit_length(), 8)}", f"links={min(4, int(4 * b.linked / len(b.text)))}"]
        f.append("path=" + "/".join(inner))
        f += [f"holder={place.holder}", f"holder={place.holder},own={own},{'named' if place.names else 'plain'}"]
        f += [f"in={t}" for t in place.within] + [f"name={n}" for n in place.names] + [f"last={n}" for n in place.last] + [f"junk={n}" for n in place.junk]
        where = "junk" if place.junk else "clean"
        f.append("clean" if not place.junk else "within junk")
        # What stands around, and whether this reads like a sentence.
        before, after = max(i - 1, 0), min(i + 1, len(blocks) - 1)
        f += [f"before={min(lengths[before].bit_length(), 6)},{dense[before]}", f"after={min(lengths[after].bit_length(), 6)},{dense[after]}"]
        sentence = lengths[i] >= 6 and not dense[i]
        f.append(f"prose={sentence},{where},{min(lengths[i].bit_length(), 6)}")
        if not place.junk:
            f += [f"share={4 * told[place.path] // whole}", f"beside={4 * beside[id(place.up)] // whole}"]
        f.append("stop" if b.text[-1] in ".!?…:;\"'»”" else "open")
        f.append(f"stops={min(3, sum(map(b.text.count, '.!?')))}")
        if "©" in b.text or "(c)" in b.text.lower():
            f.append("rights")
        if b.text.count("|") + b.text.count("·") > 1:
            f.append("bars")
        if own in ("h1", "h2", "h3", "h4", "h5", "h6"):
            f.append("heading")
        f.append("first" if i == 0 else "last" if i == len(blocks) - 1 else "inside")
        if i and blocks[i - 1].place.path == place.path:
            f.append("alike")
        out.append(f)
    return out


@dataclass
class Field:
    weights: dict[str, tuple[float, float]]
    moves: np.ndarray  # from label, to label

    def decode(self, features: list[list[str]]) -> list[int]:
        """Viterbi: the likeliest labels of a page's blocks."""
        (aa, ab), (ba, bb) = self.moves.tolist()
        none = (0.0, 0.0)
        x = y = 0.0
        back: list[tuple[int, int]] = []
        for i, f in enumerate(features):
            e = [self.weights.get(name, none) for name in f]
            p, q = sum(w[0] for w in e), sum(w[1] for w in e)
            if i:
                from_x, from_y = (0 if x + aa >= y + ba else 1), (0 if x + ab >= y + bb else 1)
                back.append((from_x, from_y))
                x, y = max(x + aa, y + ba) + p, max(x + ab, y + bb) + q
            else:
                x, y = p, q
        if not features:
            return []
        label = 0 if x >= y else 1
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 120, rate: float = 0.1, ridge: float = 2e-3) -> Field:
    """Maximum conditional likelihood with a ridge, by Adam on exact gradients (forward and backward over all pages at once)."""
    pages = [p for p in pages if p[0]]
    names = sorted({n for f, _ in pages for block in f for n in block})
    number = {n: i for i, n in enumerate(names)}
    longest, count = max(len(f) for f, _ in pages), len(pages)
    x = np.zeros((count, longest, len(names)), np.float32)
    y, there = np.zeros((count, longest), np.int64), np.zeros((count, longest), bool)
    for i, (f, labels) in enumerate(pages):
        for j, block in enumerate(f):
            x[i, j, [number[n] for n in block]] = 1
        y[i, : len(f)], there[i, : len(f)] = labels, True
    flat, n = x.reshape(-1, len(names)), there.sum()
    w, moves = np.zeros((len(names), 2)), np.zeros((2, 2))
    truth = np.eye(2)[y] * there[:, :, None]
    both = there[:, 1:] & there[:, :-1]
    pair_truth = np.einsum("pta,ptb,pt->ab", truth[:, :-1], truth[:, 1:], both)
    state = [np.zeros_like(v) for v in (w, w, moves, moves)]
    lse = lambda a, axis: np.logaddexp.reduce(a, axis)
    for step in range(1, rounds + 1):
        e = (flat @ w.astype(np.float32)).reshape(count, longest, 2).astype(float) * there[:, :, None]
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for t in range(1, longest):
            a[:, t] = np.where(there[:, t, None], lse(a[:, t - 1, :, None] + moves, 1) + e[:, t], a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(there[:, t + 1, None], lse(moves[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        z = lse(a[:, 0] + b[:, 0], 1)
        p = np.exp(a + b - z[:, None, None]) * there[:, :, None]
        pair = np.exp(a[:, :-1, :, None] + moves + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        gw = flat.T @ (truth - p).reshape(-1, 2).astype(np.float32) / n - ridge * w
        gm = (pair_truth - pair.sum((0, 1))) / n - ridge * moves
        for k, (v, g) in enumerate(((w, gw), (moves, gm))):
            m, s = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Field({name: (float(w[i, 0]), float(w[i, 1])) for name, i in number.items()}, moves)


class Maker:
    """Writes pages part by part and remembers which blocks are the article's."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(("an", "er", "to", "in", "ré", "ste", "ou", "kel", "mi", "da", "lo", "ß", "ei")) for _ in range(self.r.randint(1, 4)))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high))).capitalize()

    def sentence(self) -> str:
        return self.phrase(2, 22) + self.r.choice("....!?")

    def prose(self) -> str:
        u = self.r.random()
        if u < 0.12:  # real pages hold odd prose too
            return self.r.choice((" ".join([self.word()] * self.r.randint(3, 60)), self.phrase(20, 80), self.phrase(5, 40).upper() + "!!", " | ".join(self.phrase(1, 2) for _ in range(self.r.randint(4, 30))), " ".join(self.word() + self.r.choice(("***", "###", "$$$")) for _ in range(self.r.randint(4, 60))), self.word()))
        text = " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 5, 8))))
        words = text.split()
        if self.r.random() < 0.3 and len(words) > 4:
            k = self.r.randrange(len(words) - 2)
            words[k] = self.r.choice((f'<a href="/x">{words[k]}</a>', f"<b>{words[k]}</b>", f"<em>{words[k]}</em>", f"{words[k]} &amp; co", f"{words[k]}<br>"))
        return " ".join(words)

    def named(self, tag: str, *names: str) -> str:
        how = self.r.choice(("class", "class", "id"))
        return f'<{tag} {how}="{self.r.choice(names)}">'

    def links(self, low: int = 2, high: int = 8) -> str:
        if self.r.random() < 0.75:
            return "<ul>" + "".join(f'<li><a href="/{i}">{self.phrase(1, 4)}</a></li>' for i in range(self.r.randint(low, high))) + "</ul>"
        return " | ".join(f'<a href="/{i}">{self.phrase(1, 3)}</a>' for i in range(self.r.randint(low, high)))

    def junk(self, where: str) -> str:
        r = self.r
        kinds = {
            "nav": lambda: r.choice(("<nav>", self.named("div", "nav", "menu", "main-menu", "navbar", "navigation"))) + self.links(),
            "header": lambda: r.choice(("<header>", self.named("div", "header", "masthead", "top-banner"))) + r.choice((f"<h1>{self.phrase(1, 3)}</h1>", f'<a href="/">{self.phrase(1, 3)}</a>', f"<p>{self.phrase(3, 8)}</p>", f"<h2>{self.phrase(1, 4)}</h2>")),
            "ad": lambda: self.named("div", "ad", "ads", "advert", "advertisement", "ad-banner", "sponsored", "promo") + r.choice((self.prose(), f"<p>{self.prose()}</p>", f'<a href="/buy">{self.phrase(3, 8)}</a>')),
            "side": lambda: r.choice(("<aside>", self.named("div", "sidebar", "widget", "rail", "related", "related-links"))) + f"<h3>{self.phrase(1, 4)}</h3>" + r.choice((self.links(), f"<p>{self.prose()}</p>")),
            "notice": lambda: self.named("div", "cookie-notice", "cookie", "consent", "notice", "alert", "popup", "notification") + f"<p>{self.prose()}</p>" + "<button>OK</button>",
            "form": lambda: r.choice(("<form>", self.named("form", "search", "newsletter", "subscribe", "login"))) + f"<p>{self.phrase(2, 9)}</p><label>{self.phrase(1, 2)}</label><input><button>{self.phrase(1, 2)}</button>",
            "share": lambda: self.named("div", "share", "social", "sharing", "tags", "breadcrumb", "pagination") + self.links(2, 5),
            "comments": lambda: r.choice(("<section", "<div")) + r.choice((' id="comments">', ' class="comments">', ' class="commentlist">', ' id="discussion">', ' class="reader-comments">')) + f"<h3>{self.phrase(1, 3)}</h3>" + "".join(r.choice((f"<p>{self.prose()}</p>", f'<div class="comment"><b>{self.word()}</b><p>{self.prose()}</p></div>', f"<li>{self.prose()}</li>")) for _ in range(r.randint(1, 5))),
            "footer": lambda: r.choice(("<footer>", self.named("div", "footer", "copyright", "legal", "bottom"))) + r.choice((f"&copy; {self.phrase(1, 3)} &middot; {self.sentence()}", f"<p>© 2020 {self.phrase(1, 5)}</p>", self.links() + f"<p>{self.prose()}</p>", f"<p>{self.prose()}</p>")),
            "code": lambda: "<script>var a = '<p>" + self.prose().replace("<", "") + "</p>';</script>",
        }
        body = kinds[where]()
        opened = re.match(r"<(\w+)", body)
        return f"{body}</{opened[1]}>" if opened and where != "code" else body

    def holder(self) -> tuple[list[str], list[str]]:
        """Tags that open around the article, and the names they close by. Many pages have none, or names that tell nothing."""
        r = self.r
        if r.random() < 0.55:
            outer = r.choice((None, None, "main", 'div class="content"', 'div id="main"', 'div class="wrapper"'))
            inner = r.choice(("article", "article", "main", 'div class="post"', 'div class="article-body"', 'div class="entry-content"', 'section class="story"', "section", 'div id="content"', 'div class="text"'))
        else:
            outer = r.choice((None, None, "div", f'div class="{self.word()}"', "center"))
            inner = r.choice((None, None, "div", f'div class="{self.word()}"', f'div id="{self.word()}"', f'section class="{self.word()}-{r.randint(1, 9)}"', "table", "td"))
        tags = [outer] if outer else []
        tags += ["table", "tr", "td"] if inner in ("table", "td") else [inner] if inner else []
        return tags, [t.split()[0] for t in reversed(tags)]

    def page(self) -> tuple[str, list[int]]:
        """html, and the label of each of its leaf blocks."""
        r, pieces = self.r, []  # (html, label)
        add = lambda label, text: pieces.append((text, label))
        if r.random() < 0.5:
            add(0, self.junk("notice"))
        order = ["header", "nav", "ad", "form", "share", "side"]
        r.shuffle(order)
        for kind in order[: r.randint(0, 5)]:
            add(0, self.junk(kind))
        opened, closed = self.holder()
        for t in opened:
            add(None, f"<{t}>")
        paragraph = r.choice(("p", "p", "p", "p", "p", "div", f'div class="{self.word()}"', f'p class="{self.word()}"'))
        if r.random() < 0.85:
            title = f"<h1>{self.phrase(2, 12)}{r.choice(('', '', '.'))}</h1>"
            add(1, f"<header>{title}</header>" if r.random() < 0.1 else title)
        odd = r.choice((0.03, 0.09, 0.09, 0.35))  # junk among the article's own blocks
        for _ in range(r.choice((1, 1, 2, 3, r.randint(1, 14), r.randint(1, 14), r.randint(1, 14), r.randint(5, 25)))):
            if r.random() < odd:
                add(0, self.junk(r.choice(("ad", "ad", "share", "side", "code", "form", "notice", "comments"))))
            u = r.random()
            if u < 0.74:
                add(1, f"<{paragraph}>{self.prose()}" + (f"</{paragraph.split()[0]}>" if paragraph[0] == "d" else r.choice(("</p>", "</p>", "</p>", "", "<br>"))))
            elif u < 0.82:
                add(1, f"<h{(k := r.randint(2, 4))}>{self.phrase(1, 8)}</h{k}>")
            elif u < 0.88:
                add(1, "<ul>" + "".join(f"<li>{r.choice((self.phrase(2, 9), self.sentence()))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif u < 0.92:
                add(1, f"<blockquote>{self.prose()}</blockquote>")
            elif u < 0.95:
                add(1, "<table>" + "".join(f"<tr><td>{self.phrase(1, 3)}</td><td>{self.word()}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                add(1, f'<figure><img src="x.png"><figcaption>{self.phrase(3, 10)}</figcaption></figure>')
        if r.random() < 0.15:  # some put the comments inside
            add(0, self.junk("comments"))
        for t in closed:
            add(None, f"</{t}>")
        order = ["comments", "comments", "side", "share", "nav", "ad", "form"]
        r.shuffle(order)
        for kind in order[: r.randint(0, 4)]:
            add(0, self.junk(kind))
        if r.random() < 0.85:
            add(0, self.junk("footer"))
        head = f"<!DOCTYPE html><html><head><title>{self.phrase(2, 9)}</title><style>p{{margin:0}}</style></head><body>"
        # A mark in each piece shows where its blocks lie; the mark is taken out again.
        marked = head + "".join(t if label is None else re.sub(r"(>|^)(?=[^<]*[^<\s])(?!var )", lambda m, i=i: f"{m[1]}\x02{i}\x03", t) for i, (t, label) in enumerate(pieces)) + "</body></html>"
        labels = []
        for b in leaf_blocks(marked):
            ids = re.findall("\x02(\\d+)\x03", b.text)
            labels.append(pieces[int(ids[0])][1] if ids else 0)
        return re.sub("\x02\\d+\x03", "", marked), labels


def labelled_pages(count: int, seed: int = 1) -> list[tuple[str, list[int]]]:
    """Made pages and the labels of their leaf blocks: 1 for the article's."""
    out = []
    for i in range(count):
        page, labels = Maker(seed * 1_000_003 + i).page()
        if len(leaf_blocks(page)) == len(labels):
            out.append((page, labels))
    return out


@lru_cache(maxsize=2)
def trained_field(count: int = 600, seed: int = 1) -> Field:
    return train([(describe(leaf_blocks(page)), labels) for page, labels in labelled_pages(count, seed)])


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, label in zip(blocks, field.decode(describe(blocks)), strict=True) if label)


def extracted(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of pages (id, url, html)."""
    field = trained_field()

    def run(batches):
        for b, texts in in_chunks(batches, "html"):
            out = [main_text(t, field) for t in texts]
            yield pa.RecordBatch.from_arrays([b["id"], b["url"], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["id", "url", "text", "n_chars"])

    schema = T.StructType([T.StructField("id", pages.schema[id_column].dataType), pages.schema["url"], *T._parse_datatype_string("text string, n_chars long").fields])
    return pages.select(F.col(id_column).alias("id"), "url", F.col(html).alias("html")).mapInArrow(run, schema)


def op8_crf_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")
