"""Main text of HTML pages by tree scoring.

A page is read into a tree: implied end tags, void elements, raw text elements, comments and
unclosed ends as browsers read them. What is no article by its tag, role or class goes first:
menus, headers, footers, sidebars, notices, adverts, forms, scripts, reader comments. Then every
paragraph gives points for its length and its commas, discounted by the share of its characters
that are links. They pass to the container around it, half of them to the next one out, and so
on; an ``article`` or ``main`` begins with points of its own. The container with the most, again
discounted by its links, is the best one; where it stands in an ``article``, that is. Siblings
stay if they have a fifth of its points, or are headings, lists or paragraphs beside it that are
not links. All text of what is kept is returned but for lists of links.

Blocks are what stands between the borders of block elements. Character references are decoded,
white space becomes one space, blocks are joined in page order by two line feeds. Headings in the
header of an article belong to it.

A page is one row and no rows meet, so one pass over the table without a shuffle does it.

Defined cases: null and empty pages, pages without text and pages of links only have an empty
text; text without any tag is one block; a page cut off in a tag ends before it; repeated rows
stay; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values: element names of the language -------------------------------------
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An open p ends before these.
ENDS_P = BLOCK - frozenset("body caption head html legend option optgroup tbody td tfoot th thead tr".split())
# A start tag ends these open elements, up to the borders.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th", "html"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th", "html"}), "dd": ({"dt", "dd"}, {"dl", "table", "td", "th", "html"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
BORDERS = frozenset("html table td th caption button object template".split())
# --- fixed values: what is no article --------------------------------------------------
NOISE_TAGS = frozenset(
    "aside audio button canvas datalist dialog embed footer frameset head iframe input map math menu nav noembed noframes "
    "noscript object script search select style svg template textarea title video xmp".split()
)
NOISE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
# Never the article, whatever is inside.
NOISE_WORDS = frozenset(
    "ad ads adbox adsense advert advertisement advertising adverts adverisement comment commentlist comments cookie cookies "
    "consent discussion disqus gdpr promo promoted promotion recommended recommendations related replies reply respond "
    "sponsor sponsored sponsors teaser teasers taboola outbrain".split()
)
# Not the article, unless it is inside.
FRAME_WORDS = frozenset(
    "banner breadcrumb breadcrumbs footer header login masthead menu menus modal nav navbar navigation newsletter notice "
    "notices notification notifications overlay pager pagination popup search share sharing sidebar signup social subscribe "
    "subscription toolbar topbar widget widgets".split()
)
MAIN_WORDS = frozenset("article articlebody content entry main post story".split())
# ------------------------------------------------------------------------------------------

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*+)>""")
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^A-Za-z>][^>]*(?:>|\Z)|</>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_USEFUL = frozenset(("class", "id", "role", "hidden", "style", "itemprop", "aria-hidden", "href"))
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_COMMAS = re.compile("[,،、，]")  # Latin, Arabic, ideographic, full width

_END_BORDERS = {t: frozenset(("table", "html")) for t in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption")}
_END_BORDERS["table"] = frozenset(("html",))

CONTAINERS = frozenset("html body div section article main center td form fieldset details".split())
PARAGRAPHS = frozenset("p pre td th li dd dt blockquote div section article main body html center figcaption form".split())


class Node:
    __slots__ = ("tag", "parent", "inside", "noise", "main", "score", "chars", "linked", "links", "at")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.inside: list[Node | tuple[str, bool]] = []  # elements, and texts with whether they are links
        self.noise = self.main = False
        self.score = 0.0
        self.chars = self.linked = self.links = 0
        self.at = 0  # of headers: 1 if named as an article's; later: -1 inside of what is no article


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        name = m[1].lower()
        if name in _USEFUL:
            out.setdefault(name, m[2] or m[3] or m[4] or "")
    return out


def _words(names: str) -> set[str]:
    """The words in class names and ids; "has-sidebar" and "no-ads" say nothing about the element."""
    out: set[str] = set()
    for name in names.split():
        own = {w.lower() for w in _WORD.findall(name)}
        if not own & {"has", "no", "with", "without"}:
            out |= own
    return out


def _judge(node: Node, attributes: dict[str, str]) -> str:
    """Empty for what may be the article, "out" for what is not, "frame" for what is not unless it holds
    it, "header" for a frame whose headings may belong to an article."""
    tag = node.tag
    if tag in NOISE_TAGS:
        return "out"
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return "out"
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return "out"
    if tag in ("html", "body"):
        return ""
    named = _words(unescape(attributes.get("class", "") + " " + attributes.get("id", ""))) if attributes else set()
    role = attributes.get("role", "").lower()
    if tag in HEADINGS:
        named.discard("header")
    if named & NOISE_WORDS:
        return "out"
    if tag in ("article", "main") or role == "main" or attributes.get("itemprop", "").lower() == "articlebody":
        node.main = True
        return ""
    if tag == "header" or named & FRAME_WORDS == {"header"}:
        node.at = 1 if named & MAIN_WORDS else 0
        return "header"
    if tag == "form" or role in NOISE_ROLES or named & FRAME_WORDS:
        return "frame"
    if named & MAIN_WORDS:
        node.score = 10.0
    return ""


class Page:
    """The tree of one page, without what is no article."""

    def __init__(self, html: str):
        self.root = self.now = Node("html", None)
        self.nodes = [self.root]
        self.open: dict[str, int] = {"html": 1}
        self.link: Node | None = None  # the element in which an open link began
        self.frames: list[tuple[Node, bool]] = []  # with whether it is a header
        self._read(html)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            begin = html.find("<", at)
            if begin < 0:
                self._text(html[at:])
                return
            if begin > at:
                self._text(html[at:begin])
            m = _TAG.match(html, begin)
            if m:
                at = m.end()
                name = m[2].lower()
                if m[1]:
                    self._end(name)
                elif name in RAW:
                    self._start(name, m[3])
                    close = _RAW_END[name].search(html, at)
                    at = close.start() if close else n  # what is inside is dropped with its element
                else:
                    self._start(name, m[3])
                continue
            m = _COMMENT.match(html, begin)
            if m:
                at = m.end()
            elif re.match(r"</?[A-Za-z]", html[begin : begin + 3]):
                return  # the page ends inside a tag
            else:
                self._text("<")
                at = begin + 1

    def _text(self, text: str) -> None:
        if self.now.tag == "head" and not text.isspace():
            self._pop()  # a page without <body>
        self.now.inside.append((text, self.link is not None))

    def _start(self, tag: str, rest: str) -> None:
        if tag == "a":
            self.link = self.now if "href" in _attributes(rest) else None
            if self.link:
                self.now.links += 1
            return
        if tag in ("br", "wbr"):
            self._text(" " if tag == "br" else "")
            return
        if tag in ("html", "head", "body") and (tag == "html" or self.open.get("body")):
            return
        if tag in ENDS_P and self.open.get("p"):
            self._close({"p"}, BORDERS)
        if tag in BLOCK and self.open.get("head"):
            self._close({"head"}, BORDERS)
        if tag in HEADINGS and self.now.tag in HEADINGS:
            self._pop()
        if tag in IMPLIED:
            names, borders = IMPLIED[tag]
            self._close(names, borders, every=True)
        node = Node(tag, self.now)
        verdict = _judge(node, _attributes(rest) if rest else {})
        if verdict == "out":
            node.noise = True
        elif verdict:
            self.frames.append((node, verdict == "header"))
        self.now.inside.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.now = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def _pop(self) -> None:
        if self.link is self.now:
            self.link = None
        self.open[self.now.tag] -= 1
        self.now = self.now.parent

    def _close(self, names: set[str] | frozenset[str], borders: set[str] | frozenset[str], every: bool = False) -> None:
        """Close the nearest open element of these names that no border hides; with ``every`` all of them."""
        while any(self.open.get(x) for x in names):
            node = self.now
            while node.parent and node.tag not in names and node.tag not in borders:
                node = node.parent
            if node.tag not in names:
                return
            while self.now is not node:
                self._pop()
            self._pop()
            if not every:
                return

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.link = None
        elif tag == "br":
            self._text(" ")
        elif tag in HEADINGS:
            self._close(HEADINGS, BORDERS)
        elif tag in ("html", "body"):
            return  # what follows still belongs to the page
        elif self.open.get(tag):
            # inline elements close inside their block only, parts of a table inside the table
            self._close({tag}, _END_BORDERS.get(tag, BORDERS - {tag} if tag in BLOCK else BLOCK))


def _drop_frames(page: Page) -> None:
    """Frames hold no article; one that holds one is none."""
    holders: set[int] = set()
    for node in page.nodes:
        if node.main and not node.noise:
            up = node.parent
            while up and id(up) not in holders and not up.noise:
                holders.add(id(up))
                up = up.parent
    shut: set[int] = set()  # nodes inside an article
    for node in page.nodes:  # parents come first
        if node.parent and (node.parent.main or id(node.parent) in shut):
            shut.add(id(node))
    for node, header in page.frames:
        if id(node) in holders or node.tag == "form" and _holds_most(node):
            continue
        if not (header and (id(node) in shut or node.at) and _headings_only(node)):
            node.noise = True


def _headings_only(node: Node) -> bool:
    """Keep only the headings of an article's header; whether there are any."""
    found, todo = [], [node]
    while todo:
        x = todo.pop()
        for child in reversed(x.inside):
            if isinstance(child, Node) and not child.noise:
                if child.tag in HEADINGS:
                    found.append(child)
                else:
                    todo.append(child)
    node.inside = list(found)
    return bool(found)


def _holds_most(form: Node) -> bool:
    """Whether a form is the frame of the whole page: it holds paragraphs and a heading."""
    todo, p, heading = [form], 0, False
    while todo:
        for child in todo.pop().inside:
            if isinstance(child, Node) and not child.noise:
                p += child.tag == "p"
                heading |= child.tag in HEADINGS
                todo.append(child)
    return heading and p >= 2


def blocks_of(node: Node) -> Iterator[tuple[Node, str, int]]:
    """(element, text, characters that are links) of each block in page order, without noise."""
    held: list[tuple[str, bool]] = []
    owner = node

    def flush() -> Iterator[tuple[Node, str, int]]:
        if held:
            text = "".join([t for t, _ in held])
            linked = sum(len(t) for t, is_link in held if is_link and not t.isspace())
            held.clear()
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                yield owner, text, min(linked, len(text))

    stack = [(node, iter(node.inside))]
    while stack:
        top, rest = stack[-1]
        for child in rest:
            if isinstance(child, tuple):
                held.append(child)
            elif not child.noise:
                if child.tag in BLOCK:
                    yield from flush()
                    owner = child
                stack.append((child, iter(child.inside)))
                break
            elif child.tag in BLOCK:
                yield from flush()
        else:
            stack.pop()
            if top.tag in BLOCK:
                yield from flush()
                owner = stack[-1][0] if stack else node
                while owner.tag not in BLOCK and owner.parent:
                    owner = owner.parent


def _score(page: Page) -> None:
    """Points, characters and links of every element, from the leaves up."""
    for owner, text, linked in blocks_of(page.root):
        owner.chars += len(text)
        owner.linked += linked
        if owner.tag in PARAGRAPHS:
            points = (1 + len(_COMMAS.findall(text)) + len(text) / 100) * (1 - linked / len(text))
            around = owner
            while around.tag not in CONTAINERS or around is owner and owner.tag == "td":
                around = around.parent
            around.score += points
    for node in reversed(page.nodes):  # children come after their parents
        up = node.parent
        if up is None or node.noise:
            continue
        up.chars += node.chars
        up.linked += node.linked
        up.links += node.links
        if node.tag in CONTAINERS:
            while up.tag not in CONTAINERS:
                up = up.parent
            up.score += node.score / 2


def _share(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _is_menu(node: Node) -> bool:
    return node.tag not in ("p", "html", "body") and node.tag in BLOCK and node.links > 1 and _share(node) > 0.7


def _best(page: Page) -> Node:
    best, most = page.root, 0.0
    for node in page.nodes:
        if node.tag in CONTAINERS and node.at >= 0:
            score = (node.score + 20 * node.main) * (1 - _share(node)) if node.chars else 0.0
            if score > most:
                best, most = node, score
    up, whole = best, None
    while up:
        if up.tag == "article":
            whole = up
        up = up.parent
    return whole or best


def _mark_hidden(page: Page) -> None:
    for node in page.nodes:
        node.at = -1 if node.noise or node.parent and node.parent.at < 0 else 0


def _keeps(best: Node, other: Node) -> bool:
    """Whether a sibling of the best container belongs to it."""
    if other.noise or not other.chars or _is_menu(other) or _share(other) > 0.5:
        return False
    alone = best.tag == "article" and not best.parent.main  # what stands beside an article is rarely part of it
    if other.tag in CONTAINERS:
        return (not alone or other.tag == "article") and other.score >= 0.2 * best.score
    return not alone and other.tag in BLOCK and _share(other) < 0.25


def main_blocks(html: str | None) -> list[str]:
    """The blocks of a page's main text."""
    page = Page(html or "")
    _drop_frames(page)
    _mark_hidden(page)
    _score(page)
    best = _best(page)
    for node in page.nodes:
        if node is not best and not node.noise and _is_menu(node):
            node.noise = True
    if best.parent is None:
        kept = [best]
    else:
        kept = [x for x in best.parent.inside if isinstance(x, Node) and (x is best or _keeps(best, x))]
    return [text for node in kept for _, text, _ in blocks_of(node)]


def main_text(html: str | None) -> str:
    return "\n\n".join(main_blocks(html))


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each row as ``name``, in place of the page."""
    others = [f for f in pages.schema.fields if f.name not in (html_col, name)]
    schema = T.StructType([*others, T.StructField(name, T.StringType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(html_col)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in others], pa.array(texts, pa.string())],
                names=[*[f.name for f in others], name],
            )

    return pages.select(*[f.name for f in others], html_col).mapInArrow(compute, schema)
