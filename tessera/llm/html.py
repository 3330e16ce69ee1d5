"""Operator 9, main text of web pages by wrapper induction.

1. Every page is parsed once: its blocks of text, and the shape of its tree. A shape has one node for all list-like siblings
   of a label (paragraphs, items, headings) and for neighbours that match each other; ids and numbers in class names, which vary
   from page to page, are no part of a label.
2. The pages of a host come from the same generators. The shapes of all its pages are merged into one wrapper: trees are aligned
   by simple tree matching (the largest order-preserving mapping of children with equal labels, level by level), and what has no
   partner is inserted, so every layout of the host is in it.
3. Every page is aligned with its host's wrapper, and the texts of all pages are counted by node. A node is constant if at least
   ``RECURS`` of what it shows is also shown by other pages of the host (a menu may have several variants); a host of fewer than
   ``FEW`` pages has too little of its own to go by, and takes the same count over all hosts that have the node's path. A text
   that ``SHARE`` of the pages with its node show there is template, too. Pages that have the same main block count once, so
   copies of an article do not look like a template.
4. Constant nodes and texts are template, varying slots are content. Markup breaks ties: what it declares as something else
   (menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) is never main text though
   it varies, and inside a declared article only texts, not whole nodes, become template.

Defined results: null and empty html give the empty string; a page without host, or with one that has too few pages, is decided
by markup alone unless other hosts know its paths; if everything in the article is template, the article is kept; broken markup is
closed at the end of its parent; repeated rows get equal texts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, release_memory
from tessera.runtime import materialise, ship_package

#: A node is constant if so much of what it shows recurs; a text is template if so many of the node's pages show it.
RECURS, SHARE = 0.5, 0.8
#: Pages that must show a text before a node is constant by it, or the text template; pages below which other hosts are asked.
LEAST, FEW = 3, 100
#: Rows of alignments and templates that are sent to all tasks at most, and their characters; beyond that they are joined.
SMALL, SMALL_CHARS = 100_000, 16_000_000
#: Part of the larger of two neighbours that must match for them to be one node of a shape.
ALIKE = 0.75
#: Shapes and comparisons that a worker remembers.
MEMORY = 200_000
#: Buckets in which the shapes of one host are merged before the buckets are.
BUCKETS = 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FOREIGN = frozenset("svg math".split())
RAW = frozenset("script style noscript template iframe textarea select svg object canvas math audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that the start of another one closes, up to the nearest of BOUND.
CLOSED_BY = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BOUND = frozenset("html body article section div main aside nav ul ol dl table td th tr blockquote form header footer figure".split())
#: Tags, roles, and words in class or id that declare something other than main text.
ASIDE_TAGS = frozenset("head title nav footer aside form button input dialog menu".split()) | RAW
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog form menu menubar".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead banner ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist reply replies disqus toolbar "
    "pagination pager widget".split()
)
#: Elements whose content goes to the end of the page if they are not closed.
ENDLESS = frozenset("script style textarea".split())
#: Elements that come in lists: those of one label under one parent are one node of a shape.
LISTED = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption caption hr tbody thead tfoot ul ol dl".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag: quotes count only behind an equals sign. Possessive, so it is linear; it always matches.
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
SPACE = re.compile(r"\s+")
SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "mark", "children", "parent", "article", "outer")

    def __init__(self, tag: str, mark: str = "", parent: Node | None = None) -> None:
        self.tag, self.mark, self.parent = tag, mark, parent
        self.children: list[Node | str] = []
        #: Whether an article lies below, and (of an inline element) whether an element that is not inline does.
        self.article = self.outer = False

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.__class__ is Node]


def mark_of(attributes: str) -> str:
    """``role`` and the words of class and id, as one string; a word ``hidden=`` where the element is not shown."""
    if not attributes or not attributes.strip(" /"):
        return ""
    found = []
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c)
        if name in ("class", "id"):
            found += SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", unescape(value)).lower())
        elif name == "role":
            found.append("role=" + value.strip().lower())
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            found.append("hidden=")
    return " ".join(dict.fromkeys(x for x in found if x))


class Reader:
    """Cuts a page into texts and tags, in time that is linear in its length."""

    def __init__(self, html: str) -> None:
        self.html, self.pos = html, 0
        #: Until a tag's quotes have swallowed the rest of the page; from then on a tag ends at its first ``>``.
        self.quoted = True
        #: Tags whose end was looked for in vain.
        self.endless: set[str] = set()

    def next(self) -> tuple[str, str, str] | None:
        """("", "", text), or (name, attributes, "") of a start tag, or ("/" + name, "", ""); None at the end."""
        html = self.html
        while self.pos < len(html):
            at = html.find("<", self.pos)
            if at != self.pos:
                start, self.pos = self.pos, at if at >= 0 else len(html)
                return "", "", html[start : self.pos]
            c = html[at + 1 : at + 2]
            name = NAME.match(html, at + 1 + (c == "/"))
            if name is None:
                if not c or c not in "!?/":
                    self.pos = at + 1
                    return "", "", "<"
                end, width = (html.find("-->", at + 2), 3) if html.startswith("<!--", at) else (html.find(">", at), 1)
                self.pos = end + width if end >= 0 else len(html)
                continue
            end = REST.match(html, name.end()).end() if self.quoted else html.find(">", name.end())
            if end == len(html):
                self.quoted = False
                end = html.find(">", name.end())
            if end < 0:  # no tag ends any more
                self.pos = len(html)
                return "", "", html[at:]
            self.pos = end + 1
            return ("/" + name.group().lower(), "", "") if c == "/" else (name.group().lower(), html[name.end() : end], "")
        return None

    def skip(self, tag: str) -> None:
        """Goes behind the end tag of an element whose content is no text; without one, only scripts and styles go to the end."""
        if tag not in self.endless:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.html, self.pos)
            if end:
                self.pos = end.end()
                return
            self.endless.add(tag)
        if tag in ENDLESS:
            self.pos = len(self.html)


def parse(html: str) -> Node:
    """A tree of elements and texts; forgiving like browsers are, within reason."""
    root = here = Node("#root")
    reader = Reader(html)
    opened: dict[str, int] = {}  # how many elements of a tag are open: none is looked for in vain

    def up(to: Node) -> Node:
        node = here
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent
        return to

    while (found := reader.next()) is not None:
        tag, attributes, text = found
        if not tag:
            here.children.append(text)
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if opened.get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                here = up(node.parent)
            elif tag == "br":
                here.children.append(Node("br", "", here))
            continue
        closes = CLOSED_BY.get(tag, "p" if tag in ENDS_P else "").split()
        if closes and any([opened.get(x) for x in closes]):
            node = here
            while node.tag not in BOUND and node.tag not in closes and node.parent is not None:
                node = node.parent
            if node.tag in closes and node.parent is not None:
                here = up(node.parent)
        node = Node(tag, mark_of(attributes), here)
        here.children.append(node)
        above: Node | None = here
        if tag not in INLINE and tag not in RAW and tag != "br":
            while above is not None and above.tag in INLINE and not above.outer:
                above.outer = True
                above = above.parent
        if tag in ("article", "main"):
            above = here
            while above is not None and not above.article:
                above.article = True
                above = above.parent
        bare = attributes.rstrip().endswith("/")
        if tag in RAW:
            if not (tag in FOREIGN and bare):
                reader.skip(tag)
        elif tag not in VOID and not (bare and tag == "path"):
            here = node  # "<div/>" opens a div in HTML
            opened[tag] = opened.get(tag, 0) + 1
    return root


def declared_aside(node: Node, in_article: bool) -> bool:
    """Whether markup says that this element is not main text."""
    if node.tag in ASIDE_TAGS:
        return True
    if node.tag == "header" and not in_article:
        return not node.article
    if not node.mark or node.tag in ("html", "body", "main"):
        return False
    words = set(node.mark.split())
    if "hidden=" in words or any(w[5:] in ASIDE_ROLES for w in words if w.startswith("role=")):
        return True
    if words & ASIDE_WORDS or (words & {"header"} and not in_article):
        return not node.article
    return False


class Block:
    """Text of a block-level element up to the next block, and whether it lies in a declared article."""

    __slots__ = ("node", "text", "article")

    def __init__(self, node: Node, text: str, article: bool) -> None:
        self.node, self.text, self.article = node, text, article


def blocks(root: Node) -> list[Block]:
    """Blocks in page order that markup does not declare as something else."""
    out: list[Block] = []
    buffer: list[str] = []

    def flush(owner: Node, article: Node | None) -> None:
        text = SPACE.sub(" ", unescape("".join(buffer))).strip()
        buffer.clear()
        if text:
            out.append(Block(owner, text, article is not None))

    # an explicit stack: pages may nest deeper than Python's calls may
    stack: list[tuple[Node, Node, Node | None, int]] = [(root, root, None, 0)]
    while stack:
        node, owner, article, at = stack.pop()
        children = node.children
        while at < len(children):
            c = children[at]
            at += 1
            if c.__class__ is str:
                buffer.append(c)
                continue
            if c.tag == "br":
                buffer.append(" ")
                continue
            if declared_aside(c, article is not None):
                if c.tag not in INLINE and c.tag not in RAW:
                    flush(owner, article)
                continue
            inside = c if c.tag in ("article", "main") and article is None else article
            stack.append((node, owner, article, at))
            if c.tag in INLINE and not c.outer:
                stack.append((c, owner, article, 0))
            else:
                flush(owner, article)
                stack.append((c, c, inside, 0))
            break
        else:
            if node is owner:
                flush(owner, article)
                if node.tag in ("td", "th"):
                    buffer.append(" ")
    return out


def main_text(root: Node) -> str:
    """What markup alone says: the blocks of all articles, or of the whole page where there is none."""
    found = blocks(root)
    return " ".join([b.text for b in found if b.article] or [b.text for b in found])


# --- shapes and simple tree matching --------------------------------------------------------------------------------


class Shape:
    """A node of a shape. ``listed`` holds list-like children by label, ``parts`` the others in order; equal shapes have equal keys."""

    __slots__ = ("label", "listed", "parts", "key", "into")

    def __init__(self, label: str) -> None:
        self.label = label
        self.listed: dict[str, Shape] = {}
        self.parts: list[Shape] = []
        self.key = -1
        self.into: Shape | None = None  # the node that this one was merged into

    def children(self) -> list[Shape]:
        return [*map(self.listed.__getitem__, sorted(self.listed)), *self.parts]


def label(node: Node) -> str:
    """Tag, role and those words of class and id that hold no digit (others vary from page to page)."""
    words = [w for w in node.mark.split() if w.isalpha() or w.startswith("role=")] if node.mark else []
    return f"{node.tag}.{'.'.join(words)}" if words else node.tag


class Matcher:
    """Keys, simple tree matching, and merging of shapes. What it remembers is bounded by its owner (``full``)."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.count: list[int] = []
        self.sizes: dict[tuple[int, int], int] = {}
        # trees may be deeper than Python's default limit; these calls take no room on the C stack
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000_000))

    def full(self) -> bool:
        return len(self.known) + len(self.sizes) > MEMORY

    def close(self, x: Shape) -> Shape:
        """Gives a node whose children have keys its own."""
        what = (x.label, tuple([x.listed[k].key for k in sorted(x.listed)]), tuple([c.key for c in x.parts]))
        if what not in self.known:
            self.known[what] = len(self.count)
            self.count.append(1 + sum([self.count[k] for k in what[1]]) + sum([self.count[k] for k in what[2]]))
        x.key = self.known[what]
        return x

    def size(self, a: Shape, b: Shape) -> int:
        """Nodes in the largest order-preserving mapping of two shapes; 0 if their labels differ."""
        if a.label != b.label:
            return 0
        if a.key == b.key:
            return self.count[a.key]
        key = (a.key, b.key)
        if key not in self.sizes:
            total = 1
            for k, x in a.listed.items():
                if k in b.listed:
                    total += self.size(x, b.listed[k])
            for i, j in self.pairs(a.parts, b.parts):
                total += self.size(a.parts[i], b.parts[j])
            self.sizes[key] = total
        return self.sizes[key]

    def pairs(self, a: list[Shape], b: list[Shape]) -> list[tuple[int, int]]:
        """The best order-preserving mapping of two lists of shapes, as pairs of places."""
        head, tail = 0, 0
        while head < min(len(a), len(b)) and a[head].key == b[head].key:
            head += 1
        while tail < min(len(a), len(b)) - head and a[-1 - tail].key == b[-1 - tail].key:
            tail += 1
        found = [(i, i) for i in range(head)]
        x, y = a[head : len(a) - tail], b[head : len(b) - tail]
        if x and y:
            best = np.zeros((len(x) + 1, len(y) + 1), np.int64)
            own = np.zeros((len(x), len(y)), np.int64)
            for i, p in enumerate(x):
                for j, q in enumerate(y):
                    if p.label == q.label:
                        own[i, j] = self.size(p, q)
                take = np.where(own[i] > 0, best[i, :-1] + own[i], 0)
                best[i + 1, 1:] = np.maximum.accumulate(np.maximum(take, best[i, 1:]))
            back, i, j = [], len(x), len(y)
            while i and j:
                if best[i, j] == best[i - 1, j]:
                    i -= 1
                elif best[i, j] == best[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    back.append((head + i, head + j))
            found += back[::-1]
        return found + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]

    def merge(self, a: Shape, b: Shape) -> Shape:
        """``a`` with all of ``b``, whose nodes point to those that they became; what has no partner is inserted."""
        b.into = a
        if a.key == b.key:
            for x, y in zip(a.children(), b.children(), strict=True):
                self.merge(x, y)
            return a
        for k in sorted(b.listed):
            if k in a.listed:
                self.merge(a.listed[k], b.listed[k])
            else:
                a.listed[k] = b.listed[k]
        if b.parts:
            parts, i = [], 0
            partner = {j: i for i, j in self.pairs(a.parts, b.parts)}
            for j, y in enumerate(b.parts):
                if j in partner:
                    parts += a.parts[i : partner[j]]
                    i = partner[j] + 1
                    parts.append(self.merge(a.parts[i - 1], y))
                else:
                    parts.append(y)
            a.parts = parts + a.parts[i:]
        return self.close(a)

    def gather(self, x: Shape, children: list[Shape]) -> Shape:
        """Gives a new node its children: one for each list-like label, and one for neighbours that are alike."""
        for c in children:
            if c.label.partition(".")[0] in LISTED:
                if c.label in x.listed:
                    self.merge(x.listed[c.label], c)
                else:
                    x.listed[c.label] = c
            elif x.parts and x.parts[-1].label == c.label and self.alike(x.parts[-1], c):
                self.merge(x.parts[-1], c)
            else:
                x.parts.append(c)
        return self.close(x)

    def alike(self, a: Shape, b: Shape) -> bool:
        return a.key == b.key or self.size(a, b) >= ALIKE * max(self.count[a.key], self.count[b.key])

    def shape(self, root: Node) -> tuple[Shape, dict[int, Shape]]:
        """The shape of a page, and the shape node of each element that is not inline."""
        order, stack = [], [root]
        while stack:
            x = stack.pop()
            order.append(x)
            stack += [c for c in x.elements() if c.tag not in RAW and c.tag != "br" and (c.tag not in INLINE or c.outer)]
        made: dict[int, Shape] = {}
        inside: dict[int, list[Shape]] = {}
        for x in reversed(order):
            children: list[Shape] = []
            for c in x.elements():
                if id(c) in made:
                    children.append(made[id(c)])
                elif id(c) in inside:
                    children += inside[id(c)]
            if x.tag in INLINE:
                inside[id(x)] = children
            else:
                made[id(x)] = self.gather(Shape(label(x)), children)
        return made[id(root)], made

    def places(self, page: Shape, wrapper: Shape) -> list[int]:
        """For each node of a page's shape in pre-order, the number of the wrapper's node it is aligned with, or -1."""
        number = {id(x): k for k, x in enumerate(preorder(wrapper))}
        partner = {id(page): wrapper}
        for x in preorder(page):
            w = partner.get(id(x))
            if w is not None:
                partner.update({id(c): w.listed[k] for k, c in x.listed.items() if k in w.listed})
                partner.update({id(x.parts[i]): w.parts[j] for i, j in self.pairs(x.parts, w.parts)})
        return [number[id(partner[id(x)])] if id(x) in partner else -1 for x in preorder(page)]


def preorder(shape: Shape) -> list[Shape]:
    out, stack = [], [shape]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += x.children()[::-1]
    return out


def written(shape: Shape) -> str:
    """A shape as lines of depth and label, in pre-order."""
    out, stack = [], [(shape, 0)]
    while stack:
        x, depth = stack.pop()
        out.append(f"{depth} {x.label}")
        stack += [(c, depth + 1) for c in x.children()[::-1]]
    return "\n".join(out)


def read(text: str, matcher: Matcher) -> Shape:
    path: list[Shape] = []
    order = []
    for line in text.split("\n"):
        depth, _, name = line.partition(" ")
        x, d = Shape(name), int(depth)
        if d:
            if name.partition(".")[0] in LISTED:
                path[d - 1].listed[name] = x
            else:
                path[d - 1].parts.append(x)
        path[d:] = [x]
        order.append(x)
    for x in reversed(order):
        matcher.close(x)
    return order[0]


def paths(wrapper: Shape) -> list[int]:
    """A hash of the path of each node in pre-order: its labels, and its place among parts of the same label."""
    own = {id(wrapper): b""}
    out = []
    for x in preorder(wrapper):
        here = own[id(x)]
        out.append(xxhash.xxh64_intdigest(here) - 2**63)
        seen: dict[str, int] = {}
        digest = hashlib.blake2b(here, digest_size=16).digest()
        for c in x.children():
            k = seen[c.label] = seen.get(c.label, -1) + 1
            own[id(c)] = digest + f"{k} {c.label}".encode("utf-8", "surrogatepass")
    return out


# --- over tables ----------------------------------------------------------------------------------------------------

PARSED = "page_id long, url string, host string, shape string, main long, nodes array<int>, articles array<boolean>, texts array<string>"


def lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    return pa.array(rows, pa.list_(kind))


def parsed(pages: DataFrame) -> DataFrame:
    """Each page's shape and blocks: the node of the shape that a block belongs to, whether it is in an article, its text.

    ``main`` is a hash of the longest block (of the articles, if there are any): pages that share it are copies.
    """

    def run(batches):
        matcher = Matcher()
        for rest, sources in chunks(batches, "html"):
            made = []
            for html in sources:
                if matcher.full():
                    matcher = Matcher()
                root = parse(html)
                found = blocks(root)
                shape, of = matcher.shape(root)
                number = {id(x): k for k, x in enumerate(preorder(shape))}

                def node(element: Node) -> int:
                    while id(element) not in of:  # inline elements belong to the one around them
                        element = element.parent
                    x = of[id(element)]
                    while x.into is not None:
                        x = x.into
                    return number[id(x)]

                region = [b.text for b in found if b.article] or [b.text for b in found]
                longest = max(region, key=lambda t: (len(t), t), default="")
                made.append((written(shape), xxhash.xxh64_intdigest(longest.encode("utf-8", "surrogatepass")) - 2**63, [node(b.node) for b in found], [b.article for b in found], [b.text for b in found]))
            shape_, main, nodes, articles, texts = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rest["page_id"], pa.int64()), pa.array(rest["url"], pa.string()), pa.array(rest["host"], pa.string()), pa.array(shape_, pa.string()), pa.array(main, pa.int64()), lists(nodes, pa.int32()), lists(articles, pa.bool_()), lists(texts, pa.string())],
                ["page_id", "url", "host", "shape", "main", "nodes", "articles", "texts"],
            )

    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return own.mapInArrow(run, PARSED)


def merged(shapes: DataFrame, by: list[str]) -> DataFrame:
    """(by, shape): the shapes of each group merged into one, in their order, so that the result depends on nothing else.

    Rows are merged as they come: a task holds one wrapper, whatever the size of the group.
    """

    def run(batches):
        key, wrapper, matcher = None, None, Matcher()

        def close():
            return pa.RecordBatch.from_arrays([*(pa.array([k]) for k in key), pa.array([written(wrapper)])], [*by, "shape"])

        for batch in batches:
            for *now, text in zip(*(batch.column(j).to_pylist() for j in range(len(by) + 1)), strict=True):
                if now != key:
                    if key is not None:
                        yield close()
                    key, matcher = now, Matcher()
                    wrapper = read(text, matcher)
                    continue
                if matcher.full():
                    again = written(wrapper)
                    matcher = Matcher()
                    wrapper = read(again, matcher)
                matcher.merge(wrapper, read(text, matcher))
        if key is not None:
            yield close()
        release_memory()

    kinds = dict(shapes.dtypes)
    return shapes.select(*by, "shape").repartition(*by).sortWithinPartitions(*by, "shape").mapInArrow(run, ", ".join([*(f"{b} {kinds[b]}" for b in by), "shape string"]))


def aligned(shapes: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, shape, places, paths: for each node of each shape, its node of the host's wrapper (-1: none) and that node's path."""

    def run(batches):
        last, matcher, wrapper, path = None, Matcher(), None, []
        for batch in batches:
            rows = list(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True))
            out = []
            for _, shape, text in rows:
                if text != last or matcher.full():
                    matcher = Matcher()
                    last, wrapper = text, read(text, matcher)
                    path = paths(wrapper)
                place = matcher.places(read(shape, matcher), wrapper)
                out.append((place, [path[k] if k >= 0 else None for k in place]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists([p for p, _ in out], pa.int32()), lists([q for _, q in out], pa.int64())], ["host", "shape", "places", "paths"])
        release_memory()

    both = shapes.join(wrappers.withColumnRenamed("shape", "wrapper"), "host").select("host", "shape", "wrapper")
    return both.mapInArrow(run, "host string, shape string, places array<int>, paths array<long>")


def beside(left: DataFrame, right: DataFrame, on: list[str], size, small: int) -> DataFrame:
    """A left join; the right side goes to all tasks only up to a measured number of rows and of characters."""
    n, chars = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return left.join(F.broadcast(right) if n <= small and chars <= SMALL_CHARS else right, on, "left")


def induce(pages: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(host, shape, places, paths) and (host, constant nodes, constant texts) of parsed pages."""
    shapes = materialise(pages.where("host != '' and size(texts) > 0").select("host", "shape").distinct(), "page-shapes")
    # a host may hold a third of all pages: its shapes are merged in buckets first
    bucket = F.pmod(F.xxhash64("shape"), F.lit(BUCKETS)).cast("long").alias("bucket")
    wrappers = merged(merged(shapes.select("host", "shape", bucket), ["host", "bucket"]), ["host"])
    places = materialise(aligned(shapes, materialise(wrappers, "wrappers")), "alignments")

    # what each node shows: once for pages that are copies; a null text stands for the page itself
    own = beside(pages.where("host != '' and size(texts) > 0"), places, ["host", "shape"], F.length("shape") + 12 * F.size("places"), small).where("places is not null")
    shown = "transform(arrays_zip(nodes, texts), x -> struct(places[x.nodes] as node, paths[x.nodes] as path, xxhash64(x.texts) as h))"
    itself = "transform(array_distinct(nodes), x -> struct(places[x] as node, paths[x] as path, cast(null as long) as h))"
    rows = own.select("host", "main", F.explode(F.expr(f"array_distinct(concat({shown}, {itself}))")).alias("x")).select("host", "main", "x.*").where("node >= 0").distinct()
    rows = materialise(rows, "shown-texts")
    counts = materialise(rows.groupBy("host", "node", "path", "h").agg(F.count(F.lit(1)).alias("c")), "template-counts")

    def recurring(of: DataFrame, by: list[str], suffix: str) -> DataFrame:
        """Of what a node shows, how much there is, how much of it recurs, and the most pages of one text."""
        return of.where("h is not null").groupBy(*by).agg(F.sum("c").alias(f"n{suffix}"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias(f"again{suffix}"), F.max("c").alias(f"most{suffix}"))

    everywhere = rows.where("h is not null").select("path", "h", "main").distinct().groupBy("path", "h").agg(F.count(F.lit(1)).alias("c"))
    held = counts.where("h is null").select("host", "node", F.col("c").alias("pages"))
    nodes = recurring(counts, ["host", "node", "path"], "").join(held, ["host", "node"]).join(recurring(everywhere, ["path"], "_all"), "path")
    constant = nodes.where((F.col("most") >= LEAST) & (F.col("again") >= RECURS * F.col("n")) | (F.col("pages") < FEW) & (F.col("most_all") >= LEAST) & (F.col("again_all") >= RECURS * F.col("n_all")))
    constant = constant.groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("constant"))  # nodes of one wrapper
    texts = counts.where("h is not null").join(held, ["host", "node"]).where((F.col("c") >= LEAST + 1) & (F.col("c") >= SHARE * F.col("pages")))
    # each is on most pages that have its node, so there are not many more of them than blocks on a page
    texts = texts.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "h"))).alias("fixed"))
    return places, materialise(constant.join(texts, "host", "full"), "templates")


def extract(pages: DataFrame, small: int = SMALL) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship_package(pages.sparkSession)
    found = materialise(parsed(pages), "parsed-pages")
    places, templates = induce(found, small)
    own = beside(found, places.select("host", "shape", "places"), ["host", "shape"], F.length("shape") + 4 * F.size("places"), small)
    own = beside(own, templates, ["host"], 4 * F.coalesce(F.size("constant"), F.lit(0)) + 12 * F.coalesce(F.size("fixed"), F.lit(0)), small)
    article = "exists(articles, x -> x)"
    region = f"if({article}, filter(arrays_zip(nodes, articles, texts), x -> x.articles), arrays_zip(nodes, articles, texts))"
    template = "(not x.articles and coalesce(array_contains(constant, places[x.nodes]), false)) or coalesce(array_contains(fixed, struct(places[x.nodes] as node, xxhash64(x.texts) as h)), false)"
    own = own.withColumn("region", F.expr(region))
    own = own.withColumn("slots", F.expr(f"if(places is null, region, filter(region, x -> not ({template})))"))
    text = F.array_join(F.expr("transform(if(size(slots) > 0, slots, region), x -> x.texts)"), " ")
    return own.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
