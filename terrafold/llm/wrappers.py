"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a stream of block tags and text slots. Neighbours of one kind fold into a repeated group, and so does a sequence
of up to ``PERIOD`` kinds that follows itself. Pages of a host whose streams are then equal are counted together; the different streams
are aligned one after another: tags that only one side has become optional, repetitions join their group, texts that differ
turn a constant into a slot. That is done first in ``BLOCKS`` blocks of a host's streams (by their hash, so a host of any size
is divided) and then for the blocks' wrappers; both orders depend on the streams alone, so reruns agree.

The wrapper decides for its slots, with what all pages of the host showed: slots under menus, headers, footers, sidebars, notices,
adverts, forms, scripts, comments (by tag, role, class or id) go; so do lists of links and constants, texts that are equal on
every one of ``TEMPLATE`` pages or more beside texts that vary. Of the rest, a page gives the slots of its best region: article,
``main``, what is named as content, the part that holds most of the host's text, or else all of it.

Null and empty pages have an empty text; nothing is cut; repeated rows get a result each; null or odd addresses form a host of their
own; an empty table gives an empty one; other columns are not read. Markup deeper than ``DEPTH`` loses its structure, not its text.
"""

from __future__ import annotations

import html
import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, keep

BLOCKS, PERIOD, TEMPLATE, DEPTH = 64, 6, 5, 64
#: Alignments beyond this many pairs of siblings look ahead by ``WINDOW`` places only.
PAIRS, WINDOW = 1 << 18, 64
#: A host with more than a ``HOT_SHARE``-th of all pages (so there are fewer of them) meets its wrapper in parts of ``HOT_PAGES``.
HOT_SHARE, HOT_PAGES = 1024, 8192

# Names of HTML elements, roles and usual class names.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
BLOCK = {"address", "article", "aside", "blockquote", "button", "canvas", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
         "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "legend", "li", "main", "menu", "nav", "noscript", "object", "ol", "optgroup", "option", "p", "pre", "search", "section", "select",
         "summary", "svg", "table", "tbody", "td", "template", "tfoot", "th", "thead", "tr", "ul"}
BREAK = {"br", "hr", "wbr", "img", "input"}
DROP_TAGS = {"aside", "button", "canvas", "dialog", "fieldset", "footer", "form", "header", "menu", "nav", "noscript", "object", "optgroup", "option", "search", "select", "svg", "template"}
DROP_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}
DROP_WORDS = {"ad", "ads", "adsense", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "copyright", "footer", "gdpr", "header", "login",
              "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related",
              "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets"}
COMMENT_WORDS = {"comment", "commentlist", "comments", "discussion", "disqus", "replies", "reply", "respond"}
CONTENT_WORDS = {"article", "articlebody", "content", "entry", "main", "post", "story"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Neighbours of these kinds fold only if they are built alike, unless they carry a class.
LAYOUT = {"div", "section", "table", "td"}
CONTAINERS = {"center", "div", "section", "table", "tbody", "td", "tr"}
#: An open element ends when one of these begins inside the given bounds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
        "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
        "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"})}

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z]+")


class Node:
    """A tag with its parts, a repeated group (``()``) or a text slot (``#``); slots count what was seen."""

    __slots__ = ("label", "kids", "optional", "repeated", "pages", "n", "chars", "linked", "low", "high", "at", "level")

    def __init__(self, label: str):
        self.label, self.kids, self.optional, self.repeated = label, [], False, False
        self.pages = self.n = self.chars = self.linked = self.low = self.high = self.level = 0
        self.at = ()  # numbers of the texts of one page

    def slots(self):
        todo = [self]
        while todo:
            x = todo.pop()
            if x.label == "#":
                yield x
            todo += reversed(x.kids)


def _label(tag: str, attributes: str) -> str:
    """The tag with its class, id and role; numbers in names are alike."""
    if not attributes or attributes.isspace():
        return tag
    words = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id", "itemprop"):
            words |= {re.sub(r"\d+", "0", re.sub(r"[^a-z0-9_-]", "", w)) for w in value.split()}
        elif name == "role":
            words.add("@" + re.sub(r"[^a-z]", "", value))
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            words.add("@hidden")
    return ".".join([tag, *sorted(w for w in words if w)])


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree of block tags and slots, and the slots' texts."""
    root, texts = Node(""), []
    stack, tags = [root], [""]
    deeper: list[str] = []  # open blocks below the deepest level kept
    run: list[str] = []
    linked, links = 0, 0

    def flush():
        nonlocal run, linked
        text = " ".join("".join(run).split())
        if text:
            slot = Node("#")
            slot.at, slot.pages, slot.n, slot.chars, slot.linked = (len(texts),), 1, 1, len(text), min(linked, len(text))
            texts.append(text)
            stack[-1].kids.append(slot)
        run, linked = [], 0

    def leave(to: int):
        flush()
        del stack[to:], tags[to:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        piece = page[at:m.start() if m else end]
        if piece:
            piece = html.unescape(piece)
            run.append(piece)
            if links > 0:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not m[1]:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = close.end() if close else end
        elif tag == "a":
            links = max(0, links + (-1 if m[1] else 1)) if m[1] or links == 0 else links
        elif tag in BREAK:
            run.append(" ")
        elif tag not in BLOCK:
            continue
        elif m[1]:
            if tag in deeper:
                flush()
                del deeper[len(deeper) - 1 - deeper[::-1].index(tag):]
            elif tag in tags:
                deeper.clear()
                links = 0
                leave(len(tags) - 1 - tags[::-1].index(tag))
            elif tag == "p":
                flush()
        else:
            flush()
            if "p" in tags and tag not in ("button", "object", "svg", "canvas", "noscript", "template"):
                deeper.clear()
                leave(len(tags) - 1 - tags[::-1].index("p"))
            if tag in ENDS:
                ended, bounds = ENDS[tag]
                i = len(tags) - 1
                outer = None
                while i > 0 and tags[i] not in bounds:
                    if tags[i] in ended:
                        outer = i
                    i -= 1
                if outer is not None:
                    leave(outer)
            if len(stack) > DEPTH:
                deeper.append(tag)
                continue
            node = Node(_label(tag, m[3].rstrip("/")))
            stack[-1].kids.append(node)
            stack.append(node)
            tags.append(tag)
    flush()
    return root, texts


def _alike(a: Node, b: Node) -> bool:
    if a.label != b.label:
        return False
    return a.label not in LAYOUT or shape(a) == shape(b)


def _joined(a: Node, b: Node, page: bool) -> Node:
    """Both parts as one, of one ``page`` (a repetition) or of several."""
    out = Node(a.label)
    out.optional, out.repeated = a.optional or b.optional, a.repeated or b.repeated
    if a.label == "#":
        out.pages = max(a.pages, b.pages) if page else a.pages + b.pages
        out.n, out.chars, out.linked, out.at = a.n + b.n, a.chars + b.chars, a.linked + b.linked, a.at + b.at
        out.low, out.high = min(a.low, b.low), max(a.high, b.high)
    else:
        out.kids = fold(align(a.kids, b.kids, page), page)
    return out


def _matches(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Places of the parts of ``a`` and ``b`` that are the same part, in order."""
    x, y = [k.label for k in a], [k.label for k in b]
    if x == y:
        return [(i, i) for i in range(len(x))]
    if len(x) * len(y) <= PAIRS:
        return [(i + d, j + d) for i, j, n in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() for d in range(n)]
    out, j = [], 0
    for i, label in enumerate(x):
        try:
            at = y.index(label, j, j + WINDOW)
        except ValueError:
            continue
        out.append((i, at))
        j = at + 1
    return out


def align(a: list[Node], b: list[Node], page: bool = False) -> list[Node]:
    """One sequence for both: what only one of them has becomes optional."""
    out: list[Node] = []
    i = j = 0
    for p, q in [*_matches(a, b), (len(a), len(b))]:
        for k in (*a[i:p], *b[j:q]):
            k.optional = True
            out.append(k)
        if p < len(a):
            out.append(_joined(a[p], b[q], page))
        i, j = p + 1, q + 1
    return out


def fold(kids: list[Node], page: bool) -> list[Node]:
    """Repetitions become groups: neighbours that are alike, then sequences of two kinds and more."""
    out: list[Node] = []
    for k in kids:
        if out and k.label != "#" and _alike(out[-1], k):
            out[-1] = _joined(out[-1], k, page)
            out[-1].repeated = True
        else:
            out.append(k)
    for period in range(2, PERIOD + 1):
        if len(out) < period + 1:
            break
        made: list[Node] = []
        i = 0
        while i < len(out):
            labels = [k.label for k in out[i:i + period]]
            group = made[-1] if made and made[-1].label == "()" and len(made[-1].kids) == period else None
            if group and labels == [k.label for k in group.kids]:
                group.kids = [_joined(x, y, page) for x, y in zip(group.kids, out[i:i + period])]
                group.repeated = True
                i += period
            elif not group and len(labels) == period and "()" not in labels and labels == [k.label for k in out[i + period:i + 2 * period]]:
                group = Node("()")
                group.kids, group.repeated = [_joined(x, y, page) for x, y in zip(out[i:i + period], out[i + period:i + 2 * period])], True
                made.append(group)
                i += 2 * period
            else:
                made.append(out[i])
                i += 1
        out = made
    return out


def folded(node: Node) -> Node:
    """The tree of a page with its repetitions folded; empty parts go."""
    kids = [k for k in (folded(x) if x.label != "#" else x for x in node.kids) if k.kids or k.label == "#"]
    node.kids = fold(kids, True)
    return node


def shape(node: Node) -> str:
    """The expression, one token per tag, slot or end; ``?`` is optional, ``+`` repeated."""
    out: list[str] = []

    def write(x: Node):
        marks = ("?" if x.optional else "") + ("+" if x.repeated else "")
        if x.label == "#":
            out.append("#" + marks)
            return
        out.append(x.label + "<")
        for k in x.kids:
            write(k)
        out.append(">" + marks)

    write(node)
    return " ".join(out)


def read(expression: str) -> Node:
    root = Node("^")
    stack = [root]
    for token in expression.split(" "):
        if token.endswith("<"):
            stack[-1].kids.append(Node(token[:-1]))
            stack.append(stack[-1].kids[-1])
            continue
        if token[0] == "#":
            node = Node("#")
            stack[-1].kids.append(node)
        else:
            node = stack.pop()
        node.optional, node.repeated = "?" in token, "+" in token
    return root.kids[0]


STATS = ("pages", "n", "chars", "linked", "low", "high")


def _stats(node: Node) -> np.ndarray:
    return np.array([[getattr(s, c) for c in STATS] for s in node.slots()], np.int64).reshape(-1, len(STATS))


def _with_stats(expression: str, stats: np.ndarray) -> Node:
    root = read(expression)
    for slot, row in zip(root.slots(), stats.tolist()):
        for c, v in zip(STATS, row):
            setattr(slot, c, v)
    return root


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a + b
    out[:, 4], out[:, 5] = np.minimum(a[:, 4], b[:, 4]), np.maximum(a[:, 5], b[:, 5])
    return out


def page_wrapper(page: str) -> tuple[Node, list[str]]:
    """The wrapper of one page; a slot's constant is the hash of all it holds on the page."""
    root, texts = parse(page)
    root = folded(root)
    for slot in root.slots():
        slot.low = slot.high = xxhash.xxh3_64_intdigest("\n".join(texts[i] for i in slot.at).encode("utf-8", "surrogatepass")) >> 1
    return root, texts


def _named(label: str) -> tuple[str, set[str], set[str]]:
    """Tag, roles and the words of class and id."""
    tag, *names = label.split(".")
    return tag, {n[1:] for n in names if n[0] == "@"}, {w for n in names if n[0] != "@" for w in _PART.findall(n)}


def _share(node: Node) -> int:
    return sum(s.chars for s in node.slots() if s.level >= 0)


def decide(root: Node) -> None:
    """The level of each slot: -1 goes; the rest tells the region, from article (1) to anything (5)."""
    holds: dict[int, bool] = {}

    def main_below(x: Node) -> bool:
        tag, roles, words = _named(x.label)
        found = [main_below(k) for k in x.kids]
        holds[id(x)] = any(found) or ((tag in ("article", "main") or "main" in roles) and not words & COMMENT_WORDS)
        return holds[id(x)]

    def walk(x: Node, level: int, inside: bool, heading: bool, only: bool):
        tag, roles, words = _named(x.label)
        if x.label == "#":
            x.level = -1 if only and not heading else level
            return
        if tag and tag != "()":
            main = tag in ("article", "main") or "main" in roles
            if words & COMMENT_WORDS or "hidden" in roles or roles & DROP_ROLES:
                level = -1
            elif tag == "header" and inside:
                only = True  # of an article's own header its headings stay
            elif (tag in DROP_TAGS or (words & DROP_WORDS and not main)) and not holds[id(x)]:
                level = -1
            if level > 0:
                rank = 1 if tag == "article" or "articlebody" in words else 2 if main else 3 if words & CONTENT_WORDS and tag not in HEADINGS else 5
                level = min(level, rank)
                inside = inside or level < 3
            heading = heading or tag in HEADINGS
        for k in x.kids:
            walk(k, level, inside, heading, only)

    main_below(root)
    walk(root, 5, False, False, False)

    # The part with most of the text, where no name tells.
    at = root
    while True:
        total = _share(at)
        into = [k for k in at.kids if k.label.split(".")[0] in CONTAINERS and not k.repeated and total and 10 * _share(k) > 6 * total]
        if not into:
            break
        at = into[0]
    for s in at.slots():
        s.level = 4 if s.level == 5 else s.level

    varies = {s.level for s in root.slots() if s.low != s.high}

    def prune(x: Node, tag: str):
        for k in x.kids:
            name = k.label.split(".")[0]
            if k.label != "#":
                prune(k, tag if name == "()" else name)
            elif k.level > 0 and tag != "h1":
                constant = k.pages >= TEMPLATE and k.low == k.high and k.level in varies
                menu = tag not in HEADINGS and tag != "p" and k.n >= 3 * k.pages and 10 * k.linked > 8 * k.chars and k.chars < 60 * k.n
                if constant or menu:
                    k.level = -1

    prune(root, "")


def plan(root: Node) -> str:
    """The wrapper with the levels of its slots."""
    decide(root)
    levels = iter([s.level for s in root.slots()])
    return " ".join(f"{t}:{next(levels)}" if t[0] == "#" else t for t in shape(root).split(" "))


def read_plan(text: str) -> Node:
    tokens = text.split(" ")
    root = read(" ".join(t.split(":")[0] if t[0] == "#" else t for t in tokens))
    for slot, level in zip(root.slots(), [int(t.split(":")[1]) for t in tokens if t[0] == "#"]):
        slot.level = level
    return root


def _assign(page: list[Node], wrapper: list[Node]) -> None:
    """Give the slots of a page the level of the wrapper's slot that they match; what matches nothing keeps its own."""
    for i, j in _matches(page, wrapper):
        a, b = page[i], wrapper[j]
        if a.label == "#":
            a.level = b.level
        else:
            _assign(a.kids, b.kids)
    matched = {i for i, _ in _matches(page, wrapper)}
    for i, a in enumerate(page):
        if i in matched:
            continue
        # A part that the wrapper folded into a group, or a group that it opened.
        parts = a.kids if a.label == "()" else [a]
        for p in parts:
            for w in (k for g in wrapper for k in (g.kids if g.label == "()" else [g])):
                if w.label == p.label:
                    if p.label == "#":
                        p.level = w.level
                    else:
                        _assign(p.kids, w.kids)
                    break


def extract(page: str, wrapper: Node | None, known: dict[str, list[int]]) -> str:
    """The text of ``page`` under its host's wrapper; ``known`` holds the levels of streams met before."""
    root, texts = page_wrapper(page)
    key = shape(root)
    levels = known.get(key)
    if levels is None:
        decide(root)
        if wrapper is not None:
            _assign(root.kids, wrapper.kids)
        levels = known[key] = [s.level for s in root.slots()]
    best = min((v for v in levels if v > 0), default=0)
    kept = sorted(i for s, v in zip(root.slots(), levels) if v == best and best for i in s.at)
    return "\n".join(texts[i] for i in kept)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _streams(pages: DataFrame) -> DataFrame:
    """``host, shape, stats``: different streams of each batch, with the counts of their slots."""

    def run(batches):
        for b in batches:
            found: dict[tuple[str, str], np.ndarray] = {}
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                root, _ = page_wrapper(page or "")
                key, stats = (h, shape(root)), _stats(root)
                found[key] = _plus(found[key], stats) if key in found else stats
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array([v.ravel() for v in found.values()], pa.list_(pa.int64()))], names=["host", "shape", "stats"])

    return in_batches(pages.select("host", "html")).mapInArrow(run, "host string, shape string, stats array<long>")


def _aligned(streams: DataFrame, last: bool) -> DataFrame:
    """One row per host and block (of all blocks, if ``last``): streams in the order of their shapes, equal ones counted together, aligned one by one."""
    keys = ["host"] if last else ["host", "block"]
    dealt = streams.withColumn("block", F.pmod(F.xxhash64("shape"), F.lit(BLOCKS)).cast("int")).repartition(*keys).sortWithinPartitions(*keys, "shape")

    def run(batches):
        group, expression, stats, root = None, None, None, None

        def add():
            nonlocal root
            x = _with_stats(expression, stats)
            root = x if root is None else _joined(root, x, False)

        def done():
            return pa.RecordBatch.from_arrays([pa.array([group[0]]), pa.array([plan(root) if last else shape(root)]), pa.array([_stats(root).ravel()], pa.list_(pa.int64()))], names=["host", "shape", "stats"])

        for b in batches:
            for h, k, e, s in zip(*(b.column(i).to_pylist() for i in range(4))):
                s = np.array(s, np.int64).reshape(-1, len(STATS))
                here = (h,) if last else (h, k)
                if here != group or e != expression:
                    if group is not None:
                        add()
                    if here != group:
                        if group is not None:
                            yield done()
                        group, root = here, None
                    expression, stats = e, s
                else:
                    stats = _plus(stats, s)
        if group is not None:
            add()
            yield done()

    return in_batches(dealt.select("host", "block", "shape", "stats")).mapInArrow(run, "host string, shape string, stats array<long>")


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host, plan``: the wrapper of each host of ``pages (url, html)``, as a kept table."""
    rows = pages.select(host(pages["url"]).alias("host"), pages["html"])
    return keep(_aligned(_aligned(_streams(rows), False), True).select("host", F.col("shape").alias("plan")))


def extract_text(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages (page_id, url, html)``."""
    wrappers = infer_wrappers(pages) if wrappers is None else wrappers
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], pages["html"], host(pages["url"]).alias("host"))
    counts = keep(rows.groupBy("host").agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.filter((F.col("n") > HOT_PAGES) & (F.col("n") * HOT_SHARE > total)).select("host", F.ceil(F.col("n") / HOT_PAGES).cast("int").alias("parts"))
    # Fewer than HOT_SHARE rows.
    dealt = rows.join(F.broadcast(hot), "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = wrappers.join(F.broadcast(hot), "host", "left").select("host", "plan", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    joined = dealt.join(copies, ["host", "part"], "left").select("page_id", "url", "html", "plan")

    def run(batches):
        plans: dict[str, tuple[Node, dict]] = {}
        for b in batches:
            out = []
            for page, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if text not in plans:
                    if len(plans) >= 256:
                        plans.clear()
                    plans[text] = (read_plan(text) if text else None, {})
                wrapper, known = plans[text]
                if len(known) > 4096:
                    known.clear()
                out.append(extract(page or "", wrapper, known))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return in_batches(joined).mapInArrow(run, "page_id long, url string, text string, n_chars long")
