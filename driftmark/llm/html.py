"""Main text of web pages by equivalence classes of tokens on the pages of a host.

A page's tokens are its structural elements, told apart by their paths, and its text runs,
told apart by the path and the text. Tokens of a host with the same occurrence vector (how often
each page has them) form an equivalence class. A class of elements is valid if every page
that has it has it once and whole (opened and closed); its elements, nested by their paths,
are the host's template, and a class that only some pages have is one of the things that
may stand in a slot of the classes around it. Elements that a page has several times
are iterations inside a slot. Text runs in a class with such elements are template text; a
slot is what the pages put between the template's tokens, and its size is the
text that isn't template text or link text.

From the whole page inwards, a page's main text is in the template element that holds most of the
text of the slots around it, as long as there is one (MOST of it). Sizes are means over the
host's pages. The names of the template's elements veto (menus, adverts, forms, comments and the
like are no main text, unless a page has no other), protect (an element named as the article is
taken whole, with the text that pages repeat in it) and settle what sizes leave open; those of elements
outside the template say nothing.

Occurrence vectors are kept as fingerprints (sums of two 32-bit mixes of page and count,
number of pages, total, largest count), which add up before any shuffle; classes are matched by
their fingerprints, so a host of any number of pages is never gathered in one place: its
template has one row for each of its template texts and of the paths that several pages have. Of paths that
are on one page alone, by an id of its own perhaps, that page itself is the whole vector. Pages that leave elements
open are not learnt from, unless a host has no other.

Defined results: null or empty html, or no main text -> text "" and n_chars 0; a null url
is a host of its own; broken markup is read as far as it goes, at any depth in memory that
grows with the page alone; repeated rows each get a row, and copies of one page don't make its text a
template's; an empty table gives no rows; columns besides those named are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.plans.cluster import cut, ship

# Fixed values of HTML: elements without content, with raw content, inside lines, and those that close an open one of their own.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "xmp", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Elements that a closing rule doesn't look beyond.
WALLS = {"ul", "ol", "dl", "table", "article", "section", "main", "div", "body", "nav", "aside", "footer", "header", "form", "blockquote"}
#: Block elements whose start ends an open paragraph.
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}
#: Elements, and words of class, id and role, that mark what isn't main text.
APART = {"head", "title", "nav", "footer", "aside", "button", "select", "dialog", "menu"}
APART_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "contentinfo", "cookie", "cookies", "consent", "dialog", "disclaimer", "discussion", "disqus", "feedback", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination", "popup", "promo", "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget"}
#: What a word made of several may have besides those; any other part (has-sidebar, comments-open) makes it say something else.
BOX_WORDS = {"0", "site", "page", "post", "posts", "entry", "article", "articles", "main", "list", "area", "section", "box", "block", "form", "links", "buttons", "bar"}
MAIN = {"article", "main"}
MAIN_WORDS = {"article", "articlebody", "main", "maincontent", "post", "entry", "story"}
#: Elements whose end tag HTML lets a page leave out.
OPTIONAL_END = {"html", "head", "body", "p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "colgroup", "caption", "option", "optgroup"}
#: Elements that hold text alone, and so no slots of a template.
TEXT_ALONE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "dt"}
#: A template element holds the main text if it has this part of the text of the slots around it.
MOST = 0.7
#: Pages that a text has to be on to be template text.
SUPPORT = 3
#: Templates of all hosts together that are sent to every task.
BROADCAST_BYTES = 8_000_000
#: Elements that a process remembers before it starts afresh.
MEMO = 200_000

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@lru_cache(100_000)
def element(tag: str, attributes: str) -> str:
    """Name of an element: its tag and the words of its class, id and role, each whole, digits made alike."""
    found = {re.sub(r"[^a-z0-9]+", "-", w).strip("-") for m in ATTRIBUTE.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").lower().split()}
    return ".".join([tag, *sorted({re.sub(r"\d+", "0", w) for w in found if w})])


def told(run: str) -> str:
    """A text run with references decoded and white space made single."""
    return " ".join(entities.unescape(run).split())


def hashed(*parts: int | str) -> int:
    """Unsigned 64-bit hash."""
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"))


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def host(url: str | None) -> str:
    """Host of a url in lower case; the whole url where it has none."""
    try:
        return (urlsplit(url or "").hostname or url or "").lower()
    except ValueError:
        return (url or "").lower()


def is_apart(word: str) -> bool:
    parts = set(word.split("-"))
    return bool(parts & APART_WORDS) and parts <= APART_WORDS | BOX_WORDS


def is_main(word: str) -> bool:
    return not MAIN_WORDS.isdisjoint(word.split("-")) and not is_apart(word)


NAMED, RESCUED, PLAIN, ASIDE, SET_APART = "named", "rescued", "plain", "aside", "apart"


class Node:
    """An element by its path: its id follows from the names on the path; whether its name sets its text apart or calls it main."""

    __slots__ = ("id", "above", "tag", "main", "apart")

    def __init__(self, above: Node | None, name: str):
        self.above = above
        self.id = hashed(above.id, name) if above else 0
        self.tag, *words = name.split(".")
        plain = self.tag in ("html", "body")
        # an article's or main's own words count for nothing, those inside it for what they enclose
        self.main = not plain and (self.tag in MAIN or any(map(is_main, words)))
        self.apart = not plain and self.tag not in MAIN and (self.tag == "form" or any(map(is_apart, words)))


ROOT = Node(None, "")


class Standing:
    """What the names of the template elements around a text make of it.

    NAMED as main text; RESCUED: so named, but inside or beside a word of what isn't; PLAIN:
    not named; ASIDE: set apart by a word or a form; SET_APART: by a tag, a header outside an article among them.
    """

    __slots__ = ("inside", "named", "rescued", "aside", "off")

    def __init__(self, inside: bool = False, named: bool = False, rescued: bool = False, aside: bool = False, off: bool = False):
        self.inside, self.named, self.rescued, self.aside, self.off = inside, named, rescued, aside, off

    def within(self, node: Node) -> Standing:
        off = self.off or node.tag in APART or node.tag == "header" and not self.inside
        inside = self.inside or node.tag in MAIN
        if node.main:
            return Standing(inside, True, self.rescued or self.aside or node.apart, False, off)
        return Standing(inside, self.named, self.rescued, self.aside or node.apart, off)

    @property
    def kind(self) -> str:
        return SET_APART if self.off else ASIDE if self.aside else RESCUED if self.rescued else NAMED if self.named else PLAIN


class _Nodes(dict):
    """Elements by the id of the one around them and their name."""

    def inside(self, above: Node, name: str) -> Node:
        node = self.get((above.id, name))
        if node is None:
            if len(self) >= MEMO:
                self.clear()
            node = self[above.id, name] = Node(above, name)
        return node


_nodes = _Nodes()


def walk(page: str):
    """Events of a page in order.

    ("open", node, ""), ("text", node, raw run), ("link", node, raw run inside a link),
    ("break", node, ""): the end of a line or block; ("torn", node, ""): an element that
    should have been closed wasn't.
    """
    stack: list[Node] = []
    counts: dict[str, int] = defaultdict(int)  # open elements by tag
    node, links, at = ROOT, 0, 0

    def pop() -> Node:
        counts[stack[-1].tag] -= 1
        return stack.pop()

    while m := MARKUP.search(page, at):
        if m.start() > at:
            yield "link" if links else "text", node, page[at : m.start()]
        at = m.end()
        if not m[2]:
            continue
        tag, alone = m[2].lower(), m[3].endswith("/")
        if tag in RAW:
            if not m[1] and not alone:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            yield "break", node, ""
        elif tag == "a":
            links = not m[1]
        elif tag in INLINE:
            continue
        elif tag in VOID:
            yield "break", node, ""
        elif m[1]:
            if counts[tag]:
                while stack[-1].tag != tag:
                    if stack[-1].tag not in OPTIONAL_END:
                        yield "torn", stack[-1], ""
                    pop()
                links = 0
                pop()
                node = stack[-1] if stack else ROOT
            yield "break", node, ""
        else:
            closes = CLOSES.get(tag, {"p"} if tag in BLOCKS else set())
            while any(counts[t] for t in closes) and _closable(stack, closes):
                pop()
                links = 0
            above = stack[-1] if stack else ROOT
            if alone:
                node = above
            else:
                node = _nodes.inside(above, element(tag, m[3]))
                stack.append(node)
                counts[tag] += 1
                yield "open", node, ""
            yield "break", node, ""
    if at < len(page):
        yield "link" if links else "text", node, page[at:]
    for left in stack:
        if left.tag not in OPTIONAL_END:
            yield "torn", left, ""


def _closable(stack: list[Node], closes: set[str]) -> bool:
    """Whether one of closes is open inside the innermost element that stops closing rules."""
    for node in reversed(stack):
        if node.tag in closes:
            return True
        if node.tag in WALLS:
            return False
    return False


def blocks(page: str) -> tuple[list[tuple[Node, list[str], str, int]], dict[int, int], bool]:
    """(element, raw runs, text, code points of it in links) of each block that has text, how often each element opens, and whether the page is whole."""
    found: list[tuple[Node, list[str], list[str]]] = []
    opened: dict[int, int] = defaultdict(int)
    begun, whole = False, True
    for kind, node, run in walk(page):
        if kind in ("text", "link"):
            if not begun:
                found.append((node, [], []))
            begun = True
            found[-1][1].append(run)
            found[-1][2].append(kind)
        elif kind == "torn":
            whole = False
        else:
            begun = False
            opened[node.id] += kind == "open"
    out = []
    for node, runs, kinds in found:
        if text := told("".join(runs)):
            out.append((node, runs, text, sum(len(told(r)) for r, k in zip(runs, kinds, strict=True) if k == "link")))
    return out, opened, whole


#: Columns of the tokens of a host: whether from whole pages; "element" or "run"; id, and the element it is in.
KEY = ["host", "whole", "kind", "id", "above"]
SUMS = ["lo", "hi", "pages", "total", "text", "links"]


def tokens(page: str) -> tuple[bool, dict[tuple, list[int]]]:
    """Whether a page is whole, and (kind, id, id of the element it is in) -> count, code points, those in links."""
    found: dict[tuple, list[int]] = {("element", 0, 0): [1, 0, 0]}
    whole = True
    for kind, node, run in walk(page):
        above = node.above.id if node.above else 0
        if kind == "torn":
            whole = False
        elif kind == "open":
            # what holds text alone is no part of a template
            found.setdefault(("text" if node.tag in TEXT_ALONE else "element", node.id, above), [0, 0, 0])[0] += 1
        elif kind != "break" and (text := told(run)):
            row = found.setdefault(("text" if node.tag in TEXT_ALONE else "element", node.id, above), [0, 0, 0])
            row[1] += len(text)
            row[2] += len(text) * (kind == "link")
            row = found.setdefault(("run", hashed("run", node.id, text), node.id), [0, len(text), 0])
            row[0] += 1
    return whole, found


def _summaries(pages: DataFrame) -> DataFrame:
    """The tokens of each host with the fingerprints of their occurrence vectors; runs only where they can be template text."""

    def counted(batches):
        for batch in batches:
            sums: dict[tuple, list] = {}
            for url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, (whole, found) = host(url), tokens(page or "")
                same = hashed("page", page or "")  # copies of a page are one page many times
                for (kind, token, above), (n, text, links) in found.items():
                    row = sums.get((name, whole, kind, token, above))
                    if row is None:
                        row = sums[name, whole, kind, token, above] = [0, 0, 0, 0, 0, 0, 0, signed(same), signed(same)]
                    mix = hashed(same, n)
                    row[0] += mix & 0xFFFFFFFF
                    row[1] += mix >> 32
                    row[2] += 1
                    row[3] += n
                    row[4] += text
                    row[5] += links
                    row[6] = max(row[6], n)
                    row[7] = min(row[7], signed(same))
                    row[8] = max(row[8], signed(same))
            keys, values = list(sums), list(sums.values())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.bool_()),
                    pa.array([k[2] for k in keys], pa.string()),
                    pa.array([signed(k[3]) for k in keys], pa.int64()),
                    pa.array([signed(k[4]) for k in keys], pa.int64()),
                    *(pa.array([v[i] for v in values], pa.int64()) for i in range(9)),
                ],
                [*KEY, *SUMS, "most", "first", "last"],
            )

    ddl = "host string, whole boolean, kind string, id long, above long, " + ", ".join(f"{c} long" for c in [*SUMS, "most", "first", "last"])
    made = pages.select("url", "html").mapInArrow(counted, ddl)
    sums = made.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in SUMS), F.max("most").alias("most"), F.min("first").alias("first"), F.max("last").alias("last"))
    # most runs, and the elements that an id names apart, are on one page: such runs make no template, and of such elements the page itself knows all
    held = F.when(F.col("kind") == "run", (F.col("pages") >= SUPPORT) & (F.col("first") != F.col("last"))).otherwise((F.col("pages") > 1) | (F.col("id") == 0))
    sums = cut(sums.where(held))
    shared = ["host", "whole", "lo", "hi", "pages", "total"]
    classes = sums.where((F.col("kind") == "element") & (F.col("most") == 1)).select(*shared).distinct()
    runs = sums.where("kind = 'run'").join(classes, shared, "left_semi")
    return sums.where("kind != 'run'").unionByName(runs.select(*sums.columns))


#: A path of a host: id, whether it is part of the template, mean own text of a page outside links and template text, mean of all text, whether it is mostly links.
PATH = np.dtype([("id", "<i8"), ("part", "u1"), ("size", "<f8"), ("text", "<f8"), ("links", "u1")])


def _templates(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for a host: its paths and its template texts, packed, and whether they come from whole pages."""
    name, whole = rows["host"].iloc[0], bool(rows["whole"].any())
    if whole:
        rows = rows[rows["whole"]]
    runs, paths = rows[rows["kind"] == "run"], rows[rows["kind"] != "run"]
    fixed = runs.assign(chars=runs["text"]).groupby("above")["chars"].sum()
    out = np.zeros(len(paths), PATH)
    out["id"] = paths["id"]
    out["part"] = (paths["kind"] == "element") & (paths["most"] == 1)
    free = np.maximum(paths["text"] - paths["links"] - paths["id"].map(fixed).fillna(0), 0)
    out["size"], out["text"] = free / paths["pages"], paths["text"] / paths["pages"]
    out["links"] = (paths["text"] > 0) & (2 * paths["links"] >= paths["text"])
    return pd.DataFrame({"host": [name], "paths": [np.sort(out, order="id").tobytes()], "fixed": [np.sort(runs["id"].to_numpy("<i8")).tobytes()], "whole": [whole]})


class Template:
    """What a host's pages say of its paths. own: a page that the host's template is learnt from speaks for paths that are on no other."""

    def __init__(self, paths: bytes = b"", fixed: bytes = b"", whole: bool = True, own: bool = True):
        rows = [(r[0] & 0xFFFFFFFFFFFFFFFF, *r[1:]) for r in np.frombuffer(paths, PATH).tolist()]
        self.parts = {r[0] for r in rows if r[1]}
        self.sizes = {r[0]: (r[2], r[3], bool(r[4])) for r in rows}
        self.fixed = set(np.frombuffer(fixed, "<u8").tolist())
        self.whole, self.own = whole, own

    def is_fixed(self, node: Node, runs: list[str]) -> bool:
        """Whether a block is made of template texts alone."""
        return bool(self.fixed) and all(hashed("run", node.id, t) in self.fixed for r in runs if (t := told(r)))


def content(nodes: dict[int, Node], kinds: dict[int, str], sizes: dict[int, float], parts: set[int]) -> int:
    """The id of the innermost template element that holds the main text.

    nodes: the elements around text, outer ones first; sizes: the text that is theirs; parts: those of the template.
    """
    around: dict[int, int] = {0: 0}
    held: dict[int, float] = {0: 0.0}
    for i, node in nodes.items():
        if i:
            around[i] = i if i in parts else around[node.above.id]
            held.setdefault(around[i], 0.0)
    for i, size in sizes.items():
        held[around[i]] += size
    outer = {i: around[nodes[i].above.id] for i in held if i}
    for i in reversed([i for i in nodes if i in outer]):
        held[outer[i]] += held[i]
    best: dict[int, int] = {}
    for i, o in outer.items():
        if o not in best or held[i] > held[best[o]]:
            best[o] = i
    at = 0
    while at in best and held[best[at]] >= MOST * held[at] > 0 and kinds[at] != NAMED:
        at = best[at]
    return at


def main_text(page: str | None, template: Template) -> str:
    """The main text of a page: the blocks of the template element that holds it, in page order."""
    found, opened, whole = blocks(page or "")
    nodes: dict[int, Node] = {0: ROOT}
    for node, *_ in found:
        chain = []
        while node.id not in nodes:
            chain.append(node)
            node = node.above
        nodes |= {n.id: n for n in reversed(chain)}
    chars: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for node, _, text, links in found:
        chars[node.id][0] += len(text)
        chars[node.id][1] += links
    # what the host's classes say of each element, or the page itself if it is one of those that are learnt from
    own = template.own and (whole or not template.whole)
    standings, parts = {0: Standing()}, {0}
    for i, node in nodes.items():
        if i:
            above = standings[node.above.id]
            standings[i] = above.within(node) if own or i in template.sizes else above
            if i in template.parts or own and i not in template.sizes and opened[i] == 1 and node.tag not in TEXT_ALONE:
                parts.add(i)
    kinds = {i: x.kind for i, x in standings.items()}
    total: dict[str, int] = defaultdict(int)
    for i, (n, _) in chars.items():
        total[kinds[i]] += n
    links = {i: template.sizes[i][2] if i in template.sizes else 2 * x >= n for i, (n, x) in chars.items()}
    first = {NAMED, PLAIN} if total[NAMED] or total[PLAIN] and total[PLAIN] >= total[RESCUED] else {RESCUED}
    for wanted in (first, {PLAIN, RESCUED} - first, {ASIDE}):
        mine = [b for b in found if kinds[b[0].id] in wanted and (kinds[b[0].id] == NAMED or not links[b[0].id])]
        if not mine:
            continue
        free = {b[0].id: template.sizes.get(b[0].id, (chars[b[0].id][0] - chars[b[0].id][1], chars[b[0].id][0])) for b in mine}
        sizes = {i: s[0] for i, s in free.items()}
        if not any(sizes.values()):  # all is template text
            sizes = {i: s[1] for i, s in free.items()}
        at = content(nodes, kinds, sizes, parts)
        inside: dict[int, bool] = {}
        for i, node in nodes.items():
            inside[i] = i == at or i != 0 and inside[node.above.id]
        kept = [b for b in mine if inside[b[0].id]]
        of = {b[0].id for b in kept}
        named = sum(sizes[i] for i in of if kinds[i] == NAMED)
        if named and named >= (1 - MOST) * sum(sizes[i] for i in of):
            kept = [b for b in kept if kinds[b[0].id] == NAMED]
        text = [b[2] for b in kept if kinds[b[0].id] == NAMED or not template.is_fixed(b[0], b[1])]
        if text or kept:
            return "\n".join(text or [b[2] for b in kept])
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    ship(pages.sparkSession)
    templates = cut(_summaries(pages).groupBy("host").applyInPandas(_templates, "host string, paths binary, fixed binary, whole boolean"))

    def with_host(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([host(u) for u in batch.column(1).to_pylist()], pa.string()), *batch.columns], ["host", *batch.schema.names])

    kind = dict(pages.dtypes)["page_id"]
    hosted = pages.select("page_id", "url", "html").mapInArrow(with_host, f"host string, page_id {kind}, url string, html string")

    def read(batches):
        unpacked = lru_cache(1000)(Template)
        for batch in batches:
            texts = [main_text(h, unpacked(*t)) for h, *t in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    # pages are sent by host only where the templates are too large for every task
    size = templates.agg(F.sum(F.octet_length("host") + F.octet_length("paths") + F.octet_length("fixed")).alias("n")).first()["n"] or 0
    joined = hosted.join(F.broadcast(templates) if size <= BROADCAST_BYTES else templates, "host").select("page_id", "url", "html", "paths", "fixed", "whole")
    return joined.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
