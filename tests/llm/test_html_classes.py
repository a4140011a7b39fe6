"""The deduction of templates against explicit occurrence vectors, and what depends on it."""

import random
import time
import tracemalloc
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from driftmark.llm import html

SCHEMA = "page_id long, url string, html string"


class Explicit(HTMLParser):
    """Paths, runs and text sizes of a well-formed page, by another parser and with paths in full."""

    def __init__(self, page):
        super().__init__()
        self.path, self.counts, self.runs, self.text = (), Counter({(): 1}), Counter(), defaultdict(list)
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        words = sorted(w for k, v in attrs for w in (v or "").split())
        self.path += (".".join([tag, *words]),)
        self.counts[self.path] += 1

    def handle_endtag(self, tag):
        assert self.path[-1].split(".")[0] == tag
        self.path = self.path[:-1]

    def handle_data(self, data):
        if told := " ".join(data.split()):
            self.runs[self.path, told] += 1
            self.text[self.path].append(told)


def _deduced(pages):
    """(template paths, template texts) from whole occurrence vectors, one entry for each page."""
    told = [Explicit(p) for p in pages]
    elements, runs = (defaultdict(lambda: [0] * len(pages)) for _ in range(2))
    for i, t in enumerate(told):
        for path, n in t.counts.items():
            elements[path][i] = n
        for run, n in t.runs.items():
            runs[run][i] = n
    alone = html.TEXT_ALONE
    parts = {p for p, v in elements.items() if max(v) == 1 and not (p and p[-1].split(".")[0] in alone)}
    vectors = {tuple(elements[p]) for p in parts}
    distinct = lambda v: len({pages[i] for i, n in enumerate(v) if n}) > 1
    fixed = {r for r, v in runs.items() if tuple(v) in vectors and sum(map(bool, v)) >= html.SUPPORT and distinct(v)}
    return parts, fixed


def _id(path):
    node = html.ROOT
    for name in path:
        node = html.Node(node, name)
    return node.id


def _host(rng, n):
    """Pages of a host without a telling name: a head line, boxes on some pages, sections that repeat, a fixed line."""
    word = lambda: rng.choice("river stone mill evening child road house green north window".split())
    line = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    out = []
    for i in range(n):
        box = f"<div class='q{rng.choice("ab")}'><p>{line(1, 3)}</p></div>" if rng.random() < 0.5 else ""
        sections = "".join(f"<section><div class='k'><p>{line(9, 15)} {i}</p></div></section>" for _ in range(rng.randint(1, 4)))
        out.append(f"<html><body><div class='z'>Top line of all</div>{box}<div class='y'><h2>{line(2, 3)} {i}</h2>{sections}<div class='w'>Thanks to all readers</div></div><div class='v'>{line(1, 2)}</div></body></html>")
    return out + out[:1] * rng.randint(0, 2)


def _templates(spark, hosts):
    rows = [(i, f"http://{h}.example/x", p) for h, pages in hosts.items() for i, p in enumerate(pages)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = html._summaries(docs).groupBy("host").applyInPandas(html._templates, "host string, paths binary, fixed binary, whole boolean").collect()
    return {r["host"].split(".")[0]: html.Template(bytes(r["paths"]), bytes(r["fixed"]), r["whole"]) for r in made}


def test_templates_equal_explicit_vectors(spark):
    rng = random.Random(4)
    hosts = {f"h{i}": _host(rng, n) for i, n in enumerate([1, 2, 3, 4, 5, 9, 17, 30])}
    got = _templates(spark, hosts)
    some = 0
    for name, pages in hosts.items():
        parts, fixed = _deduced(pages)
        # paths of a single page are left to that page
        several = {p for p in parts if sum(p in Explicit(x).counts for x in pages) > 1}
        assert got[name].parts == {_id(p) for p in several} | {0}
        assert got[name].fixed == {html.hashed("run", _id(p), t) for p, t in fixed}
        some += len(fixed)
    assert some > 4


def test_unnamed_main_text_of_small_and_large_hosts(spark):
    """No name says anything here: classes alone find the element, keep all its sections and leave out what is fixed."""
    rng = random.Random(5)
    hosts = {f"h{i}": _host(rng, n) for i, n in enumerate([1, 2, 3, 4, 8, 20])}
    rows = [(i, f"http://{h}.example/x", p) for h, pages in hosts.items() for i, p in enumerate(pages)]
    got = {(r["url"].split("/")[2].split(".")[0], r["page_id"]): r["text"] for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for name, pages in hosts.items():
        _, fixed = _deduced(pages)
        for i, page in enumerate(pages):
            told = Explicit(page)
            inside = [(p, t) for p, texts in told.text.items() if "div.y" in p for t in texts]
            assert sorted(got[name, i].split("\n")) == sorted(t for p, t in inside if (p, t) not in fixed)


def test_classes_decide():
    """Without the host's classes no element is known to be menu or article, and all text is given back."""
    page = "<html><body><nav><p>Menu</p></nav><article><h1>Title</h1><p>Text of the article.</p></article><footer>End</footer></body></html>"
    assert html.main_text(page, html.Template(own=False)) == "Menu\nTitle\nText of the article.\nEnd"


def test_sections_that_repeat_are_not_descended_into(spark):
    """A page with a single section keeps the line beside it, as other pages show that sections repeat."""
    page = lambda n, many: "<body><div class=q><div class=t>T {0}</div>".format(n) + f"<section><p>Long text of one section {n} goes on and on here.</p></section>" * many + "</div></body>"
    rows = [(n, "http://a.example/x", page(n, 1 + n % 3)) for n in range(6)] + [(n, "http://b.example/x", page(n, 1)) for n in range(6)]
    got = {(r["url"], r["page_id"]): r["text"] for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["http://a.example/x", 0] == "T 0\nLong text of one section 0 goes on and on here."
    assert got["http://b.example/x", 0] == "Long text of one section 0 goes on and on here."


def test_torn_pages_don_t_spoil_a_template(spark):
    whole = "<html><body><nav>Menu</nav><article><p>Text {0} of a page.</p></article><footer>End</footer></body></html>"
    torn = "<html><body><nav>Menu</nav><article><p>Text {0} of a page."
    rows = [(n, "http://a.example/x", (torn if n % 3 else whole).format(n)) for n in range(9)] + [(9, "http://b.example/x", torn.format(9))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {n: f"Text {n} of a page." for n in range(10)}


def test_ids_of_each_page(spark):
    """Names that no two pages share leave few rows for a host, and the pages are read alike."""
    page = "<body><nav>Menu</nav><article id='slug-{w}'><h1>Title {n}</h1><p>Text {n} of a page.</p><div class=comments><p>Reader {n}</p></div></article><footer>End</footer></body>"
    word = lambda n: "".join("abcdefghij"[int(c)] for c in str(1000 + n))
    rows = [(n, "http://a.example/x", page.format(n=n, w=word(n))) for n in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert html._summaries(df).count() < 10
    assert {r["page_id"]: r["text"] for r in html.extract(df).collect()} == {n: f"Title {n}\nText {n} of a page." for n in range(60)}


def test_rows_of_equal_or_null_ids(spark):
    page = "<body><div class=a>Same line</div><div class=b><p>Own text {0} is long enough here.</p></div></body>"
    rows = [(None if n % 2 else 7, "http://a.example/x", page.format(n // 2)) for n in range(12)]
    got = sorted(r["text"] for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted(f"Own text {n // 2} is long enough here." for n in range(12))


@pytest.mark.parametrize("tag", ["div", "section", "x-y"])
def test_deep_pages_cost_in_proportion(tag):
    def peak(depth):
        page = "<article>" + f"<{tag}>" * depth + "deep" + f"</{tag}>" * depth + "</article>"
        html._nodes.clear()
        tracemalloc.start()
        began = time.perf_counter()
        whole, found = html.tokens(page)
        assert whole and len(found) == depth + 3
        assert html.main_text(page, html.Template()) == "deep"
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return size, time.perf_counter() - began

    small, large = peak(2_000), peak(16_000)
    assert large[0] < 16 * small[0] and large[0] < 40_000_000 and large[1] < 20
