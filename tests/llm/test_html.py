from driftmark.llm import html

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p><b>';</script></head><body class='article post'>"
    "<header><h1>Site</h1></header><nav><ul><li><a href='/a'>Menu</a></ul></nav><!-- <p>no</p> --><div class=\"ad\">Buy {n} now</div>"
    "<article><h1>Title {n} &amp; more</h1><p>First  para&#233;\n of {n}<p>Second <b>bold</b><i>x</i> &lt;tag&gt; of {n}<br>after {n}<br></p>"
    "<div class='comments'><p>Reader {n} says</p></div><form><input value='x'>Send {n}</form></article>"
    "<aside>Side {n}</aside><footer>&copy; all {n}</footer></body></html>"
)


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string, keep string")


def _rows(pages, first=0):
    return [(first + i, u, h, "x", "y", "z") for i, (u, h) in enumerate(pages)]


def _wanted(n):
    return f"Title {n} & more\nFirst paraé of {n}\nSecond boldx <tag> of {n}\nafter {n}"


def test_main_text(spark):
    pages = [(f"https://Host.example/{n}", PAGE.format(n=n)) for n in range(12)] + [("https://lonely.example/", PAGE.format(n=99))]
    got = {r["page_id"]: r for r in html.extract(_pages(spark, _rows(pages))).collect()}
    for i in range(12):
        assert got[i]["text"] == _wanted(i) and got[i]["n_chars"] == len(_wanted(i))
    assert got[12]["text"] == _wanted(99)


def test_pages_without_an_article(spark):
    page = "<body><div id=top><a href=1>One</a> <a href=2>Two</a></div><div id=body><p>Real text number {n} is here, and long enough.</p><p>Same words on each page.</p></div></body>"
    got = html.extract(_pages(spark, _rows([("http://plain.example/x", page.format(n=n)) for n in range(8)]))).collect()
    assert sorted(r["text"] for r in got) == [f"Real text number {n} is here, and long enough." for n in range(8)]


def test_a_host_of_two_templates(spark):
    links = "<div id=top><a href=1>One</a> <a href=2>Two</a></div>"
    plain = links + "<div class=content><p>Unnamed page {n} has its own long text.</p><p>Same on each plain page.</p></div>"
    bodies = {
        "named": links + "<article><p>Named page {n} has its own long text.</p><p>Same on each named page.</p></article>",
        "open": links + "<main><p>Open page {n} is never closed.",
        "plain": plain, "teaser": links + "<div class=story><p>Teaser {n}</p></div>",
    }
    kinds = ["named"] * 8 + ["open"] + ["plain"] * 8 + ["teaser"]
    pages = [("http://two.example/x", f"<html><body>{bodies[k].format(n=n)}</body></html>") for n, k in enumerate(kinds)]
    got = {r["page_id"]: r["text"] for r in html.extract(_pages(spark, _rows(pages))).collect()}
    for n, k in enumerate(kinds):
        assert got[n] == {
            "named": f"Named page {n} has its own long text.\nSame on each named page.", "open": f"Open page {n} is never closed.",
            "plain": f"Unnamed page {n} has its own long text.", "teaser": f"Teaser {n}",
        }[k]


def test_words_of_an_article_and_its_wrappers_don_t_lose_it(spark):
    text, other = "<h1>Title {n}</h1><p>Long main text of page {n}.</p>", "<div class=comments><p>Reader {n}</p></div><ol class=comment-list><li><article>Reply {n}</article></ol>"
    main = "Title {n}\nLong main text of page {n}."
    bodies = [
        f"<article class='post comments-open'>{text}{other}</article>", f"<article class='category-social'>{text}</article>{other}", f"<article class='search'>{text}</article>",
        f"<main id='main' class='no-sidebar'>{text}</main>", f"<div class='content has-sidebar'>{text}</div>{other}", f"<div class='content has-sidebar'><article>{text}</article></div>",
        f"<div class='sidebar search'><main>{text}</main></div>", f"<form id=aspnet><div class=post>{text}</div></form>", f"<form>{text}</form>", f"<div class='notice'>{text}</div>",
        f"<div class='content'>{text}</div><div class='related'><article>Card {{n}}</article></div>", f"<div class='entry social'>{text}</div><div class=site-footer>All rights {{n}}</div>",
    ]
    pages = [(f"http://h{h}.example/x", f"<html><body class='ad'><nav>Menu</nav>{b.format(n=n)}<footer>End</footer></body></html>") for h, b in enumerate(bodies) for n in range(6)]
    got = {r["page_id"]: r["text"] for r in html.extract(_pages(spark, _rows(pages))).collect()}
    assert [(i // 6, got[i]) for i in range(len(pages))] == [(i // 6, main.format(n=i % 6)) for i in range(len(pages))]


def test_copies_of_a_page_keep_their_text(spark):
    got = html.extract(_pages(spark, _rows([("http://copies.example/x", PAGE.format(n=1))] * 9))).collect()
    assert {r["text"] for r in got} == {_wanted(1)} and len(got) == 9


def test_odd_pages(spark):
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    pages = [
        (None, None), ("http://a.example", ""), ("not a url", "plain text only"), ("http://[bad", "<article>broken <p>markup <b"),
        ("http://b.example", "<script>never closed <p>x"), ("http://c.example", long), ("http://d.example", "<article><p>a &amp b &nbsp; &am</p></p></div></article></article>"),
        ("http://e.example", "<article>a < b and c > d</article>"), ("http://f.example", "<" * 3000 + "&" * 3000), ("http://g.example", "<article><p title='a>b'>quoted</p></article>"),
    ]
    got = {r["page_id"]: r["text"] for r in html.extract(_pages(spark, _rows(pages))).collect()}
    assert got[0] == got[1] == got[4] == ""
    assert got[2] == "plain text only" and got[3].split() == ["broken", "markup"]
    assert got[5] == "\n".join(["word word"] * 20_000)
    assert got[6] == "a & b &am" and got[7] == "a < b and c > d" and got[9] == "quoted"
    assert html.extract(_pages(spark, _rows([])) if False else _pages(spark, _rows(pages)).limit(0)).count() == 0
