"""Template removal against a plain twin, on sites with and without telling tags."""

import random
from collections import defaultdict
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pytest

from fieldglass.llm import html_text


class Tree(HTMLParser):
    """Nested lists (tag, class, children) of well-formed pages."""

    def __init__(self):
        super().__init__()
        self.root = ["#", "", []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs).get("class", ""), []]
        self.open[-1][2].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(" ".join(data.split()))


def tree(html):
    t = Tree()
    t.feed(html)
    return t.root


def containers(node):
    for child in node[2] if not isinstance(node, str) else ():
        if not isinstance(child, str):
            if child[0] in ("div", "ul", "nav", "footer", "section"):
                yield child
            yield from containers(child)


def texts(node, gone):
    for child in node[2]:
        if isinstance(child, str):
            if child:
                yield child
        elif str(child) not in gone:
            yield from texts(child, gone)


def plain(rows, least):
    """Every subtree counted per host by the pages of different texts that hold it."""
    seen = defaultdict(set)
    for _, url, html in rows:
        t = tree(html)
        for c in containers(t):
            seen[urlsplit(url).hostname, str(c)].add(" ".join(texts(t, ())))
    return {i: "\n".join(texts(tree(html), {c for (h, c), pages in seen.items() if h == urlsplit(url).hostname and len(pages) >= least})) for i, url, html in rows}


def site(semantic):
    rng = random.Random(5)
    nav, foot = ("nav", "footer") if semantic else ("div", "div")
    rows = []
    for i in range(150):
        host = rng.choice(("a.example", "b.example", "c.example"))
        menu = rng.randrange(4)
        items = "".join(f"<li><p>{host} {menu} {k}</p></li>" for k in range(3))
        promo = f"<div class=x9><div><p>offer {rng.randrange(3)}</p></div></div>"
        story = "".join(f"<p>story {i} part {k}</p>" for k in range(rng.randrange(1, 5)))
        rows.append((i, f"http://{host}/{i}", f"<html><body><{nav} class=q1><ul>{items}</ul></{nav}><div class=z3><div>{story}</div>{promo}</div><{foot} class=q2><p>imprint of {host}</p></{foot}></body></html>"))
    return rows


@pytest.mark.parametrize("semantic", [True, False])
def test_recurrence_alone(spark, semantic):
    """Without hints, recurrence finds menus, offers and imprints, whatever their tags."""
    rows = site(semantic)
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), hints=False)
    got = {r.page_id: r.text for r in out.collect()}
    want = plain(rows, html_text.LEAST_PAGES)
    assert got == want
    assert all(t and "imprint" not in t and "offer" not in t and t.startswith(f"story {i} ") for i, t in got.items())


def test_recurrence_on_the_driver_pages():
    """With the shortcut to articles and the hints switched off, recurrence alone gives the full text where a host's menus recur, and nothing does without it."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["url", "html"])
    pages = [(html_text.host_of(u), h) for u, h in zip(table["url"].to_pylist(), table["html"].to_pylist(), strict=True) if h]
    full = [html_text.parse(h)[0] for _, h in pages]
    seen = {}
    for (host, h), text in zip(pages, full, strict=True):
        for piece in html_text.parse(h, hints=False, shortcut=False)[1]:
            seen.setdefault((host, piece), set()).add(text)
    template = {}
    for (host, piece), mains in seen.items():
        if len(mains) >= html_text.LEAST_PAGES:
            template.setdefault(host, set()).add(piece)

    def alike(pieces, hints):
        return sum(html_text.parse(h, frozenset(pieces.get(host, ())), hints, shortcut=False)[0] == text for (host, h), text in zip(pages, full, strict=True))

    assert alike({}, False) == 0
    assert alike(template, False) > 0.25 * len(pages)
    # what does not recur, the hints know; the shortcut adds nothing on these pages
    assert alike(template, True) == len(pages)


@pytest.mark.parametrize(
    "page",
    ["<b>" * 60_000 + "<p>x</p>" * 90_000, "<div>" * 90_000 + "x" + "</div>" * 90_000, "<article>" + "<b>" * 60_000 + "<h2>y</h2>" * 70_000, "<table><tr>" + "<td>x<i>" * 120_000],
)
def test_nested_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_text.parse(page)
    assert len(page) > 870_000 and time.process_time() - began < 6  # quadratic time took minutes


def test_article_in_a_menu():
    """An article that is no main text leaves no trace behind it."""
    assert html_text.parse("<nav><article>no</article></nav><main><header><p>by</p><h1>T</h1></header><h2>s</h2><p>a</p></main>")[0] == "T\ns\na"


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><div class='ad-hoc methods'><p>a</p></div><div class=social-science>b</div><div class='top-menu'>no</div></article>", "a\nb"),
        ("<article><header><p>By X</p><h1>T</h1><p>date</p></header><p>a</p></article>", "T\na"),
        ("<main><header><h1>T</h1><p>no</p></header><article><p>a</p></article></main>", "T\na"),
        ("<article><p>x <math><mi>y</mi></math> z</p><object>o</object><noscript><p>n</p></noscript><xmp><b>&amp;</xmp></article>", "x y z\no\nn\n<b>&amp;"),
        ("<noscript>turn it on</noscript><p>a</p><nav><ul><li>m</ul></nav><div id='cookie-notice'>c</div>", "a"),
    ],
)
def test_hints(page, want):
    assert html_text.parse(page)[0] == want


def test_html_edges(spark):
    schema = "page_id long, url string, html string, row int, host string, pieces int, `a.b` int"
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
    long_ = "<article><p>" + "word " * 400_000 + "</p></article>"
    urls = [None, "", "//h.org/x", " http://h.org/1", "http://a@b@h.org/1", "http://[bad", "nothing"]
    rows = [(i, u, "<div><p>same</p></div><p>x</p>", 1, "h", 2, 3) for i, u in enumerate(urls)] + [(50, "http://l.org", long_, 1, "h", 2, 3), (50, "http://l.org", long_, 1, "h", 2, 3), (None, None, None, None, None, None, None)]
    out = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows) and {len(r.text) for r in out if r.page_id == 50} == {5 * 400_000 - 1}
    assert [r.text for r in out if r.page_id is None] == [""]


def test_equally_long_mains():
    """Of equally long main elements the first is the text."""
    assert html_text.parse("<main><p>a</p></main><main><p>b</p></main>")[0] == "a"
