import html
import random
import re
import time
import tracemalloc

import duckdb
import numpy as np
import pytest

from siftwell.llm import html_text

CASES = [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a b"), ("<article>x<b>y</b>z <i>k</i></article>", "xyz k"), ("<article>a &amp; b &#233;&nbsp;c &lt;p&gt; &am</article>", "a & b é c <p> &am"),
    ("<article>one<br>two<br/>three</article>", "one two three"), ("<body><script>var a='<p>no</p>';</script><style>p{}</style><p>yes</p></body>", "yes"),
    ("<article><h1>T</h1><p>Long text that goes on for a while, and then some more of it.</p><p>Ok.</p><aside>no</aside><form>no<input></form><div class='related'>no</div></article><div>far away</div>", "T Long text that goes on for a while, and then some more of it. Ok."),
    ("<nav><a>x</a></nav><header>h</header><main><header><h1>T</h1></header><p>Body text of some length here.</p></main><footer>f</footer>", "T Body text of some length here."),
    ("<div id=page><div class='cookie-notice'>We use cookies, and this sentence is rather long to be one.</div><div class=post><h2>Head</h2><p>Long text that goes on for a while, and more.</p><p>Yes.</p></div><div class='side sidebar'><p>Side text of quite some length, but it is only beside.</p></div><section id=comments><p>A reader says something that is very long too.</p></section></div>", "Head Long text that goes on for a while, and more. Yes."),
    ("<article><p>a<p>b<!-- no --></article", "a b"), ("<article><div hidden>no</div><div role='alert'>no</div>yes</article>", "yes"), ("<article><table><tr><td>a</td><td>b</td></tr></table></article>", "a b"), ("<<<>>> &&& </p></b>", "<<<>>> &&&"),
]


@pytest.mark.parametrize(("page", "wanted"), CASES)
def test_cases(page, wanted):
    assert html_text.main_text(page) == wanted


def test_pages_of_the_corpus():
    """The whole article of every page, by another way: a pattern and the tags taken out."""
    for (page,) in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        wanted = " ".join(html.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert html_text.main_text(page) == wanted


def test_very_long_pages():
    text = " ".join(["word"] * 200_000)
    assert html_text.main_text(f"<nav>x</nav><article><p>{text}</p></article>") == text
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_smoothing_and_threshold():
    flat = np.full(9, 3.0)
    assert np.allclose(html_text.smooth(flat), flat)
    two = np.array([1.0, 2, 1, 50, 60, 55])
    assert 2 < html_text.threshold(two) < 50 and html_text.threshold(flat) < 3


def test_query_rows(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, "x"), (2, "v", "é" * 10, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "é" * 10, 10)], key=str)
    assert html_text.extract(df.limit(0)).collect() == []


LONG = "Long text that goes on for a while, with commas, and then some more of it."
ODD = [
    (f"<article class='post category-social'><h1>T</h1><p>{LONG}</p></article>", f"T {LONG}"),
    (f"<article class='post login-free tags'><p>{LONG}</p></article><div class='ad'>{LONG}</div>", LONG),
    (f"<body><div class='post login-free'><h1>T</h1><p>{LONG}</p><p>Yes.</p></div><div>(c) 2024</div></body>", f"T {LONG} Yes."),
    (f"<article><p>{LONG}</p></article><section id=comments><article class='comment'><p>{LONG} Says one.</p></article></section>", LONG),
    (f"<article><p>{LONG}</p><article class='comment depth-1'><p>{LONG} Says one.</p></article></article>", LONG),
    (f"<article><p>{LONG} a <b and c</p></article>", f"{LONG} a"),
    (f"<div><p>{LONG} if a < b then more", f"{LONG} if a < b then more"),
    (f"<div><p>{LONG} if a <b then more of it", f"{LONG} if a <b then more of it"),
    (f"<div><p>{LONG}</p><p>x <a href='/y", f"{LONG} x"),
    (f"<article class='comment-free'><p>{LONG}</p></article>", LONG),
]


@pytest.mark.parametrize(("page", "wanted"), ODD)
def test_names_are_only_evidence(page, wanted):
    assert html_text.main_text(page) == wanted


def plain_page(r):
    """A page without semantic elements: menus, a text, a list of links and a line at the end."""
    word = lambda: r.choice("lorem ipsum dolor sit amet, consectetur adipiscing elit sed do eiusmod tempor".split())
    links = lambda n: "<div><ul>" + "".join(f"<li><a href='/{k}'>{' '.join(word() for _ in range(r.randint(1, 4)))}</a></li>" for k in range(n)) + "</ul></div>"
    paragraphs = [" ".join(word() for _ in range(r.randint(15, 90))) for _ in range(r.randint(3, 12))]
    text = ["Heading of it", *paragraphs]
    body = "<h1>Heading of it</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><body>{links(r.randint(10, 30))}<div><div>{body}</div></div>{links(r.randint(15, 40))}<div>(c) <a href='/'>us</a></div></body></html>", " ".join(text)


def test_the_ratios_choose_the_region(monkeypatch):
    r = random.Random(2)
    pages = [plain_page(r) for _ in range(60)]
    assert [html_text.main_text(p) for p, _ in pages] == [t for _, t in pages]
    monkeypatch.setattr(html_text, "threshold", lambda values: float(values.min()) - 1)
    assert sum(html_text.main_text(p) != t for p, t in pages) >= 50


def test_region_against_all_chains():
    """Sums by walking from each line to the root, and the region by trying every element."""
    r = random.Random(9)
    for _ in range(300):
        names, parents = [""], [0]
        for k in range(1, r.randint(2, 25)):
            names.append(r.choice(["div", "section", "p", "article", "ul", "td"]))
            parents.append(r.randrange(k))
        lines = [("x" * r.randint(1, 90), 0, r.randrange(len(names)), False) for _ in range(r.randint(1, 20))]
        content = np.array([r.random() < 0.6 for _ in lines])

        def chain(e):
            out = [e]
            while out[-1]:
                out.append(parents[out[-1]])
            return out

        inside = lambda e, good=False: sum(len(t) for (t, _, at, _), c in zip(lines, content, strict=True) if e in chain(at) and (c or not good))
        want = max(e for e in range(len(names)) if (e == 0 or names[e] in html_text.CONTAINERS) and inside(e, True) >= 0.9 * inside(0, True))
        up = chain(want)
        if articles := [e for e in up if names[e] == "article"]:
            want = articles[-1]
        else:
            for e in up[1:]:
                if e == 0 or names[e] in html_text.CONTAINERS:
                    if not e or inside(e) - inside(want) > 0.25 * inside(want):
                        break
                    want = e
        assert html_text.region_of(names, parents, lines, content) == want


@pytest.mark.parametrize("unit", ["<li>item text", "<td>x", "<tr><td>x", "<b>x", "<div>x", "</p>", "<p>x<b>", "<dd>x", "<a>x<div>"])
def test_unclosed_elements_take_linear_room(unit):
    page, times, peaks = unit * 10_000, [], []
    for part in (page, page * 4):
        tracemalloc.start()
        began = time.perf_counter()
        html_text.main_text(part)
        times.append(time.perf_counter() - began)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert times[1] < 8 * times[0] + 0.5 and peaks[1] < 6 * peaks[0]


def test_many_unclosed_items():
    assert html_text.main_text("<article><ul>" + "<li>x" * 200_000) == " ".join(["x"] * 200_000)
