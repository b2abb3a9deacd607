"""The reader of pages, the consistent choice against all choices, held-out accuracy, and defined cases."""

import html
import itertools
import math
import os
import random
import re

import numpy as np
import pytest

from skycolumn.llm import dom, html_extract
from skycolumn.llm.boosting import fit_boosted

PAGES = "/root/testdata/sf0.01/pages.parquet"


def plain_article(source):
    inner = source[source.index("<article>") + 9:source.index("</article>")]
    parts = re.split(r"</?(?:h1|p)>", inner)
    texts = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts)
    return "\n".join(t for t in texts if t)


@pytest.fixture(scope="module")
def pages():
    import pyarrow.parquet as pq

    if not os.path.exists(PAGES):
        pytest.skip("no test tables")
    return pq.read_table(PAGES).to_pylist()


@pytest.fixture(scope="module")
def model(pages):
    return html_extract.fit([p["html"] for p in pages[:100]])


def test_held_out_pages(pages, model):
    rest = [p["html"] for p in pages[100:]]
    assert html_extract.extract(model, rest) == [plain_article(h) for h in rest]


def test_made_layouts(pages, model):
    texts = [t for p in pages[100:] for _, t in dom.parse(p["html"]).blocks if len(t) > 20]
    maker, errors, nodes = html_extract.Maker([t.replace("<", " ").replace("&", " ") for t in texts], 1234), 0, 0
    for _ in range(200):
        page, labels = html_extract._made_labels(maker.page())
        kept = dom.decode(page, model.logit(np.array(dom.features(page))).tolist())
        errors += sum(a != bool(b) for a, b in zip(kept, labels))
        nodes += len(labels)
    assert errors < 0.01 * nodes


def test_defined_cases(model):
    got = html_extract.extract(model, [None, "", "plain &lt;text&gt;", "<p>a&nbsp;&#233;  b\n c", "<p>no <script>x('<p>')</script>yes<style>p{}</style>", "<<< & <p", "<ul><li>a<li>b</ul>" * 3])
    assert got[:4] == ["", "", "plain <text>", "a é b c"]
    assert got[4] == "no yes"
    assert html_extract.extract(model, ["<p>" + "w " * 300_000])[0].count("w") == 300_000


def test_parse():
    page = dom.parse("<div>a<p>b<b>c<br>d<p>e</div>f<table><tr><td>g<td>h<tr><td>i</table><h1>j</h1>&amp;")
    assert [t for _, t in page.blocks] == ["a", "bc d", "e", "f", "g", "h", "i", "j", "&"]
    assert [n.tag for n in page.nodes] == ["html", "div", "p", "p", "table", "tr", "td", "td", "tr", "td", "h1"]


def test_choice_is_the_best_consistent_one():
    rng = random.Random(1)
    for _ in range(40):
        n = rng.randint(2, 8)
        nodes = [dom.Node("html", -1, 0)]
        for i in range(1, n):
            p = rng.randrange(i)
            nodes.append(dom.Node("div", p, 0))
            nodes[p].children.append(i)
        logits = [rng.uniform(-3, 3) for _ in range(n)]

        def value(choice):
            return sum(-math.log1p(math.exp(-v if c else v)) for v, c in zip(logits, choice))

        every = [c for c in itertools.product([True, False], repeat=n) if c[0] and all(not c[i] or c[nodes[i].parent] for i in range(1, n))]
        best = max(map(value, every))
        assert value(dom.decode(dom.Page(nodes, []), logits)) == pytest.approx(best)


def test_boosting():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit_boosted(x[:2000], y[:2000])
    assert ((model.logit(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_rows(spark, model):
    rows = [(1, "u", "<article><h1>T</h1><p>one two three four five</p></article>", 9), (1, None, None, None), (None, "u", "", 1)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int"), model=model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.n_chars) for r in got.collect()) == [("1", 0), ("1", 25), ("None", 0)]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.main_text(empty, model=model).collect() == []


@pytest.mark.parametrize("n", [20, 60, 400])
def test_siblings_of_any_number(n):
    """The share of siblings of the same kind has no other rule for crowded parents."""
    page = dom.parse("<div>" + "<p>x</p><h2>y</h2><ul><li>z</li></ul><p>w</p>" * (n // 4) + "</div>")
    rows, same = dom.features(page), {"p": 0.5, "h2": 0.25, "ul": 0.25}
    shares = {(node.tag, row[10]) for node, row in zip(page.nodes, rows) if node.tag in same}
    assert shares == set(same.items())


def test_sample_of_one_id(spark):
    """The pages that teach do not depend on the order of the rows, however many share an id."""
    rows = [(1, f"<p>{i:04d}</p>") for i in range(900)]
    random.Random(3).shuffle(rows)
    make = lambda r: html_extract.sample(spark.createDataFrame(r, "page_id long, html string"), "page_id", "html")
    want = sorted(h for _, h in rows)[:html_extract.SAMPLE]
    assert make(rows) == make(rows[::-1]) == want


def test_fit_without_text():
    assert html_extract.extract(html_extract.fit([]), ["<p>x</p>"]) is not None


def test_elements_without_end():
    texts = lambda page: [t for _, t in dom.parse(page).blocks]
    assert texts("<article><p>one</p><button>b<p>two</p><p>three</p></article>") == ["one", "b", "two", "three"]
    assert texts("<p>one</p><audio src='x'/><p>two</p><video/><canvas/><p>three</p>") == ["one", "two", "three"]
    assert texts("<p>x <math><mi>a</mi><mo>+</mo><mi>b</mi></math> y</p>") == ["x a+b y"]
    assert texts("<article><noscript><p>n</p></noscript><object><p>o</p></object></article>") == ["n", "o"]
    assert texts("<p>a</p><select><option>1<option>2</select><svg><svg></svg><text>t</text></svg><p>b</p>") == ["a", "b"]
    assert texts("<p>a</p><button>x<button>y</button><p>c</p>") == ["a", "x", "c"]
    assert texts("<svg>" * 20_000 + "<p>q</p>" + "<button>" * 20_000) == ["q"]
