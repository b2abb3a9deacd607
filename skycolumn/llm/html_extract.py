"""Main text of web pages: boosted trees over DOM nodes and a consistent choice along the tree.

Fit. ``SAMPLE`` pages (the smallest hashes of their ids) teach in two ways. Pages that mark their article, menus and so on by
elements or attribute words are labelled by these marks. And the sample's paragraphs and menus are
dealt anew into ``MADE`` pages of many layouts whose parts are known, with and without telling names, also with notices,
adverts, forms and comments inside the article, so that density, links, depth and siblings count too.

Apply. Each page is parsed whole; its nodes get features (subtree density, attribute words, depth, siblings, ancestors), the
trees give each the odds to hold main text, and a pass over the tree finds the most likely choice in which nothing below
a dropped node is kept. The text is the kept blocks in page order, white space made one blank, joined by line ends.

Defined cases: NULL and empty pages give an empty text. Scripts, styles and form controls are never text;
those without an end tag, scripts and styles apart, and those closed by a slash are taken as empty.
Unclosed tags end where HTML ends them. Rows that repeat are pages of their own. Without any text in the sample made-up words stand in for it. An empty
table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycolumn.llm import dom
from skycolumn.llm.boosting import Boosted, fit_boosted

SAMPLE, SAMPLE_CHARS, MADE = 300, 100_000, 1400
BATCH_NODES = 4000
DROPPED = frozenset("menu head foot side notice ad form comment share".split())
DROPPED_TAGS = frozenset(("nav", "footer", "aside", "form"))


def weak_labels(page: dom.Page) -> list[int] | None:
    """1 for nodes on the way to or inside the article, 0 for marked boilerplate; None where a page marks no article."""
    nodes = page.nodes
    if not any(n.tag in ("article", "main") for n in nodes):
        return None
    inside, marked = [False] * len(nodes), [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        within = inside[n.parent]
        inside[i] = within or n.tag in ("article", "main")
        marked[i] = marked[n.parent] or n.tag in DROPPED_TAGS or n.tag == "header" and not within or bool(n.groups & DROPPED) and "content" not in n.groups
    label = [int(a and not b) for a, b in zip(inside, marked)]
    for i in range(len(nodes) - 1, 0, -1):  # ancestors of kept nodes are kept
        if label[i]:
            label[nodes[i].parent] = 1
    label[0] = 1
    return label


class Maker:
    """Pages of many layouts from given paragraphs, each part marked by ``k="1"`` (main text) or ``k="0"``."""

    def __init__(self, paragraphs: list[str], seed: int):
        self.rng, self.paragraphs = random.Random(seed), paragraphs

    def words(self, low: int, high: int) -> str:
        pool = self.rng.choice(self.paragraphs).split() or ["word"]
        n = self.rng.randint(low, high)
        return " ".join(self.rng.choices(pool, k=n)) if len(pool) < n else " ".join(pool[(s := self.rng.randrange(len(pool) - n + 1)):s + n])

    def open(self, *choices: str) -> tuple[str, str]:
        """``tag.word`` or ``tag#word`` or ``tag`` to its start (without the end of the tag) and its end."""
        pick = self.rng.choice(choices)
        for sign, name in ((".", "class"), ("#", "id")):
            if sign in pick:
                tag, word = pick.split(sign)
                return f'<{tag} {name}="{word}"', f"</{tag}>"
        return f"<{pick}", f"</{pick}>"

    def part(self, keep: int, inner: str, *choices: str) -> str:
        start, end = self.open(*choices)
        return f'{start} k="{keep}">{inner}{end}'

    def links(self, low: int, high: int, item: str = "li") -> str:
        return "".join(f'<{item} k="0"><a href="/x">{self.words(1, 3)}</a></{item}>' for _ in range(self.rng.randint(low, high)))

    def menu(self) -> str:
        inner = self.rng.choice([lambda: f'<ul k="0">{self.links(3, 9)}</ul>', lambda: " ".join(f'<a href="/x">{self.words(1, 2)}</a>' for _ in range(self.rng.randint(3, 8)))])()
        return self.part(0, inner, "nav", "nav.menu", "div.navbar", "div#navigation", "ul.menu", "div.breadcrumbs", "div")

    def header(self) -> str:
        return self.part(0, self.part(0, self.words(1, 4), "div.logo", "h1", "p", "div") + self.rng.choice(["", self.menu()]), "header", "div.header", "div#masthead", "div.topbar", "header.site-header")

    def footer(self) -> str:
        inner = self.rng.choice([f"&copy; {self.words(1, 3)} &middot; {self.words(3, 12)}", f'<p k="0">{self.words(4, 15)}</p>' + self.rng.choice(["", f'<ul k="0">{self.links(2, 6)}</ul>'])])
        return self.part(0, inner, "footer", "footer.site-footer", "div.footer", "div#colophon", "div.copyright")

    def prose(self, keep: int, low: int, high: int) -> str:
        return "".join(f'<p k="{keep}">{self.words(3, 60)}</p>' for _ in range(self.rng.randint(low, high)))

    def boiler(self) -> str:
        r = self.rng
        small = lambda: r.choice([self.words(1, 30), f'<p k="0">{self.words(2, 40)}</p>', f'<h3 k="0">{self.words(1, 4)}</h3>{self.prose(0, 1, 2)}'])
        controls = f'<label>{self.words(1, 3)}</label><input type="text"><input type="submit">'
        return r.choice([
            lambda: self.part(0, small(), "div.ad", "div.ads", "aside.advert", "div.sponsored", "div.promo", "div#ad-slot", "section.advertisement"),
            lambda: self.part(0, small() + r.choice(["", f'<ul k="0">{self.links(3, 8)}</ul>']), "aside", "div.sidebar", "div#secondary", "div.widget", "aside.sidebar"),
            lambda: self.part(0, small() + r.choice(["", "<button>x</button>"]), "div.cookie-notice", "div#consent", "div.notice", "div.alert", "section.gdpr-banner", "div.popup", "div.cookie-banner", "dialog"),
            lambda: self.part(0, f'<p k="0">{self.words(3, 12)}</p>{controls}', "form", "form.search", "div.newsletter", "div.subscribe", "form.login", "div.search-form"),
            lambda: self.part(0, f'<h3 k="0">{self.words(1, 3)}</h3>' + "".join(self.part(0, f'<p k="0">{self.words(1, 3)}</p>{self.prose(0, 1, 2)}', "div.comment", "li.comment", "article.comment", "div") for _ in range(r.randint(1, 6))),
                              "section#comments", "div.comments", "div#comments", "section.reader-comments", "div.comment-list", "ol.commentlist"),
            lambda: self.part(0, f'<h3 k="0">{self.words(1, 3)}</h3><ul k="0">{self.links(2, 6)}</ul>', "div.related", "section.recommended", "div.share", "div.social"),
        ])()

    def article(self) -> str:
        r, parts = self.rng, [f'<h1 k="1">{self.words(1, 12)}</h1>'] if self.rng.random() < 0.8 else []
        if r.random() < 0.3:
            parts.append(f'<p k="1"><b>{self.words(5, 40)}<br>')
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            parts.append(r.choice([
                lambda: f'<p k="1">{r.choice(self.paragraphs)[:2000]}</p>', lambda: f'<p k="1">{self.words(1, 80)}</p>', lambda: f'<p k="1">{self.words(1, 80)}</p>', lambda: f'<p k="1">{self.words(1, 6)}</p>',
                lambda: f'<h2 k="1">{self.words(1, 8)}</h2>', lambda: f'<p k="1">{self.words(5, 30)} <a href="/x">{self.words(1, 4)}</a> {self.words(3, 20)}</p>',
                lambda: '<ul k="1">' + "".join(f'<li k="1">{self.words(3, 15)}</li>' for _ in range(r.randint(2, 5))) + "</ul>",
                lambda: f'<blockquote k="1"><p k="1">{self.words(8, 40)}</p></blockquote>', lambda: f'<div k="1">{self.words(10, 60)}</div>', lambda: f'<pre k="1">{self.words(3, 30)}</pre>',
                lambda: f'<table k="1"><tr k="1"><td k="1">{self.words(1, 5)}</td><td k="1">{self.words(1, 5)}</td></tr></table>'])())
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            parts.insert(r.randint(0, len(parts)), r.choice([self.boiler, self.boiler, self.boiler, self.menu, self.footer])())
        return self.part(1, "".join(parts), "article", "article", "main", "div.content", "div#content", "div.post-body", "section.entry", "div.article-text", "div", "section")

    def page(self) -> str:
        r = self.rng
        outer = [self.header] * (r.random() < 0.5) + [self.menu] * (r.random() < 0.6) + [self.boiler] * r.randint(0, 2)
        after = [self.boiler] * r.randint(0, 3) + [self.footer] * (r.random() < 0.8)
        body = "".join(f() for f in outer) + self.article() + "".join(f() for f in after)
        for _ in range(r.randint(0, 2)):
            body = self.part(1, body, "div", "div.wrapper", "div#page", "div.container")
        return f"<html><body>{body}</body></html>"


def _made_labels(source: str) -> tuple[dom.Page, list[int]]:
    """The page without the marks, and the marks in the order of its nodes."""
    import re

    marks = [int(m) for m in re.findall(r' k="([01])"', source)]
    page = dom.parse(re.sub(r' k="[01]"', "", source))
    blocks = [i for i, n in enumerate(page.nodes) if i]
    if len(blocks) != len(marks):
        return page, []
    return page, [1, *marks]


def fit(htmls: list[str], seed: int = 5) -> Boosted:
    rows: list[list[float]] = []
    labels: list[int] = []
    paragraphs: list[str] = []
    for source in htmls:
        page = dom.parse(source)
        known = weak_labels(page)
        paragraphs += [t for i, t in page.blocks if len(t) >= 20]
        if known:
            rows += dom.features(page)
            labels += known
    if not paragraphs:
        filler = random.Random(seed)
        paragraphs = [" ".join("".join(filler.choices("aeioulnrstd", k=filler.randint(2, 9))) for _ in range(filler.randint(5, 80))) + "." for _ in range(200)]
    maker = Maker([p.replace("<", " ").replace("&", " ") for p in sorted(set(paragraphs))], seed)
    for _ in range(MADE):
        page, known = _made_labels(maker.page())
        if known:
            rows += dom.features(page)
            labels += known
    return fit_boosted(np.array(rows, dtype=np.float64), np.array(labels, dtype=np.float64), trees=80, depth=5)


def extract(model: Boosted, htmls: list[str | None]) -> list[str]:
    """Main texts; pages are scored together."""
    pages = [dom.parse(h) if h else None for h in htmls]
    rows = [r for p in pages if p for r in dom.features(p)]
    logits = model.logit(np.array(rows, dtype=np.float64)).tolist() if rows else []
    out, at = [], 0
    for p in pages:
        if p is None:
            out.append("")
            continue
        kept = dom.decode(p, logits[at:at + len(p.nodes)])
        at += len(p.nodes)
        out.append("\n".join(t for i, t in p.blocks if kept[i]))
    return out


def sample(pages: DataFrame, page_id: str, html: str) -> list[str]:
    """At most ``SAMPLE`` pages of at most ``SAMPLE_CHARS`` characters: those with the smallest hashes of their ids, of pages with the same id
    the smallest texts."""
    rows = pages.select(F.xxhash64(F.col(f"`{page_id}`"), F.lit(9)).alias("h"), F.col(f"`{html}`").cast("string").alias("html"))
    rows = rows.filter(F.length("html").between(1, SAMPLE_CHARS))
    edge = [r["h"] for r in rows.select("h").orderBy("h").limit(SAMPLE).collect()]
    return sorted(r["html"] for r in rows.filter(F.col("h") <= edge[-1]).orderBy("h", "html").limit(SAMPLE).collect()) if edge else []


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", model: Boosted | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    model = model or fit(sample(pages, page_id, html))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, size = 0, [], 0
            for k, value in enumerate(batch.column(2)):
                held.append(value.as_py())
                size += held[-1].count("<") if held[-1] else 0
                if size >= BATCH_NODES or k == batch.num_rows - 1:
                    texts = extract(model, held)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), batch.column(1).slice(at, len(held)), pa.array(texts, pa.string()),
                                                      pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                    at, held, size = k + 1, [], 0

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
