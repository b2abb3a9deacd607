"""A forgiving reader of HTML: block elements as nodes, their text as blocks, features of each node."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

# Element names of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Text up to the end tag is no markup; what is inside the second kind is not part of a text. The third kind may be closed by a slash.
RAW = frozenset("script style title textarea xmp iframe noembed noframes head".split())
SKIPPED = frozenset("template svg select button canvas audio video annotation annotation-xml".split())
SLASHED = frozenset("svg math iframe audio video canvas object button select template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub "
                   "sup time tt u var math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mpadded mfenced semantics".split())
CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",)}
SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|aria-label|style|type|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Words in class, id, role and label attributes, by what they mark.
GROUPS: dict[str, frozenset[str]] = {k: frozenset(v.split()) for k, v in {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc sitemap tabs skip",
    "head": "header masthead topbar banner logo branding top hero",
    "foot": "footer foot colophon copyright bottom legal imprint credits",
    "side": "sidebar aside side rail widget widgets secondary complementary column",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay toast privacy paywall warning disclaimer message",
    "ad": "ad ads adsbygoogle adslot advert adverts advertisement advertising sponsor sponsored promo promotion promoted affiliate dfp teaser outbrain taboola",
    "form": "form search searchbox newsletter subscribe subscription signup login register contact",
    "comment": "comment comments commentlist respond reply replies discussion disqus feedback reviews review response responses reader",
    "share": "share sharing social follow related recommended recommendations more trending popular tags tag author bio byline",
    "content": "article content post entry main story body text articlebody page primary prose",
}.items()}
NAMES = list(GROUPS)
TAGS = ["p", "heading", "list", "item", "div", "section", "article", "nav", "header", "footer", "aside", "form", "table", "cell", "quote", "body", "other"]
_TAG_OF = {"p": "p", **{f"h{i}": "heading" for i in range(1, 7)}, **dict.fromkeys(("ul", "ol", "dl", "menu"), "list"), **dict.fromkeys(("li", "dt", "dd"), "item"), "div": "div",
           "section": "section", "article": "article", "main": "article", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside",
           **dict.fromkeys(("form", "fieldset", "dialog"), "form"), **dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr"), "table"), **dict.fromkeys(("td", "th", "caption"), "cell"),
           **dict.fromkeys(("blockquote", "pre", "figure", "figcaption", "address", "details", "summary"), "quote"), **dict.fromkeys(("html", "body"), "body")}


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    groups: frozenset[str] = frozenset()
    hidden: bool = False
    children: list[int] = field(default_factory=list)
    text: int = 0        # characters of the node's own blocks
    link: int = 0        # of these, in links
    blocks: int = 0
    stops: int = 0       # sentence punctuation
    tags: int = 1        # elements, inline ones included
    inputs: int = 0
    before: int = 0      # characters of the page before the node
    paragraphs: int = 0


@dataclass(slots=True)
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str]]   # (node, text) in page order


def _groups(attributes: str) -> tuple[frozenset[str], bool]:
    words, hidden = set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif name in ("class", "id", "role", "aria-label", "itemprop"):
            words.update(w.lower() for w in _WORD.findall(value))
    return frozenset(k for k, v in GROUPS.items() if not v.isdisjoint(words)), hidden


def _ends(source: str, tag: str) -> dict[int, int]:
    """Where the elements of a skipped kind begin and end. One without an end tag before the next of its kind opens (but for those
    that nest) is not among them: it is taken as empty."""
    out: dict[int, int] = {}
    opened: list[int] = []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*>", source, re.I):
        if m[1]:
            if opened:
                out[opened.pop()] = m.end()
        elif not m[0].endswith("/>"):
            if tag not in ("svg", "template"):
                opened.clear()
            opened.append(m.start())
    return out


def parse(source: str) -> Page:
    """Nodes are block elements (node 0 stands for the page); inline elements only add to their block."""
    nodes, blocks = [Node("html", -1, 0)], []
    stack: list[tuple[str, int]] = [("html", 0)]  # (tag, node); an inline element has the node of its block
    run: list[str] = []
    links, link_chars, seen, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal link_chars, seen
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                node = nodes[stack[-1][1]]
                blocks.append((stack[-1][1], text))
                node.text += len(text)
                node.link += min(link_chars, len(text))
                node.blocks += 1
                node.stops += text.count(".") + text.count(",") + text.count(";")
                seen += len(text)
        link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            run.append(text)
            if links:
                link_chars += len(text.strip())

    def close_to(depth: int) -> None:
        nonlocal links
        if any(t not in INLINE for t, _ in stack[depth:]):
            flush()
        links -= sum(t == "a" for t, _ in stack[depth:])
        del stack[depth:]

    def find(tags: tuple[str, ...], stop: tuple[str, ...]) -> int | None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in stop:
                return None
        return None

    position, ends = 0, {}
    while (m := _TOKEN.search(source, position)) is not None:
        add(source[at:m.start()])
        at = position = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending, attributes = bool(m[1] or m[4]), m[3] if m[2] else m[6]
        node = nodes[stack[-1][1]]
        if ending:
            if tag == "br":
                run.append(" ")
            elif tag not in VOID and tag not in ("html", "body"):
                depth = None
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        depth = k
                        break
                    if tag in INLINE and stack[k][0] not in INLINE:
                        break
                if depth is not None:
                    close_to(depth)
            continue
        node.tags += 1
        if tag in ("textarea", "select", "button"):
            node.inputs += 1
        if tag in SLASHED and attributes.endswith("/"):
            continue
        if tag in RAW:
            if tag == "head":  # ends with its end tag or where the body begins
                end = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(source, position)
                if end is None:
                    continue
            else:
                end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(source, position)
            at = position = end.end() if end else len(source)
        elif tag in SKIPPED:
            if tag not in ends:
                ends[tag] = _ends(source, tag)
            at = position = ends[tag].get(m.start(), position)
        elif tag in VOID:
            if tag in ("br", "hr", "wbr"):
                if tag != "wbr":
                    run.append(" ")
                if tag == "hr":
                    flush()
            elif tag == "input":
                node.inputs += 1
        elif tag in ("html", "body"):
            groups, _ = _groups(attributes)
            nodes[0].groups |= groups
        elif tag in INLINE:
            stack.append((tag, stack[-1][1]))
            links += tag == "a"
        else:
            paragraph = find(("p",), ("table", "td", "th", "button", "object"))
            if paragraph is not None:
                close_to(paragraph)
            if tag in CLOSES:
                open_ = find(SAME.get(tag, (tag,)), CLOSES[tag])
                if open_ is not None:
                    close_to(open_)
            elif _TAG_OF.get(tag) == "heading" and _TAG_OF.get(stack[-1][0]) == "heading":
                close_to(len(stack) - 1)
            flush()
            parent = stack[-1][1]
            groups, hidden = _groups(attributes) if attributes else (frozenset(), False)
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, groups, hidden, before=seen))
            nodes[parent].children.append(len(nodes) - 1)
            stack.append((tag, len(nodes) - 1))
    add(source[at:])
    flush()
    return Page(nodes, blocks)


def features(page: Page) -> list[list[float]]:
    """One row per node, from the node, its subtree, its siblings and its ancestors."""
    nodes = page.nodes
    total: list[list[int]] = [[n.text, n.link, n.blocks, n.stops, n.tags, n.inputs, int(n.tag == "p")] for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        up, own = total[nodes[i].parent], total[i]
        for k in range(7):
            up[k] += own[k]
    all_text = max(1, total[0][0])
    above: list[tuple[frozenset[str], bool]] = []
    alike = Counter((n.parent, n.tag) for n in nodes)
    rows = []
    for i, n in enumerate(nodes):
        text, link, blocks, stops, tags, inputs, paragraphs = total[i]
        if i:
            parent = nodes[n.parent]
            groups, inside = above[n.parent]
            above.append((groups | n.groups, inside or _TAG_OF.get(n.tag) == "article"))
            place, count, same, share, over = n.before / all_text, len(parent.children), alike[n.parent, n.tag], text / max(1, total[n.parent][0]), _TAG_OF.get(parent.tag, "other")
        else:
            groups, inside, same, place, count, share, over = frozenset(), False, 1, 0.0, 1, 1.0, "other"
            above.append((n.groups, False))
        kind = _TAG_OF.get(n.tag, "other")
        rows.append([
            n.depth, math.log1p(text), link / max(1, text), text / tags, math.log1p(paragraphs), text / max(1, blocks), text / all_text, share, place, count, same / count,
            stops / max(1, text), math.log1p(n.text), inputs, float(inside), float(n.hidden),
            *[float(kind == t) for t in TAGS], *[float(over == t) for t in TAGS], *[float(g in n.groups) for g in NAMES], *[float(g in groups) for g in NAMES]])
    return rows


def decode(page: Page, logits: list[float]) -> list[bool]:
    """The most likely keep or drop of every node such that whatever lies below a dropped node is dropped."""
    nodes = page.nodes
    keep = [-math.log1p(math.exp(-max(-30.0, min(30.0, v)))) for v in logits]
    drop = [-math.log1p(math.exp(max(-30.0, min(30.0, v)))) for v in logits]
    all_dropped, best = drop[:], keep[:]
    chosen = [True] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        chosen[i] = best[i] >= all_dropped[i]
        if i:
            up = nodes[i].parent
            all_dropped[up] += all_dropped[i]
            best[up] += best[i] if chosen[i] else all_dropped[i]
    chosen[0] = True
    for i in range(1, len(nodes)):
        chosen[i] = chosen[i] and chosen[nodes[i].parent]
    return chosen
