"""HTML extraction by tag-path ratios.

Each page is parsed once into text blocks, each with its root-to-leaf path of
block-level tags. Per path the text length, the punctuation and the number of
nodes are aggregated; the two ratios (length and punctuation per node) are
smoothed over neighbouring paths, weighted by how much of the path they share,
and fused by their geometric mean. Paths whose fused ratio reaches a share of
the deviation over the page's nodes hold content. The innermost element that holds
all content (or all articles, if they have half of the content) is the article;
its blocks are returned in page order, without boilerplate elements (menus,
forms, adverts, notices, comments) and without links off the paths with content.

Scale: pages are mapped one by one; nothing is shuffled or broadcast. Parsing is
linear in the page.

Defined cases: a null or empty page gives an empty text. A page without tags is
one block. Broken markup is read as it stands: unclosed elements end with their
parent, an unclosed tag at the end is dropped, unclosed comments, scripts and
styles run to the end. Repeated rows give repeated results. Other columns pass
through.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import small_batches

#: A path holds content from this share of the deviation of fused ratios on.
LAMBDA = 0.8
#: Paths to each side that smooth a path.
SMOOTH = 2
#: Blocks in the article with more link text than this, on paths without content, aren't content.
LINK_SHARE = 0.6

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_GONE = frozenset("script style textarea title iframe noembed noframes head noscript template svg math canvas object audio video select datalist button nav footer aside form menu dialog".split())
_CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("article aside body blockquote button details div fieldset figure footer form header html main nav section table td th caption li".split())
#: Elements of these tags end where one of these starts, up to the boundary tags.
_ENDS_BY = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "body": (("head",), ("html",))}
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tooltip".split())
#: Words in a class or id that mark boilerplate.
_MARKS = re.compile(
    r"ad|ads|adv|advert\w*|adsense|adslot|adunit|banner|breadcrumbs?|byline|captcha|comments?|commentlist|consent|cookies?|copyright|disqus|dropdown|footer|gdpr|legal|login|menu|modal|nav|navbar|navigation|newsletter|notices?|overlay|pager|pagination|paywall|popup|promos?|promotion|rail|recommended|related|replies|reply|respond|responses|search|shar(?:e|ing)|sidebar|signup|skip|social|sponsor(?:s|ed)?|subscribe|subscription|tagcloud|teaser|toolbar|tooltip|trending|widget"
)
_HEADS = re.compile(r"header|masthead|head|topbar")
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WHITE = re.compile(r"\s+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTED = re.compile(r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>""")
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？؟،·]")


@dataclass
class Node:
    tag: str
    parent: int
    gone: bool
    path: int  # of the block-level tags down to here


@dataclass
class Block:
    node: int
    path: int
    gone: bool
    text: str
    linked: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node("", -1, False, 0)])
    paths: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    blocks: list[Block] = field(default_factory=list)


def _boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _GONE or tag == "header" and not in_article:
        return True
    if not attrs.strip():
        return False
    marks: list[str] = []
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return tag not in ("html", "body")
        if name == "role" and value.lower() in _ROLES:
            return tag not in ("html", "body")
        if name in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in _SPLIT.split(token) if w]
                if not {"has", "with", "no", "without", "content", "article", "main", "page", "layout", "wrapper", "body"} & set(words):
                    marks += words
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return any(w.startswith(("comment", "ad", "promo", "teaser", "related")) and _MARKS.fullmatch(w) for w in marks)
    return any(_MARKS.fullmatch(w) or not in_article and _HEADS.fullmatch(w) for w in marks)


def parse(html: str) -> Page:
    page, path_ids = Page(), {(): 0}
    nodes, stack = page.nodes, [0]
    pieces: list[str] = []
    linked, links, articles = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _WHITE.sub(" ", "".join(pieces)).strip()
            if text:
                at = nodes[stack[-1]]
                k = stack[-1]
                while nodes[k].tag in _INLINE and nodes[k].parent > 0:
                    k = nodes[k].parent
                page.blocks.append(Block(k, at.path, at.gone, text, linked))
            pieces.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links, articles
        for k in stack[depth:]:
            links -= nodes[k].tag == "a"
            articles -= nodes[k].tag in ("article", "main")
        del stack[depth:]

    def close(tags: tuple[str, ...], bounds: frozenset[str] | tuple[str, ...]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[depth]].tag
            if tag in tags:
                flush()
                pop_to(depth)
                return
            if tag in bounds:
                return

    def add(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            linked += len(text.strip())

    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        if lt > at:
            add(html[at:lt])
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        following = html[lt + 1 : lt + 2]
        if following in ("!", "?"):
            stop = html.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = _NAME.match(html, lt + 1 + (following == "/"))
        if not m:
            add("<")
            at = lt + 1
            continue
        tag = m[0].lower()
        q = _QUOTED.match(html, m.end())
        stop = q.end() if q else html.find(">", m.end()) + 1
        if stop <= 0:
            break
        at = stop
        if following == "/":
            if tag not in _INLINE:
                flush()
            for depth in range(len(stack) - 1, 0, -1):
                own = nodes[stack[depth]].tag
                if own == tag:
                    pop_to(depth)
                    break
                if tag in _INLINE and own in _SCOPE or tag == "p" and own in _SCOPE:
                    break
            continue
        if tag not in _INLINE:
            flush()
        elif tag == "br":
            add(" ")
        if tag in _CLOSES_P:
            close(("p",), _SCOPE)
        if tag in _ENDS_BY:
            close(*_ENDS_BY[tag])
        if tag == "a":
            close_inline = next((d for d in range(len(stack) - 1, 0, -1) if nodes[stack[d]].tag == "a"), 0)
            if close_inline and all(nodes[k].tag in _INLINE for k in stack[close_inline:]):
                pop_to(close_inline)
        if tag in _VOID or html[stop - 2] == "/" and tag not in _RAW and tag in ("path", "use", "circle", "rect"):
            continue
        if tag in _RAW:
            close_at = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            if not close_at:
                at = end
            else:
                stop = html.find(">", close_at.start())
                at = end if stop < 0 else stop + 1
            continue
        up = nodes[stack[-1]]
        path = up.path
        if tag not in _INLINE:
            key = (*page.paths[path], tag)
            path = path_ids.get(key)
            if path is None:
                path = path_ids[key] = len(page.paths)
                page.paths.append(key)
        gone = up.gone or _boilerplate(tag, html[m.end() : stop - 1], articles > 0)
        nodes.append(Node(tag, stack[-1], gone, path))
        stack.append(len(nodes) - 1)
        links += tag == "a"
        articles += tag in ("article", "main")
    flush()
    return page


def path_scores(page: Page, smooth: int = SMOOTH) -> dict[int, float]:
    """Fused, smoothed ratios of the paths that have text."""
    length: dict[int, int] = {}
    points: dict[int, int] = {}
    count: dict[int, int] = {}
    for b in page.blocks:
        if not b.gone:
            length[b.path] = length.get(b.path, 0) + max(0, len(b.text) - b.linked)
            points[b.path] = points.get(b.path, 0) + (len(_PUNCT.findall(b.text)) if b.linked < len(b.text) else 0)
            count[b.path] = count.get(b.path, 0) + 1
    order = list(length)
    ratios = [(length[p] / count[p], points[p] / count[p]) for p in order]

    def near(a: tuple[str, ...], b: tuple[str, ...]) -> float:
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
        return math.exp(-((len(a) + len(b) - 2 * same) ** 2) / 2)

    scores = {}
    for i, p in enumerate(order):
        around = [(near(page.paths[p], page.paths[order[j]]) * (1.0 if i == j else 0.5), j) for j in range(max(0, i - smooth), min(len(order), i + smooth + 1))]
        total = sum(w for w, _ in around)
        text = sum(w * ratios[j][0] for w, j in around) / total
        punct = sum(w * ratios[j][1] for w, j in around) / total
        scores[p] = math.sqrt(text * (1 + punct))
    return scores


def select(page: Page, lam: float = LAMBDA) -> list[Block]:
    blocks = [b for b in page.blocks if not b.gone]
    if not blocks:
        return []
    scores = path_scores(page)
    values = [scores[b.path] for b in blocks]
    mean = sum(values) / len(values)
    limit = lam * math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    over = {id(b) for b, v in zip(blocks, values, strict=True) if v >= limit}
    content = [b for b in blocks if id(b) in over and b.linked <= LINK_SHARE * len(b.text)] or blocks

    def ups(k: int) -> list[int]:
        """k and the elements that hold it, outermost first."""
        out = []
        while k >= 0:
            out.append(k)
            k = page.nodes[k].parent
        return out[::-1]

    def within(tags: tuple[str, ...]) -> dict[int, int]:
        """Content text of the outermost elements of these tags."""
        mass: dict[int, int] = {}
        for b in content:
            k = next((k for k in ups(b.node) if page.nodes[k].tag in tags), 0)
            if k:
                mass[k] = mass.get(k, 0) + len(b.text)
        return mass

    total = sum(len(b.text) for b in content)
    held = next((m for m in map(within, (("article",), ("main",))) if m and 2 * sum(m.values()) >= total), None)
    article, *others = map(ups, held or [b.node for b in content])
    for o in others:
        article = article[: next((k for k, (x, y) in enumerate(zip(article, o)) if x != y), min(len(article), len(o)))]  # noqa: B905
    regions = set(held or article[-1:])
    out = []
    for b in blocks:
        around = ups(b.node)
        plain = b.linked <= LINK_SHARE * len(b.text) and not regions.isdisjoint(around)
        if plain or id(b) in over and article[-1] in around:
            out.append(b)
    return out


def extract_text(html: str | None) -> str:
    return "\n".join(b.text for b in select(parse(html))) if html else ""


def main_text(html: Column) -> Column:
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([extract_text(v.as_py()) for v in values], pa.string())

    return run(html)


def extract(pages: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with the main text of each page."""
    return small_batches(pages).withColumn(out_col, main_text(F.col(html_col)))
