"""Main text of web pages by tree scoring.

Blocks of text pass points for their length and commas to the containers above them, link-heavy containers are
discounted, and the best container is kept: the whole of the outermost article or main element around it, or else with
those siblings that read like it. Menus, headers, footers and the like are known by element, role or class and never scored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.llm.common import slices

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title noscript template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = HEADING | frozenset("p pre li dd dt td th tr tbody thead tfoot caption figcaption blockquote summary".split())
BOILERPLATE = frozenset("aside button canvas datalist dialog footer form head input label menu nav object optgroup option search select".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words in class and id names that mark what surrounds an article.
MARKS = frozenset(
    "ad ads adbox adsbygoogle adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead "
    "menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip "
    "social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
WRAPS = frozenset("has no not with without".split())
GOOD = frozenset("article body content entry main post story text".split())
CLOSES = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dd": ("dd dt", {"dl"}), "dt": ("dd dt", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
CLOSES |= {t: ("thead tbody tfoot tr td th", {"table"}) for t in ("thead", "tbody", "tfoot")}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))?+|=)*+)>")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PIECE = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("chars", "good", "links", "parent", "score", "tag")

    def __init__(self, tag: str, parent: int, good: bool) -> None:
        self.tag, self.parent, self.good = tag, parent, good
        self.score, self.chars, self.links = 0.0, 0, 0


def _marks(attributes: str) -> tuple[bool, bool]:
    """Whether attributes mark boilerplate, and whether they speak for content."""
    bad = good = False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            bad = True
        elif name == "role":
            bad |= value.strip().lower() in ROLES
        elif name in ("class", "id"):
            for phrase in value.split():
                words = {w.lower() for w in PIECE.findall(phrase)}
                bad |= bool(words & MARKS) and not words & WRAPS
                good |= bool(words & GOOD)
    return bad, good


def _parse(html: str, lenient: bool) -> tuple[list[Node], list[tuple[int, str, int]]]:
    """Block-level tree, and the text blocks in page order as (node, text, characters in links). lenient: forms and marked elements count too."""
    nodes, blocks = [Node("", -1, False)], []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, True, False)]  # tag, node, block-level, dropped
    # depths at which tags are open, and those of block-level ones: no search walks the stack
    depths: defaultdict[str, list[int]] = defaultdict(list)
    block_depths = [0]
    parts: list[str] = []
    linked = links = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                blocks.append((stack[-1][1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop(depth: int) -> None:
        nonlocal links
        if any(x[2] for x in stack[depth:]):
            end_block()
        for tag, _, block, _ in stack[depth:]:
            depths[tag].pop()
            links -= tag == "a"
            if block:
                block_depths.pop()
        del stack[depth:]

    def nearest(tags: Iterable[str]) -> int:
        return max((depths[t][-1] for t in tags if depths[t]), default=0)

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1][3]:
            raw = unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if links:
                linked += len(raw.strip())

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        text(html[at:lt])
        if html.startswith("<!--", lt):
            at = html.find("-->", lt + 4)
            at = size if at < 0 else at + 3
            continue
        m = TAG.match(html, lt)
        if not m:
            if html[lt + 1 : lt + 2] in ("!", "?") or re.match("</?[a-zA-Z]", html[lt : lt + 3]):
                at = html.find(">", lt)
                at = size if at < 0 else at + 1
            else:
                text("<")
                at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if not depths[tag] or tag in ("html", "body"):
                if tag in BLOCK:
                    end_block()
            elif tag in BLOCK or block_depths[-1] <= depths[tag][-1]:  # formatting doesn't close blocks
                pop(depths[tag][-1])
            continue
        if tag in RAW:
            if tag in BLOCK:
                end_block()
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                gt = html.find(">", close.end()) if close else -1
                at = size if gt < 0 else gt + 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in BLOCK
        if block:
            if depths["p"] and depths["p"][-1] > nearest(("td", "th", "caption", "button", "object")):
                pop(depths["p"][-1])
            if tag in CLOSES:
                closed, scope = CLOSES[tag]
                floor = nearest(scope)
                if tag in ("tr", "thead", "tbody", "tfoot"):  # all that is open
                    found = [depths[t][k] for t in closed.split() if (k := bisect_right(depths[t], floor)) < len(depths[t])]
                    depth = min(found, default=0)
                else:
                    depth = nearest(closed.split())
                if depth > floor:
                    pop(depth)
            end_block()
        if tag in VOID:
            continue
        bad, good = _marks(m[3]) if m[3] else (False, False)
        top = stack[-1]
        bad = tag in BOILERPLATE and not (lenient and tag == "form") or bad and not lenient and tag not in ("html", "body", "main")
        if tag == "header":  # of the page; an article's own has its headline
            bad |= not (depths["article"] or depths["main"])
        node = top[1]
        if block and not (top[3] or bad):
            nodes.append(Node(tag, node, good))
            node = len(nodes) - 1
        depths[tag].append(len(stack))
        if block:
            block_depths.append(len(stack))
        stack.append((tag, node, block, top[3] or bad))
        links += tag == "a"
    end_block()
    return nodes, blocks


def _within(nodes: list[Node], roots: set[int]) -> list[bool]:
    out = [False] * len(nodes)
    for i, n in enumerate(nodes):
        out[i] = i in roots or n.parent >= 0 and out[n.parent]
    return out


def _select(nodes: list[Node], blocks: list[tuple[int, str, int]]) -> list[str]:
    for i, s, links in blocks:
        n = nodes[i]
        n.chars += len(s)
        n.links += links
        points = (1 + s.count(",") + s.count("，") + min(len(s) / 100, 3)) * (1 - links / len(s)) if len(s) >= 25 else 0.2
        k = i
        while nodes[k].tag in PARAGRAPH and nodes[k].parent >= 0:
            k = nodes[k].parent
        for share in (1, 1 / 2, 1 / 6, 1 / 9):
            nodes[k].score += points * share
            k = nodes[k].parent
            if k < 0:
                break
    for n in reversed(nodes):
        if n.parent >= 0:
            nodes[n.parent].chars += n.chars
            nodes[n.parent].links += n.links

    def value(n: Node) -> float:
        if not n.chars or n.tag in HEADING:
            return 0.0
        prior = 25 * (n.tag in ("article", "main")) + 5 * (n.tag in ("div", "section")) + 15 * n.good
        return (n.score + prior * min(1, n.chars / 200)) * (1 - n.links / n.chars)

    best = max(range(len(nodes)), key=lambda i: (value(nodes[i]), -i))
    most, top, k = value(nodes[best]), best, best
    while k > 0:
        if nodes[k].tag in ("article", "main"):
            top = k
        k = nodes[k].parent
    roots = {top}
    if nodes[top].tag not in ("article", "main"):
        for i, n in enumerate(nodes):
            if n.parent == nodes[top].parent and i != top and n.chars:
                density = n.links / n.chars
                if n.tag in ("h1", "h2") and i < top or value(n) >= max(10, 0.2 * most) and n.tag not in ("ul", "ol") or n.tag == "p" and (n.chars > 80 and density < 0.25):
                    roots.add(i)
    # lists of links go, but not an article's own; the header's small print goes
    whole = _within(nodes, {i for i, n in enumerate(nodes) if n.tag in ("article", "main")})
    dropped = {i for i, n in enumerate(nodes) if i not in roots and not whole[i] and n.tag in ("ul", "ol", "div", "section", "table") and n.chars and n.links / n.chars > 0.66}
    kept, out = _within(nodes, roots), _within(nodes, dropped)
    header = _within(nodes, {i for i, n in enumerate(nodes) if n.tag == "header"})
    return [s for i, s, _ in blocks if kept[i] and not out[i] and (not header[i] or nodes[i].tag in HEADING)]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, joined by two line feeds; empty if there is none."""
    if not html:
        return ""
    for lenient in (False, True):
        nodes, blocks = _parse(html, lenient)
        if blocks and (found := _select(nodes, blocks)):
            return "\n\n".join(found)
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """pages: html and any others. Returns the other columns as a struct `row`, with text and n_chars (code points).

    The whole html is read. Null and empty html give an empty text; repeated rows are extracted each.
    """
    packed = pages.select(F.struct(*[c for c in pages.columns if c != "html"]).alias("row"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts = [main_text(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["row", "text", "n_chars"])

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
