"""Main text of web pages by tree scoring.

Each paragraph passes points, for its length and its commas, to its parent, half of them to the next ancestor, a quarter
to the one above, and so on. A container's points are discounted by its link density. The best container is kept with
those of its siblings that have a fair share of its points, are alike in element and class, or are prose or headings by
themselves; where it lies in an article element, that element is kept.

Subtrees that are navigation, notices, adverts, forms, comments and so forth by element or role are left out
beforehand. A class or id that says so only raises a suspicion, for layouts use the same words (``has-sidebar``,
``comments-open``): an element so named is left out unless another of its classes names content, the word is part of a
layout's name, it holds an article, or it holds at least half of the page's prose.

Null and empty pages give empty text. Markup may be broken: unclosed elements end where HTML says they do, and what is
left open ends with the page. Repeated rows each get a row; other columns pass through, and columns named text and
n_chars are replaced. The tree is walked without recursion and in time in proportion to the page, so nesting may be deep.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import small_batches, table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "noembed", "noframes", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption br hr option select button".split())
_CLOSES_P = _BLOCK - frozenset(["br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "head", "option", "select", "button"])
_CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("html body table td th article section div main aside nav header footer form li".split())
_DROPPED = frozenset("nav aside footer header form fieldset button select option menu dialog head object embed canvas".split())
_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
_DROPPED_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs combx comment commentlist comments consent cookie cookies disqus disclaimer footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies respond rss share sharing shoutbox sidebar signup skyscraper social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
_COMMENT_WORDS = frozenset("comment commentlist comments disqus replies respond shoutbox".split())
_PLAIN_WORDS = frozenset("ad ads advert adverts banner comment comments cookie cookies footer menu nav navigation newsletter notice promo related sidebar widget".split())
_LAYOUT_WORDS = frozenset("no not has have with without hide hides open closed layout enabled disabled".split())
_GOOD_WORDS = frozenset("article body content entry hentry main page post story text blog".split())
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_COMMA = re.compile(r"[,،、，]")


class _Node:
    __slots__ = ("tag", "attrs", "parent", "parts", "order")

    def __init__(self, tag: str, attrs: str, parent: _Node | None, order: int) -> None:
        self.tag, self.attrs, self.parent, self.order = tag, attrs, parent, order
        self.parts: list[_Node | str] = []


def parse(page: str) -> list[_Node]:
    """The page's elements in page order, the root first."""
    root = _Node("#root", "", None, 0)
    nodes, stack, at = [root], [root], 0
    is_open: Counter[str] = Counter()
    is_open: Counter[str] = Counter()

    def text(s: str) -> None:
        if s:
            stack[-1].parts.append(s)

    def close(tags: frozenset | set, stop: frozenset | set) -> None:
        if not any(is_open[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                is_open.subtract(x.tag for x in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            text(html.unescape(page[at:]))
            return nodes
        text(html.unescape(page[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"])
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "br":
                text("\n")
            elif tag not in _VOID:
                close({tag}, _SCOPE - {tag} if tag not in _SCOPE else frozenset())
            continue
        if tag in _CLOSES_P:
            close({"p"}, _SCOPE)
        if tag in _CLOSED_BY:
            close(*_CLOSED_BY[tag])
        if tag in _HEADINGS and stack[-1].tag != tag and stack[-1].tag in _HEADINGS:
            is_open[stack.pop().tag] -= 1
        node = _Node(tag, m["attrs"] or "", stack[-1], len(nodes))
        if tag in _RAW:
            if (m["attrs"] or "").endswith("/"):
                continue
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        stack[-1].parts.append(node)
        nodes.append(node)
        if tag not in _VOID and not (m["attrs"] or "").endswith("/"):
            stack.append(node)
            is_open[tag] += 1


def _words(attrs: str) -> tuple[set[str], dict[str, str]]:
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    return {w.lower() for key in ("class", "id") for w in _SPLIT.split(found.get(key, "")) if w}, found


def dropped(node: _Node) -> bool:
    """Whether an element is none of the article's by its kind, role or style."""
    if node.tag in ("html", "body", "#root"):
        return False
    if node.tag in _DROPPED:
        return True
    if not node.attrs.strip():
        return False
    attrs = _words(node.attrs)[1]
    return "hidden" in attrs or attrs.get("aria-hidden", "") == "true" or attrs.get("role", "").lower() in _ROLES or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I))


def suspect(node: _Node) -> str:
    """What an element may be by its class and id: "comments", "other", or "" for the article's."""
    if not node.attrs.strip() or node.tag in ("html", "body", "#root"):
        return ""
    words, attrs = _words(node.attrs)
    if not words & _DROPPED_WORDS:
        return ""
    bad: set[str] = set()
    good = plain = False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        inner = {w.lower() for w in _SPLIT.split(name) if w}
        if inner & _LAYOUT_WORDS:
            continue
        bad |= inner & _DROPPED_WORDS
        good |= bool(inner & _GOOD_WORDS) and not inner & _DROPPED_WORDS
        plain |= name.lower() in _PLAIN_WORDS
    if not bad or good and not plain:
        return ""
    if bad & _COMMENT_WORDS:
        return "comments"
    return "" if node.tag in ("article", "main") else "other"


def left_out(nodes: list[_Node]) -> list[bool]:
    """Of each element, whether it or one it lies in isn't the article's."""
    n = len(nodes)
    gone, prose, holds, why = [False] * n, [0] * n, [False] * n, [""] * n
    in_link = [False] * n
    for x in nodes:
        up = x.parent.order if x.parent else -1
        gone[x.order] = (up >= 0 and gone[up]) or dropped(x)
        in_link[x.order] = x.tag == "a" or (up >= 0 and in_link[up])
        if not gone[x.order]:
            why[x.order] = suspect(x)
            holds[x.order] = x.tag in ("article", "main") and why[x.order] == ""
            if not in_link[x.order]:
                prose[x.order] = sum(len(part.strip()) for part in x.parts if isinstance(part, str))
    for x in reversed(nodes[1:]):
        if not gone[x.order]:
            prose[x.parent.order] += prose[x.order]
            holds[x.parent.order] |= holds[x.order]
    for x in nodes[1:]:
        k = x.order
        gone[k] = gone[k] or gone[x.parent.order] or (why[k] != "" and not holds[k] and (why[k] == "comments" or 2 * prose[k] < prose[0]))
    return gone


def main_text(page: str | None) -> str:
    """The article's blocks, joined by one space."""
    nodes = parse(page or "")
    n = len(nodes)
    gone, size, linked, own, commas = left_out(nodes), [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for x in nodes:
        in_link[x.order] = x.tag == "a" or (x.parent is not None and in_link[x.parent.order])
        if not gone[x.order]:
            for part in x.parts:
                if isinstance(part, str):
                    k = len(" ".join(part.split()))
                    own[x.order] += k
                    size[x.order] += k
                    linked[x.order] += k if in_link[x.order] else 0
                    commas[x.order] += len(_COMMA.findall(part))
    inner = commas[:]
    flow = own[:]  # text of a block with that of its inline elements
    for x in reversed(nodes[1:]):
        if not gone[x.order]:
            up = x.parent.order
            size[up] += size[x.order]
            linked[up] += linked[x.order]
            if x.tag not in _BLOCK:
                inner[up] += inner[x.order]
                flow[up] += flow[x.order]
    points = [0.0] * n
    for x in reversed(nodes):  # an element's own points are complete when its turn comes
        k = x.order
        passed = points[k] / 2
        if not gone[k] and (x.tag in _BLOCK or x.tag == "#root") and flow[k] >= 1 and x.tag not in _HEADINGS and x.tag not in ("br", "hr"):
            worth = (1 + inner[k] + min(flow[k] / 100, 3)) * (1 if x.tag in ("p", "pre", "blockquote", "td") or flow[k] >= 25 else 0.2)
            passed += worth
            if x.tag not in ("p", "pre", "li"):
                points[k] += worth  # a container with text of its own
        if x.parent is not None:
            points[x.parent.order] += passed
    for x in nodes:
        if points[x.order]:
            if x.tag in ("article", "main"):
                points[x.order] += 25
            elif x.attrs and _words(x.attrs)[0] & _GOOD_WORDS:
                points[x.order] += 10
            points[x.order] *= 1 - linked[x.order] / max(size[x.order], 1)
    best = max((x for x in nodes if points[x.order] > 0), key=lambda x: (points[x.order], -x.order), default=None)
    if best is None:
        return ""
    up = best
    while up is not None and up.tag != "article":
        up = up.parent
    keep = [up or best]
    if up is None and best.parent is not None:
        least = max(10.0, 0.2 * points[best.order])
        kind = _words(best.attrs)[1].get("class")
        for part in best.parent.parts:
            if isinstance(part, _Node) and part is not best and not gone[part.order] and size[part.order]:
                k = part.order
                density = linked[k] / size[k]
                alike = part.tag == best.tag and kind is not None and density < 0.25 and _words(part.attrs)[1].get("class") == kind
                if points[k] >= least or alike or part.tag in _HEADINGS and density == 0 or part.tag == "p" and (size[k] > 80 and density < 0.25 or size[k] <= 80 and density == 0 and best.tag == "p"):
                    keep.append(part)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        words = " ".join("".join(line).split())
        if words:
            blocks.append(words)
        line.clear()

    for top in sorted(keep, key=lambda x: x.order):
        todo: list[_Node | str | None] = [top]
        while todo:
            part = todo.pop()
            if part is None:
                flush()
            elif isinstance(part, str):
                line.append(part)
            elif not gone[part.order]:
                if part.tag in _BLOCK:
                    flush()
                    todo.append(None)
                todo.extend(reversed(part.parts))
        flush()
    return " ".join(blocks)


def extract(df: DataFrame, page: str = "html") -> DataFrame:
    """df without the page, with text and n_chars (code points)."""
    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    rest = [F.col(f"`{c}`") for c in df.columns if c not in (page, "text", "n_chars")]
    found = df.select(*rest, of(F.coalesce(F.col(f"`{page}`"), F.lit(""))).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
