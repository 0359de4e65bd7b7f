"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged by the path of tags and classes. A node whose content and children are
much the same on every page has low entropy and so low importance; such branches are cut from each page. What
a tag, class or role names outright (menus, adverts, comments) goes on any page, as long as the rest outweighs it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsrisk.llm.common import by_bytes, ship
from tsrisk.session import stage

#: Share of content in a node's importance; the rest is presentation.
CONTENT_WEIGHT = 0.7
#: Branches below this importance are cut where the host shows them on at least so many pages.
LEAST_IMPORTANCE, LEAST_PAGES = 0.3, 5
#: Characters inside an article or main element weigh so much more where a branch is weighed against the rest.
ARTICLE_WEIGHT = 4
#: Share of the important text from which article elements, or the main element, stand for the whole page.
LEAST_SHARE = {2: 1 / 2, 1: 1 / 3}

# Elements without text of their own, inside a line, without an end tag, and never main text.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "object", "canvas", "math", "select", "xmp")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside form button dialog menu".split())
#: What may stand in a head; anything else ends it, with or without an end tag.
HEAD = frozenset("base link meta noscript script style template title".split())
#: Of the tags above, all but forms come back only if they hold one of these.
PROSE = frozenset("article h1 main p".split())
SELF_CLOSING = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
}
#: An implied end tag never reaches beyond these.
FENCES = frozenset("html body table ul ol dl div article section main td th nav aside header footer form".split())
# Words in a class, id or role that name something beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising alert banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus footer gdpr header "
    "login masthead menu menubar modal nav navbar navigation newsletter notice notices notification notifications pager "
    "pagination popup promo promoted promotion recommended related replies reply search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
# A class with one of these tells what an element has or lacks; the id of a heading is an anchor.
STATES = frozenset("has no not with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)", re.S)
#: What follows a tag's name. Only a quote behind `=` opens a value, and only if another one closes it.
_TAG_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_LONG_NUMBER = re.compile(r"&#([0-9]{9,}+)")
_NAMES = re.compile(r"(?i)\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_MASK = (1 << 64) - 1


class Node(NamedTuple):
    """An element: what names it, and where it stands."""

    tag: str
    path: int
    beside: bool  # its own tag or names put it beside the article
    article: int  # 0 outside, 1 inside main, 2 inside article
    head: bool = False  # head or title, or inside


def host_of(url: str | None) -> str:
    """Host in lower case; empty if the url has none."""
    found = _HOST.match((url or "").strip())
    return found[1].lower() if found else ""


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))


def _describe(tag: str, attributes: str, inside: int) -> tuple[str, bool]:
    """Presentation of a tag, and whether its names put it beside the article."""
    if not attributes.strip():
        return tag, tag in NEVER or (tag == "header" and not inside)
    names, hidden, classes = set(), False, ""
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style":
            hidden = hidden or re.search(r"display\s*:\s*none", value, re.I) is not None
        elif name in ("class", "id", "role"):
            for one in value.split() if name != "id" or tag not in HEADINGS else ():
                words = {w.lower() for w in _WORDS.findall(one)}
                if words.isdisjoint(STATES):
                    names |= words
            if name == "class":
                classes = value
    beside = hidden or tag in NEVER or (tag == "header" and not inside)
    if tag not in ("html", "body", "main") and not (tag == "header" and inside):
        beside = beside or not names.isdisjoint(BESIDE)
    return f"{tag}.{classes}", beside


def _unescape(text: str) -> str:
    """Character references decoded; a number of any length is one, and those beyond Unicode are U+FFFD."""
    return html.unescape(_LONG_NUMBER.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), text))


def walk(page: str) -> Iterator[tuple[str, object]]:
    """Events `open` (Node), `text`, `space`, and `close` (Node) of a page, with the end tags that HTML implies.

    The time is in proportion to the page, whatever its markup. From the first tag on that has no `>` outside
    its quotes, quotes count for nothing and the next `>` ends a tag; behind the last `>` all is text.
    """
    stack: list[Node] = [Node("", 0, False, 0)]
    places: dict[str, list[int]] = {}  # depths of the open elements of a tag
    fences = [0]
    at, quotes = 0, True

    def close_to(depth: int) -> Iterator[tuple[str, object]]:
        while len(stack) > depth:
            node = stack.pop()
            places[node.tag].pop()
            if node.tag in FENCES:
                fences.pop()
            yield "close", node

    def depth_of(tags: set[str]) -> int | None:
        """Depth of the nearest open element of these, inside the nearest fence."""
        depth = max((places[tag][-1] for tag in tags if places.get(tag)), default=0)
        return depth if depth and depth >= fences[-1] else None

    while True:
        found, rest, end = _TOKEN.search(page, at), "", None
        if found and found[2]:
            whole = _TAG_REST.match(page, found.end()) if quotes else None
            quotes = whole is not None
            end = whole.end() if whole else page.find(">", found.end()) + 1
            rest = page[found.end() : end - 1]
            found = found if end else None
        text = page[at : found.start() if found else len(page)]
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                yield from close_to(len(stack) - 1)
            yield "text", _unescape(text)
        if not found:
            break
        at = end or found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if places.get(tag):
                yield from close_to(places[tag][-1])
            continue
        if tag not in HEAD and stack[-1].head:
            depth = len(stack) - 1
            while stack[depth - 1].head:
                depth -= 1
            yield from close_to(depth)
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            yield ("space", "") if tag in ("br", "hr") else ("skip", "")
            continue
        if tag not in INLINE and (depth := depth_of({"p"})):
            yield from close_to(depth)
        if tag in SELF_CLOSING and (depth := depth_of(SELF_CLOSING[tag])):
            yield from close_to(depth)
        parent = stack[-1]
        shown, beside = _describe(tag, rest, parent.article)
        inside = max(parent.article, {"article": 2, "main": 1}.get(tag, 0) if not beside else 0)
        node = Node(tag, _hash(f"{parent.path}>{shown}"), beside, inside, parent.head or tag in ("head", "title"))
        places.setdefault(tag, []).append(len(stack))
        if tag in FENCES:
            fences.append(len(stack))
        stack.append(node)
        yield "open", node
    yield from close_to(1)


def page_nodes(page: str) -> dict[int, tuple[int, int]]:
    """For each path of a page, a hash of all content and of all child tags that stand there."""
    content, style = [0], [0]
    found: dict[int, tuple[int, int]] = {}
    for event, value in walk(page):
        if event == "text":
            words = " ".join(value.split())
            if words:
                content[-1] = (content[-1] * 31 + _hash(words)) & _MASK
        elif event == "open":
            style[-1] = (style[-1] * 31 + _hash(value.tag)) & _MASK
            content.append(0), style.append(0)
        elif event == "close":
            own, children = content.pop(), style.pop()
            content[-1] = (content[-1] * 31 + own) & _MASK
            a, b = found.get(value.path, (0, 0))
            found[value.path] = (a * 31 + own) & _MASK, (b * 31 + children) & _MASK
    return found


class Branch:
    """A part of a page that a tag or name puts beside the article, and its own text without that of inner branches."""

    __slots__ = ("article", "low", "outer", "own", "path", "prose", "tag", "weight")

    def __init__(self, node: Node, outer: int, low: bool) -> None:
        self.tag, self.path, self.outer, self.low = node.tag, node.path, outer, low
        self.own, self.weight, self.article, self.prose = 0, 0, False, False


def _beside(branches: list[Branch]) -> list[bool]:
    """Whether each branch is cut; they stand in the order of their starts, the page itself first.

    The largest are tried first. A branch is cut if the text that surely stays weighs at least as much, or if the
    tree finds it unimportant too and any text stays. Else its own text stays, and all branches of its path do.
    """
    cut, whole = [False] * len(branches), [b.own for b in branches]
    for at in range(len(branches) - 1, 0, -1):
        b = branches[at]
        cut[at] = b.tag in NEVER and b.tag != "form" and not b.prose
        if not cut[at]:
            whole[b.outer] += whole[at]
    rest, stay = branches[0].weight, set()
    for at in sorted(range(1, len(branches)), key=lambda x: (-whole[x], x)):
        b = branches[at]
        held = whole[at] * (ARTICLE_WEIGHT if b.article else 1)
        if cut[at] or cut[b.outer] or (b.path not in stay and (rest >= held or (b.low and rest))):
            cut[at] = True
        else:
            stay.add(b.path)
            rest += b.weight
    for at in range(1, len(branches)):
        cut[at] = cut[at] or cut[branches[at].outer]
    return cut


def main_text(page: str | None, low: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the main text, joined by an empty line; `low` holds the paths that the host's tree cuts.

    A tag or name cuts a branch only if the rest of the page outweighs it. The
    tree cuts everywhere, but not all of a page, nor most of articles that
    outweigh what is left outside. If articles (else main) hold LEAST_SHARE of what is then left,
    only their text counts.
    """
    if not page:
        return ""
    found: list[tuple[str, int, bool, int]] = []  # text, place relative to an article, cut by the tree, branch
    branches, inner = [Branch(Node("", 0, False, 0), 0, False)], [0]
    line: list[str] = []
    stack = [(Node("", 0, False, 0), False)]

    def flush() -> None:
        words = "".join(line).split()
        node, cut = stack[-1]
        if words and not node.head:
            found.append((" ".join(words), node.article, cut, inner[-1]))
            size, own = len(found[-1][0]), branches[inner[-1]]
            own.own += size
            own.weight += size * (ARTICLE_WEIGHT if node.article else 1)
        line.clear()

    for event, value in walk(page):
        if event == "text":
            line.append(value)
        elif event == "space":
            line.append(" ")
        elif event in ("open", "close"):
            node = value
            if node.tag not in INLINE or node.beside:
                flush()
            if event == "open":
                cut = stack[-1][1] or (node.path in low and node.tag not in INLINE)
                if node.beside:
                    branches.append(Branch(node, inner[-1], cut))
                    inner.append(len(branches) - 1)
                own = branches[inner[-1]]
                own.prose = own.prose or node.tag in PROSE
                own.article = own.article or (node.article > stack[-1][0].article)
                stack.append((node, cut))
            else:
                stack.pop()
                if node.beside:
                    own = branches[inner.pop()]
                    outer = branches[inner[-1]]
                    outer.prose, outer.article = outer.prose or own.prose, outer.article or own.article
    flush()
    beside = _beside(branches)
    blocks = [(text, place, cut) for text, place, cut, branch in found if not beside[branch]]
    own = sum(len(text) for text, place, _ in blocks if place)
    left = [sum(len(text) for text, place, cut in blocks if not cut and bool(place) == inside) for inside in (False, True)]
    spared = 2 * left[1] < own >= left[0]
    kept = [(text, place) for text, place, cut in blocks if not cut or (place and spared)]
    kept = kept or [(text, place) for text, place, _ in blocks]
    for level, share in LEAST_SHARE.items():
        inside = [text for text, place in kept if place >= level]
        if inside and sum(map(len, inside)) >= share * sum(len(text) for text, _ in kept):
            return "\n\n".join(inside)
    return "\n\n".join(text for text, _ in kept)


def site_tree(pages: DataFrame) -> DataFrame:
    """`host, path, pages, importance` of every node of the hosts' merged trees.

    Importance is the entropy of a node's contents and of its child sequences
    over the pages that have it, each divided by the entropy of all being
    different: 1 if no two pages agree, 0 if all do. A node of one page has 1.
    """
    rows = pages.filter(F.col("html").isNotNull() & F.col("url").isNotNull()).select("url", "html")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "html", 4 << 20):
            counts: Counter[tuple[str, int, int, int]] = Counter()
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                host = host_of(url)
                if host:
                    for path, values in page_nodes(page).items():
                        counts.update((host, path, kind, value) for kind, value in enumerate(values))
            columns = list(zip(*counts)) or [(), (), (), ()]
            signed = [[v - (1 << 64) if v >> 63 else v for v in columns[k]] for k in (1, 3)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.string()), pa.array(signed[0], pa.int64()), pa.array(columns[2], pa.int32()),
                    pa.array(signed[1], pa.int64()), pa.array(list(counts.values()), pa.int64()),
                ],
                names=["host", "path", "kind", "value", "n"],
            )

    seen = rows.mapInArrow(run, "host string, path long, kind int, value long, n long")
    seen = seen.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    by_kind = [
        f(F.when(F.col("kind") == kind, x))
        for kind in (0, 1)
        for f, x in ((F.sum, F.col("n")), (F.sum, F.col("n") * F.log(F.col("n").cast("double"))))
    ]
    sums = seen.groupBy("host", "path").agg(*[c.alias(a) for c, a in zip(by_kind, ("pages", "content", "pages_", "style"))])
    most = F.col("pages") * F.log(F.col("pages").cast("double"))
    same = F.lit(CONTENT_WEIGHT) * F.col("content") + F.lit(1 - CONTENT_WEIGHT) * F.col("style")
    importance = F.when(F.col("pages") > 1, 1 - same / most).otherwise(1.0)
    return sums.select("host", "path", "pages", importance.alias("importance"))


def extract(pages: DataFrame) -> DataFrame:
    """`page_id, url, text, n_chars`, a row per row of `pages`; other columns play no part.

    White space inside a block is one space and blocks are joined by an empty
    line. A null or empty html, or a page without main text, gives an empty
    text. Pages whose url is null or has no host are read without a tree.
    Repeated rows give repeated rows and count as pages of their own in the
    tree; an empty table gives an empty result.
    """
    ship(pages)
    cut = site_tree(pages).filter((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE))
    # One row for each host; its file size decides whether the join sends it to every task.
    low = stage(cut.groupBy("host").agg(F.collect_list("path").alias("low")), "html-tree")
    pattern = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
    rows = pages.select("page_id", "url", "html", F.lower(F.regexp_extract("url", pattern, 1)).alias("host"))
    joined = rows.join(low, "host", "left").select("page_id", "url", "html", "low")
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "html", 4 << 20):
            paths: dict[tuple, frozenset[int]] = {}
            texts = []
            for page, own in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist()):
                key = tuple(own or ())
                if key not in paths:
                    paths[key] = frozenset(v & _MASK for v in key)
                texts.append(main_text(page, paths[key]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
