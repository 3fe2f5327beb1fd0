"""HTML extraction by wrapper induction: pages of a host are aligned with one of its pages by simple tree matching."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Set
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchline.sources.scratch import materialise

from . import words

#: A text node of the template: the same on this share of at least so many other pages aligned with it.
CONSTANT_SHARE, LEAST_PAGES = 0.8, 3
#: Reference pages and templates are broadcast up to this many bytes, and joined by shuffle beyond.
BROADCAST_BYTES = 16 << 20

# Element kinds of HTML.
RAW = "script style noscript template textarea title iframe xmp svg object"
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul button label legend head search".split()
)
CLOSES_P = BLOCKS - set("button label option select legend".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
SCOPE = {"ul", "ol", "dl", "table", "menu", "select", "body", "html", "article", "section", "div", "nav", "aside", "main", "form", "footer", "header"}
#: Elements, roles and words of class or id that mark what is no article text.
NO_TEXT = set("nav header footer aside form button select menu dialog head search".split())
NO_TEXT_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NO_TEXT_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer masthead cookie cookies consent "
    "gdpr notice popup modal overlay newsletter subscribe signup login comment comments commentlist respond reply replies disqus social share sharing related "
    "recommended recommendations breadcrumb breadcrumbs pagination pager widget toolbar toc".split()
)
#: Blocks of running text: inside the article no class word or id takes them away.
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th".split())
HEADER_WORDS, ARTICLE_WORDS = {"header", "topbar"}, {"article", "post", "entry", "content", "story", "body", "main"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW.split()) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    """A block element, or with tag `#text` a run of text between block borders. `shape` is equal for trees that match in full."""

    __slots__ = ("tag", "children", "text", "skip", "article", "anchors", "links", "shape", "size", "depth", "number")

    def __init__(self, tag: str, skip: bool = False, article: bool = False):
        self.tag, self.skip, self.article, self.children, self.text, self.anchors, self.links = tag, skip, article, [], "", 0, 0


def _marks(tag: str, attributes: str, inside_article: bool) -> bool:
    """Whether the element holds no article text by its name, role, class or id."""
    if tag in NO_TEXT and not (tag == "header" and inside_article):
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in NO_TEXT_ROLES or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "article", "main"):
        return "comment" in found.get("class", "").lower()
    names = {w.lower() for w in _WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    return bool(names & NO_TEXT_WORDS) or bool(names & HEADER_WORDS and not names & ARTICLE_WORDS and not inside_article)


def parse(html: str | None) -> Node:
    """The block tree of a page: inline elements dissolve into the text, missing end tags are supplied."""
    root = Node("#root")
    stack, run, in_link, anchors, linked = [root], [], False, 0, 0
    html = html or ""

    def end_run() -> None:
        nonlocal anchors, linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                leaf = Node("#text")
                leaf.text, leaf.anchors, leaf.links = text, anchors, linked
                stack[-1].children.append(leaf)
            run.clear()
        anchors = linked = 0

    last = 0
    # No tag can end behind the last ">", so nothing is looked for there but the start of a comment that never ends.
    end = html.rfind(">") + 1
    cut = html.find("<!--", end)
    html = html[:cut] if cut >= 0 else html
    for m in _TOKEN.finditer(html, 0, end):
        if m.end() == end:  # a comment or script without end goes on to the end of the page
            m = _TOKEN.match(html, m.start())
        if m.start() > last:
            run.append(html[last : m.start()])
            if in_link:
                linked += m.start() - last
        last = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue  # comments, declarations, scripts and the like
        tag, closing, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag == "a":
            in_link = not closing
            anchors += in_link
        if tag not in BLOCKS:
            if tag in ("br", "wbr"):
                run.append(" " if tag == "br" else "")
            elif tag == "hr":
                end_run()
            continue  # an inline element is part of its block
        end_run()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        ends = CLOSED_BY.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in ends:
                del stack[k:]
                break
            if stack[k].tag in SCOPE:
                break
        inside = any(n.article for n in stack)
        node = Node(tag, _marks(tag, attributes, inside), tag in ("article", "main"))
        stack[-1].children.append(node)
        stack.append(node)
    run.append(html[last:])
    end_run()
    _finish(root)
    return root


def _finish(root: Node) -> None:
    """Shapes, sizes and preorder numbers, without recursion: pages may nest deeply."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(order)
        order.append(node)
        todo.extend(reversed(node.children))
    for node in reversed(order):
        node.size = 1 + sum(c.size for c in node.children)
        node.depth = 1 + max((c.depth for c in node.children), default=0)
        node.shape = hash((node.tag, *(c.shape for c in node.children)))


class _Matching:
    """Weights of simple tree matching between the subtrees of two pages: a pair counts one plus the best matching of its children in order.

    Equal shapes at both ends of two child lists are paired first, which loses nothing, so only what differs needs the table.
    """

    def __init__(self, page: Node, reference: Node) -> None:
        self.scores: dict[tuple[int, int], int] = {}
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 4 * min(page.depth, reference.depth)))

    def middle(self, a: Node, b: Node) -> tuple[int, int, int]:
        """Children paired at the front, and the ends of what lies between."""
        front, x, y = 0, len(a.children), len(b.children)
        while front < min(x, y) and a.children[front].shape == b.children[front].shape:
            front += 1
        while x > front and y > front and a.children[x - 1].shape == b.children[y - 1].shape:
            x, y = x - 1, y - 1
        return front, x, y

    def table(self, a: Node, b: Node) -> list[list[int]]:
        front, x, y = self.middle(a, b)
        rows = [[0] * (y - front + 1)]
        for i in range(front, x):
            row, above = [0], rows[-1]
            for j in range(front, y):
                row.append(max(above[j - front + 1], row[-1], above[j - front] + self.score(a.children[i], b.children[j])))
            rows.append(row)
        return rows

    def score(self, a: Node, b: Node) -> int:
        if a.tag != b.tag:
            return 0
        if a.shape == b.shape:
            return a.size
        key = (a.number, b.number)
        if key not in self.scores:
            front, x, y = self.middle(a, b)
            ends = sum(c.size for c in a.children[:front]) + sum(c.size for c in a.children[x:])
            self.scores[key] = 1 + ends + (self.table(a, b)[-1][-1] if x > front and y > front else 0)
        return self.scores[key]


def match_size(page: Node, reference: Node) -> int:
    """Nodes that the best matching pairs."""
    return _Matching(page, reference).score(page, reference)


def align(page: Node, reference: Node) -> dict[int, Node]:
    """Page text nodes (by number) and the reference nodes that simple tree matching pairs them with."""
    matching = _Matching(page, reference)
    pairs, todo = {}, [(page, reference)]
    while todo:
        a, b = todo.pop()
        if a.tag == "#text":
            pairs[a.number] = b
        front, x, y = matching.middle(a, b)
        todo += zip(a.children[:front], b.children[:front], strict=True)
        todo += zip(a.children[x:], b.children[y:], strict=True)
        if x > front and y > front:
            rows = matching.table(a, b)
            i, j = x - front, y - front
            while i and j:
                here = rows[i][j]
                if here == rows[i - 1][j]:
                    i -= 1
                elif here == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((a.children[front + i], b.children[front + j]))
    return pairs


def _preorder(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(reversed(node.children))
    return order


def _unmarked(root: Node, template: Set[int] | None = None) -> tuple[list[Node], dict[str, set[int]]]:
    """Text nodes that are neither template nor marked, in page order; by tag the numbers of those inside an article or main element.

    Marks have no say on a part that holds most of the page's varying text, if it wraps an article or hardly any unmarked text is left
    without it, nor on a paragraph, a heading or a list of links inside the article. Without a `template` only article elements show where that is.
    """
    aligned, template = template is not None, template or set()
    order = _preorder(root)
    varying, free, wraps = ([0] * len(order) for _ in range(3))
    for node in reversed(order):
        n = node.number
        if node.tag == "#text":
            varying[n] = free[n] = 0 if n in template else len(node.text)
        else:
            varying[n] = sum(varying[c.number] for c in node.children)
            free[n] = 0 if node.skip else sum(free[c.number] for c in node.children)
            wraps[n] = not node.skip and node.article or any(wraps[c.number] for c in node.children)
    most = lambda node: 2 * varying[node.number] > varying[root.number]
    found, inside, todo = [], {"article": set(), "main": set()}, [(root, False, False, False)]
    while todo:
        node, article, main, slot = todo.pop()
        if node.tag == "#text":
            if node.number not in template:
                found.append(node)
                for tag, held in (("article", article), ("main", main)):
                    if held:
                        inside[tag].add(node.number)
            continue
        if node.skip and not (slot and node.tag in TEXT_BLOCKS):
            if not (most(node) and node.tag not in NO_TEXT and (wraps[node.number] or 10 * free[root.number] < varying[node.number])):
                continue
        article, main = article or node.tag == "article", main or node.tag == "main"
        if node.tag in ("ul", "ol", "div", "table", "dl") and not slot and not (most(node) and wraps[node.number]) and _is_link_list(node):
            continue
        # The slot is the article, or after alignment the smallest part with most of the varying text.
        slot = slot or node.tag == "article" or (aligned and node.tag not in ("#root", "html", "body") and most(node) and not any(most(c) and c.tag != "#text" for c in node.children))
        todo.extend((c, article, main, slot) for c in reversed(node.children))
    return found, inside


def text_nodes(root: Node) -> list[Node]:
    """Text nodes of the article by marks and tags alone: of main, else of article elements, where they hold half of the unmarked text or more, else of the body."""
    found, inside = _unmarked(root)
    total = sum(len(n.text) for n in found)
    for wanted in ("main", "article"):
        if inside[wanted] and 2 * sum(len(n.text) for n in found if n.number in inside[wanted]) >= total:
            return [n for n in found if n.number in inside[wanted]]
    return found


def _is_link_list(node: Node) -> bool:
    """Three links or more, and hardly any text beside them."""
    total = linked = count = 0
    todo = [node]
    while todo:
        at = todo.pop()
        total += len(at.text)
        linked += min(at.links, len(at.text))
        count += at.anchors
        todo.extend(at.children)
    return count >= 3 and linked >= 0.9 * total


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


@lru_cache(maxsize=64)
def _reference(html: str) -> tuple[Node, tuple[str, ...]]:
    root = parse(html)
    return root, tuple(n.text for n in text_nodes(root))


def _layouts(html: Column) -> tuple[Column, Column]:
    """Digests of the block skeleton outside articles: of the tags with their class words in order, and of the same without what repeats."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", ""), r"(?is)<article\b.*</article", "<article></article")
    tags = F.regexp_extract_all(bare, F.lit(r"(?i)<(/?(?:header|footer|nav|aside|main|article|section|div|form|table|h1)\b(?:[^>]*?\bclass\s*=\s*(?:\"[^\">]*\"|'[^'>]*'|[^\s\"'>]+))?)"), F.lit(1))
    name = lambda t: F.concat_ws(" ", F.lower(F.regexp_extract(t, r"^/?\w+", 0)), F.regexp_replace(F.regexp_extract(t, r"(?i)\bclass\s*=\s*[\"']?([^\"']*)", 1), r"\d+", ""))
    tags = F.transform(tags, name)
    return F.md5(F.array_join(tags, "<")), F.md5(F.array_join(F.array_distinct(tags), "<"))


def _joined(pages: DataFrame, small: DataFrame, *keys: str) -> DataFrame:
    """Join by the keys; broadcast what is measured to be small, else shuffle and let adaptive execution split hot hosts."""
    size = small.agg(F.sum(sum(F.octet_length(c) if t == "string" else 4 * F.greatest(F.size(c), F.lit(0)) for c, t in small.dtypes))).first()[0] or 0
    return pages.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, list(keys), "left")


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """All rows and columns with the main text in `out` (a column of that name is replaced); names that start with _ are used inside.

    The page of a host and layout with the least digest is the reference of both. A layout is the block skeleton outside articles; one of too few
    pages to compare is taken without repeated parts, then goes to the host's most frequent layout. Every page is aligned with it, with all its text nodes; one of the
    reference that is equal on CONSTANT_SHARE of LEAST_PAGES or more aligned pages is template, the other nodes are varying slots and
    content, save what is marked (menus, headers, notices, comments and so on). Pages whose article equals the reference's say nothing about
    what varies and are not counted, so copies of one article do not turn it into a template. Where too few pages can be compared, tags
    decide: main, else article, else body. NULL and empty pages give an empty text; a NULL url is a host of its own; repeated rows are treated alike.
    """
    rows = pages.withColumn("_host", _host(F.col(url)))
    fine, coarse = _layouts(F.col(html))
    rows = rows.withColumn("_fine", fine)
    # One row for each skeleton of a host, and from it the layout whose reference its pages take.
    skeletons = materialise(rows.where(F.length(html) > 0).groupBy("_host", "_fine").agg(F.count(F.lit(1)).alias("n"), F.min(coarse).alias("coarse")), "skeletons")
    large = lambda n: F.col(n) > LEAST_PAGES
    merged = skeletons.groupBy("_host", "coarse").agg(F.sum(F.when(large("n"), 0).otherwise(F.col("n"))).alias("rest"), F.max(F.struct("n", "_fine")).alias("top"))
    own = F.when(large("n"), F.col("_fine")).when(large("rest"), F.col("coarse")).when(large("top.n"), F.col("top._fine"))
    placed = skeletons.join(merged, ["_host", "coarse"]).select("_host", "_fine", "n", own.alias("own"))
    sizes = placed.groupBy("_host", "own").agg(F.sum("n").alias("n"))
    most = F.max(F.when(F.col("own").isNotNull(), F.struct("n", "own")))["own"]
    main = sizes.groupBy("_host").agg(most.alias("main"), F.sum("n").alias("n_host"))
    layout = F.coalesce("own", "main", F.when(large("n_host"), F.lit("")))
    layouts = materialise(placed.join(main, "_host").select("_host", "_fine", layout.alias("_layout")), "layouts")
    rows = _joined(rows, layouts.where("_layout IS NOT NULL"), "_host", "_fine").drop("_fine")
    references = materialise(rows.where("_layout IS NOT NULL").groupBy("_host", "_layout").agg(F.min_by(html, F.md5(html)).alias("_reference")), "references")
    aligned = _joined(rows, references, "_host", "_layout")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str, int], list[int]] = {}
        for batch in batches:
            for part in words.byte_slices(batch, "html"):
                for host, layout, page, reference in zip(*(part.column(c).to_pylist() for c in ("_host", "_layout", "html", "_reference")), strict=True):
                    if not page or not reference or page == reference:
                        continue
                    root = parse(page)
                    base, article = _reference(reference)
                    if tuple(n.text for n in text_nodes(root)) == article:
                        continue
                    pairs = align(root, base)
                    for node in _preorder(root):
                        if node.number in pairs:
                            n = seen.setdefault((host, layout, pairs[node.number].number), [0, 0])
                            n[0] += 1
                            n[1] += node.text == pairs[node.number].text
            if len(seen) > 100_000:
                yield _counted(seen)
                seen = {}
        yield _counted(seen)

    counts = aligned.select("_host", "_layout", F.col(html).alias("html"), "_reference").mapInArrow(count, "_host string, _layout string, node int, n long, same long")
    compared = counts.groupBy("_host", "_layout", "node").agg(F.sum("n").alias("n"), F.sum("same").alias("same")).where(F.col("n") >= LEAST_PAGES)
    constant = F.when(F.col("same") >= F.col("n") * CONSTANT_SHARE, F.col("node"))
    templates = compared.groupBy("_host", "_layout").agg(F.collect_set(constant).alias("_constant"))  # at most the nodes of one page; empty if all vary
    wrappers = materialise(references.join(templates, ["_host", "_layout"], "left"), "wrappers")
    full = _joined(rows, wrappers, "_host", "_layout").withColumn(out, F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.byte_slices(batch, html):
                texts = [article_text(*row) for row in zip(*(part.column(c).to_pylist() for c in (html, "_reference", "_constant")), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == out else part.column(n) for n in part.schema.names], names=part.schema.names)

    return full.mapInArrow(run, full.schema).drop("_host", "_layout", "_reference", "_constant")


def article_text(page: str | None, reference: str | None, constant: list[int] | None) -> str:
    """The content nodes of one page, one a line; `constant` lists the reference nodes that are template, and is None where tags decide."""
    if not page:
        return ""
    root = parse(page)
    if constant is None or not reference:
        return "\n".join(n.text for n in text_nodes(root))
    fixed, template = set(constant), set()
    if fixed:
        nodes = _preorder(root)
        template = {k for k, n in align(root, _reference(reference)[0]).items() if n.number in fixed and nodes[k].text == n.text}
    return "\n".join(n.text for n in _unmarked(root, template)[0])


def _counted(seen: dict[tuple[str, str, int], list[int]]) -> pa.RecordBatch:
    columns = [[k[0] for k in seen], [k[1] for k in seen], [k[2] for k in seen], [v[0] for v in seen.values()], [v[1] for v in seen.values()]]
    types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["_host", "_layout", "node", "n", "same"])
