"""HTML extraction by wrapper induction.

Pages of a host are aligned, by simple tree matching, with one page of the host (the one of the smallest hash). Text that
is the same at aligned nodes is constant, text that differs is a varying slot. Counted over all pages of the host, the
deepest container that holds all of the varying text is the host's content node, so no varying text outside boilerplate is left; what else stands on its pages is
template. So are short blocks within it that are the same on nearly all of at least ``PAGES`` pages (share bars, follow-us lines), but for headings, and only where
enough of the page is left. Each page is aligned once more, and the node aligned with the content node gives the text. Pages that don't
align, hosts whose slots don't point to one container, and hosts whose pages hardly vary (one article at many addresses) fall back to the page's own article,
main or body elements.

Within content, elements that are boilerplate by their tag, role, class or id (menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts, styles) are left out. White space inside a block becomes one space; blocks are joined
by one space in page order; character references are decoded.

Alignment is by page, so a host of any size is spread over tasks; only sums per node of the host's one page meet. Null and
empty html give an empty text; pages without a url belong to one nameless host; repeated rows give equal rows. Broken
markup never fails: unclosed elements end with their parent, stray end tags are skipped. Extra columns play no part.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Generator, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored

OPENING = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*))")
#: What may stand in a tag: no quote stays open.
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "textarea", "title")}
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = set("html body div main section article center td tr table tbody #root".split())
SKIPPED = set("head nav footer aside form button dialog menu".split())
#: Skipped elements too; one that is never closed is empty.
EMBEDDED = set("noscript template iframe svg select object".split())
ENDS_P = set("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
#: Class, id and role values that mark boilerplate: whole, or as the first word of a value, or after one of PLACES.
NAMES = set(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored promo banner cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer header masthead topbar toolbar share sharing social related recommended "
    "comment comments reply replies disqus search login complementary contentinfo".split()
)
PLACES = set("site page global main top bottom left right".split())
#: What else may stand in such a value behind a name.
PARTS = set("area bar block body box button buttons container content form group icons inner item items layer link links list open panel section slot strip unit wrap wrapper".split())
#: A block is template text if it is the same on this share of at least so many pages that have it.
CONSTANT, PAGES = 0.9, 4
#: Pairs of children up to which their table is held as a whole, and weights that are kept at once; results don't depend on them.
TABLE, KEPT = 40_000, 1_000_000
#: Share of a page's text from which an element that is boilerplate by name alone is taken for content.
SHARE = 0.8
#: Characters that a constant block in the content has at most to be left out, share of a page's text that must stay then, and share of all text that must vary for a host to have a template.
SHORT, STAYS, VARIES = 200, 1 / 3, 0.1
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("kids", "mark", "shape", "size", "tag")

    def __init__(self, tag: str, mark: bool):
        self.tag, self.mark, self.kids = tag, mark, []  # kids: nodes and strings; mark: boilerplate by its own kind
        self.shape, self.size = 0, 1  # of the tree below: a hash, and its nodes


def named(value: str) -> bool:
    """Whether a class, id or role value has a token that names boilerplate, and nothing else."""
    for token in value.lower().split():
        words = [x for x in re.split(r"[^a-z]+", token) if x]
        if len(words) > 1 and words[0] in PLACES:
            words = words[1:]
        if words and words[0] in NAMES and all(x in NAMES or x in PLACES or x in PARTS for x in words):
            return True
    return False


def boilerplate(tag: str, attrs: str, depth: dict[str, int]) -> tuple[bool, bool]:
    """Whether an element is boilerplate by its tag, and by its names."""
    if tag in SKIPPED or tag in EMBEDDED or tag == "header" and not (depth["article"] or depth["main"]):
        return True, False
    return False, tag not in ("html", "body", "article", "main") and any(named(m[2] or m[3] or m[4] or "") for m in (ATTRIBUTE.finditer(attrs) if attrs else ()))


def unmark(root: Node, by_name: list[Node]) -> None:
    """Takes the mark off elements that are boilerplate by name alone and hold most of the page's text, or an article or main element."""
    kept = {id(n) for n in by_name}
    nodes, _, parents = numbered(root)
    size, body = [0] * len(nodes), [n.tag in ("article", "main") for n in nodes]
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        size[k] = 0 if n.mark and id(n) not in kept else size[k] + sum(len(x.strip()) for x in n.kids if isinstance(x, str))
        if k:
            size[parents[k]] += size[k]
            body[parents[k]] |= body[k] and not (n.mark and id(n) not in kept)
    for k, n in enumerate(nodes):
        if id(n) in kept and (body[k] or size[k] and size[k] >= SHARE * size[0]):
            n.mark = False


def tokens(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, tag (empty: nothing to open or close), whether it is an end tag, and attributes, in one pass.

    Where a quote in a tag stays open, quotes count no longer: this tag and those after it end at the next ``>``.
    """
    at, quotes = 0, True
    while (m := OPENING.search(html, at)) is not None:
        start, tag = m.start(), (m["tag"] or "").lower()
        if m["comment"]:
            end = html.find("-->", m.end())
            at = len(html) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        close = ATTRIBUTES.match(html, m.end()).end() if quotes and tag else html.find(">", m.end())
        if quotes and tag and html[close : close + 1] != ">":
            quotes, close = False, html.find(">", m.end())
        if close < 0:  # a tag that never ends
            yield start, len(html), "", False, ""
            return
        at = close + 1
        if tag in RAW and not m["end"]:
            end = RAW[tag].search(html, at)
            at, tag = len(html) if end is None else end.end(), ""
        yield start, at, tag, bool(m["end"]), html[m.end() : close] if tag else ""


def unclosed(found: list[tuple[int, int, str, bool, str]]) -> set[int]:
    """Starts of the embedded elements that no end tag closes."""
    waiting: dict[str, list[int]] = defaultdict(list)
    for start, _, tag, ends, attrs in found:
        if tag in EMBEDDED:
            if not ends:
                if not attrs.endswith("/"):
                    waiting[tag].append(start)
            elif waiting[tag]:
                waiting[tag].pop()
    return {x for v in waiting.values() for x in v}


def parse(html: str) -> Node:
    """The element tree; raw-text elements and comments are left out."""
    root = Node("#root", False)
    open_, at, found = [root], 0, list(tokens(html))
    depth: dict[str, int] = defaultdict(int)  # how many elements of a tag are open
    empty = unclosed(found)
    by_name: list[Node] = []

    def close(k: int) -> None:
        for n in open_[k:]:
            depth[n.tag] -= 1
        del open_[k:]

    for start, end, tag, ends, attrs in found:
        if start > at:
            open_[-1].kids.append(html[at:start])
        at = end
        if not tag:
            continue
        if ends:
            if depth[tag]:
                close(next(k for k in range(len(open_) - 1, 0, -1) if open_[k].tag == tag))
            continue
        closes = ({"p"} if tag in ENDS_P else set()) | SAME.get(tag, set())
        if any(depth[x] for x in closes):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag in closes:
                    close(k)
                    break
                if open_[k].tag not in INLINE:
                    break
        by_tag, name = boilerplate(tag, attrs, depth)
        node = Node(tag, by_tag or name)
        if name:
            by_name.append(node)
        open_[-1].kids.append(node)
        if tag not in VOID and not attrs.endswith("/") and start not in empty:
            open_.append(node)
            depth[tag] += 1
    if at < len(html):
        open_[-1].kids.append(html[at:])
    if by_name:
        unmark(root, by_name)
    for n in reversed(numbered(root)[0]):
        below = elements(n)
        n.shape, n.size = hash((n.tag, n.mark, *(k.shape for k in below))), 1 + sum(k.size for k in below)
    return root


def text_of(node: Node, own: bool = True, template: set[int] = frozenset()) -> str:
    """The text of a node without boilerplate below it; ``own``: take the node itself even if it is marked.

    Of the nodes whose identities are in ``template``, the text that stands in no block below them is left out.
    """
    out: list[str] = []

    def below(n: Node) -> list[Node | str]:
        return [k for k in n.kids if not isinstance(k, str) and k.tag not in INLINE] if id(n) in template else n.kids

    stack: list[Node | str] = [] if node.mark and not own else list(reversed(below(node)))
    while stack:
        kid = stack.pop()
        if isinstance(kid, str):
            out.append(unescape(kid))
        elif not kid.mark:
            space = [] if kid.tag in INLINE else [" "]
            stack += [*space, *reversed(below(kid)), *space]
    return " ".join("".join(out).split())


def block_text(node: Node) -> str:
    """The text of a node itself and of inline elements in it."""
    return " ".join(" ".join(k if isinstance(k, str) else text_of(k) for k in node.kids if isinstance(k, str) or k.tag in INLINE and not k.mark).split())


def elements(node: Node) -> list[Node]:
    return [k for k in node.kids if not isinstance(k, str)]


def numbered(root: Node) -> tuple[list[Node], dict[int, int], list[int]]:
    """Nodes in page order, their numbers by identity, and the parent's number of each."""
    nodes, parents, stack = [], [], [(root, -1)]
    number: dict[int, int] = {}
    while stack:
        n, p = stack.pop()
        number[id(n)] = len(nodes)
        nodes.append(n)
        parents.append(p)
        stack.extend((k, number[id(n)]) for k in reversed(elements(n)))
    return nodes, number, parents


Wanted = Generator[tuple[Node, Node], int, tuple[int, list[tuple[Node, Node]]]]


def matched(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the pairs of the largest order-keeping match of two trees with equal roots.

    Trees of one shape match node by node. Weights of pairs of shapes are kept, and nothing recurses, as unclosed elements
    nest without limit.
    """
    memo: dict[tuple[int, int], int] = {}
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if x.shape == y.shape:
            todo.extend(zip(elements(x), elements(y), strict=True))
            continue
        stack, answer = [(x, y, children(x, y))], None
        while stack:
            p, q, steps = stack[-1]
            try:
                wanted = steps.send(answer)
                answer = memo.get((wanted[0].shape, wanted[1].shape))
                if answer is None:
                    stack.append((*wanted, children(*wanted)))
            except StopIteration as end:
                stack.pop()
                answer, pairs = end.value
                if len(memo) >= KEPT:
                    memo.clear()
                memo[p.shape, q.shape] = answer
        todo.extend(pairs)
    return out


def children(a: Node, b: Node) -> Wanted:
    """The weight of the best match of two nodes, and its pairs of children. Yields the pairs whose weight it needs.

    Equal ends match as they are, which is never worse than another match. A table of over ``TABLE`` pairs is not held as a whole (``wide``); it gives the same pairs.
    """
    x, y = elements(a), elements(b)
    lead = next((k for k, (p, q) in enumerate(zip(x, y)) if p.shape != q.shape), min(len(x), len(y)))
    tail = next((k for k, (p, q) in enumerate(zip(reversed(x[lead:]), reversed(y[lead:]))) if p.shape != q.shape), min(len(x), len(y)) - lead)
    pairs = [*zip(x[:lead], y[:lead], strict=True), *zip(x[len(x) - tail :], y[len(y) - tail :], strict=True)]
    weight = 1 + sum(p.size for p, _ in pairs)
    x, y = x[lead : len(x) - tail], y[lead : len(y) - tail]
    if not x or not y:
        return weight, pairs
    if len(x) * len(y) > TABLE:
        most, found = yield from wide(x, y)
        return weight + most, pairs + [(x[i], y[j]) for i, j in found]
    cells: dict[tuple[int, int], int] = {}
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, after = best[i], best[i + 1]
        for j in range(len(y) - 1, -1, -1):
            most = after[j] if after[j] >= row[j + 1] else row[j + 1]
            if x[i].tag == y[j].tag and x[i].mark == y[j].mark:
                w = x[i].size if x[i].shape == y[j].shape else 1 if x[i].size == 1 or y[j].size == 1 else (yield x[i], y[j])
                cells[i, j] = w
                most = max(most, w + after[j + 1])
            row[j] = most
    i = j = 0
    while i < len(x) and j < len(y):
        if (i, j) in cells and best[i][j] == cells[i, j] + best[i + 1][j + 1]:
            pairs.append((x[i], y[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return weight + best[0][0], pairs


def wide(x: list[Node], y: list[Node]) -> Generator[tuple[Node, Node], int, tuple[int, list[tuple[int, int]]]]:
    """The same weight and pairs as by a whole table, for lists of any length: a row of the table at a time, and each pair of shapes weighed once.

    Of n rows, every square root of n-th is kept, and those between two of them are made again on the way along the best pairs.
    """
    shapes = [{n.shape: n for n in nodes} for nodes in (x, y)]
    at, to = (np.array([code[n.shape] for n in nodes]) for nodes, code in ((nodes, {s: k for k, s in enumerate(own)}) for nodes, own in zip((x, y), shapes, strict=True)))
    weights = np.zeros((len(shapes[0]), len(shapes[1])), np.int64)
    for i, p in enumerate(shapes[0].values()):
        for j, q in enumerate(shapes[1].values()):
            if p.tag == q.tag and p.mark == q.mark:
                weights[i, j] = p.size if p.shape == q.shape else 1 if p.size == 1 or q.size == 1 else (yield p, q)

    def row(i: int, after: np.ndarray) -> np.ndarray:
        best = np.zeros(len(y) + 1, np.int64)
        best[:-1] = np.maximum.accumulate(np.maximum(after[:-1], weights[at[i]][to] + after[1:])[::-1])[::-1]
        return best

    step, now = math.isqrt(len(x)) + 1, np.zeros(len(y) + 1, np.int64)
    kept = {len(x): now}
    for i in range(len(x) - 1, -1, -1):
        now = row(i, now)
        if i % step == 0:
            kept[i] = now
    pairs, best = [], {}
    i = j = 0
    while i < len(x) and j < len(y):
        if i + 1 not in best:
            end = min(len(x), i + step)
            best = {end: kept[end]}
            for k in range(end - 1, i - 1, -1):
                best[k] = row(k, best[k + 1])
        w = weights[at[i], to[j]]
        if w and best[i][j] == w + best[i + 1][j + 1]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return int(kept[0][0]), pairs


@functools.lru_cache(maxsize=64)
def reference(html: str) -> tuple[Node, list[Node], dict[int, int], list[int]]:
    root = parse(html)
    return root, *numbered(root)


@functools.lru_cache(maxsize=64)
def reference_texts(html: str) -> list[str]:
    """The reference's own text of each node, read once for all pages that are held against it."""
    return [block_text(n) for n in reference(html)[1]]


def aligned(page: Node, ref: str) -> dict[int, Node]:
    """Nodes of a page by the numbers of the reference's nodes that they match."""
    root, _, number, _ = reference(ref)
    return {number[id(b)]: a for a, b in matched(page, root)}


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def with_reference(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each host's reference page, and ``pages`` with it."""
    refs = pages.where(F.length("html") > 0).groupBy("host").agg(F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("ref"))
    refs = stored(refs, "references")
    bound = refs.agg(F.coalesce(F.sum(F.octet_length("ref")), F.lit(0))).first()[0] <= 32_000_000
    return refs, pages.join(F.broadcast(refs) if bound else refs, "host", "left")


def content_nodes(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """``host``, ``node`` and ``template`` of each host's reference page: its content node (-1: none) and the nodes whose text is constant, from all pages of the host."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0])  # varying characters, pages where the text is the same, pages, all characters
        for batch in batches:
            for h, html, ref in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not html or not ref or html == ref:
                    continue
                texts = reference_texts(ref)
                root = parse(html)
                pairs = aligned(root, ref)
                own = {id(node): k for k, node in pairs.items()}
                for k, node in pairs.items():
                    if not node.mark and node.tag not in INLINE:
                        mine, constant = block_text(node), texts[k]
                        x = sums[h, k]
                        x[0] += 0 if mine == constant else len(mine)
                        x[1] += bool(mine) and mine == constant
                        x[2] += 1
                        x[3] += len(mine)
                # blocks that the reference page lacks vary, as a part of what they stand in
                stack = [(root, 0)]
                while stack:
                    n, k = stack.pop()
                    if n.mark or n.tag in INLINE:
                        continue
                    k = own.get(id(n), k)
                    if id(n) not in own:
                        more = len(block_text(n))
                        sums[h, k][0] += more
                        sums[h, k][3] += more
                    stack.extend((x, k) for x in elements(n))
        if sums:
            columns = zip(*((h, k, *v) for (h, k), v in sums.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 5), strict=True)], ["host", "node", "varied", "same", "pages", "all"])

    sums = pages.select("host", "html", "ref").mapInArrow(count, "host string, node long, varied long, same long, pages long, all long")
    by = sums.groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in ("varied", "same", "pages", "all")])
    # as many nodes as the reference page has, so that a host's list is bounded by one page
    listed = by.groupBy("host").agg(F.collect_list(F.struct("node", "varied", "same", "pages", "all")).alias("nodes"))

    def choose(ref: str, nodes: list[dict]) -> tuple[int, list[int]]:
        _, tree, _, parents = reference(ref)
        mass = [0] * len(tree)
        for x in nodes:
            mass[x["node"]] += x["varied"]
        template = sorted(x["node"] for x in nodes if x["pages"] >= PAGES and x["same"] >= CONSTANT * x["pages"] and tree[x["node"]].tag not in HEADINGS and len(reference_texts(ref)[x["node"]]) <= SHORT)
        hidden, kids = [False] * len(tree), defaultdict(list)
        for k in range(1, len(tree)):
            hidden[k] = hidden[parents[k]] or tree[k].mark
            mass[k] *= not hidden[k]
            kids[parents[k]].append(k)
        whole = sum(x["all"] for x in nodes if not hidden[x["node"]])
        for k in range(len(tree) - 1, 0, -1):
            mass[parents[k]] += mass[k]
        at = 0
        if not mass[0] or mass[0] < VARIES * whole:
            return -1, []
        # no varying text of a sibling is left behind
        while tree[at].tag not in ("article", "main"):
            best = max((k for k in kids[at] if tree[k].tag in CONTAINERS and not tree[k].mark), key=lambda k: mass[k], default=None)
            if best is None or mass[best] < mass[0]:
                break
            at = best
        return at if tree[at].tag not in ("#root", "html") else -1, template

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, ref, nodes = (batch.column(i).to_pylist() for i in range(3))
            found = [choose(*x) for x in zip(ref, nodes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array([n for n, _ in found], pa.int32()), pa.array([t for _, t in found], pa.list_(pa.int64()))], ["host", "node", "template"])

    return refs.join(listed, "host").select("host", "ref", "nodes").mapInArrow(pick, "host string, node int, template array<long>")


def own_content(root: Node) -> str:
    """The text of a page by itself: its article or main elements, else its body, else all."""
    nodes, *_ = numbered(root)
    for tags in (("article",), ("main",), ("body",), ("#root",)):
        found: list[Node] = []
        for n in nodes:
            if n.tag in tags and not n.mark:
                found.append(n)
        if found:
            inner = {id(k) for n in found for k in numbered(n)[0][1:]}
            text = " ".join(t for n in found if id(n) not in inner and (t := text_of(n)))
            if text:
                return text
    return ""


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` of every page."""
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), host(F.col(f"`{url}`")).alias("host"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    refs, joined = with_reference(rows)
    nodes = stored(content_nodes(joined, refs), "content")
    ready = joined.join(small(nodes), "host", "left").select("html", "ref", "node", "template", "key", "url")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, ref, node, template in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                root = parse(page)
                text = ""
                if node is not None and node >= 0:
                    texts, pairs = reference_texts(ref), aligned(root, ref)
                    constant = {id(pairs[k]) for k in template if k in pairs and block_text(pairs[k]) == texts[k]}
                    if node in pairs:
                        text = text_of(pairs[node])
                        bare = text_of(pairs[node], template=constant) if constant else text
                        text = bare if len(bare) >= STAYS * len(text) else text
                out.append(text or own_content(root))
            text = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(5), text, pa.array([len(t) for t in out], pa.int64())], ["key", "url", "text", "n_chars"])

    kind = rows.schema["key"].dataType.simpleString()
    out = ready.mapInArrow(read, f"key {kind}, url string, text string, n_chars long")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
