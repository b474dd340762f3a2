"""HTML extraction loses no article text, and aligns as a search over all matches does."""

from __future__ import annotations

from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from tidemark.llm import html_extract as html

BODY = "<p>" + "</p><p>".join(f"sentence {j} of a long article that stands here" for j in range(12)) + "</p>"


def texts(spark, pages):
    rows = [(k, f"https://host.example/{k}", p) for k, p in enumerate(pages)]
    return [r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def page(k, inner):
    words = " ".join(f"w{k}x{j}" for j in range(80))
    return "<html><body><nav>Home News Contact</nav>" + inner.replace("{k}", str(k)).replace("{words}", words) + "<footer>imprint</footer></body></html>"


@pytest.mark.parametrize("inner, kept", [
    ("<div><h1>Title {k}</h1><article><p>{words}</p></article></div>", "Title {k} {words}"),
    ("<div><article><h2>Introduction</h2><p>{words}</p><h2>Conclusion</h2><p>end {k}</p></article></div>", "Introduction {words} Conclusion end {k}"),
    ("<main><p>{words}</p></main><div>second part {k}</div>", "{words} second part {k}"),
    ("<div><h1>Title {k}</h1><div><p>{words}</p></div></div>", "Title {k} {words}"),
    ("<div class='sidebar'>other {k}</div><article><p>{words}</p></article>", "{words}"),
    ("<article><p>{words}</p><p>Follow us</p></article>", "{words}"),
])
def test_no_part_of_an_article_is_lost(spark, inner, kept):
    expect = [page(k, kept).split("Contact</nav>")[1].split("<footer>")[0] for k in range(8)]
    assert texts(spark, [page(k, inner) for k in range(8)]) == expect


@pytest.mark.parametrize("inner", ["<article>{body}<p>Version {k}</p></article>", "<div>{body}</div><div>Version {k}</div>", "<main>{body}</main><p>Version {k}</p>"])
def test_one_article_at_many_addresses(spark, inner):
    found = texts(spark, [page(k, inner.replace("{body}", BODY)) for k in range(8)])
    assert all("sentence 0 of" in t and "sentence 11 of" in t and "Home" not in t and "imprint" not in t for t in found)


TREE = hs.recursive(hs.sampled_from("abc").map(lambda t: (t, ())), lambda kids: hs.tuples(hs.sampled_from("abc"), hs.lists(kids, max_size=3).map(tuple)), max_leaves=7)


def built(tree):
    tag, kids = tree
    return f"<x-{tag}>" + "".join(map(built, kids)) + f"</x-{tag}>"


@cache
def heaviest(a, b):
    """Simple tree matching by trying all order-keeping matches."""
    if a[0] != b[0]:
        return 0

    @cache
    def pairs(i, j):
        if i == len(a[1]) or j == len(b[1]):
            return 0
        return max(pairs(i + 1, j), pairs(i, j + 1), heaviest(a[1][i], b[1][j]) + pairs(i + 1, j + 1))

    return 1 + pairs(0, 0)


@settings(max_examples=150, deadline=None)
@given(TREE, TREE)
def test_alignment_is_the_heaviest(a, b):
    a, b = ("r", (a,)), ("r", (b,))
    one, two = html.parse(built(a)), html.parse(built(b))
    found = html.matched(one, two)
    assert len(found) - 1 == heaviest(a, b)  # the root of the page comes on top
    assert all(x.tag == y.tag for x, y in found) and len({id(x) for x, _ in found}) == len(found) == len({id(y) for _, y in found})
    order = lambda root: {id(n): k for k, n in enumerate(html.numbered(root)[0])}
    first, second = order(one), order(two)
    at = sorted((first[id(x)], second[id(y)]) for x, y in found)
    assert [j for _, j in at] == sorted(j for _, j in at)


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.sampled_from(["<p>x</p>", "<p>x<b>y</b></p>", "<ul><li>a<li>b<b>c</b></ul>", "<ul><li>a</ul>", "<div><p>t</p></div>", "<div></div>", "<i>z</i>"]), min_size=2, max_size=24).flatmap(lambda v: hs.tuples(hs.just(v), hs.permutations(v))))
def test_alignment_is_the_same_at_any_size(kinds):
    a, b = (html.parse("<main>" + "".join(k) + "</main>") for k in kinds)
    found = []
    for most in (0, 10**9):
        before, html.TABLE = html.TABLE, most
        try:
            found.append([(id(p), id(q)) for p, q in html.matched(a, b)])
        finally:
            html.TABLE = before
    assert sorted(found[0]) == sorted(found[1])


def test_many_children_align_by_their_whole_weight():
    empty, large = "<div></div>" * 250, lambda end: "<div>" + "<p>x</p>" * 300 + end + "</div>"
    left, right = html.parse("<ul></ul>" + large("<b>y</b>") + empty + "<ol></ol>"), html.parse("<dl></dl>" + empty + large("<i>y</i>") + "<table></table>")
    pairs = html.matched(left, right)
    assert any(len(p.kids) > 300 and len(q.kids) > 300 for p, q in pairs[1:] if p.tag == q.tag == "div")  # of 300 paragraphs, not 250 empty elements
    assert len(pairs) == 1 + 301
