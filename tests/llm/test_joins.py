"""Near-duplicate joins, neighbours, chat repair and HTML extraction against brute force."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from tidemark.llm import chat_format as chat
from tidemark.llm import common, html_extract, line_dedup, neighbours, ngram_join, similarity
from tidemark.llm.similarity import Hasher

DATA = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups_of(docs):
    sets = {k: shingles(t) for k, t in docs}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def near_copies(n, words, edits, seed=1):
    """Texts that differ from one another in a few words, some pairs similar and some not."""
    draw = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for at in draw.integers(0, words, edits):
            own[at] = f"v{draw.integers(10**6)}"
        out.append((100 + k, " ".join(own)))
    return out


def test_ngram_join_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    docs += [(10_000 + k, t) for k, t in near_copies(40, 60, 2)] + [(20_000 + k, t) for k, t in near_copies(30, 13, 1, 5)] + [(30_000 + k, t) for k, t in near_copies(30, 8, 1, 6)]
    found = ngram_join.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == groups_of(docs)


@pytest.mark.parametrize("limits", [(1, 2, 3, 8), (2, 1, 1000, 4096), (4, 16, 1000, 10)])
def test_ngram_join_in_rounds_equals_brute_force(spark, monkeypatch, limits):
    for name, value in zip(("OFFERS", "FEW", "CROWD", "HUGE"), limits, strict=True):
        monkeypatch.setattr(ngram_join, name, value)
    docs = near_copies(60, 60, 2) + [(1000 + k, t) for k, t in near_copies(50, 40, 1, 5)] + [(2000 + k, t) for k, t in near_copies(40, 12, 1, 6)]
    chain = [f"c{k}" for k in range(300)]  # each is similar to those near it only
    docs += [(3000 + k, " ".join(chain[2 * k : 2 * k + 60])) for k in range(40)]
    docs += [(4000 + k, " ".join(chain[:30] + [f"z{k}x{j}" for j in range(20)])) for k in range(40)]  # a passage that many share
    found = ngram_join.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == groups_of(docs)


def test_ngram_join_edges(edges, empty):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(edges).collect()}
    assert found[1] == (0, 1) and found[2] == (0, 2) and found[3] == (0, 3) and found[4] == (1, 4) and found[6] == (3, 5) and found[5] == (3, 5)
    assert found[None][1] is None
    assert ngram_join.link(edges).count() == edges.count() and ngram_join.link(empty).count() == 0
    kept = ngram_join.keep_one(edges)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 7, 8, 9, None}


def test_small_sets_enumerate_what_a_link_asks_for():
    for n, m in product(range(1, 13), range(1, 13)):
        needed = -(-80 * (n + m) // 180)
        if 100 * min(n, m) >= 80 * max(n, m):
            assert needed in ngram_join.subset_sizes(n) and needed in ngram_join.subset_sizes(m)


@settings(max_examples=50, deadline=None)
@given(hs.sets(hs.integers(0, 10**6), max_size=300), hs.sets(hs.integers(0, 10**6), max_size=300))
def test_parity_bounds_the_difference(a, b):
    held = [(k, 0, " ".join(map(str, x)).encode()) for k, x in enumerate((a, b))]
    x = line_dedup.Lines(Hasher(), held, 1)
    bits = dict(zip(x.key.tolist(), x.parity(), strict=True))
    one, two = (bits.get(k, np.zeros(2, np.uint64)) for k in (0, 1))
    assert int(np.bitwise_count(one ^ two).sum()) <= len(a ^ b)
    assert dict(zip(x.key.tolist(), x.n.tolist(), strict=True)) == {k: len(y) for k, y in enumerate((a, b)) if y}


def test_hashes_follow_windows():
    own = Hasher()
    words = [b"a", b"bc", b"a", b"bc", b"a", b"", b"\xc3\xa9"][:5] * 40_000
    h = own.windows(words, 5)
    assert len(h) == len(words) - 4 and len(set(h[:2000].tolist())) == len({tuple(words[k : k + 5]) for k in range(2000)})
    assert own.windows([b"x", b"y"], 5).tolist() == own.windows([b"x", b"y"], 2).tolist()


def test_components(spark):
    draw = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1100)]
    found = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert found.get(start, start) == min(seen)


def removed(docs):
    lines = [(k, i, set(w)) for k, t in sorted(docs) for i, line in enumerate((t or "").encode().lower().split(b"\n")) if (w := line.split())]
    out, before = defaultdict(list), []
    for k, i, s in lines:
        if any(100 * len(s & o) >= 80 * len(s | o) for o in before):
            out[k].append(i)
        before.append(s)
    return out


def test_line_dedup_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(80).collect()]
    docs += [(10_000 + k, "\n".join(t for _, t in near_copies(10, 12, 1, k))) for k in range(4)] + [(20_000, "a b c d e\nA b c d e\nshort\nshort\n")]
    out = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    expect = removed(docs)
    for k, t in docs:
        assert out[k].removed_lines == expect[k]
        assert out[k].text == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in expect[k])


@pytest.mark.parametrize("limits", [(2, 256, 2, 16, 1024, 4096), (3, 15, 1, 2, 10, 10), (8, 8, 1, 1, 4, 8), (512, 256, 1, 16, 1024, 20)])
def test_long_lists_of_lines_equal_brute_force(spark, monkeypatch, limits):
    for name, value in zip(("FREQUENT", "LONG", "CLOSEST", "FEW", "CROWD", "HUGE"), limits, strict=True):
        monkeypatch.setattr(line_dedup, name, value)
    docs = [(k, "\n".join(t for _, t in near_copies(25, 12, 2, k % 3))) for k in range(6)]
    docs += [(100 + k, "\n".join(t for _, t in near_copies(30, 20, 3, 10 + k))) for k in range(3)]
    out = {r.doc_id: r.removed_lines for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    expect = removed(docs)
    assert out == {k: expect[k] for k, _ in docs} and any(expect.values())


def test_line_dedup_edges(edges, empty):
    out = line_dedup.dedup(edges)
    found = defaultdict(list)
    for r in out.collect():
        found[r.doc_id].append((r.text, r.removed_lines))
    assert out.columns == [*edges.columns, "removed_lines"] and out.count() == edges.count()
    assert found[1] == [(None, [])] and found[2] == [("", [])] and found[6] == [("", [0])] * 2 and found[None][0][1] == []
    assert line_dedup.dedup(empty).count() == 0


@pytest.mark.parametrize("sample, held", [(neighbours.SAMPLE, neighbours.HELD), (300, 1)])  # 300: trees split a part of the table, so leaves grow; 1: a leaf's queries in parts
def test_neighbours(spark, sample, held):
    draw = np.random.default_rng(2)
    points = draw.standard_normal((1500, 16))
    points[700:900] = points[700]  # a large class of equal vectors
    rows = [(k, [float(x) for x in p]) for k, p in enumerate(points)]
    rows += [(2000, None), (2100, []), (2200, [0.0] * 16), (2300, [float("nan")] * 16), (2400, [None] + [1.0] * 15), (2500, [1.0] * 3), (None, [1.0] * 16), (100, rows[100][1])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, leaf string, `class` int")
    found = neighbours.search(table, F.col("id") % 100 == 0, sample=sample, held=held).collect()
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        by[r.query_id].append(r)
    assert set(by) == set(range(0, 1500, 100)) and all([r["rank"] for r in v] == list(range(1, 11)) for v in by.values())
    hits = 0
    for q, v in by.items():
        far = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        best = [int(k) for k in np.lexsort((np.arange(1500), far)) if k != q][:10]
        hits += len(set(best) & {r.vec_id for r in v})
        assert all(abs(r.score - far[r.vec_id]) < 1e-9 for r in v)
    assert hits / 150 >= 0.9
    assert [r.vec_id for r in by[700]] == list(range(701, 711)) and [r.vec_id for r in by[800]] == list(range(700, 710))
    assert neighbours.search(table.limit(0), F.col("id") % 100 == 0).count() == 0
    assert neighbours.search(table.where("vec_id = 100"), F.col("id") % 100 == 0).count() == 0


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_recall_on_unstructured_vectors(spark, name):
    """Of 64 dimensions, nearly all of which count."""
    table = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.collect()]
    points = np.array([p for _, p in rows])
    found = defaultdict(set)
    for r in neighbours.search(table, F.col("id") % 25 == 0).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q, p in rows:
        if q % 25 == 0:
            far = np.sqrt(((points - p) ** 2).sum(axis=1))
            hits += len(found[q] & {k for _, k in sorted((d, k) for d, (k, _) in zip(far, rows, strict=True) if k != q)[:10]})
    assert hits >= 0.9 * 10 * len(found)


def cheapest(roles):
    """Least cost over all choices of actions, by trying them."""
    best = [chat.FAR]

    def go(k, state, cost):
        if cost >= best[0]:
            return
        if k == len(roles):
            best[0] = min(best[0], cost + chat.ENDS[state][0])
            return
        for before, after, c, _ in chat.MOVES[roles[k]]:
            if before == state:
                go(k + 1, after, cost + c)

    go(0, chat.START, 0)
    return best[0]


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.sampled_from([-1, 0, 1, 2]), min_size=1, max_size=6), hs.integers(1, 5))
def test_chat_segments_reach_the_least_cost(roles, cut):
    m = np.full((4, 4), chat.FAR)
    m[range(4), range(4)] = 0
    for k in range(0, len(roles), cut):
        step = np.array(chat.matrix_of(roles[k : k + cut]))
        m = np.minimum((m[:, :, None] + step[None]).min(axis=1), chat.FAR)
    assert min(m[chat.START][s] + chat.ENDS[s][0] for s in range(3)) == cheapest(roles)


def test_chat_renders_legal_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "there"), (1, 2, "assistant", "yes"), (2, 0, "assistant", "alone"), (3, 0, "bot", "what"), (3, 1, None, None), (4, 5, "system", "s"), (4, 6, "user", "u"),
            (None, 0, "user", "lost"), (5, None, "user", "first"), (5, 0, "assistant", "second"), (5, 0, "assistant", "second")]
    rows += [(9, k, "user" if k % 3 else "assistant", f"t{k}") for k in range(3000)]
    out = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == len(rows) - 1
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: r.position):
        by[r.conv_id].append(r)
    for c, turns in by.items():
        whole = "".join(r.rendered for r in turns)
        roles = [x.split("\n")[0] for x in whole.split("<|im_start|>")[1:]]
        body = roles[1:] if roles[0] == "system" else roles
        assert body == ["user", "assistant"] * (len(body) // 2) and body and whole.endswith("<|im_end|>\n"), c
        assert [r.position for r in turns] == list(range(len(turns)))
    assert [r.action for r in by[1]] == ["keep", "merge", "keep"] and "hi\n\nthere" in "".join(r.rendered for r in by[1])
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_result_costs_the_least(spark):
    draw = np.random.default_rng(6)
    names = ["system", "user", "assistant", "bot"]
    chats = {c: draw.integers(0, 4, draw.integers(1, 8)).tolist() for c in range(80)}
    rows = [(c, k, names[r], f"t{k}", 1, "x") for c, roles in chats.items() for k, r in enumerate(roles)]
    out = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int, position string")).collect()
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: r.position):
        by[r.conv_id].append(r)
    for c, roles in chats.items():
        codes, state, cost = [r if r < 3 else -1 for r in roles], chat.START, 0
        for k, r in enumerate(by[c]):
            assert r.turn == k
            after = chat.ROLES.index(r.new_role)
            cost += min(m for before, to, m, action in chat.MOVES[codes[k]] if (before, to, action) == (state, after, r.action))
            state = after
        assert cost + chat.ENDS[state][0] == cheapest(codes), (c, roles)


def page(k, body, extra=""):
    return (k, f"http://h.example/{k}", f'<html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><a href="/x">menu {k}</a></nav><div class="ad">buy {k}</div>{body}{extra}<footer>&copy; end</footer></body></html>')


def test_html_extraction(spark):
    rows = [page(k, f'<div id="main-text"><h2>Head {k}</h2><p>first &amp; <b>bo</b>ld {k}<br>more<p>second\n {k}</div>', '<div class="comments"><p>nice!</p></div>') for k in range(12)]
    rows += [page(20, "<article><h1>A</h1><p>b&nbsp;c</p><form><p>no</p></form><aside>no</aside></article>"), (21, None, "<p>x</p></b><i>y"), (22, "http://h.example/z", None), (23, "http://h.example/y", ""), (24, "http://h.example/q", "<p>a < b <"), rows[0]]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert all(text[k] == f"Head {k} first & bold {k} more second {k}" for k in range(12))
    assert text[20] == "A b c" and text[21] == "x y" and text[22] == text[23] == ""
    assert text[24].startswith("a < b")
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_line_dedup_query_takes_lines_of_any_length(spark, tmp_path):
    import corpus_pipeline
    from tidemark.llm import queries

    texts = ["short\nShort\n\n \ntwo words\nwords two", "a b c\na b c d\nd c b a\na b c d e\nx", "SHORT\nx\ntwo\n a  b c d f\nc b a e d"]
    docs = [(k, "\n".join([t, *(x for _, x in near_copies(6, 4, 1, k)), *(x for _, x in near_copies(6, 3, 1, 9))])) for k, t in enumerate(texts)]
    lines = [(k, i, set(w)) for k, t in docs for i, line in enumerate(t.lower().split("\n")) if (w := line.split())]
    expect = {k: [i for j, (o, i, s) in enumerate(lines) if o == k and any(100 * len(s & b) >= 80 * len(s | b) for *_, b in lines[:j])] for k, _ in docs}
    frame = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.removed_lines for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {k: ",".join(map(str, v)) for k, v in expect.items()} and expect[0][:2] == [1, 5]
    cleaned = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, frame, "").collect()}
    assert cleaned == {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in expect[k]) for k, t in docs}


def extracted(spark, bodies, host="g.example"):
    rows = [(k, f"http://{host}/{k}", f"<html><body>{b}</body></html>") for k, b in enumerate(bodies)]
    return {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_keeps_varying_siblings(spark):
    long = lambda k: f"text {k} " * 30
    own = [f"<p>same on all</p><div><h1>Title {k}</h1><div><p>{long(k)}</p></div><section>tail {k}</section></div>" for k in range(8)]
    assert extracted(spark, own) == {k: " ".join(f"Title {k} {long(k)} tail {k}".split()) for k in range(8)}
    own[3] = f"<p>same on all</p><div><h1>Title 3</h1><div><p>{long(3)}</p></div><section>tail 3</section><section><p>{long(33)}</p></section></div>"
    assert long(33).strip() in extracted(spark, own)[3]


def test_html_embedded_elements_end():
    for tag in ("<svg-icon></svg-icon>", "<select-menu>", "<template-x></template-x>", "<svg/>", "<iframe src='x'/>", "<object>", "<svg class='i'>", "<select>", "<noscript>", "<svg>no</svg>", "<svg><svg>no</svg>"):
        text = html_extract.own_content(html_extract.parse(f"<body><p>before</p>{tag}<p>after</p></body>"))
        assert text == "before after", tag
    assert html_extract.own_content(html_extract.parse("<body>a<title-x>b</title-x><script>c</body>")) == "a b"


def test_html_names_mark_whole_tokens(spark):
    read = lambda body: html_extract.own_content(html_extract.parse(f"<body>{body}</body>"))
    for body in ("<article class='post has-sidebar'>kept</article>", "<div class='content no-ads'>kept</div>", "<div class='article-header'>kept</div>", "<div class='page sidebar'>kept</div>", "<div id='main-nav'><main>kept</main></div>"):
        assert read(body) == "kept", body
    for name in ("ad", "post ads", "sidebar-left", "site-footer", "comments_list"):
        assert read(f"<p>{'kept ' * 9}</p><div class='{name}'>gone</div>") == " ".join(["kept"] * 9), name


def test_html_deep_markup_never_fails(spark):
    bodies = [("<div>" * 3000 if k % 2 else "<span>" * 3000) + f"deep {k}" for k in range(4)]
    bodies += ["<font>" * 3000 + "deep 4", "<div>" * 3000 + "deep 5"]
    assert extracted(spark, bodies, "deep.example") == {k: f"deep {k}" for k in range(6)}


def test_html_scanning_and_alignment_stay_linear(spark):
    assert html_extract.own_content(html_extract.parse("<p>first</p>" + '<a x="' * 170_000 + "<p>last</p>")).startswith("first")
    for broken in ("<a title='it\"s'>x</a>", '<a href="y>x</a>'):
        assert html_extract.own_content(html_extract.parse(f"<p>{broken} more")) == "x more"
    assert html_extract.own_content(html_extract.parse("<div>" * 100_000 + "deep")) == "deep"
    items = lambda n, k: "<ul>" + "".join(f"<li>{'<b>' if (i * k) % 7 == 0 else '<i>'}item {k} {i}</li>" for i in range(n)) + "</ul>"
    found = extracted(spark, [f"<div class='menu'>m</div><article>{items(20_000 + k, k + 1)}</article>" for k in range(3)], "wide.example")
    assert all(found[k] == " ".join(f"item {k + 1} {i}" for i in range(20_000 + k)) for k in found)


def test_html_wide_match_is_the_heaviest():
    draw = np.random.default_rng(4)
    tags = ["<p></p>", "<p><b></b></p>", "<ul><li></li><li></li></ul>", "<ul></ul>"]
    for _ in range(60):
        x, y = (html_extract.elements(html_extract.parse("".join(tags[k] for k in draw.integers(0, 4, draw.integers(1, 9))))) for _ in range(2))
        weight = lambda a, b: a.size if a.shape == b.shape else int(a.tag == b.tag)
        best = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + weight(a, b) if weight(a, b) else 0)
        found = html_extract.wide(x, y)
        assert sum(weight(x[i], y[j]) for i, j in found) == best[-1, -1]
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:]))


def test_html_leaves_constant_blocks_out(spark):
    bodies = [f"<article><h1>Title {k}</h1><p>Follow us on our channels</p><p>text {k} words</p><div><span>Share</span> this</div><p>end {k}</p></article>" for k in range(6)]
    assert extracted(spark, bodies, "const.example") == {k: f"Title {k} text {k} words end {k}" for k in range(6)}
    two = [f"<article><p>same words</p><p>text {k}</p></article>" for k in range(2)]  # too few pages to tell
    assert extracted(spark, two, "two.example") == {k: f"same words text {k}" for k in range(2)}


def test_html_keeps_content_with_telling_names(spark):
    body = "<article><h2 class='section-header'>Head</h2><p class='related-work'>work</p><p class='share-buttons'>gone</p><p class='comment'>gone</p></article>"
    assert html_extract.own_content(html_extract.parse(body)) == "Head work"


def test_html_edges_and_clashing_columns(spark):
    rows = [(1, "http://e.example/1", None, "a", 1), (1, "http://e.example/1", "<p>x</p>", "b", 2), (1, "http://e.example/1", "<p>x</p>", "b", 2), (None, None, "y", None, None)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, node int")).collect()
    assert sorted((r.page_id or 0, r.text) for r in out) == [(0, "y"), (1, ""), (1, "x"), (1, "x")]


def test_pairs_whose_bitmaps_are_apart_are_dropped_and_no_link_is(spark):
    draw = np.random.default_rng(12)
    sets = [draw.integers(0, 2**63, 500, np.uint64)]
    for edits in (0, 20, 50, 55, 56, 57, 80, 150, 400):  # in place of as many others; 55 are the most that link
        sets.append(np.concatenate((sets[0][edits:], draw.integers(0, 2**63, edits, np.uint64))))
    sets += [sets[0][:400], sets[0][:399], sets[0][:1], sets[0][:0]]
    rows = [(k, len(x), ngram_join.parity(x).tolist()) for k, x in enumerate(sets)] + [(9, 500, ngram_join.parity(sets[0]).tolist()), (None, 500, None)]
    bitmaps = spark.createDataFrame(rows, "key long, n long, parity array<long>")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 14)] + [(12, 13), (0, 99), (None, 1)], "a long, b long")
    found = {tuple(r) for r in ngram_join.near(pairs, bitmaps).collect()}
    shared = [len(np.intersect1d(sets[0], x)) for x in sets]
    links = {(0, k) for k in range(1, 14) if 100 * shared[k] >= 80 * (500 + len(sets[k]) - shared[k])}
    assert links == {(0, k) for k in (1, 2, 3, 4, 10)} and links <= found
    assert (0, 9) in found  # one of two rows of its id
    assert not found & {(0, 8), (0, 12), (0, 13), (12, 13), (0, 99)} and all(None not in r for r in found)
    for x in sets:
        bits = np.bitwise_count((ngram_join.parity(x) ^ ngram_join.parity(sets[0])).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(x, sets[0]))


def test_shingles_that_share_a_cell_are_all_counted(spark):
    texts = [" ".join(f"w{k}" for k in range(30_000)), "a b c d e", "A b  c d e", "one", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "key long, text string").coalesce(1)
    slices = {r.slice: zlib.decompress(r.data) for r in ngram_join.sets(rows).where("slice is not null").collect()}
    counted = {(k << 16) + int(i): int(n) for k, data in slices.items() for x in [np.frombuffer(data, "<u2")] for i, n in zip(np.flatnonzero(x), x[x > 0], strict=True)}
    cells = [h >> (64 - ngram_join.BITS) for t in texts for h in ngram_join.shingler()(t).tolist()]
    assert len(set(cells[:29_996])) < 29_996 == len(cells) - 3 and counted == Counter(cells)


def test_whole_texts_are_dealt_out_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c"), (1, "x y"), (2, "A  b c"), (3, "x y"), (4, None), (5, ""), (None, "a b c"), (6, "a b d")], "key long, text string")
    pairs = spark.createDataFrame([(1, -1, b, -1) for b in (2, 3, 4, 5, 6, 9)] + [(4, -1, 5, -1), (None, -1, 2, -1)], "a long, a_line int, b long, b_line int")
    words = lambda: lambda text: frozenset(similarity.lower_words(text))
    monkeypatch.setattr(similarity, "MEMBERS", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = similarity.verify(pairs, docs, words, whole=True)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2 and "Generate" not in plan
        expect = sorted(map(tuple, similarity.verify(pairs, docs, words).collect()))
        assert sorted(map(tuple, found.collect())) == expect and {r[2] for r in expect if r[0] == 1} == {2, 3}
        monkeypatch.setattr(similarity, "small", lambda df: df)  # too many to broadcast
        assert sorted(map(tuple, similarity.verify(pairs, docs, words, whole=True).collect())) == expect
        assert similarity.verify(pairs.limit(0), docs, words, whole=True).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_postings_are_packed_and_restored():
    import numpy as np

    from tidemark.llm import ngram_join as join

    draw = np.random.default_rng(4)
    keys = np.sort(np.concatenate((draw.integers(-(2**63), 2**63, 900), [2**63 - 1, -(2**63), 0])))
    sizes = draw.integers(1, 3000, len(keys)).astype(np.int32)
    token = draw.integers(0, 2**64, 3 * len(keys), np.uint64)
    x = {"token": token.astype(np.uint32), "key": np.repeat(keys, 3), "n": np.repeat(sizes, 3), "place": np.tile([0, 7, 65535], len(keys)).astype(np.uint16), "crowded": draw.random(len(token)) < 0.1}
    sent = join.dealt(0, token, x, 5)
    plain, packed = sent.column(2).to_pylist(), join.squeezed(sent).column(2).to_pylist()
    before, after = join.together(plain, join.POSTING), join.restored(packed)
    assert all((before[c] == after[c]).all() and before[c].dtype == after[c].dtype for c in join.POSTING)
    ids = np.arange(5000)  # as documents come in a batch: a small part of the bytes, but for the hashes
    x = {"token": draw.integers(0, 2**32, 5000).astype(np.uint32), "key": ids, "n": np.full(5000, 90, np.int32), "place": np.zeros(5000, np.uint16), "crowded": np.zeros(5000, bool)}
    sent = join.dealt(0, draw.integers(0, 2**64, 5000, np.uint64), x, 1)
    assert len(join.squeezed(sent).column(2)[0].as_py()) < 5 * 5000
