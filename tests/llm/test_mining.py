"""Decontamination, collocations and spelling variants against brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from tidemark.llm import collocations, decontamination, spelling, tokens

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(docs, items, width=10):
    """By trying every window at every place."""
    windows = defaultdict(set)
    for k, t in items:
        w = alnum(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(k)
    sizes, out = {len(w) for w in windows}, []
    for k, t in docs:
        w, hit, found = alnum(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in windows[g] if x is not None}
        out.append((k, len(w), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    items += [(500, "the"), (501, "of the"), (502, "is, only; HEND"), (503, "no such thing stands in any of these documents at all, I hope"), (504, items[0][1]), (500, "thint")]
    docs += [(9000 + k, " ".join(alnum(t)[k : k + 8 + k])) for k, (_, t) in enumerate(items[:12])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expect = contaminated(docs, items)
    assert sorted(map(tuple, decontamination.digest(d, b).collect()), key=repr) == expect and 0 < sum(x[-1] for x in expect)
    # in blocks, with other shingles
    found = decontamination.scan(d, b, most=20_000, shingle=2)
    again = found.select("doc_id", "n_words", decontamination.hit_words(F.col("spans")), F.size("items"), F.sha2(F.array_join("items", ","), 256), F.size("spans") > 0)
    assert sorted(map(tuple, again.collect()), key=repr) == expect


def test_passages_across_the_parts_of_a_long_text(spark):
    draw = np.random.default_rng(4)
    passage = [f"P{k}ä" for k in range(23)]
    w = [f"w{x}" for x in draw.integers(0, 5000, 420_000)]
    for at in range(50, len(w) - 30, 997):
        w[at : at + 23] = passage
    docs = [(1, " ".join(w)), (2, "short"), (3, ", ".join(w[:2000])), (4, "x" * 3_000_000 + " " + " ".join(passage[:10]))]
    items = [(7, " ".join(passage)), (8, "w1 w2"), (9, "short")]
    assert len(docs[0][1].encode()) > 2 * tokens.PART
    found = decontamination.digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == contaminated(docs, items)


@pytest.mark.parametrize("most", [1, 7, 40, 1000])
def test_parts_hold_every_word_once(most):
    texts = ["", None, "one two", "a" * 90 + " b", "three, four; five " * 9, "é" * 30, "x", " "]
    found = defaultdict(list)
    for part in tokens.parts(pa.array(texts), tokens.NOT_ALNUM, most):
        starts, ends = tokens.runs(~tokens.NOT_ALNUM[np.frombuffer(part.data, np.uint8)])
        for row, a, b in zip(part.rows[tokens.row_of(part, starts)].tolist(), starts.tolist(), ends.tolist(), strict=True):
            found[row].append(part.data[a:b].decode())
    assert dict(found) == {k: alnum(t) for k, t in enumerate(texts) if alnum(t)}


def test_decontamination_edges(spark, edges, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "the end"), (None, "CÔDé;odd".replace("CÔ", "cô")), (4, "...")], "item_id long, text string")
    found = defaultdict(list)
    for r in decontamination.digest(edges, items).collect():
        found[r.doc_id].append((r.n_words, r.n_hit, r.n_items, r.contaminated))
    assert found[1] == [(0, 0, 0, False)] == found[2] == found[3] and found[8] == [(18_000, 6000, 1, True)]
    assert found[9] == [(5, 2, 0, True)] and len(found[6]) == 2 and found[None] == [(7, 0, 0, False)] and len(found) == 10
    assert decontamination.digest(empty, items).count() == 0 and decontamination.digest(edges, items.limit(0)).where("contaminated").count() == 0
    clashing = edges.withColumn("spans", F.lit(1)).withColumn("items", F.lit(2)).withColumn("n_words", F.lit(3))
    assert decontamination.digest(clashing, items).count() == edges.count()


def test_clean_drops_documents_by_their_share_of_hits(edges, empty):
    spark = edges.sparkSession
    items = spark.createDataFrame([(3, "the end"), (4, "seven")], "item_id long, text string")
    rows = edges.withColumn("spans", F.lit("s")).withColumn("row", F.lit(2)).withColumn("a b", F.lit(3))
    all_ids = {r.doc_id for r in rows.collect()}
    one, some = decontamination.clean(rows, items), decontamination.clean(rows, items, percent=20)
    assert one.columns == rows.columns and {r.doc_id for r in one.collect()} == all_ids - {5, 6, 8}
    assert {r.doc_id for r in some.collect()} == all_ids - {8} and some.where("doc_id = 6").count() == 2  # one word of seven is hit, and a third of all
    assert [r["a b"] for r in some.where("doc_id = 5").collect()] == [3] and decontamination.clean(empty, items).count() == 0


def phrases(docs, least, top):
    """Every phrase counted, every cut tried."""
    counts, words = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    held = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in held.items():
        if any(x == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in held.items()):
            continue
        score, _, l, r = min((1000 * a * words[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, n + 1, p.decode(), -a, l, r, words[lang], -s) for lang, found in out.items() for n, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("least, top, bits", [(4, 30, 26), (3, 2000, 12), (300, 5, 26)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, top, bits):
    draw = np.random.default_rng(8)
    vocabulary = ["New", "york", "is", "a", "city", "of", "the", "é", "x\x1fy", "big\tapple", "los  angeles", "end.", "so,"]
    docs = [(("en", "de", None)[k % 3], " ".join(draw.choice(vocabulary, draw.integers(0, 60)))) for k in range(60)]
    docs += [("en", None), ("en", ""), ("und", "new york is a city. New york is a city"), ("fr", "un deux trois " * 400), ("fr", "un deux trois quatre cinq six\r" * 5)]
    rows = spark.createDataFrame(docs, "lang string, text string")
    found = collocations.frequent(rows, least=least, most_bits=bits)[0]
    assert found.count() > 0
    monkeypatch.setattr(collocations.frequent, "__defaults__", ("lang", "text", least, bits))
    got = collocations.collocations(rows, least=least, top=top).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == phrases(docs, least, top)


def test_sketches_lose_nothing_and_rounds_share(spark):
    docs = [("en", f"w{k % 97} v{k % 89} u{k % 83}.") for k in range(40_000)]
    rows = spark.createDataFrame(docs, "lang string, text string")
    one, many = ({(r.phrase, r.a) for r in collocations.frequent(rows, least=100, most_bits=b)[0].collect()} for b in (26, 11))
    truth = Counter(g for _, t in docs for w in [t[:-1].split()] for k in (1, 2, 3) for g in (" ".join(w[i : i + k]) for i in range(4 - k)))
    assert one == many == {(p, n) for p, n in truth.items() if n >= 100}


def test_phrases_add_up_over_the_parts_of_a_task(spark):
    text = "one  two\tthree, four " * 20_000
    rows = spark.createDataFrame([(lang, text) for lang in ("en", None) for _ in range(8)] + [("en", None), ("en", "")], "lang string, text string").coalesce(1)
    found = {(r.lang, r.phrase): r.a for r in collocations.frequent(rows)[0].collect()}
    each = ("one", "two", "three", "four", "one two", "two three", "one two three", "four one", "four one two", "four one two three")
    assert found == {(lang, p): 8 * (20_000 - p.startswith("four ")) for lang in ("en", "und") for p in each}


def test_tally_asks_for_a_phrase_once_and_tells_those_that_share_a_hash():
    tally, u = collocations.Tally(), lambda *x: np.array(x, np.uint64)
    assert tally.add(u(3, 7, 7), u(1, 1, 2), np.array([5, 6, 7])).tolist() == [0, 1, 2] and tally.counts.tolist() == [5, 6, 7]
    assert tally.add(u(), u(), np.zeros(0, np.int64)).tolist() == []
    assert tally.add(u(1, 3, 3, 9), u(1, 1, 2, 1), np.array([1, 10, 20, 30])).tolist() == [0, 2, 3]
    assert tally.add(u(1, 9), u(1, 1), np.array([0, 0])).tolist() == []
    assert sorted(zip(tally.first.tolist(), tally.second.tolist(), tally.counts[tally.place].tolist(), strict=True)) == [(1, 1, 1), (3, 1, 15), (3, 2, 20), (7, 1, 6), (7, 2, 7), (9, 1, 30)]


def test_longer_phrases_are_sketched_only_where_their_pairs_are_frequent(spark):
    texts = ["New York city hall."] * 150 + [f"a{k} rare{k} text{k} of{k} words{k}" for k in range(500)] + [None, ""]
    rows = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").coalesce(1)

    def cells(lengths, sieves, number=0, rounds=1):
        slices = collocations.sketched(rows, lengths, 16, sieves, number, rounds, 100).where("slice >= 0").orderBy("slice").collect()
        return [int(np.count_nonzero(np.frombuffer(zlib.decompress(s.data), np.uint8))) for s in slices]

    first, longer = collocations.SKETCHES
    reached, words = collocations.merged(collocations.sketched(rows, first, 16, [], 0, 1, 100), 16, 100)
    sieve = collocations.Sieve(first, 16, reached)
    assert cells(longer, [sieve]) == [3, 3] and [tuple(r) for r in words.collect()] == [("en", 3100)]  # two of three words, one of four
    assert all(n > 2000 for n in cells(longer, []))
    # in rounds, parts of another round pass
    assert sum(cells(longer, [sieve], number, 2)[0] for number in range(2)) >= 3
    found = {(r.phrase, r.a) for r in collocations.frequent(rows)[0].collect()}
    assert found == {(" ".join("new york city hall".split()[i : i + k]), 150) for k in range(1, 5) for i in range(5 - k)}


@pytest.mark.parametrize("words", [5_000, 60_000])
def test_slices_of_a_sketch_are_smaller_than_a_search_for_repeats_makes_them(spark, words):
    text = " ".join(f"w{k}" for k in np.random.default_rng(3).integers(0, 10**6, words))
    rows = spark.createDataFrame([("en", text)], "lang string, text string")
    found = collocations.sketched(rows, collocations.SKETCHES[0], 16, [], 0, 1, 100).where("slice >= 0").collect()
    assert len(found) == 2 and all(len(r.data) < len(zlib.compress(zlib.decompress(r.data), 1)) for r in found)


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**14 + 7, 10**15 + 3, 10**14 + 9, 10**15 + 11), (100, 100, 100, 10**15), (3, 7, 11, 10**9 + 7), (2**53 + 1, 2**53 + 1, 1, 3)]
    found = collocations.with_score(spark.createDataFrame(rows, "a long, l long, r long, n long")).collect()
    assert [r.score for r in found] == [1000 * a * n // (l * r) for a, l, r, n in rows]


def test_collocations_edges(edges, empty):
    assert collocations.collocations(empty).count() == 0
    found = collocations.collocations(edges.withColumn("a", F.lit(1)).withColumn("w", F.lit(2)), least=2).collect()
    assert any(r.phrase == "the end of a long" and r.a == 3000 for r in found) and {r.lang for r in found} == {"en"}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def variants(counts):
    out, form = {}, {}
    for w, n in counts.items():
        around = [x for x in counts if near(w, x)]
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
        out[w] = len(around)

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, out[w], counts[form[w]] if form[w] else -1) for w, n in counts.items())


def slipped(docs, every=199, least=5):
    counts = Counter()
    for k, t in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if every and h % every == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}


def rows_of(frame):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in frame.collect())


@pytest.mark.parametrize("shard", [3, 40, 20_000])
def test_spelling_variants_equal_brute_force(spark, shard):
    draw = np.random.default_rng(6)
    words = sorted({"".join(draw.choice(list("abÿ"), draw.integers(6, 9))) for _ in range(350)} | {"receive", "recieve", "receives", "aaaaaa", "aaaaaaa", "aaaaaaaa"})
    docs = [(k, " ".join(draw.choice(words, 40)) + ". " + " ".join(words[:3] * 40)) for k in range(60)] + [(None, " ".join(words[::7] * 5)), (900, None), (901, "")]
    docs += [(1000 + k, "Receive,RECEIVE-receive_receive9receive" * 3) for k in range(5)] + [(1000, "recieve " * 5)]
    found = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), slip_every=5, shard=shard)
    expect = variants(slipped(docs, 5))
    assert rows_of(found) == expect and any(r != w for w, _, r, *_ in expect)


def test_spelling_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    counts = slipped(docs)
    found = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), slip_every=199, shard=300)
    assert {(r.word, r.n) for r in found.select("word", "n").collect()} == set(counts.items()) and len(counts) > 500
    some = set(sorted(counts)[::9])
    full = {w: sum(near(w, x) for x in counts) for w in some}
    assert {r.word: r.n_near for r in found.collect() if r.word in some} == full


def test_spelling_edges(spark, edges, empty):
    assert spelling.variants(empty).count() == 0
    found = spelling.variants(edges.withColumn("n", F.lit(1)).withColumn("word", F.lit("x"))).collect()
    assert found == [] or all(len(r.word) >= 6 and r.n >= 5 for r in found)
    long = spark.createDataFrame([(1, "abcdefg " * 200_000 + "z" * 2_000_000), (2, "abcdefh " * 6)], "doc_id long, text string")
    assert rows_of(spelling.variants(long)) == [("abcdefg", "", "abcdefg", 200_000, 1, -1), ("abcdefh", "abcdefg", "abcdefg", 6, 1, 200_000)]


WORDS = hs.lists(hs.text("abc", min_size=1, max_size=7), min_size=1, max_size=40, unique=True).map(sorted)


@settings(max_examples=120, deadline=None)
@given(WORDS, hs.text("abc", min_size=1, max_size=7), hs.integers(0, 4))
def test_automaton_numbers_and_completes(words, query, half):
    own = spelling.Automaton(words)
    assert [own.number(w) for w in words] == list(range(len(words))) and own.number("zz") is None
    half = min(half, len(query))
    assert own.near(query, half) == {k for k, w in enumerate(words) if w[:half] == query[:half] and near(w, query)}


def test_automaton_is_minimal():
    """As many states as there are sets of endings."""
    words = sorted({a + b + c for a in ("", "x", "yy") for b in ("a", "b", "cab") for c in ("", "s", "ing", "ed")})
    endings = {tuple(sorted(w[len(p) :] for w in words if w.startswith(p))) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert len(spelling.Automaton(words).edges) == len(endings)


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.tuples(hs.integers(0, 10**6), hs.binary(max_size=30)), min_size=1, max_size=20))
def test_crc_of_many_spans(rows):
    data = b"".join(x for _, x in rows)
    ends = np.cumsum([len(x) for _, x in rows])
    starts = ends - [len(x) for _, x in rows]
    state = np.array([zlib.crc32(f"{k}:".encode()) for k, _ in rows], np.uint32)
    assert spelling.crc_after(state, data, starts, ends).tolist() == [zlib.crc32(f"{k}:".encode() + x) for k, x in rows]


def test_packing_remembers_what_comes_again(monkeypatch):
    from tidemark.llm import packing
    from tidemark.llm.queries import tokenizer_path

    monkeypatch.setattr(packing, "REMEMBERED", 40)
    monkeypatch.setattr(packing, "AT_ONCE", 7)
    monkeypatch.setattr(packing, "GROUPED", 3)
    own = packing.ChunkEncoder(tokenizer_path())
    texts = [f"The often met words, word{k} (odd{k}) {k}! ÜBER {'x' * 30} \x01 <|a|>" for k in range(60)] + [None, "", " ", "a\x1cb"]
    found = [list(memoryview(ids).cast("I")) for ids in own.encode(texts)]
    assert found == [[*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert {"often", "words,", "words"} <= set(own.chunks) and not {"word7", "(odd7)"} & set(own.chunks) and len(own.chunks) <= 40
