"""Quality rules, license scans, the classifier, packing, mixing and the pipeline's filters."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import license_scan, mixing, packing, quality_classifier, quality_rules
from tidemark.llm.oracles import ORACLES
from tidemark.llm.queries import QUERIES, tokenizer_path

DATA = "/root/testdata/sf0.001"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(r[i] for i in order) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    own = QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert rows(own.columns, own.collect()) == rows(columns, cursor.fetchall())


def repeated(words):
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(k, k + 5))
    return len(covered)


def test_quality_rules_edges(edges, empty):
    for r in quality_rules.judge(edges).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(words), repeated(words), sum(map(len, words)))
        assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words)) and not (r.base_failed and r.kept)
        low = [w.lower() for w in words]
        assert r.n_stop == sum(w in quality_rules.STOP_WORDS for w in low) and ("stop_words" in r.failed) == (len(words) >= 100 and 100 * r.n_stop < 2 * len(words))
    kept = quality_rules.keep(edges)
    assert kept.columns == edges.columns and quality_rules.keep(empty).count() == 0


def test_license_scan_edges(edges, empty):
    found = {r.doc_id: r for r in license_scan.digest(edges).collect()}
    assert found[1].n_words == 0 and found[1].labels == "" and found[1].score == 0
    assert license_scan.digest(empty).count() == 0
    spark = edges.sparkSession
    texts = [(1, "All rights\nreserved. CC-BY; cc by"), (2, "x\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files"), (3, "general public licenses")]
    out = {r.doc_id: r for r in license_scan.digest(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels) == (3, 0, 5, "cc-by,reserved")
    assert out[2].labels == "mit" and 0.8 <= out[2].score < 1 and out[3].n_base == 0


def test_classifier_holds_out_and_separates(spark, edges, empty):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels)
    seen = quality_classifier.classify(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in seen)
    assert np.mean([r.predicted == r.quality for r in seen]) > 0.9
    scored = quality_classifier.classify(edges, model).collect()
    assert len(scored) == edges.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality_classifier.classify(empty, model).count() == 0
    none = quality_classifier.fit(docs, labels.limit(0))
    assert quality_classifier.classify(edges, none).first().score == 1.0


def test_chunks_are_encoded_as_whole_texts():
    draw, letters = np.random.default_rng(5), list("ab'sZİßǅé\u0301한글1２.,;:!?#$%&*()[]{}+-/=@^_~<|>\x01\x1c\x85\u00a0\u200b😀 \t\n\u2003\u3000İI'ReS’ς")
    texts = ["".join(draw.choice(letters, draw.integers(0, 60))) for _ in range(4000)] + ["<|endoftext|> a", "x<|startoftext|>y", "", None, "'s", "don't.", "it's,", "\x01", "a \x01 b"]
    own = packing.ChunkEncoder(tokenizer_path())
    for _ in range(2):  # chunks new and known
        assert list(own.encode(texts)) == [np.asarray([*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]


def check_pieces(found, texts, repeats=1):
    encoder = packing.ChunkEncoder(tokenizer_path()).tokenizer
    ids = {k: np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for k, t in texts.items()}
    used, total = {}, Counter()
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        total[r.doc_id] += r.length
    assert max(used.values()) <= packing.CAPACITY
    return ids, total, used


def test_packing(spark, edges, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    ids, total, used = check_pieces(packing.pack(docs, tokenizer_path()).collect(), texts)
    assert all(total[k] == len(v) for k, v in ids.items())
    assert sum(total.values()) / len(used) / packing.CAPACITY > 0.9
    own = {r.doc_id: r.text for r in edges.select("doc_id", "text").collect()}
    ids, total, _ = check_pieces(packing.pack(edges, tokenizer_path()).collect(), own)
    assert total[6] == 2 * len(ids[6]) and all(total[k] == len(ids[k]) for k in ids if k != 6)
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_plan_uses_every_piece_once():
    draw = np.random.default_rng(3)
    histogram = Counter(np.minimum(256, draw.lognormal(4, 1, 5000).astype(int) + 1).tolist())
    patterns, left = packing.plan(histogram, 256), Counter(histogram)
    for pattern, copies in patterns:
        assert sum(s * n for s, n in pattern.items()) <= 256
        left.subtract({s: n * copies for s, n in pattern.items()})
    assert not any(left.values())
    assert sum(c for _, c in patterns) <= 1.01 * sum(s * n for s, n in histogram.items()) / 256 + 1


def test_mixing_meets_limit_and_budget(spark, edges, empty):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 7), "abc"[0 if k < 600 else 1 if k < 900 else 2]) for k in range(1000)], "doc_id long, text string, source string")
    even = mixing.mix(docs, entropy_share=None, limit=2.0, budget_share=None)
    copies = {r.doc_id: r.n for r in even.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert len(copies) == 1000 and max(copies.values()) == 2 and all(copies[k] == 1 for k in range(600))
    words = {r.source: r.n for r in even.groupBy("source").agg(F.sum("n_words").alias("n")).collect()}
    whole = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert words["c"] == 2 * whole["c"]
    power = 1 - np.log(2) / np.log(whole["a"] / whole["c"])
    aim = whole["a"] * (whole["b"] / whole["a"]) ** power
    assert aim - 7 <= words["b"] <= aim + 1e-6
    same = mixing.mix(docs, entropy_share=1.0, limit=None, budget_share=1.0)
    parts = [r.n for r in same.groupBy("source").agg(F.sum("n_words").alias("n")).collect()]
    assert max(parts) - min(parts) <= 14 and sum(parts) <= sum(whole.values())
    assert mixing.mix(empty).count() == 0
    out = mixing.mix(edges, entropy_share=None, limit=2.0, budget_share=None)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in edges.collect()}


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "end", "left", "low", "fine", "passes", "open", "n_words", "copy", "_hash", "_source", "taken"]
    rows = [(k, "w " * (k % 5), "ab"[k % 2], *[f"{n}{k}" for n in names[3:]]) for k in range(40)] + [(None, None, None, *[None] * 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names[3:]))
    out = mixing.mix(docs, entropy_share=None, limit=2.0, budget_share=None)
    assert out.columns == [n for n in names if n not in ("n_words", "copy")] + ["n_words", "copy", "order_key"]
    assert all(r.end == f"end{r.doc_id}" and r.left == f"left{r.doc_id}" and r.n_words == r.doc_id % 5 for r in out.collect() if r.doc_id is not None)


def test_license_digest_keeps_repeated_rows_apart(spark):
    texts = [(1, "under the MIT license"), (1, "cc by and more words"), (1, "cc by and more words"), (None, "all rights reserved"), (None, None), (None, "plain")]
    out = license_scan.digest(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.labels) for r in out) == [(0, 0, ""), (0, 1, ""), (0, 3, "reserved"), (1, 4, "mit"), (1, 5, "cc-by"), (1, 5, "cc-by")]


NOTICES = [
    ("Released under the MIT License.", "mit"), ("Licensed under MIT license", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under Apache-2.0", "apache-2.0"),
    ("Released under the BSD License", "bsd"), ("Licensed under the BSD 3-Clause License.", "bsd"), ("Licensed under BSD-2-Clause", "bsd"), ("Released under the GNU General Public License", "gpl"),
    ("Licensed under the GPL, version 3", "gpl"), ("Released under GPLv3", "gpl"), ("Licensed under GPLv2.", "gpl"), ("Released under the Mozilla Public License 2.0", "mpl-2.0"),
    ("Licensed under the MPL 2.0", "mpl-2.0"), ("Licensed under the ISC license.", "isc"), ("Released under CC BY 4.0", "cc-by"), ("Licensed under the Creative Commons Attribution License", "cc-by"),
    ("Released under CC0 1.0", "cc0"), ("Licensed under the Creative Commons Zero license", "cc0"), ("Released under the Unlicense.", "unlicense"), ("All rights reserved.", "reserved"),
    ("MIT License", "mit"), ("This project is MIT licensed.", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("SPDX-License-Identifier: GPL-3.0-only", "gpl"), ("Released under the terms of the MIT license", "mit"),
    ("SPDX-License-Identifier: CC-BY-4.0", "cc-by"), ("SPDX-License-Identifier: CC0-1.0", "cc0"), ("SPDX-License-Identifier: Unlicense", "unlicense"), ("BSD 3-Clause License", "bsd"),
    ("A dog mit owner stood under the tree without a license", ""), ("under " + "word " * 5000 + "apache " + "word " * 5000 + "license", ""), ("the license of mit", ""), ("license identifier", ""),
    ("Released under the terms of the license", ""), ("Licensed under the public license, version 2.0", ""), ("Licensed under the Creative Commons license", ""),
]


def test_license_notices_of_one_line(spark):
    docs = spark.createDataFrame([(k, f"some prose\n\n{text}\n \nmore prose mit mpl") for k, (text, _) in enumerate(NOTICES)], "doc_id long, text string")
    assert {label for label, _ in license_scan.KNOWN} <= {label for _, label in NOTICES}
    assert {NOTICES[r.doc_id][0]: r.labels for r in license_scan.digest(docs).collect()} == dict(NOTICES)


def test_license_templates_wrapped_over_lines(spark):
    import textwrap

    texts, whole = {}, dict(enumerate(license_scan.KNOWN))
    for k, (_, text) in whole.items():
        texts[k] = "First paragraph.\n \n" + "\n".join(f" * {x}" for x in textwrap.wrap(text, max(6, min(40, len(text) // 2)), break_long_words=False, break_on_hyphens=False)) + "\n\nlast one"
    texts[100] = "under\nthe\n \ngpl\nlicense"  # an empty line ends a block
    texts[101] = "under the\n" + "word " * 10 + "license\nfor\nmit"  # words that don't stand together
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r.labels.split(",") for r in license_scan.digest(docs).collect()}
    assert all(label in out[k] for k, (label, _) in whole.items()) and out[100] == out[101] == [""]
    found = license_scan.scan(docs).collect()
    assert all(any(r.doc_id == k == r.template and r.n_held == r.n_template for r in found) for k in whole)
