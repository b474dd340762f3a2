"""Each stage of the pipeline on its own input, against brute force."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F
from test_joins import groups_of, removed
from test_text import check_pieces

import corpus_pipeline
from tidemark.llm import quality_rules

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "line_dedup", "ngram_jaccard_join", "source_mixing", "packing"]
    rows = {}

    def run(name, frame):
        out = stage[name](spark, frame, DATA)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = out.collect()
        return out

    good = run("quality_rules", docs)
    assert good.columns == docs.columns
    assert {r.doc_id for r in rows["quality_rules"]} == {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}

    before = [(r.doc_id, r.text) for r in rows["quality_rules"]]
    clean = run("line_dedup", good)
    assert clean.columns == docs.columns
    gone = removed(before)
    expect = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in before}
    assert {r.doc_id: r.text for r in rows["line_dedup"]} == {k: t for k, t in expect.items() if t.split() or not gone[k]}

    single = run("ngram_jaccard_join", clean)
    own = groups_of([(r.doc_id, r.text) for r in rows["line_dedup"]])
    assert {r.doc_id for r in rows["ngram_jaccard_join"]} == {k for k, (_, group) in own.items() if group == k}

    mixed = run("source_mixing", single)
    copies = Counter(r.doc_id for r in rows["source_mixing"])
    assert mixed.columns == docs.columns and set(copies) == {r.doc_id for r in rows["ngram_jaccard_join"]} and max(copies.values()) <= 2

    run("packing", mixed)
    ids, total, _ = check_pieces(rows["packing"], {r.doc_id: r.text for r in rows["source_mixing"]})
    assert all(total[k] == copies[k] * len(ids[k]) for k in ids)


CLASHES = ["removed_lines", "copy", "order_key", "n_words", "component_id", "class", "gone", "key", "line", "row", "asks", "n_shingles", "n_stop", "kept"]


def test_stages_take_odd_documents(spark, edges, empty, tmp_path):
    """Null and empty texts, repeated rows, a null id, very long texts and clashing names go through every stage; so does a table without rows."""
    good = " ".join(f"the{k} word{k} of tale{k} and with{k}" for k in range(40))
    more = spark.createDataFrame([(50, good, "en", "a", len(good)), (50, good, "en", "a", len(good)), (51, good, "en", None, len(good)), (None, good + " more words", "en", "b", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    base = edges.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more)
    for name, frame in (("all", base.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])), ("none", base.limit(0)), ("few", base.drop("n_chars"))):
        docs, kept = frame, []
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, DATA)
            if stage != "packing":
                assert out.columns == docs.columns, (name, stage)
            out.write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
            kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert kept[0] == (set() if name == "none" else kept[0] | {50, 51, None}) and kept[-1] <= kept[0]
        if name == "all":
            assert 50 in kept[-1] and docs.where("doc_id = 50").count() >= 1
            first = spark.read.parquet(f"{tmp_path}/all3").where("doc_id = 50").first()
            assert [first[c] for c in CLASHES] == list(range(len(CLASHES))) and first.text == good and first.n_chars == len(good)
