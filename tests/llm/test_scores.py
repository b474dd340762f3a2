"""The classifier's scores and the mixing's last pass, computed again by plain loops."""

from __future__ import annotations

import zlib
from collections import Counter
from math import exp, log

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import mixing, quality_classifier

DATA = "/root/testdata/sf0.01"


def test_scores_follow_from_compressed_sizes(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels)
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 200_000), (None, "some text")], "doc_id long, text string"))
    found = {r.doc_id: r for r in quality_classifier.classify(rows, model).collect()}
    assert len(found) == rows.count() and len(model.weights) == 5
    sizes = {}
    for name, content in (("good", model.good), ("bad", model.bad)):
        held = zstandard.ZstdCompressionDict(content)
        sizes[name] = lambda t, held=held: len(zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(t))
    for r in rows.collect():
        t = (r.text or "").encode()
        d = x = 0.0
        if t:
            g, b = sizes["good"](t), sizes["bad"](t)
            d, x = max(-5.0, min(5.0, 10 * (b - g) / (b + g))), max(-6.0, min(1.0, log((g + b) / (2 * len(t)))))
        z = sum(w * v for w, v in zip(model.weights, (1.0, d, x, x * x, d * x), strict=True))
        score = 1 / (1 + exp(-max(-30.0, min(30.0, z))))
        own = found[r.doc_id]
        assert own.score == pytest.approx(score, abs=1e-9) and own.predicted == int(own.score >= 0.3)
        assert own.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_scores_learn_from_the_other_folds_only(spark):
    """Labels of held-out rows, turned round, change nothing; and neither do ids, languages or sources."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels)
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_classifier.fit(docs, turned) == model
    moved = docs.select((F.col("doc_id") + 7_000_000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"))
    one, two = ({r.doc_id % 7_000_000: r.score for r in quality_classifier.classify(d, model).collect()} for d in (docs, moved))
    assert one == two


def power_of(words, entropy_share, limit, budget):
    """The exponent, on a fine grid that is refined; entropy first, then the limit."""
    def weights(a):
        p = np.array([w**a for w in words])
        return p / p.sum()

    def entropy(a):
        p = weights(a)
        return float(-(p * np.log(p)).sum())

    def repeats(a):
        return max(budget * p / w for p, w in zip(weights(a), words, strict=True))

    def least(ok):
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if ok(middle) else (middle, high)
        return high

    a = 1.0 if entropy(1.0) >= entropy_share * log(len(words)) else least(lambda x: entropy(x) < entropy_share * log(len(words)))
    return a if repeats(a) <= limit else least(lambda x: repeats(x) <= limit)


@pytest.mark.parametrize("entropy_share, limit", [(0.95, 4.0), (0.8, 1.5), (0.999, 30.0)])
def test_the_last_pass_is_a_prefix_of_the_permutation(spark, entropy_share, limit):
    draw = np.random.default_rng(3)
    rows = [(k, " ".join(["w"] * int(n)), s) for k, (n, s) in enumerate(zip(draw.integers(0, 60, 4000), draw.choice(["a", "b", "c", None], 4000, p=[0.7, 0.2, 0.06, 0.04]), strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashes = {r.doc_id: r.h & (2**64 - 1) for r in docs.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("h")).collect()}
    copies = Counter(r.doc_id for r in mixing.mix(docs, entropy_share=entropy_share, limit=limit).collect())
    totals = Counter()
    for _, t, s in rows:
        totals[s or ""] += len(t.split())
    budget = sum(totals.values())
    power = power_of(list(totals.values()), entropy_share, limit, budget)
    scale = budget / sum(w**power for w in totals.values())
    for source, words in totals.items():
        aim = scale * words ** (power - 1)
        whole, used = int(aim + 1e-9), 0
        near = 0
        for k, t in sorted(((k, t) for k, t, s in rows if (s or "") == source), key=lambda r: (hashes[r[0]], r[0])):
            used += len(t.split())
            rest = (aim - whole) * words
            near += abs(used - rest) < 1e-3  # the two exponents differ by some units of the last place
            assert copies[k] == whole + (used <= rest) or abs(used - rest) < 1e-3, (source, k)
        assert near <= 3
