"""Quality classifier by compression.

Two zstandard dictionaries are built, from texts labelled good and bad. A text is compressed with either; the difference
of the two sizes, normalised by their sum, and the size against the text's own length are calibrated to a probability by
logistic regression on labelled texts that took no part in the dictionaries.

Fitting takes at most ``SAMPLE`` labelled rows of each class, those with the smallest hash of their id, and of these the
texts of at most ``FIT_BYTES`` bytes; both bounds are parameters. Scoring covers every row and whole texts. Null and empty
texts get the score that calibration gives to an empty text. Repeated rows get equal scores; without labels of both
classes every score is the share of good labels (1 without any label). Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, FIT_BYTES, DICTIONARY, LEVEL = 2000, 20_000, 65_536, 3
FOLDS, THRESHOLD = 5, 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float = 1.0


class Sizer:
    """Features of texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL):
        import zstandard

        self.own = []
        for content in (good, bad):
            held = zstandard.ZstdCompressionDict(content)
            held.precompute_compress(level=level)
            self.own.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), 2))
        for i, t in enumerate(texts):
            if t:
                g, b = (len(c.compress(t)) for c in self.own)
                out[i] = (b - g) / (b + g), np.log((g + b) / (2 * len(t)))
        return out


def expand(x: np.ndarray) -> np.ndarray:
    """Intercept, the difference, the log ratio with its square, and their product; scaled to be of order one."""
    d, r = np.clip(x[:, 0] * 10, -5, 5), np.clip(x[:, 1], -6, 1)
    return np.column_stack([np.ones(len(x)), d, r, r * r, d * r])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(key: Column) -> Column:
    """Whether the row's fold (crc32 of its id as text, modulo FOLDS) is the one kept from learning."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def dictionary(samples: list[bytes], size: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(samples)[-size:]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, fit_bytes: int = FIT_BYTES) -> Model:
    """A model from a bounded sample of the labelled rows that are not held out."""
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label")).where(F.col("key").isNotNull() & F.col("label").isin(0, 1))
    known = known.where(~held_out(F.col("key")))
    order = F.xxhash64("key"), F.col("key")
    some = known.where("label = 1").orderBy(*order).limit(sample).unionByName(known.where("label = 0").orderBy(*order).limit(sample))
    share = known.agg(F.avg("label")).first()[0]
    # at most 2 * sample rows are broadcast, and collected
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where(F.octet_length("text").between(1, fit_bytes))
    taken = sorted({(r["key"], r["label"], r["text"]) for r in rows.join(F.broadcast(some), "key").collect()})
    texts = {c: [t.encode() for k, (_, y, t) in enumerate(taken) if y == c and k % 2 == 0] for c in (0, 1)}
    rest = [(y, t.encode()) for k, (_, y, t) in enumerate(taken) if k % 2]
    if not texts[0] or not texts[1] or len({y for y, _ in rest}) < 2:
        return Model(b"", b"", (), 1.0 if share is None else float(share))
    size = min(DICTIONARY, *(max(256, sum(map(len, x)) // 4) for x in texts.values()))
    good, bad = dictionary(texts[1], size), dictionary(texts[0], size)
    y = np.array([y for y, _ in rest], float)
    weights = logistic(expand(Sizer(good, bad).features([t for _, t in rest])), y)
    return Model(good, bad, tuple(weights), float(share))


def scored(text: Column, model: Model) -> Column:
    """The calibrated probability of label 1."""
    if not model.weights:
        return F.lit(model.prior)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, w = Sizer(model.good, model.bad), np.array(model.weights)
        for texts in batches:
            x = expand(own.features([t.encode() if t else b"" for t in texts]))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    return score(text)


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` for every row."""
    out = docs.select(F.col(f"`{key}`").alias(key), held_out(F.col(f"`{key}`")).alias("held_out"), scored(F.col(f"`{text}`"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
