"""Approximate nearest neighbours by a forest of random-projection trees.

Trees split a bounded sample (at most ``SAMPLE`` vectors, those of the smallest hash) at medians along directions between
two random sample vectors, down to ``LEAF`` vectors. Every vector is then sent to its leaf of every tree. A query walks all
trees through one shared priority queue, nearest boundary first, until it has the share ``VISITED`` of all
leaves; the vectors of these are
ranked by exact distances in double precision.

Equal vectors are one class: the index holds it once, with its eleven smallest ids, as no more can enter a list of ten.
Leaves are read as streams of blocks, so neither a leaf nor the vectors of a class are gathered whole. Where more queries come to a leaf than
a task should hold (``HELD``), they are dealt to parts, each of which reads the leaf.

Null, empty and zero vectors, vectors with null or non-finite components, and vectors whose length isn't the most frequent
one (ties: the shorter) take no part, neither as queries nor as candidates. Rows without an id take no part. Rows that
repeat an id with the same vector count once. Fewer candidates than asked for give shorter lists; extra columns play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

NEIGHBOURS, SAMPLE, LEAF, TREES, VISITED = 10, 20_000, 48, 12, 0.09
#: Queries that a task holds for a leaf, about.
HELD = 4096


class Tree:
    """Inner nodes: direction, threshold, children; a child below zero is the leaf ``-1 - child``."""

    def __init__(self, sample: np.ndarray, draw: np.random.Generator, leaf: int):
        directions: list[np.ndarray] = []
        thresholds: list[float] = []
        children: list[list[int]] = []
        self.leaves = 0

        def grow(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                a, b = sample[draw.choice(rows, 2, replace=False)]
                direction = a - b
                norm = np.linalg.norm(direction)
                direction = direction / norm if norm > 0 else draw.standard_normal(sample.shape[1])
                along = sample[rows] @ direction
                middle = float(np.median(along))
                left, right = rows[along < middle], rows[along >= middle]
                if len(left) and len(right):
                    k = len(directions)
                    directions.append(direction)
                    thresholds.append(middle)
                    children.append([0, 0])
                    children[k] = [grow(left), grow(right)]
                    return k
            self.leaves += 1
            return -self.leaves

        self.root = grow(np.arange(len(sample)))
        self.directions = np.array(directions) if directions else np.zeros((0, sample.shape[1]))
        self.thresholds, self.children = np.array(thresholds), np.array(children, int).reshape(-1, 2)

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        at = np.full(len(rows), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            k = at[inner]
            side = np.einsum("ij,ij->i", rows[inner], self.directions[k]) >= self.thresholds[k]
            at[inner] = self.children[k, side.astype(int)]
        return -1 - at


def visit(trees: list[Tree], query: np.ndarray, visits: int) -> list[tuple[int, int]]:
    """Leaves ``(tree, leaf)`` in the order in which the shared queue reaches them."""
    margins = [t.directions @ query - t.thresholds for t in trees]
    queue = [(0.0, k, t.root) for k, t in enumerate(trees)]
    out = []
    while queue and len(out) < visits:
        far, k, node = heapq.heappop(queue)
        while node >= 0:
            margin = float(margins[k][node])
            near, other = trees[k].children[node][:: 1 if margin < 0 else -1]
            heapq.heappush(queue, (max(far, abs(margin)), k, int(other)))
            node = int(near)
        out.append((k, -1 - node))
    return out


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (array of double) of the rows that take part."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine)
    common = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return rows.where(F.size("v") == (common["size"] if common else 0))


def forest(rows: DataFrame, sample: int, leaf: int, trees: int, seed: int = 11) -> list[Tree]:
    """Trees over a bounded sample, which the driver gets."""
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    points = np.array([r["v"] for r in taken])
    draw = np.random.default_rng(seed)
    return [Tree(points, draw, leaf) for _ in range(trees)] if len(points) else []


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def search(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS,
    sample: int = SAMPLE, leaf: int = LEAF, trees: int = TREES, visited: float = VISITED, held: int = HELD,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (distance) for the rows that ``is_query`` (over ``id``) picks."""
    rows = usable(vectors, key, vector)
    # the filter on the row number goes below the shuffle, so a class of any size sends k + 1 rows from each task
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    members = stored(rows.distinct().withColumn("place", place).where(F.col("place") <= k + 1), "members")
    classes = members.where("place = 1").select(F.col("id").alias("class"), "v")
    of = members.alias("m").join(classes.alias("c"), F.col("m.v") == F.col("c.v")).select("class", "id")
    of = stored(of, "classes")
    asked = stored(rows.where(is_query).distinct().alias("q").join(classes.alias("c"), F.col("q.v") == F.col("c.v")).select("id", "class", F.col("c.v").alias("v")), "queries")
    grown = forest(classes.select(F.col("class").alias("id"), "v"), sample, leaf, trees)
    visits = max(trees, round(visited * sum(t.leaves for t in grown)))
    sent = rows.sparkSession.sparkContext.broadcast(grown)
    probed = asked.select("class", "v").dropDuplicates(["class"])
    parts = max(1, -(-round(probed.count() * visited) // held))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = matrix(batch.column(1))
                for t, tree in enumerate(sent.value):
                    n, at = batch.num_rows, pa.array(tree.leaf_of(points).astype(np.int32))
                    for part in range(parts):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), at, pa.array(np.full(n, part, np.int32)), pa.array(np.ones(n, np.int32)), batch.column(0), batch.column(1)], names)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [(i, *x) for i, q in enumerate(matrix(batch.column(1))) for x in visit(sent.value, q, visits)]
                i, t, l = (np.array(x, np.int32) for x in zip(*found, strict=True))
                own = batch.column(0).take(pa.array(i))
                part = (own.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(l), pa.array(part.astype(np.int32)), pa.array(np.zeros(len(t), np.int32)), own, batch.column(1).take(pa.array(i))], names)

    names = ["tree", "leaf", "part", "kind", "class", "v"]
    schema = "tree int, leaf int, part int, kind int, class long, v array<double>"
    both = classes.mapInArrow(index, schema).unionByName(probed.mapInArrow(probe, schema)).repartition("tree", "leaf", "part").sortWithinPartitions("tree", "leaf", "part", "kind", "class")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, queries = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, leaf_, part, kind, own = (batch.column(i).to_numpy() for i in range(5))
            points = matrix(batch.column(5))
            cuts = np.flatnonzero((np.diff(tree) != 0) | (np.diff(leaf_) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            out: list[tuple] = []
            for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True):
                if (tree[a], leaf_[a], part[a]) != now:
                    now, ids, queries = (tree[a], leaf_[a], part[a]), [], []
                if kind[a] == 0:
                    ids.extend(own[a:b].tolist())
                    queries.extend(points[a:b])
                    continue
                for q, point in zip(ids, queries, strict=True):
                    far = np.sqrt(((points[a:b] - point) ** 2).sum(axis=1))
                    keep = np.arange(b - a) if b - a <= k + 1 else np.flatnonzero(far <= np.partition(far, k)[k])
                    out.extend((q, c, d) for c, d in zip(own[a:b][keep].tolist(), far[keep].tolist(), strict=True))
            if out:
                q, c, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.float64())], ["asker", "class", "score"])

    near = both.mapInArrow(rank, "asker long, class long, score double").groupBy("asker", "class").agg(F.min("score").alias("score"))
    # k + 1 classes: the query's own may be among them
    best = near.withColumn("place", F.row_number().over(Window.partitionBy("asker").orderBy("score", "class"))).where(F.col("place") <= k + 1).drop("place")
    listed = best.join(of.withColumnRenamed("id", "vec_id"), "class").drop("class")
    pairs = small(asked.select(F.col("id").alias("query_id"), F.col("class").alias("asker"))).join(listed, "asker").where("query_id <> vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
