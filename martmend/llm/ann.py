"""Approximate nearest neighbours (operator 7): a forest of random-projection trees, one priority queue over all of them,
exact reranking of the leaves' vectors.

Trees are grown on the driver from ``sample`` distinct vectors (those with the least hashes): a node's direction lies between
two random vectors of it, its threshold is the median. Every vector of the table is put into its leaf of each tree. A query's
queue holds branches of all trees by the smallest margin on their path; leaves are taken from its head until ``leaves`` are
found. Queries and vectors meet by blocks of leaves; a block is cut into parts so that its size stays bounded as the table
grows, and only a query's best of a block leave it. The forest's size is bounded by the sample.

Vectors of one direction (their components agree to ``PLACES`` decimal places, that is to a few units in the last place of a
double) are one class, of which the ``k`` + 1 smallest ids are kept with their own vectors: no result can need more. So a direction
that is repeated many times costs as much as one that is not. Candidates are cut by (cosine, smallest id of the class), so what
leaves a leaf is bounded however many classes tie, and ranked by their cosine in double precision, equal ones by id.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components take no
part, nor do rows without an id; rows that repeat id and vector count once; ties go to the smaller id; other columns are ignored; with fewer than k
candidates all are returned; an empty table has no results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

TREES, LEAVES, SAMPLE, LEAF = 8, 640, 20_000, 12
#: Leaves in a block, and vectors of a block beyond which it is cut into parts.
BLOCK, PART = 128, 32_768
#: Decimal places to which directions are told apart, and how far two ways to compute a cosine may differ.
PLACES, SLACK = 15, 1e-14


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v (array of doubles) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    sound = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (most.n if most else 0))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """c (class number, a hash), v (one of its vectors) and members (vec_id and v of the k + 1 smallest ids) of each direction."""
    order = Window.partitionBy("c", "c2").orderBy("vec_id", "v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    # Adding zero turns a negative zero into a positive one.
    direction = F.transform("v", lambda x: F.round(x / F.col("norm"), PLACES) + 0.0)
    numbered = rows.distinct().withColumn("norm", norm).withColumn("direction", direction)
    numbered = numbered.select("vec_id", "v", F.xxhash64("direction").alias("c"), F.hash("direction").alias("c2"))
    least = numbered.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    return least.groupBy("c", "c2").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("members")).select("c", F.get("members", 0)["v"].alias("v"), "members")


class Forest:
    """Trees as complete arrays: node i has the children 2 i + 1 and 2 i + 2."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.depth = max(0, int(np.floor(np.log2(max(1, len(sample) / leaf)))))
        inner = 2**self.depth - 1
        self.direction = np.zeros((trees, inner, sample.shape[1]))
        self.threshold = np.zeros((trees, inner))
        for t in range(trees):
            held = {0: np.arange(len(sample))}
            for node in range(inner):
                own = held.pop(node)
                a, b = rng.choice(own, 2, replace=False) if len(own) > 1 else (0, 0)
                way = sample[a] - sample[b]
                if not way.any():
                    way = rng.standard_normal(sample.shape[1])
                way /= np.linalg.norm(way)
                along = sample[own] @ way
                cut_at = float(np.median(along)) if len(own) else 0.0
                self.direction[t, node], self.threshold[t, node] = way, cut_at
                held[2 * node + 1], held[2 * node + 2] = own[along <= cut_at], own[along > cut_at]

    def parts(self) -> tuple:
        return self.depth, self.direction, self.threshold

    @classmethod
    def of(cls, parts: tuple) -> Forest:
        forest = cls.__new__(cls)
        forest.depth, forest.direction, forest.threshold = parts
        return forest

    def leaves_of(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(unit), len(self.direction)), np.int64)
        for t in range(len(self.direction)):
            node = np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                along = np.einsum("ij,ij->i", unit, self.direction[t, node]) - self.threshold[t, node]
                node = 2 * node + 1 + (along > 0)
            out[:, t] = node - (2**self.depth - 1)
        return out

    def search(self, unit: np.ndarray, leaves: int = LEAVES) -> list[tuple[int, int]]:
        """(tree, leaf) of the leaves that come first in the shared queue."""
        margin = self.direction @ unit - self.threshold
        first, found = 2**self.depth - 1, []
        queue = [(-np.inf, t, 0) for t in range(len(self.direction))]
        while queue and len(found) < leaves:
            less, t, node = heapq.heappop(queue)
            while node < first:
                m = margin[t, node]
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(less, abs(m)), t, far))
                node = near
            found.append((t, node - first))
        return found


def cosine(a: str, b: str):
    def dot(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _units(column: pa.Array) -> np.ndarray:
    v = column.flatten().to_numpy().reshape(len(column), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def nearest(df: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = TREES, leaves: int = LEAVES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score (cosine): for each row for which is_query (of the column vec_id) holds, its k nearest of all others."""
    rows = cut(usable(df, vec_id, embedding), "ann-rows")
    held = cut(classes(rows, k), "ann-classes")
    taken = [r.v for r in held.orderBy("c").select("v").limit(sample).collect()]
    forest = Forest(_units(pa.array(taken)) if taken else np.zeros((0, 1)), trees)
    parts = int(np.ceil(max(1, held.count()) * min(1, BLOCK / 2**forest.depth) / PART))
    shared = df.sparkSession.sparkContext.broadcast(forest.parts())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest.of(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            at, n = forest.leaves_of(_units(batch.column(1))), batch.num_rows
            for t in range(at.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t)), pa.array(at[:, t] // BLOCK), pa.array(at[:, t]), *batch.columns], ["tree", "block", "leaf", "c", "v", "least"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest.of(shared.value)
        for batch in batches:
            for i, unit in enumerate(_units(batch.column(1)) if batch.num_rows else ()):
                found: dict[tuple[int, int], list[int]] = {}
                for tree, leaf in forest.search(unit, leaves):
                    found.setdefault((tree, leaf // BLOCK), []).append(leaf)
                tree, block = np.array(list(found)).T
                pick = pa.array(np.full(len(tree), i))
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(block), pa.array(list(found.values()), pa.list_(pa.int64())), *[c.take(pick) for c in batch.columns]], ["tree", "block", "leaves", "q", "v"])

    def score(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if queries.num_rows and vectors.num_rows:
            q, x = (np.vstack([c.flatten().to_numpy().reshape(len(c), -1) for c in t.column("v").chunks if len(c)]) for t in (queries, vectors))
            lists, xl = queries.column("leaves").combine_chunks(), vectors.column("leaf").to_numpy()
            ql, qrow = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            qid, cid = queries.column("q").to_numpy(), vectors.column("c").to_numpy()
            qn, xn = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
            rank = np.argsort(np.argsort(vectors.column("least").to_numpy(), kind="stable"))
            for leaf in np.intersect1d(ql, xl):
                a, b = qrow[ql == leaf], np.flatnonzero(xl == leaf)
                cosine = (q[a] @ x[b].T) / (qn[a][:, None] * xn[b][None, :])
                if cosine.shape[1] > k + 1:
                    # What is surely above the last of the k + 1 best, and of those that may tie with it the k + 1 with the smallest ids.
                    last = -np.partition(-cosine, k, axis=1)[:, k : k + 1]
                    order = np.where(np.abs(cosine - last) <= SLACK, rank[b][None, :], np.where(cosine > last, -1, len(rank)))
                    best = np.argsort(order, axis=1, kind="stable")[:, : 2 * k + 1]
                    i, j = np.nonzero(np.take_along_axis(order, best, 1) < len(rank))
                    j = best[i, j]
                else:
                    i, j = np.nonzero(cosine >= -2)
                out[0].append(qid[a][i])
                out[1].append(cid[b][j])
                out[2].append(cosine[i, j])
        return pa.table([np.concatenate(c) for c in out], ["q", "c", "score"])

    index = held.select("c", "v", F.get("members", 0)["vec_id"].alias("least")).mapInArrow(place, "tree long, block long, leaf long, c long, v array<double>, least long").withColumn("part", F.pmod(F.xxhash64("c"), F.lit(parts)))
    asked = rows.where(is_query(F.col("vec_id"))).distinct().mapInArrow(ask, "tree long, block long, leaves array<long>, q long, v array<double>").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    keys = ["tree", "block", "part"]
    met = asked.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(score, "q long, c long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    found = met.groupBy("q", "c").agg(F.max("score").alias("score")).join(held.select("c", "members", F.get("members", 0)["vec_id"].alias("least")), "c")
    # Of k + 1 classes each has an id, so they hold the k nearest besides the query itself; as many more where the last places differ.
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= 2 * k + 2).select("q", F.explode("members").alias("m")).select("q", F.col("m.vec_id").alias("vec_id"), F.col("m.v").alias("v")).where("q <> vec_id")
    asking = rows.where(is_query(F.col("vec_id"))).distinct().select(F.col("vec_id").alias("q"), F.col("v").alias("w"))
    # An id that stands with several vectors counts by its nearest.
    scored = found.join(asking, "q").select("q", "vec_id", cosine("v", "w").alias("score")).groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", "vec_id", "score")
