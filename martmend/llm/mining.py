"""Hard-negative mining over zone-mapped blocks (operator 13).

All rows are ordered along a Hilbert curve and written as Parquet blocks of ``BLOCK`` neighbours, each with its zone map: the
smallest and largest value of every dimension, and its labels. An anchor asks with windows: its positives are the best rows of
its label in the window of all scores, its negatives the best rows of other labels in a window of scores that follows from each
positive. Interval arithmetic over a zone map bounds the inner product of an anchor with every row of the block from below and
above; a block is read only by groups of anchors of which at least one has a window that meets these bounds.

Windows are answered in two turns. The first reads the blocks with the highest bounds only and yields a score that each window
surely reaches; the second reads every block whose bounds still meet a window above that score, highest bound first, so the
result is exact. Neighbouring anchors form a group and read blocks together: a task holds the anchors of one group, and a part
of the group's blocks passes through it one by one. Groups, parts and blocks have bounded sizes whatever the labels and vectors
are; the zone maps are met in chunks of bounded size as well. What a task returns are the best rows of each window.

On vectors without structure in many dimensions the bounds are wide and most blocks are read; the work is then that of comparing
all anchors with all rows, in blocks.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part; rows that repeat id,
label and vector count once; an id that stands with several vectors is several rows, and no row is a candidate of its own id;
vectors are compared with those of their own length only; scores are exact up to 64 bits; ties go to the smaller id; an anchor
without positives, or a window without rows, gives no rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, union

#: Rows of a block, rows of a partition of blocks, partitions of a group of anchors, blocks of a part, zone maps of a chunk.
BLOCK, PARTITION, GROUP, PART, CHUNK = 256, 8_192, 8, 64, 1_024
#: Bits of each dimension in the place on the curve, blocks of each chunk that a window reads in the first turn.
BITS, FIRST = 4, 2
LOWEST = -(2**62)
BLOCKS = "group long, block long, dim int, ids array<long>, labels array<long>, v binary, lo binary, hi binary"


def pack(values: np.ndarray) -> bytes:
    """Integers in the smallest width that holds them all."""
    for kind in ("<i1", "<i2", "<i4"):
        if not values.size or (values.min() >= np.iinfo(kind).min and values.max() <= np.iinfo(kind).max):
            return values.astype(kind).tobytes()
    return values.astype("<i8").tobytes()


def unpack(held: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(held, f"<i{len(held) // (rows * dim)}").reshape(rows, dim).astype(np.int64) if rows * dim else np.zeros((rows, dim), np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b as 64-bit integers; by floating point where that is exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest inner product that each row of a can have with any vector between lo and hi, for each row of these."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return product(up, lo) + product(down, hi), product(up, hi) + product(down, lo)


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row on a Hilbert curve through a grid of 2**bits cells a side, as bytes that sort like the places."""
    x = axes.T.astype(np.int64).copy()
    dim, top = len(x), 1 << (bits - 1)
    if not dim:
        return np.zeros((axes.shape[0], 0), np.uint8)
    q = top
    while q > 1:  # undo the rotations of the coarser cells
        for i in range(dim):
            swapped = (x[0] ^ x[i]) & (q - 1)
            turned = (x[i] & q) != 0
            x[i] ^= np.where(turned, 0, swapped)
            x[0] ^= np.where(turned, q - 1, swapped)
        q >>= 1
    for i in range(1, dim):  # Gray code
        x[i] ^= x[i - 1]
    rest, q = np.zeros(x.shape[1], np.int64), top
    while q > 1:
        rest ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= rest
    planes = (x[None] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1
    return np.packbits(planes.reshape(bits * dim, -1).T.astype(np.uint8), axis=1)


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: Column | str = "label") -> DataFrame:
    """vec_id, label and v (components times 256, rounded down) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    sound = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * 256)))


def blocked(rows: DataFrame) -> DataFrame:
    """The rows as blocks along the curve, see BLOCKS; rows that repeat another are left out."""
    span = rows.agg(F.min(F.array_min("v")).alias("a"), F.max(F.array_max("v")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    low, width = span.a or 0, float((span.b or 0) - (span.a or 0) + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            flat, ends = batch.column(2).flatten().to_numpy(), np.cumsum(sizes)
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                v = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
                cells = np.minimum(((v - low) / width * 2**BITS).astype(np.int64), 2**BITS - 1)
                keys = pa.array([k.tobytes() for k in hilbert(cells)], pa.binary())
                packed = pa.array([x.astype("<i8").tobytes() for x in v], pa.binary())
                pick = pa.array(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), dim, np.int32)), keys, batch.column(0).take(pick), batch.column(1).take(pick), packed], ["dim", "key", "vec_id", "label", "v"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, made, last = TaskContext.get().partitionId(), 0, None
        dim, held = 0, []

        def block() -> pa.RecordBatch:
            held.sort()  # by id, so that the first of equal scores has the smallest
            v = np.array([np.frombuffer(h[2], "<i8") for h in held]).reshape(len(held), dim)
            low, high = (pack(f(v, axis=0)) for f in (np.min, np.max))
            cells = [[here // GROUP], [(here << 32) + made], [dim], [[h[0] for h in held]], [[h[1] for h in held]], [pack(v)], [low], [high]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["group", "block", "dim", "ids", "labels", "v", "lo", "hi"])

        for batch in batches:
            for d, vec_id, label, v in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if (d, vec_id, label, v) == last:
                    continue
                if held and (d != dim or len(held) == BLOCK):
                    yield block()
                    made, held = made + 1, []
                last, dim = (d, vec_id, label, v), d
                held.append((vec_id, label, v))
        if held:
            yield block()

    placed = rows.mapInArrow(place, "dim int, key binary, vec_id long, label long, v binary")
    order = ["dim", "key", "vec_id", "label", "v"]
    return placed.repartitionByRange(max(1, -(-span.n // PARTITION)), *order).sortWithinPartitions(*order).mapInArrow(build, BLOCKS)


def anchors_of(blocks: DataFrame, is_anchor) -> DataFrame:
    """group, anchor (number of the row), vec_id, dim, label and v (binary) of the rows for whose id is_anchor holds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                v = unpack(r["v"], len(r["ids"]), r["dim"])
                out += [(r["group"], r["block"] * BLOCK + i, vec_id, r["dim"], label, pack(v[i])) for i, (vec_id, label) in enumerate(zip(r["ids"], r["labels"], strict=True))]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], k) for c, k in enumerate(kinds)], ["group", "anchor", "vec_id", "dim", "label", "v"])

    holding = blocks.where(F.exists("ids", is_anchor))
    return holding.mapInArrow(rows, "group long, anchor long, vec_id long, dim int, label long, v binary").where(is_anchor(F.col("vec_id")))


class _Asks:
    """Anchors of one group and dimension with their windows, and the best k rows found for each window."""

    def __init__(self, dim: int, anchor: list, ids: list, labels: list, v: list, windows: list, k: int, same: bool) -> None:
        self.k, self.same, self.anchor = k, same, np.array(anchor, np.int64)
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)
        self.v = np.concatenate([unpack(x, 1, dim) for x in v])
        flat = np.concatenate([np.array(w, np.int64).reshape(-1, 4) for w in windows])
        self.of = np.repeat(np.arange(len(windows)), [len(w) // 4 for w in windows])
        self.number, self.lo, self.hi, least = flat.T
        self.floor = np.maximum(self.lo, least)
        self.score = np.full((len(self.of), k), LOWEST, np.int64)
        self.found = np.zeros((len(self.of), k), np.int64)

    def wanted(self, lo: np.ndarray, hi: np.ndarray, labels: list) -> tuple[np.ndarray, np.ndarray]:
        """For each window and zone map: whether the block can hold a row for it, and its upper bound."""
        low, high = bounds(self.v, lo, hi)
        fits = np.zeros(low.shape, bool)
        for label in np.unique(self.labels):
            holds = [(label in x) if self.same else (x != {label}) for x in labels]
            fits[self.labels == label] = holds
        return fits[self.of] & (high[self.of] >= self.floor[:, None]) & (low[self.of] <= self.hi[:, None]), high[self.of]

    def read(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, wanted: np.ndarray) -> None:
        """Take in a block for the windows in wanted."""
        for first in range(0, len(wanted), 4 * BLOCK):
            w = wanted[first : first + 4 * BLOCK]
            asked, at = np.unique(self.of[w], return_inverse=True)
            score = product(self.v[asked], v)
            score[((self.labels[asked][:, None] == labels[None]) != self.same) | (self.ids[asked][:, None] == ids[None])] = LOWEST
            score = score[at]
            score[(score < self.floor[w][:, None]) | (score > self.hi[w][:, None])] = LOWEST
            moved = score.max(axis=1) > LOWEST
            w, score = w[moved], score[moved]
            if not len(w):
                continue
            best, found = [self.score[w]], [self.found[w]]
            for _ in range(min(self.k, len(ids))):
                i = score.argmax(axis=1)[:, None]
                best.append(np.take_along_axis(score, i, 1))
                found.append(ids[i])
                np.put_along_axis(score, i, LOWEST, 1)
            best, found = np.concatenate(best, axis=1), np.concatenate(found, axis=1)
            order = np.lexsort((found, -best), axis=1)[:, : self.k]
            self.score[w], self.found[w] = (np.take_along_axis(x, order, 1) for x in (best, found))
            self.floor[w] = np.maximum(self.floor[w], self.score[w, -1])

    def rows(self) -> tuple[np.ndarray, ...]:
        w, i = np.nonzero(self.score > LOWEST)
        return self.anchor[self.of[w]], self.number[w], self.score[w, i], self.found[w, i]


def _chosen(asks: DataFrame, zones: DataFrame, k: int, same: bool, first: int | None) -> DataFrame:
    """group, block and bound: the blocks that each group reads; with ``first``, only so many of a chunk for each window."""

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            a, z = left.to_pydict(), right.to_pydict()
            dim = a["dim"][0]
            found = _Asks(dim, a["anchor"], a["vec_id"], a["label"], a["v"], a["windows"], k, same)
            lo, hi = (np.concatenate([unpack(x, 1, dim) for x in z[c]]) for c in ("lo", "hi"))
            meets, high = found.wanted(lo, hi, [set(x) for x in z["labels"]])
            if first is not None and meets.shape[1] > first:
                order = np.argsort(-np.where(meets, high, LOWEST), axis=1, kind="stable")[:, :first]
                kept = np.zeros_like(meets)
                np.put_along_axis(kept, order, True, 1)
                meets &= kept
            for i in np.flatnonzero(meets.any(axis=0)):
                out[0].append(a["group"][0])
                out[1].append(z["block"][i])
                out[2].append(int(high[meets[:, i], i].max()))
        return pa.table([pa.array(c, pa.int64()) for c in out], ["group", "block", "bound"])

    keys = ["group", "chunk", "dim"]
    return asks.groupBy(*keys).cogroup(zones.groupBy(*keys)).applyInArrow(choose, "group long, block long, bound long")


def answered(blocks: DataFrame, n_blocks: int, asks: DataFrame, k: int, same: bool, first: int = FIRST) -> DataFrame:
    """anchor, number, score, vec_id and r: the k best rows of each window of asks (group, anchor, vec_id, dim, label, v, windows).

    A window is four numbers in ``windows``: its number, least and largest score, and a score that its k-th row surely reaches.
    """
    chunks, parts = -(-max(1, n_blocks) // CHUNK), -(-max(1, n_blocks) // PART)
    last = asks.agg(F.max("group")).first()[0] or 0
    zones = blocks.select("block", "dim", F.array_distinct("labels").alias("labels"), "lo", "hi", F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["anchor", "number", "score", "vec_id"], [pa.int64()] * 4
        key, waiting, state = None, [], None

        def result() -> Iterator[pa.RecordBatch]:
            if state is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(state.rows(), kinds, strict=True)], names)

        for batch in batches:
            for r in batch.to_pylist():
                own = (r["group"], r["part"], r["dim"])
                if own != key:
                    yield from result()
                    key, waiting, state = own, [], None
                if r["kind"] == 0:
                    waiting.append((r["ids"][0], r["ids"][1], r["labels"][0], r["v"], r["windows"]))
                    continue
                if state is None and waiting:
                    state, waiting = _Asks(r["dim"], *map(list, zip(*waiting, strict=True)), k, same), []
                if state is not None:
                    labels = np.array(r["labels"], np.int64)
                    meets, _ = state.wanted(unpack(r["lo"], 1, r["dim"]), unpack(r["hi"], 1, r["dim"]), [set(r["labels"])])
                    state.read(np.array(r["ids"], np.int64), labels, unpack(r["v"], len(labels), r["dim"]), np.flatnonzero(meets[:, 0]))
        yield from result()

    def turn(asks: DataFrame, first: int | None) -> DataFrame:
        spread = asks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("chunk", F.col("chunk").cast("long"))
        met = zones.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
        chosen = _chosen(spread, met, k, same, first)
        nothing = F.lit(None).cast("binary")
        heads = asks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        heads = heads.select("group", "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place"), "dim", F.array("anchor", "vec_id").alias("ids"), F.array("label").alias("labels"), "v", nothing.alias("lo"), nothing.alias("hi"), "windows")
        read = chosen.join(blocks.drop("group"), "block").select("group", F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part"), F.lit(1).alias("kind"), (-F.col("bound")).alias("place"), "dim", "ids", "labels", "v", "lo", "hi", F.lit(None).cast("array<long>").alias("windows"))
        keys = ["group", "part", "dim"]
        streamed = union(heads, read).repartition(*keys).sortWithinPartitions(*keys, "kind", "place")
        order = Window.partitionBy("anchor", "number").orderBy(F.desc("score"), "vec_id")
        found = streamed.mapInArrow(stream, "anchor long, number long, score long, vec_id long")
        return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)

    reached = turn(asks, first).where(F.col("r") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("number", "score"))).alias("reached"))
    four = F.expr("transform(sequence(0, size(windows) div 4 - 1), i -> slice(windows, cast(4 * i + 1 as int), 4))")
    raised = F.flatten(F.transform(four, lambda w: F.array(w[0], w[1], w[2], F.greatest(w[3], F.coalesce(F.element_at("reached", w[0]), w[3])))))
    return turn(asks.join(reached, "anchor", "left").withColumn("windows", raised).drop("reached"), None)


def mine(df: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, vec_id: str = "vec_id", embedding: str = "embedding", label: Column | str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    For each anchor (rows for whose id is_anchor, a function of a column, holds) and each of its ``positives`` nearest rows of
    the same label: the first ``negatives`` rows of other labels whose score is ``least`` to ``most`` hundredths of the positive's.
    """
    blocks = cut(blocked(usable(df, vec_id, embedding, label)), "mining-blocks")
    n = blocks.count()
    asks = cut(anchors_of(blocks, is_anchor), "mining-anchors")
    all_scores = asks.withColumn("windows", F.array(*(F.lit(x).cast("long") for x in (0, LOWEST + 1, -LOWEST, LOWEST + 1))))
    near = cut(answered(blocks, n, all_scores, positives, True), "mining-positives")
    score = F.col("score")
    # Whole numbers in the window: least * score <= 100 * x <= most * score.
    windows = near.select("anchor", F.struct(F.col("r").cast("long").alias("r"), F.expr(f"-((-{least} * score) div 100) + if((-{least} * score) % 100 < 0, 1, 0)").alias("lo"), F.expr(f"({most} * score) div 100 - if(({most} * score) % 100 < 0, 1, 0)").alias("hi")).alias("w"), score)
    windows = windows.where("w.lo <= w.hi").groupBy("anchor").agg(F.array_sort(F.collect_list("w")).alias("w"))
    windows = windows.select("anchor", F.flatten(F.transform("w", lambda w: F.array(w["r"], w["lo"], w["hi"], F.lit(LOWEST + 1).cast("long")))).alias("windows"))
    found = answered(blocks, n, cut(asks.join(windows, "anchor"), "mining-windows"), negatives, False)
    found = found.select("anchor", F.col("number").alias("place"), F.col("r").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.select("anchor", F.col("r").cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = asks.select("anchor", F.col("vec_id").alias("anchor_id"))
    return found.join(pairs, ["anchor", "place"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
