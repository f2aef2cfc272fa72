"""Ranked lexical search with the roles reversed (operator 12): an inverted index over the items is broadcast, and the
documents stream through it.

The index maps a term to the items that hold it. A first pass counts documents, terms and, for terms of the index alone,
documents that hold them; a second one looks up each document's terms, adds up the scores of all items that share one, and
keeps the ``k`` best documents of each item in a heap. Each task gives its heaps away at its end, and they are merged item by
item. Nothing of a document is shuffled, and what a task holds depends on the items alone.

The index of all items may be large, so it is cut into slices of at most ``postings`` entries, whose sizes are counted before
anything is broadcast; each slice is a pass over the documents. An item by itself is never cut.

Scores are 64-bit integers; only the weight of a term, floor(1000 ln((2N + 2) / (2df + 1))), comes from doubles.

Defined results: terms are runs of ASCII letters, ASCII digits and all characters beyond ASCII, A-Z lower-cased; a null or empty
text has none, so a document or an item without terms is in no result; every row of documents counts, also one that repeats
another; documents without an id come after those with one in a tie; item rows that repeat id and text are asked once, item
rows with one id and several texts each get their own ranks; an empty table on either side gives no rows; other columns are
ignored. A text of any length is one row in memory.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import union

TOP, POSTINGS = 10, 500_000
#: A-Z become a-z, other ASCII characters but letters and digits become blanks; bytes beyond ASCII stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Stands for a missing doc_id, after all others.
NO_ID = 1 << 63


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return text.translate(FOLD).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        yield b"" if (b := x.as_buffer()) is None else b.to_pybytes()


def postings(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item (id as text), asked (hash of the text), term and n: a row for each item row and term of it."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms(t)) for t in _texts(batch.column(2))]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(c) for c in found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([t for c in found for t in c], pa.binary()), pa.array([n for c in found for n in c.values()], pa.int64())],
                ["item", "asked", "term", "n"],
            )

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.xxhash64(text).alias("asked"), F.col(text).alias("t")).distinct()
    return rows.mapInArrow(split, "item string, asked long, term binary, n long")


def slices(found: DataFrame, most: int) -> tuple[DataFrame, int]:
    """found with the number of its slice, none of which has more than ``most`` rows unless it is a single item; their number."""
    n = 1
    while True:
        dealt = found.withColumn("slice", F.pmod(F.hash("item", "asked"), F.lit(n)))
        sizes = dealt.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("item", "asked")).alias("a"), F.max(F.struct("item", "asked")).alias("b"))
        largest = sizes.where("a <> b").agg(F.max("n")).first()[0] or 0
        if largest <= most:
            return dealt, n
        n *= 2 * -(-largest // most)


class Index:
    """Items by term: ``place`` numbers the terms; the items of term i are ``item[start[i]:start[i + 1]]``, ``times`` their repeats."""

    def __init__(self, rows: pa.Table) -> None:
        asked = list(zip(rows["item"].to_pylist(), rows["asked"].to_pylist(), strict=True))
        self.items = sorted(set(asked), key=lambda x: (x[0] is not None, x))
        number = {x: i for i, x in enumerate(self.items)}
        held: list[bytes] = rows["term"].to_pylist()
        self.place = {t: i for i, t in enumerate(sorted(set(held)))}
        term, item = np.array([self.place[t] for t in held], np.int64), np.array([number[x] for x in asked], np.int64)
        order = np.lexsort((item, term))
        self.item, self.times = item[order], rows["n"].to_numpy()[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.place) + 1))

    def scores(self, term: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """The sum over term of worth times repeats, for each item."""
        first, size = self.start[term], self.start[term + 1] - self.start[term]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(first - ends + size, size)
        out = np.zeros(len(self.items), np.int64)
        np.add.at(out, self.item[at], np.repeat(worth, size) * self.times[at])
        return out


def _counts(docs: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents for each term of the index."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.place
        n = length = 0
        holders: Counter = Counter()
        for batch in batches:
            for t in _texts(batch.column(1)):
                found = terms(t)
                n, length = n + bool(found), length + len(found)
                holders.update(place.keys() & set(found))
        keys = list(holders)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2] + [place[t] for t in keys], pa.int64()), pa.array([n, length] + [holders[t] for t in keys], pa.int64())], ["term", "n"])

    rows = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(rows["term"].to_pylist(), rows["n"].to_pylist(), strict=True))
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(i, 0) for i in range(len(shared.value.place))], np.int64)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _ranked(docs: DataFrame, rows: pa.Table, k: int) -> DataFrame:
    """item, asked, doc_id and score: the heaps of all tasks for the items of a slice."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(Index(rows))
    n_docs, length, holders = _counts(docs, shared)
    weights = context.broadcast(np.array([weight(n_docs, int(df)) for df in holders], np.int64))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, w = shared.value, weights.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in index.items]
        least = np.ones(len(heaps), np.int64)  # what a score must reach
        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                found = terms(t)
                tf = Counter(found)
                shared_terms = index.place.keys() & tf.keys()
                if not shared_terms:
                    continue
                m = 100 - 75 + (75 * len(found) * n_docs) // length
                term = np.array([index.place[x] for x in shared_terms])
                times = np.array([tf[x] for x in shared_terms], np.int64)
                scores = index.scores(term, w[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m)))
                last = -(NO_ID if doc is None else doc)
                for i in np.flatnonzero(scores >= least).tolist():
                    entry, heap = (int(scores[i]), last), heaps[i]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        least[i] = heap[0][0]
        out = [(*index.items[i], None if -last == NO_ID else -last, score) for i, heap in enumerate(heaps) for score, last in heap]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], ["item", "asked", "doc_id", "score"])

    return docs.mapInArrow(stream, "item string, asked long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = POSTINGS) -> DataFrame:
    """item_id, rank, doc_id and score: the k highest-scoring documents of each item."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    dealt, n = slices(postings(items, item_id, item_text), most)
    # Rows of the table bound what comes to the driver: a slice is counted before it is read.
    found = [_ranked(docs, dealt.where(F.col("slice") == i).drop("slice").toArrow(), k) for i in range(n)]
    order = Window.partitionBy("item", "asked").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = union(*found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").cast(items.schema[item_id].dataType).alias("item_id"), "rank", "doc_id", "score")
