"""Document fingerprints by winnowing (operator 9). DataFrame and SQL functions only.

A text is lower-cased and cut into units: runs of at most eight letters or digits, or single Han or kana characters. Every
``K`` units in a row are hashed; of every ``W`` hashes in a row the least is marked, the rightmost of equal ones, with its
position. Texts that share ``K + W - 1`` units in a row share a mark.

A mark is a long: 36 bits of hash above 28 bits of inverted position, so that the least of a window is the least hash and,
among equal hashes, the rightmost.

Defined results: null is the empty text, which has no marks; a text with fewer than K units has one mark, of all its units, or of
itself where it has none; a text with fewer than W hashes has the marks of one window. The likeness of two fingerprints is
the Jaccard similarity of their sets of hashes; of two empty ones it is 1. For ``with_neighbours``, rows that repeat an id
and a text are one document; an id with several texts is ordered by a hash of the text; a null id comes first; the
document after the last is the first, and one document alone is followed by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let

K, W = 5, 8
PLACES = 28
UNIT = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{N}]{1,8}"


def marks(text: Column, k: int = K, w: int = W) -> Column:
    """Array of marks in order of position."""
    low = (1 << PLACES) - 1

    def mark(h: Column, at: Column) -> Column:
        return F.shiftleft(F.shiftright(h, PLACES), PLACES).bitwiseOR(F.lit(low) - at)

    def grams(units: Column) -> Column:
        rolled = F.transform(F.sequence(F.lit(1), F.size(units) - (k - 1)), lambda i: mark(F.xxhash64(F.slice(units, i, k)), (i - 1).cast("long")))
        return F.when(F.size(units) >= k, rolled).otherwise(F.array(mark(F.xxhash64(units), F.lit(0).cast("long"))))

    def least(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(hashes) - (w - 1), F.lit(1))), lambda i: F.array_min(F.slice(hashes, i, w)))
        return F.array_distinct(windows)

    units = F.regexp_extract_all(F.lower(text), F.lit(UNIT), F.lit(0))
    units = let(units, lambda u: F.when(F.size(u) > 0, u).otherwise(F.array(text)))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<bigint>")).otherwise(let(let(units, grams), least))


def hashes(marked: Column) -> Column:
    return F.array_distinct(F.transform(marked, lambda m: F.shiftright(m, PLACES)))


def fingerprint(marked: Column) -> Column:
    """The marks as text: hash and position (in units, from 0) of each."""
    low = (1 << PLACES) - 1
    return F.array_join(F.transform(marked, lambda m: F.concat_ws(":", F.hex(F.shiftright(m, PLACES).bitwiseAND(F.lit((1 << 36) - 1))), (F.lit(low) - m.bitwiseAND(F.lit(low))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of hashes."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def followers(keys: DataFrame) -> DataFrame:
    """keys (doc_id, h, n, part: a range of the order, as a stored column) with next_id and next_h, the next key in order."""
    key = F.struct("doc_id", "h")
    order = Window.partitionBy("part").orderBy("doc_id", "h")
    heads = keys.groupBy("part").agg(F.min(key).alias("head"))  # one row per range
    ends = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.first("head").over(ends)).alias("after"))
    within = keys.withColumn("next", F.lead(key).over(order)).join(F.broadcast(after), "part")
    return within.withColumn("next", F.coalesce("next", "after")).select("doc_id", "h", "n", F.col("next.doc_id").alias("next_id"), F.col("next.h").alias("next_h"))


def with_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, edited (its last half replaced by the start of the next document), and the marks of text and of the
    next document (next_marks)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    counted = rows.select("doc_id", "h", F.length("text").alias("n")).groupBy("doc_id", "h", "n").agg(F.count(F.lit(1)).alias("k"))
    keys = cut(counted.repartitionByRange("doc_id", "h").withColumn("part", F.spark_partition_id()), "winnow-keys")
    if not keys.where("k > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "h"])
    chain = cut(followers(keys), "winnow-chain")
    # Each document sends its marks, and as much of its start as is needed, to the one before it.
    to = chain.select(F.col("next_id").alias("i"), F.col("next_h").alias("h"), F.col("doc_id").alias("before_id"), F.col("h").alias("before_h"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    own = rows.join(to.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("i")) & (rows.h == to.h)).select("doc_id", rows.h.alias("h"), "text", marks(F.col("text")).alias("marks"), "before_id", "before_h", "need")
    sent = own.select("before_id", "before_h", F.substring("text", F.lit(1), F.col("need")).alias("start"), F.col("need").alias("half"), F.col("marks").alias("next_marks"))
    own = own.select("doc_id", "h", "text", "marks")
    met = own.join(sent, F.col("doc_id").eqNullSafe(F.col("before_id")) & (F.col("h") == F.col("before_h")))
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("half")), "start")
    return met.select("doc_id", "text", edited.alias("edited"), "marks", "next_marks")
