"""Byte-level BPE (operator 3): ranked merges folded by higher-order functions over the distinct words.

Flow:

1. the distinct words of a bounded sample of rows (``SAMPLE_ROWS``, at most ``COMMON_WORDS`` words) are folded once, as one
   table, and handed to the tasks together with the words that are tokens as a whole. This list only spares work: ids do
   not depend on it;
2. in one stage without a shuffle, the JVM splits each text into words by the tokenizer's pattern;
3. a task's rows are dictionary-encoded: each row keeps codes, the first row of several batches carries the words that are new in
   the task and not in the list;
4. the JVM folds the ranked merges over the bytes of those distinct words, looking pairs up in a map that comes with them: the
   Python step hands it on from a broadcast, so that the text of no plan has it, and the driver's memory stays small;
5. the codes are replaced by the ids of their words, batch by batch.

While it is merged, a word is a string with one character for each piece: a byte is the character of its value, a merged
piece the character of its rank plus 256 (see ``_sign``). The order of such characters is that of the ranks. A second string
has the merged piece of each pair of neighbours: its least character is the next merge, the first place of it the leftmost
one, and a merge changes two of its characters. The map gives the merged piece of a pair; it is cut into buckets by
CRC-32, since Spark searches a map from end to end. Its size is that of the vocabulary file and does not grow with the data.

Defined results: null and empty texts have no ids; words of over ``LONG_WORD`` bytes, for which the fold would take
quadratic time, are merged by a heap in the same Python step that replaces the codes, to the same ids; other columns are kept as they
are, and a column that has the result's name is replaced.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, let

BUCKETS = 65536
#: Bytes of a word beyond which the heap is used.
LONG_WORD = 512
#: Words that are numbered at once, words that are replaced at once, and distinct words of a task after which its dictionary begins anew.
BATCH_WORDS, PART_WORDS, BOOK_WORDS = 1_500_000, 250_000, 500_000
#: Bytes of a batch that goes to Python. ``BATCH_WORDS`` words of several batches are handed on together.
BATCH_BYTES = 4 << 20
#: The list of common words: rows that it is taken from, most words, most bytes of a word, rows in which they are folded.
SAMPLE_ROWS, COMMON_WORDS, COMMON_BYTES, COMMON_GROUPS = 12_000, 600_000, 64, 16
#: Character that stands for a pair that cannot be merged; it comes after all others.
NONE = "\U0010ffff"
#: The White_Space property of Unicode, which Java's \\s lacks.
SPACE = r"\t-\r \x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a base64 piece and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def java_pattern(pattern: str) -> str:
    """The splitting pattern with Unicode white space spelt out."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")


def _sign(rank: int) -> str:
    """The character of a merged piece; surrogates and private characters are left out."""
    code = rank + 256
    return chr(code if code < 0xD800 else code + 0x2800)


def merge_map(ranks: dict[bytes, int]) -> str:
    """JSON of an array of maps: a pair's two characters to the character of the merged piece."""
    signs = {piece: piece.decode("latin-1") if len(piece) == 1 else _sign(rank) for piece, rank in ranks.items()}
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for piece, merged in signs.items():
        for at in range(1, len(piece)):
            if (a := signs.get(piece[:at])) and (b := signs.get(piece[at:])):
                buckets[zlib.crc32((a + b).encode()) % BUCKETS][a + b] = merged
    return json.dumps(buckets, ensure_ascii=False, separators=(",", ":"))


def piece_list(ranks: dict[bytes, int]) -> Column:
    """Literal array, rank to piece with one character for each byte."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    return F.from_json(F.lit(json.dumps(pieces)), "array<string>")


def merged_word(word: Column, table: Column) -> Column:
    """The word's pieces as characters after all merges: lowest rank first, leftmost among equals."""

    def lookup(pair: Column) -> Column:
        return F.coalesce(F.element_at(F.get(table, F.pmod(F.crc32(pair), F.lit(BUCKETS)).cast("int")), pair), F.lit(NONE))

    def ranked(s: Column) -> Column:
        """One character for each pair of neighbours: the merged piece, or NONE."""
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: lookup(F.substring(s, i, 2))), "")

    def merge(state: Column, least: Column, at: Column) -> Column:
        s, r = state["s"], state["r"]

        def joined(t: Column) -> Column:
            left = F.when(at > 1, lookup(F.substring(t, at - 1, 2))).otherwise("")
            right = F.when(F.length(t) > at, lookup(F.substring(t, at, 2))).otherwise("")
            return F.struct(t.alias("s"), F.concat(F.substring(r, F.lit(1), at - 2), left, right, F.substring(r, at + 2, F.lit(LONG_WORD))).alias("r"))

        return let(F.concat(F.substring(s, F.lit(1), at - 1), least, F.substring(s, at + 2, F.lit(LONG_WORD))), joined)

    def step(state: Column, _: Column) -> Column:
        def next_merge(least: Column) -> Column:
            return F.when((least == NONE) | (least == ""), state).otherwise(let(F.instr(state["r"], least), lambda at: merge(state, least, at)))

        return let(F.array_min(F.split(state["r"], "")), next_merge)

    def fold(s: Column) -> Column:
        start = F.struct(s.alias("s"), ranked(s).alias("r"))
        return F.aggregate(F.sequence(F.lit(2), F.length(s)), start, step)["s"]

    whole = let(F.decode(F.encode(word, "utf-8"), "iso-8859-1"), lambda s: F.when(F.length(s) < 2, s).otherwise(fold(s)))
    return F.when(F.octet_length(word) > LONG_WORD, F.lit("")).otherwise(whole)


def heap_ids(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word in n log n steps."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = after[i] if alive[i] else n
        if j >= n or not alive[i] or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(piece[a : end[b]])) is not None:
                heapq.heappush(queue, (r, a, end[b]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def _list_parts(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists (null: 0) and their joined values."""
    return np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64), column.flatten()


def _cuts(lengths: np.ndarray, most: int, also: set[int] | None = None) -> list[tuple[int, int]]:
    """Bounds of parts that hold about ``most`` words each; a part begins at each row of also, too."""
    at = np.searchsorted(np.cumsum(lengths), np.arange(most, lengths.sum(), most)) + 1
    bounds = sorted({0, len(lengths), *at.tolist(), *(also or ())})
    return list(zip(bounds, bounds[1:], strict=False))


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


class _Book:
    """Ids of words by their codes: the common words first, then those of a task."""

    def __init__(self, ranks: dict[bytes, int], common: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.ranks = ranks
        self.first, self.values = common or (np.zeros(1, np.int64), np.zeros(0, np.int32))
        self.of_byte = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int32)

    def add(self, words: pa.StringArray, merged: pa.StringArray) -> None:
        size = pc.utf8_length(merged).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.frombuffer(merged.buffers()[1], np.int32)[merged.offset : merged.offset + len(merged) + 1] if len(merged) else np.zeros(1, np.int32)
        text = (merged.buffers()[2] or b"")[int(bounds[0]) : int(bounds[-1])]
        flat = np.frombuffer(bytes(text).decode().encode("utf-32-le"), np.int32)
        ids = np.where(flat < 256, self.of_byte[np.minimum(flat, 255)], np.where(flat < 0xD800, flat - 256, flat - 0x2900)).astype(np.int32)
        for i in np.flatnonzero(size == 0).tolist():  # words that the fold leaves to the heap
            long = np.array(heap_ids(words[i].as_py().encode(), self.ranks), np.int32)
            at = int(size[:i].sum())
            ids, size[i] = np.concatenate([ids[:at], long, ids[at:]]), len(long)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        self.values = np.concatenate([self.values, ids])

    def ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each code, and all their ids in order."""
        size = self.first[codes + 1] - self.first[codes]
        at = np.repeat((self.first[codes] - _starts(size)[:-1]).astype(np.int32), size)
        return size, self.values[at + np.arange(len(at), dtype=np.int32)]


def split_words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def folded(df: DataFrame, pairs: str, news: str, merged: str) -> DataFrame:
    """df with merged: the words of the array column news after all merges, by the map of ``merge_map`` in the column pairs, which is read
    once for each row that has words; other rows need none."""
    table = F.from_json(F.col(pairs), "array<map<string,string>>")
    return df.withColumn(merged, F.when(F.size(news) > 0, let(table, lambda t: F.transform(news, lambda w: merged_word(w, t)))).otherwise(F.array().cast("array<string>")))


def common_words(df: DataFrame, ranks: dict[bytes, int], pairs: Broadcast, pattern: str, text: str = "text") -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Words and, by their place, the bounds and values of their ids: tokens, and words of the rows with the least hashes."""
    tokens = []
    for piece in ranks:
        try:
            tokens.append(piece.decode())
        except UnicodeDecodeError:
            continue
    share = SAMPLE_ROWS / max(1, df.count())
    sample = df.where(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < int(1_000_000 * share) + 1).select(F.explode(split_words(F.col(text), pattern)).alias("w"))
    words = cut(sample.where(F.octet_length("w") <= COMMON_BYTES).groupBy("w").count(), "bpe-words")
    sizes, least, total = {r.c: r.n for r in words.groupBy(F.least("count", F.lit(1000)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}, 1001, 0
    for c in sorted(sizes, reverse=True):
        total += sizes[c]
        if total > COMMON_WORDS:
            break
        least = c
    groups = words.where(F.col("count") >= least).groupBy(F.pmod(F.xxhash64("w"), F.lit(COMMON_GROUPS)).alias("g")).agg(F.collect_list("w").alias("news"))

    def with_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([pairs.value])], ["news", "pairs"])

    given = groups.select("news").mapInArrow(with_pairs, "news array<string>, pairs string")
    found = folded(given, "pairs", "news", "merged").select("news", "merged").toArrow()
    news, merged = (pc.list_flatten(found.column(c)).combine_chunks().cast(pa.string()) for c in ("news", "merged"))
    known = pa.array(tokens, pa.string())
    other = pc.invert(pc.is_in(news, value_set=known))
    news, merged = news.filter(other), merged.filter(other)
    book = _Book(ranks, (np.arange(len(tokens) + 1, dtype=np.int64), np.array([ranks[t.encode()] for t in tokens], np.int32)))
    book.add(news, merged)
    return pa.concat_arrays([known, news]), book.first, book.values


def small_batches(spark: SparkSession) -> None:
    """Batches that Python gets hold at most ``BATCH_BYTES``. Words take several times the bytes of their text, in the JVM's buffers and in Python,
    and two steps of each task hold a batch at once. The setting is read when a plan runs, so it stays in the session; smaller ones are left alone."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    at_most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting))
    if not 0 < at_most <= BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", keep: Sequence[str] | None = None) -> DataFrame:
    """df, or its columns keep, with the array column ids: the token ids of each whole text, without special tokens. What is kept goes through
    Python and back, so a text that nobody needs any more is better left out."""
    small_batches(df.sparkSession)
    words, codes, news, table, merged = (free_name(df, x) for x in ("words_", "codes_", "news_", "pairs_", "merged_"))
    kept = [f for f in (df if keep is None else df.select(*keep)).schema.fields if f.name.lower() != ids.lower()]
    names = [f.name for f in kept]
    k = len(names)
    pairs = df.sparkSession.sparkContext.broadcast(merge_map(ranks))
    known, *bounds = common_words(df, ranks, pairs, pattern, text)
    # Each step is a Python worker of its own and loads only what it reads.
    shared_words, shared_ids = (df.sparkSession.sparkContext.broadcast(x) for x in (known, tuple(bounds)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes instead of words; ``news``: new words that must be merged; a null among them begins a dictionary anew. The row that has
        such words has the map of pairs as well."""
        common = shared_words.value
        seen: dict[str, int] = {}
        fresh: list[str | None] = []
        held: list[list[pa.Array]] = []
        words_held = 0

        def given_on() -> Iterator[pa.RecordBatch]:
            """What is held; its first row has all new words. A map of pairs is dear to read, so several small batches share one."""
            for i, columns in enumerate(held):
                rest = [None] * (len(columns[-1]) - 1)
                new = fresh if not i else []
                lookup = pa.array([pairs.value if new else None, *rest], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([new, *[[]] * len(rest)], pa.list_(pa.string())), lookup], [*names, codes, news, table])
            held.clear()
            fresh.clear()

        for batch in batches:
            lengths, _ = _list_parts(batch.column(k))
            for a, b in _cuts(lengths, BATCH_WORDS):
                part = batch.slice(a, b - a)
                n, flat = _list_parts(part.column(k))
                if words_held + len(flat) > BATCH_WORDS or len(seen) > BOOK_WORDS:
                    yield from given_on()
                    words_held = 0
                if len(seen) > BOOK_WORDS:
                    seen = {}
                    fresh.append(None)
                coded = flat.dictionary_encode()
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=common), -1).to_numpy(zero_copy_only=False).copy()
                other = np.flatnonzero(place < 0)
                own = coded.dictionary.take(pa.array(other)).to_pylist()
                for w in own:
                    if w not in seen:
                        seen[w] = len(common) + len(seen)
                        fresh.append(w)
                place[other] = np.fromiter((seen[w] for w in own), np.int32, len(own))
                mine = place[coded.indices.to_numpy()] if len(place) else np.zeros(0, np.int32)
                # Copies: a column of the batch would keep all of it, its words, too.
                rows = pa.array(np.arange(b - a))
                held.append([*(c.take(rows) for c in part.columns[:k]), pa.ListArray.from_arrays(pa.array(_starts(n), pa.int32()), pa.array(mine, pa.int32()))])
                words_held += len(flat)
                del part, flat, coded, place, mine, own
            pa.default_memory_pool().release_unused()
        yield from given_on()

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared_ids.value
        book = _Book(ranks, common)
        for batch in batches:
            n, flat = _list_parts(batch.column(k))
            flat, ends = flat.to_numpy(), _starts(n)
            fresh, done = batch.column(k + 1), batch.column(k + 2)
            begins = {*np.flatnonzero(_list_parts(fresh)[0]).tolist()}
            for a, b in _cuts(n, PART_WORDS, begins):
                if a in begins:
                    new, pieces = fresh[a].values, done[a].values
                    if not new[0].is_valid:
                        book, new, pieces = _Book(ranks, common), new[1:], pieces[1:]
                    book.add(new, pieces)
                size, values = book.ids(flat[ends[a] : ends[b]])
                total = _starts(size)
                out = total[ends[a : b + 1] - ends[a]]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:k]), pa.ListArray.from_arrays(pa.array(out, pa.int32()), pa.array(values, pa.int32()))], [*names, ids])
            pa.default_memory_pool().release_unused()

    numbered = df.select(*names, split_words(F.col(text), pattern).alias(words)).mapInArrow(number, T.StructType([*kept, T.StructField(codes, T.ArrayType(T.IntegerType())), T.StructField(news, T.ArrayType(T.StringType())), T.StructField(table, T.StringType())]))
    return folded(numbered, table, news, merged).drop(table).mapInArrow(replace, T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of the ids: their pieces, one after another (null: null)."""
    pieces = piece_list(ranks)
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""), "iso-8859-1")
