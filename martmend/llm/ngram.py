"""N-gram Jaccard join (operator 2) by a token-group matrix.

Two documents link when their sets of five-word shingles have a Jaccard similarity of at least ``percent`` / 100. The
result is exact up to collisions of 64-bit hashes.

1. ``weigh`` counts hashed shingles over all documents in a table of fixed size. It orders all shingles, rare ones first;
   any order gives the same links, a good one fewer candidates.
2. ``signatures`` gives each document the size and hash of its set, its prefix (the first shingles in that order, so many
   that two linked sets must share one) and a few minima of remixed prefix shingles. Equal sets are one set from here on.
3. Groups: sets that share a minimum are compared with the most common of them; linked ones form a group.
4. The matrix has the shingles of the groups' prefixes; shingles of one group only are left out. Groups that share a shingle,
   at places, with sizes and with sketches that allow a link, are candidates. Sketches bound the difference of two sets from
   below, so a family of copies that are too far apart to link makes few candidates.
5. Each candidate group's token union is stored as (group, token) rows. The overlap of a set with a union bounds its overlap with
   every member; only groups that reach the needed overlap are opened. The set that met a group is compared with the member
   that it met first, which joins most groups that belong together.
6. For groups still apart the other sets ask, too, and all members of a possible size of the groups that they open are compared.

Hot minima are reduced to one set each and joined by plain equi-joins whose hot partitions Spark splits; hot shingles of several
groups are dealt out by salts, in each of which a task compares ``SALTED`` or so entries with all others, which takes time in
proportion to the square of their number. Links and components stay tables.

Defined results: null, empty and blank texts have no shingles and stay alone; repeated rows and equal texts link (if not
empty); null ids form the component null only when no id is known; extra columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped, union
from .graph import components
from .shingles import mix, sets

WORDS, PERCENT, MINIMA = 5, 80, 4
#: Cells of a sketch, and rows of a token below which it is not dealt out to several tasks.
SKETCH, SALTED = 512, 1024
#: Entries of one token and group that are held until another group comes.
HELD = 1_000_000
#: Counters in a block of the count table, and the least and largest exponent of their number.
BLOCK, LEAST_BITS, MOST_BITS = 4096, 16, 26


def need(n: np.ndarray | int, percent: int = PERCENT):
    """The least overlap with any linked set of a set of n."""
    return (n * percent + 99) // 100


def weigh(docs: DataFrame, text: str = "text", words: int = WORDS) -> np.ndarray:
    """Levels (steps of a quarter) of the number of documents for each hash bucket; at most 2**MOST_BITS bytes."""
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(4 * docs.count() + 1)))))
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for s in sets(batch.column(0), words):
                np.add.at(table, (s >> shift).astype(np.int64), np.uint32(1))
        for b in range(len(table) // BLOCK):
            part = table[b * BLOCK : (b + 1) * BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["block", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.uint64)
        for batch in batches:
            for c in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
        levels = np.floor(np.log(np.maximum(total, 1)) / np.log(1.25)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([levels.tobytes()], pa.binary())], ["block", "levels"])

    out = np.zeros(1 << bits, np.uint8)
    for r in docs.select(text).mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, levels binary").toLocalIterator():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.levels, np.uint8)
    return out


def signatures(docs: DataFrame, levels: np.ndarray, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, sid (the set's hash; null for none), prefix, minima and sketch of each row.

    The sketch has the parities of the numbers of shingles in ``SKETCH`` cells: two sets differ in at least as many shingles as
    their sketches differ in bits.
    """
    held = docs.sparkSession.sparkContext.broadcast(levels)
    shift = np.uint64(64 - int(np.log2(len(levels))))
    seeds = mix(np.arange(1, MINIMA + 1, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            n, sid, prefix, minima, common, sketch = [], [], [], [], [], []
            for s in sets(batch.column(1), words):
                n.append(len(s))
                if not len(s):
                    sid.append(None), prefix.append(None), minima.append(None), common.append(None), sketch.append(None)
                    continue
                sid.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63)
                order = np.lexsort((s, table[(s >> shift).astype(np.int64)]))
                first = s[order[: len(s) - int(need(len(s), percent)) + 1]]
                prefix.append(first.view(np.int64))
                common.append(float(table[(first >> shift).astype(np.int64)].mean()))
                minima.append([int(mix(first ^ seed).view(np.int64).min()) for seed in seeds])
                sketch.append(np.packbits(np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(sid, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(minima, pa.list_(pa.int64())), pa.array(common, pa.float64()), pa.array(sketch, pa.binary())], ["doc_id", "n", "sid", "prefix", "minima", "common", "sketch"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(sign, "doc_id long, n int, sid long, prefix array<long>, minima array<long>, common double, sketch binary")


def fetch_sets(docs: DataFrame, wanted: DataFrame, signed: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(sid, text) for each wanted sid: the text of one document that has it, which takes less room than the set."""
    reps = signed.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("doc_id").alias("rep"))
    left = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("text"))
    rows = left.join(reps, F.col("d").eqNullSafe(F.col("rep"))).select("sid", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Ids may be repeated with other texts.
            own = [bool(len(s)) and xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 == i for i, s in zip(batch.column(0).to_pylist(), sets(batch.column(1), words), strict=True)]
            yield batch.filter(pa.array(own, pa.bool_()))

    return cut(rows.mapInArrow(make, "sid long, text string").dropDuplicates(["sid"]), "ngram-sets")


def compare(pairs: DataFrame, held: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    both = pairs.join(held.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a").join(held.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(sets(batch.column(2), words), sets(batch.column(3), words), strict=True):
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(judge, "a long, b long")


def grouped(sids: DataFrame, links: DataFrame) -> DataFrame:
    """sids with their group g: the smallest set reachable by links, or the set itself."""
    found = components(links, "ngram-groups").withColumnsRenamed({"v": "sid", "c": "g_"})
    return sids.join(found, "sid", "left").withColumn("g", F.coalesce("g_", "sid")).drop("g_")


def minima_pairs(signed: DataFrame) -> DataFrame:
    """(a, b): each set with the most common set that shares one of its minima.

    Most common: with the highest mean level of its prefix. Among edited copies of a text that is the text itself, or the
    copy with the fewest edits, to which most others link even where they do not link to one another.
    """
    keys = signed.where("n > 0").select("sid", "common", F.posexplode("minima").alias("i", "m"))
    hubs = keys.groupBy("i", "m").agg(F.max_by("sid", F.struct("common", "sid")).alias("b"), F.min("sid").alias("y"), F.max("sid").alias("z")).where("y < z").select("i", "m", "b")
    return keys.join(hubs, ["i", "m"]).where("sid <> b").select(F.col("sid").alias("a"), "b").distinct()


NAMES = ["token", "g", "sid", "n", "at"]


def shared_tokens(members: DataFrame) -> DataFrame:
    """token, g, sid, n, at: the entries of the token-group matrix whose token stands in several groups.

    members: sid, g, n, prefix. Rows of one token stand together in a sorted partition; entries of its first group are held
    until a second group comes, others pass through.
    """
    posted = members.select(F.posexplode("prefix").alias("at", "token"), "g", "sid", "n").select(*NAMES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # entries of a token that may have one group only
        last, several = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            token, g = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            stop = np.append(begin[1:], len(token))
            many = g[begin] != g[stop - 1]  # sorted by group within a token
            if last is not None and token[0] == last[0]:
                many[0] |= several or g[0] != last[1]
                if many[0]:
                    yield from held
                    held = []
            else:
                held = []
            keep = np.repeat(many, stop - begin)
            if not many[-1]:
                held = [*(held if len(begin) == 1 else []), batch.slice(int(begin[-1]))]
                if sum(b.num_rows for b in held) > HELD:  # a superset does no harm
                    yield from held
                    held = []
            else:
                held = []
            last, several = (token[-1], g[-1]), bool(many[-1])
            if keep.any():
                yield batch.filter(pa.array(keep))

    return posted.repartition("token").sortWithinPartitions("token", "g").mapInArrow(scan, posted.schema)


def matrix_pairs(entries: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(ga, gb, a, b): groups whose sets a and b share a token and may link by sizes, places and sketches, each pair of groups once.

    entries: of the token-group matrix; sketches: sid and sketch. Tokens with many entries are dealt out by salts: an entry
    meets all others of its token in the task of its own salt.
    """
    many = entries.groupBy("token").agg((F.floor(F.count(F.lit(1)) / SALTED).cast("int") + 1).alias("salts"))
    rows = entries.join(many, "token").join(sketches, "sid")
    dealt = rows.select(*NAMES, "sketch", F.pmod("sid", "salts").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, seen = None, set()

        def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            token, g, sid, n, at, sketch, own, salt = cols
            begin = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]))
            stop = np.append(begin[1:], len(token))
            out = []
            for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
                if b - a < 2 or (g[a:b] == g[a]).all():
                    continue
                for i in (np.flatnonzero(own[a:b] == salt[a]) + a).tolist():
                    low, high = np.minimum(n[a:b], n[i]), np.maximum(n[a:b], n[i])
                    left = np.minimum(n[a:b] - at[a:b], n[i] - at[i])
                    fit = (sid[a:b] < sid[i]) & (g[a:b] != g[i]) & (100 * low >= percent * high) & ((100 + percent) * left >= percent * (low + high))
                    j = np.flatnonzero(fit) + a
                    apart = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1, dtype=np.int64)
                    for j in j[(100 + percent) * apart <= (100 - percent) * (n[j] + n[i])].tolist():
                        x, y = (i, j) if g[i] < g[j] else (j, i)
                        if (key := (int(g[x]), int(g[y]))) not in seen:
                            if len(seen) > 1_000_000:
                                seen.clear()  # pairs met again are made distinct later
                            seen.add(key)
                            out.append((*key, int(sid[x]), int(sid[y])))
                if len(out) > 50_000:
                    yield table(out)
                    out = []
            if out:
                yield table(out)

        def table(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["ga", "gb", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            by = dict(zip(batch.schema.names, batch.columns, strict=True))
            bits = np.frombuffer(b"".join(by["sketch"].to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
            cols = [*(by[x].to_numpy() for x in NAMES), bits, by["own"].to_numpy(), by["salt"].to_numpy()]
            if rest:
                cols = [np.concatenate(c) for c in zip(rest, cols, strict=True)]
            last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[7] != cols[7][-1]))[-1]) + 1 if (cols[0] != cols[0][-1]).any() or (cols[7] != cols[7][-1]).any() else 0
            rest = [c[last:] for c in cols]
            if last:
                yield from emit([c[:last] for c in cols])
        if rest and len(rest[0]):
            yield from emit(rest)

    sorted_rows = dealt.repartition("token", "salt").sortWithinPartitions("token", "salt", "g")
    return sorted_rows.mapInArrow(scan, "ga long, gb long, a long, b long").groupBy("ga", "gb").agg(F.min_by("a", F.struct("a", "b")).alias("a"), F.min_by("b", F.struct("a", "b")).alias("b"))


def tokens_of(held: DataFrame, words: int = WORDS) -> DataFrame:
    """(sid, token): a row for each shingle of the sets in held (sid, text)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), sets(batch.column(1), words), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i)), pa.array(s.view(np.int64))], ["sid", "token"])

    return held.mapInArrow(spread, "sid long, token long")


def qualifying(queries: DataFrame, inside: DataFrame, tokens: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, gb, na) of the queries (a, na, gb) whose overlap with the token union of the group gb is as large as a link with any member needs.

    inside: b, gb and nb of the groups' members. Unions are (group, token) rows, and overlaps are added up for each set and group, so
    neither a union nor the queries of a group are ever in one task as a whole.
    """
    union = inside.select(F.col("b").alias("sid"), "gb").join(tokens, "sid").select("gb", "token").distinct()
    asked = queries.select(F.col("a").alias("sid"), "gb", "na").join(tokens, "sid").join(union, ["gb", "token"])
    return asked.groupBy(F.col("sid").alias("a"), "gb", "na").agg(F.count(F.lit(1)).alias("overlap")).where(100 * F.col("overlap") >= percent * F.col("na")).drop("overlap")


def open_met(near: DataFrame, members: DataFrame, docs: DataFrame, signed: DataFrame, percent: int = PERCENT, **names: str) -> DataFrame:
    """Links (a, b) of near (ga, gb, a, b): a against the token union of gb, then, where the bound allows, against the member that it met."""
    small = members.select("sid", "g", "n")
    queries = near.select("a", "gb").distinct().join(small.select(F.col("sid").alias("a"), F.col("n").alias("na")), "a")
    inside = near.select("gb").distinct().join(small.select(F.col("sid").alias("b"), F.col("g").alias("gb"), F.col("n").alias("nb")), "gb")
    held = fetch_sets(docs, queries.select(F.col("a").alias("sid")).union(inside.select("b")).distinct(), signed, **names)
    fit = cut(qualifying(queries, inside, tokens_of(held, names.get("words", WORDS)), percent), "ngram-fit")
    links = cut(compare(near.join(fit, ["a", "gb"]).select("a", "b"), held, percent, names.get("words", WORDS)), "ngram-links")
    for table in (held, fit):
        dropped(docs.sparkSession, table)
    return links


def open_groups(pairs: DataFrame, members: DataFrame, docs: DataFrame, signed: DataFrame, percent: int = PERCENT, **names: str) -> DataFrame:
    """Links (a, b) between groups (ga, gb): sets of ga against the token union of gb, then against gb's members where the bound allows."""
    small = members.select("sid", "g", "n")
    queries = pairs.select("ga", "gb").join(small.select(F.col("sid").alias("a"), F.col("g").alias("ga"), F.col("n").alias("na")), "ga")
    inside = pairs.select("gb").distinct().join(small.select(F.col("sid").alias("b"), F.col("g").alias("gb"), F.col("n").alias("nb")), "gb")
    held = fetch_sets(docs, queries.select(F.col("a").alias("sid")).union(inside.select("b")).distinct(), signed, **names)
    fit = qualifying(queries, inside, tokens_of(held, names.get("words", WORDS)), percent)
    opened = fit.join(inside, "gb").where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("a") != F.col("b")))
    return compare(opened.select("a", "b"), held, percent, names.get("words", WORDS))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) of each row of docs."""
    signed = cut(signatures(docs, weigh(docs, text, words), doc_id, text, words, percent), "ngram-signed")
    names, spark = {"doc_id": doc_id, "text": text, "words": words}, docs.sparkSession
    sids = signed.where("n > 0").select("sid", "n").distinct()
    first = cut(minima_pairs(signed), "ngram-first")
    held = fetch_sets(docs, first.select(F.col("a").alias("sid")).union(first.select("b")).distinct(), signed, **names)
    links = cut(compare(first, held, percent, words), "ngram-links")
    dropped(spark, held)
    dropped(spark, first)
    members = grouped(signed.where("n > 0").select("sid", "n", "prefix").dropDuplicates(["sid"]), links)
    entries = cut(shared_tokens(members), "ngram-entries")
    near = cut(matrix_pairs(entries, signed.where("n > 0").select("sid", "sketch").dropDuplicates(["sid"]), percent), "ngram-near")
    dropped(spark, entries)
    more = open_met(near, members, docs, signed, percent, **names)
    # Groups of which neither has more than one set are settled; the others may link through other members.
    of = cut(grouped(sids, union(links, more)), "ngram-of")
    old = cut(grouped(sids, links), "ngram-old")
    sizes = old.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    root = [of.select(F.col("sid").alias(f"g{x}"), F.col("g").alias(f"r{x}")) for x in "ab"]
    apart = near.select("ga", "gb").join(root[0], "ga").join(root[1], "gb").where("ra <> rb")
    apart = apart.join(sizes.select(F.col("g").alias("ga"), F.col("k").alias("ka")), "ga", "left").join(sizes.select(F.col("g").alias("gb"), F.col("k").alias("kb")), "gb", "left")
    apart = apart.where("ka is not null or kb is not null").select(F.when(F.coalesce("ka", F.lit(1)) > F.coalesce("kb", F.lit(1)), F.struct(F.col("gb").alias("ga"), F.col("ga").alias("gb"))).otherwise(F.struct("ga", "gb")).alias("p")).select("p.*")
    apart = cut(apart, "ngram-apart")
    if not apart.isEmpty():
        last = cut(open_groups(apart, old, docs, signed, percent, **names), "ngram-links")
        of = cut(grouped(sids, union(links, more, last)), "ngram-of")
    least = signed.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = of.select("sid", "g").join(least, "sid")
    whole = named.groupBy("g").agg(F.min("least").alias("component_id"))
    named = cut(named.select("sid", "g").join(whole, "g").select("sid", "component_id"), "ngram-named")
    out = signed.select("doc_id", "n", "sid").join(named, "sid", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
