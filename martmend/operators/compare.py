"""Comparison of marts and proofs of coverage. Every result is a table of one row or of keys; nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import union_all
from .workspace import Workspace

#: Buckets of the first level of a comparison.
BUCKETS = 4_096

def one_row(*parts: DataFrame) -> DataFrame:
    """Aggregates of one row each, side by side."""
    marked = [p.withColumn("__one", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(F.broadcast(b), "__one"), marked).drop("__one")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def compare_tables(actual: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """missing_rows (only in the reference), extra_rows, mismatched_rows (a column differs, null-safely), duplicate_keys and reason.

    Columns are aligned by name. Both sides are reduced to one row per key first, so a key with several rows adds one
    duplicate key and never multiplies the join.
    """
    if sorted(actual.columns) != sorted(reference.columns):
        return actual.sparkSession.createDataFrame([(None, None, None, None, "SCHEMA_MISALIGNED")], "missing_rows long, extra_rows long, mismatched_rows long, duplicate_keys long, reason string")
    names = sorted(c for c in actual.columns if c != key)
    sides = []
    for mark, df in (("a", actual), ("r", reference)):
        row = F.struct(*[F.col(c) for c in names]) if names else F.struct(F.lit(1).alias("one"))
        sides.append(df.groupBy(F.col(key).alias(f"__k{mark}")).agg(F.count(F.lit(1)).alias(f"__n{mark}"), F.first(row).alias(f"__{mark}")))
    met = sides[0].join(sides[1], F.col("__ka").eqNullSafe(F.col("__kr")), "full_outer")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")

    counts = met.agg(
        total(F.col("__na").isNull()).alias("missing_rows"),
        total(F.col("__nr").isNull()).alias("extra_rows"),
        total(F.col("__na").isNotNull() & F.col("__nr").isNotNull() & ~F.col("__a").eqNullSafe(F.col("__r"))).alias("mismatched_rows"),
        total((F.col("__na") > 1) | (F.col("__nr") > 1)).alias("duplicate_keys"),
    )
    wrong = F.col("missing_rows") + F.col("extra_rows") + F.col("mismatched_rows")
    return counts.withColumn("reason", F.when(F.col("duplicate_keys") > 0, "GRAIN_VIOLATED").when(wrong > 0, "ROWS_DIFFER"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with multiplicity."""
    after = after.select(*before.columns)
    return union_all(before.exceptAll(after), after.exceptAll(before))


def changed_keys(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys with rows that differ. Rows without a key belong to no entity and are left out, as they are of candidates."""
    keyed = F.col(key).isNotNull()
    return difference(before.where(keyed), after.where(keyed)).select(key).distinct()


#: On targeted results the same operation confirms candidates.
confirmed_keys = changed_keys


def missing_keys(changed: DataFrame, candidates: DataFrame) -> DataFrame:
    key = changed.columns[0]
    return changed.join(candidates.select(F.col(candidates.columns[0]).alias(key)), key, "left_anti").distinct()


def extra_keys(candidates: DataFrame, changed: DataFrame) -> DataFrame:
    return missing_keys(candidates, changed)


vanished_keys = missing_keys


def mismatched_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return difference(a, b).agg(F.count(F.lit(1)).alias("mismatched_rows"))


def pre_repair_delta(mart: DataFrame, head: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows in which the mart, limited to the keys, differs from the recomputed rows; a diagnostic, no verdict."""
    only = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
    return mismatched_rows(mart.join(only, key, "left_semi"), head)


def count_of(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def impact_metrics(full: Column, frontier: Column) -> list[Column]:
    """Columns of the entity metrics; percent_avoided is an error for impossible counts."""
    sound = (full > 0) & frontier.between(0, full)
    percent = F.when(sound, F.round((1 - frontier / full) * 100, 3)).otherwise(F.raise_error(F.lit("entity counts are impossible")).cast("double"))
    return [full.alias("full_entities"), frontier.alias("frontier_entities"), percent.alias("percent_avoided")]


def no_op_count(union: Column, confirmed: Column) -> Column:
    return F.when(confirmed <= union, union - confirmed).otherwise(F.raise_error(F.lit("more confirmed keys than candidates")).cast("bigint"))


def digests(df: DataFrame, like: DataFrame, key: str, side: str, **sides: str) -> DataFrame:
    """__key, __a and __b (128 bits of the row, columns by name and in the types of ``like``) and a count for each of the sides."""
    cells = [F.col(c).cast(like.schema[c].dataType) for c in sorted(like.columns)]
    ones = [F.lit(int(n == side)).cast("bigint").alias(n) for n in sides]
    return df.select(F.col(key).cast(like.schema[key].dataType).alias("__key"), F.xxhash64(*cells).alias("__a"), F.xxhash64(F.lit(1), *cells).alias("__b"), *ones)


def _tally(key: str, like: DataFrame, keys: DataFrame, apart: dict[str, Column], **sides: DataFrame) -> DataFrame:
    """A row for each key: the rows of each side, ``listed`` (rows in keys), and the sums of ``apart`` over the key's distinct rows.

    Each side is read once. Rows are added up by digest before the shuffle, so neither rows without a key nor repeated rows make
    a task large.
    """
    names = dict.fromkeys(sides, "")
    rows = [digests(df, like, key, n, **names).withColumn("listed", F.lit(0).cast("bigint")) for n, df in sides.items()]
    zero = F.lit(0).cast("bigint")
    only = keys.select(F.col(keys.columns[0]).cast(like.schema[key].dataType).alias("__key")).where("__key is not null")
    rows.append(only.select("__key", zero.alias("__a"), zero.alias("__b"), *[zero.alias(n) for n in names], F.lit(1).cast("bigint").alias("listed")))
    kinds = union_all(*rows).groupBy("__key", "__a", "__b").agg(*[F.sum(n).alias(n) for n in (*names, "listed")])
    return kinds.groupBy("__key").agg(*[F.sum(n).alias(n) for n in (*names, "listed")], *[F.sum(c).alias(n) for n, c in apart.items()])


def _count(c: Column) -> Column:
    return F.count(F.when(c, 1))


def change_proof(before: DataFrame, after: DataFrame, candidates: DataFrame, head: DataFrame, key: str) -> DataFrame:
    """The coverage proof of a change in one row: no changed key may be missing; extra ones are reported, never a failure.

    The repaired mart is ``before`` with ``head`` (the recomputed rows) in place of the candidates' rows; it is not built but
    follows from the tally, in which each of the four tables is read once.
    """
    c = F.col
    apart = {
        "moved": F.abs(c("before") - c("after")),
        "kept": F.abs(c("before") + c("head") - c("after")),  # were the key no candidate
        "replaced": F.abs(c("head") - c("after")),
    }
    tally = _tally(key, before, candidates, apart, before=before, after=after, head=head)
    keyed, listed = c("__key").isNotNull(), c("listed") > 0
    row = tally.agg(
        F.coalesce(F.sum("before"), F.lit(0)).alias("before_entities"),
        F.coalesce(F.sum("after"), F.lit(0)).alias("after_entities"),
        F.coalesce(F.sum("listed"), F.lit(0)).alias("candidates"),
        _count(keyed & (c("moved") > 0)).alias("changed"),
        _count(keyed & (c("moved") > 0) & ~listed).alias("missing"),
        _count(listed & (c("moved") == 0)).alias("extra"),
        F.coalesce(F.sum(F.when(listed, c("replaced")).otherwise(c("kept"))), F.lit(0)).alias("mismatched_rows"),
    )
    return row.withColumn("passed", (c("missing") == 0) & (c("mismatched_rows") == 0))


#: The proof of a mutation of the data is the same, from the marts before and after it.
mutation_proof = change_proof


def targeted_proof(mart: DataFrame, keys: DataFrame, head: DataFrame, key: str) -> DataFrame:
    """candidate_count, confirmed_change_count, no_op_count, vanished_count and targeted_rows_compared of a batch's keys, from their rows
    in the mart and the recomputed ones: one pass over each."""
    c = F.col
    only = keys.select(c(keys.columns[0]).cast(mart.schema[key].dataType).alias(key)).where(c(key).isNotNull())
    current = mart.join(only, key, "left_semi")
    tally = _tally(key, mart, only, {"moved": F.abs(c("now") - c("head"))}, now=current, head=head)
    listed = c("listed") > 0
    row = tally.agg(_count(listed).alias("candidate_count"), _count(listed & (c("moved") > 0)).alias("confirmed_change_count"), _count(listed & (c("head") == 0)).alias("vanished_count"), F.coalesce(F.sum(F.when(~listed, c("head"))), F.lit(0)).alias("strays"))
    return row.select("candidate_count", "confirmed_change_count", (c("candidate_count") - c("confirmed_change_count")).alias("no_op_count"), "vanished_count", (c("strays") == 0).alias("targeted_rows_compared"))


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets))


def bucket_digests(df: DataFrame, like: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """bucket, rows, digest (sums over the rows) and duplicate_keys of each bucket of keys: the first level of a comparison. Marts
    that don't change can keep it."""
    wide = "decimal(38,0)"
    one = digests(df, like, key, "n", n="").groupBy("__key").agg(F.sum("n").alias("n"), F.sum(F.col("__a").cast(wide)).alias("a"), F.sum(F.col("__b").cast(wide)).alias("b"))
    return one.groupBy(bucket_of("__key", buckets).alias("bucket")).agg(F.sum("n").alias("rows"), F.struct(F.sum("a").alias("a"), F.sum("b").alias("b")).alias("digest"), _count(F.col("n") > 1).alias("duplicate_keys"))


def compare_by_buckets(actual: DataFrame, reference: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """``compare_tables`` in two levels: sums of row digests for each bucket of keys first, then the rows of buckets that differ.

    Equal marts are told without joining rows; with few changes only their buckets are read again and joined. The digests are kept
    in a work table of at most ``buckets`` rows a side.
    """
    spark = actual.sparkSession
    if sorted(actual.columns) != sorted(reference.columns):
        return compare_tables(actual, reference, key)
    with Workspace(spark) as work:
        sides = [work.put(name, bucket_digests(df, reference, key, buckets)) for name, df in (("actual", actual), ("reference", reference))]
        met = sides[0].join(sides[1].select("bucket", F.col("rows").alias("r"), F.col("digest").alias("d"), F.col("duplicate_keys").alias("k")), "bucket", "full_outer")
        differ = ~F.col("rows").eqNullSafe(F.col("r")) | ~F.col("digest").eqNullSafe(F.col("d"))
        doubled = F.greatest(F.coalesce("duplicate_keys", F.lit(0)), F.coalesce("k", F.lit(0)))
        facts = met.agg(_count(differ).alias("differ"), F.coalesce(F.sum(F.when(~differ, doubled)), F.lit(0)).alias("doubled")).first()
        counts = (0, 0, 0, 0)
        if facts.differ:
            some = work.put("differ", met.where(differ).select("bucket"))  # at most ``buckets`` rows
            rest = [df.withColumn("bucket", bucket_of(key, buckets)).join(F.broadcast(some), "bucket", "left_semi").drop("bucket") for df in (actual.withColumn(key, F.col(key).cast(reference.schema[key].dataType)), reference)]
            counts = compare_tables(*rest, key).select("missing_rows", "extra_rows", "mismatched_rows", "duplicate_keys").first()
    missing, extra, mismatched, doubled = *counts[:3], counts[3] + facts.doubled
    reason = "GRAIN_VIOLATED" if doubled else "ROWS_DIFFER" if missing + extra + mismatched else None
    return spark.createDataFrame([(missing, extra, mismatched, doubled, reason)], "missing_rows long, extra_rows long, mismatched_rows long, duplicate_keys long, reason string")


def fallback_proof(df: DataFrame, kind: Column, full: Column, candidates: Column, source_rows: Column) -> DataFrame:
    """Counts of runs without a measured proof. required: the candidate set is unknown, so all entities are candidates.
    recommended, failed: the measured candidates stay."""
    known = kind.isin("recommended", "failed")
    frontier = F.when(known, F.least(F.greatest(candidates, F.lit(0)), full)).otherwise(full)
    return df.select(
        "*",
        frontier.alias("frontier_rows"),
        (full - frontier).alias("rows_avoided"),
        F.when(known, candidates).otherwise(full).alias("candidate_count"),
        F.when(known, source_rows).otherwise(F.lit(0).cast("bigint")).alias("changed_source_rows"),
        (kind == "required").alias("rebuild_required"),
        (kind == "recommended").alias("rebuild_recommended"),
    )
