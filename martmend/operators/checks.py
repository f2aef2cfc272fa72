"""Roll-up of checks, and profiles of key columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sets of checks that together count as an empirical proof.
PROOFS = (
    ("assert_changed_customers_in_frontier", "assert_no_extra_frontier_entities", "assert_repaired_equals_reference"),
    ("assert_sql_frontier_covers_reference", "assert_repaired_equals_reference"),
    ("assert_frontier_events_resolve", "assert_frontier_matches_full_mart"),
)


def summarize_checks(checks: DataFrame) -> DataFrame:
    """run_id, evidence and status of each run (run_id, test_name, status). Skipped checks count for nothing; a run without
    other checks has no evidence."""
    counted = F.col("status") != "skipped"
    row = checks.groupBy("run_id").agg(
        F.collect_set(F.when(counted, F.col("test_name"))).alias("names"),
        F.count(F.when(counted, 1)).alias("n"),
        F.count(F.when(counted & (F.col("status") != "passed"), 1)).alias("not_passed"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failed"),
    )
    proven = F.lit(False)
    for names in PROOFS:
        proven = proven | F.forall(F.array(*map(F.lit, names)), lambda n: F.array_contains("names", n))
    evidence = F.when((F.col("n") == 0) | (F.col("not_passed") > 0), "none").when(proven, "empirically_validated").otherwise("aggregates")
    return row.select("run_id", evidence.alias("evidence"), F.when(F.col("failed") > 0, "failed").otherwise("passed").alias("status"))


def profile_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """column_name, null_count, distinct_count and is_unique of each column, in one pass over the data."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.count(F.when(F.col(c).isNull(), 1)).alias("null_count"), F.count_distinct(F.col(c)).alias("distinct_count"), F.count(F.lit(1)).alias("rows")) for c in cols]
    table = df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    return table.select("column_name", "null_count", "distinct_count", ((F.col("null_count") == 0) & (F.col("distinct_count") == F.col("rows"))).alias("is_unique"))


#: Relative error of a distinct count beyond which a column counts as not unique, several times that of the sketches (1.6 %).
NEAR = 0.08


def key_sketches(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """by, column_name, rows, nulls and sketch: a HyperLogLog sketch of each column for each partition of the data (columns ``by``).
    Sketches of partitions that don't change can be kept and merged with those of new ones."""
    groups = by or []
    one = [F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(c).isNull(), 1)).alias("nulls"), F.hll_sketch_agg(F.col(c).cast("string"), F.lit(12)).alias("sketch")) for c in cols]
    return df.groupBy(*groups).agg(F.array(*one).alias("__p")).select(*groups, F.inline("__p"))


def merged_profile(sketches: DataFrame) -> DataFrame:
    """column_name, rows, nulls and estimate of each column, from the sketches of all partitions."""
    row = sketches.groupBy("column_name").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("sketch").alias("s"))
    return row.select("column_name", "rows", "nulls", F.hll_sketch_estimate("s").alias("estimate"))


def unique_columns(df: DataFrame, cols: list[str], sketches: DataFrame | None = None) -> DataFrame:
    """column_name, null_count, near_unique and is_unique, in one pass of sketches; only columns without nulls whose estimate comes near
    the number of rows are then counted exactly."""
    spark = df.sparkSession
    rough = merged_profile(key_sketches(df, cols) if sketches is None else sketches).collect()  # a row for each column
    near = [r.column_name for r in rough if r.nulls == 0 and r.estimate >= (1 - NEAR) * r.rows]
    exact = set()
    if near:
        sure = df.agg(*[(F.count_distinct(F.col(c)) == F.count(F.lit(1))).alias(c) for c in near]).first()
        exact = {c for c in near if sure[c]}
    rows = [(r.column_name, r.nulls, r.column_name in near, r.column_name in exact) for r in rough]
    return spark.createDataFrame(rows, "column_name string, null_count long, near_unique boolean, is_unique boolean")
