"""Repair of marts by replacing the rows of affected keys, and the decisions around it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import union_all
from .compare import compare_by_buckets, compare_tables, count_of, one_row

#: Fixed value: percent of entities from which a rebuild is recommended.
REBUILD_PERCENT = 75


def rows_to_replace(mart: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return mart.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_semi")


def repaired(mart: DataFrame, head: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The mart without the rows of the keys, and the recomputed rows. Rows with a null key stay."""
    kept = mart.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_anti")
    return union_all(kept, head.select(*mart.columns))


def verify_baseline(mart: DataFrame, old: DataFrame, key: str, pinned: Column | None = None) -> DataFrame:
    """Does the existing mart equal the full old result? MATCHED, MISMATCHED or, unpinned or misaligned, FAILED."""
    counts = compare_by_buckets(mart, old, key)
    failed = (F.col("reason") == "SCHEMA_MISALIGNED") | ~(pinned if pinned is not None else F.lit(True))
    return counts.withColumn("status", F.when(F.coalesce(failed, F.lit(False)), "FAILED").when(F.col("reason").isNull(), "MATCHED").otherwise("MISMATCHED"))


def validate_repair(mart: DataFrame, head_full: DataFrame, head: DataFrame, keys: DataFrame, key: str, certified: bool = True, confirmed: bool = True, baseline: str = "MATCHED") -> DataFrame:
    """Repair a copy and compare it with the full new result; refused unless certified, confirmed and on a matched baseline."""
    if not (certified and confirmed and baseline == "MATCHED"):
        reason = "NOT_CERTIFIED" if not certified else "NOT_CONFIRMED" if not confirmed else "BASELINE_NOT_MATCHED"
        return mart.sparkSession.createDataFrame([("FAILED", reason, None, None, None, None, None, None)], "status string, reason string, deleted_rows long, inserted_rows long, missing_rows long, extra_rows long, mismatched_rows long, duplicate_keys long")
    counts = one_row(count_of(rows_to_replace(mart, keys, key), "deleted_rows"), count_of(head, "inserted_rows"), compare_tables(repaired(mart, head, keys, key), head_full, key))
    status = F.when(F.col("reason").isNull(), "SUCCEEDED").otherwise("FAILED").alias("status")
    return counts.select(status, "reason", "deleted_rows", "inserted_rows", "missing_rows", "extra_rows", "mismatched_rows", "duplicate_keys")


def recommend_rebuild(candidates: Column, full: Column, percent: int = REBUILD_PERCENT) -> Column:
    return F.coalesce((full > 0) & (candidates * 100 >= full * percent), F.lit(False))


def apply_repair(spark: SparkSession, mart_path: str, head: DataFrame, keys: DataFrame, key: str) -> str:
    """Write the repaired mart beside the old one and swap the folders; Spark cannot overwrite what it reads. Returns the old
    mart's folder. Needs a file system whose rename is atomic; on table formats use MERGE or replaceWhere instead."""
    fresh, old = (f"{mart_path.rstrip('/')}__{tag}_{uuid.uuid4().hex}" for tag in ("new", "old"))
    repaired(spark.read.parquet(mart_path), head, keys, key).write.parquet(fresh)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(mart_path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not (fs.rename(path(mart_path), path(old)) and fs.rename(path(fresh), path(mart_path))):
        raise OSError(f"the swap of {mart_path} failed; the repaired mart is at {fresh}")
    return old


class PartitionedMart:
    """A mart stored in ``parts`` partitions by the hash of its key. A repair rewrites only those that hold a key of it.

    The new content of the touched partitions is first written whole to a stage beside the mart; it counts as soon as its
    ``_SUCCESS`` file is there. Then it takes the place of those partitions by dynamic partition overwrite. A repair that dies
    before the stage is complete has changed nothing; one that dies later is finished by ``resume``, which can be repeated. ``repair``
    calls it first. One repair at a time.
    """

    PART = "__part"

    def __init__(self, spark: SparkSession, path: str, key: str, parts: int = 256) -> None:
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts
        self.stage = f"{self.path}__stage"

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        fs, path = self._fs(name)
        return fs.exists(path)

    def _drop(self, name: str) -> None:
        fs, path = self._fs(name)
        fs.delete(path, True)

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.PART, F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int"))

    def _type(self):
        return self.spark.read.parquet(self.path).schema[self.key].dataType

    def create(self, mart: DataFrame) -> None:
        self._placed(mart).repartition(self.PART).write.partitionBy(self.PART).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(self.PART)

    def repair(self, head: DataFrame, keys: DataFrame) -> list[int]:
        """Replace the rows of the keys by head; gives the numbers of the partitions that were written."""
        self.resume()
        stored = self.spark.read.parquet(self.path)
        keys = self._placed(keys.select(F.col(keys.columns[0]).cast(self._type()).alias(self.key)).where(F.col(self.key).isNotNull()).distinct())
        head = self._placed(head.select(*[F.col(c).cast(stored.schema[c].dataType) for c in stored.columns if c != self.PART]))
        touched = sorted(r[0] for r in union_all(keys.select(self.PART), head.select(self.PART)).distinct().collect())  # at most ``parts`` numbers
        if not touched:
            return []
        rest = stored.where(F.col(self.PART).isin(touched)).join(keys.select(self.key), self.key, "left_anti")
        self._drop(self.stage)
        self.spark.createDataFrame([(n,) for n in touched], "part int").coalesce(1).write.parquet(f"{self.stage}/touched")
        union_all(rest.select(*stored.columns), head.select(*stored.columns)).repartition(self.PART).write.partitionBy(self.PART).parquet(f"{self.stage}/rows")
        self.resume()
        return touched

    def resume(self) -> bool:
        """Finish a repair whose stage is complete, drop one that is not. Was there one to finish?"""
        if not self._exists(f"{self.stage}/rows/_SUCCESS"):
            self._drop(self.stage)
            return False
        touched = [r[0] for r in self.spark.read.parquet(f"{self.stage}/touched").collect()]
        full = [n for n in touched if self._exists(f"{self.stage}/rows/{self.PART}={n}")]
        if full:
            rows = self.spark.read.option("basePath", f"{self.stage}/rows").parquet(*[f"{self.stage}/rows/{self.PART}={n}" for n in full])
            rows.repartition(self.PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.PART).parquet(self.path)
        for n in set(touched) - set(full):  # all their rows went
            self._drop(f"{self.path}/{self.PART}={n}")
        self._drop(self.stage)
        return True


def economics(jobs: DataFrame, full: DataFrame) -> DataFrame:
    """Cost of each run and its decision.

    jobs: run_id, phase, elapsed_ms, bytes_scanned, total_bytes_processed. full: run_id, full_bytes, full_elapsed_ms,
    credits, full_credits. Phases of full-reference validation are no part of the targeted cost. Credits on both sides decide;
    else bytes and time of both sides, and the targeted path must be lower in both; bytes alone decide nothing.
    """
    apart = F.lower("phase").rlike("full head|complete head|full comparison|full reference")
    counted = F.coalesce(F.col("phase"), F.lit("")) != ""
    kept = jobs.where(counted & ~apart).groupBy("run_id").agg(F.sum(F.coalesce("total_bytes_processed", "bytes_scanned")).alias("targeted_bytes"), F.sum("elapsed_ms").alias("targeted_elapsed_ms"))
    row = full.join(kept, "run_id", "left")
    credits = F.col("credits").isNotNull() & F.col("full_credits").isNotNull()
    some_bytes = F.col("targeted_bytes").isNotNull() & F.col("full_bytes").isNotNull()
    both = some_bytes & F.col("targeted_elapsed_ms").isNotNull() & F.col("full_elapsed_ms").isNotNull()
    lower = (F.col("targeted_bytes") < F.col("full_bytes")) & (F.col("targeted_elapsed_ms") < F.col("full_elapsed_ms"))
    pick = lambda cheaper: F.when(cheaper, "TARGETED_REPAIR_RECOMMENDED").otherwise("FULL_REBUILD_RECOMMENDED")
    decision = F.when(credits, pick(F.col("credits") < F.col("full_credits"))).when(both, pick(lower)).otherwise("NOT_EVALUATED")
    basis = F.when(credits, "CREDITS").when(some_bytes, "BYTES_AND_TIME").otherwise("NONE")
    return row.select("run_id", "targeted_bytes", "full_bytes", "targeted_elapsed_ms", "full_elapsed_ms", basis.alias("basis"), decision.alias("decision"))


def shows_reduction(full: dict[str, Column], targeted: dict[str, Column]) -> Column:
    """Is any measure strictly smaller on the targeted side?"""
    out = F.lit(False)
    for name in ("bytes_scanned", "total_bytes_processed", "partitions_scanned", "rows_produced"):
        if name in full and name in targeted:
            out = out | F.coalesce(targeted[name] < full[name], F.lit(False))
    return out


def certification(pinned: Column, static: Column, contract: Column) -> Column:
    return F.when(~F.coalesce(pinned, F.lit(False)), "UNCERTIFIED").when(static, "SQL_CERTIFIED").when(contract, "CONTRACT_CERTIFIED").otherwise("UNCERTIFIED")


def assessment(runs: DataFrame) -> DataFrame:
    """Four independent dimensions of each run, from its flags and figures."""
    c = F.col
    economic = F.when(c("rebuild_recommended"), "FULL_REBUILD_RECOMMENDED").when(c("frontier_bytes").isNull() | c("full_bytes").isNull(), "NOT_EVALUATED").when(c("frontier_bytes") >= c("full_bytes"), "FULL_REBUILD_RECOMMENDED").when(c("credits").isNull(), "NOT_EVALUATED").otherwise("TARGETED_REPAIR_RECOMMENDED")
    valid = F.when(c("reference_validated"), "FULL_REFERENCE_VALIDATED").when(c("reference_failed") | c("confirmation_failed"), "FAILED").when(c("candidates_confirmed"), "CANDIDATES_CONFIRMED").otherwise("NOT_RUN")
    ran = F.when(c("execution_failed"), "FAILED").when(c("execution_ran"), "SUCCEEDED").otherwise("PENDING")
    return runs.select("*", certification(c("pinned"), c("static_certified"), c("contract_certified")).alias("certification"), valid.alias("validation"), economic.alias("economics"), ran.alias("execution"))


def safe_to_apply(runs: DataFrame) -> Column:
    """In-place repair is safe only if every single condition holds; an unknown one does not."""
    c = F.col
    parts = [
        c("certification").isin("SQL_CERTIFIED", "CONTRACT_CERTIFIED"), c("validation").isin("CANDIDATES_CONFIRMED", "FULL_REFERENCE_VALIDATED"), c("pinned"),
        c("baseline") == "MATCHED", c("repair") == "SUCCEEDED", c("missing_rows") == 0, c("extra_rows") == 0, c("mismatched_rows") == 0, c("duplicate_keys") == 0,
        c("deleted_rows").isNotNull(), c("inserted_rows").isNotNull(), c("cleaned"), ~c("execution_failed"),
    ]
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(p, F.lit(False))
    return out


def overlay_repair(proofs: DataFrame) -> DataFrame:
    """Counts of the disposable repair in place of the mart's own, where a repair succeeded or failed; unknown stays null."""
    ran = F.coalesce(F.col("repair").isin("SUCCEEDED", "FAILED"), F.lit(False))
    zero = F.coalesce((F.col("repair") == "SUCCEEDED") & (F.col("missing_rows") == 0) & (F.col("extra_rows") == 0) & (F.col("mismatched_rows") == 0) & (F.coalesce("duplicate_keys", F.lit(0)) == 0) & F.col("cleaned"), F.lit(False))
    out = [F.when(ran, F.col(f"{n}_rows")).otherwise(F.col(f"proof_{n}")).alias(f"{n}_result") for n in ("missing", "extra", "mismatched")]
    return proofs.select("*", *out, F.when(ran, zero).otherwise(F.col("proof_validated")).alias("reference_validated"))
