"""Work tables of one run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that driver and executors share. Where it is unset a local session, as in tests, gets a
    folder of its own; on a cluster that is an error, as executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("SHARED_FOLDER_UNSET: spark.checkpoint.dir names the folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df computed and kept in the shared folder, so that it outlives the work tables it was read from; Spark's
    cleaner removes it where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


class Workspace:
    """``with Workspace(spark) as ws: df = ws.put("keys", df)``: tables in a folder of this run, removed at the end,
    after success and failure alike. Removal is tried three times; if it fails, so does the run."""

    def __init__(self, spark: SparkSession, base: str | None = None, run_id: str | None = None, attempts: int = 3) -> None:
        self.spark, self.attempts = spark, attempts
        self.path = f"{(base or shared_base(spark)).rstrip('/')}/run-{run_id or uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        self._remove(f"{self.path}/{name}")

    def _remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for _ in range(self.attempts):
            if not fs.exists(path) or fs.delete(path, True):
                return
        raise OSError(f"CLEANUP_FAILED: {folder}")

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *error: object) -> None:
        self._remove(self.path)
