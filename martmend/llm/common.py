"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset a local session, as in tests, gets a new one;
    on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("SHARED_FOLDER_UNSET: spark.checkpoint.dir names the folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind. Else they stay on the executors' disks until the driver happens to collect its
    garbage; what is written is read from its table from then on, so nobody needs them."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, held)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again, so later failures recompute nothing above it."""
    path = new_folder(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.written_at = path
    return written


def dropped(spark: SparkSession, what: DataFrame | str) -> None:
    """Delete a folder below the shared one, or the table that ``cut`` wrote, when nothing will read it again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(what if isinstance(what, str) else what.written_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def union(a: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows. Spark 4.1's unions that keep their inputs' partitioning fail when adaptive execution coalesces these differently, so that is turned off."""
    a.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    for b in more:
        a = a.unionByName(b)
    return a


def let(value, body):
    """body(value) with value computed once: higher-order functions are interpreted, without sharing of subexpressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
