"""Union of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*frames: DataFrame, by_name: bool = True) -> DataFrame:
    """All rows of all tables.

    Spark 4.1 lets a union keep its inputs' partitioning. When adaptive execution coalesces the inputs differently, that
    fails ("can't zip RDDs") or groups wrongly afterwards, so it is turned off in the session.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(lambda a, b: a.unionByName(b) if by_name else a.union(b), frames)
