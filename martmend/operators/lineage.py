"""Lineage closures, catalog differences and routes along shared columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import union_all
from ..functions.scalars import text_fingerprint
from .workspace import Workspace, settled


#: Pairs of a level of shortcuts, for each edge, beyond which no longer shortcuts are made.
GROWTH = 4
#: Tables of found nodes after which they are made one.
TABLES = 8
#: Rows of a partition where a task holds a hash table of them: a file of a few MB may have millions of rows.
ROWS = 100_000


def reach(edges: DataFrame, seeds: DataFrame, rounds: list | None = None) -> DataFrame:
    """seeds (node, and any other columns as a tag) with each node reachable from them over edges (parent, child), by tag.

    Path doubling: level k holds the pairs that are 2**k steps apart, and made from level k - 1; what is reached within fewer than 2**k
    steps, joined to it, gives what is reached within fewer than 2**(k + 1). So a path of n steps takes about log2(n) rounds. In
    graphs with very many paths a level may become much larger than the edges; then no further one is made, and each round goes
    on by the steps of the last one from the nodes that the round before found. What the rounds found is kept in at most ``TABLES``
    tables, which are then made one. ``rounds`` gets a number for each round.
    """
    spark = edges.sparkSession
    tag = [c for c in seeds.columns if c != "node"]
    with Workspace(spark) as work:
        level = work.put("level-0", edges.select(F.col("parent").alias("node"), F.col("child").alias("next")).where("node is not null and next is not null").distinct())
        most = GROWTH * level.count()
        start = work.put("seeds", seeds.select(*tag, "node").where("node is not null").distinct())
        nothing = spark.createDataFrame([], T.StructType([start.schema[c] for c in start.columns[:-1]] + [T.StructField("node", level.schema["next"].dataType)]))
        found, from_, doubling, k, tables = nothing, start, True, 0, []
        while True:
            following = from_.join(level, "node").select(*tag, F.col("next").alias("node")).distinct()
            fresh = work.put(f"fresh-{k}", following.join(found, [*tag, "node"], "left_anti"))
            if rounds is not None:
                rounds.append(k)
            if fresh.isEmpty():
                break
            tables.append(f"{work.path}/fresh-{k}")
            found = spark.read.schema(fresh.schema).parquet(*tables)
            if len(tables) > TABLES:
                found, tables = work.put(f"found-{k}", found), [f"{work.path}/found-{k}"]
            if doubling:
                ahead = level.join(level.select(F.col("node").alias("next"), F.col("next").alias("end")), "next").select("node", F.col("end").alias("next")).distinct()
                longer = work.put(f"level-{k + 1}", ahead)
                doubling = longer.count() <= most
                level = longer if doubling else level
            # Nodes nearer than the steps of the level that comes next; without a further one, those that are new.
            from_ = union_all(start.select(*tag, "node"), found) if doubling else fresh
            k += 1
        return settled(found)


def closure(edges: DataFrame, start: list[str], direction: str = "down", rounds: list | None = None) -> DataFrame:
    """node: all nodes reachable from start over edges (parent, child), start itself left out unless on a cycle."""
    steps = edges if direction == "down" else edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    seeds = edges.sparkSession.createDataFrame([(n,) for n in start], T.StructType([T.StructField("node", edges.schema["parent"].dataType)]))
    return reach(steps, seeds, rounds)


def descendants(edges: DataFrame, of: DataFrame | None = None, rounds: list | None = None) -> DataFrame:
    """(ancestor, node) for every pair, or those whose ancestor is in ``of``, for any graph; on a cycle a node is its own descendant."""
    of = edges.select("parent") if of is None else of
    name = F.col(of.columns[0])
    return reach(edges, of.select(name.alias("ancestor"), name.alias("node")), rounds)


def catalog_fingerprint(df: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """One hash over all pairs of key and fingerprint, in order. A catalog has as many rows as there are definitions."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.col(fingerprint).alias("fingerprint"))))
    return df.agg(F.sha2(F.to_json(pairs), 256).alias("catalog_fingerprint"))


def catalog_diff(base: DataFrame, head: DataFrame, key: str, text: str, edges: DataFrame | None = None) -> DataFrame:
    """key and change (added, removed, modified) of definitions whose texts differ in more than layout; with edges, the sorted
    names downstream of each."""
    a = base.select(F.col(key).alias("k_a"), text_fingerprint(F.col(text)).alias("fa"))
    b = head.select(F.col(key).alias("k_b"), text_fingerprint(F.col(text)).alias("fb"))
    met = a.join(b, F.col("k_a") == F.col("k_b"), "full_outer")
    change = F.when(F.col("k_a").isNull(), "added").when(F.col("k_b").isNull(), "removed").when(~F.col("fa").eqNullSafe(F.col("fb")), "modified")
    out = met.select(F.coalesce("k_a", "k_b").alias(key), change.alias("change")).where("change is not null")
    if edges is None:
        return out
    below = descendants(edges, out.select(key)).withColumnRenamed("ancestor", key).groupBy(key).agg(F.sort_array(F.collect_set("node")).alias("downstream"))
    return out.join(below, key, "left").withColumn("downstream", F.coalesce("downstream", F.array().cast("array<string>")))


def derive_routes(columns: DataFrame, edges: DataFrame, unique: DataFrame, key: str) -> DataFrame:
    """upstream, downstream, status, join_column of each lineage edge.

    columns: table_name, column_name. unique: the same for columns whose values are unique. One shared unique column is
    VERIFIED, several are AMBIGUOUS, none is UNRESOLVED; the mart's key wins where both tables have it. An edge of a table without
    columns is INVALID.

    All tables are dealt out by key into partitions of about ``ROWS`` rows before anything is grouped or joined, so what a task
    holds does not grow with them.
    """
    n = -(-max(columns.count(), edges.count(), 1) // ROWS)
    columns, edges, unique = columns.repartition(n, "table_name"), edges.repartition(n, "parent", "child"), unique.repartition(n, "column_name")
    up = columns.select(F.col("table_name").alias("parent"), "column_name")
    down = columns.select(F.col("table_name").alias("child"), "column_name")
    shared = edges.join(up, "parent").join(down, ["child", "column_name"])
    keyed = unique.select(F.col("table_name").alias("t"), F.col("column_name").alias("c"))
    good = shared.join(keyed, (F.col("c") == F.col("column_name")) & ((F.col("t") == F.col("parent")) | (F.col("t") == F.col("child"))), "left_semi")
    found = good.repartition(n, "parent", "child").groupBy("parent", "child").agg(F.sort_array(F.collect_set("column_name")).alias("cols"))
    row = edges.join(found, ["parent", "child"], "left").withColumn("cols", F.coalesce("cols", F.array().cast("array<string>")))
    single = F.when(F.array_contains("cols", key), F.lit(key)).when(F.size("cols") == 1, F.get("cols", 0))
    known = columns.select("table_name").distinct()
    for c in ("parent", "child"):
        row = row.join(known.select(F.col("table_name").alias(c), F.lit(True).alias(f"{c}_known")), c, "left")
    invalid = F.col("parent_known").isNull() | F.col("child_known").isNull()
    status = F.when(invalid, "INVALID").when(single.isNotNull(), "VERIFIED").when(F.size("cols") > 1, "AMBIGUOUS").otherwise("UNRESOLVED")
    return row.select(F.col("parent").alias("upstream"), F.col("child").alias("downstream"), status.alias("status"), single.alias("join_column"))


def derive_chains(routes: DataFrame, target: str) -> DataFrame:
    """upstream, status, route ("a -> b -> c") and join_columns for each table above target, from the edges of ``derive_routes``.

    The route is the shortest chain of hops whose columns are known; VERIFIED if there is one and each hop is, AMBIGUOUS if there
    are several or a hop is. Tables that no chain reaches are INVALID if all of their edges are, or else UNRESOLVED. Each
    round goes one hop up from the tables that the round before reached, so cycles end."""
    spark = routes.sparkSession
    with Workspace(spark) as work:
        routes = work.put("routes", routes)
        hops = routes.where("status in ('VERIFIED', 'AMBIGUOUS')").select(F.col("upstream").alias("up"), F.col("downstream").alias("node"), (F.col("status") == "AMBIGUOUS").alias("open"), F.coalesce("join_column", F.lit("?")).alias("c"))
        start = spark.createDataFrame([(target, target, "", False)], "node string, route string, join_columns string, several boolean")
        fresh = found = work.put("0", start)
        rounds = 1
        while not fresh.isEmpty():
            chain = fresh.join(hops, "node").select("up", F.concat_ws(" -> ", "up", "route").alias("route"), F.concat_ws(", ", "c", F.nullif("join_columns", F.lit(""))).alias("join_columns"), (F.col("several") | F.col("open")).alias("several"))
            least = F.struct("route", "join_columns")
            one = chain.groupBy(F.col("up").alias("node")).agg(F.min(least).alias("r"), (F.max("several") | (F.count(F.lit(1)) > 1)).alias("several"))
            fresh = work.put(f"fresh-{rounds}", one.select("node", "r.route", "r.join_columns", "several").join(found.select("node"), "node", "left_anti"))
            found = work.put(str(rounds), union_all(found, fresh))
            rounds += 1
        edges = routes.select(F.col("upstream").alias("parent"), F.col("downstream").alias("child"))
        above = closure(edges, [target], "up").where(F.col("node") != target)
        invalid = routes.groupBy(F.col("upstream").alias("node")).agg(F.min(F.col("status") == "INVALID").alias("invalid"))
        status = F.when(F.col("route").isNull(), F.when(F.col("invalid"), "INVALID").otherwise("UNRESOLVED")).when(F.col("several"), "AMBIGUOUS").otherwise("VERIFIED")
        return settled(above.join(found, "node", "left").join(invalid, "node", "left").select(F.col("node").alias("upstream"), status.alias("status"), "route", "join_columns"))


def route_text(hops: tuple[tuple[str, str], ...]) -> str:
    return " -> ".join(f"{t}.{c}" for t, c in hops)
