"""All registered queries of the library, each with the SQL that checks it.

Every query reads the given tables whole; feeds, events and runs that the tables lack are derived from them by rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import leaks, scalars
from .operators import checks, compare, keys, lineage, repair
from .operators.workspace import Workspace, settled
from .plans import cover, spec
from .sources import files
from .streaming import batchlog, cdc

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


class Tables(dict):
    """The Parquet tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__()
        self.spark, self.path = spark, path

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self[name]


def sources(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    t = Tables(spark, path)
    return {n: t[n] for n in names}


# ---------------------------------------------------------------- marts
CENTS = "cast(coalesce(sum(cast(round(o_totalprice * 100) as bigint)), 0) as bigint)"
AGGREGATES = (("n_orders", "count(o_orderkey)"), ("total_cents", CENTS))
BY_CUSTOMER = (("c_custkey", "o_custkey"),)


def left_mart(predicate: str) -> spec.MartSpec:
    return spec.MartSpec("customer", "c_custkey", AGGREGATES, (spec.Join("orders", BY_CUSTOMER, "left"),), (("orders", predicate),))


def inner_mart(predicate: str) -> spec.MartSpec:
    return spec.MartSpec("customer", "c_custkey", AGGREGATES, (spec.Join("orders", BY_CUSTOMER, "inner"),), (("orders", predicate),))


def two_join_mart(predicate: str) -> spec.MartSpec:
    joins = (spec.Join("orders", BY_CUSTOMER, "left"), spec.Join("nation", (("c_nationkey", "n_nationkey"),), "inner"))
    return spec.MartSpec("customer", "c_custkey", (*AGGREGATES, ("nation", "max(n_name)")), joins, (("orders", predicate),))


_SECRET = "not a secret"
_IPAD, _OPAD = (bytes(b ^ x for b in _SECRET.encode().ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
OLD, NEW = "o_totalprice >= 200000", "o_totalprice >= 205000"
VANISH_OLD, VANISH_NEW = "o_totalprice >= 450000", "o_totalprice >= 455000"
#: SQL of a mart for a predicate, written without the library's shape: a grouped subquery, joined afterwards.
_G = "(select o_custkey as k, count(*) as n, sum(cast(round(o_totalprice * 100) as bigint)) as s from orders where {p} group by 1)"
LEFT_SQL = "(select c_custkey, coalesce(n, 0)::bigint as n_orders, coalesce(s, 0)::bigint as total_cents from customer left join " + _G + " g on k = c_custkey)"
INNER_SQL = "(select k as c_custkey, n::bigint as n_orders, s::bigint as total_cents from " + _G + " g where exists (select 1 from customer where c_custkey = k))"
L_OLD, L_NEW, I_OLD, I_NEW = LEFT_SQL.format(p=OLD), LEFT_SQL.format(p=NEW), INNER_SQL.format(p=VANISH_OLD), INNER_SQL.format(p=VANISH_NEW)
#: Keys whose rows differ, from two marts compared key by key.
CHANGED_SQL = "(select coalesce(a.c_custkey, b.c_custkey) as c_custkey from {a} a full join {b} b on a.c_custkey = b.c_custkey where a.n_orders is distinct from b.n_orders or a.total_cents is distinct from b.total_cents)"
L_CHANGED, I_CHANGED = CHANGED_SQL.format(a=L_OLD, b=L_NEW), CHANGED_SQL.format(a=I_OLD, b=I_NEW)
#: Candidates of the left mart, by EXISTS on a flipped order.
L_CANDIDATES = "(select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and (o_totalprice >= 200000) <> (o_totalprice >= 205000)))"


def _left(spark: SparkSession, path: str):
    src = sources(spark, path, "customer", "orders")
    found = cover.candidate_keys(left_mart(OLD), left_mart(NEW), src)
    return src, found.keys, spec.build_mart(left_mart(OLD), src), spec.build_mart(left_mart(NEW), src)


def flagship(spark: SparkSession, path: str) -> DataFrame:
    """Candidate keys of a changed filter, and whether the recomputed rows of each really differ."""
    src, found, _, _ = _left(spark, path)
    before, after = (spec.targeted(left_mart(p), src, found) for p in (OLD, NEW))
    real = compare.confirmed_keys(before, after, "c_custkey").withColumn("hit", F.lit(True))
    return found.join(real, "c_custkey", "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("really_changed"))


query(f"select c.c_custkey, exists (select 1 from {L_CHANGED} x where x.c_custkey = c.c_custkey) as really_changed from {L_CANDIDATES} c")(flagship)


@query(f"select * from {L_OLD}")
def mart_left(spark, path):
    return spec.build_mart(left_mart(OLD), sources(spark, path, "customer", "orders"))


@query(f"select * from {INNER_SQL.format(p=OLD)}")
def mart_inner(spark, path):
    return spec.build_mart(inner_mart(OLD), sources(spark, path, "customer", "orders"))


@query(f"select m.*, (select n_name from nation, customer c where n_nationkey = c.c_nationkey and c.c_custkey = m.c_custkey) as nation from {L_OLD} m")
def mart_two_joins(spark, path):
    return spec.build_mart(two_join_mart(OLD), sources(spark, path, "customer", "orders", "nation"))


# ---------------------------------------------------------------- flips and covers
@query("select o_orderkey, o_custkey from orders where (o_totalprice >= 200000) <> (o_totalprice >= 205000)")
def flip_rows(spark, path):
    return cover.flip_rows(Tables(spark, path)["orders"], OLD, NEW).select("o_orderkey", "o_custkey")


@query("select o_orderkey from orders where case when o_custkey % 7 = 0 then false else o_orderstatus = 'F' end <> case when o_custkey % 7 = 0 then false else o_orderstatus in ('F', 'O') end")
def flip_null_pred(spark, path):
    orders = Tables(spark, path)["orders"].withColumn("status", F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderstatus")))
    return cover.flip_rows(orders, "status = 'F'", "status in ('F', 'O')").select("o_orderkey")


@query("select sum(n)::bigint as source_rows, count(*)::bigint as candidate_keys from (select o_custkey, count(*) as n from orders where o_totalprice >= 200000 and o_totalprice < 205000 group by 1)")
def discovery_counts(spark, path):
    return cover.discovery_counts(cover.flip_rows(Tables(spark, path)["orders"], OLD, NEW), "o_custkey")


def _flipped(spark, path):
    return cover.flip_rows(Tables(spark, path)["orders"], OLD, NEW)


@query("select distinct o_custkey as c_custkey from orders where o_totalprice >= 200000 and o_totalprice < 205000 and o_custkey in (select c_custkey from customer)")
def cover_inner_right(spark, path):
    return cover.terminal_keys(cover.cover_inner(_flipped(spark, path), Tables(spark, path)["customer"], BY_CUSTOMER, "right"), "c_custkey")


@query("select distinct o_orderkey from orders join customer on c_custkey = o_custkey where (c_acctbal > 0) <> (c_acctbal > 1000)")
def cover_inner_left(spark, path):
    t = Tables(spark, path)
    flipped = cover.flip_rows(t["customer"], "c_acctbal > 0", "c_acctbal > 1000")
    return cover.terminal_keys(cover.cover_inner(flipped, t["orders"], BY_CUSTOMER), "o_orderkey")


@query("select c_custkey from customer where c_acctbal > 0 and c_acctbal <= 1000")
def cover_left_left(spark, path):
    t = Tables(spark, path)
    flipped = cover.cover_project(cover.flip_rows(t["customer"], "c_acctbal > 0", "c_acctbal > 1000"), {"c_custkey": "c_custkey", "c_name": "name"})
    return cover.terminal_keys(cover.cover_filter(cover.cover_left_from_left(flipped, t["orders"], BY_CUSTOMER)), "c_custkey")


@query(f"select * from {L_CANDIDATES}")
def cover_left_right(spark, path):
    t = Tables(spark, path)
    rows = cover.cover_left_from_right(t["customer"], _flipped(spark, path), t["orders"].where(OLD), t["orders"].where(NEW), BY_CUSTOMER)
    return cover.terminal_keys(rows, "c_custkey")


@query(f"select distinct n_nationkey from nation join customer c on c_nationkey = n_nationkey join {L_CANDIDATES} x on x.c_custkey = c.c_custkey")
def cover_then_join(spark, path):
    t = Tables(spark, path)
    rows = cover.cover_left_from_right(t["customer"], _flipped(spark, path), t["orders"].where(OLD), t["orders"].where(NEW), BY_CUSTOMER)
    return cover.terminal_keys(cover.cover_inner(rows, t["nation"], (("c_nationkey", "n_nationkey"),)), "n_nationkey")


@query(f"select * from {L_CANDIDATES}")
def candidates(spark, path):
    return _left(spark, path)[1]


@query(f"select c_custkey from {L_CHANGED} where c_custkey not in (select c_custkey from {L_CANDIDATES})")
def candidates_missing(spark, path):
    _, found, before, after = _left(spark, path)
    return compare.missing_keys(compare.changed_keys(before, after, "c_custkey"), found)


@query(f"select c_custkey from {L_CANDIDATES} where c_custkey not in (select c_custkey from {L_CHANGED})")
def candidates_extra(spark, path):
    _, found, before, after = _left(spark, path)
    return compare.extra_keys(found, compare.changed_keys(before, after, "c_custkey"))


@query(f"select (select count(*) from customer) as before_entities, (select count(*) from customer) as after_entities, (select count(*) from {L_CANDIDATES}) as candidates, (select count(*) from {L_CHANGED}) as changed, 0::bigint as missing, (select count(*) from {L_CANDIDATES}) - (select count(*) from {L_CHANGED}) as extra, 0::bigint as mismatched_rows, true as passed")
def change_proof(spark, path):
    src, found, before, after = _left(spark, path)
    with Workspace(spark) as work:
        found = work.put("keys", found)
        head = work.put("head", spec.targeted(left_mart(NEW), src, found))
        return settled(compare.change_proof(before, after, found, head, "c_custkey"))


@query(f"select (select count(*) from {I_OLD}) as before_entities, (select count(*) from {I_NEW}) as after_entities, count(*)::bigint as candidates, count(*)::bigint as changed, 0::bigint as missing, 0::bigint as extra, 0::bigint as mismatched_rows, true as passed from {I_CHANGED}")
def mutation_proof(spark, path):
    src = sources(spark, path, "customer", "orders")
    before, after = (spec.build_mart(inner_mart(p), src) for p in (VANISH_OLD, VANISH_NEW))
    with Workspace(spark) as work:
        found = work.put("keys", cover.candidate_keys(inner_mart(VANISH_OLD), inner_mart(VANISH_NEW), src).keys)
        head = work.put("head", spec.targeted(inner_mart(VANISH_NEW), src, found))
        return settled(compare.mutation_proof(before, after, found, head, "c_custkey"))


# ---------------------------------------------------------------- other changes
@query("select l_orderkey, l_linenumber from lineitem where round(l_discount * 100) > 4 or (l_quantity > 25 and l_returnflag <> 'R')")
def expr_diff(spark, path):
    li = Tables(spark, path)["lineitem"]
    pairs = [("least(round(l_discount * 100), 4)", "round(l_discount * 100)"), ("l_returnflag", "case when l_quantity > 25 then 'R' else l_returnflag end")]
    return cover.changed_expr_rows(li, pairs).select("l_orderkey", "l_linenumber")


@query("select o_orderkey from orders where o_totalprice >= 100000 and o_totalprice < 150000")
def case_diff(spark, path):
    pair = [("case when o_totalprice >= 150000 then 'big' else 'small' end", "case when o_totalprice >= 100000 then 'big' else 'small' end")]
    return cover.changed_expr_rows(Tables(spark, path)["orders"], pair).select("o_orderkey")


@query("select distinct l_orderkey from lineitem where round(l_discount * 100) <> 0")
def agg_input_diff(spark, path):
    pair = [("round(l_extendedprice * 100)", "round(l_extendedprice * 100) * (100 - round(l_discount * 100)) / 100")]
    return cover.terminal_keys(cover.changed_agg_input_rows(Tables(spark, path)["lineitem"], pair), "l_orderkey")


@query("select o_custkey from orders group by 1 having max(o_totalprice) is distinct from min(o_totalprice)")
def agg_func_diff(spark, path):
    return cover.changed_agg_keys(Tables(spark, path)["orders"], "o_custkey", "max(o_totalprice)", "min(o_totalprice)")


@query("select o_custkey from orders group by 1 having count(*) in (9, 10)")
def having_flip(spark, path):
    return cover.having_flip_keys(Tables(spark, path)["orders"], "o_custkey", {"n": "count(*)"}, "n > 10", "n > 8")


@query("select distinct o_custkey from (select o_custkey, o_orderkey, n_nationkey from orders, nation where n_nationkey = o_custkey % 25 and not n_nationkey = o_orderkey % 25 union all select o_custkey, o_orderkey, n_nationkey from orders, nation where n_nationkey = o_orderkey % 25 and not n_nationkey = o_custkey % 25)")
def join_cond_diff(spark, path):
    t = Tables(spark, path)
    orders = t["orders"].select("o_orderkey", "o_custkey", (F.col("o_custkey") % 25).alias("by_customer"), (F.col("o_orderkey") % 25).alias("by_order"))
    return cover.join_condition_changed_keys(orders, t["nation"], (("by_customer", "n_nationkey"),), (("by_order", "n_nationkey"),), "o_custkey", "o_orderkey", "n_nationkey")


@query(f"select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and {VANISH_OLD})")
def join_type_diff(spark, path):
    t = Tables(spark, path)
    return cover.join_type_changed_keys(t["customer"], t["orders"].where(VANISH_OLD), BY_CUSTOMER, "c_custkey")


@query("select o_custkey from orders group by 1 having count(*) in (9, 10) or max(o_totalprice) is distinct from min(o_totalprice) or count(*) filter (where o_totalprice >= 200000 and o_totalprice < 205000) > 0")
def candidate_union(spark, path):
    return cover.candidate_union(cover.terminal_keys(_flipped(spark, path), "o_custkey"), having_flip(spark, path), agg_func_diff(spark, path))


# ---------------------------------------------------------------- targeted recomputation and repair
@query(f"select m.* from {L_NEW} m join {L_CANDIDATES} using (c_custkey)")
def targeted_head(spark, path):
    src, found, _, _ = _left(spark, path)
    return spec.targeted(left_mart(NEW), src, found)


_EVENT_KEYS = "(select distinct o_custkey as c_custkey from orders where o_orderstatus = 'P')"


def _origins(spark, path):
    event_keys = Tables(spark, path)["orders"].where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return keys.affected_keys(event_keys, _left(spark, path)[1])


@query(f"select m.* from {L_NEW} m where c_custkey in (select c_custkey from {L_CANDIDATES} union all select c_custkey from {_EVENT_KEYS})")
def targeted_multi_origin(spark, path):
    return spec.targeted(left_mart(NEW), sources(spark, path, "customer", "orders"), _origins(spark, path))


@query(f"select (select count(*) from {_EVENT_KEYS}) as event_keys, (select count(*) from {L_CANDIDATES}) as change_keys, (select count(*) from (select c_custkey from {_EVENT_KEYS} union select c_custkey from {L_CANDIDATES})) as union_keys")
def origin_counts(spark, path):
    return keys.origin_counts(_origins(spark, path))


@query(f"select c_custkey, 'event' as origin from {_EVENT_KEYS} union all select c_custkey, 'sql_change' from {L_CANDIDATES}")
def affected_keys(spark, path):
    return _origins(spark, path)


@query(f"select m.* from {L_OLD} m join {L_CANDIDATES} using (c_custkey)")
def rows_to_replace(spark, path):
    _, found, before, _ = _left(spark, path)
    return repair.rows_to_replace(before, found, "c_custkey")


@query(f"select * from {L_NEW}")
def repaired_mart(spark, path):
    src, found, before, _ = _left(spark, path)
    return repair.repaired(before, spec.targeted(left_mart(NEW), src, found), found, "c_custkey")


@query(f"select 'SUCCEEDED' as status, null::varchar as reason, (select count(*) from {L_CANDIDATES}) as deleted_rows, (select count(*) from {L_CANDIDATES}) as inserted_rows, 0::bigint as missing_rows, 0::bigint as extra_rows, 0::bigint as mismatched_rows, 0::bigint as duplicate_keys")
def repair_vs_head(spark, path):
    src, found, before, after = _left(spark, path)
    return repair.validate_repair(before, after, spec.targeted(left_mart(NEW), src, found), found, "c_custkey")


@query(f"select 2 * count(*)::bigint as mismatched_rows from {L_CHANGED}")
def pre_repair_delta(spark, path):
    src, found, before, _ = _left(spark, path)
    return compare.pre_repair_delta(before, spec.targeted(left_mart(NEW), src, found), found, "c_custkey")


@query(f"select c_custkey from {I_OLD} where c_custkey not in (select c_custkey from {I_NEW})")
def vanished_keys(spark, path):
    src = sources(spark, path, "customer", "orders")
    found = cover.candidate_keys(inner_mart(VANISH_OLD), inner_mart(VANISH_NEW), src).keys
    return compare.vanished_keys(found, spec.targeted(inner_mart(VANISH_NEW), src, found))


@query(f"select 0::bigint as missing_rows, 0::bigint as extra_rows, count(*)::bigint as mismatched_rows, 0::bigint as duplicate_keys, case when count(*) > 0 then 'ROWS_DIFFER' end as reason, case when count(*) > 0 then 'MISMATCHED' else 'MATCHED' end as status from {L_CHANGED}")
def mart_baseline(spark, path):
    _, _, before, after = _left(spark, path)
    return repair.verify_baseline(before, after, "c_custkey")


@query(f"select count(*) filter (where b.n_orders is null) as missing_rows, count(*) filter (where a.n_orders is null) as extra_rows, count(*) filter (where a.total_cents <> b.total_cents) as mismatched_rows, 0::bigint as duplicate_keys, null::varchar as reason, 'MATCHED' as status from {L_OLD} a full join {L_OLD} b on a.c_custkey = b.c_custkey")
def mart_baseline_equal(spark, path):
    """A mart that equals the full old result: told from bucket digests alone, no rows are joined."""
    return repair.verify_baseline(_left(spark, path)[2], mart_left(spark, path), "c_custkey")


@query(f"select count(*) filter (where d.c_custkey is null) as missing_rows, count(*) filter (where m.c_custkey is null) as extra_rows, count(*) filter (where d.n_orders <> m.n_orders) as mismatched_rows, 0::bigint as duplicate_keys, 'ROWS_DIFFER' as reason from {{damaged}} d full join {L_OLD} m on d.c_custkey = m.c_custkey".format(damaged=f"(select c_custkey, case when c_custkey % 110 = 0 then n_orders + 1 else n_orders end as n_orders, total_cents from {L_OLD} where c_custkey % 130 <> 1)"))
def compare_by_buckets(spark, path):
    good = mart_left(spark, path)
    damaged = good.where("c_custkey % 130 <> 1").withColumn("n_orders", F.expr("if(c_custkey % 110 = 0, n_orders + 1, n_orders)"))
    return compare.compare_by_buckets(damaged, good, "c_custkey")


@query(f"select c_custkey from {L_CHANGED}")
def confirmed_keys(spark, path):
    src, found, _, _ = _left(spark, path)
    before, after = (spec.targeted(left_mart(p), src, found) for p in (OLD, NEW))
    return compare.confirmed_keys(before, after, "c_custkey")


@query(f"select c_custkey from {I_CHANGED}")
def confirmed_vanishing(spark, path):
    src = sources(spark, path, "customer", "orders")
    found = cover.candidate_keys(inner_mart(VANISH_OLD), inner_mart(VANISH_NEW), src).keys
    before, after = (spec.targeted(inner_mart(p), src, found) for p in (VANISH_OLD, VANISH_NEW))
    return compare.confirmed_keys(before, after, "c_custkey")


@query(f"select (select count(*) from (select c_custkey from {_EVENT_KEYS} union select c_custkey from {L_CANDIDATES})) - (select count(*) from {L_CHANGED}) as no_ops")
def no_ops(spark, path):
    row = compare.one_row(keys.origin_counts(_origins(spark, path)), compare.count_of(confirmed_keys(spark, path), "confirmed"))
    return row.select(compare.no_op_count(F.col("union_keys"), F.col("confirmed")).alias("no_ops"))


@query(f"select * from {L_NEW}")
def repair_by_partition(spark, path):
    """The stored mart after a repair that rewrites only the partitions with a key of it."""
    src, found, before, _ = _left(spark, path)
    with Workspace(spark) as work:
        mart = repair.PartitionedMart(spark, f"{work.path}/mart", "c_custkey", parts=16)
        mart.create(before)
        found = work.put("keys", found)
        mart.repair(spec.targeted(left_mart(NEW), src, found), found)
        return settled(mart.read())


@query(f"select * from {L_NEW}")
def apply_repair(spark, path):
    """The stored mart after the repaired copy has been swapped in."""
    src, found, before, _ = _left(spark, path)
    with Workspace(spark) as work:
        stored, found = work.put("mart", before), work.put("keys", found)
        repair.apply_repair(spark, f"{work.path}/mart", spec.targeted(left_mart(NEW), src, found), found, "c_custkey")
        return settled(spark.read.schema(stored.schema).parquet(f"{work.path}/mart"))


@query("select 'FULL_REBUILD_REQUIRED' as status, 'TWO_TAINTED_JOIN_INPUTS' as reason, count(*) as candidate_count, 0::bigint as rows_avoided from customer")
def two_tainted_inputs(spark, path):
    """Two filters change at once: no keys are derived, so all entities count as candidates."""
    src = sources(spark, path, "customer", "orders")
    old = left_mart(OLD).with_filter("customer", "c_acctbal > 0")
    found = cover.candidate_keys(old, left_mart(NEW).with_filter("customer", "c_acctbal > 1000"), src)
    full = compare.count_of(src["customer"], "full").select(F.lit(found.status).alias("status"), F.lit(found.reasons[0]).alias("reason"), "full")
    proof = compare.fallback_proof(full, F.lit("required"), F.col("full"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    return proof.select("status", "reason", "candidate_count", "rows_avoided")


_DAMAGED = f"(select c_custkey, case when c_custkey % 11 = 0 then n_orders + 1 else n_orders end as n_orders, total_cents from {L_OLD} where c_custkey % 13 <> 0 union all select c_custkey + 10000000, n_orders, total_cents from {L_OLD} where c_custkey % 17 = 0)"


@query(f"select count(*) filter (where d.c_custkey is null) as missing_rows, count(*) filter (where m.c_custkey is null) as extra_rows, count(*) filter (where d.n_orders <> m.n_orders) as mismatched_rows, 0::bigint as duplicate_keys, 'ROWS_DIFFER' as reason from {_DAMAGED} d full join {L_OLD} m on d.c_custkey = m.c_custkey")
def compare_tables(spark, path):
    good = mart_left(spark, path)
    damaged = good.where("c_custkey % 13 <> 0").withColumn("n_orders", F.expr("if(c_custkey % 11 = 0, n_orders + 1, n_orders)"))
    damaged = damaged.unionByName(good.where("c_custkey % 17 = 0").withColumn("c_custkey", F.col("c_custkey") + 10000000))
    return compare.compare_tables(damaged, good, "c_custkey")


@query("select o_custkey, count(*) as rows from orders group by 1 having count(*) > 1")
def duplicate_keys(spark, path):
    return compare.duplicate_keys(Tables(spark, path)["orders"], "o_custkey")


@query(f"with n as (select (select count(*) from customer) as f, (select count(*) from {L_CANDIDATES}) as c) select f as full_entities, c as frontier_entities, round((1 - c / f) * 100, 3) as percent_avoided from n")
def impact_metrics(spark, path):
    t = Tables(spark, path)
    row = compare.one_row(compare.count_of(t["customer"], "f"), compare.count_of(candidates(spark, path), "c"))
    return row.select(*compare.impact_metrics(F.col("f"), F.col("c")))


@query("with c as (select c_nationkey, count(*) as full_entities, count(*) filter (where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice >= 450000)) as candidates from customer group by 1) select c_nationkey, full_entities, candidates, candidates * 100 >= full_entities * 25 as rebuild from c")
def rebuild_decision(spark, path):
    t = Tables(spark, path)
    some = t["orders"].where(VANISH_OLD).select(F.col("o_custkey").alias("k")).distinct()
    row = t["customer"].join(some, F.col("c_custkey") == F.col("k"), "left").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("full_entities"), F.count("k").alias("candidates"))
    return row.withColumn("rebuild", repair.recommend_rebuild(F.col("candidates"), F.col("full_entities"), 25))


@query("with c as (select c_nationkey as run, count(*) as f, count(*) filter (where c_acctbal < 0) as c, case c_nationkey % 3 when 0 then 'required' when 1 then 'recommended' else 'failed' end as kind from customer group by 1) select run, kind, case when kind = 'required' then f else c end as frontier_rows, case when kind = 'required' then 0 else f - c end as rows_avoided, case when kind = 'required' then f else c end as candidate_count, case when kind = 'required' then 0 else c end as changed_source_rows, kind = 'required' as rebuild_required, kind = 'recommended' as rebuild_recommended from c")
def fallback_proofs(spark, path):
    runs = Tables(spark, path)["customer"].groupBy(F.col("c_nationkey").alias("run")).agg(F.count(F.lit(1)).alias("f"), F.count(F.when(F.col("c_acctbal") < 0, 1)).alias("c"))
    kind = F.when(F.col("run") % 3 == 0, "required").when(F.col("run") % 3 == 1, "recommended").otherwise("failed")
    return compare.fallback_proof(runs.withColumn("kind", kind), F.col("kind"), F.col("f"), F.col("c"), F.col("c")).drop("f", "c")


# ---------------------------------------------------------------- events
#: Change events derived from the tables: customers (direct), orders (same row), line items (two hops).
_EVENTS_SQL = """(select 'c' || c_custkey as event_id, 'customer' as source_model, c_custkey::varchar as entity_value, case when c_custkey % 2 = 0 then (c_custkey + 1)::varchar end as prior_entity_value, c_custkey as position from customer
union all select 'o' || o_orderkey, 'orders', o_orderkey::varchar, case when o_orderkey % 2 = 0 then ((o_custkey + 1) % (select count(*) from customer))::varchar end, 10000000000 + o_orderkey from orders
union all select 'l' || l_orderkey || '.' || l_linenumber, 'lineitem', l_orderkey::varchar, null, 20000000000 + l_orderkey * 10 + l_linenumber from lineitem)"""
ROUTES = {"customer": keys.Route("direct", "c_custkey"), "orders": keys.Route("path", "order_id", (("orders", "o_orderkey"), ("orders", "o_custkey"))), "lineitem": keys.Route("path", "line_id", (("lineitem", "l_orderkey"), ("orders", "o_orderkey"), ("orders", "o_custkey"), ("customer", "c_custkey")))}


def change_feed(spark, path) -> DataFrame:
    t = Tables(spark, path)
    n = t["customer"].agg(F.count(F.lit(1)).alias("n_customers"))
    c = t["customer"].selectExpr("concat('c', c_custkey) as event_id", "'customer' as source_model", "cast(c_custkey as string) as entity_value", "if(c_custkey % 2 = 0, cast(c_custkey + 1 as string), null) as prior_entity_value", "c_custkey as position")
    o = t["orders"].join(F.broadcast(n)).selectExpr("concat('o', o_orderkey)", "'orders'", "cast(o_orderkey as string)", "if(o_orderkey % 2 = 0, cast((o_custkey + 1) % n_customers as string), null)", "10000000000 + o_orderkey")
    li = t["lineitem"].selectExpr("concat('l', l_orderkey, '.', l_linenumber)", "'lineitem'", "cast(l_orderkey as string)", "cast(null as string)", "20000000000 + l_orderkey * 10 + l_linenumber")
    return c.union(o).union(li)


def _route_tables(spark, path) -> dict[str, DataFrame]:
    return sources(spark, path, "customer", "orders", "lineitem")


def _of(events: DataFrame, name: str) -> DataFrame:
    return events.where(F.col("source_model") == name)


@query(f"select event_id, entity_value from {_EVENTS_SQL} where source_model = 'customer'")
def route_direct(spark, path):
    return keys.route_direct(_of(change_feed(spark, path), "customer"))


@query("select 'o' || o_orderkey as event_id, o_custkey::varchar as entity_value from orders")
def route_same_row(spark, path):
    return keys.route_same_row(_of(change_feed(spark, path), "orders"), Tables(spark, path)["orders"], "o_orderkey", "o_custkey")


@query("select distinct 'l' || l_orderkey || '.' || l_linenumber as event_id, o_custkey::varchar as entity_value from lineitem join orders on o_orderkey = l_orderkey")
def route_multi_hop(spark, path):
    return keys.route_path(_of(change_feed(spark, path), "lineitem"), _route_tables(spark, path), ROUTES["lineitem"].hops)


@query(f"select event_id, prior_entity_value as entity_value from {_EVENTS_SQL} where prior_entity_value is not null")
def route_before_image(spark, path):
    return keys.route_before_image(change_feed(spark, path))


_AFFECTED_SQL = f"""(with e as (select * from {_EVENTS_SQL}), r as (
select entity_value, 'Direct customer key' as reason, 0 as late, position as p, 0 as step from e where source_model = 'customer'
union all select prior_entity_value, 'Before-image supplied customer', 1, position, 1 from e where source_model = 'customer' and prior_entity_value is not null
union all select o_custkey::varchar, 'Order ' || e.entity_value || ' belongs to customer', 0, position, 0 from e join orders on o_orderkey::varchar = e.entity_value where source_model = 'orders'
union all select prior_entity_value, 'Before-image supplied customer', 0, position, 1 from e where source_model = 'orders' and prior_entity_value is not null
union all select o_custkey::varchar, 'Line ' || e.entity_value || ' belongs to customer', 0, position, 0 from e join orders on o_orderkey::varchar = e.entity_value where source_model = 'lineitem')
select entity_value, arg_min(reason, (late, p, step, reason)) as reason from r group by 1)"""


@query(f"select * from {_AFFECTED_SQL}")
def affected_entities(spark, path):
    with Workspace(spark) as work:  # a feed is a table; it is derived only here
        return settled(keys.affected_entities(work.put("feed", change_feed(spark, path)), ROUTES, _route_tables(spark, path), "c_custkey", "customer", work=work))


@query(f"select entity_value, row_number() over (order by entity_value::bigint) as place from {_AFFECTED_SQL}")
def entity_order(spark, path):
    return keys.placed(affected_entities(spark, path).select("entity_value"))


@query("select k as entity_value, min(l)::int as first_list from (select c_custkey::varchar as k, 0 as l from customer where c_acctbal < 0 union all select distinct o_custkey::varchar, 1 from orders where o_orderstatus = 'P') group by 1")
def merge_keys(spark, path):
    t = Tables(spark, path)
    return keys.merge_keys(t["customer"].where("c_acctbal < 0").select("c_custkey"), t["orders"].where("o_orderstatus = 'P'").select("o_custkey"))


@query(f"select event_id from {_EVENTS_SQL} e where source_model <> 'customer' and prior_entity_value is null and not exists (select 1 from orders where o_orderkey::varchar = entity_value and o_orderstatus <> 'F')")
def unresolved_events(spark, path):
    events = change_feed(spark, path).where("source_model <> 'customer'")
    routed = keys.route_same_row(events, Tables(spark, path)["orders"].where("o_orderstatus <> 'F'"), "o_orderkey", "o_custkey")
    return keys.unresolved_events(events, routed).select("event_id")


# ---------------------------------------------------------------- change data capture
_FEED_SQL = """(with f as (select o_orderkey pk, o_custkey ck, o_orderkey % 50 b from orders where o_orderkey % 50 < 4)
select 'DELETE' as action, b < 2 as is_update, 'r' || pk as row_id, pk::varchar as primary_key, ck::varchar as target_key from f where b in (0, 1, 2)
union all select 'INSERT', b < 2, 'r' || pk, pk::varchar, (case when b = 1 then (ck + 1) % (select count(*) from customer) else ck end)::varchar from f where b in (0, 1, 3))"""


def raw_feed(spark, path) -> DataFrame:
    """Raw records: orders updated in place, moved to another customer, deleted and inserted, by their key modulo 50."""
    t = Tables(spark, path)
    n = t["customer"].agg(F.count(F.lit(1)).alias("n"))
    f = t["orders"].where("o_orderkey % 50 < 4").selectExpr("o_orderkey as pk", "o_custkey as ck", "o_orderkey % 50 as b").join(F.broadcast(n))
    gone = f.where("b in (0, 1, 2)").selectExpr("'delete ' as a", "if(b < 2, 'T', 'no') as u", "concat('r', pk) as r", "pk", "ck as k")
    new = f.where("b in (0, 1, 3)").selectExpr("'Insert'", "if(b < 2, 'yes', '0')", "concat('r', pk)", "pk", "if(b = 1, (ck + 1) % n, ck)")
    return cdc.decode_cdc(gone.union(new), "a", "u", "r", "pk", "k")


_LOGICAL_SQL = f"""(select row_id, case when bool_or(is_update) then 'UPDATE' else max(action) end as operation, bool_or(is_update) as is_update,
max(primary_key) filter (where action = 'DELETE') as pb, max(primary_key) filter (where action = 'INSERT') as pa,
max(target_key) filter (where action = 'DELETE') as tb, max(target_key) filter (where action = 'INSERT') as ta from {_FEED_SQL} group by 1)"""
_PRINT_SQL = "sha256('orders_stream|' || row_id || '|' || operation || '|' || coalesce(pb, '') || '|' || coalesce(pa, '') || '|' || coalesce(tb, '') || '|' || coalesce(ta, ''))"


def logical_events(spark, path) -> DataFrame:
    return cdc.paired(raw_feed(spark, path), "orders_stream")


@query(f"select * from {_FEED_SQL}")
def cdc_decode(spark, path):
    return raw_feed(spark, path)


@query(f"select substr({_PRINT_SQL}, 1, 32) as event_id, row_id, operation, is_update, pb as primary_key_before, pa as primary_key_after, tb as target_key_before, ta as target_key_after, {_PRINT_SQL} as payload_fingerprint from {_LOGICAL_SQL}")
def cdc_normalize(spark, path):
    return cdc.normalize_cdc(raw_feed(spark, path), "orders_stream")


@query("select count(*) filter (where b = 3) as inserts, count(*) filter (where b < 2) as updates, count(*) filter (where b = 2) as deletes from (select o_orderkey % 50 as b from orders)")
def cdc_counts(spark, path):
    return cdc.operation_counts(logical_events(spark, path))


@query("select b.o_orderpriority, count(*) filter (where b = 3) as inserts, count(*) filter (where b < 2) as updates, count(*) filter (where b = 2) as deletes from (select o_orderpriority, o_orderkey % 50 as b from orders where o_orderkey % 50 < 4) b group by 1")
def cdc_counts_by_source(spark, path):
    source = Tables(spark, path)["orders"].select(F.concat(F.lit("r"), "o_orderkey").alias("row_id"), "o_orderpriority")
    return cdc.operation_counts(logical_events(spark, path).join(source, "row_id"), ["o_orderpriority"])


_KEYS_SQL = f"(select row_id, unnest(case when tb is null then [ta] when ta is null or ta = tb then [tb] else [tb, ta] end) as entity_key from {_LOGICAL_SQL})"


@query(f"select substr({_PRINT_SQL}, 1, 32) as event_id, entity_key from {_LOGICAL_SQL} join {_KEYS_SQL} using (row_id)")
def cdc_route(spark, path):
    return cdc.target_keys(logical_events(spark, path))


@query(f"select entity_key, count(*) as event_count, 'event' as origin from {_KEYS_SQL} group by 1")
def cdc_key_counts(spark, path):
    return cdc.route_cdc(logical_events(spark, path))


@query(f"select sha256(string_agg(p, ',' order by p)) as batch_fingerprint from (select {_PRINT_SQL} as p from {_LOGICAL_SQL})")
def cdc_fingerprint(spark, path):
    return cdc.batch_fingerprint(logical_events(spark, path))


@query(f"select {_PRINT_SQL} as payload_fingerprint from {_LOGICAL_SQL} where pb::bigint % 3 = 0 or pa::bigint % 3 = 0")
def cdc_duplicates(spark, path):
    events = logical_events(spark, path)
    history = events.where("cast(coalesce(primary_key_before, primary_key_after) as bigint) % 3 = 0")
    return cdc.duplicates(events, history)


@query("select 'r' || o_orderkey as row_id from orders where o_orderkey % 50 in (1, 2) and o_custkey % 4 = 0")
def cdc_before_image(spark, path):
    raw = raw_feed(spark, path).withColumn("target_key", F.expr("if(action = 'DELETE' and cast(target_key as bigint) % 4 = 0 and cast(primary_key as bigint) % 50 > 0, null, target_key)"))
    return cdc.check_before_images(cdc.paired(raw, "orders_stream")).select("row_id")


@query("select count(*) as unresolved from orders where o_orderkey % 50 < 4 and o_custkey % 4 = 0 and o_orderkey % 50 <> 1")
def cdc_unresolved(spark, path):
    raw = raw_feed(spark, path).withColumn("target_key", F.expr("if(cast(target_key as bigint) % 4 = 0 and cast(primary_key as bigint) % 50 <> 1, null, target_key)"))
    return cdc.unresolved_count(cdc.paired(raw, "orders_stream"))


@query(f"with k as (select distinct entity_key::bigint as c_custkey from {_KEYS_SQL}), c as (select c_custkey from {CHANGED_SQL.format(a=L_OLD, b=L_NEW)} join k using (c_custkey)) select (select count(*) from k) as candidate_count, (select count(*) from c) as confirmed_change_count, (select count(*) from k) - (select count(*) from c) as no_op_count, 0::bigint as vanished_count, true as targeted_rows_compared")
def cdc_proof(spark, path):
    src = sources(spark, path, "customer", "orders")
    routed = cdc.route_cdc(logical_events(spark, path))
    with Workspace(spark) as work:
        return settled(batchlog.prove_cdc(routed, lambda k: spec.targeted(left_mart(NEW), src, k), mart_left(spark, path), "c_custkey", work)[0])


_STORED_SQL = f"select substr({_PRINT_SQL}, 1, 32) as event_id, 'orders' as source_model, 'orders_stream' as source_relation, row_id as provider_row_id, operation, is_update, pb as primary_key_before, pa as primary_key_after, tb as target_key_before, ta as target_key_after, {_PRINT_SQL} as payload_fingerprint from {_LOGICAL_SQL}"
_STORED = ["event_id", "source_model", "source_relation", "provider_row_id", "operation", "is_update", "primary_key_before", "primary_key_after", "target_key_before", "target_key_after", "payload_fingerprint"]


@query(_STORED_SQL)
def captured_events(spark, path):
    """The event log after a stream over files with the whole feed has been consumed."""
    with Workspace(spark) as work:
        feed = work.put("feed", raw_feed(spark, path))
        log = batchlog.BatchLog(spark, f"{work.path}/log", project="orders_mart")
        log.consume(spark.readStream.schema(feed.schema).parquet(f"{work.path}/feed"), f"{work.path}/checkpoint", "orders_stream", model="orders").awaitTermination()
        return settled(log.events().select(*_STORED))


@query(_STORED_SQL)
def paired_events(spark, path):
    """The same log from a feed whose deletes and inserts come in different micro-batches."""
    with Workspace(spark) as work:
        at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("primary_key").cast("bigint") % 600)
        feeds = [work.put(f"feed/{action}", raw_feed(spark, path).where(F.col("action") == action).withColumn("at", at)) for action in ("DELETE", "INSERT")]
        feed, files = feeds[0], max(len(f.inputFiles()) for f in feeds)
        log = batchlog.BatchLog(spark, f"{work.path}/log", project="orders_mart")
        stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", max(1, files)).option("recursiveFileLookup", True).parquet(f"{work.path}/feed")
        log.consume_paired(stream, f"{work.path}/checkpoint", "orders_stream", "at", "1 hour", model="orders", partitions=spark.sparkContext.defaultParallelism).awaitTermination()
        return settled(log.events().select(*_STORED))


@query(f"with k as (select distinct entity_key::bigint as c_custkey from {_KEYS_SQL}), c as (select c_custkey from {CHANGED_SQL.format(a=L_OLD, b=L_NEW)}), q as (select c_custkey from {L_CANDIDATES}) select (select count(*) from k) as candidate_count, (select count(*) from q) as sql_change_candidate_count, (select count(*) from (select * from k union select * from q)) as union_candidate_count, (select count(*) from c where c_custkey in (select * from k union select * from q)) as confirmed_change_count, 0::bigint as missed_event_count, 'passed' as validation_status, true as repair_applied, 'COMPLETED' as status, (select count(*) from {_FEED_SQL}) as raw_record_count, (select count(*) from {_LOGICAL_SQL}) as logical_event_count")
def batch_proof(spark, path):
    """A captured batch, with a definition change beside it, proved and applied to a partitioned mart: the batch's state and proof."""
    src, changed, before, _ = _left(spark, path)
    with Workspace(spark) as work:
        mart = repair.PartitionedMart(spark, f"{work.path}/mart", "c_custkey", parts=16)
        mart.create(before)
        log = batchlog.BatchLog(spark, f"{work.path}/log", project="orders_mart")
        log.capture(raw_feed(spark, path), "b1", "orders_stream", model="orders")
        log.prove("b1", lambda k: spec.targeted(left_mart(NEW), src, k), mart.read(), "c_custkey", apply=mart.repair, changed=changed)
        return settled(log.batches(status="COMPLETED").select("candidate_count", "sql_change_candidate_count", "union_candidate_count", "confirmed_change_count", "missed_event_count", "validation_status", "repair_applied", "status", "raw_record_count", "logical_event_count"))


@query("select distinct user_id, event_type from events")
def late_duplicates(spark, path):
    """Events of a stream without those that repeat user and type within the declared lateness."""
    with Workspace(spark) as work:
        events = work.put("events", Tables(spark, path)["events"].select("user_id", "event_type", "ts"))
        stream = cdc.with_lateness(spark.readStream.schema(events.schema).parquet(f"{work.path}/events"), "ts", "36500 days")
        kept = cdc.drop_late_duplicates(stream, ["user_id", "event_type"]).select("user_id", "event_type")
        kept.writeStream.format("parquet").option("path", f"{work.path}/kept").option("checkpointLocation", f"{work.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return settled(spark.read.schema(kept.schema).parquet(f"{work.path}/kept"))


def _batches(spark, path) -> DataFrame:
    """A batch per customer nation: its state and proof derived from that nation's figures."""
    row = Tables(spark, path)["customer"].groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("full_entities"), F.count(F.when(F.col("c_acctbal") < 0, 1)).alias("union_candidates"))
    k = F.col("c_nationkey")
    return row.select(
        F.concat(F.lit("b"), k).alias("batch_id"), "full_entities", "union_candidates",
        F.when(k % 5 == 0, "CAPTURED").when(k % 5 == 1, "FAILED").otherwise("COMPLETED").alias("status"),
        F.when(k % 2 == 1, "E1").alias("error_code"), F.when(k % 7 != 0, "f").alias("payload_fingerprint"), F.when(k % 5 != 2, "passed").otherwise("failed").alias("validation_status"),
        (k % 3 != 0).alias("targeted_rows_compared"), F.when(k % 4 == 0, 1).otherwise(0).alias("missed_event_count"), F.lit(0).alias("unresolved_events"),
    )


@query("""with b as (select c_nationkey as k, count(*) as f, count(*) filter (where c_acctbal < 0) as u from customer group by 1),
r as (select *, case when k % 7 = 0 then 'FINGERPRINT_MISSING' when k % 5 = 0 then 'BATCH_NOT_FINISHED' when k % 5 = 1 and k % 2 = 0 then 'ERROR_CODE_MISSING' when k % 5 = 1 then null when k % 5 = 2 then 'PROOF_NOT_PASSED' when k % 3 = 0 then 'TARGETED_ROWS_NOT_COMPARED' when k % 4 = 0 then 'EVENTS_UNRESOLVED' end as refused from b)
select 'b' || k as batch_id, case when refused is null then case when k % 5 = 1 then 'failed' else 'passed' end end as assessment, case when refused is null then case when k % 5 = 1 then 'failed' else 'completed' end end as checkpoint,
case when refused is null then case when k % 5 = 1 then 'none' else 'empirically_validated' end end as evidence, case when refused is null then round((1 - u / f) * 100, 3) end as percent_avoided, refused from r""")
def cdc_summary(spark, path):
    return cdc.cdc_summary(_batches(spark, path))


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, max(ts) as ts from events group by 1")
def latest_state(spark, path):
    return keys.latest(Tables(spark, path)["events"], ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "ts")


def _moves(spark, path) -> DataFrame:
    """States of a batch per customer, from that customer's orders: the status by the order's."""
    status = "case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'CAPTURED' else 'FAILED' end"
    return Tables(spark, path)["orders"].selectExpr("concat('b', o_custkey) as batch_id", "concat('p', o_custkey % 40) as project_name", "concat('s', o_custkey % 3) as stream_relation", "cast(o_orderkey as bigint) as seq", f"{status} as status", "cast(o_orderdate as timestamp) as started_at", "cast(o_orderdate as timestamp) as completed_at", "o_orderkey % 3 = 0 as repair_applied", "cast(o_orderdate as timestamp) as at")


_LATEST_SQL = "(select 'b' || o_custkey as batch_id, 'p' || (o_custkey % 40) as project_name, 's' || (o_custkey % 3) as stream_relation, o_orderkey::bigint as seq, case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'CAPTURED' else 'FAILED' end as status, o_orderdate::timestamp as started_at, o_orderkey % 3 = 0 as repair_applied from orders o where not exists (select 1 from orders x where x.o_custkey = o.o_custkey and x.o_orderkey > o.o_orderkey))"


@query(f"select batch_id, status, seq from {_LATEST_SQL} where status <> 'COMPLETED' order by started_at, batch_id limit 1")
def oldest_pending(spark, path):
    return batchlog.oldest_pending(_moves(spark, path)).select("batch_id", "status", "seq")


@query(f"select batch_id, seq from {_LATEST_SQL} where status = 'COMPLETED' and batch_id not in (select 'b' || c_custkey from customer where c_acctbal > 5000) order by started_at desc, batch_id desc limit 1")
def newest_unpublished(spark, path):
    published = Tables(spark, path)["customer"].where("c_acctbal > 5000").select(F.concat(F.lit("b"), "c_custkey").alias("batch_id"))
    return batchlog.newest_unpublished(_moves(spark, path), published).select("batch_id", "seq")


@query(f"select a.batch_id, min(b.batch_id) as blocked_by from {_LATEST_SQL} a join {_LATEST_SQL} b on a.project_name = b.project_name and a.batch_id <> b.batch_id where a.status <> 'COMPLETED' and b.status = 'COMPLETED' and not b.repair_applied group by 1")
def stale_batches(spark, path):
    return batchlog.stale_pairs(_moves(spark, path))


@query(f"select l.batch_id, l.project_name, l.stream_relation, l.seq, l.status, l.repair_applied, p.n as candidate_count, case when p.n % 2 = 0 then 'passed' else 'failed' end as validation_status from {_LATEST_SQL} l join (select 'b' || c_custkey as b, c_nationkey::bigint as n from customer) p on p.b = l.batch_id where l.stream_relation = 's1' and l.status = 'COMPLETED'")
def batch_list(spark, path):
    proofs = Tables(spark, path)["customer"].selectExpr("concat('b', c_custkey) as batch_id", "cast(c_nationkey as bigint) as candidate_count", "if(c_nationkey % 2 = 0, 'passed', 'failed') as validation_status", "true as repair_applied")
    found = batchlog.list_batches(_moves(spark, path), proofs, stream="s1", status="COMPLETED")
    return found.select("batch_id", "project_name", "stream_relation", "seq", "status", "repair_applied", "candidate_count", "validation_status")


@query("with c as (select o_orderpriority, count(*) filter (where b = 3) as i, count(*) filter (where b < 2) as u, count(*) filter (where b = 2) as d from (select o_orderpriority, o_orderkey % 50 as b from orders where o_orderkey % 50 < 4) group by 1) select o_orderpriority, sha256('orders|orders_stream|' || i || '|' || u || '|' || d) as fingerprint from c")
def relation_fingerprints(spark, path):
    row = cdc_counts_by_source(spark, path)
    return row.select("o_orderpriority", scalars.relation_fingerprint(F.lit("orders"), F.lit("orders_stream"), *[F.col(n) for n in ("inserts", "updates", "deletes")]).alias("fingerprint"))


@query("select l_orderkey as run_id, count(distinct i) = 1 and count(i) = count(*) as consistent from (select l_orderkey, case when l_linenumber % 4 <> 0 or l_quantity <= 45 then l_returnflag end as i from lineitem) group by 1")
def pin_consistency(spark, path):
    return files.pin_consistent(Tables(spark, path)["lineitem"].selectExpr("l_orderkey as run_id", "l_linenumber as phase", "if(l_linenumber % 4 <> 0 or l_quantity <= 45, l_returnflag, null) as identifier"))


@query("select 'e' || event_id as event_id, 'clicks' as source_model, nullif(trim(event_type), '') as operation, 'user_id' as entity_key, user_id::varchar as entity_value, case when event_id % 3 <> 0 then (user_id + 1)::varchar end as prior_entity_value from events")
def read_events(spark, path):
    raw = Tables(spark, path)["events"].selectExpr("concat(' e', event_id, ' ') as eventId", "'clicks' as source_model", "event_type as operation", "'user_id' as entityKey", "user_id as entity_value", "if(event_id % 3 = 0, '  ', cast(user_id + 1 as string)) as prior_customer_id")
    return files.change_events(raw)


@query("select o_orderpriority, count(*) as n from orders group by 1")
def pinned_source(spark, path):
    """Counts from a source that is read only if every part of it is as it was pinned."""
    pins = files.pin(spark, {"orders": f"{path}/orders.parquet"})
    return files.read_pinned(pins, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("select 'p' || (p_partkey // 2) as parent, 'p' || p_partkey as child from part where p_partkey > 1")
def lineage_file(spark, path):
    """Lineage edges read from a file of nodes, written from the parts."""
    node = "struct(concat('p', p_partkey) as unique_id, concat('p', p_partkey) as name, 'model' as resource_type, struct(if(p_partkey > 1, array(concat('p', p_partkey div 2)), array()) as nodes) as depends_on)"
    with Workspace(spark) as work:
        nodes = Tables(spark, path)["part"].select(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("p"), "p_partkey"), F.expr(node)))).alias("nodes"))
        nodes.coalesce(1).write.json(f"{work.path}/lineage")
        return settled(files.read_lineage(spark, f"{work.path}/lineage")[1])


@query(f"select sha256(from_hex('{_OPAD}') || from_hex(sha256(from_hex('{_IPAD}') || encode('v1|demo|customer|c_custkey|' || c_custkey)))) as entity_value, 'Order belongs to customer' as reason from {L_CANDIDATES}")
def written_assessment(spark, path):
    """The entities of an assessment as they leave the house: pseudonyms, and reasons without ids."""
    found = candidates(spark, path).select(F.col("c_custkey").cast("string").alias("entity_value"), scalars.routed_reason("order_id", F.col("c_custkey"), "customer").alias("reason"))
    with Workspace(spark) as work:
        files.write_assessment(compare.count_of(found, "n"), found, f"{work.path}/out", _SECRET, "demo", "customer", "c_custkey")
        return settled(spark.read.schema("entity_value string, reason string").json(f"{work.path}/out/entities"))


@query("select event_id, 'customer_id' as field from events where event_id % 3 = 0 union all select event_id, 'secret' from events where event_id % 5 = 0")
def forbidden_fields(spark, path):
    inner = "if(event_id % 3 = 0, concat('{\"customer_id\": ', user_id, '}'), '\"customer_id\"')"
    row = Tables(spark, path)["events"].selectExpr("event_id", f"concat('{{\"a\": ', {inner}, ', \"', if(event_id % 5 = 0, 'secret', 'note'), '\" : \"customer_id: 1\"}}') as json")
    return leaks.forbidden_fields(row, "event_id", "json", ["customer_id", "secret"])


# ---------------------------------------------------------------- scalars
@query(f"select c_custkey, sha256(from_hex('{_OPAD}') || from_hex(sha256(from_hex('{_IPAD}') || encode('v1|demo|customer|c_custkey|' || c_custkey)))) as pseudonym from customer")
def pseudonyms(spark, path):
    return Tables(spark, path)["customer"].select("c_custkey", scalars.pseudonymize(F.concat(F.lit(" +00"), F.col("c_custkey")), _SECRET, "demo", "Customer", "c_custkey").alias("pseudonym"))


@query("select o_orderkey, case o_orderkey % 5 when 0 then o_orderkey::varchar when 1 then (-o_orderkey)::varchar when 2 then o_orderkey || '.50' when 3 then 'x' || o_orderkey else o_orderkey::varchar end as k from orders")
def normalized_keys(spark, path):
    raw = F.expr("case o_orderkey % 5 when 0 then concat(' +', o_orderkey, ' ') when 1 then concat('-00', o_orderkey) when 2 then concat(o_orderkey, '.50') when 3 then concat('x', o_orderkey) else concat('000', o_orderkey, '.00') end")
    return Tables(spark, path)["orders"].select("o_orderkey", scalars.normalize_key(raw).alias("k"))


@query("select event_id, coalesce(lower(event_type), '') in ('true', '1', 't', 'yes') or user_id % 4 = 0 as yes from events")
def truthy(spark, path):
    text = F.expr("case user_id % 4 when 0 then ' YES ' else event_type end")
    return Tables(spark, path)["events"].select("event_id", scalars.truthy(text).alias("yes"))


@query("select p_partkey, case p_partkey % 3 when 0 then 'customer' when 1 then 'part' else 'p_brand' end as entity from part")
def entity_type(spark, path):
    key = F.expr("case p_partkey % 3 when 0 then ' cust_key' when 1 then 'part_id' else 'p_brand' end")
    return Tables(spark, path)["part"].select("p_partkey", scalars.entity_type(key, "cust_key", "customer").alias("entity"))


@query("select o_orderkey, 'Purchase Order ' || o_orderkey || ' belongs to customer' as shown, 'Purchase Order belongs to customer' as hidden from orders")
def reasons(spark, path):
    make = [scalars.routed_reason("purchase_order_id", F.col("o_orderkey"), "customer", show).alias(n) for show, n in ((True, "shown"), (False, "hidden"))]
    return Tables(spark, path)["orders"].select("o_orderkey", *make)


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when microsecond(ts) % 1000000 <> 0 then '.' || lpad((microsecond(ts) % 1000000)::varchar, 6, '0') else '' end || 'Z' as at from events")
def iso_ts(spark, path):
    return Tables(spark, path)["events"].select("event_id", scalars.iso_utc(F.col("ts")).alias("at"))


@query("select distinct doc_id, t as entity_value from (select doc_id, unnest(regexp_extract_all(text, '[0-9A-Fa-f]+')) as t from documents) where t in (select c_custkey::varchar from customer)")
def leak_scan(spark, path):
    t = Tables(spark, path)
    return leaks.leak_scan(t["documents"], "doc_id", "text", t["customer"].select("c_custkey"))


@query("select doc_id, md5(t) as plain, sha256(t) as fingerprint from (select doc_id, trim(regexp_replace('select x -- ''note'' from ' || doc_id || chr(10) || ' from \"Keep  Case\" where y = ''A  -- b''', '^(select x) .*\\n', '\\1')) as raw, 'select x from \"Keep Case\" where y = ''A -- b''' as t from documents)")
def text_fingerprint(spark, path):
    text = F.concat(F.lit("SELECT  X -- 'note' FROM "), F.col("doc_id"), F.lit("\n FROM /* a ' \n b */ \"Keep  Case\"\tWHERE y='A  -- b'"))
    row = Tables(spark, path)["documents"].select("doc_id", F.regexp_replace(scalars.plain_text(text), "y='", "y = '").alias("t"))
    return row.select("doc_id", F.md5("t").alias("plain"), F.sha2("t", 256).alias("fingerprint"))


# ---------------------------------------------------------------- decisions over a table of runs (one per customer)
def runs(spark, path) -> DataFrame:
    """Figures and flags of a run per customer, from the customer's orders."""
    t = Tables(spark, path)
    mart = spec.build_mart(left_mart("o_totalprice > 0"), {"customer": t["customer"], "orders": t["orders"]})
    k, n, s = F.col("c_custkey"), F.col("n_orders"), F.col("total_cents")
    return mart.select(
        k.alias("run_id"), n, s, (k % 3 != 0).alias("pinned"), (k % 2 == 0).alias("static_certified"), (k % 5 == 0).alias("contract_certified"), (n > 15).alias("rebuild_recommended"),
        F.when(k % 4 != 0, s).alias("frontier_bytes"), F.when(k % 6 != 0, n * 15000000).alias("full_bytes"), F.when(k % 7 == 0, 1.0).alias("credits"), (k % 11 == 0).alias("reference_validated"),
        (k % 13 == 0).alias("reference_failed"), (k % 17 == 0).alias("confirmation_failed"), (n > 5).alias("candidates_confirmed"), (k % 19 == 0).alias("execution_failed"), (k % 2 == 1).alias("execution_ran"),
    )


_RUNS_SQL = f"""(select c_custkey as run_id, n_orders, total_cents, c_custkey % 3 <> 0 as pinned, n_orders > 15 as reb, case when c_custkey % 4 <> 0 then total_cents end as fb, case when c_custkey % 6 <> 0 then n_orders * 15000000 end as ub from {LEFT_SQL.format(p='o_totalprice > 0')})"""
_CERT_SQL = "case when run_id % 3 = 0 then 'UNCERTIFIED' when run_id % 2 = 0 then 'SQL_CERTIFIED' when run_id % 5 = 0 then 'CONTRACT_CERTIFIED' else 'UNCERTIFIED' end"
_VALID_SQL = "case when run_id % 11 = 0 then 'FULL_REFERENCE_VALIDATED' when run_id % 13 = 0 or run_id % 17 = 0 then 'FAILED' when n_orders > 5 then 'CANDIDATES_CONFIRMED' else 'NOT_RUN' end"


@query(f"select run_id, {_CERT_SQL} as certification, {_VALID_SQL} as validation, case when reb then 'FULL_REBUILD_RECOMMENDED' when fb is null or ub is null then 'NOT_EVALUATED' when fb >= ub then 'FULL_REBUILD_RECOMMENDED' when run_id % 7 <> 0 then 'NOT_EVALUATED' else 'TARGETED_REPAIR_RECOMMENDED' end as economics, case when run_id % 19 = 0 then 'FAILED' when run_id % 2 = 1 then 'SUCCEEDED' else 'PENDING' end as execution from {_RUNS_SQL}")
def assessment(spark, path):
    return repair.assessment(runs(spark, path)).select("run_id", "certification", "validation", "economics", "execution")


def _repairs(spark, path) -> DataFrame:
    k = F.col("run_id")
    out = repair.assessment(runs(spark, path))
    named = {"baseline": F.when(k % 8 != 0, "MATCHED").otherwise("MISMATCHED"), "repair": F.when(k % 9 == 0, "FAILED").when(k % 9 == 1, "SKIPPED").otherwise("SUCCEEDED"), "missing_rows": F.when(k % 10 != 0, F.greatest(F.lit(0).cast("bigint"), F.col("n_orders") - 12)), "extra_rows": F.lit(0).cast("bigint"), "mismatched_rows": F.lit(0).cast("bigint"), "duplicate_keys": F.lit(0).cast("bigint"), "deleted_rows": F.when(k % 23 != 0, F.col("n_orders")), "inserted_rows": F.col("n_orders"), "cleaned": k % 29 != 0}
    return out.withColumns(named)


@query(f"select run_id, coalesce({_CERT_SQL} <> 'UNCERTIFIED' and {_VALID_SQL} in ('FULL_REFERENCE_VALIDATED', 'CANDIDATES_CONFIRMED') and run_id % 8 <> 0 and run_id % 9 > 1 and run_id % 10 <> 0 and n_orders <= 12 and run_id % 23 <> 0 and run_id % 29 <> 0 and run_id % 19 <> 0, false) as safe from {_RUNS_SQL}")
def safe_to_apply(spark, path):
    rows = _repairs(spark, path)
    return rows.select("run_id", repair.safe_to_apply(rows).alias("safe"))


@query(f"select run_id, case when run_id % 9 <> 1 then case when run_id % 10 <> 0 then greatest(0, n_orders - 12) end else n_orders end as missing_result, case when run_id % 9 <> 1 then 0 else n_orders end::bigint as extra_result, case when run_id % 9 <> 1 then 0 else n_orders end::bigint as mismatched_result, case when run_id % 9 <> 1 then run_id % 9 <> 0 and run_id % 10 <> 0 and n_orders <= 12 and run_id % 29 <> 0 else false end as reference_validated from {_RUNS_SQL}")
def overlay(spark, path):
    proofs = _repairs(spark, path).drop("reference_validated").withColumns({f"proof_{n}": F.col("n_orders") for n in ("missing", "extra", "mismatched")}).withColumn("proof_validated", F.lit(False))
    return repair.overlay_repair(proofs).select("run_id", "missing_result", "extra_result", "mismatched_result", "reference_validated")


@query("""with j as (select l_orderkey as run_id, case when l_returnflag = 'R' then 'Full head' else 'targeted ' || l_linenumber end as phase, l_quantity::bigint as ms, case when l_linenumber % 3 <> 0 then l_partkey::bigint end as scanned, case when l_linenumber % 2 = 0 then l_suppkey::bigint end as total from lineitem),
t as (select run_id, sum(coalesce(total, scanned))::bigint as b, sum(ms)::bigint as ms from j where phase <> 'Full head' group by 1),
f as (select o_orderkey as run_id, case when o_orderkey % 5 <> 0 then o_totalprice::bigint % 9000 end as full_bytes, case when o_orderkey % 7 <> 0 then 120::bigint end as full_ms, case when o_orderkey % 3 = 0 then o_custkey end as c, 700 as fc from orders)
select f.run_id, b as targeted_bytes, full_bytes, ms as targeted_elapsed_ms, full_ms as full_elapsed_ms, case when c is not null then 'CREDITS' when b is not null and full_bytes is not null then 'BYTES_AND_TIME' else 'NONE' end as basis,
case when c is not null then case when c < fc then 'TARGETED_REPAIR_RECOMMENDED' else 'FULL_REBUILD_RECOMMENDED' end when b is not null and full_bytes is not null and ms is not null and full_ms is not null then case when b < full_bytes and ms < full_ms then 'TARGETED_REPAIR_RECOMMENDED' else 'FULL_REBUILD_RECOMMENDED' end else 'NOT_EVALUATED' end as decision from f left join t using (run_id)""".replace("o_totalprice::bigint", "floor(o_totalprice)::bigint").replace("l_quantity::bigint", "floor(l_quantity)::bigint"))
def economics(spark, path):
    t = Tables(spark, path)
    jobs = t["lineitem"].selectExpr("l_orderkey as run_id", "if(l_returnflag = 'R', 'Full head', concat('targeted ', l_linenumber)) as phase", "cast(floor(l_quantity) as bigint) as elapsed_ms", "if(l_linenumber % 3 <> 0, cast(l_partkey as bigint), null) as bytes_scanned", "if(l_linenumber % 2 = 0, cast(l_suppkey as bigint), null) as total_bytes_processed")
    full = t["orders"].selectExpr("o_orderkey as run_id", "if(o_orderkey % 5 <> 0, cast(floor(o_totalprice) as bigint) % 9000, null) as full_bytes", "if(o_orderkey % 7 <> 0, bigint(120), null) as full_elapsed_ms", "if(o_orderkey % 3 = 0, o_custkey, null) as credits", "700 as full_credits")
    return repair.economics(jobs, full)


@query("select o_orderkey, coalesce(max(l_partkey) < o_custkey, false) or coalesce(count(l_orderkey) < 4, false) as reduced from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_custkey")
def shows_reduction(spark, path):
    t = Tables(spark, path)
    li = t["lineitem"].groupBy("l_orderkey").agg(F.max("l_partkey").alias("p"), F.count(F.lit(1)).alias("n"))
    row = t["orders"].join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    reduced = repair.shows_reduction({"bytes_scanned": F.col("o_custkey"), "rows_produced": F.lit(4)}, {"bytes_scanned": F.col("p"), "rows_produced": F.coalesce("n", F.lit(0))})
    return row.select("o_orderkey", reduced.alias("reduced"))


_TESTS = "case l_linenumber when 1 then 'assert_sql_frontier_covers_reference' when 2 then 'assert_repaired_equals_reference' else 'other' end"
_STATE = "case when l_returnflag = 'R' then 'failed' when l_partkey % 3 = 0 then 'skipped' else 'passed' end"


@query(f"with c as (select l_orderkey as run_id, {_TESTS} as t, {_STATE} as s from lineitem) select run_id, case when count(*) filter (where s <> 'skipped') = 0 or count(*) filter (where s = 'failed') > 0 then 'none' when count(distinct t) filter (where s <> 'skipped' and t <> 'other') = 2 then 'empirically_validated' else 'aggregates' end as evidence, case when count(*) filter (where s = 'failed') > 0 then 'failed' else 'passed' end as status from c group by 1")
def check_summary(spark, path):
    return checks.summarize_checks(Tables(spark, path)["lineitem"].selectExpr("l_orderkey as run_id", f"{_TESTS} as test_name", f"{_STATE} as status"))


@query("select c as column_name, 0::bigint as null_count, d as distinct_count, d = n as is_unique from (select 'o_orderkey' as c, count(distinct o_orderkey) as d, count(*) as n from orders union all select 'o_custkey', count(distinct o_custkey), count(*) from orders union all select 'o_orderstatus', count(distinct o_orderstatus), count(*) from orders)")
def key_profile(spark, path):
    return checks.profile_keys(Tables(spark, path)["orders"], ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("select c as column_name, 0::bigint as null_count, d = n as is_unique from (select 'o_orderkey' as c, count(distinct o_orderkey) as d, count(*) as n from orders union all select 'o_custkey', count(distinct o_custkey), count(*) from orders union all select 'o_orderstatus', count(distinct o_orderstatus), count(*) from orders union all select 'o_totalprice', count(distinct o_totalprice), count(*) from orders)")
def unique_columns(spark, path):
    """From sketches by order status that are merged, with exact counts only where these leave it open."""
    orders, cols = Tables(spark, path)["orders"], ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    found = checks.unique_columns(orders, cols, checks.key_sketches(orders, cols, ["o_orderstatus"]))
    return found.select("column_name", "null_count", "is_unique")


# ---------------------------------------------------------------- catalogs and lineage derived from parts and schemas
def _edges(spark, path) -> DataFrame:
    """Each part below the one with half its number."""
    return Tables(spark, path)["part"].where("p_partkey > 1").selectExpr("concat('p', p_partkey div 2) as parent", "concat('p', p_partkey) as child")


_EDGES_SQL = "(select 'p' || (p_partkey // 2) as parent, 'p' || p_partkey as child from part where p_partkey > 1)"


@query(f"with recursive r as (select child as node from {_EDGES_SQL} where parent = 'p5' union select e.child from {_EDGES_SQL} e join r on e.parent = r.node) select node from r")
def closure_down(spark, path):
    return lineage.closure(_edges(spark, path), ["p5"], "down")


@query(f"with recursive r as (select parent as node from {_EDGES_SQL} where child in ('p150', 'p77') union select e.parent from {_EDGES_SQL} e join r on e.child = r.node) select node from r")
def closure_up(spark, path):
    return lineage.closure(_edges(spark, path), ["p150", "p77"], "up")


def _catalogs(spark, path) -> tuple[DataFrame, DataFrame]:
    part = Tables(spark, path)["part"]
    base = part.where("p_partkey % 10 <> 0").selectExpr("concat('p', p_partkey) as name", "concat('SELECT ', p_partkey, ' -- old') as text")
    head = part.where("p_partkey % 10 <> 1").selectExpr("concat('p', p_partkey) as name", "concat('select  ', if(p_partkey % 10 = 2, p_partkey + 1, p_partkey)) as text")
    return base, head


_CATALOG_DIFF_SQL = "select 'p' || p_partkey as name, case p_partkey % 10 when 0 then 'added' when 1 then 'removed' else 'modified' end as change from part where p_partkey % 10 < 3"


@query(_CATALOG_DIFF_SQL)
def catalog_diff(spark, path):
    return lineage.catalog_diff(*_catalogs(spark, path), "name", "text")


@query(f"with recursive r(ancestor, node) as (select parent, child from {_EDGES_SQL} union select r.ancestor, e.child from {_EDGES_SQL} e join r on e.parent = r.node) select name, change, coalesce(string_agg(node, ',' order by node), '') as downstream from ({_CATALOG_DIFF_SQL}) left join r on ancestor = name group by all")
def catalog_downstream(spark, path):
    found = lineage.catalog_diff(*_catalogs(spark, path), "name", "text", _edges(spark, path))
    return found.select("name", "change", F.array_join("downstream", ",").alias("downstream"))


@query("select sha256('[' || string_agg('{\"key\":\"' || n || '\",\"fingerprint\":\"' || f || '\"}', ',' order by n) || ']') as catalog_fingerprint from (select 'p' || p_partkey as n, sha256('select ' || p_partkey) as f from part where p_partkey % 10 <> 0)")
def catalog_fingerprint(spark, path):
    base, _ = _catalogs(spark, path)
    return lineage.catalog_fingerprint(base.withColumn("f", scalars.text_fingerprint(F.col("text"))), "name", "f")


@query("select p_brand as fingerprint, max(p_size)::int as downstream, arg_max(p_partkey::varchar, (p_size, p_partkey::varchar)) as name from part group by 1 order by downstream desc, name desc limit 1")
def canonical_pick(spark, path):
    return keys.pick_canonical(Tables(spark, path)["part"].selectExpr("p_brand as fingerprint", "cast(p_partkey as string) as name", "cast(p_size as int) as downstream"))


@query("select * from (values ('customer', 'orders', 'VERIFIED', 'custkey'), ('orders', 'lineitem', 'VERIFIED', 'orderkey'), ('nation', 'customer', 'VERIFIED', 'nationkey'), ('customer', 'lineitem', 'UNRESOLVED', null)) t(upstream, downstream, status, join_column)")
def derived_routes(spark, path):
    """Join columns along lineage edges, from the tables' columns (prefix dropped) and the uniqueness that their rows show."""
    t = sources(spark, path, "nation", "customer", "orders", "lineitem")
    columns = spark.createDataFrame([(n, c.split("_", 1)[1]) for n, df in t.items() for c in df.columns], "table_name string, column_name string")
    unique = None
    for n, df in t.items():
        one = checks.profile_keys(df, [c for c in df.columns if c.endswith("key")]).where("is_unique").select(F.lit(n).alias("table_name"), F.substring_index("column_name", "_", -1).alias("column_name"))
        unique = one if unique is None else unique.union(one)
    edges = spark.createDataFrame([("customer", "orders"), ("orders", "lineitem"), ("nation", "customer"), ("customer", "lineitem")], "parent string, child string")
    return lineage.derive_routes(columns, edges, unique, "custkey")


@query("""with recursive e as (select p_partkey as i, p_partkey // 2 as j, (p_partkey // 2) % 7 <> 0 as c, p_partkey % 5 = 0 as x from part where p_partkey > 1),
r(i, route, cols, amb) as (select 1::bigint, 'p1', '', false union all
select e.i::bigint, 'p' || e.i || ' -> ' || route, case when c and x then '?' when c then 'c' || j else 'x' || j end || case when cols <> '' then ', ' || cols else '' end, amb or (c and x) from e join r on e.j = r.i where c or x)
select 'p' || e.i as upstream, case when r.i is null then 'UNRESOLVED' when amb then 'AMBIGUOUS' else 'VERIFIED' end as status, route, cols as join_columns from e left join r on r.i = e.i""")
def route_chains(spark, path):
    """Chains of routes to one table from a table per part, each of which has a link to that with half its number: the columns and
    their uniqueness decide which hops are known."""
    part = Tables(spark, path)["part"].where("p_partkey > 0").selectExpr("p_partkey as i", "p_partkey div 2 as j")
    own = part.selectExpr("concat('p', i) as table_name", "explode(array(concat('c', i), concat('x', i))) as column_name")
    link = part.where("i > 1").selectExpr("concat('p', i) as table_name", "explode(if(i % 5 = 0, array(concat('c', j), concat('x', j)), array(concat('c', j)))) as column_name")
    unique = part.selectExpr("concat('p', i) as table_name", "explode(if(i % 7 <> 0, array(concat('c', i), concat('x', i)), array(concat('x', i)))) as column_name")
    edges = part.where("i > 1").selectExpr("concat('p', i) as parent", "concat('p', j) as child")
    return lineage.derive_chains(lineage.derive_routes(own.union(link), edges, unique, "none"), "p1")
