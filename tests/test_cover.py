"""Soundness of candidate keys: no truly changed key is ever missed."""

import random

import pytest
from pyspark.sql import functions as F

from martmend.operators import compare, keys, repair
from martmend.plans import cover, spec

AGG = (("n", "count(id)"), ("total", "sum(price)"), ("low", "min(price)"), ("high", "max(price)"), ("states", "count(distinct status)"))
ON = (("customer_id", "o_customer"),)
CUSTOMERS = [(1, "A", "Y"), (2, "B", "Y"), (3, "C", "Y"), (4, "D", "N")]
ORDERS = [(10, 1, "F", 10), (11, 1, "P", 11), (20, 2, "F", 20), (30, 3, "O", 30), (40, 4, "P", 40)]
NATIONS = [(1, 1, "X"), (2, 2, "Y"), (3, 3, None)]


def tables(spark, customers=CUSTOMERS, orders=ORDERS, nations=NATIONS):
    return {
        "customers": spark.createDataFrame(customers, "customer_id int, name string, active string"),
        "orders": spark.createDataFrame(orders, "id int, o_customer int, status string, price int"),
        "nations": spark.createDataFrame(nations, "nation_id int, n_customer int, nation string"),
    }


def mart(how="left", name="orders", predicate="status = 'F'", second=None):
    joins = [spec.Join("orders", ON, how)]
    if second:
        joins.append(spec.Join("nations", (("customer_id", "n_customer"),), second))
    return spec.MartSpec("customers", "customer_id", AGG, tuple(joins), ((name, predicate),))


def check(old, new, src):
    found = cover.candidate_keys(old, new, src)
    assert found.status == cover.COMPILED
    before, after = spec.build_mart(old, src), spec.build_mart(new, src)
    changed = {r[0] for r in compare.changed_keys(before, after, "customer_id").collect()} - {None}
    got = {r[0] for r in found.keys.collect()}
    assert changed <= got
    head = spec.targeted(new, src, found.keys)
    fixed = repair.repaired(before.where("customer_id is not null"), head, found.keys, "customer_id")
    assert compare.compare_tables(fixed, after.where("customer_id is not null"), "customer_id").first().reason is None
    return changed, got


@pytest.mark.parametrize("how", ["left", "inner"])
def test_filter_flip(spark, how):
    changed, got = check(mart(how), mart(how, predicate="status in ('F', 'O')"), tables(spark))
    assert changed == {3}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_null_predicates_keys_and_copies(spark, how):
    src = tables(spark, [*CUSTOMERS, (None, "N", "Y"), (2, "B", "Y")], [*ORDERS, (50, None, "O", 5), (51, 1, None, 7)])
    check(mart(how), mart(how, predicate="status <> 'P'"), src)


def test_last_match_removed_and_left_side_filter(spark):
    src = tables(spark)
    assert check(mart("inner"), mart("inner", predicate="status = 'F' and price > 15"), src)[0] == {1}
    assert check(mart(name="customers", predicate="active = 'Y'"), mart(name="customers", predicate="active is not null"), src)[0] == {4}


@pytest.mark.parametrize("second", ["left", "inner"])
def test_second_join(spark, second):
    check(mart(second=second), mart(predicate="status in ('F', 'O', 'P')", second=second), tables(spark))


def test_random_tables_and_predicates(spark):
    rng = random.Random(4)
    some = ["status = 'F'", "status in ('F', 'O')", "price > 20", "price > 25 or status = 'P'", "status is null", "not status = 'O'"]
    for _ in range(8):
        customers = [(rng.choice([None, *range(6)]), "c", "Y") for _ in range(6)]
        orders = [(i, rng.choice([None, *range(7)]), rng.choice([None, "F", "O", "P"]), rng.randrange(40)) for i in range(12)]
        nations = [(i, rng.choice([None, *range(6)]), "n") for i in range(4)]
        old, new = rng.sample(some, 2)
        how, second = rng.choice(["left", "inner"]), rng.choice([None, "left", "inner"])
        check(mart(how, predicate=old, second=second), mart(how, predicate=new, second=second), tables(spark, customers, orders, nations))


def test_fails_closed(spark):
    src = tables(spark)
    base = mart()
    for new in (base.with_filter("customers", "active = 'Y'").with_filter("orders", "price > 1"), spec.MartSpec("customers", "customer_id", AGG[:1], base.joins, base.filters), mart("inner"), mart(predicate="1 / price > 0"), mart(predicate="rand() > 0.5"), mart(predicate="cast(status as int) = 1")):
        found = cover.candidate_keys(base, new, src)
        assert found.status == cover.REBUILD and found.keys is None and found.reasons
    same = cover.candidate_keys(base, base, src)
    assert same.status == cover.NO_CHANGE and same.keys.count() == 0
    with pytest.raises(spec.Unsupported):
        cover.cover_project(src["orders"], {"price * 2": "x"})


def test_threshold_repair(spark):
    customers = [(i, n, "Y") for i, n in enumerate(("Alice", "Bob", "Carol", "Dan", "Eve"), 1)]
    orders = [(1, 1, "F", 25), (2, 1, "F", 50), (3, 2, "F", 60), (4, 2, "F", 10), (5, 3, "F", 35), (6, 3, "F", 12), (7, 4, "F", 20), (8, 4, "F", 90), (9, 5, "F", 29), (10, 5, "F", 31), (11, 5, "F", 5), (12, 3, "F", 30)]
    assert check(mart(predicate="price >= 20"), mart(predicate="price >= 30"), tables(spark, customers, orders))[0] == {1, 4, 5}


def test_two_origins_do_not_multiply_rows(spark):
    src = tables(spark)
    some = spark.createDataFrame([(1,), (2,), (None,)], "customer_id int")
    both = keys.affected_keys(some, some)
    assert both.count() == 4
    rows = {r.customer_id: r.n for r in spec.targeted(mart(), src, both).collect()}
    assert rows == {1: 1, 2: 1}
    with pytest.raises(ValueError, match="NO_CANDIDATES"):
        keys.affected_keys()


def test_comparison_cases(spark):
    base = [("1", "Ada", 10), ("2", "Bea", 20), ("3", None, 30), (None, None, 10)]
    frame = lambda rows: spark.createDataFrame(rows, "customer_id string, customer_name string, n int")
    cases = {
        (0, 0, 0, 0, None): base,
        (1, 0, 0, 0, "ROWS_DIFFER"): base[1:],
        (0, 1, 0, 0, "ROWS_DIFFER"): [*base, ("4", "Dee", 40)],
        (0, 0, 1, 0, "ROWS_DIFFER"): [("1", "Ada", 11), *base[1:]],
        (0, 0, 0, 1, "GRAIN_VIOLATED"): [*base, base[0]],
    }
    for want, rows in cases.items():
        assert tuple(compare.compare_tables(frame(rows), frame(base), "customer_id").first()) == want
    assert compare.compare_tables(frame(base).drop("n"), frame(base), "customer_id").first().reason == "SCHEMA_MISALIGNED"
    assert repair.verify_baseline(frame(base), frame(base), "customer_id", F.lit(False)).first().status == "FAILED"
    refused = repair.validate_repair(frame(base), frame(base), frame(base), frame(base), "customer_id", baseline="MISMATCHED").first()
    assert (refused.status, refused.reason) == ("FAILED", "BASELINE_NOT_MATCHED")
    with pytest.raises(Exception, match="more confirmed"):
        spark.range(1).select(compare.no_op_count(F.lit(1), F.lit(2))).collect()
