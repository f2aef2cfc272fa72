"""Plans and behaviour behind the queries: proofs in one pass, repair by partition, closures in log rounds, pairing over micro-batches, pruned
history, comparison in two levels, compacted states, shared lookups, identity trees, sketches."""

import os
import re

import pytest
from pyspark.sql import functions as F

from martmend import catalog
from martmend.operators import checks, compare, keys, lineage, repair
from martmend.operators.workspace import Workspace
from martmend.plans import spec
from martmend.sources import files
from martmend.streaming import batchlog, cdc

SF = "/root/testdata/sf0.001"


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, name):
    return len(re.findall(rf"FileScan parquet [^\n]*{name}\b", plan(df)))


# ---------------------------------------------------------------- proofs
def test_proofs_read_each_source_once_for_a_definition(spark):
    src, found, before, after = catalog._left(spark, SF)
    with Workspace(spark) as work:
        listed = work.put("keys", found)
        head = work.put("head", spec.targeted(catalog.left_mart(catalog.NEW), src, listed))
        proof = compare.change_proof(before, after, listed, head, "c_custkey")
        assert {n: scans(proof, n) for n in ("/orders.parquet", "/customer.parquet", "/keys", "/head")} == {"/orders.parquet": 2, "/customer.parquet": 2, "/keys": 1, "/head": 1}
        small = compare.targeted_proof(before, listed, head, "c_custkey")
        # The keys are read to restrict the mart, and as such.
        assert {n: scans(small, n) for n in ("/orders.parquet", "/customer.parquet", "/keys", "/head")} == {"/orders.parquet": 1, "/customer.parquet": 1, "/keys": 2, "/head": 1}


def plain_proof(before, after, listed, head):
    from collections import Counter

    rows = Counter(r for r in before if r[0] is None or r[0] not in listed) + Counter(head)
    differ = (Counter(before) - Counter(after)) + (Counter(after) - Counter(before))
    changed = {r[0] for r in differ if r[0] is not None}
    wrong = (rows - Counter(after)) + (Counter(after) - rows)
    return len(before), len(after), len(listed), len(changed), len(changed - listed), len(listed - changed), sum(wrong.values())


def test_change_proof_against_plain_sets(spark):
    before = [(1, 10, "a"), (2, 20, None), (2, 20, None), (3, 30, "c"), (None, 5, "n"), (None, 5, "n"), (6, 0, "x")]
    after = [(1, 10, "a"), (2, 20, None), (3, 31, "c"), (4, 40, ""), (None, 5, "n"), (None, 6, "n")]
    for listed, head in (({2, 3, 4, 6}, [(2, 20, None), (3, 31, "c"), (4, 40, "")]), ({1, 3}, [(1, 10, "a"), (3, 30, "c"), (9, 9, "stray")]), (set(), [])):
        frames = [spark.createDataFrame(rows, "k int, n int, t string") for rows in (before, after, head)]
        row = compare.change_proof(frames[0], frames[1].select("t", "k", "n"), spark.createDataFrame([(k,) for k in listed], "k long"), frames[2], "k").first()
        expected = plain_proof(before, after, listed, head)
        assert tuple(row)[:7] == expected and row.passed == (expected[4] == expected[6] == 0)


# ---------------------------------------------------------------- comparison in two levels
def test_buckets_tell_equal_marts_without_a_join_and_others_exactly(spark, monkeypatch):
    rows = [(i, i % 7, str(i)) for i in range(300)] + [(None, 1, "n")]
    a = spark.createDataFrame(rows, "k long, n int, t string")
    calls = []
    exact = compare.compare_tables
    monkeypatch.setattr(compare, "compare_tables", lambda *x: calls.append(x[0].count()) or exact(*x))
    assert tuple(compare.compare_by_buckets(a, a.orderBy(F.desc("k")), "k").first()) == (0, 0, 0, 0, None) and not calls
    doubled = a.union(a.where("k = 5"))
    assert tuple(compare.compare_by_buckets(doubled, doubled, "k").first()) == (0, 0, 0, 1, "GRAIN_VIOLATED") and not calls
    b = spark.createDataFrame([(i, n + (i == 9), t) for i, n, t in rows if i != 3] + [(1000, 0, "")] + [(20, 1, "again")], "k long, n int, t string")
    assert tuple(compare.compare_by_buckets(b, a, "k").first()) == tuple(exact(b, a, "k").first()) and len(calls) == 1
    assert calls[0] < 20  # rows of the buckets that differ
    assert compare.compare_by_buckets(b.drop("t"), a, "k").first().reason == "SCHEMA_MISALIGNED"


# ---------------------------------------------------------------- repair by partition
def names_and_times(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_repair_touches_its_partitions_only(spark, tmp_path):
    mart = repair.PartitionedMart(spark, f"file://{tmp_path}/m", "k", parts=16)
    mart.create(spark.createDataFrame([(i, i) for i in range(200)] + [(None, 7)], "k int, n long"))
    was = names_and_times(tmp_path / "m")
    touched = mart.repair(spark.createDataFrame([(3, 30), (500, 1)], "k int, n int"), spark.createDataFrame([(3,), (4,), (500,)], "k long"))
    now = names_and_times(tmp_path / "m")
    same = {f for f in was if int(re.search(r"__part=(\d+)", f)[1]) not in touched}
    assert 0 < len(touched) <= 3 and same and all(now[f] == was[f] for f in same) and not (set(was) - same) & set(now)
    expected = sorted([(i, 30 if i == 3 else i) for i in range(200) if i != 4] + [(500, 1)])
    assert sorted(tuple(r) for r in mart.read().where("k is not null").collect()) == expected and mart.read().where("k is null").count() == 1
    assert mart.repair(spark.createDataFrame([], "k int, n long"), spark.createDataFrame([], "k int")) == []


def test_repair_restarts_after_a_failure(spark, tmp_path, monkeypatch):
    mart = repair.PartitionedMart(spark, f"file://{tmp_path}/m", "k", parts=8)
    rows = [(i, i) for i in range(40)]
    mart.create(spark.createDataFrame(rows, "k int, n long"))
    part = {r.k: r.p for r in spark.read.parquet(mart.path).selectExpr("k", "__part as p").collect()}
    gone = [k for k in part if part[k] == part[0]]  # a whole partition vanishes
    head, listed = spark.createDataFrame([(39, -1)], "k int, n long"), spark.createDataFrame([(k,) for k in {*gone, 39}], "k int")
    published = repair.PartitionedMart.resume

    def dies(self):
        if self._exists(f"{self.stage}/rows/_SUCCESS"):
            raise RuntimeError("lost")
        return published(self)

    monkeypatch.setattr(repair.PartitionedMart, "resume", dies)
    with pytest.raises(RuntimeError):
        mart.repair(head, listed)
    assert sorted(map(tuple, mart.read().collect())) == rows  # nothing has changed yet
    monkeypatch.setattr(repair.PartitionedMart, "resume", published)
    assert mart.resume() and not mart.resume()
    expected = sorted([(k, n) for k, n in rows if k not in gone and k != 39] + [(39, -1)])
    assert sorted(map(tuple, mart.read().collect())) == expected
    (tmp_path / "m__stage/rows").mkdir(parents=True)  # a stage that was never completed
    assert not mart.resume() and sorted(map(tuple, mart.read().collect())) == expected
    mart.repair(head, listed)  # again: the same result
    assert sorted(map(tuple, mart.read().collect())) == expected


# ---------------------------------------------------------------- closures
def test_long_chains_take_few_rounds(spark):
    chain = spark.range(1_000).selectExpr("concat('n', id) as parent", "concat('n', id + 1) as child")
    rounds = []
    assert lineage.closure(chain, ["n0"], rounds=rounds).count() == 1_000 and len(rounds) <= 15
    rounds = []
    assert lineage.closure(chain, ["n1000", "n400"], "up", rounds=rounds).count() == 1_000 and len(rounds) <= 15
    rounds = []
    of = spark.createDataFrame([("n990",), ("n0",), ("none",)], "name string")
    assert lineage.descendants(chain, of, rounds).count() == 1_010 and len(rounds) <= 15


@pytest.mark.parametrize("growth", [0, 1, 4])
def test_reach_equals_a_plain_search(spark, monkeypatch, growth):
    import random

    monkeypatch.setattr(lineage, "GROWTH", growth)
    monkeypatch.setattr(lineage, "TABLES", 2)
    rng = random.Random(growth)
    links = {(rng.randrange(40), rng.randrange(40)) for _ in range(45)} | {(i, i + 1) for i in range(50, 70)} | {(70, 50)}

    def below(start):
        seen, todo = set(), [start]
        while todo:
            at = todo.pop()
            for a, b in links:
                if a == at and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    edges = spark.createDataFrame(list(links), "parent int, child int")
    assert {(r.ancestor, r.node) for r in lineage.descendants(edges).collect()} == {(a, b) for a in {a for a, _ in links} for b in below(a)}
    assert {r.node for r in lineage.closure(edges, [0, 55]).collect()} == below(0) | below(55)


def test_work_tables_are_removed(spark, tmp_path):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    was = {n for n in os.listdir(base) if n.startswith("run-")}
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "parent string, child string")
    found = [lineage.closure(edges, ["a"]), lineage.descendants(edges), keys.placed(spark.createDataFrame([("2",), ("1",)], "entity_value string"))]
    assert {n for n in os.listdir(base) if n.startswith("run-")} == was
    assert [f.count() for f in found] == [2, 3, 2]


# ---------------------------------------------------------------- change data capture
RAW = "action string, is_update boolean, row_id string, primary_key string, target_key string, at timestamp"


def feed(spark, path, rows):
    typed = spark.createDataFrame([(*r[:5], r[5]) for r in rows], RAW.replace("at timestamp", "at string")).withColumn("at", F.col("at").cast("timestamp"))
    typed.coalesce(1).write.mode("append").parquet(path)


def test_a_pair_over_two_files_is_one_update(spark, tmp_path):
    path, log = f"file://{tmp_path}/feed", batchlog.BatchLog(spark, f"file://{tmp_path}/log", project="m")

    def run():
        stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(path)
        log.consume_paired(stream, f"file://{tmp_path}/checkpoint", "s", "at", "1 hour", model="orders", provider="demo").awaitTermination()

    feed(spark, path, [("DELETE", True, "r1", "1", "370", "2024-01-01 10:00:00"), ("INSERT", False, "r2", "2", "5", "2024-01-01 10:00:01"), ("DELETE", True, "lost", "9", "9", "2024-01-01 10:00:02")])
    run()
    assert [r.provider_row_id for r in log.events().collect()] == ["r2"]
    feed(spark, path, [("INSERT", True, "r1", "1", "781", "2024-01-01 10:20:00")])
    run()
    update = log.events().where("operation = 'UPDATE'").collect()
    assert [(u.provider_row_id, u.target_key_before, u.target_key_after, u.source_model, u.source_relation, u.provider) for u in update] == [("r1", "370", "781", "orders", "s", "demo")]
    assert {r.entity_key for r in cdc.route_cdc(log.events()).collect()} == {"370", "781", "5"}
    assert log.leftovers().count() == 0
    feed(spark, path, [("DELETE", False, "r3", "3", "6", "2024-01-02 10:00:00")])  # the watermark passes
    run()
    assert [(r.row_id, r.action, r.target_key) for r in log.leftovers().collect()] == [("lost", "DELETE", "9")]
    states = {r.batch_id: r for r in log.batches().collect()}
    failed = [r for r in states.values() if r.status == "FAILED"]
    assert [(r.error_code, r.raw_record_count) for r in failed] == [("UNPAIRED_RECORDS", 1)]
    captured = [r for r in states.values() if r.status == "CAPTURED"]
    assert sorted((r.raw_record_count, r.logical_event_count) for r in captured) == [(1, 1), (1, 1), (2, 1)]
    assert all(r.project_name == "m" and r.stream_relation == "s" and r.started_at <= r.captured_at and r.completed_at is None for r in captured)


def test_history_reads_the_folders_of_its_digits(spark, tmp_path):
    log = batchlog.BatchLog(spark, f"file://{tmp_path}/log")
    raw = spark.createDataFrame([("INSERT", False, f"r{i}", str(i), str(i)) for i in range(60)], "action string, is_update boolean, row_id string, primary_key string, target_key string")
    assert log.capture(raw, "b1", "s") == "CAPTURED"
    one = cdc.paired(raw.limit(1), "s")
    past = log.history(one, "b2")
    text = plan(past)
    assert "PartitionFilters" in text and re.search(r"ReadSchema: struct<payload_fingerprint:string>", text)
    found = set(past.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
    assert 0 < past.count() < 60 and len({re.search("digit=(.)", f)[1] for f in found}) == 1
    assert log.capture(raw.where("row_id = 'r7'"), "b2", "s") == "FAILED" and log.state("b2").error_code == "DUPLICATE_EVENT"
    assert log.capture(raw.where("row_id = 'r7'").withColumn("target_key", F.lit("x")), "b2", "s") == "CAPTURED"  # repaired and taken anew
    assert log.events().where("batch_id = 'b2'").count() == 1
    assert set(batchlog.EVENT.replace(", ", " ").split(" ")[::2]) - {"digit"} == set(log.events().columns)


def test_states_stay_few_files(spark, tmp_path):
    log = batchlog.BatchLog(spark, f"file://{tmp_path}/log", moves=5)
    names = [f.split(" ")[0] for f in batchlog.STATE.split(", ")]
    many = spark.range(1_000).select(F.concat(F.lit("b"), "id").alias("batch_id"), F.lit("m").alias("project_name"), F.lit("s").alias("stream_relation"), F.lit(0).cast("long").alias("seq"), F.lit("COMPLETED").alias("status"), *[F.lit(None).alias(n) for n in names[5:]])
    for i in range(18):
        log.append_states(many.where(f"id % 18 = {i}").select(*[F.col(f.split(" ")[0]).cast(f.split(" ")[1]) for f in batchlog.STATE.split(", ")]))
    log.move("new", "CAPTURING", stream_relation="s")
    log.move("new", "CAPTURED", raw_record_count=3)
    assert len(log.states().inputFiles()) <= 5 + 2 and log.states().count() >= 1_001
    row = log.state("new")
    assert (row.seq, row.status, row.raw_record_count, row.stream_relation) == (1, "CAPTURED", 3, "s") and row.started_at <= row.captured_at
    (tmp_path / f"log/states/snapshot-{log._generation() + 1}").mkdir()  # a compaction that died
    assert log.state("new").status == "CAPTURED"
    log.compact()
    assert log.states().count() == 1_001 and log.state("b7").status == "COMPLETED"
    assert batchlog.newest_unpublished(log.states(), log.proofs()).count() == 1
    assert [r.batch_id for r in log.batches(project="m").limit(3).collect()] == ["b0", "b1", "b10"]
    with pytest.raises(cdc.BatchFailed, match="STATE_CAPTURED_TO_COMPLETED"):
        log.move("new", "COMPLETED")


def test_proof_counts_both_origins(spark, tmp_path):
    log = batchlog.BatchLog(spark, f"file://{tmp_path}/log", project="m")
    raw = spark.createDataFrame([("INSERT", False, "r1", "1", "5"), ("DELETE", False, "r2", "2", "6")], "action string, is_update boolean, row_id string, primary_key string, target_key string")
    assert log.capture(raw, "b1", "s") == "CAPTURED"
    mart = spark.createDataFrame([(5, 1), (6, 1), (7, 1)], "k int, n int")
    head = spark.createDataFrame([(5, 2), (6, 1), (7, 3)], "k int, n int")
    changed = spark.createDataFrame([(6,), (7,), (None,)], "k int")
    proof = log.prove("b1", lambda k: head.join(k, "k", "left_semi"), mart, "k", changed=changed, query_fingerprint="q").first()
    assert (proof.candidate_count, proof.sql_change_candidate_count, proof.union_candidate_count, proof.confirmed_change_count, proof.no_op_count) == (2, 2, 3, 2, 1)
    assert proof.event_routing_validated and proof.targeted_rows_compared and not proof.whole_table_reference_executed and (proof.query_fingerprint, proof.missed_event_count) == ("q", 0)
    row = log.batches(status="COMPLETED").first()
    assert row.union_candidate_count == 3 and row.completed_at is not None


# ---------------------------------------------------------------- routing, identities, sketches
def test_routes_share_their_lookups(spark, monkeypatch):
    ways = {n: keys.steps_of(r, "c_custkey") for n, r in catalog.ROUTES.items()}
    assert ways == {"customer": [], "orders": [("orders", "o_orderkey", "o_custkey")], "lineitem": [("orders", "o_orderkey", "o_custkey"), ("customer", "c_custkey", "c_custkey")]}
    assert [len(takers) for _, takers in keys.hop_order(ways)] == [2, 1]
    with Workspace(spark) as work:
        feed = work.put("feed", catalog.change_feed(spark, SF))
        plans = []
        put = Workspace.put
        monkeypatch.setattr(Workspace, "put", lambda self, name, df: plans.append(df) or put(self, name, df))
        found = keys.affected_entities(feed, catalog.ROUTES, catalog._route_tables(spark, SF), "c_custkey", "customer", work=work)
        assert [sum(scans(df, f"/{n}.parquet") for df in (*plans, found)) for n in ("orders", "customer", "lineitem")] == [1, 1, 0]
        assert found.count() == 150


def test_lookups_in_another_order_and_typed_values(spark):
    ways = {"a": [("t", "x", "y"), ("u", "y", "z")], "b": [("u", "y", "z"), ("t", "x", "y")], "c": [("u", "y", "z")], "d": []}
    order = keys.hop_order(ways)
    for name, way in ways.items():
        assert [s for s, takers in order if name in takers] == way
    tables = {"t": spark.createDataFrame([(1, 10), (2, None), (1, 11)], "x int, y long"), "u": spark.createDataFrame([(10, "k1"), (11, "k2"), (5, "1")], "y int, z string")}
    routes = {n: keys.Route("path", "v_id", sum([((t, a), (t, b)) for t, a, b in w], ())) for n, w in ways.items() if w}
    routes["e"] = keys.Route("direct", "k")
    rows = [("e1", "a", "1", None, 1), ("e2", "a", "01", None, 2), ("e3", "b", "5", "p", 3), ("e4", "c", "11", None, 4), ("e5", "a", None, None, 5), ("e6", "a", "2", None, 6), ("e7", "e", "k9", None, 7)]
    events = spark.createDataFrame(rows, "event_id string, source_model string, entity_value string, prior_entity_value string, position int")
    got = {r.entity_value: r.reason for r in keys.affected_entities(events, routes, tables, "k", "mart").collect()}
    assert got == {"k1": "V 1 belongs to mart", "k2": "V 1 belongs to mart", "10": "V 5 belongs to mart", "11": "V 5 belongs to mart", "p": "Before-image supplied mart", "k9": "Direct mart key"}


def test_identity_tree_names_the_part_that_changed(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(40).selectExpr("id", "id % 2 as a", "id % 4 as b").write.partitionBy("a", "b").parquet(path)
    pins = files.pin(spark, {"t": path})
    assert files.verify_pin(pins) and files.changed_parts(pins, "t").count() == 0
    spark.range(1).write.mode("append").parquet(f"{path}/a=1/b=3")
    spark.range(1).write.parquet(f"{path}/a=9/b=9")
    got = {r.part: r.change for r in files.changed_parts(pins, "t").collect()}
    assert got == {"": "modified", "a=1": "modified", "a=1/b=3": "modified", "a=9": "added", "a=9/b=9": "added"}
    with pytest.raises(ValueError, match="SOURCE_CHANGED: t in a=1/b=3"):
        files.read_pinned(pins, "t")
    tree = {r.part: r.files for r in files.identity_tree(spark, path).collect()}
    assert tree[""] == sum(n for p, n in tree.items() if p.count("/") == 0 and p)


def test_sketches_merge_and_decide_uniqueness(spark):
    df = spark.range(5_000).selectExpr("id", "id % 10 as day", "id div 2 as pair", "if(id = 7, null, id) as holed", "if(id = 7, 8, id) as twice", "cast(id as string) as text")
    cols = ["id", "day", "pair", "holed", "twice", "text"]
    kept = checks.key_sketches(df.where("day < 5"), cols, ["day"]).union(checks.key_sketches(df.where("day >= 5"), cols, ["day"]))
    rough = {r.column_name: r for r in checks.merged_profile(kept).collect()}
    assert rough["day"].estimate == 10 and rough["holed"].nulls == 1 and all(r.rows == 5_000 for r in rough.values()) and abs(rough["pair"].estimate - 2_500) < 250
    got = {r.column_name: (r.near_unique, r.is_unique) for r in checks.unique_columns(df, cols, kept).collect()}
    assert got == {"id": (True, True), "day": (False, False), "pair": (False, False), "holed": (False, False), "twice": (True, False), "text": (True, True)}


def test_unused_columns_are_not_read(spark):
    """What only other columns of a source are good for never reaches a shuffle or the scan."""
    src, found, before, _ = catalog._left(spark, SF)
    for df in (before, spec.targeted(catalog.left_mart(catalog.NEW), src, found), found):
        read = re.findall(r"FileScan parquet [^\n]*orders.parquet[^\n]*ReadSchema: struct<([^>]*)>", plan(df))
        assert read and all({c.split(":")[0] for c in r.split(",")} <= {"o_orderkey", "o_custkey", "o_totalprice"} for r in read)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_totalprice", plan(before))


def test_no_single_task_writes_a_feed(spark, monkeypatch):
    from martmend.operators.workspace import Workspace

    parts, put = {}, Workspace.put

    def seen(self, name, df):
        parts[name] = df.rdd.getNumPartitions()
        return put(self, name, df)

    class Written(Exception):
        pass

    def stop(*args, **more):
        raise Written

    monkeypatch.setattr(Workspace, "put", seen)
    monkeypatch.setattr(batchlog, "BatchLog", stop)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        for f in (catalog.captured_events, catalog.paired_events):
            with pytest.raises(Written):
                f(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert set(parts) == {"feed", "feed/DELETE", "feed/INSERT"} and min(parts.values()) > 1
