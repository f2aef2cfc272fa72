"""Change data capture in batches and micro-batches."""

import pytest
from pyspark.sql import functions as F

from martmend.streaming import batchlog, cdc

RAW = "action string, is_update string, row_id string, primary_key string, target_key string"
PAIR = [("DELETE", "true", "r1", "1", "370"), ("insert ", "1", "r1", "1", "781")]


def decoded(spark, rows):
    return cdc.decode_cdc(spark.createDataFrame(rows, RAW), "action", "is_update", "row_id", "primary_key", "target_key")


def test_pairs_and_keys(spark):
    rows = [*PAIR, ("INSERT", "no", "r2", "2", "5"), ("DELETE", None, "r3", "3", " 6 ")]
    events = cdc.normalize_cdc(decoded(spark, rows), "s")
    assert {r.row_id: r.operation for r in events.collect()} == {"r1": "UPDATE", "r2": "INSERT", "r3": "DELETE"}
    assert {r.entity_key: r.event_count for r in cdc.route_cdc(events).collect()} == {"370": 1, "781": 1, "5": 1, "6": 1}
    assert cdc.batch_fingerprint(events).first() == cdc.batch_fingerprint(events.orderBy(F.desc("row_id"))).first()


@pytest.mark.parametrize(
    ("rows", "code"),
    [
        ([PAIR[0]], "UNPAIRED_RECORDS"),
        ([*PAIR, PAIR[1]], "UNPAIRED_RECORDS"),
        ([("INSERT", "no", "r", "1", "2")] * 2, "UNPAIRED_RECORDS"),
        ([("UPSERT", "no", "r", "1", "2")], "BAD_RECORD"),
        ([("INSERT", "no", " ", "1", "2")], "BAD_RECORD"),
        ([("DELETE", "no", "r", "1", " ")], "BEFORE_IMAGE_MISSING"),
        ([("DELETE", "yes", "r", "1", None), ("INSERT", "yes", "r", "1", "2")], "BEFORE_IMAGE_MISSING"),
    ],
)
def test_bad_batches_fail(spark, rows, code):
    with pytest.raises(cdc.BatchFailed, match=code):
        cdc.normalize_cdc(decoded(spark, rows), "s")


def test_stream_to_proof(spark, tmp_path):
    feed = f"file://{tmp_path}/feed"
    decoded(spark, [*PAIR, ("INSERT", "no", "r2", "2", "5")]).coalesce(1).write.parquet(feed)
    log = batchlog.BatchLog(spark, f"file://{tmp_path}/log")
    stream = spark.readStream.schema(spark.read.parquet(feed).schema).parquet(feed)
    for _ in range(2):  # the second run finds nothing new
        log.consume(stream, f"file://{tmp_path}/checkpoint", "s").awaitTermination()
    first = batchlog.oldest_pending(log.states()).first()
    assert (first.status, first.raw_record_count, first.logical_event_count) == ("CAPTURED", 3, 2)
    assert log.capture(log.raw(first.batch_id), first.batch_id, "s") == "REUSED"
    assert log.capture(log.raw(first.batch_id).limit(0), "zz", "s") == "EMPTY"
    assert log.events().count() == 2
    decoded(spark, [("INSERT", "no", "r2", "2", "5")]).coalesce(1).write.mode("append").parquet(feed)  # an event the history has
    log.consume(stream, f"file://{tmp_path}/checkpoint", "s").awaitTermination()
    states = {r.batch_id: r for r in batchlog.latest_states(log.states()).collect()}
    assert sorted(r.status for r in states.values()) == ["CAPTURED", "FAILED"]
    assert next(r for r in states.values() if r.status == "FAILED").error_code == "DUPLICATE_EVENT"

    mart = spark.createDataFrame([(370, 1), (781, 2), (5, 3), (9, 9)], "k int, n int")
    head = spark.createDataFrame([(370, 0), (781, 3), (5, 3)], "k int, n int")
    done = []
    proof = log.prove(first.batch_id, lambda k: head.join(k, "k", "left_semi"), mart, "k", apply=lambda h, k: done.append(h.count())).first()
    assert (proof.candidate_count, proof.confirmed_change_count, proof.no_op_count, proof.vanished_count) == (3, 2, 1, 0)
    assert done == [3] and log.state(first.batch_id).repair_applied
    with pytest.raises(cdc.BatchFailed, match="STATE_COMPLETED"):
        log.prove(first.batch_id, lambda k: head, mart, "k")
    assert batchlog.newest_unpublished(log.states(), log.proofs().limit(0)).first().batch_id == first.batch_id


def test_stale_baseline_and_vanished_keys(spark, tmp_path):
    log = batchlog.BatchLog(spark, f"file://{tmp_path}/log")
    for b, row in (("b1", "r1"), ("b2", "r2")):
        assert log.capture(decoded(spark, [("DELETE", "no", row, "1", "5")]), b, "s") == "CAPTURED"
    mart = spark.createDataFrame([(5, 3), (6, 1)], "k int, n int")
    with pytest.raises(cdc.BatchFailed, match="CANDIDATE_WITHOUT_ROW"):
        log.prove("b1", lambda k: mart.limit(0), mart, "k", allow_vanished=False)
    assert log.state("b1").status == "FAILED"
    assert log.prove("b1", lambda k: mart.limit(0), mart, "k").first().vanished_count == 1
    with pytest.raises(cdc.BatchFailed, match="BASELINE_STALE"):
        log.prove("b2", lambda k: mart, mart, "k")
    assert log.capture(decoded(spark, [("DELETE", "no", "r3", "1", "5")]), "c3", "other") == "CAPTURED"
    with pytest.raises(cdc.BatchFailed, match="BASELINE_STALE: b1"):  # the mart is one, whatever the stream
        log.prove("c3", lambda k: mart, mart, "k")
    apart = batchlog.BatchLog(spark, f"file://{tmp_path}/apart", project="another mart")
    assert apart.capture(decoded(spark, [("DELETE", "no", "r3", "1", "5")]), "d1", "s") == "CAPTURED"
    states = log.states().unionByName(apart.states())
    assert {(r.batch_id, r.blocked_by) for r in batchlog.stale_pairs(states).collect()} == {("b2", "b1"), ("c3", "b1")}


def test_lateness(spark, tmp_path):
    spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as ts, 1 as id union all select timestamp_ntz'2024-01-01 00:00:01', 1").write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp_ntz, id int").parquet(f"file://{tmp_path}/e")
    with pytest.raises(ValueError):
        cdc.with_lateness(stream, "", "1 hour")
    q = cdc.drop_late_duplicates(cdc.with_lateness(stream, "ts", "1 hour"), ["id"]).writeStream.format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("late").count() == 1
