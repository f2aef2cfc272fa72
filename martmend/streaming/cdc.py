"""Change data capture: raw insert and delete records to logical events, and events to mart keys.

The functions take and give DataFrames without regard to whether they are batches; ``batchlog`` runs them in micro-batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.frames import union_all

DELETE, KEY_CHANGE = "DELETE", "KEY_CHANGE"


class BatchFailed(ValueError):
    """A batch that must not be applied; the message is its error code."""


def decode_cdc(df: DataFrame, action: str, is_update: str, row_id: str, primary_key: str, target_key: str) -> DataFrame:
    """Raw records in canonical form: action in upper case, truthy update mark, keys trimmed to null."""
    return df.select(
        F.upper(F.trim(F.col(action).cast("string"))).alias("action"),
        scalars.truthy(F.col(is_update)).alias("is_update"),
        scalars.blank_to_null(F.col(row_id).cast("string")).alias("row_id"),
        scalars.blank_to_null(F.col(primary_key).cast("string")).alias("primary_key"),
        scalars.blank_to_null(F.col(target_key).cast("string")).alias("target_key"),
    )


def bad_records(raw: DataFrame) -> DataFrame:
    return raw.where(~F.coalesce(F.col("action").isin("INSERT", "DELETE"), F.lit(False)) | F.col("row_id").isNull())


def paired(raw: DataFrame, stream: str) -> DataFrame:
    """One row per row id with its operation, keys before and after, fingerprint and event id; operation is null where the
    records do not form an event."""
    ins, dele = F.col("action") == "INSERT", F.col("action") == "DELETE"
    row = raw.groupBy("row_id").agg(
        F.count(F.when(ins, 1)).alias("inserts"),
        F.count(F.when(dele, 1)).alias("deletes"),
        F.max("is_update").alias("is_update"),
        *[F.max(F.when(side, F.col(k))).alias(f"{k}_{when}") for k in ("primary_key", "target_key") for side, when in ((dele, "before"), (ins, "after"))],
    )
    one, none = F.lit(1), F.lit(0)
    operation = F.when(F.col("is_update"), F.when((F.col("inserts") == one) & (F.col("deletes") == one), "UPDATE")).when((F.col("inserts") == one) & (F.col("deletes") == none), "INSERT").when((F.col("deletes") == one) & (F.col("inserts") == none), "DELETE")
    return _identified(row.withColumn("operation", operation), stream).select("event_id", "row_id", "operation", "is_update", *KEYS, "payload_fingerprint")


KEYS = ("primary_key_before", "primary_key_after", "target_key_before", "target_key_after")


def _identified(rows: DataFrame, stream: str) -> DataFrame:
    """rows (row_id, operation and keys) with their fingerprint and event id."""
    print_ = scalars.event_fingerprint(F.lit(stream), F.col("row_id"), F.col("operation"), *[F.col(n) for n in KEYS])
    return rows.withColumn("payload_fingerprint", print_).withColumn("event_id", scalars.event_id(F.col("payload_fingerprint")))


def paired_stream(raw: DataFrame, stream: str, event_time: str, lateness: str) -> DataFrame:
    """Events of a stream of raw records (canonical columns and an event time), with event_time; the two records of an update may
    come in different micro-batches.

    Records that are no updates are events at once. The halves of updates meet in a full outer stream-stream join on the row
    id, which keeps a half in its state until the watermark passes it by ``lateness``. A half that no other joined by then comes
    out without an operation, its action as ``side``.
    """
    timed = with_lateness(raw.withColumnRenamed(event_time, "event_time"), "event_time", lateness)
    halves = []
    for action, when in (("DELETE", "before"), ("INSERT", "after")):
        own = timed.where((F.col("action") == action) & F.col("is_update"))
        halves.append(own.select(F.col("row_id").alias(f"row_{when}"), F.col("event_time").alias(f"time_{when}"), *[F.col(k).alias(f"{k}_{when}") for k in ("primary_key", "target_key")]))
    near = F.expr(f"row_before = row_after and time_after between time_before - interval {lateness} and time_before + interval {lateness}")
    met = halves[0].join(halves[1], near, "full_outer")
    both = F.col("row_before").isNotNull() & F.col("row_after").isNotNull()
    updates = met.select(
        F.coalesce("row_before", "row_after").alias("row_id"), F.when(both, "UPDATE").alias("operation"), F.lit(True).alias("is_update"), *KEYS,
        F.coalesce("time_after", "time_before").alias("event_time"), F.when(F.col("row_after").isNull(), "DELETE").when(F.col("row_before").isNull(), "INSERT").alias("side"),
    )
    sides = [F.when(F.col("action") == action, F.col(k)).alias(f"{k}_{when}") for k in ("primary_key", "target_key") for action, when in (("DELETE", "before"), ("INSERT", "after"))]
    plain = timed.where(~F.col("is_update") | ~F.coalesce(F.col("action").isin("INSERT", "DELETE"), F.lit(False))).select("row_id", F.col("action").alias("operation"), "is_update", *sides, "event_time", F.col("action").alias("side"))
    return _identified(union_all(plain.select(updates.columns), updates), stream)


def before_image_missing(require: tuple[str, ...] = (DELETE, KEY_CHANGE)) -> Column:
    """True for events that lack a target key which the configuration asks for."""
    before, after = F.col("target_key_before"), F.col("target_key_after")
    out = F.lit(False)
    if DELETE in require:
        out = out | ((F.col("operation") == "DELETE") & before.isNull())
    if KEY_CHANGE in require:
        out = out | ((F.col("operation") == "UPDATE") & ~before.eqNullSafe(after) & (before.isNull() | after.isNull()))
    return out


def check_before_images(events: DataFrame, require: tuple[str, ...] = (DELETE, KEY_CHANGE)) -> DataFrame:
    return events.where(before_image_missing(require))


def duplicates(events: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Fingerprints that come twice in the batch or are in the history of all batches (exact)."""
    twice = events.groupBy("payload_fingerprint").count().where("count > 1").select("payload_fingerprint")
    if history is None:
        return twice
    return union_all(twice, events.select("payload_fingerprint").join(history.select("payload_fingerprint"), "payload_fingerprint", "left_semi")).distinct()


def normalize_cdc(raw: DataFrame, stream: str, require: tuple[str, ...] = (DELETE, KEY_CHANGE), history: DataFrame | None = None) -> DataFrame:
    """The batch's logical events, all of them sound, or ``BatchFailed`` before anything is written."""
    events = paired(raw, stream)
    if not bad_records(raw).isEmpty():
        raise BatchFailed("BAD_RECORD")
    check_events(events, require, history)
    return events


def check_events(events: DataFrame, require: tuple[str, ...] = (DELETE, KEY_CHANGE), history: DataFrame | None = None) -> None:
    """``BatchFailed`` if an event has no known operation or no row id, a row id comes twice, or a before-image or a new fingerprint is missing."""
    bad = events.where(F.col("row_id").isNull() | ~F.coalesce(F.col("operation").isin("INSERT", "UPDATE", "DELETE"), F.lit(True)))
    unpaired = union_all(events.where("operation is null").select("row_id"), events.groupBy("row_id").count().where("count > 1").select("row_id"))
    checks = [("BAD_RECORD", bad), ("UNPAIRED_RECORDS", unpaired), ("BEFORE_IMAGE_MISSING", check_before_images(events, require)), ("DUPLICATE_EVENT", duplicates(events, history))]
    for code, df in checks:
        if not df.isEmpty():
            raise BatchFailed(code)


def keys_of_event() -> Column:
    """Target keys of an event; null if it cannot be resolved."""
    before, after, op = F.col("target_key_before"), F.col("target_key_after"), F.col("operation")
    update = F.when(before.isNull(), F.lit(None)).when(after.isNull(), F.array(before)).otherwise(F.array_distinct(F.array(before, after)))
    return F.when((op == "INSERT") & after.isNotNull(), F.array(after)).when((op == "DELETE") & before.isNotNull(), F.array(before)).when(op == "UPDATE", update)


def target_keys(events: DataFrame) -> DataFrame:
    """event_id and entity_key, one row per key of each event."""
    return events.select("event_id", F.explode(keys_of_event()).alias("entity_key"))


def route_cdc(events: DataFrame) -> DataFrame:
    """entity_key, the number of events that touch it, and the origin."""
    return target_keys(events).groupBy("entity_key").agg(F.count_distinct("event_id").alias("event_count")).withColumn("origin", F.lit("event"))


def unresolved_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.when(F.col("target_key_before").isNull() & F.col("target_key_after").isNull(), 1)).alias("unresolved"))


def operation_counts(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    counts = [F.count(F.when(F.col("operation") == op, 1)).alias(name) for op, name in (("INSERT", "inserts"), ("UPDATE", "updates"), ("DELETE", "deletes"))]
    return events.groupBy(*(by or [])).agg(*counts)


def batch_fingerprint(events: DataFrame) -> DataFrame:
    """SHA-256 of the sorted event fingerprints; a list per batch, bounded by the batch's size."""
    return events.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("payload_fingerprint")), ","), 256).alias("batch_fingerprint"))


def with_lateness(stream: DataFrame, event_time: str, lateness: str | None) -> DataFrame:
    """The stream with its declared lateness as a watermark; the time must be a TIMESTAMP, so other types are cast."""
    if not event_time:
        raise ValueError("event time needs a column")
    typed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return typed.withWatermark(event_time, lateness) if lateness else typed


def drop_late_duplicates(stream: DataFrame, columns: list[str]) -> DataFrame:
    """Bounded alternative to the exact history: duplicates within the watermark go, later ones pass."""
    return stream.dropDuplicatesWithinWatermark(columns)


def cdc_summary(batches: DataFrame) -> DataFrame:
    """Summary of batches joined with their proofs and counts (columns as used): status, checkpoint, evidence and percent avoided.

    Refused (null status with a reason): batches still captured or in work, completed ones without a passed proof or with
    missed or unresolved events, failed ones without a code, and any without a fingerprint.
    """
    c = F.col
    done, failed = c("status") == "COMPLETED", c("status") == "FAILED"
    reason = (
        F.when(c("payload_fingerprint").isNull(), "FINGERPRINT_MISSING")
        .when(~done & ~failed, "BATCH_NOT_FINISHED")
        .when(failed & c("error_code").isNull(), "ERROR_CODE_MISSING")
        .when(done & ~c("validation_status").eqNullSafe(F.lit("passed")), "PROOF_NOT_PASSED")
        .when(done & ~F.coalesce(c("targeted_rows_compared"), F.lit(False)), "TARGETED_ROWS_NOT_COMPARED")
        .when(done & ((F.coalesce(c("missed_event_count"), F.lit(0)) > 0) | (c("unresolved_events") > 0)), "EVENTS_UNRESOLVED")
    )
    out = batches.withColumn("refused", reason)
    ok = c("refused").isNull()
    return out.select(
        "batch_id",
        F.when(ok, F.when(done, "passed").otherwise("failed")).alias("assessment"),
        F.when(ok, F.lower("status")).alias("checkpoint"),
        F.when(ok, F.when(done, "empirically_validated").otherwise("none")).alias("evidence"),
        F.when(ok & (c("full_entities") > 0), F.round((1 - F.coalesce(c("union_candidates"), F.lit(0)) / c("full_entities")) * 100, 3)).alias("percent_avoided"),
        "refused",
    )
