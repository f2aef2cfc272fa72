"""Event log, batch states and proofs as tables, and the streams that fill them.

The streaming checkpoint gives one writer and numbers the batches; a batch that is replayed finds its state and writes
nothing twice.

* States are a log that is compacted: a snapshot with the latest state of each batch, and a folder with the moves since then. When that
  has ``MOVES`` files, the next snapshot is written; it counts from the moment its ``_SUCCESS`` file is there, so a reader
  sees the old pair of folders or the new one. However many batches there were, a bounded number of files is read.
* Events lie in folders by the first digit of their fingerprint and by batch, so the search for duplicates of a batch reads one column
  of those folders only whose digits the batch has.
* A table of leftovers has the records of updates whose other half never came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.frames import union_all
from ..operators.compare import targeted_proof
from ..operators.keys import latest
from ..operators.workspace import Workspace
from . import cdc

STATES = ("CAPTURING", "CAPTURED", "PROCESSING", "COMPLETED", "FAILED")
STATE = (
    "batch_id string, project_name string, stream_relation string, seq long, status string, started_at timestamp, captured_at timestamp, completed_at timestamp, "
    "raw_record_count long, logical_event_count long, error_code string, payload_fingerprint string, repair_applied boolean, at timestamp"
)
EVENT = (
    "event_id string, source_model string, source_relation string, provider string, operation string, provider_row_id string, is_update boolean, primary_key_before string, primary_key_after string, "
    "target_key_before string, target_key_after string, event_time timestamp, ingestion_time timestamp, payload_fingerprint string, processing_status string, digit string, batch_id string"
)
PROOF = (
    "batch_id string, candidate_count long, sql_change_candidate_count long, union_candidate_count long, confirmed_change_count long, no_op_count long, vanished_count long, missed_event_count long, "
    "validation_status string, event_routing_validated boolean, targeted_rows_compared boolean, whole_table_reference_executed boolean, query_fingerprint string, repair_applied boolean"
)
NEXT = {None: {"CAPTURING"}, "CAPTURING": {"CAPTURED", "FAILED"}, "CAPTURED": {"PROCESSING", "FAILED"}, "PROCESSING": {"COMPLETED", "FAILED"}, "FAILED": {"CAPTURING", "PROCESSING"}, "COMPLETED": set()}
#: Files of moves after which the states are compacted.
MOVES = 64


def latest_states(states: DataFrame) -> DataFrame:
    return latest(states, ["batch_id"], [F.desc("seq")])


def oldest_pending(states: DataFrame) -> DataFrame:
    """The batch to work on next: captured or failed, the earliest start first."""
    return latest_states(states).where("status in ('CAPTURED', 'FAILED')").orderBy("started_at", "batch_id").limit(1)


def newest_unpublished(states: DataFrame, published: DataFrame) -> DataFrame:
    """The completed batch without a publication that was completed last."""
    done = latest_states(states).where("status = 'COMPLETED'")
    return done.join(published.select("batch_id"), "batch_id", "left_anti").orderBy(F.desc("completed_at"), F.desc("batch_id")).limit(1)


def stale_pairs(states: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """batch_id and blocked_by: for each batch that is not completed (or in ``batches``), the completed batches of its project whose
    repair was not applied, so that the mart is no baseline for it.

    By project, whatever the stream and order of the batches: a mart has one baseline. For each batch only the first by id is
    named, which is enough to block it.
    """
    now = latest_states(states)
    some = now.where("status <> 'COMPLETED'") if batches is None else now.join(batches.select("batch_id").distinct(), "batch_id", "left_semi")
    project = F.coalesce("project_name", F.lit(""))
    at = Window.partitionBy("p").orderBy("batch_id")
    open_ = now.where((F.col("status") == "COMPLETED") & ~F.coalesce("repair_applied", F.lit(False))).select(project.alias("p"), "batch_id")
    two = open_.withColumn("r", F.row_number().over(at)).where("r <= 2").groupBy("p").agg(F.array_sort(F.collect_list("batch_id")).alias("ids"))
    first = F.get(F.filter("ids", lambda i: i != F.col("batch_id")), 0)
    return some.withColumn("p", project).join(two, "p").select("batch_id", first.alias("blocked_by")).where("blocked_by is not null")


def list_batches(states: DataFrame, proofs: DataFrame, project: str | None = None, stream: str | None = None, status: str | None = None) -> DataFrame:
    """Latest states with the figures of their proofs, the latest start first."""
    kept = latest_states(states)
    for name, value in (("project_name", project), ("stream_relation", stream), ("status", status)):
        kept = kept if value is None else kept.where(F.col(name) == value)
    return kept.drop("at").join(proofs.drop("repair_applied"), "batch_id", "left").orderBy(F.desc("started_at"), "batch_id")


class BatchLog:
    """Tables below one folder: states, raw/batch_id=, events/digit=/batch_id=, proofs/batch_id=, leftovers/batch_id=."""

    def __init__(self, spark: SparkSession, path: str, project: str = "", moves: int = MOVES) -> None:
        self.spark, self.path, self.project, self.moves = spark, path.rstrip("/"), project, moves

    # ------------------------------------------------------------ folders
    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _list(self, name: str) -> list[str]:
        fs, path = self._fs(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _drop(self, name: str) -> None:
        fs, path = self._fs(name)
        fs.delete(path, True)

    def _table(self, name: str, schema: str) -> DataFrame:
        fs, path = self._fs(name)
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    # ------------------------------------------------------------ states
    def _generation(self) -> int:
        """The number of the newest complete snapshot; 0 before the first."""
        found = [int(n.split("-")[1]) for n in self._list("states") if n.startswith("snapshot-")]
        return max((n for n in found if "_SUCCESS" in self._list(f"states/snapshot-{n}")), default=0)

    def states(self) -> DataFrame:
        """The latest state of each batch at the last snapshot, and all moves since then."""
        n = self._generation()
        return union_all(self._table(f"states/snapshot-{n}", STATE), self._table(f"states/moves-{n}", STATE))

    def compact(self) -> None:
        """Write the next snapshot and drop what the one before the last had; a snapshot that was left incomplete is written anew."""
        n = self._generation()
        latest_states(self.states()).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/states/snapshot-{n + 1}")
        for name in self._list("states"):
            if int(name.split("-")[1]) < n:
                self._drop(f"states/{name}")

    def append_states(self, rows: DataFrame) -> None:
        """Add moves (columns of STATE); compacts first when enough moves have gathered."""
        n = self._generation()
        if sum(f.startswith("part-") for f in self._list(f"states/moves-{n}")) >= self.moves:
            self.compact()
            n += 1
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/states/moves-{n}")

    def state(self, batch_id: str):
        return latest_states(self.states().where(F.col("batch_id") == batch_id)).first()

    def move(self, batch_id: str, status: str, **facts) -> None:
        """Append a state; a move that the life cycle does not allow is refused."""
        now = self.state(batch_id)
        if status not in NEXT[now.status if now else None]:
            raise cdc.BatchFailed(f"STATE_{now.status if now else 'NONE'}_TO_{status}")
        held = dict.fromkeys([f.split(" ")[0] for f in STATE.split(", ")]) | {"project_name": self.project, "repair_applied": False}
        held |= {k: v for k, v in (now.asDict() if now else {}).items() if k not in ("error_code", "at")}
        held |= {"batch_id": batch_id, "status": status, "seq": now.seq + 1 if now else 0} | facts
        one = self.spark.createDataFrame([tuple(held.values())], STATE)
        clock = {"at": F.current_timestamp()} | {name: F.current_timestamp() for name, when in (("started_at", "CAPTURING"), ("captured_at", "CAPTURED"), ("completed_at", "COMPLETED")) if status == when and not (name == "started_at" and held[name])}
        self.append_states(one.withColumns(clock))

    # ------------------------------------------------------------ other tables
    def proofs(self) -> DataFrame:
        return self._table("proofs", PROOF)

    def events(self) -> DataFrame:
        return self._table("events", EVENT).drop("digit")

    def leftovers(self) -> DataFrame:
        return self._table("leftovers", "row_id string, action string, primary_key string, target_key string, event_time timestamp, batch_id string")

    def raw(self, batch_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/raw/batch_id={batch_id}")

    def batches(self, **only: str | None) -> DataFrame:
        return list_batches(self.states(), self.proofs(), **only)

    def history(self, events: DataFrame, batch_id: str) -> DataFrame:
        """Fingerprints of other batches, read from the folders only that can have one of the events (at most 16 digits)."""
        digits = [r[0] for r in events.select(digit_of(F.col("payload_fingerprint"))).distinct().collect()]
        return self._table("events", EVENT).where(F.col("digit").isin(digits) & (F.col("batch_id") != batch_id)).select("payload_fingerprint")

    def _store(self, events: DataFrame, batch_id: str, model: str, stream: str, provider: str) -> None:
        """Put the batch's events in place of those that an attempt before may have left."""
        for digit in self._list("events"):
            self._drop(f"events/{digit}/batch_id={batch_id}")
        none = F.lit(None).cast("timestamp")
        when = F.col("event_time") if "event_time" in events.columns else none
        named = {"source_model": F.lit(model), "source_relation": F.lit(stream), "provider": F.lit(provider), "provider_row_id": F.col("row_id"), "event_time": when, "ingestion_time": F.current_timestamp(), "processing_status": F.lit("CAPTURED"), "digit": digit_of(F.col("payload_fingerprint")), "batch_id": F.lit(batch_id)}
        rows = events.withColumns(named).select(*[f.split(" ")[0] for f in EVENT.split(", ")])
        rows.repartition("digit").write.mode("append").partitionBy("digit", "batch_id").parquet(f"{self.path}/events")

    # ------------------------------------------------------------ capture
    def _begin(self, batch: DataFrame, batch_id: str, stream: str) -> str | None:
        now = self.state(batch_id)
        if now and now.status not in ("CAPTURING", "FAILED"):
            return "REUSED"
        if batch.isEmpty():
            return "EMPTY"
        if not now or now.status == "FAILED":
            self.move(batch_id, "CAPTURING", stream_relation=stream)
        return None

    def _finish(self, events: DataFrame, batch_id: str, stream: str, raw_records: int, model: str, provider: str) -> str:
        self._store(events, batch_id, model, stream, provider)
        stored = self.events().where(F.col("batch_id") == batch_id)
        facts = stored.agg(F.count(F.lit(1)).alias("n")).first()
        self.move(batch_id, "CAPTURED", raw_record_count=raw_records, logical_event_count=facts.n, payload_fingerprint=cdc.batch_fingerprint(stored).first()[0])
        return "CAPTURED"

    def capture(self, batch: DataFrame, batch_id: str, stream: str, model: str = "", provider: str = "", **normal) -> str:
        """Raw records, then events, then the state: a batch is captured as a whole or not at all. EMPTY, REUSED, CAPTURED or FAILED."""
        if early := self._begin(batch, batch_id, stream):
            return early
        batch.write.mode("overwrite").parquet(f"{self.path}/raw/batch_id={batch_id}")
        raw = self.raw(batch_id)
        n = raw.count()
        try:
            events = cdc.normalize_cdc(raw, stream, history=self.history(cdc.paired(raw, stream), batch_id), **normal)
        except cdc.BatchFailed as why:
            self.move(batch_id, "FAILED", error_code=str(why), raw_record_count=n)
            return "FAILED"
        return self._finish(events, batch_id, stream, n, model, provider)

    def consume(self, stream: DataFrame, checkpoint: str, name: str, **normal) -> StreamingQuery:
        """Capture what the stream holds, micro-batch by micro-batch; ends when there is no more. Both records of an update must come
        in one micro-batch, else ``consume_paired``."""

        def take(batch: DataFrame, number: int) -> None:
            self.capture(batch, f"{name}-{number:08d}", name, **normal)

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def consume_paired(self, stream: DataFrame, checkpoint: str, name: str, event_time: str, lateness: str, model: str = "", provider: str = "", require: tuple[str, ...] = (cdc.DELETE, cdc.KEY_CHANGE), partitions: int | None = None) -> StreamingQuery:
        """Like ``consume``, for feeds in which the two records of an update may come in different micro-batches.

        The halves wait for each other in the state of a stream-stream join, up to ``lateness``. A half that stays alone goes to
        the leftovers, and a batch of its own with the suffix -unpaired tells so as FAILED. The state has ``partitions`` partitions, by
        default as many as shuffles; a checkpoint keeps its number.
        """

        def take(batch: DataFrame, number: int) -> None:
            batch_id = f"{name}-{number:08d}"
            with Workspace(self.spark) as work:
                rows = work.put("batch", batch)
                self._take_paired(rows.where("operation is not null"), batch_id, name, model, provider, require)
                self._take_leftovers(rows.where("operation is null"), f"{batch_id}-unpaired", name)

        writer = cdc.paired_stream(stream, name, event_time, lateness).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        setting = "spark.sql.shuffle.partitions"
        held = self.spark.conf.get(setting)
        try:  # a stream takes the session's settings when it starts
            self.spark.conf.set(setting, str(partitions or held))
            return writer.start()
        finally:
            self.spark.conf.set(setting, held)

    def _take_paired(self, events: DataFrame, batch_id: str, stream: str, model: str, provider: str, require: tuple[str, ...]) -> None:
        if self._begin(events, batch_id, stream):
            return
        raw_records = events.agg(F.sum(F.when(F.col("operation") == "UPDATE", 2).otherwise(1))).first()[0]
        try:
            cdc.check_events(events, require, self.history(events, batch_id))
        except cdc.BatchFailed as why:
            self.move(batch_id, "FAILED", error_code=str(why), raw_record_count=raw_records)
            return
        self._finish(events, batch_id, stream, raw_records, model, provider)

    def _take_leftovers(self, rows: DataFrame, batch_id: str, stream: str) -> None:
        if self._begin(rows, batch_id, stream):
            return
        before = F.col("side") == "DELETE"
        halves = rows.select("row_id", F.col("side").alias("action"), *[F.when(before, F.col(f"{k}_before")).otherwise(F.col(f"{k}_after")).alias(k) for k in ("primary_key", "target_key")], "event_time")
        halves.write.mode("overwrite").parquet(f"{self.path}/leftovers/batch_id={batch_id}")
        self.move(batch_id, "FAILED", error_code="UNPAIRED_RECORDS", raw_record_count=rows.count())

    # ------------------------------------------------------------ proof
    def assert_fresh(self, batch_id: str) -> None:
        """Another batch of the project that is completed but not applied leaves a stale baseline."""
        one = self.spark.createDataFrame([(batch_id,)], "batch_id string")
        if row := stale_pairs(self.states(), one).first():
            raise cdc.BatchFailed(f"BASELINE_STALE: {row.blocked_by}")

    def prove(self, batch_id: str, recompute: Callable[[DataFrame], DataFrame], mart: DataFrame, key: str, apply: Callable[[DataFrame, DataFrame], object] | None = None, allow_vanished: bool = True, changed: DataFrame | None = None, query_fingerprint: str | None = None) -> DataFrame:
        """Recompute the keys of a captured batch, and those of a definition change if given (``changed``), compare, optionally apply; the
        proof is stored and returned."""
        self.assert_fresh(batch_id)
        self.move(batch_id, "PROCESSING")
        try:
            with Workspace(self.spark) as work:
                events = self.events().where(F.col("batch_id") == batch_id)
                routed = cdc.route_cdc(events).select("entity_key")
                own = routed.count()
                if changed is not None:
                    changed = work.put("changed", changed.select(F.col(changed.columns[0]).cast("string").alias("entity_key")).where("entity_key is not null").distinct())
                    routed = union_all(routed, changed).distinct()
                proof, keys, head = prove_cdc(routed, recompute, mart, key, work)
                row = proof.first()
                lost = events.where(cdc.keys_of_event().isNull()).count()
                if row.vanished_count and not allow_vanished:
                    raise cdc.BatchFailed("CANDIDATE_WITHOUT_ROW")
                if not row.targeted_rows_compared:
                    raise cdc.BatchFailed("REPAIRED_ROWS_DIFFER")
                if apply:
                    apply(head, keys)
                facts = (own, changed.count() if changed is not None else 0, row.candidate_count, row.confirmed_change_count, row.no_op_count, row.vanished_count, lost, "passed" if not lost else "failed", not lost, True, False, query_fingerprint, bool(apply))
        except Exception as why:
            self.move(batch_id, "FAILED", error_code=str(why)[:200])
            raise
        stored = self.spark.createDataFrame([facts], PROOF.split(", ", 1)[1])
        stored.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/proofs/batch_id={batch_id}")
        self.move(batch_id, "COMPLETED", repair_applied=bool(apply))
        return self.proofs().where(F.col("batch_id") == batch_id)


def digit_of(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, 1)


def prove_cdc(routed: DataFrame, recompute: Callable[[DataFrame], DataFrame], mart: DataFrame, key: str, work: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proof, keys, head): counts of candidates, confirmed changes, no-ops and vanished keys, and whether the repaired
    candidates equal the recomputed rows. Keys and head are computed once and stand in the work tables."""
    keys = routed.select(F.col("entity_key").cast(mart.schema[key].dataType).alias(key)).where(F.col(key).isNotNull()).distinct()
    keys = work.put("keys", keys)
    head = work.put("head", recompute(keys))
    return targeted_proof(mart, keys, head, key), keys, head
