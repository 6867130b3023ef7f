"""Structured Streaming: windowed rates, keyed transaction state with timeouts, ingest without duplicates."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logloom.functions.protocols import Protocol
from logloom.operators import tables
from logloom.operators.shared import shared_root

TRANSACTION = "corr_id string, application string, status string, waiting_for string, phase_ts string, ack_code string, spawned_at long, first_seen_at long, last_activity long"
STATE = "application string, phase_ts string, ack_code string, spawned_at long, first_seen_at long, last_activity long, status string"
NAMES, STATE_NAMES = ([f.split()[0] for f in fields.split(", ")] for fields in (TRANSACTION, STATE))


def ingest(records: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Records once each: log_id within the watermark's reach. records: log_id, ts (timestamp), ..."""
    return records.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["log_id"])


def rates(parsed: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Tumbling counts by fingerprint; parsed: ts (timestamp, with a watermark for append output), fingerprint."""
    return parsed.groupBy(F.window("ts", window), "fingerprint").agg(F.count(F.lit(1)).alias("n")).select(F.unix_millis("window.start").alias("window_start"), "fingerprint", "n")


def advance(state: dict | None, events: pd.DataFrame, phases: tuple[str, ...], failing: Callable[[str], bool], now: int, timeout_ms: int) -> dict:
    """The next state of one transaction: pure in (state, events, now), used for batches and timers alike.

    Any phase may come first; a phase keeps its first time; the latest code counts; closed transactions stay as they are.
    """
    return advance_rows(state, list(events.itertuples()), phases, failing, now, timeout_ms)


def advance_rows(state: dict | None, events: list, phases: tuple[str, ...], failing: Callable[[str], bool], now: int, timeout_ms: int) -> dict:
    """`advance` for events as plain rows."""
    s = dict(state) if state else None
    for e in sorted(events, key=lambda e: (e.ts_ms, e.log_id)):
        if s is None:
            s = {"application": e.application, "phase_ts": {}, "ack_code": None, "spawned_at": int(e.ts_ms), "first_seen_at": now, "last_activity": int(e.ts_ms), "status": "awaiting"}
        if s["status"] not in ("awaiting", "undecided"):
            break
        s["phase_ts"] = {e.type: int(e.ts_ms), **s["phase_ts"]}
        s["ack_code"] = e.ack_code or s["ack_code"]
        s["last_activity"] = max(s["last_activity"], int(e.ts_ms))
    if s and s["status"] in ("awaiting", "undecided"):
        missing = [p for p in phases if p not in s["phase_ts"]]
        if s["ack_code"] and failing(s["ack_code"]):
            s["status"] = "failed"
        elif not missing:
            s["status"] = "completed"
        elif now - s["last_activity"] > timeout_ms and now - s["first_seen_at"] > timeout_ms:
            s["status"] = "error"
        else:
            s["status"] = "undecided" if phases[-1] in s["phase_ts"] else "awaiting"
    return s or {}


ACTIVE = ("awaiting", "undecided")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Transactions(StatefulProcessor):
    """One transaction's state and its timer. The timer fires on processing time, with or without input."""

    def __init__(self, phases: tuple[str, ...], ok_codes: frozenset[str], timeout_ms: int, clock: Callable[[int], int] | None):
        self.phases, self.ok_codes, self.timeout_ms, self.clock = phases, ok_codes, timeout_ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("transaction", STATE)

    def _step(self, key: tuple, events: list[Row], real_ms: int) -> Iterator[Row]:
        # Every call of the handle or the state is a message to the JVM and back, which is most of a transaction's cost: none that is not needed.
        now = self.clock(real_ms) if self.clock else real_ms
        before, held = None, self.state.get()
        if held is not None:
            before = dict(zip(STATE_NAMES, held, strict=True))
            before["phase_ts"] = json.loads(before["phase_ts"])
        after = advance_rows(before, events, self.phases, lambda c: c.upper() not in self.ok_codes, now, self.timeout_ms)
        if not after:
            return
        active = after["status"] in ACTIVE
        if before is not None and before["status"] in ACTIVE:  # nothing else has a timer
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
        if active:
            # In the clock's time; the timer itself runs on the cluster's.
            left = max(after["last_activity"], after["first_seen_at"]) + self.timeout_ms - now
            self.handle.registerTimer(real_ms + max(1, left + 1))
        if after == before:
            return
        stored = {**after, "phase_ts": json.dumps(after["phase_ts"], sort_keys=True)}
        self.state.update(tuple(stored[n] for n in STATE_NAMES))
        waiting = next((p for p in self.phases if p not in after["phase_ts"]), None) if active else None
        stored |= {"corr_id": key[0], "waiting_for": waiting}
        yield Row(**{n: stored[n] for n in NAMES})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        return self._step(key, list(rows), timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        return self._step(key, [], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def transactions(events: DataFrame, app: Protocol, ok_codes: frozenset[str], clock: Callable[[int], int] | None = None, timeout_ms: int | None = None) -> DataFrame:
    """Keyed state per corr_id: a row whenever a transaction changes or times out.

    State lives in RocksDB and timers run on processing time, so they fire without input. `clock` turns the cluster's time into the time that
    counts (as a replay does); it is asked again when a timer fires, which waits on if it is early.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = events.where(F.col("application") == app.id).select("corr_id", "application", "type", "ts_ms", "log_id", "ack_code")
    machine = _Transactions(app.phases, ok_codes, app.timeout_minutes * 60_000 if timeout_ms is None else timeout_ms, clock)
    return keyed.groupBy("corr_id").transformWithState(statefulProcessor=machine, outputStructType=TRANSACTION, outputMode="Update", timeMode="ProcessingTime")


def report_failures(transactions: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Findings for closed failures that have none yet: for use after each batch; driven by the tables, not by the batch, so it heals itself."""
    closed = transactions.where(F.col("status").isin("failed", "error")).withColumn("fingerprint", F.concat(F.lit("tx:"), "corr_id"))
    new = closed.join(anomalies.select("fingerprint"), "fingerprint", "left_anti")
    return new.select("fingerprint", F.when(F.col("status") == "failed", "high").otherwise("medium").alias("severity"), "corr_id").dropDuplicates(["fingerprint"])


def fold_updates(old: DataFrame, updates: DataFrame) -> DataFrame:
    """Snapshot after a batch of state rows."""
    return tables.merge(old, updates, "corr_id", keep_old=("application", "first_seen_at"), keep_new=("ack_code",))


def shared_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, mode: str = "append", timers: bool = False) -> DataFrame:
    """Run a stream over all input there is and return what it wrote. Output rows carry their batch number.

    A stream with processing-time timers never runs out of batches, so it is stopped once the input is through.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/out/part={batch}")

    trigger = {"processingTime": "1 second"} if timers else {"availableNow": True}
    q = stream.writeStream.outputMode(mode).trigger(**trigger).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).start()
    if timers:
        while q.isActive and not (q.lastProgress is not None and q.lastProgress.numInputRows == 0):
            time.sleep(0.2)
        if q.exception() is not None:
            raise q.exception()
        q.stop()
    else:
        q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def read_table_stream(spark: SparkSession, sf_dir: str, table: str, files_per_batch: int = 4) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{table}.parque[t]")
