"""The ingest queue as a stateful stream: claims, attempts, requeues and a visibility timeout kept by timers.

A job's life is a state of its own, keyed by job id, so jobs are independent of each other and dealt out by key. Claims
by workers, their outcomes and new requests come as events with a time; timers, in event time, take back what a worker
has held for too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tables import MAX_ATTEMPTS, VISIBILITY_SECONDS

STATE = "status string, attempts int, claimed_at double, error string"
OUT = "job_id long, seq long, at double, status string, attempts int, error string, cause string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(state: tuple | None, at: float, kind: str, error: str) -> tuple | None:
    """The state (status, attempts, claimed_at, error) after an event; None if the event changes nothing.

    request: a new job, or a finished one, is queued afresh. claim: a queued job runs, with one more attempt. done and
    fail count for a running job alone; a failed one is queued again until its attempts are used up.
    """
    status, attempts, _, _ = state or ("", 0, None, "")
    if kind == "request":
        return None if status in ("queued", "running") else ("queued", 0, None, "")
    if kind == "claim":
        return ("running", attempts + 1, at, "") if status == "queued" else None
    if status != "running":
        return None
    if kind == "done":
        return "done", attempts, None, ""
    if kind == "fail":
        return ("queued" if attempts < MAX_ATTEMPTS else "failed"), attempts, None, error[:500]
    return None


def timed_out(state: tuple | None, at: float) -> tuple | None:
    """The state of a running job whose claim is older than the visibility timeout at a time: queued, or failed for good."""
    if state is None or state[0] != "running" or at <= state[2] + VISIBILITY_SECONDS:
        return None
    return ("queued" if state[1] < MAX_ATTEMPTS else "failed"), state[1], None, "worker lost"


class Queue(StatefulProcessor):
    """One job for each key. Of a key's events in a batch those of lower (at, seq) come first; an event older than the
    job's last one is late and has no effect, so a repeated event repeats nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)
        self.last = handle.getValueState("last", "at double, seq long")

    def _put(self, state: tuple) -> None:
        self.job.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state[0] == "running":
            # Behind the second in which the claim is still held.
            self.handle.registerTimer(int((state[2] + VISIBILITY_SECONDS) * 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["at", "seq"])  # one job's events of one batch
        state = tuple(self.job.get()) if self.job.exists() else None
        seen = tuple(self.last.get()) if self.last.exists() else (float("-inf"), -1)
        out = []
        for seq, at, kind, error in zip(events["seq"].tolist(), events["at"].tolist(), events["kind"].tolist(), events["error"].tolist(), strict=True):
            if (at, seq) <= seen:
                continue
            seen = at, seq
            lost = timed_out(state, at)
            if lost:
                state = lost
                out.append((key[0], seq, at, *lost[:2], lost[3], "timeout"))
            after = advance(state, at, kind, error or "")
            if after:
                state = after
                out.append((key[0], seq, at, *after[:2], after[3], kind))
        self.last.update(seen)
        if out:
            self._put(state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs() / 1000
        state = timed_out(tuple(self.job.get()), at) if self.job.exists() else None
        if state:
            self._put(state)
            _, seq = tuple(self.last.get())
            yield pd.DataFrame([(key[0], seq, at, *state[:2], state[3], "timeout")], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def run_queue(events: DataFrame, out: str, checkpoint: str, lateness: str = "1 second") -> None:
    """Work through a stream of events (job_id, seq, at in seconds, kind, error) and append every change of a job to out.

    What is there is handled and the run ends; the next run goes on from the checkpoint, with all states and timers, and
    the sink's log of batches keeps a repeated batch from adding its rows twice. Rows without job id or time are left out.
    """
    spark = events.sparkSession
    known = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(known, None)
    spark.conf.set(known, PROVIDER)
    try:
        timed = events.where("job_id is not null and at is not null").withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", lateness)
        changes = timed.groupBy("job_id").transformWithStateInPandas(Queue(), OUT, "Append", "EventTime")
        query = changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    finally:
        spark.conf.unset(known) if before is None else spark.conf.set(known, before)


def states(changes: DataFrame) -> DataFrame:
    """(job_id, status, attempts, error) of each job by its last change."""
    order = F.struct("at", "seq", F.when(F.col("cause") == "timeout", 0).otherwise(1))
    return changes.groupBy("job_id").agg(F.max_by(F.struct("status", "attempts", "error"), order).alias("s")).select("job_id", "s.*")
