"""Job watcher: a stateful stream over progress records, and its batch twin (STM-1 to STM-5).

A running job ends by the first rule that holds:
1. its time is over; 2. no progress within 120 s of its start; 3. a result came;
4. its process is dead and its last record older than 60 s. Otherwise the share
moves on. Liveness is a column of the records, as processes
can't be signalled from executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.functions.scalar import stage_share

START_GRACE_MS, STALE_MS, ERROR_CHARS = 120_000, 60_000, 300
RECORD = "job_id string, ts long, created_at long, timeout_at long, alive boolean, stage string, done long, total long, ok boolean, error string"
EVENT = "job_id string, ts long, status string, progress double, reason string, error string"
_STATE = "share double, last_ts long, created_at long, timeout_at long, alive boolean"


def next_share(before: float, stage: str | None, done: float | None, total: float | None) -> float:
    """STM-2 for one record."""
    new = {"extract": 0.03, "render": 0.95}.get(stage or "", before)
    if stage == "translate":
        new = 0.05 + 0.87 * min(1.0, (done or 0) / total if total else 0.0)
    return new if abs(new - before) >= 0.005 else before


def _watch(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    job = key[0]
    out: list[tuple] = []
    share, last, created, limit, alive = state.get if state.exists else (0.0, None, None, None, True)
    ended = False

    def end(ts: int, status: str, reason: str, error: str | None = None) -> None:
        nonlocal ended
        ended = True
        out.append((job, ts, status, 1.0 if status == "done" else share, reason, error and error[:ERROR_CHARS]))

    if state.hasTimedOut:
        now = state.getCurrentProcessingTimeMs()
        if limit is not None and now >= limit:
            end(now, "failed", "timeout")
        elif last is None:
            end(now, "failed", "never started")
        elif not alive and now - last > STALE_MS:
            end(now, "failed", "stale")
    else:
        rows = pd.concat(list(batches)).sort_values("ts")
        for r in rows.itertuples(index=False):
            created = r.created_at if created is None and not pd.isna(r.created_at) else created
            limit = r.timeout_at if not pd.isna(r.timeout_at) else limit
            if limit is not None and r.ts >= limit:
                end(int(r.ts), "failed", "timeout")
            elif r.ok is not None and not pd.isna(r.ok):
                end(int(r.ts), "done" if r.ok else "failed", "result", None if r.ok else r.error)
            elif r.stage is not None:
                share = next_share(share, r.stage, None if pd.isna(r.done) else r.done, None if pd.isna(r.total) else r.total)
                last, alive = int(r.ts), bool(r.alive)
                out.append((job, last, "running", share, "progress", None))
            if ended:
                break
    if ended:
        state.remove()
    else:
        state.update((share, last, None if created is None else int(created), None if limit is None else int(limit), alive))
        state.setTimeoutDuration(STALE_MS if last is not None else START_GRACE_MS)
    yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.split(", ")])


def watch(records: DataFrame) -> DataFrame:
    """A stream of RECORD rows to a stream of EVENT rows; state is one small row a job, dropped when it ends."""
    return records.groupBy("job_id").applyInPandasWithState(_watch, EVENT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def settle(jobs: DataFrame, records: DataFrame, now: Column) -> DataFrame:
    """The batch twin of STM-1 to STM-3: (id, status, progress, reason, error) of each running job at ``now``.

    Takes each job's last record and its last result; the share is folded over all records in order.
    """
    last = records.groupBy("job_id").agg(F.max_by(F.coalesce("alive", F.lit(True)), "ts").alias("alive"), F.max("ts").alias("last_ts"))
    result = records.where("ok is not null").groupBy("job_id").agg(F.max_by("ok", "ts").alias("ok"), F.max_by("error", "ts").alias("result_error"))
    steps = records.where("stage is not null").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ts", "stage", "done", "total"))).alias("steps"))
    folded = steps.select("job_id", F.aggregate("steps", F.lit(0.0), lambda a, s: stage_share(s["stage"], s["done"], s["total"], a)).alias("share"))
    j = jobs.where("status = 'running'").withColumnRenamed("id", "job_id").join(last, "job_id", "left").join(result, "job_id", "left").join(folded, "job_id", "left")
    late = now >= F.col("timeout_at")
    silent = F.col("last_ts").isNull() & (now - F.col("created_at") > START_GRACE_MS)
    stale = ~F.coalesce("alive", F.lit(True)) & (now - F.col("last_ts") > STALE_MS)
    status = F.when(late | silent, "failed").when(F.col("ok"), "done").when(~F.col("ok"), "failed").when(stale, "failed").otherwise("running")
    reason = F.when(late, "timeout").when(silent, "never started").when(F.col("ok").isNotNull(), "result").when(stale, "stale").otherwise("progress")
    share = F.when(status == "done", 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    error = F.when((status == "failed") & (reason == "result"), F.substring("result_error", 1, ERROR_CHARS))
    return j.select(F.col("job_id").alias("id"), status.alias("status"), share.alias("progress"), reason.alias("reason"), error.alias("error"))


def apply_settled(jobs: DataFrame, settled: DataFrame, now: Column) -> DataFrame:
    """STM-3: the ledger with what has ended; others stay as they are."""
    s = settled.select("id", F.col("status").alias("_status"), F.col("progress").alias("_progress"), F.col("error").alias("_error"))
    ended = F.col("_status").isin("done", "failed")
    out = jobs.join(s, "id", "left")
    return out.select(*[F.when(ended, F.col("_status")).otherwise(F.col("status")).alias("status") if c == "status" else F.when(ended, now).otherwise(F.col("ended_at")).alias("ended_at") if c == "ended_at" else F.coalesce("_progress", "progress").alias("progress") if c == "progress" else F.coalesce("_error", "error").alias("error") if c == "error" else F.col(c) for c in jobs.columns])


def retried(jobs: DataFrame, job_id: str, new_id: str, now: int) -> DataFrame:
    """STM-5: a job that isn't running is replaced by a fresh one."""
    hit = (F.col("id") == job_id) & (F.col("status") != "running")
    new = {"id": F.lit(new_id), "status": F.lit("running"), "created_at": F.lit(now), "ended_at": F.lit(None), "progress": F.lit(0.0), "error": F.lit(None)}
    return jobs.select(*[F.when(hit, new[c]).otherwise(F.col(c)).cast(jobs.schema[c].dataType).alias(c) if c in new else F.col(c) for c in jobs.columns])


def cleared(jobs: DataFrame) -> DataFrame:
    """STM-5: running jobs alone."""
    return jobs.where("status = 'running'")
