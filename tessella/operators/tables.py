"""Row-store operators: table rewrites in place of row updates, index reconciliation, queue, lease and cache states.

Each is a function from tables (and an explicit `now`) to tables, so it can run in a batch or in foreachBatch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import store

VISIBILITY_SECONDS, MAX_ATTEMPTS, LEASE_SECONDS, TTL_HOURS = 1_800, 3, 90, 24


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows inserted or replaced by key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def insert_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


def cascade(parents: DataFrame, children: list[tuple[DataFrame, str]], deleted: DataFrame, key: str) -> list[DataFrame]:
    """The parents and each child table without the rows that hang on deleted keys."""
    gone = deleted.select(F.col(key).alias("_gone"))
    return [parents.join(gone, parents[key] == gone["_gone"], "left_anti")] + [c.join(gone, c[fk] == gone["_gone"], "left_anti") for c, fk in children]


def set_null(events: DataFrame, column: str, deleted: DataFrame, key: str) -> DataFrame:
    """events with the column emptied where it points to a deleted key; no row is lost."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    joined = events.join(gone, events[column] == gone["_gone"], "left")
    return joined.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")


def activate(profiles: DataFrame, target: int) -> DataFrame:
    return profiles.withColumn("is_active", F.col("id") == target)


def enqueue(jobs: DataFrame, source_ids: DataFrame) -> DataFrame:
    """jobs with a fresh queued job for each source; an existing one is reset under its id."""
    old = jobs.select("source_id", F.col("id").alias("_id"))
    top = jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    wanted = source_ids.select("source_id").distinct().join(old, "source_id", "left")
    new = store.numbered(wanted.where("_id is null").select("source_id"), "source_id", "_n").crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("_n")).alias("id"), "source_id")
    again = wanted.where("_id is not null").select(F.col("_id").alias("id"), "source_id")
    fresh = new.unionByName(again).select("id", "source_id", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("double").alias("claimed_at"), F.lit("").alias("error"))
    return upsert(jobs, fresh, "source_id")


def claimable(now: float) -> Column:
    return (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("claimed_at") < now - VISIBILITY_SECONDS))


def claim_next(jobs: DataFrame, now: float, n: int = 1) -> DataFrame:
    """The n claimable jobs of lowest id, as they are after the claim: queued ones and stale running ones alike."""
    return jobs.where(claimable(now)).orderBy("id").limit(n).withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "claimed_at": F.lit(float(now))})


def finish(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """jobs after outcomes (id, ok, error): only running ones change; failures are queued again below the attempt limit."""
    j = jobs.join(outcomes.select("id", "ok", F.col("error").alias("_error")), "id", "left")
    mine = (F.col("status") == "running") & F.col("ok").isNotNull()
    after = F.when(F.col("ok"), "done").when(F.col("attempts") < MAX_ATTEMPTS, "queued").otherwise("failed")
    error = F.when(F.col("ok"), "").otherwise(F.substring(F.coalesce("_error", F.lit("")), 1, 500))
    return j.withColumns({"error": F.when(mine, error).otherwise(F.col("error")), "claimed_at": F.when(mine & ~F.col("ok") & (F.col("attempts") < MAX_ATTEMPTS), None).otherwise(F.col("claimed_at")), "status": F.when(mine, after).otherwise(F.col("status"))}).drop("ok", "_error")


def lease_state(locks: DataFrame, now: float) -> DataFrame:
    """(key, held, acquirable): a lease older than its time is free again."""
    age = F.lit(float(now)) - F.col("acquired_at")
    held = F.coalesce(age <= LEASE_SECONDS, F.lit(False))
    return locks.select("notebook_id", held.alias("held"), (~held).alias("acquirable"))


def ttl_valid(saved_at: Column, now: Column) -> Column:
    return F.coalesce(saved_at > now - F.expr(f"INTERVAL {TTL_HOURS} HOURS"), F.lit(False))


def relative_age(at: Column, now: Column) -> Column:
    """now, minutes, hours or days ago, or the date."""
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    n = lambda k: F.floor(s / k).cast("string")
    return F.when(s < 60, "now").when(s < 3_600, F.concat(n(60), F.lit("m"))).when(s < 86_400, F.concat(n(3_600), F.lit("h"))).when(s < 7 * 86_400, F.concat(n(86_400), F.lit("d"))).otherwise(F.date_format(at, "yyyy-MM-dd"))


def vector_id(chunk_id: Column) -> Column:
    return F.concat(F.lit("chunk:"), chunk_id.cast("string"))


def index_plan(chunks: DataFrame, index: DataFrame, mode: str = "diff") -> DataFrame:
    """(vector_id, action): diff upserts the missing and deletes orphans, full upserts all and deletes nothing."""
    ids = chunks.select(vector_id(F.col("id")).alias("vector_id"))
    if mode == "full":
        return ids.withColumn("action", F.lit("upsert"))
    if mode != "diff":
        raise ValueError(f"unknown mode {mode!r}")
    have = index.select("vector_id")
    return ids.join(have, "vector_id", "left_anti").withColumn("action", F.lit("upsert")).unionByName(have.join(ids, "vector_id", "left_anti").withColumn("action", F.lit("delete")))


def index_status(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """One row: counts of both sides, missing, orphaned, and whether they agree."""
    a = chunks.select(vector_id(F.col("id")).alias("vector_id"), F.lit(1).alias("c"))
    both = a.join(index.select("vector_id", F.lit(1).alias("v")), "vector_id", "full_outer")
    out = both.agg(F.count("c").alias("chunks"), F.count("v").alias("vectors"), F.count_if(F.col("v").isNull()).alias("missing"), F.count_if(F.col("c").isNull()).alias("orphans"))
    return out.withColumn("in_sync", (F.col("missing") == 0) & (F.col("orphans") == 0))


def apply_plan(index: DataFrame, plan: DataFrame, vectors: DataFrame) -> DataFrame:
    """The index after a plan: (vector_id, embedding) rows of `vectors` are taken for upserts."""
    kept = index.join(plan.select("vector_id"), "vector_id", "left_anti")
    return kept.unionByName(vectors.join(plan.where("action = 'upsert'").select("vector_id"), "vector_id", "left_semi").select(*index.columns))


def attach_message(events: DataFrame, watermark: int, context: Column, call_types: list[str], message_id: int) -> DataFrame:
    """Fill the message of events after a watermark that match a context and have none yet."""
    mine = (F.col("id") > watermark) & context & F.col("call_type").isin(call_types) & F.col("message_id").isNull()
    return events.withColumn("message_id", F.when(mine, F.lit(message_id).cast("long")).otherwise(F.col("message_id")))
