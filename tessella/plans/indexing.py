"""Index reconciliation, queue, leases, caches and table rewrites."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tables as O
from ..sources import lease
from ..streaming.jobs import work_dir
from . import model
from .registry import Plans

PLANS = Plans()

NOW = 6_000.0

#: An index that lacks some chunks and holds some that are gone.
_INDEX = f"""{model.CHUNKS}, live AS (SELECT * FROM chunks WHERE status = 'indexed'), idx AS (SELECT 'chunk:' || id AS vector_id FROM live WHERE id % 7 <> 0 UNION ALL SELECT 'chunk:' || (id + 500000) FROM live WHERE id % 11 = 0),
 ids AS (SELECT 'chunk:' || id AS vector_id FROM live)"""


def _index(spark, sf_dir):
    live = model.chunks(spark, sf_dir).where("status = 'indexed'").select("id")
    have = live.where("id % 7 <> 0").select(O.vector_id(F.col("id")).alias("vector_id"))
    return live, have.unionByName(live.where("id % 11 = 0").select(O.vector_id(F.col("id") + 500_000).alias("vector_id")))


@PLANS.add(f"""WITH {_INDEX} SELECT (SELECT count(*) FROM ids) AS chunks, (SELECT count(*) FROM idx) AS vectors, (SELECT count(*) FROM ids WHERE vector_id NOT IN (SELECT vector_id FROM idx)) AS missing, (SELECT count(*) FROM idx WHERE vector_id NOT IN (SELECT vector_id FROM ids)) AS orphans, false AS in_sync""")
def index_status(spark, sf_dir):
    """V-10, S-09, S-10, A-10, X-22"""
    return O.index_status(*_index(spark, sf_dir))


@PLANS.add(f"""WITH {_INDEX} SELECT vector_id, 'upsert' AS action FROM ids ANTI JOIN idx USING (vector_id) UNION ALL SELECT vector_id, 'delete' FROM idx ANTI JOIN ids USING (vector_id)""")
def index_diff_plan(spark, sf_dir):
    """K-07, U-03, S-11"""
    return O.index_plan(*_index(spark, sf_dir))


@PLANS.add(f"WITH {_INDEX} SELECT vector_id, 'upsert' AS action FROM ids")
def index_full_plan(spark, sf_dir):
    """K-07, B-30"""
    return O.index_plan(*_index(spark, sf_dir), mode="full")


@PLANS.add(f"WITH {_INDEX} SELECT vector_id FROM idx ANTI JOIN ids USING (vector_id)")
def orphan_vectors(spark, sf_dir):
    """U-03"""
    return O.index_plan(*_index(spark, sf_dir)).where("action = 'delete'").select("vector_id")


@PLANS.add(f"WITH {model.JOBS} SELECT id, source_id, 'running' AS status, attempts + 1 AS attempts, {NOW} AS claimed_at FROM jobs WHERE status = 'queued' OR (status = 'running' AND claimed_at < {NOW} - 1800) ORDER BY id LIMIT 10")
def job_claim(spark, sf_dir):
    """K-02, B-35, X-43"""
    return O.claim_next(model.jobs(spark, sf_dir), NOW, 10).drop("error")


@PLANS.add(f"""WITH {model.JOBS}, o AS (SELECT doc_id AS id, doc_id % 3 = 0 AS ok, 'boom ' || doc_id AS e FROM documents WHERE doc_id % 2 = 0)
 SELECT j.id, j.source_id, CASE WHEN j.status = 'running' AND ok IS NOT NULL THEN CASE WHEN ok THEN 'done' WHEN attempts < 3 THEN 'queued' ELSE 'failed' END ELSE j.status END AS status, attempts,
 CASE WHEN j.status = 'running' AND NOT ok AND attempts < 3 THEN NULL ELSE claimed_at END AS claimed_at, CASE WHEN j.status = 'running' AND ok IS NOT NULL THEN CASE WHEN ok THEN '' ELSE e END ELSE '' END AS error FROM jobs j LEFT JOIN o USING (id)""")
def job_retry_transition(spark, sf_dir):
    """K-03, M-03, X-35"""
    o = model.read(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3 == 0).alias("ok"), F.concat(F.lit("boom "), F.col("doc_id").cast("string")).alias("error"))
    return O.finish(model.jobs(spark, sf_dir), o)


@PLANS.add(f"""WITH {model.JOBS}, w AS (SELECT DISTINCT o_custkey AS source_id FROM orders), n AS (SELECT source_id, row_number() OVER (ORDER BY source_id) + (SELECT max(id) FROM jobs) AS id FROM w ANTI JOIN jobs USING (source_id))
 SELECT * FROM (SELECT id, source_id, status, attempts, claimed_at, error FROM jobs ANTI JOIN w USING (source_id) UNION ALL SELECT j.id, j.source_id, 'queued', 0, NULL, '' FROM jobs j JOIN w USING (source_id) UNION ALL SELECT id, source_id, 'queued', 0, NULL, '' FROM n)""")
def upsert_jobs(spark, sf_dir):
    """K-01, M-01, M-02"""
    return O.enqueue(model.jobs(spark, sf_dir), model.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id")))


@PLANS.add("WITH l AS (SELECT DISTINCT user_id AS notebook_id, (user_id * 40)::DOUBLE AS acquired_at FROM events) SELECT notebook_id, 6000 - acquired_at <= 90 AS held, NOT (6000 - acquired_at <= 90) AS acquirable FROM l")
def lease_state(spark, sf_dir):
    """K-05"""
    locks = model.read(spark, sf_dir, "events").select(F.col("user_id").alias("notebook_id"), (F.col("user_id") * 40).cast("double").alias("acquired_at")).distinct()
    return O.lease_state(locks, NOW)


#: Notebooks by user; the first holder by name of every round, and what came of notebooks released rightly, wrongly or not at all.
@PLANS.add("""WITH n AS (SELECT user_id AS notebook_id, min('a' || event_id) AS a, min('c' || event_id) AS c FROM events GROUP BY user_id)
 SELECT notebook_id, CASE WHEN notebook_id % 3 = 1 THEN c WHEN notebook_id % 3 = 2 THEN 'd' ELSE a END AS holder, CASE WHEN notebook_id % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS token, CASE notebook_id % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 160.0 ELSE 195.0 END::DOUBLE AS acquired_at, 1 + (notebook_id % 3 > 0)::INT AS grants FROM n""")
def lease_contest(spark, sf_dir):
    """K-05: of all contenders for a notebook one wins; a held lease is refused, a released or stale one goes to another under a new token"""
    path = work_dir(spark, "leases")
    e = model.read(spark, sf_dir, "events").select(F.col("user_id").alias("notebook_id"), "event_id")
    named = lambda who: e.select("notebook_id", F.concat(F.lit(who), F.col("event_id").cast("string")).alias("holder"))
    won = [lease.acquire(named("a"), path, 100.0), lease.acquire(named("b"), path, 150.0)]
    # Only the holder's own token gives a lease back.
    lease.release(won[0].where("notebook_id % 3 = 1"), path)
    lease.release(won[0].where("notebook_id % 3 = 0").withColumn("token", F.col("token") + 1), path)
    won.append(lease.acquire(named("c"), path, 160.0))
    # What was granted at 100 is stale at 195, what was granted at 160 is not.
    late = e.where("notebook_id % 3 > 0").select("notebook_id", F.lit("d").alias("holder"))
    won.append(lease.acquire(late, path, 195.0))
    grants = functools.reduce(DataFrame.unionByName, won).groupBy("notebook_id").agg(F.count(F.lit(1)).cast("int").alias("grants"))
    return lease.leases(spark, path).join(grants, "notebook_id")


@PLANS.add("SELECT event_id, ts > TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 24 HOURS AND event_type <> 'error' AS usable FROM events")
def ttl_cache(spark, sf_dir):
    """K-06, X-41"""
    ok = O.ttl_valid(F.col("ts"), F.lit("2024-01-10 00:00:00").cast("timestamp")) & (F.col("event_type") != "error")
    return model.read(spark, sf_dir, "events").select("event_id", ok.alias("usable"))


@PLANS.add("""WITH a AS (SELECT event_id, ts, epoch(TIMESTAMP '2024-01-31 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events)
 SELECT event_id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' WHEN s < 604800 THEN (s // 86400) || 'd' ELSE strftime(ts, '%Y-%m-%d') END AS age FROM a""")
def relative_age(spark, sf_dir):
    """X-42, X-40"""
    return model.read(spark, sf_dir, "events").select("event_id", O.relative_age(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("age"))


@PLANS.add(f"""WITH {model.CHUNKS} SELECT 'sources' AS tbl, count(*) AS rows_left FROM sources WHERE user_id <> 3 UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE source_id NOT IN (SELECT source_id FROM sources WHERE user_id = 3)
 UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'events_kept_user', count(*) FROM events WHERE user_id <> 3""")
def cascade_delete(spark, sf_dir):
    """M-04, M-05, B-36: a tenant's sources and chunks go, its events stay without the link"""
    s = model.sources(spark, sf_dir)
    gone = s.where("user_id = 3").select("source_id")
    left, (chunks,) = (lambda x: (x[0], x[1:]))(O.cascade(s, [(model.chunks(spark, sf_dir), "source_id")], gone, "source_id"))
    users = spark.range(3, 4).withColumnRenamed("id", "uid")
    events = O.set_null(model.read(spark, sf_dir, "events"), "user_id", users, "uid")
    count = lambda d, n, c="*": d.agg(F.count(c if c != "*" else F.lit(1)).alias("rows_left")).select(F.lit(n).alias("tbl"), "rows_left")
    return count(left, "sources").unionByName(count(chunks, "chunks")).unionByName(count(events, "events")).unionByName(count(events, "events_kept_user", "user_id"))


@PLANS.add("""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_nationkey::BIGINT END AS notebook_id, c_custkey % 50 AS user_id FROM customer), d AS (SELECT user_id, 1000 + user_id AS nb FROM (SELECT DISTINCT user_id FROM c WHERE notebook_id IS NULL))
 SELECT id, user_id, coalesce(notebook_id, nb) AS notebook_id FROM c LEFT JOIN d USING (user_id)""")
def backfill_default(spark, sf_dir):
    """M-06, F-09: a default parent for rows without one"""
    c = model.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey").cast("long")).alias("notebook_id"), (F.col("c_custkey") % 50).alias("user_id"))
    d = c.where("notebook_id is null").select("user_id").distinct().withColumn("nb", F.col("user_id") + 1000)
    return c.join(d, "user_id", "left").select("id", "user_id", F.coalesce("notebook_id", "nb").alias("notebook_id"))


@PLANS.add(f"WITH {model.USAGE} SELECT id, CASE WHEN id > 500 AND notebook_id = 3 AND call_type IN ('click', 'view') AND id % 10 <> 0 THEN 77 WHEN id % 10 = 0 THEN 5 END::BIGINT AS message_id FROM usage")
def watermark_attach(spark, sf_dir):
    """M-09"""
    u = model.usage_events(spark, sf_dir).withColumn("message_id", F.when(F.col("id") % 10 == 0, 5).cast("long"))
    return O.attach_message(u, 500, F.col("notebook_id") == 3, ["click", "view"], 77).select("id", "message_id")


@PLANS.add("SELECT s_suppkey AS id, s_suppkey = 7 AS is_active FROM supplier")
def set_active_profile(spark, sf_dir):
    """M-07"""
    return O.activate(model.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(True).alias("is_active")), 7)
