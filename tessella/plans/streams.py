"""Streaming jobs run over what is there, compared by their final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as O
from ..streaming import jobs, queue
from . import model
from .registry import Plans

PLANS = Plans()


def _stream(spark, sf_dir, name, columns):
    """A table as a stream of files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 5).parquet(f"{path}*").select(*columns)


@PLANS.add(f"WITH {model.CHUNKS} SELECT source_id, count(*) AS chunks, 'indexed' AS status FROM chunks GROUP BY source_id")
def stream_ingest(spark, sf_dir):
    """C-10: every new source is chunked once"""
    out = jobs.work_dir(spark, "ingest")
    jobs.ingest(_stream(spark, sf_dir, "documents", [F.col("doc_id").alias("source_id"), "text"]), f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data/state").select("source_id", "chunks", "status")


#: Three events of a job a minute apart, then nothing for longer than a claim holds.
_KINDS = "CASE floor(value)::INT % 5 WHEN 0 THEN 'request' WHEN 3 THEN 'done' WHEN 4 THEN 'fail' ELSE 'claim' END"
_STEP = f"""CASE
 WHEN x.k = 'tick' THEN CASE WHEN a.s = 'running' AND x.sec > a.c + {O.VISIBILITY_SECONDS} THEN {{'k': '', 'sec': 0.0, 's': CASE WHEN a.n < {O.MAX_ATTEMPTS} THEN 'queued' ELSE 'failed' END, 'n': a.n, 'c': 0.0, 'e': 'worker lost'}} ELSE a END
 WHEN x.k = 'request' AND a.s NOT IN ('queued', 'running') THEN {{'k': '', 'sec': 0.0, 's': 'queued', 'n': 0, 'c': 0.0, 'e': ''}}
 WHEN x.k = 'claim' AND a.s = 'queued' THEN {{'k': '', 'sec': 0.0, 's': 'running', 'n': a.n + 1, 'c': x.sec, 'e': ''}}
 WHEN x.k = 'done' AND a.s = 'running' THEN {{'k': '', 'sec': 0.0, 's': 'done', 'n': a.n, 'c': 0.0, 'e': ''}}
 WHEN x.k = 'fail' AND a.s = 'running' THEN {{'k': '', 'sec': 0.0, 's': CASE WHEN a.n < {O.MAX_ATTEMPTS} THEN 'queued' ELSE 'failed' END, 'n': a.n, 'c': 0.0, 'e': 'boom'}} ELSE a END"""


@PLANS.add(f"""WITH e AS (SELECT event_id AS seq, event_id // 3 % 29 AS job_id, (event_id * 60)::DOUBLE AS sec, {_KINDS} AS k FROM events),
 items AS (SELECT job_id, sec, 1 AS o, k FROM e UNION ALL SELECT job_id, sec, 0, 'tick' FROM e UNION ALL SELECT DISTINCT job_id, (SELECT max(sec) FROM e) - 1, 2, 'tick' FROM e),
 lists AS (SELECT job_id, list({{'k': k, 'sec': sec, 's': '', 'n': 0, 'c': 0.0::DOUBLE, 'e': ''}} ORDER BY sec, o) AS l FROM items GROUP BY job_id),
 ended AS (SELECT job_id, list_reduce(list_prepend({{'k': '', 'sec': 0.0::DOUBLE, 's': '', 'n': 0, 'c': 0.0::DOUBLE, 'e': ''}}, l), lambda a, x: {_STEP}) AS r FROM lists)
 SELECT job_id, r.s AS status, r.n::INT AS attempts, r.e AS error FROM ended WHERE r.s <> ''""")
def job_queue_stream(spark, sf_dir):
    """K-02, K-03, K-04: requests, claims and outcomes as a stream in two runs over one checkpoint; a claim held too long comes back by its timer"""
    out = jobs.work_dir(spark, "queue")
    v = F.floor("value").cast("int") % 5
    kind = F.when(v == 0, "request").when(v == 3, "done").when(v == 4, "fail").otherwise("claim")
    i = F.col("event_id")
    e = model.read(spark, sf_dir, "events").select(F.pmod(F.floor(i / 3), F.lit(29)).alias("job_id"), i.alias("seq"), (i * 60).cast("double").alias("at"), kind.alias("kind"), F.when(kind == "fail", "boom").alias("error"))
    middle = e.agg(F.max("seq") / 2).head()[0]
    for part in (e.where(F.col("seq") <= middle), e.where(F.col("seq") > middle)):
        part.repartition("job_id").write.mode("append").parquet(f"{out}/events")
        queue.run_queue(spark.readStream.schema(e.schema).parquet(f"{out}/events"), f"{out}/changes", f"{out}/checkpoint")
    return queue.states(spark.read.parquet(f"{out}/changes")).withColumn("error", F.coalesce("error", F.lit("")))


@PLANS.add("""SELECT 'chunk:' || event_id AS vector_id FROM events WHERE event_id % 7 <> 2""")
def stream_index_sync(spark, sf_dir):
    """K-07 as a stream of chunk changes (here events): repeated ids come in once, a deleted chunk's vector goes, orphans go when their chunk is reported gone"""
    out = jobs.work_dir(spark, "sync")
    i = F.col("event_id")
    e = model.read(spark, sf_dir, "events").select(i.alias("id"), i.alias("seq"), F.lit(False).alias("deleted"))
    start = e.where("id % 3 = 0").select(O.vector_id(F.col("id")).alias("vector_id")).unionByName(e.where("id % 5 = 0").select(O.vector_id(F.col("id") + 1_000_000_000).alias("vector_id")))
    jobs.put_index(start, f"{out}/index")
    again = e.select("id", (F.col("seq") + 2_000_000_000).alias("seq"), (F.col("id") % 7 == 2).alias("deleted"))
    orphans = e.where("id % 5 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "seq", F.lit(True).alias("deleted"))
    for part in (e.unionByName(e.where("id % 4 = 0")), again.unionByName(orphans)):
        part.repartition(2).write.mode("append").parquet(f"{out}/changes")
        jobs.sync_index(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/changes"), f"{out}/index", f"{out}/checkpoint")
    return jobs.read_index(spark, f"{out}/index").select("vector_id")
