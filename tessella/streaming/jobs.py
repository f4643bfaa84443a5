"""Structured Streaming jobs: ingest of new documents, and incremental index reconciliation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..operators import chunking
from ..operators import tables as O
from ..sources import files


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one; only a local session may lack that and take a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-stream-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, step, checkpoint: str) -> None:
    """Hand everything that is there to step(batch, batch_id) and stop; each batch exactly once by the checkpoint."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()


def ingest(sources: DataFrame, out: str, checkpoint: str) -> None:
    """Chunk every new source of a stream (source_id, text, ...) into out: a chunk folder, and a state row a source.

    A source without any chunk fails on its own and does not stop the batch. A repeated batch overwrites its own
    folder, so a restart leaves no duplicates.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        chunks = chunking.chunk_sources(batch)
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={batch_id}")
        counts = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"))
        state = batch.select("source_id").join(counts, "source_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long")))
        state = state.withColumn("status", F.when(F.col("chunks") > 0, "indexed").otherwise("failed")).withColumn("error", F.when(F.col("chunks") > 0, "").otherwise("no readable text"))
        state.write.mode("overwrite").parquet(f"{out}/state/batch={batch_id}")

    run_once(sources, step, checkpoint)


def put_index(vectors: DataFrame, path: str) -> None:
    """Add or replace vectors (vector_id, ...) of a kept index; all others stay."""
    files.write_keyed(vectors, path, "vector_id")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return files.read_keyed(spark, path)


def sync_index(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Keep an index in step with a stream of chunk changes (id, seq, deleted).

    Of the changes of an id in a batch the last by seq counts. Each batch is planned against the index as it stands:
    vectors that are missing are added, those of deleted chunks go, whether this stream added them or they were orphans,
    and what is there already stays untouched. Only the index's buckets that a batch falls into are read and written
    anew. A batch that is repeated after a crash finds its work done and changes nothing.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = batch.where("id is not null").groupBy("id").agg(F.max_by("deleted", "seq").alias("deleted"))
        wanted = store.written(last.select(O.vector_id(F.col("id")).alias("vector_id"), "deleted"))
        have = files.read_keyed(spark, path, wanted.select("vector_id"), "vector_id").select("vector_id")
        new = wanted.where("not deleted").select("vector_id").join(have, "vector_id", "left_anti")
        gone = wanted.where("deleted").select("vector_id").join(have, "vector_id", "left_semi")
        files.write_keyed(store.written(new), path, "vector_id", gone=store.written(gone))

    run_once(changes, step, checkpoint)
