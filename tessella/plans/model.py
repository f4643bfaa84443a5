"""The engine's tables made from the driver's: each as a DataFrame and as a WITH clause of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions import text as X
from ..operators import chunking, embedding
from ..operators import postings as P
from ..operators import vector_index as V
from . import sql

BASE = "TIMESTAMP '2024-01-01 00:00:00'"
TENANTS = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    user = F.expr("cast(substring(source, 4) as bigint)")
    return d.select(
        F.col("doc_id").alias("source_id"), user.alias("user_id"), user.alias("notebook_id"), F.concat_ws("/", "source", "doc_id").alias("filename"),
        F.when(F.col("doc_id") % 17 == 0, "failed").otherwise("indexed").alias("status"), F.expr(f"{BASE} + make_interval(0, 0, 0, 0, 0, 0, doc_id)").alias("updated_at"), "text",
    )


SOURCES = f"""sources AS (SELECT doc_id AS source_id, substr(source, 4)::BIGINT AS user_id, substr(source, 4)::BIGINT AS notebook_id, source || '/' || doc_id AS filename,
  CASE WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'indexed' END AS status, {BASE} + to_seconds(doc_id) AS updated_at, text FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks; a session makes them once for each state of the documents, and plans read the columns they need."""

    def make() -> DataFrame:
        return chunking.chunk_sources(store.spread(sources(spark, sf_dir))).withColumn("id", F.col("source_id") * 1_000_000 + F.col("chunk_index"))

    return store.kept(spark, f"chunks of {sf_dir} {store.state_of(spark, f'{sf_dir}/documents.parquet')}", make)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, entries) of all indexed chunks, made once like these."""

    def make() -> DataFrame:
        live = chunks(spark, sf_dir).where("status = 'indexed'").select("id", "user_id", "text")
        return embedding.sparse(embedding.hash_entries(live, "id", "text", "user_id"), "id", "user_id")

    return store.kept(spark, f"vectors of {sf_dir} {store.state_of(spark, f'{sf_dir}/documents.parquet')}", make)


def vector_index(spark: SparkSession, sf_dir: str) -> V.VectorIndex:
    """The index of all embeddings' cells, built once like the chunks."""
    state = store.state_of(spark, f"{sf_dir}/embeddings.parquet")
    return store.kept_in_folder(spark, f"cells of {sf_dir} {state}", lambda path: V.build(read(spark, sf_dir, "embeddings"), path))


def postings(spark: SparkSession, sf_dir: str) -> P.Postings:
    """The index of all indexed chunks' words, its tables made once like the chunks."""
    state = store.state_of(spark, f"{sf_dir}/documents.parquet")
    live = chunks(spark, sf_dir).where("status = 'indexed'").select("id", "user_id", "text")
    return P.build(live, 80, lambda name, make: store.kept(spark, f"postings {name} of {sf_dir} {state}", make))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.spread(read(spark, sf_dir, "documents"))


CHUNKS = f"""{SOURCES},
 normal AS (SELECT *, {sql.horizontal('text')} AS n FROM sources),
 sized AS (SELECT *, CASE WHEN {sql.cjk_ratio('n')} >= 0.3 THEN 400 ELSE 800 END AS target FROM normal),
 folded AS (SELECT * EXCLUDE (text, n), {sql.chunks('n', 'target')} AS cs FROM sized),
 chunks AS (SELECT source_id * 1000000 + i AS id, source_id, user_id, notebook_id, filename, status, updated_at, i AS chunk_index, 'document' AS location, cs[i + 1] AS text
  FROM folded, unnest(range(0, len(cs))) AS u(i))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    words = F.split(X.collapse(F.col("text")), " ")
    return b.select(F.col("item_id").alias("question_id"), (F.col("item_id") % TENANTS).alias("user_id"), F.array_join(F.slice(words, 1, 12), " ").alias("question"), F.substring("text", 1, 60).alias("evidence"))


QUESTIONS = f"""questions AS (SELECT item_id AS question_id, item_id % {TENANTS} AS user_id, array_to_string(string_split({sql.collapse('text')}, ' ')[1:12], ' ') AS question, substring(text, 1, 60) AS evidence FROM benchmark)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"), (F.col("conv_id") % TENANTS).alias("user_id"), (F.col("conv_id") % TENANTS).alias("notebook_id"),
        "role", F.col("text").alias("content"), F.expr(f"{BASE} + make_interval(0, 0, 0, 0, 0, 0, conv_id * 60 + turn div 2)").alias("created_at"),
    )


MESSAGES = f"""messages AS (SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, conv_id % {TENANTS} AS user_id, conv_id % {TENANTS} AS notebook_id, role, text AS content,
  {BASE} + to_seconds(conv_id * 60 + turn // 2) AS created_at FROM conversations)"""


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("id"), "user_id", (F.col("user_id") % TENANTS).alias("notebook_id"), F.col("event_type").alias("call_type"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("value").alias("latency_ms"), k.alias("input_chars"), (k % 7).alias("output_chars"), F.col("ts").alias("created_at"))


USAGE = f"""usage AS (SELECT event_id AS id, user_id, user_id % {TENANTS} AS notebook_id, event_type AS call_type, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, value AS latency_ms,
  (props::JSON->>'$.k')::BIGINT AS input_chars, (props::JSON->>'$.k')::BIGINT % 7 AS output_chars, ts AS created_at FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    state = F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "failed", "running"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("source_id"), state.alias("status"), (F.col("doc_id") % 4).cast("int").alias("attempts"), F.when(F.col("doc_id") % 5 == 0, None).otherwise((F.col("doc_id") * 10).cast("double")).alias("claimed_at"), F.lit("").alias("error"))


JOBS = """jobs AS (SELECT doc_id AS id, doc_id AS source_id, ['queued', 'running', 'done', 'failed', 'running'][(doc_id % 5 + 1)::INT] AS status, (doc_id % 4)::INT AS attempts,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id * 10)::DOUBLE END AS claimed_at, '' AS error FROM documents)"""


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked chunks of evaluation items, from order lines: item, rank, chunk, source, score, text."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").cast("int").alias("rank"), F.col("l_partkey").alias("chunk_id"), F.col("l_suppkey").alias("source_id"), (F.col("l_discount") * 10).alias("score"), F.concat_ws(" ", "l_returnflag", "l_partkey", "l_quantity").alias("text"))


RETRIEVED = """retrieved AS (SELECT l_orderkey AS item_id, l_linenumber::INT AS rank, l_partkey AS chunk_id, l_suppkey AS source_id, l_discount * 10 AS score, l_returnflag || ' ' || l_partkey || ' ' || l_quantity AS text FROM lineitem)"""


def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per order: what it expects (a source, a chunk, substrings, or nothing), in three sets."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("item_id"), (k % 3).alias("eval_set_id"), F.concat(F.lit("Q"), k).alias("question"), F.when(k % 4 == 0, k % 10 + 1).alias("expected_source_id"), F.when(k % 16 == 4, k % 50 + 1).alias("expected_chunk_id"),
        F.when(k % 4 == 1, F.array(F.lit("R 1"), F.lit("A 7"))).when(k % 4 == 2, F.array(F.lit("N 5"))).otherwise(F.array().cast("array<string>")).alias("expected_substrings"), (k % 2 == 0).alias("approved"), (F.col("o_totalprice") / 1000).alias("latency_ms"), (F.col("o_orderpriority") == "1-URGENT").alias("failed"),
    )


EVAL_ITEMS = """eval_items AS (SELECT o_orderkey AS item_id, o_orderkey % 3 AS eval_set_id, 'Q' || o_orderkey AS question, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 10 + 1 END AS expected_source_id,
  CASE WHEN o_orderkey % 16 = 4 THEN o_orderkey % 50 + 1 END AS expected_chunk_id, CASE o_orderkey % 4 WHEN 1 THEN ['R 1', 'A 7'] WHEN 2 THEN ['N 5'] ELSE []::VARCHAR[] END AS expected_substrings,
  o_orderkey % 2 = 0 AS approved, o_totalprice / 1000 AS latency_ms, o_orderpriority = '1-URGENT' AS failed FROM orders)"""
