"""Sentences, chunks, tokens and embeddings of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, embedding
from . import model, sql
from .registry import Plans

PLANS = Plans()


@PLANS.add(f"SELECT doc_id, i + 1 AS nr, s[i + 1] AS sentence FROM (SELECT doc_id, {sql.sentences(sql.horizontal('text'))} AS s FROM documents), unnest(range(0, len(s))) AS u(i)")
def sentence_split(spark, sf_dir):
    """C-01, C-04"""
    d = model.documents(spark, sf_dir)
    return d.select("doc_id", F.posexplode(X.sentences(X.normalise_horizontal(F.col("text")))).alias("p", "sentence")).select("doc_id", (F.col("p") + 1).cast("long").alias("nr"), "sentence")


@PLANS.add(f"SELECT doc_id, i + 1 AS nr, t[i + 1] AS token FROM (SELECT doc_id, {sql.latin_tokens('text')} AS t FROM documents), unnest(range(0, len(t))) AS u(i)")
def tokenize_latin(spark, sf_dir):
    """R-02"""
    d = model.documents(spark, sf_dir)
    return d.select("doc_id", F.posexplode(X.latin_tokens(F.col("text"))).alias("p", "token")).select("doc_id", (F.col("p") + 1).cast("long").alias("nr"), "token")


_MIXED = "CASE WHEN doc_id % 3 = 0 THEN text || '檢索增強生成，需要可靠的引用。' WHEN doc_id % 3 = 1 THEN text || repeat('檢索增強生成系統', CAST(floor(length(text) / 12) AS INT) + 1) ELSE text END"


def _mixed(spark, sf_dir):
    return model.documents(spark, sf_dir).select("doc_id", F.expr(_MIXED).alias("text"))


_MIXED_SQL = f"WITH m AS (SELECT doc_id, {_MIXED} AS text FROM documents)"


@PLANS.add(f"{_MIXED_SQL} SELECT doc_id, round({sql.cjk_ratio('text')}, 9) AS ratio, {sql.cjk_ratio('text')} >= 0.3 AS is_cjk, CASE WHEN {sql.cjk_ratio('text')} >= 0.3 THEN 400 ELSE 800 END AS target FROM m")
def cjk_ratio(spark, sf_dir):
    """C-02, C-03"""
    t = F.col("text")
    return _mixed(spark, sf_dir).select("doc_id", F.round(X.cjk_ratio(t), 9).alias("ratio"), X.is_mostly_cjk(t).alias("is_cjk"), X.chunk_target(t).alias("target"))


#: A few Han characters behind whole texts: the SQL takes n-grams one by one.
_SOME_HAN = "CASE WHEN doc_id % 3 < 2 THEN text || '檢索增強生成，需要可靠的引用。' ELSE text END"


@PLANS.add(f"WITH g AS (SELECT doc_id, {sql.search_tokens(_SOME_HAN)} AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, coalesce(t[len(t)], '') AS last_token FROM g")
def cjk_ngrams(spark, sf_dir):
    """R-02, R-03"""
    d = model.documents(spark, sf_dir).select("doc_id", F.expr(_SOME_HAN).alias("text"))
    t = d.select("doc_id", X.search_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.coalesce(F.get("t", F.size("t") - 1), F.lit("")).alias("last_token"))


@PLANS.add(f"WITH l AS (SELECT doc_id, replace(replace({sql.horizontal('text')}, '.', ','), chr(10), ' ') AS s FROM documents), p AS (SELECT doc_id, {sql.split_long('s', '300')} AS ps FROM l) SELECT doc_id, i + 1 AS nr, ps[i + 1] AS piece FROM p, unnest(range(0, len(ps))) AS u(i)")
def long_sentence_split(spark, sf_dir):
    """C-05"""
    d = model.documents(spark, sf_dir)
    one = F.translate(X.normalise_horizontal(F.col("text")), ".\n", ", ")
    return d.select("doc_id", F.posexplode(X.split_long(one, F.lit(300))).alias("p", "piece")).select("doc_id", (F.col("p") + 1).cast("long").alias("nr"), "piece")


@PLANS.add(f"WITH {model.CHUNKS} SELECT id, source_id, user_id, chunk_index, location, text FROM chunks")
def chunk_pack(spark, sf_dir):
    """C-01..C-05, C-08..C-10"""
    return model.chunks(spark, sf_dir).select("id", "source_id", "user_id", F.col("chunk_index").cast("long").alias("chunk_index"), "location", "text")


_CATEGORY = f"""CASE WHEN {sql.cjk_ratio('text')} >= 0.5 THEN 'cjk' WHEN (length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))) / greatest(1, length(text))::DOUBLE >= 0.5 THEN 'latin' ELSE 'mixed' END"""


@PLANS.add(f"WITH {model.CHUNKS}, k AS (SELECT {_CATEGORY} AS category, length(text) AS n FROM chunks) SELECT category, count(*) AS chunks, round(avg(n), 6) AS mean_chars, max(n) AS max_chars, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99 FROM k GROUP BY category")
def chunk_stats_by_category(spark, sf_dir):
    """Q-13, A-08, X-16"""
    t = F.col("text")
    latin = F.regexp_count(t, F.lit("[A-Za-z]")) / F.greatest(F.lit(1), F.length(t))
    k = model.chunks(spark, sf_dir).select(F.when(X.cjk_ratio(t) >= 0.5, "cjk").when(latin >= 0.5, "latin").otherwise("mixed").alias("category"), F.length(t).alias("n"))
    p = F.percentile("n", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = k.groupBy("category").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("n"), 6).alias("mean_chars"), F.max("n").cast("long").alias("max_chars"), p.alias("p"))
    return out.select("category", "chunks", "mean_chars", "max_chars", *(F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))))


@PLANS.add(f"WITH {model.CHUNKS} SELECT source_id, count(*) AS chunks, min(chunk_index) AS first_index, max(chunk_index) AS last_index FROM chunks GROUP BY source_id")
def chunk_numbering(spark, sf_dir):
    """C-10"""
    return model.chunks(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"), F.min("chunk_index").cast("long").alias("first_index"), F.max("chunk_index").cast("long").alias("last_index"))


@PLANS.add(embedding.hash_sql("documents", "doc_id", "text") + " SELECT doc_id, bucket, round(weight, 9) AS weight FROM hashed_documents")
def hash_embed(spark, sf_dir):
    """E-07"""
    h = embedding.hash_entries(model.documents(spark, sf_dir), "doc_id", "text")
    return h.select("doc_id", "bucket", F.round("weight", 9).alias("weight"))


@PLANS.add("SELECT doc_id, 'query: ' || text AS as_query, 'passage: ' || text AS as_passage FROM documents")
def embedding_prefix(spark, sf_dir):
    """E-01"""
    t = F.col("text")
    return model.documents(spark, sf_dir).select("doc_id", embedding.with_prefix(t, "query:").alias("as_query"), embedding.with_prefix(t, "passage: ").alias("as_passage"))
