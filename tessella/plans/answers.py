"""From ranked chunks to an answer: gate, prompt, citations; and what the model stages are fed."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import store
from ..functions import text as X
from ..operators import calls
from ..operators import retrieval as R
from . import model, sql
from .registry import Plans
from .retrieval import RERANKED, reranked_rows

PLANS = Plans()


@PLANS.add(f"""WITH {RERANKED}, tops AS (SELECT question_id, max(score) AS top_score FROM reranked WHERE score > 0 GROUP BY question_id)
 SELECT q.question_id, top_score, CASE WHEN top_score IS NULL THEN 'no_retrieval' WHEN top_score < 0.25 THEN 'low_confidence' ELSE 'answered' END AS outcome FROM questions q LEFT JOIN tops USING (question_id)""")
def confidence_gate(spark, sf_dir):
    """R-14"""
    ranked, q = reranked_rows(spark, sf_dir)
    return R.gate(ranked, q)


@PLANS.add(f"""WITH {RERANKED} SELECT question_id, rank AS index, source_id, id AS chunk_id, filename, location, substring(text, 1, 260) AS snippet, round(score, 3) AS score, round(vector_score, 3) AS vector_score, round(keyword_score, 3) AS keyword_score, round(rerank_score, 3) AS rerank_score FROM reranked WHERE score > 0""")
def citation_payload(spark, sf_dir):
    """R-15, X-04, X-32"""
    return R.citations(reranked_rows(spark, sf_dir)[0])


@PLANS.add(f"""WITH {RERANKED} SELECT question_id, string_agg('[' || rank || '] ' || filename || ' - ' || location || chr(10) || text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(question) AS prompt FROM reranked WHERE score > 0 GROUP BY question_id""")
def answer_prompt(spark, sf_dir):
    """R-17, A-11"""
    ranked, q = reranked_rows(spark, sf_dir)
    return R.answer_prompt(ranked, q)


def _reply(prompt: str) -> str:
    """A model for checks: names the second excerpt, and fails on some prompts."""
    if len(prompt) % 7 == 0:
        raise RuntimeError("overloaded")
    return f"Read {len(prompt)} characters [2]."


@PLANS.add(f"""WITH {RERANKED}, tops AS (SELECT question_id, max(score) AS top_score, count(*) AS n, length(string_agg('[' || rank || '] ' || filename || ' - ' || location || chr(10) || text, chr(10) || chr(10)) || chr(10) || chr(10) || 'Question: ' || any_value(question)) AS chars FROM reranked WHERE score > 0 GROUP BY question_id),
 o AS (SELECT q.question_id, t.*, CASE WHEN top_score IS NULL THEN 'no_retrieval' WHEN top_score < 0.25 THEN 'low_confidence' ELSE 'answered' END AS outcome FROM questions q LEFT JOIN tops t USING (question_id))
 SELECT question_id, outcome, CASE WHEN outcome <> 'answered' THEN 'I cannot tell.' WHEN chars % 7 <> 0 THEN 'Read ' || chars || ' characters [2].' END AS answer, CASE WHEN outcome = 'answered' AND chars % 7 = 0 THEN 'RuntimeError: overloaded' ELSE '' END AS error, CASE WHEN outcome = 'answered' AND chars % 7 <> 0 AND n >= 2 THEN 1 ELSE 0 END AS n_citations FROM o""")
def answer_flow(spark, sf_dir):
    """L-03, R-14..R-17: gate, prompt, call and cited excerpts as one flow; a call that fails leaves its own question without an answer"""
    ranked, q = reranked_rows(spark, sf_dir)
    got = calls.answers(store.written(ranked), q, _reply, abstain="I cannot tell.", wait=0.001)
    return got.select("question_id", "outcome", "answer", "error", F.greatest(F.coalesce(F.size("citations"), F.lit(0)), F.lit(0)).alias("n_citations"))


_ANSWER = "CASE item_id % 4 WHEN 0 THEN 'See [1] and [3].' WHEN 1 THEN 'No marker here.' WHEN 2 THEN 'Only [9].' ELSE 'First [2], again [2].' END"


@PLANS.add(f"""WITH {model.RETRIEVED}, a AS (SELECT *, {_ANSWER} AS answer FROM retrieved), m AS (SELECT *, list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: x::INT) AS marks FROM a)
 SELECT item_id, rank AS index, chunk_id FROM m WHERE len(marks) = 0 OR list_contains(marks, rank)""")
def citation_filter(spark, sf_dir):
    """R-16: no marker keeps all, markers that match nothing keep none"""
    got = model.retrieved(spark, sf_dir).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("index"), "chunk_id"))).alias("cited"))
    kept = got.select("item_id", F.explode(R.citation_filter(F.expr(_ANSWER), F.col("cited"))).alias("c"))
    return kept.select("item_id", "c.index", "c.chunk_id")


@PLANS.add(f"""WITH {model.CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY notebook_id ORDER BY id DESC) AS n FROM chunks WHERE status = 'indexed')
 SELECT notebook_id, count(*) AS excerpts, string_agg('[' || n || '] ' || filename || chr(10) || substring(text, 1, 400), chr(10) || chr(10) ORDER BY n) AS context FROM r WHERE n <= 8 GROUP BY notebook_id""")
def starter_excerpts(spark, sf_dir):
    """L-04, O-06: the newest excerpts of a notebook, numbered and cut"""
    c = model.chunks(spark, sf_dir).where("status = 'indexed'")
    r = R.top(c, ["notebook_id"], [F.desc("id")], 8)
    part = F.concat(F.lit("["), F.col("_rank").cast("string"), F.lit("] "), "filename", F.lit("\n"), F.substring("text", 1, 400))
    lists = r.groupBy("notebook_id").agg(F.count(F.lit(1)).alias("excerpts"), F.array_sort(F.collect_list(F.struct("_rank", part.alias("p")))).alias("ps"))
    return lists.select("notebook_id", "excerpts", F.array_join(F.transform("ps", lambda x: x.p), "\n\n").alias("context"))


@PLANS.add(f"""WITH {model.CHUNKS} SELECT source_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS context, count(*) AS chunks FROM chunks WHERE chunk_index < 12 GROUP BY source_id""")
def summary_context(spark, sf_dir):
    """L-06"""
    c = model.chunks(spark, sf_dir).where("chunk_index < 12")
    lists = c.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("ts"), F.count(F.lit(1)).alias("chunks"))
    return lists.select("source_id", F.array_join(F.transform("ts", lambda x: x.text), "\n\n").alias("context"), "chunks")


@PLANS.add(f"""WITH {model.CHUNKS}, f AS (SELECT source_id, chunk_index, text, sum(length(text)) OVER (PARTITION BY source_id ORDER BY chunk_index) AS upto FROM chunks WHERE chunk_index < 100)
 SELECT source_id, count(*) AS chunks, max(upto)::BIGINT AS chars, sha256(string_agg(text, chr(10) ORDER BY chunk_index)) AS context_hash FROM f WHERE upto <= 16000 GROUP BY source_id""")
def minutes_context(spark, sf_dir):
    """L-11, O-06: a prefix within a budget of characters"""
    c = model.chunks(spark, sf_dir).where("chunk_index < 100")
    upto = F.sum(F.length("text")).over(Window.partitionBy("source_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0))
    kept = c.withColumn("upto", upto).where("upto <= 16000")
    lists = kept.groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("upto").alias("chars"), F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("ts"))
    return lists.select("source_id", "chunks", "chars", F.sha2(F.array_join(F.transform("ts", lambda x: x.text), "\n"), 256).alias("context_hash"))


@PLANS.add(f"""WITH {model.SOURCES} SELECT notebook_id, string_agg('## ' || filename || chr(10) || {sql.snippet('text', 160)}, chr(10) || chr(10) ORDER BY source_id) AS context FROM sources WHERE status = 'indexed' AND trim(text) <> '' GROUP BY notebook_id""")
def artifact_context(spark, sf_dir):
    """L-09: summaries of a notebook's sources under their file names"""
    s = model.sources(spark, sf_dir).where("status = 'indexed' and trim(text) <> ''")
    part = F.concat(F.lit("## "), "filename", F.lit("\n"), X.snippet(F.col("text"), 160))
    lists = s.groupBy("notebook_id").agg(F.array_sort(F.collect_list(F.struct("source_id", part.alias("p")))).alias("ps"))
    return lists.select("notebook_id", F.array_join(F.transform("ps", lambda x: x.p), "\n\n").alias("context"))


@PLANS.add(f"""WITH {model.SOURCES}, n AS (SELECT notebook_id, count(CASE WHEN status = 'indexed' AND source_id % 3 = 0 AND source_id < 100 THEN 1 END) AS indexed FROM sources GROUP BY notebook_id)
 SELECT notebook_id, indexed, indexed >= 2 AS can_compare, indexed >= 1 AS can_brief FROM n""")
def tool_gating(spark, sf_dir):
    """L-12"""
    s = model.sources(spark, sf_dir).groupBy("notebook_id").agg(F.count_if(F.expr("status = 'indexed' and source_id % 3 = 0 and source_id < 100")).alias("indexed"))
    return s.select("notebook_id", "indexed", (F.col("indexed") >= 2).alias("can_compare"), (F.col("indexed") >= 1).alias("can_brief"))
