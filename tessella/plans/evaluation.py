"""Evaluation of ranked results: order lines stand for retrieved chunks, orders for evaluation items."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..streaming.jobs import work_dir
from . import model, sql
from .registry import Plans
from .retrieval import DIVERSE, diverse_rows

PLANS = Plans()

_OK = """(expected_source_id IS NULL OR r.source_id = expected_source_id) AND (expected_chunk_id IS NULL OR r.chunk_id = expected_chunk_id)
  AND (len(expected_substrings) = 0 OR len(list_filter(expected_substrings, lambda s: contains(r.text, s))) > 0)"""
#: CTEs for two runs over the items; the second reads one rank further down.
_RUNS = f"""{model.RETRIEVED}, {model.EVAL_ITEMS}, runs AS (SELECT unnest([1, 2]) AS run_id),
 firsts AS (SELECT u.run_id, i.item_id, min(r.rank - (u.run_id - 1)) AS f FROM runs u, eval_items i JOIN retrieved r ON r.item_id = i.item_id WHERE r.rank >= u.run_id AND {_OK} GROUP BY ALL),
 tops AS (SELECT u.run_id, r.item_id, max(r.score) AS top_score FROM runs u JOIN retrieved r ON r.rank >= u.run_id GROUP BY ALL),
 ranked AS (SELECT u.run_id, i.*, CASE WHEN expected_source_id IS NOT NULL OR expected_chunk_id IS NOT NULL OR len(expected_substrings) > 0 THEN coalesce(f, 0) END AS rank0, top_score
   FROM runs u CROSS JOIN eval_items i LEFT JOIN firsts f ON f.run_id = u.run_id AND f.item_id = i.item_id LEFT JOIN tops t ON t.run_id = u.run_id AND t.item_id = i.item_id),
 results AS (SELECT * EXCLUDE (rank0), CASE WHEN failed THEN 'error' WHEN rank0 IS NULL THEN 'unscored' WHEN rank0 > 0 THEN 'hit' ELSE 'miss' END AS status, CASE WHEN rank0 > 0 THEN rank0 END AS hit_rank FROM ranked)"""


def _run(spark, sf_dir, run_id):
    got = model.retrieved(spark, sf_dir).where(F.col("rank") >= run_id).withColumn("rank", F.col("rank") - (run_id - 1))
    items = E.hit_ranks(model.eval_items(spark, sf_dir), got)
    tops = got.groupBy("item_id").agg(F.max("score").alias("top_score"))
    r = items.join(tops, "item_id", "left").withColumn("status", E.status_of(F.col("hit_rank"), F.col("failed")))
    return r.withColumn("hit_rank", F.when(F.col("hit_rank") > 0, F.col("hit_rank"))).withColumn("run_id", F.lit(run_id))


def _runs(spark, sf_dir):
    return _run(spark, sf_dir, 1).unionByName(_run(spark, sf_dir, 2))


@PLANS.add(f"WITH {_RUNS} SELECT item_id, rank0 AS hit_rank FROM ranked WHERE run_id = 1")
def hit_rank(spark, sf_dir):
    """V-01"""
    return E.hit_ranks(model.eval_items(spark, sf_dir), model.retrieved(spark, sf_dir)).select("item_id", "hit_rank")


@PLANS.add(f"WITH {_RUNS} SELECT run_id, item_id, status, hit_rank FROM results")
def result_status(spark, sf_dir):
    """V-02"""
    return _runs(spark, sf_dir).select("run_id", "item_id", "status", "hit_rank")


def _search(item: dict) -> list[dict]:
    """A search for checks: what the item brings along; every eleventh breaks."""
    if item["item_id"] % 11 == 0:
        raise LookupError(f"nothing answers for {item['item_id']}")
    return [dict(f) for f in item["found"]]


_SEARCHED = """CASE WHEN item_id % 11 = 0 THEN 'error' WHEN rank0 IS NULL THEN 'unscored' WHEN rank0 > 0 THEN 'hit' ELSE 'miss' END"""


@PLANS.add(f"""WITH {_RUNS}, mine AS (SELECT eval_set_id AS run_id, item_id, {_SEARCHED} AS status, CASE WHEN item_id % 11 <> 0 AND rank0 > 0 THEN rank0 END AS hit_rank, CASE WHEN item_id % 11 <> 0 THEN top_score END AS top_score FROM ranked WHERE approved AND run_id = 1),
 m AS (SELECT run_id, count(*) AS total, count(CASE WHEN status = 'error' THEN 1 END) AS errors, count(CASE WHEN status = 'hit' THEN 1 END) AS hits, count(CASE WHEN status = 'miss' THEN 1 END) AS misses,
  round(count(CASE WHEN status = 'hit' THEN 1 END) / greatest(1, count(CASE WHEN status IN ('hit', 'miss') THEN 1 END))::DOUBLE, 4) AS recall_at_k,
  round(coalesce(sum(CASE WHEN status = 'hit' THEN (1.0::DOUBLE / hit_rank)::DECIMAL(28,9) END)::DOUBLE, 0) / greatest(1, count(CASE WHEN status IN ('hit', 'miss') THEN 1 END)), 4) AS mrr, round(sum(coalesce(top_score, 0.0)::DECIMAL(28,9))::DOUBLE / count(*), 4) AS avg_top_score FROM mine GROUP BY run_id)
 SELECT run_id, 'succeeded' AS status, total AS progress_total, total AS progress_current, errors, '' AS error, hits, misses, recall_at_k, mrr, avg_top_score FROM m
 UNION ALL SELECT 8, 'failed', 0, 0, 0, 'there are no approved items to run', NULL, NULL, NULL, NULL, NULL
 UNION ALL SELECT 9, 'failed', (SELECT count(*) FROM eval_items WHERE approved AND eval_set_id = 0), 0, 0, 'there are no indexed sources', NULL, NULL, NULL, NULL, NULL""")
def eval_run_job(spark, sf_dir):
    """V-11, V-04: a run for each set through a search that breaks on some items; two runs that can't begin"""
    items, sources = model.eval_items(spark, sf_dir), model.sources(spark, sf_dir)
    got = model.retrieved(spark, sf_dir).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source_id", "chunk_id", "text", "score"))).alias("found"))
    items = items.join(got, "item_id", "left").withColumn("found", F.coalesce("found", F.array().cast(E.FOUND)))
    out = work_dir(spark, "runs")
    jobs = [(n, items.where(F.col("eval_set_id") == n), sources) for n in range(3)]
    jobs += [(8, items.where("eval_set_id = 99"), sources), (9, items.where("eval_set_id = 0"), sources.where("status = 'failed'"))]
    records, results = None, None
    for n, some, from_ in jobs:
        record, found = E.run_job(n, some, from_, _search, f"{out}/{n}")
        records = record if records is None else records.unionByName(record)
        if found is not None:
            results = found if results is None else results.unionByName(found)
    measured = E.run_metrics(results).select("run_id", "hits", "misses", "recall_at_k", "mrr", "avg_top_score")
    return records.join(measured, "run_id", "left")


_METRICS = """count(*) AS total, count(CASE WHEN status IN ('hit', 'miss') THEN 1 END) AS scored, count(CASE WHEN status = 'hit' THEN 1 END) AS hits, count(CASE WHEN status = 'miss' THEN 1 END) AS misses,
 count(CASE WHEN status = 'unscored' THEN 1 END) AS unscored, count(CASE WHEN status = 'error' THEN 1 END) AS errors,
 round(count(CASE WHEN status = 'hit' THEN 1 END) / greatest(1, count(CASE WHEN status IN ('hit', 'miss') THEN 1 END))::DOUBLE, 4) AS recall_at_k,
 round(coalesce(sum(CASE WHEN status = 'hit' THEN (1.0::DOUBLE / hit_rank)::DECIMAL(28,9) END)::DOUBLE, 0) / greatest(1, count(CASE WHEN status IN ('hit', 'miss') THEN 1 END)), 4) AS mrr,
 round(sum(coalesce(latency_ms, 0.0)::DECIMAL(28,9))::DOUBLE / count(*), 1) AS avg_latency_ms, round(sum(coalesce(top_score, 0.0)::DECIMAL(28,9))::DOUBLE / count(*), 4) AS avg_top_score, round(count(CASE WHEN coalesce(top_score, 0.0) < 0.25 THEN 1 END) / count(*)::DOUBLE, 4) AS low_confidence_rate"""


@PLANS.add(f"WITH {_RUNS} SELECT run_id, {_METRICS} FROM results GROUP BY run_id")
def run_metrics(spark, sf_dir):
    """V-04, A-06, X-33"""
    return E.run_metrics(_runs(spark, sf_dir))


@PLANS.add(f"WITH {_RUNS}, m AS (SELECT eval_set_id, {_METRICS} FROM results GROUP BY eval_set_id) SELECT * FROM m")
def metrics_by_set(spark, sf_dir):
    """V-04 by another key"""
    return E.run_metrics(_runs(spark, sf_dir), "eval_set_id")


@PLANS.add(f"WITH {model.RETRIEVED} SELECT item_id, rank, chunk_id, source_id, round(score, 4) AS score, substring({sql.collapse('text')}, 1, 220) AS snippet FROM retrieved")
def compact_retrieved(spark, sf_dir):
    """V-03"""
    return E.compact_retrieved(model.retrieved(spark, sf_dir))


@PLANS.add(f"""WITH {_RUNS}, lists AS (SELECT item_id, list(source_id) AS ss, list(chunk_id) AS cs, string_agg({sql.collapse('text')}[1:220], ' ' ORDER BY rank) AS all_text FROM retrieved GROUP BY item_id),
 j AS (SELECT r.*, ss, cs, all_text FROM results r LEFT JOIN lists USING (item_id) WHERE run_id = 1),
 c AS (SELECT item_id, status, ss, list_filter([CASE WHEN expected_source_id IS NOT NULL AND NOT list_contains(ss, expected_source_id) THEN 'source_missing' WHEN expected_source_id IS NOT NULL THEN 'source_found_elsewhere' END,
   CASE WHEN expected_chunk_id IS NOT NULL AND NOT list_contains(cs, expected_chunk_id) THEN 'chunk_missing' END, CASE WHEN len(list_filter(expected_substrings, lambda s: NOT contains(all_text, s))) > 0 THEN 'substring_missing' END], lambda x: x IS NOT NULL) AS codes FROM j)
 SELECT item_id, status, CASE WHEN status <> 'miss' THEN status WHEN ss IS NULL THEN 'nothing_retrieved' WHEN len(codes) = 0 THEN 'criteria_unmet' ELSE array_to_string(codes, ' ') END AS reasons FROM c""")
def miss_diagnosis(spark, sf_dir):
    """V-05, X-60, X-61"""
    return E.diagnosis(_run(spark, sf_dir, 1), E.compact_retrieved(model.retrieved(spark, sf_dir)))


_LONG = " UNION ALL ".join(f"SELECT run_id, '{m}' AS metric, {m}::DOUBLE AS value, {str(up).lower()} AS higher FROM m" for m, up in E.METRICS.items())


@PLANS.add(f"""WITH {_RUNS}, m AS (SELECT run_id, {_METRICS} FROM results GROUP BY run_id), l AS ({_LONG}), d AS (SELECT a.metric, a.higher, a.value AS base, b.value AS candidate, round(b.value - a.value, 4) AS delta FROM l a JOIN l b USING (metric) WHERE a.run_id = 1 AND b.run_id = 2)
 SELECT 1 AS pair, metric, base, candidate, delta, CASE WHEN delta = 0 THEN 'same' WHEN (delta > 0) = higher THEN 'better' ELSE 'worse' END AS direction FROM d""")
def compare_metrics(spark, sf_dir):
    """V-07"""
    a, b = (E.run_metrics(_run(spark, sf_dir, n).withColumn("pair", F.lit(1)), "pair") for n in (1, 2))
    return E.compare_metrics(a, b, "pair")


@PLANS.add(f"""WITH {_RUNS}, o AS (SELECT *, list_position(['hit', 'miss', 'unscored', 'error', 'pending'], status) AS ord FROM results), a AS (SELECT * FROM o WHERE run_id = 1 AND item_id % 11 <> 0), b AS (SELECT * FROM o WHERE run_id = 2 AND item_id % 13 <> 0)
 SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.status, '—') AS base_status, coalesce(b.status, '—') AS candidate_status, a.hit_rank AS base_rank, b.hit_rank AS candidate_rank,
 CASE WHEN a.status IS NULL OR b.status IS NULL THEN 'unchanged' WHEN b.ord < a.ord OR (a.status = 'hit' AND b.status = 'hit' AND b.hit_rank < a.hit_rank) THEN 'improved' WHEN b.ord > a.ord OR (a.status = 'hit' AND b.status = 'hit' AND b.hit_rank > a.hit_rank) THEN 'regressed' ELSE 'unchanged' END AS trend FROM a FULL JOIN b USING (item_id)""")
def compare_questions(spark, sf_dir):
    """V-08, J-11, U-04"""
    return E.compare_questions(_run(spark, sf_dir, 1).where("item_id % 11 <> 0"), _run(spark, sf_dir, 2).where("item_id % 13 <> 0"))


@PLANS.add("""WITH s AS (SELECT c_custkey AS run_id, MAP {'vector_weight': '0.7', 'keyword_weight': '0.3', 'candidate_pool_size': c_nationkey::VARCHAR} AS a, MAP {'vector_weight': '0.7', 'keyword_weight': (c_custkey % 3 / 10.0)::DECIMAL(2,1)::VARCHAR, 'final_chunk_count': '6', 'candidate_pool_size': (c_nationkey // 2 * 2)::VARCHAR} AS b FROM customer),
 k AS (SELECT unnest(['vector_weight', 'keyword_weight', 'rerank_model_weight', 'rerank_base_weight', 'low_confidence_threshold', 'candidate_pool_size', 'final_chunk_count']) AS key)
 SELECT run_id, key, a[key] AS base, b[key] AS candidate, a[key] IS DISTINCT FROM b[key] AS changed FROM s, k WHERE a[key] IS NOT NULL OR b[key] IS NOT NULL""")
def compare_params(spark, sf_dir):
    """V-06"""
    c = model.read(spark, sf_dir, "customer")
    a = F.create_map(F.lit("vector_weight"), F.lit("0.7"), F.lit("keyword_weight"), F.lit("0.3"), F.lit("candidate_pool_size"), F.col("c_nationkey").cast("string"))
    b = F.create_map(F.lit("vector_weight"), F.lit("0.7"), F.lit("keyword_weight"), (F.col("c_custkey") % 3 / 10).cast("decimal(2,1)").cast("string"), F.lit("final_chunk_count"), F.lit("6"), F.lit("candidate_pool_size"), (F.expr("c_nationkey div 2") * 2).cast("string"))
    return c.select(F.col("c_custkey").alias("run_id"), F.inline(E.compare_params(a, b, R.PROFILE_KEYS)))


@PLANS.add(f"""WITH {model.CHUNKS}, used AS (SELECT doc_id * 1000000 AS chunk_id FROM labels WHERE quality = 0), free AS (SELECT * FROM chunks c WHERE status = 'indexed' AND trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM used u WHERE u.chunk_id = c.id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY chunk_index, id) AS chunk_rank FROM free), s AS (SELECT *, {sql.snippet('text')} AS snip FROM r QUALIFY row_number() OVER (ORDER BY chunk_rank, updated_at DESC, source_id DESC, id) <= 500)
 SELECT id AS chunk_id, source_id, chunk_rank::INT AS chunk_rank, '「' || substring(snip, 1, 72) || CASE WHEN length(snip) > 72 THEN '...' ELSE '' END || '」 ' || filename AS question, snip AS expected_substring, false AS approved FROM s WHERE snip <> ''""")
def eval_item_generation(spark, sf_dir):
    """V-12, W-02, J-05, X-02, X-03: chunks not used yet, in turn over the sources"""
    used = model.read(spark, sf_dir, "labels").where("quality = 0").select((F.col("doc_id") * 1_000_000).alias("id"))
    free = model.chunks(spark, sf_dir).where("status = 'indexed' and trim(text) <> ''").join(used, "id", "left_anti")
    r = free.withColumn("chunk_rank", F.row_number().over(Window.partitionBy("source_id").orderBy("chunk_index", "id")))
    s = r.orderBy("chunk_rank", F.desc("updated_at"), F.desc("source_id"), "id").limit(500).withColumn("snip", X.snippet(F.col("text"))).where("snip <> ''")
    q = F.concat(F.lit("「"), F.substring("snip", 1, 72), F.when(F.length("snip") > 72, "...").otherwise(""), F.lit("」 "), "filename")
    return s.select(F.col("id").alias("chunk_id"), "source_id", "chunk_rank", q.alias("question"), F.col("snip").alias("expected_substring"), F.lit(False).alias("approved"))


@PLANS.add(f"""WITH {model.CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY chunk_index, id) AS chunk_rank FROM chunks WHERE status = 'indexed')
 SELECT id, source_id, chunk_rank::INT AS chunk_rank FROM r ORDER BY chunk_rank, source_id DESC, id LIMIT 300""")
def round_robin_sampling(spark, sf_dir):
    """W-01, Q-11, O-05"""
    c = model.chunks(spark, sf_dir).where("status = 'indexed'")
    r = c.withColumn("chunk_rank", F.row_number().over(Window.partitionBy("source_id").orderBy("chunk_index", "id")))
    return r.orderBy("chunk_rank", F.desc("source_id"), "id").limit(300).select("id", "source_id", "chunk_rank")


@PLANS.add(f"""WITH {DIVERSE}, h AS (SELECT question_id, min(position) AS rank FROM diverse JOIN questions USING (question_id, question) WHERE position <= 5 AND contains(text, evidence) GROUP BY question_id)
 SELECT count(*) AS questions, count(rank) AS hits, round(count(rank) / count(*)::DOUBLE, 4) AS recall_at_5, round(sum(coalesce(1.0::DOUBLE / rank, 0)::DECIMAL(28,9))::DOUBLE / count(*), 4) AS mrr FROM questions LEFT JOIN h USING (question_id)""")
def offline_recall_mrr(spark, sf_dir):
    """V-14: hits and reciprocal ranks over all questions"""
    found, q = diverse_rows(spark, sf_dir)
    hit = found.where("position <= 5").join(q.select("question_id", "evidence"), "question_id").where(F.contains("text", F.col("evidence")))
    h = hit.groupBy("question_id").agg(F.min("position").alias("rank"))
    n = F.count(F.lit(1))
    return q.join(h, "question_id", "left").agg(n.alias("questions"), F.count("rank").alias("hits"), F.round(F.count("rank") / n, 4).alias("recall_at_5"), F.round(F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0)).cast("decimal(28,9)")).cast("double") / n, 4).alias("mrr"))


@PLANS.add("""WITH c AS (SELECT doc_id, substring(text, 5, 40) AS a, 'not in the text' AS b, substring(text, 1, 10) AS d, text FROM documents), s AS (SELECT doc_id, text, list_filter([a, b, d, a], lambda x: contains(text, x) AND trim(x) <> '') AS g FROM c),
 u AS (SELECT doc_id, list_filter(g, lambda x, i: list_position(g, x) = i)[1:3] AS g FROM s) SELECT doc_id, len(g) AS n_grounded, coalesce(g[1], '') AS first_substring FROM u""")
def authored_item_grounding(spark, sf_dir):
    """V-13, J-12, X-61: proposed evidence must occur in the chunk"""
    t = F.col("text")
    some = F.array(F.substring(t, 5, 40), F.lit("not in the text"), F.substring(t, 1, 10), F.substring(t, 5, 40))
    g = F.slice(F.array_distinct(F.filter(some, lambda x: F.contains(t, x) & (F.trim(x) != ""))), 1, 3)
    return model.read(spark, sf_dir, "documents").select("doc_id", g.alias("g")).select("doc_id", F.size("g").cast("long").alias("n_grounded"), F.coalesce(F.get("g", F.lit(0)), F.lit("")).alias("first_substring"))


@PLANS.add(f"""WITH {_RUNS} SELECT eval_set_id, count(*) AS items, count(CASE WHEN approved THEN 1 END) AS approved FROM eval_items GROUP BY eval_set_id""")
def eval_set_overview(spark, sf_dir):
    """V-16, Q-05, J-08"""
    return model.eval_items(spark, sf_dir).groupBy("eval_set_id").agg(F.count(F.lit(1)).alias("items"), F.count_if("approved").alias("approved"))
