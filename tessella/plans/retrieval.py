"""Retrieval over the chunked documents for the benchmark's questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import store
from ..functions import text as X
from ..operators import embedding
from ..operators import retrieval as R
from ..operators import vector_index as V
from . import model, sql
from .registry import Plans

PLANS = Plans()

#: CTEs up to the blended candidates.
_BASE = f"""{model.CHUNKS}, live AS (SELECT * FROM chunks WHERE status = 'indexed'), {model.QUESTIONS},
 {embedding.hash_ctes('live', 'id', 'text', 'user_id')}, {embedding.hash_ctes('questions', 'question_id', 'question', 'user_id')},
 dots AS (SELECT q.question_id, e.id, round(sum(e.weight * q.weight), 6) AS dot FROM hashed_live e JOIN hashed_questions q USING (user_id, bucket) GROUP BY ALL),
 vec AS (SELECT question_id, id, greatest(0.0, dot) AS vector_score FROM dots QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY greatest(0.0, dot) DESC, id) <= 20),
 asked AS (SELECT *, {sql.search_tokens('question')} AS toks, lower(question) AS lowq FROM questions),
 firsts AS (SELECT *, list_filter(toks, lambda t, i: list_position(toks, t) = i)[1:12] AS first12 FROM asked),
 hits AS (SELECT f.question_id, c.id, c.text, f.toks, f.lowq FROM live c JOIN firsts f USING (user_id)
   WHERE len(list_filter(f.first12, lambda t: c.text ILIKE '%' || t || '%')) > 0 QUALIFY row_number() OVER (PARTITION BY f.question_id ORDER BY c.id DESC) <= 80),
 hits_have AS (SELECT *, {sql.search_tokens('text')} AS have, lower(text) AS lowt FROM hits),
 lex AS (SELECT question_id, id, {sql.keyword('toks', 'lowq', 'have', 'lowt')} AS keyword_score FROM hits_have
   QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY {sql.keyword('toks', 'lowq', 'have', 'lowt')} DESC, id DESC) <= 20),
 best AS (SELECT question_id, id, max(vector_score) AS vector_score FROM (SELECT * FROM vec UNION ALL SELECT question_id, id, 0.0 FROM lex) GROUP BY ALL),
 best_have AS (SELECT b.*, c.source_id, c.filename, c.location, c.text, a.toks, a.lowq, a.question, {sql.search_tokens('c.text')} AS have, lower(c.text) AS lowt FROM best b JOIN live c USING (id) JOIN asked a USING (question_id)),
 kw AS (SELECT * EXCLUDE (toks, lowq, have, lowt), {sql.keyword('toks', 'lowq', 'have', 'lowt')} AS keyword_score FROM best_have),
 blended AS (SELECT *, round(0.7 * vector_score + 0.3 * keyword_score, 9) AS score FROM kw WHERE round(0.7 * vector_score + 0.3 * keyword_score, 9) > 0)"""

_STRIPPED = f"list_distinct(list_filter(list_transform({sql.search_tokens('text')}, lambda t: trim(t, '.,;:!?()[]{{}}\"''`“”‘’')), lambda t: t <> ''))"
_ALIKE = "len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t)))::DOUBLE >= 0.88"
#: CTEs from the blended candidates to the kept ones with their positions.
_DIVERSE = f"""{_BASE}, overlap AS (SELECT question_id, id, score, {_STRIPPED} AS t FROM blended),
 lists AS (SELECT question_id, list({{'k': []::STRUCT(id BIGINT, t VARCHAR[])[], 'id': id, 't': t}} ORDER BY score DESC, id) AS items FROM overlap GROUP BY question_id),
 kept AS (SELECT question_id, list_transform(list_reduce(list_prepend({{'k': []::STRUCT(id BIGINT, t VARCHAR[])[], 'id': 0::BIGINT, 't': []::VARCHAR[]}}, items), lambda a, x:
   CASE WHEN len(a.k) >= 20 OR (len(x.t) >= 8 AND len(list_filter(a.k, lambda y: len(y.t) > 0 AND {_ALIKE})) > 0) THEN a
   ELSE {{'k': list_append(a.k, {{'id': x.id, 't': x.t}}), 'id': a.id, 't': a.t}} END).k, lambda y: y.id) AS ids FROM lists),
 placed AS (SELECT question_id, ids[i] AS id, i AS position FROM kept, unnest(range(1, len(ids) + 1)) AS u(i)),
 diverse AS (SELECT b.*, p.position FROM blended b JOIN placed p USING (question_id, id))"""


def _asking(spark, sf_dir):
    """Chunks and questions, which is all that the lexical arm needs."""
    return model.chunks(spark, sf_dir).where("status = 'indexed'"), model.questions(spark, sf_dir).withColumn("queries", R.query_set(F.col("question")))


def _tables(spark, sf_dir):
    chunks, q = _asking(spark, sf_dir)
    return chunks, model.vectors(spark, sf_dir), _variants(q), q


def _variants(q):
    """The entries of each question's variants."""
    variants = q.select("question_id", "user_id", F.posexplode("queries").alias("variant", "query")).withColumn("key", F.col("question_id") * 8 + F.col("variant"))
    return embedding.hash_entries(variants, "key", "query", "question_id", "variant", "user_id").drop("key")


def _blended(spark, sf_dir):
    chunks, vectors, asked, q = _tables(spark, sf_dir)
    return R.blend(R.vector_arm(vectors, asked, 20), R.lexical_arm(chunks, q, 20, lambda: model.postings(spark, sf_dir)), chunks, q), q


def _diverse(spark, sf_dir):
    found, q = _blended(spark, sf_dir)
    return R.diversify(found, 20), q


_K9 = "round(keyword_score, 9) AS keyword_score"


@PLANS.add(f"WITH {_DIVERSE} SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, position)::INT AS rank, id, source_id, filename, score, vector_score, {_K9} FROM diverse QUALIFY rank <= 6")
def hybrid_retrieve_topk(spark, sf_dir):
    """R-01, R-04, R-06..R-10, R-13, R-20"""
    chunks, vectors, asked, q = _tables(spark, sf_dir)
    got = R.retrieve(chunks, vectors, asked, q, index=lambda: model.postings(spark, sf_dir))
    return got.select("question_id", "rank", "id", "source_id", "filename", "score", "vector_score", F.round("keyword_score", 9).alias("keyword_score"))


@PLANS.add(f"WITH {_BASE} SELECT question_id, id, vector_score, {_K9}, score FROM blended")
def hybrid_blend(spark, sf_dir):
    """R-08, U-02"""
    return _blended(spark, sf_dir)[0].select("question_id", "id", "vector_score", F.round("keyword_score", 9).alias("keyword_score"), "score")


@PLANS.add(f"WITH {_BASE} SELECT question_id, id, {_K9} FROM lex")
def lexical_candidates(spark, sf_dir):
    """R-06, F-05"""
    chunks, q = _asking(spark, sf_dir)
    return R.lexical_arm(chunks, q, 20, lambda: model.postings(spark, sf_dir)).select("question_id", "id", F.round("keyword_score", 9).alias("keyword_score"))


@PLANS.add(f"WITH {_BASE} SELECT question_id, id, {_K9} FROM lex")
def lexical_index(spark, sf_dir):
    """R-06, F-05 through the inverted index whatever the size: words by their rarest gram, newest postings, then the chunks that these name"""
    chunks, q = _asking(spark, sf_dir)
    return R.lexical_by_index(chunks, q, 20, model.postings(spark, sf_dir)).select("question_id", "id", F.round("keyword_score", 9).alias("keyword_score"))


@PLANS.add(f"WITH {_DIVERSE} SELECT question_id, id, position::INT AS position, score FROM diverse")
def diversify_jaccard(spark, sf_dir):
    """R-09, U-05"""
    return _diverse(spark, sf_dir)[0].select("question_id", "id", "position", "score")


_RERANKED = f"""{_DIVERSE}, model_scores AS (SELECT question_id, position, least(1.0, greatest(0.0, ((id * 7919 + position) % 130) / 100.0)) AS rerank, question_id % 3 <> 0 AND position % 4 <> 0 AS has FROM diverse),
 scored AS (SELECT d.*, CASE WHEN m.has THEN m.rerank END AS rerank, count(CASE WHEN m.has THEN 1 END) OVER (PARTITION BY question_id) AS n FROM diverse d JOIN model_scores m USING (question_id, position)),
 combined AS (SELECT * EXCLUDE (score), CASE WHEN n = 0 THEN score ELSE round(0.8 * rerank + 0.2 * score, 9) END AS score, CASE WHEN n > 0 THEN rerank END AS rerank_score FROM scored WHERE n = 0 OR rerank IS NOT NULL),
 reranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, position)::INT AS rank FROM combined QUALIFY rank <= 6)"""


def _reranked(spark, sf_dir):
    found, q = _diverse(spark, sf_dir)
    scores = found.where("question_id % 3 <> 0 and position % 4 <> 0").select("question_id", "position", (F.pmod(F.col("id") * 7919 + F.col("position"), F.lit(130)) / 100.0).alias("rerank"))
    return R.rerank(found, scores), q


@PLANS.add(f"WITH {_RERANKED} SELECT question_id, rank, id, score, rerank_score FROM reranked WHERE score > 0")
def rerank_blend(spark, sf_dir):
    """R-10, X-31: questions divisible by three have no scores and fall back to hybrid order."""
    return _reranked(spark, sf_dir)[0].select("question_id", "rank", "id", "score", "rerank_score")


@PLANS.add(f"WITH {_DIVERSE} SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, position)::INT AS rank, score, NULL::DOUBLE AS rerank_score FROM diverse QUALIFY rank <= 6")
def rerank_fallback(spark, sf_dir):
    """R-10 without a model"""
    return R.rerank(_diverse(spark, sf_dir)[0], None).select("question_id", "id", "rank", "score", "rerank_score")


@PLANS.add(f"""WITH {_BASE}, newest AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) <= 2000),
 pairs AS (SELECT a.question_id, c.id, coalesce(d.dot, 0.0) AS vector_score, a.toks, a.lowq, {sql.search_tokens('c.text')} AS have, lower(c.text) AS lowt FROM newest c JOIN asked a USING (user_id) LEFT JOIN dots d ON d.question_id = a.question_id AND d.id = c.id),
 scored AS (SELECT question_id, id, vector_score, {sql.keyword('toks', 'lowq', 'have', 'lowt')} AS keyword_score FROM pairs)
 SELECT question_id, id, vector_score, {_K9}, round(0.7 * greatest(0.0, vector_score) + 0.3 * keyword_score, 9) AS score FROM scored WHERE round(0.7 * greatest(0.0, vector_score) + 0.3 * keyword_score, 9) > 0""")
def degraded_scan(spark, sf_dir):
    """R-05, R-11, R-12"""
    chunks, q = _asking(spark, sf_dir)
    # Chunks beyond the newest are not scored, so no vector is made of them.
    newest = store.written(R.newest_chunks(chunks, R.RetrievalParams.fallback_scan_limit))
    vectors = embedding.sparse(embedding.hash_entries(newest, "id", "text", "user_id"), "id", "user_id")
    got = R.degraded_scan(newest, vectors, _variants(q), q)
    return got.select("question_id", "id", "vector_score", F.round("keyword_score", 9).alias("keyword_score"), "score")


@PLANS.add(f"""WITH {model.SOURCES}, {model.QUESTIONS}, q AS (SELECT *, {sql.search_tokens('question')} AS toks, lower(question) AS lowq FROM questions),
 h AS (SELECT source_id, user_id, {sql.search_tokens('text')} AS have, lower(text) AS lowt FROM sources), p AS (SELECT * FROM h JOIN q USING (user_id))
 SELECT source_id, question_id, round({sql.keyword('toks', 'lowq', 'have', 'lowt')}, 9) AS score FROM p""")
def keyword_score(spark, sf_dir):
    """R-07: every question against all whole documents of its tenant"""
    q = model.questions(spark, sf_dir).select("question_id", "user_id", F.array(F.struct(X.search_tokens(F.col("question")).alias("tokens"), F.lower("question").alias("low"))).alias("asked"))
    d = store.spread(model.sources(spark, sf_dir)).select("source_id", "user_id", X.search_tokens(F.col("text")).alias("have"), F.lower("text").alias("low"))
    pairs = d.join(store.small_enough(q, 2_000), "user_id")
    return pairs.select("source_id", "question_id", F.round(X.keyword_score_of(F.col("asked"), F.col("have"), F.col("low")), 9).alias("score"))


_TOPK = "round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6)"


def _queries(spark, sf_dir):
    return model.read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"), F.col("label").alias("query_label"))


@PLANS.add(f"SELECT q.vec_id AS query_id, e.vec_id AS id, {_TOPK} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_TOPK} DESC, e.vec_id)::INT AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY rank <= 20")
def vector_topk(spark, sf_dir):
    """R-04, R-05, J-13, W-04: a stated query set against all rows"""
    return R.dense_topk(model.read(spark, sf_dir, "embeddings"), _queries(spark, sf_dir).drop("query_label"), 20).select("query_id", "id", "score", "rank")


@PLANS.add(f"SELECT q.vec_id AS query_id, e.vec_id AS id, {_TOPK} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_TOPK} DESC, e.vec_id)::INT AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.label IN (1, 3, 5) QUALIFY rank <= 20")
def vector_topk_filtered(spark, sf_dir):
    """R-04, F-03, F-04: the metadata filter comes before the top-k"""
    index = model.read(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 3, 5))
    return R.dense_topk(index, _queries(spark, sf_dir).drop("query_label"), 20).select("query_id", "id", "score", "rank")


@PLANS.add(None)
def vector_index_topk(spark, sf_dir):
    """R-04, W-04: the stated query set through the kept index of cells; tests hold its recall against vector_topk's rows"""
    return V.search(spark, model.vector_index(spark, sf_dir), _queries(spark, sf_dir).drop("query_label"), 20)


@PLANS.add("SELECT vec_id, round(list_sum(list_transform(list_zip(embedding[1:32], embedding[33:64]), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS dot FROM embeddings")
def dot_product(spark, sf_dir):
    """R-05: over the shorter length"""
    v = F.col("embedding").cast("array<double>")
    return model.read(spark, sf_dir, "embeddings").select("vec_id", F.round(R.dot(F.slice(v, 1, 32), F.slice(v, 33, 64)), 6).alias("dot"))


@PLANS.add(f"SELECT q.label AS query_group, e.vec_id AS id, max(greatest(0.0, {_TOPK})) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 GROUP BY ALL")
def multi_query_max(spark, sf_dir):
    """A-07: a chunk's best score over the variants of one question (here the queries of one label)"""
    best = R.dense_best(model.read(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), "query_label")
    return best.select(F.col("query_label").alias("query_group"), "id", F.greatest(F.lit(0.0), "score").alias("score"))


@PLANS.add(f"""WITH r AS (SELECT item_id, string_split(text, ' ')[1:4] AS w FROM benchmark), v AS (SELECT item_id, [array_to_string(w, ' '), '  ' || lower(array_to_string(w, '   ')) || ' ', '', w[1], w[2] || ' ' || w[1], w[1] || '  ', w[3], w[4]] AS qs FROM r),
 c AS (SELECT item_id, list_filter(list_transform(qs, lambda x: {sql.collapse('x')}), lambda x: x <> '') AS qs FROM v),
 u AS (SELECT item_id, list_filter(qs, lambda x, i: list_position(list_transform(qs, lambda y: lower(y)), lower(x)) = i)[1:5] AS qs FROM c)
 SELECT item_id, i AS nr, qs[i] AS query FROM u, unnest(range(1, len(qs) + 1)) AS t(i)""")
def query_set_dedup(spark, sf_dir):
    """R-01, U-07, X-59"""
    w = F.slice(F.split("text", " "), 1, 4)
    b = model.read(spark, sf_dir, "benchmark").select("item_id", w.alias("w"))
    g = lambda i: F.get("w", F.lit(i))
    rewrites = F.array(F.concat(F.lit("  "), F.lower(F.array_join("w", "   ")), F.lit(" ")), F.lit(""), g(0), F.concat_ws(" ", g(1), g(0)), F.concat(g(0), F.lit("  ")), g(2), g(3))
    return b.select("item_id", F.posexplode(R.query_set(F.array_join("w", " "), rewrites)).alias("p", "query")).select("item_id", (F.col("p") + 1).cast("long").alias("nr"), "query")


@PLANS.add("SELECT p_partkey, p_name, p_name ILIKE '%a_e%' AS wildcard, contains(lower(p_name), 'a_e') AS literal FROM part")
def like_unescaped(spark, sf_dir):
    """F-05: an underscore in a token is a wildcard"""
    n = F.col("p_name")
    return model.read(spark, sf_dir, "part").select("p_partkey", "p_name", F.ilike(n, F.lit("%a_e%")).alias("wildcard"), F.contains(F.lower(n), F.lit("a_e")).alias("literal"))


@PLANS.add("SELECT event_id, props FROM events WHERE contains(lower(props), lower('\"K\": 1'))")
def like_escaped_search(spark, sf_dir):
    """F-06, X-10: the search string is taken literally"""
    return model.read(spark, sf_dir, "events").where(F.contains(F.lower("props"), F.lower(F.lit('"K": 1')))).select("event_id", "props")


DIVERSE, RERANKED, diverse_rows, reranked_rows = _DIVERSE, _RERANKED, _diverse, _reranked
