"""Titles, notes, profiles, runs, follow-ups, model calls and settings over the driver's tables."""

from __future__ import annotations

import json
import threading
import time

from pyspark.sql import functions as F

from .. import store
from ..functions import text as X
from ..operators import embedding
from ..operators import lifecycle as L
from ..operators import retrieval as R
from ..operators import tables as O
from ..sources import config
from . import model, sql
from .registry import Plans

PLANS = Plans()

NOW = "TIMESTAMP '2024-02-01 00:00:00'"


@PLANS.add(f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 6 = 0 THEN '新對話' ELSE substring({sql.collapse("'  new ' || c_mktsegment || '   ' || c_name || repeat(' tail', 20)")}, 1, 80) END ELSE c_name END AS title,
 CASE WHEN c_custkey % 3 = 0 THEN {NOW} ELSE {model.BASE} END AS updated_at FROM customer""")
def rename_conversation(spark, sf_dir):
    """M-10: titles are collapsed and cut, edits by another user change nothing"""
    c = model.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7).alias("user_id"), F.col("c_name").alias("title"), F.expr(model.BASE).alias("updated_at"), "c_mktsegment")
    wanted = F.when(F.col("id") % 6 == 0, "  \n ").otherwise(F.concat(F.lit("  new "), "c_mktsegment", F.lit(" \t "), "title", F.repeat(F.lit(" tail"), 20)))
    mine = c.where("id % 3 = 0").select("id", "user_id", wanted.alias("title"))
    foreign = c.where("id % 3 = 1").select("id", (F.col("user_id") + 1).alias("user_id"), F.lit("not mine").alias("title"))
    # An earlier edit of the same row is overtaken by the one above.
    both = mine.withColumn("at", F.lit(2)).unionByName(mine.select("id", "user_id", F.lit("zz earlier").alias("title"), F.lit(1).alias("at")))
    return L.rename(c, both.unionByName(foreign.withColumn("at", F.lit(3))), F.expr(NOW), "新對話").select("id", "title", "updated_at")


@PLANS.add(f"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Edited ' || turn ELSE 'old' END AS title, CASE WHEN turn % 2 = 0 THEN 'changed: ' || {sql.strip('text')} ELSE text END AS content, CASE WHEN turn % 2 = 0 THEN {NOW} ELSE {model.BASE} END AS updated_at FROM conversations""")
def edit_note(spark, sf_dir):
    """M-10: an edit without content is refused"""
    c = model.read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit(1).alias("user_id"), F.lit("old").alias("title"), F.col("text").alias("content"), F.expr(model.BASE).alias("updated_at"))
    edits = c.select("id", "user_id", F.concat(F.lit(" Edited  "), F.col("turn").cast("string")).alias("title"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" changed: "), X.strip("content"), F.lit("\n"))).otherwise(F.lit("  ")).alias("content"))
    earlier = c.where("turn % 2 = 0").select("id", "user_id", F.lit("zz").alias("title"), F.lit("earlier").alias("content"), F.lit(1).alias("at"))
    return L.edit_notes(c, edits.withColumn("at", F.lit(2)).unionByName(earlier), F.expr(NOW)).select("conv_id", "turn", "title", "content", "updated_at")


@PLANS.add(f"""WITH {model.SOURCES}, t AS (SELECT DISTINCT notebook_id FROM sources WHERE source_id % 13 = 0), n AS (SELECT DISTINCT notebook_id FROM sources) SELECT n.notebook_id, CASE WHEN t.notebook_id IS NOT NULL THEN {NOW} ELSE {model.BASE} END AS updated_at FROM n LEFT JOIN t USING (notebook_id)""")
def touch_notebooks(spark, sf_dir):
    """M-10"""
    s = model.sources(spark, sf_dir)
    n = s.select("notebook_id").distinct().withColumn("updated_at", F.expr(model.BASE))
    return L.touch(n, s.where("source_id % 13 = 0"), "notebook_id", F.expr(NOW))


_DEFAULT = json.dumps({"final_chunk_count": 6})


@PLANS.add(f"""WITH p AS (SELECT s_suppkey AS id, s_name AS name, '{{"k": ' || s_nationkey || '}}' AS params_json, s_suppkey % 5 = 3 AS is_active FROM supplier), c AS (SELECT * FROM p ORDER BY is_active DESC, id LIMIT 1), r AS (SELECT o_orderkey % 9 AS eval_set_id, count(CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 9 <> 4 THEN 1 END) AS approved FROM orders GROUP BY ALL)
 SELECT eval_set_id, 'queued' AS status, approved AS progress_total, c.id AS profile_id, c.params_json AS profile_snapshot_json FROM r, c WHERE approved > 0 UNION ALL SELECT -1, 'queued', 1, 1, '{_DEFAULT}'""")
def profile_snapshots(spark, sf_dir):
    """V-15: runs hold a copy of the active profile; where there is no profile (set -1) a default one is made"""
    s = model.read(spark, sf_dir, "supplier")
    p = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.format_string('{"k": %d}', "s_nationkey").alias("params_json"), (F.col("s_suppkey") % 5 == 3).alias("is_active"), F.lit(False).alias("is_default"), F.lit(None).cast("long").alias("created_by"))
    k = F.col("o_orderkey")
    r = model.read(spark, sf_dir, "orders").groupBy((k % 9).alias("eval_set_id")).agg(F.count_if((k % 2 == 0) & (k % 9 != 4)).alias("approved"))
    runs = L.start_runs(r, L.default_profile(p, _DEFAULT, "default"))
    one = spark.range(1).select(F.lit(-1).cast("long").alias("eval_set_id"), F.lit(1).cast("long").alias("approved"))
    return runs.unionByName(L.start_runs(one, L.default_profile(p.limit(0), _DEFAULT, "default")))


@PLANS.add(f"""WITH {model.CHUNKS}, {model.EVAL_ITEMS} SELECT i.item_id, question, expected_source_id, expected_chunk_id, s.filename AS expected_filename, c.location AS expected_chunk_location, coalesce(substring({sql.collapse('c.text')}, 1, 220), '') AS expected_chunk_snippet, len(expected_substrings) AS n_substrings
 FROM (SELECT item_id, question, expected_source_id, expected_chunk_id * 1000000 AS expected_chunk_id, expected_substrings FROM eval_items WHERE approved) i LEFT JOIN sources s ON s.source_id = i.expected_source_id LEFT JOIN chunks c ON c.id = i.expected_chunk_id""")
def run_context(spark, sf_dir):
    """V-09: results with their items, expected sources and chunks, absent ones too"""
    items = model.eval_items(spark, sf_dir).withColumn("expected_chunk_id", F.col("expected_chunk_id") * 1_000_000)
    got = L.run_context(items.where("approved").select("item_id"), items, model.sources(spark, sf_dir), model.chunks(spark, sf_dir))
    return got.select("item_id", "question", "expected_source_id", "expected_chunk_id", "expected_filename", "expected_chunk_location", "expected_chunk_snippet", F.size("expected_substrings").cast("long").alias("n_substrings"))


def _messages(spark, sf_dir):
    c = model.messages(spark, sf_dir)
    snippets = F.when(F.col("id") % 3 == 0, F.array(F.substring("content", 1, 700), F.lit("  "), F.lit("臨床試驗的安全性與有效性資料說明文件"))).otherwise(F.array().cast("array<string>"))
    meta = F.when(F.col("id") % 5 == 0, '{"followups": ["a"], "followups_version": 2, "mode": "x"}').when(F.col("id") % 5 == 1, '{"followups": ["a"], "followups_version": 1, "n": 6, "n": 7}').otherwise("{}")
    return c.withColumn("snippets", snippets).withColumn("metadata_json", meta)


_LANGUAGE = "CASE WHEN la >= greatest(40, ha * 2) THEN 'English' WHEN ha >= 12 THEN 'Traditional Chinese' WHEN la >= 12 THEN 'English' ELSE '' END"


def _language(e: str) -> str:
    latin, han = (f"len(regexp_extract_all(substring({e}, 1, 6000), '{p}'))" for p in ("[A-Za-z]", "[一-鿿]"))
    return "nullif(" + _LANGUAGE.replace("la", latin).replace("ha", han) + ", '')"


@PLANS.add(f"""WITH {model.MESSAGES}, m AS (SELECT *, CASE WHEN id % 3 = 0 THEN [substring(content, 1, 700), '  ', '臨床試驗的安全性與有效性資料說明文件'] ELSE []::VARCHAR[] END AS snippets, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM messages),
 a AS (SELECT *, array_to_string(snippets, chr(10)) AS src FROM m WHERE role = 'assistant' AND question IS NOT NULL), l AS (SELECT *, coalesce({_language('src')}, {_language('content')}, {_language('question')}, 'Traditional Chinese') AS language FROM a)
 SELECT id, conversation_id, id % 5 = 0 AS cached, language, 'TARGET LANGUAGE: ' || language || chr(10) || chr(10) || 'Source excerpts:' || chr(10) || CASE WHEN len(snippets) = 0 THEN '(unavailable)' ELSE CASE WHEN {sql.strip('snippets[1]')} = '' THEN '' ELSE '[1] ' || substring({sql.strip('snippets[1]')}, 1, 500) || chr(10) || chr(10) END || '[3] ' || snippets[3] END
  || chr(10) || chr(10) || 'User question:' || chr(10) || substring({sql.strip('question')}, 1, 1000) || chr(10) || chr(10) || 'Assistant answer:' || chr(10) || substring({sql.strip('content')}, 1, 4000) || chr(10) || chr(10) || 'Return the JSON array now.' AS prompt FROM l""")
def followup_prompts(spark, sf_dir):
    """L-05, X-13: context, language and cache state of follow-up questions"""
    return L.followups(_messages(spark, sf_dir))


@PLANS.add(f"""WITH {model.MESSAGES} SELECT id, CASE WHEN id % 4 = 0 THEN 3 WHEN id % 5 < 2 THEN 1 ELSE 0 END AS n_followups, CASE WHEN id % 4 = 0 THEN 'What about ' || id || '?' WHEN id % 5 < 2 THEN 'a' END AS first_followup, CASE WHEN id % 4 = 0 OR id % 5 = 0 THEN 2 WHEN id % 5 = 1 THEN 1 END AS version,
 CASE WHEN id % 5 = 0 THEN 'x' END AS mode, CASE WHEN id % 5 = 1 THEN 7 END AS n FROM messages""")
def followups_patch(spark, sf_dir):
    """X-51, L-05, X-53: two keys of the metadata are set, the others stay with their types"""
    m = _messages(spark, sf_dir)
    reply = F.concat(F.lit('```json\n[" What about '), F.col("id").cast("string"), F.lit('? ", "", "b", "c", "d"]\n```'))
    made = m.select("id", F.when(F.col("id") % 4 == 0, reply).otherwise("no list").alias("reply"), F.lit(2).alias("at")).where("id % 4 < 2")
    made = made.unionByName(m.select("id", F.lit('["overtaken"]').alias("reply"), F.lit(1).alias("at")).where("id % 4 = 0"))
    whole = F.from_json("metadata_json", "struct<followups:array<string>,followups_version:int,mode:string,n:int>").alias("j")
    got = L.cache_followups(m, made).select("id", whole)
    return got.select("id", F.coalesce(F.size("j.followups"), F.lit(0)).alias("_n"), "j").select("id", F.greatest("_n", F.lit(0)).alias("n_followups"), F.get("j.followups", F.lit(0)).alias("first_followup"), F.col("j.followups_version").alias("version"), "j.mode", "j.n")


@PLANS.add(f"""WITH {model.CHUNKS} SELECT source_id, chunk_index // 64 AS batch, count(*) AS texts, sum(length(text))::BIGINT AS input_chars FROM chunks GROUP BY ALL""")
def embedding_batches(spark, sf_dir):
    """A-09, E-02: characters of each embedding request"""
    return L.batch_chars(model.chunks(spark, sf_dir))


@PLANS.add(f"""WITH {model.USAGE} SELECT id, call_type, status, CASE WHEN id % 3 = 0 THEN '' ELSE repeat('ab ', (id % 50)::INT) END AS content, CASE WHEN id % 3 = 1 THEN 12 ELSE (input_chars + 3) // 4 END AS prompt_tokens,
 CASE WHEN id % 3 = 1 THEN 3 WHEN id % 3 = 0 THEN 0 ELSE (3 * (id % 50) + 3) // 4 END AS completion_tokens, (id % 3 <> 1)::INT AS is_estimated FROM usage""")
def call_usage_events(spark, sf_dir):
    """L-01, G-01: counted tokens where the provider reports them, else estimates"""
    u = model.usage_events(spark, sf_dir)
    said = F.repeat(F.lit("ab "), (F.col("id") % 50).cast("int"))
    reply = F.concat(F.lit('{"choices": [{"message": {"content": "'), said, F.lit('"}}]'), F.when(F.col("id") % 3 == 1, ', "usage": {"prompt_tokens": 12, "completion_tokens": 3, "total_tokens": 15}').otherwise(""), F.lit("}"))
    got = L.call_events(u.withColumn("response", F.when(F.col("id") % 3 == 0, "bad gateway").otherwise(reply)))
    return got.select("id", "call_type", "status", "content", "prompt_tokens", "completion_tokens", "is_estimated")


@PLANS.add(f"""WITH {model.USAGE} SELECT id, status, CASE WHEN id % 7 = 0 THEN '' ELSE '你好' || id END AS content, id % 2 = 1 AS stream_usage_available, status = 'failed' AND id % 7 = 0 AS may_retry, CASE WHEN id % 2 = 1 THEN 11 ELSE (input_chars + 3) // 4 + CASE WHEN id % 7 = 0 THEN 0 ELSE (2 + length(id::VARCHAR) + 3) // 4 END END AS total_tokens FROM usage""")
def stream_usage_events(spark, sf_dir):
    """L-02: deltas in order, usage from the last line that has it, retries only before any delta"""
    u = model.usage_events(spark, sf_dir)
    delta = lambda c: F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), c, F.lit('"}}]}\n\n'))
    said = F.when(F.col("id") % 7 == 0, F.lit(": nothing\n\n")).otherwise(F.concat(delta(F.lit("你")), delta(F.lit("好")), delta(F.col("id").cast("string"))))
    tail = F.when(F.col("id") % 2 == 1, 'data: {"choices":[],"usage":{"prompt_tokens":9,"completion_tokens":2,"total_tokens":11}}\r\n\r\n').otherwise("")
    got = L.stream_events(u.withColumn("body", F.concat(said, tail, F.lit("data: [DONE]\n\n"))))
    return got.select("id", "status", "content", "stream_usage_available", "may_retry", "total_tokens")


@PLANS.add(f"""WITH {model.SOURCES}, s AS (SELECT *, CASE WHEN source_id % 4 = 0 THEN '  ' ELSE {sql.snippet('text', 160)} END AS summary FROM sources WHERE status = 'indexed'), i AS (SELECT *, row_number() OVER (PARTITION BY notebook_id ORDER BY source_id) AS nr FROM s WHERE trim(summary) <> ''),
 c AS (SELECT notebook_id, count(*) AS summaries, string_agg('[' || nr || '] ' || filename || chr(10) || {sql.strip('summary')}, chr(10) || chr(10) ORDER BY nr) AS context FROM i GROUP BY notebook_id), t AS (SELECT unnest(['briefing', 'compare', 'study_guide', 'faq', 'timeline']) AS tool, unnest([1, 2, 1, 1, 1]) AS needs)
 SELECT notebook_id, tool, summaries, context FROM c, t WHERE summaries >= needs""")
def tool_contexts(spark, sf_dir):
    """L-07, L-08, L-09: numbered summaries for each tool that has enough of them"""
    s = model.sources(spark, sf_dir).where("status = 'indexed'").withColumn("summary", F.when(F.col("source_id") % 4 == 0, "  ").otherwise(X.snippet(F.col("text"), 160)))
    return L.tool_contexts(s)


_WANTED = "CASE doc_id % 6 WHEN 0 THEN '繁體中文' WHEN 1 THEN 'English' WHEN 2 THEN '日本語' WHEN 3 THEN '简体中文' WHEN 4 THEN 'Klingon' ELSE 'english' END"


@PLANS.add(f"""SELECT doc_id AS id, {_WANTED} AS language, 'TARGET LANGUAGE: ' || {_WANTED} || chr(10) || chr(10) || 'Summary to translate:' || chr(10) || {sql.strip('text')} || chr(10) || chr(10) || 'Write the translation now.' AS prompt FROM documents WHERE doc_id % 6 < 4 AND {sql.strip('text')} <> ''""")
def translation_prompts(spark, sf_dir):
    """L-10: four languages, no others"""
    d = model.read(spark, sf_dir, "documents")
    return L.translation_prompts(d.select(F.col("doc_id").alias("id"), F.col("text").alias("summary"), F.expr(_WANTED).alias("language")))


@PLANS.add("""SELECT doc_id, doc_id AS source_id, 'input_length' AS category, CASE WHEN length(text) > 24000 THEN 'high' ELSE 'medium' END AS severity, 'local.rules.v1' AS detector_version, 'input_chars max_chars route' AS keys FROM documents WHERE length(text) > 12000""")
def safety_event_rows(spark, sf_dir):
    """G-07: stored findings have clean ids, redacted metadata and the detector's version"""
    d = model.read(spark, sf_dir, "documents")
    context = F.create_map(F.lit("source_id"), F.col("doc_id").cast("string"), F.lit("user_id"), F.lit("-1"), F.lit("other"), F.lit("3"))
    metadata = F.create_map(F.lit("route"), F.lit("upload"), F.lit("apiKey"), F.lit("k"))
    got = L.safety_events(d, "doc_id", "text", context, metadata, "source_ingest", "upload").where("category = 'input_length' and user_id is null")
    return got.select("doc_id", "source_id", "category", "severity", "detector_version", F.array_join(F.array_sort(F.map_keys("metadata")), " ").alias("keys"))


@PLANS.add("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, round(value, 1) AS latency_ms, CASE WHEN user_id % 2 = 0 THEN 'ok' ELSE 'not_tested' END AS json_status, user_id % 2 = 0 AS usage_reporting, 1 AS n_capabilities FROM events""")
def compact_diagnostics(spark, sf_dir):
    """G-10, L-13: bounded results of connection tests and whether usage is reported"""
    e = model.read(spark, sf_dir, "events")
    even = F.col("user_id") % 2 == 0
    probe = F.when(even, '{"status": "ok", "usage_available": true, "json_valid": true}').otherwise('{"latency_ms": 1.26}')
    result = F.concat(F.lit('{"status": "'), F.when(F.col("event_type") == "error", "").otherwise("ok"), F.lit('", "latency_ms": '), F.col("value").cast("string"), F.lit(', "capabilities": {"json": '), probe, F.lit(', "image": null}}'))
    got = e.select("event_id", L.compact_diagnostic(result).alias("d"))
    return got.select("event_id", "d.status", "d.latency_ms", F.col("d.capabilities")["json"].status.alias("json_status"), L.usage_reporting(F.col("d")).alias("usage_reporting"), F.size("d.capabilities").alias("n_capabilities"))


@PLANS.add("""SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 <> 0""")
def vector_upsert(spark, sf_dir):
    """S-16: rows of known ids are replaced, new ones added"""
    e = model.read(spark, sf_dir, "embeddings")
    return O.upsert(e.where("vec_id % 3 <> 0"), e.where("vec_id % 2 = 0").withColumn("label", F.col("label") + 100), "vec_id").select("vec_id", "label")


@PLANS.add("""SELECT 'chunk:' || vec_id AS vector_id, embedding[1]::DOUBLE AS first FROM embeddings WHERE vec_id % 5 <> 0""")
def index_plan_applied(spark, sf_dir):
    """S-16, K-07: the index after a diff plan holds every chunk once and no orphan"""
    e = model.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), O.vector_id(F.col("vec_id")).alias("vector_id"), "embedding")
    chunks = e.where("id % 5 <> 0")
    index = e.where("id % 2 = 0").select("vector_id", "embedding")
    plan = O.index_plan(chunks.select("id"), index)
    return O.apply_plan(index, plan, e.select("vector_id", "embedding")).select("vector_id", F.col("embedding")[0].cast("double").alias("first"))


@PLANS.add("""SELECT (SELECT count(*) FROM embeddings) AS deleted, 0 AS left_over""")
def clear_index(spark, sf_dir):
    """K-08"""
    empty, count = L.cleared(model.read(spark, sf_dir, "embeddings"))
    return count.crossJoin(empty.agg(F.count(F.lit(1)).alias("left_over")))


@PLANS.add("""SELECT 64 AS dimension, true AS same_accepted, true AS other_refused, NULL::INT AS empty_dimension""")
def index_dimension(spark, sf_dir):
    """S-12, E-08: the index's dimension, and the guard against another model's"""
    e = model.read(spark, sf_dir, "embeddings")
    size = lambda d: d.select(F.size("embedding").alias("n")).limit(1).agg(F.max("n"))

    def refused(n: int) -> bool:
        try:
            embedding.check_dimension(e, n)
            return False
        except ValueError:
            return True

    found = size(e).toDF("dimension").crossJoin(size(e.limit(0)).toDF("empty_dimension"))
    return found.select("dimension", F.lit(not refused(64)).alias("same_accepted"), F.lit(refused(384)).alias("other_refused"), "empty_dimension")


_LOCK = threading.Lock()
_SEEN = {"now": 0, "most": 0}
#: By thread, in which one call makes all its attempts.
_TRIES: dict[int, int] = {}


def _watched(texts: list[str]) -> list[list[float]]:
    """An embedder for checks that fails twice before it answers: a text's length, how many texts came in a call, how many
    calls were under way at most, and at which attempt it answered."""
    if any("refuse me" in t for t in texts):
        raise RuntimeError("bad input")
    with _LOCK:
        _SEEN["now"] += 1
        _SEEN["most"] = max(_SEEN["most"], _SEEN["now"])
        tries = _TRIES[threading.get_ident()] = _TRIES.get(threading.get_ident(), 0) + 1
    try:
        time.sleep(0.01)
        if tries < 3:
            raise embedding.TransientError
        with _LOCK:
            del _TRIES[threading.get_ident()]
        return [[float(len(t)), float(len(texts)), float(_SEEN["most"]), float(tries)] for t in texts]
    finally:
        with _LOCK:
            _SEEN["now"] -= 1


@PLANS.add("""SELECT doc_id, (length(text) + 9)::DOUBLE AS chars, true AS bounded, 3 AS attempts, true AS window_held, true AS overlapped FROM documents""")
def embedder_batches(spark, sf_dir):
    """E-01, E-02, E-03, E-04, E-06: any embedder under a prefix in bounded batches, two to four under way at a time, each tried until it answers, keys kept"""
    found = embedding.embed(model.read(spark, sf_dir, "documents"), _watched, key="doc_id", text="text", prefix="passage:", batch=16, wait=0.002)
    got = store.written(found.select("doc_id", *(F.col("embedding")[k].alias(c) for k, c in enumerate(("chars", "texts", "most", "tries")))))
    overlapped = got.agg((F.max("most") >= 2).alias("overlapped"))
    shown = got.select("doc_id", F.col("chars").cast("double").alias("chars"), (F.col("texts") <= 16).alias("bounded"), F.col("tries").cast("int").alias("attempts"), (F.col("most") <= embedding.IN_FLIGHT).alias("window_held"))
    return shown.crossJoin(F.broadcast(overlapped))


@PLANS.add("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'no embedding model is configured' WHEN doc_id % 50 = 1 THEN 'RuntimeError: bad input' ELSE '' END AS error, NOT (doc_id % 2 = 0 OR doc_id % 50 = 1) AS embedded FROM documents""")
def embedder_refusals(spark, sf_dir):
    """E-05: without a model every row says so; with one, what it refuses fails alone"""
    d = model.documents(spark, sf_dir)
    none = embedding.embed(d.where("doc_id % 2 = 0"), None, key="doc_id", text="text", errors=True)
    text = F.when(F.col("doc_id") % 50 == 1, F.concat(F.lit("refuse me "), "text")).otherwise(F.col("text")).alias("text")
    some = embedding.embed(d.where("doc_id % 2 = 1").select("doc_id", text), _watched, key="doc_id", text="text", wait=0.002, errors=True)
    return none.unionByName(some).select("doc_id", "error", F.col("embedding").isNotNull().alias("embedded"))


_OVERRIDE = """CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '{"vector_weight": 0.5, "unknown": 9}' ELSE '{"final_chunk_count": ' || c_nationkey || '}' END"""


@PLANS.add("""SELECT c_custkey AS run_id, CASE WHEN c_custkey % 3 = 0 THEN 0.9 WHEN c_custkey % 3 = 1 THEN 0.5 ELSE 0.7 END::DOUBLE AS vector_weight, CASE WHEN c_custkey % 3 = 0 THEN 4 WHEN c_custkey % 3 = 1 THEN 6 ELSE c_nationkey END AS final_chunk_count, NOT (c_custkey % 3 = 2 AND c_nationkey < 1) AS valid FROM customer""")
def profile_params(spark, sf_dir):
    """R-18, R-19: no override means the active profile, an override lies over the defaults; counts are positive"""
    c = model.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.expr(_OVERRIDE).alias("override"))
    active = R.RetrievalParams(vector_weight=0.9, final_chunk_count=4)
    got = c.select("run_id", R.resolved_params(F.col("override"), active).alias("p"))
    return got.select("run_id", "p.vector_weight", F.col("p.final_chunk_count").cast("int").alias("final_chunk_count"), R.params_valid(F.col("p")).alias("valid"))


@PLANS.add("""SELECT * FROM (VALUES ('chunking', 'cjk_target_chars', '300'), ('jobs', 'max_attempts', '3'), ('retrieval', 'final_chunk_count', '6'), ('retrieval', 'vector_weight', '0.5')) AS t(grp, key, value)""")
def settings_layers(spark, sf_dir):
    """S-13: a variable lies over the file, the file over the default"""
    got = config.load_config(None, {"TESSELLA_RETRIEVAL_VECTOR_WEIGHT": "0.5", "TESSELLA_CHUNKING_CJK_TARGET_CHARS": "300"})
    rows = [(g, k, str(got[g][k])) for g, k in (("chunking", "cjk_target_chars"), ("jobs", "max_attempts"), ("retrieval", "final_chunk_count"), ("retrieval", "vector_weight"))]
    return spark.createDataFrame(rows, "grp string, key string, value string")


@PLANS.add("""SELECT s_suppkey, sha256('{"model": "' || s_name || '", "provider": "p' || s_nationkey || '"}') AS fingerprint FROM supplier""")
def settings_fingerprint(spark, sf_dir):
    """X-21: secrets don't count"""
    s = model.read(spark, sf_dir, "supplier")
    m = F.create_map(F.lit("provider"), F.concat(F.lit("p"), F.col("s_nationkey").cast("string")), F.lit("model"), F.col("s_name"), F.lit("api_key"), F.col("s_acctbal").cast("string"))
    return s.select("s_suppkey", config.fingerprint_column(m).alias("fingerprint"))


@PLANS.add(f"""WITH {model.CHUNKS}, s AS (SELECT source_id FROM sources WHERE source_id % 19 = 0) SELECT 'file' AS kind, '/store/' || source_id AS name FROM s UNION ALL SELECT 'vector', 'chunk:' || id FROM chunks WHERE source_id IN (SELECT source_id FROM s)""")
def source_cleanup(spark, sf_dir):
    """M-11: what deleted sources leave to be removed"""
    s = model.sources(spark, sf_dir).withColumn("stored_path", F.concat(F.lit("/store/"), F.col("source_id").cast("string")))
    return L.source_artifacts(s, model.chunks(spark, sf_dir), s.where("source_id % 19 = 0"))


@PLANS.add(f"""WITH {model.CHUNKS}, k AS (SELECT source_id, count(*) AS n FROM chunks GROUP BY source_id) SELECT s.source_id, CASE WHEN s.source_id % 10 = 0 OR n IS NULL THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN s.source_id % 10 = 0 THEN repeat('e', 500) WHEN n IS NULL THEN 'No extractable text found.' ELSE '' END AS error,
 CASE WHEN s.source_id % 10 = 0 THEN 0 ELSE coalesce(n, 0) END AS chunks FROM sources s LEFT JOIN k USING (source_id)""")
def source_states(spark, sf_dir):
    """K-09: indexed, or failed with a bounded error and no chunks"""
    s = model.sources(spark, sf_dir).withColumn("error", F.lit("")).drop("text")
    broken = s.where("source_id % 10 = 0").select("source_id", F.repeat(F.lit("e"), 900).alias("error"))
    return L.process_sources(s, model.chunks(spark, sf_dir), broken.unionByName(broken)).select("source_id", "status", "error", "chunks")


@PLANS.add("""WITH n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey AS request_id, l_linenumber AS position, CASE WHEN n <= 5 THEN 'uploaded' ELSE 'refused' END AS status, CASE WHEN n <= 5 THEN 'queued' END AS job_status FROM n""")
def upload_batches(spark, sf_dir):
    """S-22: a request of more than five files is refused as a whole"""
    u = model.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("filename"))
    return L.upload_batch(u).drop("filename")
