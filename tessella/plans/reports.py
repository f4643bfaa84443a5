"""Relational reports over notebooks, conversations, sources and runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from . import model, sql
from .registry import Plans

PLANS = Plans()


def _count(rows, key, name):
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))


@PLANS.add(f"""WITH {model.SOURCES}, {model.MESSAGES}, n AS (SELECT unnest(range(0, 22)) AS notebook_id)
 SELECT n.notebook_id, (SELECT count(*) FROM sources s WHERE s.notebook_id = n.notebook_id) AS sources, (SELECT count(DISTINCT conversation_id) FROM messages m WHERE m.notebook_id = n.notebook_id) AS conversations FROM n""")
def notebook_grid(spark, sf_dir):
    """Q-01, J-08, F-01: counts of children, 0 for none"""
    n = spark.range(22).withColumnRenamed("id", "notebook_id")
    c = model.messages(spark, sf_dir).groupBy("notebook_id").agg(F.countDistinct("conversation_id").alias("conversations"))
    out = n.join(_count(model.sources(spark, sf_dir), "notebook_id", "sources"), "notebook_id", "left").join(c, "notebook_id", "left")
    return out.select("notebook_id", *(F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("sources", "conversations")))


@PLANS.add(f"WITH {model.MESSAGES} SELECT conversation_id, count(*) AS messages, count(CASE WHEN role = 'user' THEN 1 END) AS asked, max(id) AS last_id FROM messages WHERE role IN ('user', 'assistant') GROUP BY conversation_id")
def conversation_counts(spark, sf_dir):
    """Q-02, A-02..A-04, F-11"""
    m = model.messages(spark, sf_dir).where(F.col("role").isin("user", "assistant"))
    return m.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("asked"), F.max("id").alias("last_id"))


@PLANS.add(f"""WITH {model.SOURCES}, {model.MESSAGES} SELECT * FROM (SELECT 'source' AS kind, source_id AS id, filename AS title FROM sources WHERE contains(lower(filename), 'src1') ORDER BY updated_at DESC, source_id DESC LIMIT 50)
 UNION ALL SELECT * FROM (SELECT 'message', id, {sql.snippet('content', 60)} FROM messages WHERE contains(lower(content), 'the') ORDER BY id DESC LIMIT 50) UNION ALL SELECT * FROM (SELECT 'benchmark', item_id, {sql.snippet('text', 60)} FROM benchmark WHERE contains(lower(text), 'the') ORDER BY item_id DESC LIMIT 50)
 UNION ALL SELECT * FROM (SELECT 'page', page_id, url FROM pages WHERE contains(lower(url), 'a') ORDER BY page_id DESC LIMIT 50)""")
def global_search(spark, sf_dir):
    """Q-03, U-06, F-06: four kinds of rows, each with its own limit"""
    s = model.sources(spark, sf_dir).where(F.contains(F.lower("filename"), F.lit("src1"))).orderBy(F.desc("updated_at"), F.desc("source_id")).limit(50).select(F.lit("source").alias("kind"), F.col("source_id").alias("id"), F.col("filename").alias("title"))
    m = model.messages(spark, sf_dir).where(F.contains(F.lower("content"), F.lit("the"))).orderBy(F.desc("id")).limit(50).select(F.lit("message").alias("kind"), "id", X.snippet(F.col("content"), 60).alias("title"))
    b = model.read(spark, sf_dir, "benchmark").where(F.contains(F.lower("text"), F.lit("the"))).orderBy(F.desc("item_id")).limit(50).select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), X.snippet(F.col("text"), 60).alias("title"))
    p = model.read(spark, sf_dir, "pages").where(F.contains(F.lower("url"), F.lit("a"))).orderBy(F.desc("page_id")).limit(50).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("title"))
    return s.unionByName(m).unionByName(b).unionByName(p)


@PLANS.add(f"WITH {model.SOURCES} SELECT notebook_id, user_id, count(*) AS indexed FROM sources WHERE status = 'indexed' AND ('src1' = '' OR contains(filename, 'src1')) GROUP BY ALL")
def indexed_counts(spark, sf_dir):
    """Q-04, J-03, F-02, F-07"""
    s = model.sources(spark, sf_dir).where("status = 'indexed'").where(F.contains("filename", F.lit("src1")))
    return s.groupBy("notebook_id", "user_id").agg(F.count(F.lit(1)).alias("indexed"))


@PLANS.add("SELECT o_orderkey AS run_id, c_name AS profile, n_name AS owner, o_orderdate AS started_at FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def run_history(spark, sf_dir):
    """Q-06, J-02, O-01: joins of three tables, newest first"""
    o, c, n = (model.read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select(F.col("o_orderkey").alias("run_id"), F.col("c_name").alias("profile"), F.col("n_name").alias("owner"), F.col("o_orderdate").alias("started_at"))


@PLANS.add("SELECT s_suppkey AS profile_id, s_name AS profile, n_name AS creator FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey <> 2")
def profile_list(spark, sf_dir):
    """Q-09, J-04: an optional dimension"""
    s, n = model.read(spark, sf_dir, "supplier"), model.read(spark, sf_dir, "nation").where("n_regionkey <> 2")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(F.col("s_suppkey").alias("profile_id"), F.col("s_name").alias("profile"), F.col("n_name").alias("creator"))


@PLANS.add(f"WITH {model.MESSAGES} SELECT conversation_id, count(CASE WHEN role <> 'system' THEN id END) AS messages FROM messages GROUP BY conversation_id")
def conversation_detail(spark, sf_dir):
    """Q-07, A-03"""
    m = model.messages(spark, sf_dir)
    heads, rest = m.select("conversation_id").distinct(), m.where("role <> 'system'").select("conversation_id", "id")
    return heads.join(rest, "conversation_id", "left").groupBy("conversation_id").agg(F.count("id").alias("messages"))


@PLANS.add(f"WITH {model.CHUNKS} SELECT source_id, chunk_index, location, substring(text, 1, 500) AS excerpt FROM chunks WHERE chunk_index < 3")
def source_preview(spark, sf_dir):
    """Q-08, F-12"""
    return model.chunks(spark, sf_dir).where("chunk_index < 3").select("source_id", F.col("chunk_index").cast("long").alias("chunk_index"), "location", F.substring("text", 1, 500).alias("excerpt"))


@PLANS.add(f"""WITH {model.CHUNKS}, summaries AS (SELECT doc_id AS source_id, CASE quality WHEN 1 THEN 'summary of ' || doc_id ELSE '  ' END AS summary FROM labels), f AS (SELECT source_id, substring(arg_min(text, chunk_index), 1, 400) AS first_text FROM chunks GROUP BY source_id)
 SELECT source_id, coalesce(nullif(trim(summary), ''), first_text) AS summary FROM f LEFT JOIN summaries USING (source_id)""")
def summary_fallback(spark, sf_dir):
    """Q-12, J-10: a summary, or the start of the first chunk"""
    f = model.chunks(spark, sf_dir).groupBy("source_id").agg(F.substring(F.min_by("text", "chunk_index"), 1, 400).alias("first_text"))
    s = model.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_id"), F.when(F.col("quality") == 1, F.concat(F.lit("summary of "), "doc_id")).otherwise("  ").alias("s"))
    return f.join(s, "source_id", "left").select("source_id", F.coalesce(F.nullif(F.trim("s"), F.lit("")), "first_text").alias("summary"))


@PLANS.add(f"WITH {model.MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY notebook_id ORDER BY id DESC) AS n FROM messages) SELECT notebook_id, count(CASE WHEN n <= 20 THEN 1 END) AS shown, max(n) > 20 AS truncated FROM r WHERE n <= 21 GROUP BY notebook_id")
def truncation_flag(spark, sf_dir):
    """O-02: one row more than the limit tells that there are more"""
    r = model.messages(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("notebook_id").orderBy(F.desc("id")))).where("n <= 21")
    return r.groupBy("notebook_id").agg(F.count_if(F.col("n") <= 20).alias("shown"), (F.max("n") > 20).alias("truncated"))


@PLANS.add(f"WITH {model.MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) AS n FROM messages m WHERE id <> (SELECT max(id) FROM messages x WHERE x.conversation_id = m.conversation_id)) SELECT conversation_id, (7 - n)::INT AS place, id, role FROM r WHERE n <= 6")
def recent_history(spark, sf_dir):
    """W-05, J-06, O-04, B-29: the last six before the newest, oldest first"""
    m = model.messages(spark, sf_dir).withColumn("top", F.max("id").over(Window.partitionBy("conversation_id"))).where("id < top")
    r = m.withColumn("n", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id")))).where("n <= 6")
    return r.select("conversation_id", (7 - F.col("n")).alias("place"), "id", "role")


@PLANS.add(f"""WITH {model.MESSAGES} SELECT id, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM messages QUALIFY role = 'assistant'""")
def previous_user_turn(spark, sf_dir):
    """J-09, W-07: as-of lookup of the question before an answer"""
    w = Window.partitionBy("conversation_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    m = model.messages(spark, sf_dir).withColumn("asked", F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w))
    return m.where("role = 'assistant'").select("id", "asked")


@PLANS.add(f"WITH {model.MESSAGES}, s AS (SELECT *, sum(length(content)) OVER (PARTITION BY conversation_id ORDER BY id) AS upto FROM messages) SELECT conversation_id, count(*) AS messages, max(upto)::BIGINT AS chars FROM s WHERE upto <= 4000 GROUP BY conversation_id")
def prefix_budget(spark, sf_dir):
    """O-06: the longest prefix within a budget"""
    w = Window.partitionBy("conversation_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    s = model.messages(spark, sf_dir).withColumn("upto", F.sum(F.length("content")).over(w)).where("upto <= 4000")
    return s.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("messages"), F.max("upto").alias("chars"))


@PLANS.add(f"""WITH {model.MESSAGES}, p AS (SELECT id, role, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM messages)
 SELECT id AS source_message_id, coalesce(nullif(substring({sql.collapse('asked')}, 1, 80), ''), 'Note') AS title FROM p WHERE role = 'assistant' AND id NOT IN (SELECT id FROM messages WHERE id % 5 = 0)""")
def pin_note_title(spark, sf_dir):
    """M-08: notes for answers not pinned yet, titled by their question"""
    w = Window.partitionBy("conversation_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    m = model.messages(spark, sf_dir)
    pinned = m.where("id % 5 = 0").select("id")
    p = m.withColumn("asked", F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w)).where("role = 'assistant'").join(pinned, "id", "left_anti")
    return p.select(F.col("id").alias("source_message_id"), F.coalesce(F.nullif(F.substring(X.collapse(F.col("asked")), 1, 80), F.lit("")), F.lit("Note")).alias("title"))


@PLANS.add(f"WITH {model.SOURCES} SELECT source_id FROM sources WHERE user_id = 3 AND source_id IN (SELECT o_orderkey FROM orders)")
def allowed_sources(spark, sf_dir):
    """F-10, J-07: requested ids that the tenant owns"""
    asked = model.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"))
    return model.sources(spark, sf_dir).where("user_id = 3").join(asked, "source_id", "left_semi").select("source_id")


@PLANS.add(f"WITH {model.SOURCES}, {model.MESSAGES} SELECT DISTINCT user_id FROM (SELECT user_id FROM sources WHERE notebook_id > 10 UNION SELECT user_id FROM messages WHERE notebook_id < 5)")
def owners_without_notebook(spark, sf_dir):
    """U-01"""
    a = model.sources(spark, sf_dir).where("notebook_id > 10").select("user_id")
    return a.union(model.messages(spark, sf_dir).where("notebook_id < 5").select("user_id")).distinct()


@PLANS.add(f"""WITH {model.MESSAGES} SELECT conversation_id, '# Conversation ' || conversation_id || chr(10) || chr(10) || string_agg(CASE role WHEN 'user' THEN '## ' || content ELSE content END, chr(10) || chr(10) ORDER BY created_at, id) AS markdown FROM messages WHERE role IN ('user', 'assistant') GROUP BY conversation_id""")
def export_conversation_md(spark, sf_dir):
    """S-17"""
    m = model.messages(spark, sf_dir).where(F.col("role").isin("user", "assistant"))
    line = F.when(F.col("role") == "user", F.concat(F.lit("## "), "content")).otherwise(F.col("content"))
    g = m.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", line.alias("line")))).alias("ls"))
    return g.select("conversation_id", F.concat(F.lit("# Conversation "), F.col("conversation_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("ls", lambda x: x.line), "\n\n")).alias("markdown"))


@PLANS.add(f"""WITH {model.MESSAGES} SELECT notebook_id, string_agg('## Note ' || id || chr(10) || content || chr(10) || strftime(created_at, '%Y-%m-%d %H:%M:%S'), chr(10) || '---' || chr(10) ORDER BY id) AS markdown FROM messages WHERE role = 'assistant' GROUP BY notebook_id""")
def export_notes_md(spark, sf_dir):
    """S-18"""
    m = model.messages(spark, sf_dir).where("role = 'assistant'")
    note = F.concat(F.lit("## Note "), F.col("id").cast("string"), F.lit("\n"), "content", F.lit("\n"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    g = m.groupBy("notebook_id").agg(F.array_sort(F.collect_list(F.struct("id", note.alias("n")))).alias("ns"))
    return g.select("notebook_id", F.array_join(F.transform("ns", lambda x: x.n), "\n---\n").alias("markdown"))


_ROW = "'{{\"item\":' || item_id || ',\"rank\":' || rank || ',\"score\":' || (score * 100)::BIGINT {more} || '}}'"


@PLANS.add(f"WITH {model.RETRIEVED} SELECT item_id, '{{\"schema\":\"run.v1\",\"results\":[' || string_agg({_ROW.format(more='')}, ',' ORDER BY rank, chunk_id, source_id, score) || ']}}' AS payload FROM retrieved GROUP BY item_id")
def export_run_sanitized(spark, sf_dir):
    """S-20: without questions, evidence and snippets"""
    return _export(spark, sf_dir, [])


@PLANS.add(f"WITH {model.RETRIEVED} SELECT item_id, '{{\"schema\":\"run.v1\",\"results\":[' || string_agg({_ROW.format(more='|| chr(44) || chr(34) || $$text$$ || chr(34) || chr(58) || chr(34) || text || chr(34)')}, ',' ORDER BY rank, chunk_id, source_id, score) || ']}}' AS payload FROM retrieved GROUP BY item_id")
def export_run_full(spark, sf_dir):
    """S-20: with the retrieved texts"""
    return _export(spark, sf_dir, ["text"])


def _export(spark, sf_dir, more):
    r = model.retrieved(spark, sf_dir)
    row = F.struct(F.col("item_id").alias("item"), "rank", F.round(F.col("score") * 100).cast("long").alias("score"), *more)
    g = r.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "source_id", "score", row.alias("r")))).alias("rs"))
    return g.select("item_id", F.to_json(F.struct(F.lit("run.v1").alias("schema"), F.transform("rs", lambda x: x.r).alias("results"))).alias("payload"))


@PLANS.add("""SELECT s_suppkey AS id, '{"schema":"retrieval_profile.v1","name":"' || s_name || '","params":{"candidate_pool_size":' || (s_suppkey % 40 + 1) || '}}' AS payload FROM supplier""")
def export_profile(spark, sf_dir):
    """S-19"""
    s = model.read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.to_json(F.struct(F.lit("retrieval_profile.v1").alias("schema"), F.col("s_name").alias("name"), F.struct((F.col("s_suppkey") % 40 + 1).alias("candidate_pool_size")).alias("params"))).alias("payload"))
