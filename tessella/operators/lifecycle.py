"""A notebook's life as table rewrites: titles and notes, profiles and runs, follow-ups, model calls and their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from . import governance as G

#: The version of cached follow-ups, what a tool needs, and the languages that summaries are put into.
FOLLOWUPS_VERSION = 2
TOOLS = {"briefing": 1, "compare": 2, "study_guide": 1, "faq": 1, "timeline": 1}
LANGUAGES = ["繁體中文", "English", "日本語", "简体中文"]
#: Columns of a safety event and their widths.
SAFETY_WIDTHS = {"event_type": 80, "surface": 120, "category": 80, "severity": 40, "decision": 40, "rule_id": 120, "content_hash": 80, "redacted_summary": 300}

EMBED_BATCH = 64


def clean_title(title: Column, default: str = "") -> Column:
    """White space collapsed, at most 80 characters; the default for nothing."""
    return F.coalesce(F.nullif(F.substring(X.collapse(F.coalesce(title, F.lit(""))), 1, 80), F.lit("")), F.lit(default))


def last_edits(edits: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """The last edit of each key, by the column `at` where edits have one; of edits at one time that of the greatest values."""
    order = F.struct(*(["at"] if "at" in edits.columns else []), *values)
    return edits.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_last")).select(*keys, *(F.col(f"_last.{v}").alias(v) for v in values))


def rename(rows: DataFrame, edits: DataFrame, now: Column, default: str = "") -> DataFrame:
    """rows (id, user_id, title, updated_at, ...) with the titles of edits (id, user_id, title, maybe at): the last one of a row counts, of others' rows none changes."""
    e = last_edits(edits.withColumn("_title", clean_title(F.col("title"), default)), ["id", "user_id"], "_title")
    joined = rows.join(e, ["id", "user_id"], "left")
    mine = F.col("_title").isNotNull()
    return joined.withColumn("title", F.coalesce("_title", "title")).withColumn("updated_at", F.when(mine, now).otherwise(F.col("updated_at"))).drop("_title")


def edit_notes(notes: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """notes with title and content of edits (id, user_id, title, content, maybe at), the last of a note; one without content changes nothing."""
    some = edits.withColumn("_content", X.strip(F.coalesce("content", F.lit("")))).where("_content <> ''").withColumn("_title", clean_title(F.col("title")))
    e = last_edits(some, ["id", "user_id"], "_title", "_content")
    joined = notes.join(e, ["id", "user_id"], "left")
    mine = F.col("_content").isNotNull()
    made = {"title": F.when(mine, F.col("_title")).otherwise(F.col("title")), "content": F.coalesce("_content", "content"), "updated_at": F.when(mine, now).otherwise(F.col("updated_at"))}
    return joined.withColumns(made).drop("_title", "_content")


def touch(parents: DataFrame, children: DataFrame, key: str, now: Column) -> DataFrame:
    """parents with updated_at set where a child was changed."""
    hit = children.select(key).distinct().withColumn("_hit", F.lit(True))
    return parents.join(hit, key, "left").withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))).drop("_hit")


def default_profile(profiles: DataFrame, params_json: str, name: str, created_by: int | None = None) -> DataFrame:
    """One row: the first active profile, else the first, else a new one of these parameters."""
    new = profiles.sparkSession.createDataFrame([(1, name, params_json, True, True, created_by)], "id long, name string, params_json string, is_active boolean, is_default boolean, created_by long")
    ranked = profiles.select(*new.columns, F.when(F.col("is_active"), 0).otherwise(1).alias("_rank")).unionByName(new.withColumn("_rank", F.lit(2)))
    return ranked.orderBy("_rank", "id").limit(1).drop("_rank")


def start_runs(requests: DataFrame, profile: DataFrame) -> DataFrame:
    """requests (eval_set_id, approved) as queued runs that hold a copy of the profile's parameters; sets without items don't run."""
    p = profile.select(F.col("id").alias("profile_id"), F.col("params_json").alias("profile_snapshot_json"))
    return requests.where("approved > 0").crossJoin(F.broadcast(p)).select("eval_set_id", F.lit("queued").alias("status"), F.col("approved").alias("progress_total"), "profile_id", "profile_snapshot_json")


def run_context(results: DataFrame, items: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """results (item_id, ...) with their question and what it expected: file name, location and 220-character snippet."""
    wanted = items.select("item_id", "question", "expected_source_id", "expected_chunk_id", "expected_substrings")
    s = sources.select(F.col("source_id").alias("expected_source_id"), F.col("filename").alias("expected_filename"))
    c = chunks.select(F.col("id").alias("expected_chunk_id"), F.col("location").alias("expected_chunk_location"), F.substring(X.collapse("text"), 1, 220).alias("expected_chunk_snippet"))
    joined = results.join(wanted, "item_id").join(s, "expected_source_id", "left").join(c, "expected_chunk_id", "left")
    return joined.withColumn("expected_chunk_snippet", F.coalesce("expected_chunk_snippet", F.lit("")))


def patch_json(document: Column, values: dict[str, Column]) -> Column:
    """A JSON object with these keys set to these JSON values; its other keys stay as they are, of a repeated one the last.
    What is no object counts as empty."""
    every = F.coalesce(F.from_json(document, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    others = F.filter(F.map_entries(every), lambda e: ~e.key.isin(list(values)))
    new = F.array(*(F.struct(F.lit(k).alias("key"), F.parse_json(v).alias("value")) for k, v in values.items()))
    return F.to_json(X.last_wins(F.concat(others, new)))


def followups(messages: DataFrame) -> DataFrame:
    """What follow-up questions to an answer are asked with, a row for each answer after a question.

    messages: (id, conversation_id, role, content, snippets array<string>, metadata_json). cached: the message has
    follow-ups of this version already. Language: the first that excerpts, answer or question show.
    """
    before = Window.partitionBy("conversation_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    asked = messages.withColumn("question", F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(before))
    answers = asked.where((F.col("role") == "assistant") & F.col("question").isNotNull())
    given = F.filter(F.transform("snippets", lambda s, i: F.struct(X.strip(F.coalesce(s, F.lit(""))).alias("text"), (i + 1).alias("nr"))), lambda s: s.text != "")
    excerpts = F.array_join(F.transform(given, lambda s: F.concat(F.lit("["), s.nr.cast("string"), F.lit("] "), F.substring(s.text, 1, 500))), "\n\n")
    cached = F.coalesce((F.get_json_object("metadata_json", "$.followups_version").try_cast("int") == FOLLOWUPS_VERSION) & (F.get_json_object("metadata_json", "$.followups[0]").isNotNull()), F.lit(False))
    language = X.followup_language(F.array_join("snippets", "\n"), F.col("content"), F.col("question"))
    prompt = F.concat(
        F.lit("TARGET LANGUAGE: "), language, F.lit("\n\nSource excerpts:\n"), F.when(excerpts == "", "(unavailable)").otherwise(excerpts), F.lit("\n\nUser question:\n"), F.substring(X.strip("question"), 1, 1_000),
        F.lit("\n\nAssistant answer:\n"), F.substring(X.strip("content"), 1, 4_000), F.lit("\n\nReturn the JSON array now."),
    )
    return answers.select("id", "conversation_id", cached.alias("cached"), language.alias("language"), prompt.alias("prompt"))


def cache_followups(messages: DataFrame, made: DataFrame) -> DataFrame:
    """messages with the follow-ups of made (id, reply, maybe at) in their metadata: at most three of a model's JSON strings, those made last."""
    strings = F.from_json(X.extract_json(F.col("reply")), "array<string>")
    three = F.slice(F.filter(F.transform(strings, X.strip), lambda q: q != ""), 1, 3)
    new = last_edits(made.withColumn("_new", three).where(F.size("_new") > 0), ["id"], "_new")
    patched = patch_json(F.col("metadata_json"), {"followups": F.to_json("_new"), "followups_version": F.lit(str(FOLLOWUPS_VERSION))})
    return messages.join(new, "id", "left").withColumn("metadata_json", F.when(F.col("_new").isNotNull(), patched).otherwise(F.col("metadata_json"))).drop("_new")


def tool_contexts(sources: DataFrame) -> DataFrame:
    """(notebook_id, tool, summaries, context) for each tool that has enough non-empty summaries: numbered under file names."""
    some = sources.withColumn("_summary", X.strip(F.coalesce("summary", F.lit("")))).where("_summary <> ''")
    lists = some.groupBy("notebook_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "filename", "_summary"))).alias("items"))
    context = F.array_join(F.transform("items", lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s.filename, F.lit("\n"), s["_summary"])), "\n\n")
    made = lists.select("notebook_id", F.size("items").cast("long").alias("summaries"), context.alias("context"))
    tools = F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(n).alias("needs")) for t, n in TOOLS.items()))
    return made.select("*", F.explode(tools).alias("t")).where("summaries >= t.needs").select("notebook_id", "t.tool", "summaries", "context")


def translation_prompts(requests: DataFrame) -> DataFrame:
    """requests (id, summary, language) of known languages and with something to translate, as prompts."""
    ok = requests.where(F.col("language").isin(LANGUAGES) & (X.strip(F.coalesce("summary", F.lit(""))) != ""))
    return ok.select("id", "language", F.concat(F.lit("TARGET LANGUAGE: "), "language", F.lit("\n\nSummary to translate:\n"), X.strip("summary"), F.lit("\n\nWrite the translation now.")).alias("prompt"))


def batch_chars(chunks: DataFrame, batch: int = EMBED_BATCH) -> DataFrame:
    """(source_id, batch, texts, input_chars): what each embedding request of a source is charged with."""
    made = chunks.groupBy("source_id", F.floor(F.col("chunk_index") / batch).alias("batch"))
    return made.agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("input_chars"))


def call_events(calls: DataFrame) -> DataFrame:
    """Usage events of calls (id, call_type, status, latency_ms, input_chars, response): the reply and its counted or estimated tokens."""
    content = F.coalesce(F.get_json_object("response", "$.choices[0].message.content"), F.lit(""))
    made = calls.withColumn("content", content)
    usage = G.normalise_usage(F.get_json_object("response", "$.usage"), F.col("input_chars"), F.length("content").cast("long"))
    return G.usage_event(made.withColumn("usage", usage).select("id", "call_type", "status", "latency_ms", "content", "usage.*"))


def stream_events(calls: DataFrame) -> DataFrame:
    """Usage events of streamed calls (id, call_type, status, latency_ms, input_chars, body), body being `data:` lines.

    The reply is all deltas in order; usage is the last that a line reports, else it is estimated. A broken stream may
    be tried again only if it has emitted nothing.
    """
    lines = F.filter(F.transform(F.split("body", r"\R"), X.strip), lambda x: F.startswith(x, F.lit("data:")))
    data = F.filter(F.transform(lines, lambda x: X.strip(F.substring(x, 6, 1 << 30))), lambda x: x != "[DONE]")
    made = calls.withColumn("data", data)
    deltas = F.transform("data", lambda d: F.coalesce(F.get_json_object(d, "$.choices[0].delta.content"), F.lit("")))
    reported = F.filter(F.transform("data", lambda d: F.get_json_object(d, "$.usage")), lambda u: u.isNotNull())
    made = made.withColumn("content", F.array_join(deltas, "")).withColumn("reported", F.try_element_at(reported, F.lit(-1)))
    usage = G.normalise_usage(F.col("reported"), F.col("input_chars"), F.length("content").cast("long"))
    out = made.withColumn("usage", usage).withColumn("stream_usage_available", F.col("reported").isNotNull()).withColumn("may_retry", (F.col("status") == "failed") & (F.col("content") == ""))
    return G.usage_event(out.select("id", "call_type", "status", "latency_ms", "content", "stream_usage_available", "may_retry", "usage.*"))


def safety_events(rows: DataFrame, key: str, text: str, context: Column, metadata: Column, event_type: str, surface: str) -> DataFrame:
    """Findings as they are stored: cut to their widths, with clean context ids and redacted metadata, detector stamped."""
    found = rows.select(key, context.alias("_context"), metadata.alias("_metadata"), F.explode(G.findings(F.col(text), event_type, surface)).alias("f"))
    cut = [F.substring(F.col(f"f.{c}"), 1, n).alias(c) for c, n in SAFETY_WIDTHS.items()]
    both = G.clean_metadata(F.map_concat(F.map_filter("_metadata", lambda k, v: ~F.array_contains(F.map_keys("f.metadata"), k)), F.col("f.metadata")))
    return found.select(key, G.clean_context(F.col("_context")).alias("c"), *cut, F.col("f.detector_version").alias("detector_version"), both.alias("metadata")).select(key, "c.*", *SAFETY_WIDTHS, "detector_version", "metadata")


def compact_diagnostic(result: Column) -> Column:
    """struct of a connection test's result (JSON) in bounded width: status, latency to one place, and its capabilities."""
    one = "struct<status:string,latency_ms:double,error_class:string,usage_available:boolean,stream_usage_fallback:boolean,json_valid:boolean>"
    whole = F.from_json(result, f"struct<status:string,provider:string,model:string,latency_ms:double,error_class:string,embedding_dimension:int,capabilities:map<string,{one}>>")
    text = lambda c, n, empty="": F.substring(F.coalesce(F.nullif(c, F.lit("")), F.lit(empty)), 1, n)
    ms = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 1)

    def item(v: Column) -> Column:
        return F.struct(text(v.status, 40, "not_tested").alias("status"), ms(v.latency_ms).alias("latency_ms"), text(v.error_class, 120).alias("error_class"), v.usage_available.alias("usage_available"), v.stream_usage_fallback.alias("stream_usage_fallback"), v.json_valid.alias("json_valid"))

    def shaped(r: Column) -> Column:
        known = F.map_filter(r.capabilities, lambda k, v: v.isNotNull())
        return F.struct(
            text(r.status, 40, "failed").alias("status"), text(r.provider, 80).alias("provider"), text(r.model, 160).alias("model"), ms(r.latency_ms).alias("latency_ms"), text(r.error_class, 120).alias("error_class"), r.embedding_dimension.alias("embedding_dimension"),
            F.transform_values(F.transform_keys(known, lambda k, v: F.substring(k, 1, 80)), lambda k, v: item(v)).alias("capabilities"),
        )

    return X.let(whole, shaped)


def usage_reporting(diagnostic: Column) -> Column:
    """Whether the JSON probe or the stream probe of a connection test came with usage."""
    has = lambda k: F.coalesce(F.try_element_at(diagnostic.capabilities, F.lit(k)).usage_available, F.lit(False))
    return has("json") | has("stream")


def cleared(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the index without any vector, one row with how many there were)."""
    return index.limit(0), index.agg(F.count(F.lit(1)).alias("deleted"))


def source_artifacts(sources: DataFrame, chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """(kind, name) of what a deleted source leaves behind: its stored file and the vectors of its chunks."""
    files = sources.join(gone.select("source_id"), "source_id", "left_semi").select(F.lit("file").alias("kind"), F.col("stored_path").alias("name")).where("name <> ''")
    vectors = chunks.join(gone.select("source_id"), "source_id", "left_semi").select(F.lit("vector").alias("kind"), F.concat(F.lit("chunk:"), F.col("id").cast("string")).alias("name"))
    return files.unionByName(vectors)


def process_sources(sources: DataFrame, chunks: DataFrame, failures: DataFrame) -> DataFrame:
    """sources (source_id, status, error, ...) after ingest: indexed with chunks, failed with an error of at most 500 characters."""
    counts = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("_chunks"))
    broken = last_edits(failures.withColumn("_error", F.coalesce("error", F.lit(""))), ["source_id"], "_error")
    joined = sources.join(counts, "source_id", "left").join(broken, "source_id", "left")
    fine = F.col("_error").isNull() & (F.coalesce("_chunks", F.lit(0)) > 0)
    error = F.when(fine, "").otherwise(F.substring(F.coalesce("_error", F.lit("No extractable text found.")), 1, 500))
    return joined.withColumn("error", error).withColumn("status", F.when(fine, "indexed").otherwise("failed")).withColumn("chunks", F.when(fine, F.col("_chunks")).otherwise(F.lit(0))).drop("_chunks", "_error")


def upload_batch(uploads: DataFrame, limit: int = 5) -> DataFrame:
    """uploads (request_id, position, filename) within a request's limit as new sources, each with a queued job; others are refused."""
    n = F.count(F.lit(1)).over(Window.partitionBy("request_id"))
    ok = F.col("_n") <= limit
    return uploads.withColumn("_n", n).select("request_id", "position", "filename", F.when(ok, "uploaded").otherwise("refused").alias("status"), F.when(ok, "queued").alias("job_status"))
