"""Retrieval evaluation: hit ranks, run metrics, diagnoses and run-to-run comparison."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as X

#: A run's metrics that are compared, and whether higher is better.
METRICS = {"recall_at_k": True, "mrr": True, "avg_top_score": True, "avg_latency_ms": False, "low_confidence_rate": False, "hits": True}
#: Statuses from best to worst.
STATUS_ORDER = ["hit", "miss", "unscored", "error", "pending"]


def hit_ranks(items: DataFrame, retrieved: DataFrame) -> DataFrame:
    """items with hit_rank: the first rank that meets all given criteria, 0 for none, null without criteria.

    items: (item_id, expected_source_id, expected_chunk_id, expected_substrings); retrieved: (item_id, rank,
    source_id, chunk_id, text).
    """
    want = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    criteria = want("expected_source_id") | want("expected_chunk_id") | (F.size("expected_substrings") > 0)
    joined = items.select("item_id", "expected_source_id", "expected_chunk_id", "expected_substrings").join(retrieved, "item_id")
    ok = (
        (~want("expected_source_id") | (F.col("source_id") == F.col("expected_source_id"))) & (~want("expected_chunk_id") | (F.col("chunk_id") == F.col("expected_chunk_id")))
        & ((F.size("expected_substrings") == 0) | F.exists("expected_substrings", lambda s: F.contains(F.col("text"), s)))
    )
    first = joined.where(ok).groupBy("item_id").agg(F.min("rank").alias("_first"))
    return items.join(first, "item_id", "left").withColumn("hit_rank", F.when(criteria, F.coalesce("_first", F.lit(0)))).drop("_first")


def status_of(hit_rank: Column, failed: Column) -> Column:
    return F.when(failed, "error").when(hit_rank.isNull(), "unscored").when(hit_rank > 0, "hit").otherwise("miss")


def run_metrics(results: DataFrame, by: str = "run_id", threshold: float = 0.25) -> DataFrame:
    """One row a run: counts, recall and MRR over scored rows, averages and the low-confidence rate over all rows."""
    n, scored = F.count(F.lit(1)), F.count_if(F.col("status").isin("hit", "miss"))
    share = lambda top, of: F.when(of > 0, top / of).otherwise(0.0)
    hits = F.count_if(F.col("status") == "hit")
    # Decimals add up to the same sum in any order, so rounded results don't hang on how rows were dealt.
    total = lambda c: F.sum(c.cast("decimal(28,9)")).cast("double")
    rr = F.coalesce(total(F.when((F.col("status") == "hit") & (F.col("hit_rank") > 0), 1 / F.col("hit_rank"))), F.lit(0.0))
    score = F.coalesce("top_score", F.lit(0.0))
    return results.groupBy(by).agg(
        n.alias("total"), scored.alias("scored"), hits.alias("hits"), F.count_if(F.col("status") == "miss").alias("misses"), F.count_if(F.col("status") == "unscored").alias("unscored"), F.count_if(F.col("status") == "error").alias("errors"),
        F.round(share(hits, scored), 4).alias("recall_at_k"), F.round(share(rr, scored), 4).alias("mrr"), F.round(total(F.coalesce("latency_ms", F.lit(0.0))) / n, 1).alias("avg_latency_ms"), F.round(total(score) / n, 4).alias("avg_top_score"), F.round(share(F.count_if(score < threshold), n), 4).alias("low_confidence_rate"),
    )


FOUND = "array<struct<rank:int,source_id:bigint,chunk_id:bigint,text:string,score:double>>"
RUN = "run_id long, status string, progress_total long, progress_current long, errors long, error string"


def attempt(items: DataFrame, search: Callable[[dict], list[dict]]) -> DataFrame:
    """(item_id, found, latency_ms, error): what a search finds for each item; one that raises has an error of at most 300
    characters and the others go on."""
    names = items.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                item, began, found, error = dict(zip(names, row, strict=True)), time.perf_counter(), [], ""
                try:
                    found = [{"rank": int(f["rank"]), "source_id": int(f["source_id"]), "chunk_id": int(f["chunk_id"]), "text": f["text"], "score": float(f["score"])} for f in search(item)]
                except Exception as e:  # noqa: BLE001 - one item must not end the run
                    error = (str(e) or type(e).__name__)[:300]
                out.append((item["item_id"], found, 1000 * (time.perf_counter() - began), error))
            yield pd.DataFrame(out, columns=["item_id", "found", "latency_ms", "error"])

    return items.mapInPandas(run, f"item_id long, found {FOUND}, latency_ms double, error string")


def run_job(run_id: int, items: DataFrame, sources: DataFrame, search: Callable[[dict], list[dict]], out: str, threshold: float = 0.25) -> tuple[DataFrame, DataFrame | None]:
    """One run over the approved items: its record (RUN) and its results (run_id, item_id, status, hit_rank, top_score, latency_ms, error).

    Items are searched in tasks, each on its own, and counted as they are written to `out`: the counts are the run's
    progress. A run without approved items or indexed sources fails before it begins; one that breaks off fails with the
    reason, in at most 500 characters, and has no results.
    """
    spark = items.sparkSession
    wanted = items.where("approved")
    total = wanted.count()

    def record(status: str, current: int = 0, errors: int = 0, error: str = "") -> DataFrame:
        return spark.createDataFrame([(run_id, status, total, current, errors, error[:500])], RUN)

    if not total:
        return record("failed", error="there are no approved items to run"), None
    if not sources.where("status = 'indexed'").limit(1).count():
        return record("failed", error="there are no indexed sources"), None
    try:
        progress = Observation(f"run {run_id}")
        attempt(wanted, search).observe(progress, F.count(F.lit(1)).alias("items"), F.count_if(F.col("error") != "").alias("errors")).write.mode("overwrite").parquet(out)
        done = spark.read.parquet(out)
        ranks = hit_ranks(wanted, done.select("item_id", F.explode("found").alias("f")).select("item_id", "f.*")).select("item_id", "hit_rank")
        joined = done.join(ranks, "item_id")
        top = F.array_max(F.transform("found", lambda f: f.score))
        results = joined.select(F.lit(run_id).cast("long").alias("run_id"), "item_id", status_of(F.col("hit_rank"), F.col("error") != "").alias("status"), F.when(F.col("hit_rank") > 0, F.col("hit_rank")).alias("hit_rank"), top.alias("top_score"), "latency_ms", "error")
        return record("succeeded", progress.get["items"], progress.get["errors"]), results
    except Exception as e:  # noqa: BLE001 - the run's record says why
        return record("failed", error=str(e)), None


def compact_retrieved(retrieved: DataFrame) -> DataFrame:
    """Ranked rows with 220-character collapsed snippets and scores to four places."""
    return retrieved.select("item_id", "rank", "chunk_id", "source_id", F.round("score", 4).alias("score"), F.substring(X.collapse(F.coalesce("text", F.lit(""))), 1, 220).alias("snippet"))


def diagnosis(results: DataFrame, compact: DataFrame) -> DataFrame:
    """(item_id, status, reasons): codes of why an item missed, in a fixed order; substrings are looked for in snippets.

    Codes: hit, unscored, error, nothing_retrieved, source_missing, source_found_elsewhere, chunk_missing,
    substring_missing, criteria_unmet.
    """
    lists = compact.groupBy("item_id").agg(F.collect_set("source_id").alias("sources"), F.collect_set("chunk_id").alias("chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "snippet"))), lambda x: x.snippet), " ").alias("all_text"))
    r = results.join(lists, "item_id", "left")
    source = F.col("expected_source_id")
    codes = F.filter(F.array(
        F.when(source.isNotNull() & ~F.array_contains("sources", source), "source_missing").when(source.isNotNull(), "source_found_elsewhere"),
        F.when(F.col("expected_chunk_id").isNotNull() & ~F.array_contains("chunks", F.col("expected_chunk_id")), "chunk_missing"),
        F.when(F.exists("expected_substrings", lambda s: ~F.contains(F.col("all_text"), s)), "substring_missing"),
    ), lambda c: c.isNotNull())
    reasons = F.when(F.col("status") != "miss", F.col("status")).when(F.col("sources").isNull(), "nothing_retrieved").when(F.size(codes) == 0, "criteria_unmet").otherwise(F.array_join(codes, " "))
    return r.select("item_id", "status", reasons.alias("reasons"))


def compare_metrics(base: DataFrame, candidate: DataFrame, by: str) -> DataFrame:
    """(key, metric, base, candidate, delta, direction): better, worse or same, each metric by its own polarity."""
    long = lambda d, name: d.select(by, *(F.col(m).cast("double").alias(m) for m in METRICS)).unpivot([by], list(METRICS), "metric", name)
    both = long(base, "base").join(long(candidate, "candidate"), [by, "metric"])
    delta = F.round(F.col("candidate") - F.col("base"), 4)
    higher = F.col("metric").isin([m for m, up in METRICS.items() if up])
    direction = F.when(delta == 0, "same").when((delta > 0) == higher, "better").otherwise("worse")
    return both.select(by, "metric", "base", "candidate", delta.alias("delta"), direction.alias("direction"))


def compare_questions(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per item of either run: statuses (a dash for an absent side), ranks and the trend."""
    b, c = (d.select("item_id", F.col("status").alias(f"{n}_status"), F.col("hit_rank").alias(f"{n}_rank")) for d, n in ((base, "base"), (candidate, "candidate")))
    order = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col(s)), F.lit(0)), F.lit(9))
    bo, co = order("base_status"), order("candidate_status")
    hits = (F.col("base_status") == "hit") & (F.col("candidate_status") == "hit") & (F.col("base_rank") > 0) & (F.col("candidate_rank") > 0)
    both = F.col("base_status").isNotNull() & F.col("candidate_status").isNotNull()
    better = (co < bo) | F.coalesce(hits & (F.col("candidate_rank") < F.col("base_rank")), F.lit(False))
    worse = (co > bo) | F.coalesce(hits & (F.col("candidate_rank") > F.col("base_rank")), F.lit(False))
    trend = F.when(both & better, "improved").when(both & worse, "regressed").otherwise("unchanged")
    dash = lambda s: F.coalesce(F.col(s), F.lit("—")).alias(s)
    return b.join(c, "item_id", "full_outer").select("item_id", dash("base_status"), dash("candidate_status"), "base_rank", "candidate_rank", trend.alias("trend"))


def compare_params(base: Column, candidate: Column, keys: list[str]) -> Column:
    """array<struct<key,base,candidate,changed>> of two maps over the known keys that either has."""
    rows = F.transform(F.array(*map(F.lit, keys)), lambda k: F.struct(k.alias("key"), F.try_element_at(base, k).alias("base"), F.try_element_at(candidate, k).alias("candidate")))
    some = F.filter(rows, lambda r: r.base.isNotNull() | r.candidate.isNotNull())
    return F.transform(some, lambda r: F.struct(r.key.alias("key"), r.base.alias("base"), r.candidate.alias("candidate"), (~r.base.eqNullSafe(r.candidate)).alias("changed")))
