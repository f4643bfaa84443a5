import functools
import random
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella import catalogue
from tessella.functions import text as X
from tessella.operators import embedding, postings
from tessella.operators import retrieval as R
from tessella.plans import model


def chunk_rows(spark):
    rows = [
        (1, 7, 1, "a.md", "document", "Alpha beta gamma about retrieval systems"),
        (2, 7, 1, "a.md", "document", "Completely different words live here"),
        (3, 8, 2, "b.md", "document", "Alpha beta gamma about retrieval systems"),
        (4, 7, 3, "c.md", "document", "retrieval systems and alpha_x tokens"),
    ]
    return spark.createDataFrame(rows, "id long, user_id long, source_id long, filename string, location string, text string")


def asked(spark, question="Alpha retrieval systems"):
    q = spark.createDataFrame([(1, 7, question)], "question_id long, user_id long, question string")
    return q.withColumn("queries", R.query_set(F.col("question")))


def arms(spark, q):
    chunks = chunk_rows(spark)
    variants = q.select("question_id", "user_id", F.posexplode("queries").alias("variant", "query")).withColumn("key", F.col("variant"))
    return chunks, embedding.sparse(embedding.hash_entries(chunks, "id", "text", "user_id"), "id", "user_id"), embedding.hash_entries(variants, "key", "query", "question_id", "variant", "user_id").drop("key")


def test_tenants_never_meet(spark):
    q = asked(spark)
    got = R.retrieve(*arms(spark, q), q).select("id").collect()
    assert {r.id for r in got} <= {1, 2, 4} and got[0].id == 1


def test_rerank_drops_unscored_and_clamps(spark):
    rows = [(1, i, i, 0.5 - i / 100, f"t{i}") for i in range(1, 5)]
    ranked = spark.createDataFrame(rows, "question_id long, id long, position int, score double, text string")
    scores = spark.createDataFrame([(1, 2, 7.0), (1, 3, 0.1)], "question_id long, position int, rerank double")
    got = [(r.id, r.rerank_score) for r in R.rerank(ranked, scores).orderBy("rank").collect()]
    assert got == [(2, 1.0), (3, 0.1)]
    assert [r.id for r in R.rerank(ranked, None).orderBy("rank").collect()] == [1, 2, 3, 4]


def test_diversify_drops_close_texts(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, 1, 0.9, long), (1, 2, 0.8, long + "."), (1, 3, 0.7, "short text"), (1, 4, 0.6, "short text")]
    df = spark.createDataFrame(rows, "question_id long, id long, score double, text string")
    assert sorted(r.id for r in R.diversify(df, 10).collect()) == [1, 3, 4]
    assert sorted(r.id for r in R.diversify(df, 2).collect()) == [1, 3]


def test_underscore_is_a_wildcard(spark):
    df = spark.createDataFrame([("alphaZx",), ("alpha_x",), ("alphax",)], "t string")
    got = df.select(R.like_any(F.col("t"), F.lower("t"), F.array(F.lit("alpha_x")))).collect()
    assert [r[0] for r in got] == [True, True, False]


def test_keyword_score(spark):
    df = spark.createDataFrame([("the alpha beta", ["alpha beta"]), ("alpha", ["alpha beta"]), ("", ["alpha"]), ("alpha", ["the"])], "t string, q array<string>")
    assert [r[0] for r in df.select(X.keyword_score(F.col("q"), F.col("t"))).collect()] == [1.0, 0.5, 0.0, 0.0]


def test_params():
    assert R.resolve_params({"vector_weight": 0.5, "unknown": 1}).vector_weight == 0.5
    assert R.validate_params(R.params_dict(R.RetrievalParams())) == R.RetrievalParams()
    for bad in ({}, R.params_dict(R.RetrievalParams()) | {"final_chunk_count": 0}, R.params_dict(R.RetrievalParams()) | {"vector_weight": -1}):
        with pytest.raises(ValueError):
            R.validate_params(bad)


def test_embedder_batches_prefix_and_refusal(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id long, text string")
    got = embedding.embed(rows, lambda texts: [[float(len(t)), float(t.startswith("passage: "))] for t in texts], key="id", text="text", prefix="passage:", batch=3).collect()
    assert sorted((r.id, list(r.embedding)) for r in got) == [(i, [11.0, 1.0]) for i in range(10)]
    with pytest.raises(ValueError):
        embedding.embed(rows, None, key="id", text="text")
    with pytest.raises(ValueError):
        embedding.check_dimension(spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>"), 3)


def test_retry_waits_longer_each_time():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise embedding.TransientError
        return "ok"

    assert embedding.with_retry(call, sleep=waits.append) == "ok"
    assert 0.5 <= waits[0] <= 0.75 and 1.0 <= waits[1] <= 1.25
    with pytest.raises(embedding.TransientError):
        embedding.with_retry(lambda: (_ for _ in ()).throw(embedding.TransientError()), sleep=waits.append)


def test_window_of_calls_keeps_order():
    """No more than the bound run at once, two at least do, results come in the order of calls, errors end it."""
    lock, seen = threading.Lock(), [0, 0]

    def call(k):
        with lock:
            seen[0] += 1
            seen[1] = max(seen)
        time.sleep(0.02 if k % 3 else 0.05)
        with lock:
            seen[0] -= 1
        return k

    assert list(embedding.in_flight((functools.partial(call, k) for k in range(30)), 4)) == list(range(30))
    assert 2 <= seen[1] <= 4
    with pytest.raises(ZeroDivisionError):
        list(embedding.in_flight([lambda: 1, lambda: 1 / 0, lambda: 2], 2))


def test_batches_cross_frames():
    frames = [pd.DataFrame({"x": range(a, b)}) for a, b in ((0, 3), (3, 3), (3, 20), (20, 21))]
    got = [f["x"].tolist() for f in embedding._batched(iter(frames), 8)]
    assert [len(g) for g in got] == [8, 8, 5] and sum(got, []) == list(range(21))
    assert list(embedding._batched(iter([]), 8)) == []


def test_index_finds_what_reading_finds(spark, monkeypatch):
    """Frequent and rare tokens, parts of words, Han, wildcards, tenants apart: the same rows with and without the index."""
    rng = random.Random(11)
    words = ["alpha", "alphabet", "beta.max", "of", "zq", "x_y", "xay", "x y", "臨床試驗", "rare-word", "Ünder", "9", "a", "İx"]
    rows = [(n, n % 3, n, " ".join(rng.choice(words[:5] if n % 5 else words) for _ in range(6))) for n in range(300)]
    chunks = spark.createDataFrame([*rows, (300, 0, 1, None), (301, 0, 1, "")], "id long, user_id long, source_id long, text string")
    asked = ["alpha zq", "phab", "x_y", "臨床", "rare-w", "nothing here", "of 9 ünder", "eta.m", "q", ""]
    q = spark.createDataFrame([(n, n % 4, [t]) for n, t in enumerate(asked * 4)], "question_id long, user_id long, queries array<string>")
    want = sorted(map(tuple, R.lexical_arm(chunks, q, 5).collect()))
    for recent in (30, 3):
        monkeypatch.setattr(postings, "RECENT", recent)
        made = {}
        index = postings.build(chunks, 20, lambda name, make: made.setdefault(name, make().cache()))  # noqa: B023
        assert sorted(map(tuple, R.lexical_by_index(chunks, q, 5, index).collect())) == want and len(want) > 50
    monkeypatch.setattr(R, "READ_PAIRS", 100)
    assert sorted(map(tuple, R.lexical_arm(chunks, q, 5, lambda: index).collect())) == want
    with pytest.raises(ValueError):
        R.lexical_by_index(chunks, q, 6, index)


def test_retries_wait_in_proportion_to_their_base():
    """A quarter second of jitter stood beside a base of two milliseconds."""
    for _ in range(50):
        waits = []
        with pytest.raises(embedding.TransientError):
            embedding.with_retry(lambda: (_ for _ in ()).throw(embedding.TransientError()), base=0.002, sleep=waits.append)
        assert 0.002 <= waits[0] <= 0.003 and 0.004 <= waits[1] <= 0.005


def test_questions_of_frequent_words_need_neither_index_nor_old_chunks(spark, monkeypatch):
    """Beyond READ_PAIRS every chunk's words were indexed, also where the newest chunks answer all questions."""
    rows = [(k, k % 2, k, f"Alpha word{k % 7} {'rare' if k < 4 else ''}") for k in range(400)]
    chunks = spark.createDataFrame(rows, "id long, user_id long, source_id long, text string")
    asked = [(1, 0, ["alpha word3"]), (2, 1, ["word5 alpha"])]
    shape = "question_id long, user_id long, queries array<string>"
    q, more = (spark.createDataFrame(r, shape) for r in (asked, [*asked, (3, 0, ["rare thing"]), (4, 5, ["alpha"])]))
    want, wider = (sorted(map(tuple, R.lexical_arm(chunks, x, 5).collect())) for x in (q, more))
    monkeypatch.setattr(R, "READ_PAIRS", 100)
    monkeypatch.setattr(R, "NEWEST", 40)

    def index():
        raise AssertionError("an index is built")

    assert sorted(map(tuple, R.lexical_arm(chunks, q, 5, index).collect())) == want and len(want) == 10
    assert sorted(map(tuple, R.lexical_arm(chunks, more, 5).collect())) == wider and [r[1] for r in wider if r[0] == 3] == [0, 2]


def test_lexical_plans_make_no_vectors(spark, data_dir, monkeypatch):
    def vectors(*_):
        raise AssertionError("vectors are made")

    monkeypatch.setattr(model, "vectors", vectors)
    for name in ("lexical_candidates", "lexical_index"):
        assert catalogue.QUERIES[name](spark, data_dir).columns == ["question_id", "id", "keyword_score"]


def test_what_is_refused_fails_alone_in_a_batch(spark):
    """A request a text was the only way to tell a refused one from its batch."""

    def embedder(texts):
        if any(t.startswith("down") for t in texts):
            raise embedding.TransientError("later")
        if any(t.startswith("bad") for t in texts):
            raise RuntimeError("no " * 300)
        return [[float(len(texts))] for _ in texts]

    rows = spark.range(0, 200, 1, 1).select("id", F.when(F.col("id").isin(5, 6, 70), "bad").when(F.col("id") == 150, "down").otherwise("fine").alias("text"))
    got = {r.id: r for r in embedding.embed(rows, embedder, key="id", text="text", wait=0.001, errors=True).collect()}
    assert {k for k, r in got.items() if r.error.startswith("RuntimeError: no") and len(r.error) == 500 and r.embedding is None} == {5, 6, 70}
    # What is down for a while is not asked text by text.
    assert {k for k, r in got.items() if r.error == "TransientError: later" and r.embedding is None} == set(range(128, 192))
    fine = {k: r.embedding[0] for k, r in got.items() if not r.error}
    assert len(fine) == 200 - 3 - 64 and fine[40] == 32.0 and fine[4] == 1.0 and fine[199] == 8.0 and fine[100] == 32.0
    with pytest.raises(Exception, match="RuntimeError: no"):
        embedding.embed(rows.where("id < 100"), embedder, key="id", text="text").collect()
    none = embedding.embed(rows, None, key="id", text="text", errors=True).select("error").distinct().collect()
    assert [r.error for r in none] == ["no embedding model is configured"]
