"""What keeps a query's cost in step with its input: how work is dealt out, and what isn't shuffled or held."""

import random
import re

import pandas as pd
from pyspark.sql import functions as F

from tessella import store
from tessella.operators import chunking, embedding
from tessella.operators import extraction as E
from tessella.operators import retrieval as R
from tessella.plans import files as plans
from tessella.sources import files


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pdf_words_are_not_shuffled(spark):
    texts = ["one (two)\\three\n\nfour é", "漢字 \U0001f600 x\n  y", ""]
    rows = [(f"/in/{k}.pdf", plans._pdf(str(k), t)) for k, t in enumerate([*texts, *texts])] + [("/in/9.pdf", b"none")]
    given = spark.createDataFrame(rows, "path string, content binary")
    found = files.pdf_sections(given)
    assert "Exchange" not in planned(found)
    # The layout operators over rows of words say the same.
    words = files.pdf_words(given).where("page is not null")
    want = sorted((r.path, r.location, r.text) for r in E.paragraphs_of(E.lines_of(words, "page", "path"), "page", "path").collect())
    assert sorted((r.path, s.location, s.text) for r in found.collect() for s in r.sections) == want
    assert [r.error for r in found.where("error <> ''").collect()] == ["ValueError: no PDF heading"]


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    spark.range(9_000).select("id", F.lit("x").alias("text")).coalesce(1).write.parquet(path)
    # Many splits of the file, of which one alone has rows.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        d = store.spread(spark.read.parquet(path), 1_000)
        assert d.rdd.getNumPartitions() == 9
        assert max(r["count"] for r in d.groupBy(F.spark_partition_id().alias("p")).count().collect()) <= 1_100
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_cut_text_is_the_fold(spark):
    odd = [
        None, "", " \t\n", "a", "One. Two! Three?\nFour\n\nfive.Six  seven\t\teight", "。。！a。b？！c\n。", "x" * 2_000, ("word, " * 300) + "end.", "漢字" * 500 + "。", "，、" * 500, "a;" + "b" * 799 + ";c. d",
        " ".join(f"Sentence number {k} of a text." for k in range(200)), " ".join("w" * (k * 37 % 830) + "." for k in range(60)), "檢索增強生成。" * 200 + "\U0001f600" * 900, "a\x1c. \x85b　. c !", "\r\f a \v\v b. \r\n c", "s" * 799 + ". " + "t" * 800 + ". u.", "k. " * 700,
    ]
    d = spark.createDataFrame(list(enumerate(odd)), "source_id long, text string")
    for overlap in (0, 1, 3):
        got = {r.source_id: r.t for r in chunking.chunk_sources(d, overlap=overlap).groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c.text).alias("t")).collect()}
        for r in d.select("source_id", chunking.chunk_text(F.col("text"), overlap=overlap).alias("t")).collect():
            assert got.get(r.source_id, []) == r.t, (overlap, r.source_id)


def test_texts_are_cut_in_plain_steps(spark):
    d = spark.createDataFrame([(1, "a. b.")], "source_id long, text string")
    assert "ArrowEvalPython" in planned(chunking.chunk_sources(d)) and "aggregate(" not in planned(chunking.chunk_sources(d))


def test_hashed_texts_are_dealt_out_by_their_number(spark):
    d = spark.range(3 * store.TASK_ROWS * spark.sparkContext.defaultParallelism).select("id", F.lit("a b").alias("text"))
    assert f"hashpartitioning(id#{{}}, {3 * spark.sparkContext.defaultParallelism})".replace("#{}", "") in re.sub(r"#\d+L?", "", planned(embedding.hash_entries(d, "id", "text")))


def _vectors(spark):
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(8)], k % 3 if k % 7 else None) for k in range(400)]
    rows += [(400 + k, rows[0][1], 1) for k in range(150)]  # copies of a query
    rows += [(600, None, 1), (601, [], 2), (602, [1.0, 2.0], 1), (603, [float("nan")] * 8, 0), (604, [None] + [1.0] * 7, 2), (605, [1e120] * 8, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_tiles_score_like_the_fold(spark, same):
    index = _vectors(spark)
    queries = index.where("vec_id % 50 = 0 or vec_id > 600").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    pairs = R.dense_scores(index, queries)
    same(R.dense_topk(index, queries, 20).toPandas(), R.top(pairs.select("query_id", "id", "score"), ["query_id"], [F.desc("score"), F.asc("id")], 20).withColumnRenamed("_rank", "rank").toPandas())
    same(R.dense_best(index, queries, "label").toPandas(), pairs.groupBy("label", "id").agg(F.max("score").alias("score")).toPandas())
    assert "NestedLoopJoin" not in planned(R.dense_topk(index.where("vec_id < 500"), queries.where("query_id < 500"), 20))
    nothing = index.where("vec_id < 0")
    assert R.dense_topk(nothing, queries, 20).count() == 0 and R.dense_topk(index, queries.where("query_id < 0"), 20).count() == 0


def test_newest_chunks_are_those_of_the_window(spark, same):
    rows = [(k % 3, k // 2 * 2 if k % 4 == 0 else k, f"t{k}") for k in range(60)] + [(7, None, "n"), (7, 3, "o"), (None, 5, "p")]
    chunks = spark.createDataFrame(rows, "user_id long, id long, text string")
    got = R.newest_chunks(chunks, 9)
    same(got.toPandas(), R.top(chunks, ["user_id"], [F.desc("id")], 9).where("user_id is not null").drop("_rank").toPandas())


def test_a_bucket_of_the_sink_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SINK_ROWS", 500)
    path = str(tmp_path / "sink")
    files.write_chunks(spark.range(20_000).select((F.col("id") % 5_000).alias("source_id"), F.lit("t").alias("text")), path, buckets=2)
    found = files.read_chunks(spark, path)
    written = found.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("k")).collect()
    assert found.count() == 20_000 and len(written) >= 10 and max(r.n for r in written) < 6_000
    assert sum(r.k for r in written) == 5_000  # a source lies in one file


def test_files_are_made_of_their_own_rows_alone(spark, monkeypatch):
    d = spark.createDataFrame([(k, "nn" if k % 10 in (5, 6) else None, "nn" if k % 10 == 8 else "t") for k in range(40)], "doc_id long, source string, text string")
    made = {r.doc_id: bytes(r.content) for r in plans._mixed_files(d).collect()}
    assert all((made[k][:4] == b"%PDF") == (k % 10 == 8) and (made[k][:2] == b"PK") == (k % 10 in (5, 6)) for k in range(40))
    monkeypatch.setattr(plans, "FILE_ROWS", 2)
    assert plans._mixed_files(d).rdd.getNumPartitions() == 20
    assert list(next(plans._pdfs(iter([(pd.Series([None, "1"]), pd.Series([None, "a"]))]))).isna()) == [True, False]
