"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import embed_join, exact_dedup, minhash, mixing, packing, quality, suffix_dedup, token_counts, toxicity, warc
from tessella.llm.common import table, written

SCHEMA = "doc_id long, text string, source string, kept string, text_sha256 string, rid string, h string, score string, slot string, label string"
BIG = (1 << 62) + 1
LONG = "many words in a row and " * 20_000
ROWS = [(None, None), (1, ""), (2, None), (3, "same text as the other"), (3, "same text as the other"), (3, "another text"), (None, "same text as the other"), (BIG, LONG), (5, LONG), (6, "x" * 50_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if n % 2 else "s", *["?"] * 7) for n, (i, t) in enumerate(ROWS)], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (3, 1, None), (3, None, 1), (None, 1, 1), (5, 1, 0), (5, 1, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def operators(labels):
    import public_tokenizers as P

    return {
        "quality": lambda d: quality.score(d, labels),
        "minhash": minhash.near_duplicates,
        "toxicity": lambda d: toxicity.score(d, labels),
        "suffix": suffix_dedup.digests,
        "packing": lambda d: packing.pack(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
        "mixing": mixing.mix,
        "counts": lambda d: token_counts.token_counts(d, P.path("word_bpe_49k.json")),
        "exact": exact_dedup.exact_groups,
    }


@pytest.mark.parametrize("name", ["quality", "minhash", "toxicity", "suffix", "packing", "mixing", "counts", "exact"])
def test_odd_and_empty_tables(odd, labels, name):
    run = operators(labels)[name]
    got = run(odd).collect()
    ids = sorted((r.doc_id for r in got if name != "packing" or r.start == 0), key=str)
    assert ids == sorted((i for i, _ in ROWS), key=str)
    assert run(odd.limit(0)).collect() == []
    if name in ("quality", "toxicity"):
        assert {r.score for r in operators(labels.limit(0))[name](odd).collect()} == {0.5}


def test_exact_values(odd):
    got = {(str(r.doc_id), r.text_sha256[:6]): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd).collect()}
    values = sorted(got.values(), key=str)
    assert (1, 3, True) in values and (1, 3, False) in values and (3, 3, True) in values and (5, 2, False) in values


def test_repeated_ids_are_separate_texts(odd):
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.digests(odd).collect()]
    assert sorted(x for x in got if x[0] == 3) == [(3, 12, 0), (3, 22, 0), (3, 22, 0)]
    removed = {i: r for i, _, r in got}
    assert (removed[5], removed[BIG], removed[6]) == (len(LONG) - 24, len(LONG), 50_000 - 1)


def test_near_groups_keep_one(odd):
    got = [(r.doc_id, r.group_id, r.kept) for r in minhash.near_duplicates(odd).collect()]
    assert sorted(k for i, g, k in got if g == 5) == [False, True]
    assert sum(k for i, g, k in got if g == 3 and i in (3, None)) >= 1


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_copies, minhash.drop_near_copies, mixing.mixed_order])
def test_stages_keep_columns(odd, drop):
    out = drop(odd)
    assert out.columns == odd.columns
    assert {r.doc_id for r in out.collect()} >= {1, 3, 5, 6}
    if drop is mixing.mixed_order:
        assert out.count() == len(ROWS)
    assert drop(odd.limit(0)).count() == 0


def test_empty_vectors_and_pages(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_join.near_vectors(none).count() == 0
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    one = spark.createDataFrame([(None, [1.0]), (BIG, [1.0]), (BIG + 1, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embed_join.near_vectors(one).collect()), key=str) == sorted([(None, 1, BIG, False), (BIG, 1, BIG, True), (BIG + 1, 0, BIG + 1, True)], key=str)


def test_pipeline_stage_by_stage(spark, data_dir):
    """What each stage keeps is what the operator says of its own input."""
    docs = table(spark, data_dir, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    verdict = {r.doc_id: r.predicted for r in toxicity.score(docs, table(spark, data_dir, "labels")).collect()}
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, data_dir).cache()
    assert {r.doc_id for r in clean.collect()} == {i for i in rows if not verdict[i]}
    once = stages["exact_dedup"](spark, clean, data_dir).cache()
    assert {r.doc_id for r in once.collect()} == {r.doc_id for r in exact_dedup.exact_groups(clean).collect() if r.kept}
    near = stages["near_dedup"](spark, once, data_dir).cache()
    assert {r.doc_id for r in near.collect()} == {r.doc_id for r in minhash.near_duplicates(once).collect() if r.kept}
    mixed = stages["mixing"](spark, near, data_dir)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} == {tuple(r) for r in near.collect()}
    packed = stages["packing"](spark, mixed, data_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in near.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, data_dir).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "start", "length", "ids_crc32").collect()))


@pytest.mark.parametrize("rows", [len(ROWS), 0])
def test_pipeline_on_odd_and_empty_tables(spark, odd, labels, tmp_path, rows):
    """Nulls, repeats, long texts and clashing columns from end to end: each text that stays is packed whole, once."""
    odd.limit(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels.where("toxic is not null and doc_id = 99").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if not rows:
        assert got == []
        return
    ends = {}
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.doc_tokens, r.start)):
        key = r.doc_id, r.doc_tokens
        assert r.start == ends.get(key, 0) % r.doc_tokens
        ends[key] = ends.get(key, 0) + r.length
    assert all(n % tokens == 0 for (_, tokens), n in ends.items())
    assert {1, 3, 5, 6} <= {r.doc_id for r in got} and BIG not in {r.doc_id for r in got}


def test_drop_toxic_keeps_columns(spark, odd, labels):
    kept = toxicity.drop_toxic(odd, labels)
    bad = {(r.doc_id, r.predicted) for r in toxicity.score(odd, labels).collect()}
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {i for i, p in bad if not p}
    assert toxicity.drop_toxic(odd.limit(0), labels).collect() == []


def test_vectors_and_pages_with_other_columns(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "?", "?", "?"), (2, [1.0, 0.0], "?", "?", "?")], "vec_id long, embedding array<float>, rid string, links string, digest string")
    assert sorted(map(tuple, embed_join.near_vectors(v).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
    p = spark.createDataFrame([(1, "u", "h" * 2_000, "?", "?"), (2, "u", "h" * 2_000, "?", "?")], "page_id long, url string, html string, payload string, record_type string")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark, p).collect()) == [(1, "revisit", 2), (2, "response", None)]


def test_packed_sequences_keep_the_mixture(spark):
    """By sequence_id the sources come in the mixed order's shares, not in the table's."""
    counts = {"a": 6_000, "b": 3_000, "c": 1_000}
    source = [s for s, n in counts.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, f"text {i}", s) for i, s in enumerate(source)], "doc_id long, text string, source string")
    mixed = written(corpus_pipeline.mix_sources(spark, docs, ""), "mixed")
    want = [r.doc_id for r in mixing.mix(docs).orderBy("slot", "in_block").collect()]
    total = sum(n**0.5 for n in counts.values())
    # Read from files, and straight from the plan.
    for given in (mixed, mixing.mixed_order(docs)):
        packed = corpus_pipeline.pack_sequences(spark, given, "").orderBy("sequence_id", "offset").collect()
        got = [r.doc_id for r in packed]
        assert sorted(got) == list(range(10_000))
        for end in (4_096, 8_192):
            assert set(got[:end]) == set(want[:end])
        for s, n in counts.items():
            assert abs(sum(source[i] == s for i in got[:4_096]) / 4_096 - n**0.5 / total) < 0.02


def test_extra_columns_do_not_reach_scores(spark, data_dir):
    docs = table(spark, data_dir, "documents").limit(20)
    labels = table(spark, data_dir, "labels")
    other = docs.withColumn("source", F.lit("zzz")).withColumn("lang", F.lit(None).cast("string"))
    for run in (quality.score, toxicity.score):
        assert sorted(run(docs, labels).select("score").collect()) == sorted(run(other, labels).select("score").collect())
