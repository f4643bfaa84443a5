"""Segmentation against a plain Python fold written here, and its invariants."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import chunking


def split_sentences(text):
    out, at = [], 0
    for m in re.finditer(r"[。！？]+|[.!?](?=\s|$)|\n+", text):
        out.append(text[at : m.end()].strip())
        at = m.end()
    return [s for s in [*out, text[at:].strip()] if s]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab。！.?! \n 　，,", max_size=60), min_size=1, max_size=40))
def test_sentences(spark, values):
    assert column(spark, values, X.sentences) == [split_sentences(v) for v in values]


@pytest.mark.parametrize(("text", "expected"), [("", False), ("abc", False), ("檢索", True), ("abcdefg檢索", False), ("abcd檢索", True)])
def test_cjk_share(spark, text, expected):
    assert column(spark, [text], X.is_mostly_cjk) == [expected]


def test_chunks_stay_within_target_and_overlap(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(200))
    chunks = column(spark, [text], chunking.chunk_text)[0]
    assert len(chunks) > 1 and all(len(c) <= 800 for c in chunks)
    for a, b in zip(chunks, chunks[1:]):
        assert b.startswith(split_sentences(a)[-1])


def test_no_overlap_rebuilds_the_text(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(200))
    chunks = column(spark, [text], lambda c: chunking.chunk_text(c, overlap=0))[0]
    assert " ".join(chunks) == text


def test_long_sentences_are_cut(spark):
    chunks = column(spark, ["漢" * 1000, "x" * 1700, "a," * 900], chunking.chunk_text)
    assert [max(map(len, c)) for c in chunks] == [400, 800, 799]
    assert "".join(chunks[1]) == "x" * 1700


def test_sections_pack_within_a_kind_only(spark):
    rows = [([("page 1 paragraph 1", "One."), ("page 1 paragraph 2", "Two."), ("page 1 table 1", "Three."), ("footnotes", "Four.")],)]
    df = spark.createDataFrame(rows, "s array<struct<location:string,text:string>>")
    got = [tuple(x) for x in df.select(chunking.chunk_array(F.col("s"))).head()[0]]
    assert got == [("page 1 paragraph 1 – page 1 paragraph 2", "One. Two."), ("page 1 table 1", "Three."), ("footnotes", "Four.")]


def test_nulls_and_blanks(spark):
    assert column(spark, [None, "", " \n "], chunking.chunk_text) == [[], [], []]


def test_tokens(spark):
    assert column(spark, ["The Retrieval-Augmented v1.2 a 檢索增強"], X.search_tokens)[0] == ["retrieval-augmented", "v1.2", "檢索增強", "檢索", "索增", "增強", "檢索增", "索增強"]


def test_json_payload(spark):
    raw = ['```json\n[1]\n```', 'x {"a": [1]} y', "none", "[1, 2", "```\n{}\n```"]
    assert column(spark, raw, X.extract_json) == ["[1]", '{"a": [1]}', "none", "[1, 2", "{}"]


def test_control_characters_end_no_sentence(spark):
    df = spark.createDataFrame([("one\x01two. three",), ("a。！b",), ("x.\n\ny",)], "t string")
    assert [r[0] for r in df.select(X.sentences(F.col("t"))).collect()] == [["one\x01two.", "three"], ["a。！", "b"], ["x.", "y"]]
