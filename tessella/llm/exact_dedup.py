"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only.

The text is read once, into a table of (doc_id, SHA-256 of the normalised text). Pass one counts, for each bit of
a Bloom filter, how many rows set it, and keeps the bits set by two rows or more as bitmaps of 32,768 bits. Pass two
probes these: a row of which both bits were set twice is possibly repeated and goes on to the grouping by full
SHA-256; every other row is certainly unique and passes straight through.

A filter has 16 bits a row up to `MAX_FILTER_BITS` (32 MB), which bounds what is broadcast. More rows are cut by their
SHA-256 into parts of at most that many, written apart; each part has both passes and a filter of its own, one after
another, so the filter never fills up. What crosses the network in pass one is two numbers a row, those of one task
added up, and never the row; a task sets far fewer bits than a filter has, so numbers are less than its bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, without_rows, written

#: Bits of one bitmap that bitmap_construct_agg builds.
BITMAP_BITS = 32_768
BITS_PER_ROW = 16
MAX_FILTER_BITS = 1 << 28
HASHES = 2


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def fingerprint(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def filter_bits(rows: int) -> int:
    bits = BITMAP_BITS
    while bits < min(rows * BITS_PER_ROW, MAX_FILTER_BITS):
        bits *= 2
    return bits


def _positions(bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), F.col("text_sha256")), F.lit(bits)).cast("long") for i in range(HASHES)]


def repeated_bits(prints: DataFrame, bits: int) -> DataFrame:
    """Pass one: bitmaps (bucket, bitmap) of the filter bits that two or more rows set; at most bits / 32,768 rows."""
    pos = prints.select(F.explode(F.array(*_positions(bits))).alias("pos"))
    twice = pos.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return twice.groupBy(F.bitmap_bucket_number("pos").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bitmap"))


def _bit(bitmap: Column, pos: Column) -> Column:
    at = F.bitmap_bit_position(pos)
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))


def possibly_repeated(prints: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Pass two: prints with a boolean `maybe`; false only for rows whose text no other row has."""
    out, maybe = prints, F.lit(True)
    for i, pos in enumerate(_positions(bits)):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"bucket{i}"), F.col("bitmap").alias(f"bitmap{i}")))
        out = out.join(side, F.bitmap_bucket_number(pos) == F.col(f"bucket{i}"), "left")
        maybe = maybe & _bit(F.col(f"bitmap{i}"), pos)
    return out.select(*prints.columns, maybe.alias("maybe"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts equal each other. Of equal texts the smallest doc_id stays; null ids
    come last. A text that only rows without id have keeps all of these; rows that repeat id and text are one
    document in several copies and all carry the same values. Other columns of docs are not read.
    """
    prints = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("text_sha256"))
    parts = -(-docs.count() * BITS_PER_ROW // MAX_FILTER_BITS)
    if parts <= 1:
        return _grouped(written(prints, "prints"))
    spark = docs.sparkSession
    cut, out = new_path(spark, "prints"), new_path(spark, "groups")
    prints.withColumn("part", F.pmod(F.xxhash64("text_sha256"), F.lit(parts))).write.partitionBy("part").parquet(cut)
    for part in range(parts):
        mine = spark.read.schema(prints.schema.add("part", "long")).parquet(cut).where(F.col("part") == part).drop("part")
        _grouped(mine).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def _grouped(prints: DataFrame) -> DataFrame:
    bits = filter_bits(prints.count())
    bitmaps = written(repeated_bits(prints, bits), "bloom")
    probed = possibly_repeated(prints, bitmaps, bits)
    maybe = probed.where("maybe").drop("maybe")
    groups = written(maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")
    one = [F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce("keep_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256"]
    repeated = maybe.join(groups, "text_sha256", "left").select("doc_id", *one)
    alone = probed.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(repeated)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, in all its columns, without the rows that exact_groups does not keep."""
    dropped = exact_groups(docs, id_col, text_col).where("not kept").select("doc_id", "text_sha256")
    return without_rows(docs, written(dropped, "copies"), {"doc_id": docs[id_col], "text_sha256": fingerprint(docs[text_col])})


ORACLE = """
WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)
"""
