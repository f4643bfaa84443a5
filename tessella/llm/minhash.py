"""Near-duplicate documents by DartMinHash signatures of weighted word shingles, banding and exact verification.

A text is the multiset of its runs of five words; the similarity of two texts is their weighted Jaccard index. For a
shingle of weight w, darts fall on [0, w) x [0, infinity) as a Poisson process that the shingle's hash seeds: the gaps
between ranks in each unit of weight are exponential variates. A dart belongs to a coordinate by its hash, and each
coordinate keeps the dart of the earliest rank over all shingles. About k ln k + 2k darts are thrown for a text,
however long it is, and two texts agree in a coordinate with the probability of their similarity.

Texts with the same words are one class and only its first member goes on. Coordinates are joined in bands: a bucket
holds the classes that agree in all of a band. No bucket's pairs are all made. First each member is held against one
leader of its bucket, the member that shares most buckets with others; verified links make components. Members of
buckets that still hold several components then meet by their rarest shingles: texts of a and b shingles that are
similar enough have at least t / (1 + t) * (a + b) in common, so one of these is among the first shingles of each, in
one order of all shingles, up to the place where fewer than that are left. Ordered by how many texts hold them, common
passages come last, so texts that only share these never meet; nor do two copies of one base, unless they share
changes. Where holders of one shingle are in several components, those outside its largest one are held against the
others. All candidates are verified on the whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_enough, with_python, without_rows, written
from .graph import connected_components
from .textvec import blocks, mix, words

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
COORDINATES = BANDS * ROWS
#: Sizes of one class differ by less than this factor; partners are taken class by class.
SIZE_STEP = 1.05

_U = np.uint64
_STEP, _COPY, _PLACE, _NAME = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)


def shingles(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of WORDS words; texts with fewer have none."""
    n = max(0, len(hashes) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for i in range(WORDS):
        out = mix(out * _STEP + hashes[i : i + n])
    inside = owner[:n] == owner[WORDS - 1 : WORDS - 1 + n]
    return out[inside], owner[:n][inside]


def cells(items: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One cell for each unit of weight: the hash of (item, how many equal ones came before in its text)."""
    order = np.lexsort((items, owner))
    items, owner = items[order], owner[order]
    new = np.ones(len(items), bool)
    new[1:] = (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(items)), 0))
    return mix(items + (np.arange(len(items)) - first).astype(np.uint64) * _COPY), owner


def dart_minhash(cell: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) names of the earliest darts; rows without cells are zero."""
    weight = np.bincount(owner, minlength=n)
    best, name = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    bound = (k * math.log(k) + 2 * k) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        use = todo[owner]
        c, o = cell[use], owner[use]
        rank, i = np.zeros(len(c)), 0
        while len(c):
            draw = mix(c + _U(i * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            on = rank < bound[o]
            c, o, rank, draw = c[on], o[on], rank[on], draw[on]
            slot = o * k + (mix(draw ^ _PLACE) % _U(k)).astype(np.int64)
            np.minimum.at(best, slot, rank)
            won = rank == best[slot]
            name[slot[won]] = mix(draw ^ _NAME)[won]
            i += 1
        todo &= np.isinf(best.reshape(n, k)).any(axis=1)
        bound[todo] *= 2
    return name.reshape(n, k)


def describe(texts: list[str]) -> list[tuple[bytes | None, int, np.ndarray | None]]:
    """For each text: 16 bytes that name its sequence of words, its number of shingles, its signature of 32-bit values."""
    out: list[tuple[bytes | None, int, np.ndarray | None]] = []
    for _, group in blocks(texts):
        hashes, owner = words(group)
        n = len(group)
        count = np.bincount(owner, minlength=n)
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(count) - count, count)
        seq = np.zeros((n, 2), np.uint64)
        for i, salt in enumerate((_PLACE, _NAME)):
            np.add.at(seq[:, i], owner, mix(hashes ^ mix(place.astype(np.uint64) * _STEP + salt)))
        item, of = shingles(hashes, owner)
        size = np.bincount(of, minlength=n)
        signature = (dart_minhash(*cells(item, of), n, COORDINATES) >> _U(32)).astype(np.uint32).view(np.int32)
        out += [(seq[i].tobytes() if count[i] else None, int(size[i]), signature[i] if size[i] else None) for i in range(n)]
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard index of two multisets of hashes."""
    (x, m), (y, n) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = np.minimum(m[i], n[j]).sum()
    return common / max(1, len(a) + len(b) - common)


def _described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = describe(frame["text"].tolist())
            yield frame[["doc_id", "text_hash"]].assign(seq=[x[0] for x in found], size=[x[1] for x in found], signature=[x[2] for x in found])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    made = rows.mapInPandas(run, "doc_id string, text_hash long, seq binary, size long, signature array<int>")
    made = made.withColumn("doc_id", F.col("doc_id").cast("long"))  # text till here: pandas makes floats of ids with nulls
    return written(made.withColumn("rid", F.monotonically_increasing_id()), "darts")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose whole texts are as similar as asked."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = np.zeros(len(frame), bool)
            both = [t for pair in zip(frame["ut"], frame["vt"], strict=True) for t in pair]
            for i in range(0, len(both), 64):
                item, of = shingles(*words(both[i : i + 64]))
                cut = np.searchsorted(of, np.arange(min(64, len(both) - i) + 1))
                for j in range(0, len(cut) - 1, 2):
                    keep[(i + j) // 2] = similarity(item[cut[j] : cut[j + 1]], item[cut[j + 1] : cut[j + 2]]) >= threshold
            yield frame.loc[keep, ["u", "v"]]

    side = lambda c: texts.select(F.col("rid").alias(c), F.col("text").alias(f"{c}t"))
    found = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "ut", "vt")
    return written(found.mapInPandas(run, "u long, v long"), "verified")


def _cells(texts: DataFrame) -> DataFrame:
    """(rid, cell): a row for each unit of weight of each text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rid = frame["rid"].to_numpy()
            for first, group in blocks(frame["text"].tolist()):
                cell, owner = cells(*shingles(*words(group)))
                yield pd.DataFrame({"rid": rid[first + owner], "cell": cell.view(np.int64)})

    return written(texts.select("rid", "text").mapInPandas(run, "rid long, cell long"), "cells")


def _meeting(apart: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) of apart (rid, size, part) in different parts that may be as similar as asked."""
    cell = _cells(texts.join(apart, "rid", "left_semi"))
    often = cell.groupBy("cell").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    of = Window.partitionBy("rid")
    place = F.col("size") - F.count(F.lit(1)).over(of) + F.row_number().over(of.orderBy("times", "cell"))
    common = F.lit(threshold / (1 + threshold))
    # Of no partner is more than the rest after this place needed: one of threshold times the size.
    last = F.col("size") - F.ceil(common * F.col("size") * (1 + threshold) - 1e-6) + 1
    rare = cell.join(often, "cell").join(apart, "rid").withColumn("place", place).where(F.col("place") <= last)
    rare = written(rare.select("rid", "size", "part", "cell", "place"), "rare")

    level = F.floor(F.log("size") / math.log(SIZE_STEP)).cast("int")
    reach = math.ceil(-math.log(threshold) / math.log(SIZE_STEP)) + 1
    least = F.greatest(F.pow(F.lit(SIZE_STEP), F.col("to")) * (1 - 1e-9), F.col("size") * threshold)
    fits = F.col("place") <= F.col("size") - F.ceil(common * (F.col("size") + least) - 1e-6) + 1
    meets = rare.withColumn("level", level).withColumn("to", F.explode(F.sequence(F.col("level") - reach, F.col("level") + reach))).where(fits)
    key = ["cell", F.least("level", "to").alias("low"), F.greatest("level", "to").alias("high")]
    meets = meets.select(*key, "level", "to", "rid", "size", "part")
    parts = meets.groupBy("cell", "low", "high", "part").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("cell", "low", "high").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    meets = written(meets.join(main, ["cell", "low", "high"]), "meets")
    left = meets.where("part <> main")
    right = meets.select("cell", F.col("to").alias("level"), F.col("level").alias("to"), F.col("rid").alias("lead"), F.col("size").alias("lead_size"), F.col("part").alias("lead_part"))
    differ = (F.col("part") != F.col("lead_part")) & ((F.col("lead_part") == F.col("main")) | (F.col("rid") < F.col("lead")))
    met = left.join(right, ["cell", "level", "to"]).where(differ & (F.least("size", "lead_size") >= F.greatest("size", "lead_size") * threshold))
    return met.select(F.least("rid", "lead").alias("u"), F.greatest("rid", "lead").alias("v")).distinct()


def near_groups(docs: DataFrame, *, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: rid, doc_id, text_hash, group_id, kept, n_texts.

    group_id is the smallest doc_id of the documents that links of at least the threshold connect, n_texts the number
    of different word sequences among them, and exactly one row of a group is kept: the one of the smallest doc_id
    (null ids last; of repeated ids any one). Null texts count as empty; texts without words link with nothing, and
    texts of fewer than five words only with texts of the same words. Texts of any length are compared whole. Ties (a
    group of several keepers) can't occur. An empty table gives no rows; other columns are not read, whatever their names.
    """
    with_python(docs.sparkSession)
    rows = _described(docs, id_col, text_col)
    first = F.min(F.struct("rid", "size", "signature"))
    classes = rows.where("seq is not null").groupBy("seq").agg(first.alias("f"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.select("seq", "n", "f.*"), "classes")
    signatures = classes.where("signature is not null").select("rid", "size", "signature")
    band = lambda b: F.xxhash64(b, F.slice("signature", b * ROWS + 1, ROWS))
    entries = signatures.select("rid", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("h"))
    shared = entries.groupBy("h").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    entries = written(entries.join(shared, "h"), "buckets")
    ranked = entries.join(entries.groupBy("rid").agg(F.sum("members").alias("weight")), "rid")
    leader = ranked.groupBy("h").agg(F.max_by(F.struct("rid", "size"), F.struct("weight", F.xxhash64("rid"))).alias("l"))
    leader = leader.select("h", F.col("l.rid").alias("lead"), F.col("l.size").alias("lead_size"))
    fits = lambda a, b: F.least(a, b) >= F.greatest(a, b) * threshold
    stars = entries.join(leader, "h").where((F.col("rid") != F.col("lead")) & fits(F.col("size"), F.col("lead_size")))
    pairs = written(stars.select(F.least("rid", "lead").alias("u"), F.greatest("rid", "lead").alias("v")).distinct(), "pairs")

    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    wanted = rows.select("rid", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).join(entries.select("rid").distinct(), "rid", "left_semi")
    wanted = small_enough(written(wanted, "wanted"), 40)
    texts = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h"))).select("rid", "text")
    texts = written(texts, "texts")

    links = _verified(pairs, texts, threshold)
    roots = written(connected_components(links), "roots").withColumnRenamed("node", "rid")
    part = F.coalesce("root", "rid")
    members = entries.join(roots, "rid", "left").select("h", "rid", "size", part.alias("part"))
    mixed = members.groupBy("h").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("h")
    apart = members.join(mixed, "h", "left_semi").select("rid", "size", "part").distinct()
    more = written(_meeting(written(apart, "apart"), texts, threshold).join(pairs, ["u", "v"], "left_anti"), "pairs")
    links = links.unionByName(_verified(more, texts, threshold))
    roots = written(connected_components(links), "roots").withColumnRenamed("node", "rid")

    several = roots.groupBy("root").agg(F.count(F.lit(1)).alias("several"))
    linked = roots.join(several, "root")
    group = classes.select("seq", "rid", "n").join(linked, "rid", "left").where("n > 1 or root is not null")
    side = group.select("seq", part.alias("part"), F.coalesce("several", F.lit(1).cast("long")).alias("n_texts"))
    placed = rows.join(small_enough(written(side, "groups"), 48), "seq", "left").select("rid", "doc_id", "text_hash", "part", F.coalesce("n_texts", F.lit(1).cast("long")).alias("n_texts"))
    placed = written(placed, "placed")
    keeper = placed.where("part is not null").groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rid")).alias("k"))
    keeper = written(keeper.select("part", F.col("k.doc_id").alias("group_id"), F.col("k.rid").alias("keep")), "keepers")
    out = placed.join(small_enough(keeper, 32), "part", "left")
    alone = F.col("part").isNull()
    return out.select("rid", "doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), (alone | (F.col("rid") == F.col("keep"))).alias("kept"), "n_texts")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, group_id, kept, n_texts, as near_groups says."""
    return near_groups(docs, **options).drop("rid", "text_hash")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, in all its columns, with one document of each group.

    Rows that repeat an id and a text of a kept row stay with it: exact copies are the exact deduplication's task.
    """
    found = written(near_groups(docs, id_col=id_col, text_col=text_col, **options), "near")
    key = {"doc_id": docs[id_col].cast("long"), "text_hash": F.xxhash64(F.coalesce(docs[text_col], F.lit("")))}
    kept = found.where("kept").select("doc_id", "text_hash")
    dropped = found.where("not kept").select("doc_id", "text_hash").join(kept.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left_anti")
    return without_rows(docs, written(dropped, "copies"), key)
