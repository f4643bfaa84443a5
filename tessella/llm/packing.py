"""Packing documents into training sequences by first-fit decreasing.

A document's token ids and its end id are cut at every `limit` ids. Full pieces are sequences of their own; the last,
shorter pieces go to randomised groups by a hash, and each group packs its pieces independently by first-fit
decreasing: a tournament tree over the bins' free capacities finds the leftmost bin with room in O(log bins). Only
piece rows (no text, no ids) are grouped, and a group has about `group_pieces` of them however large the corpus is.

Documents in an order that matters (a mixture) are packed in that order: a group is then a stretch of `group_pieces`
consecutive pieces, sequences are numbered by stretch, and within a stretch they come in a random order.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, small_enough, with_python, written

LIMIT = 2_048
END_ID = 1


@functools.cache
def byte_bpe(ranks_path: str, pattern: str, special: str = "<|endoftext|>", special_id: int = 50_256) -> Callable[[str], np.ndarray]:
    """Text to ids for a byte-level BPE given as ranks; the special string in a text becomes its id, as in the .json file of the same vocabulary."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens={special: special_id})
    return lambda text: coder.encode_to_numpy(text, allowed_special="all")


class Tournament:
    """Bins 0..n-1 of equal capacity; place() takes the leftmost with room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bin_no = node - self.leaves
        free[node] -= size
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
        return bin_no


def first_fit_decreasing(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset in it for pieces that come in descending order of size."""
    bins, at, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), [0] * max(1, len(sizes))
    tree = Tournament(max(1, len(sizes)), limit)
    for i, size in enumerate(sizes.tolist()):
        b = bins[i] = tree.place(size)
        at[i] = used[b]
        used[b] += size
    return bins, at


#: Ids go through Python as text: pandas would turn a column with nulls into floats.
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, ranks_path: str, pattern: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", place_col: str | None = None) -> DataFrame:
    """Each document's pieces, in one pass over the texts: doc_id, start, length, ids_crc32, doc_tokens (and place)."""
    with_python(docs.sparkSession)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = byte_bpe(ranks_path, pattern), np.array([END_ID], dtype=np.uint32).tobytes()
        for frame in frames:
            rows = []
            for doc, text, *place in zip(frame["doc_id"], frame["text"], *([frame["place"]] if place_col else []), strict=True):
                raw = encode(text).astype("<u4", copy=False).tobytes() + end
                n = len(raw) // 4
                rows += [(doc, s, min(limit, n - s), zlib.crc32(raw[4 * s : 4 * (s + limit)]), n, *place) for s in range(0, n, limit)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["place"] * bool(place_col)])

    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.col(place_col).alias("place")] if place_col else []))
    return texts.mapInPandas(cut, PIECES + ", place long" * bool(place_col)).withColumn("doc_id", F.col("doc_id").cast("long"))


def _placed(docs: DataFrame, place: str) -> DataFrame:
    """docs with each row's place, from 0, in their physical order.

    Spark reads files in an order of its own, so the order of rows in files is that of the files' numbers and of the
    rows within them. Rows that are not read straight from files are written first, a file a partition.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if plan.nodeName() != "LogicalRelation":
        docs = written(docs, "ordered")
    path, row, name, base = fresh(docs, "_path", "_row", "_name", "_base")
    found = docs.select(*docs.columns, F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    # The last row's index, for a filter may have left out rows; places then have gaps.
    ends = [(r[0], r[1]) for r in found.groupBy(path).agg(F.max(row) + 1).collect()]
    start, starts = 0, []
    for file, n in sorted(ends, key=lambda e: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", e[0])]):
        starts.append((file, start))
        start += n
    side = docs.sparkSession.createDataFrame(starts, f"{name} string, {base} long")
    return found.join(small_enough(side, 300), F.col(path) == F.col(name)).withColumn(place, F.col(base) + F.col(row)).drop(path, row, name, base)


def _numbered(cut: DataFrame, number: str) -> DataFrame:
    """Pieces with their number, from 0, by (place, start), found without gathering them: by counts of buckets of places."""
    bucket, far = F.floor(F.col("place") / 1_024), F.floor(F.col("bucket") / 1_024)
    cut = cut.withColumn("bucket", bucket)
    sizes = written(cut.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("far", far), "sizes")
    start, starts = 0, []
    for r in sorted(sizes.groupBy("far").agg(F.sum("n").alias("n")).collect()):
        starts.append((r["far"], start))
        start += r["n"]
    starts = cut.sparkSession.createDataFrame(starts, "far long, start long")
    before = sizes.join(small_enough(starts, 16), "far").select("bucket", (F.col("start") + F.sum("n").over(Window.partitionBy("far").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("place", "start")) - 1
    return cut.withColumn("inside", inside).join(small_enough(written(before, "before"), 16), "bucket").withColumn(number, F.col("before") + F.col("inside")).drop("bucket", "inside", "before", "place")


def pack(docs: DataFrame, ranks_path: str, pattern: str, *, limit: int = LIMIT, group_pieces: int = 4_096, seed: int = 5, ordered: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty: its document is the end id alone. Null and repeated ids are documents like any
    other, equal ones too. A text of any length is encoded whole and cut by ids. A sequence's pieces fill it gaplessly
    from 0 and never exceed the limit. An empty table gives no rows; other columns are not read, whatever they are
    called. ordered: the physical order of
    docs is kept, to within a stretch of group_pieces pieces, by the order of sequence_id.
    """
    if ordered:
        (place,) = fresh(docs, "_place")
        cut = written(pieces(_placed(docs, place), ranks_path, pattern, limit, id_col, text_col, place), "pieces")
        dealt = _numbered(cut, "number").withColumn("pack_group", F.floor(F.col("number") / group_pieces))
    else:
        cut = written(pieces(docs, ranks_path, pattern, limit, id_col, text_col), "pieces")
        groups = max(1, -(-cut.count() // group_pieces))
        dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.lit(groups)))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        ties = ["number"] if ordered else ["doc_id", "start", "ids_crc32"]
        frame = frame.sort_values(["length", *ties], ascending=[False, *[True] * len(ties)], kind="stable").reset_index(drop=True)
        bins, at = first_fit_decreasing(frame["length"].to_numpy(), limit)
        if ordered:  # long pieces come first in the bins; a random order leaves no source ahead
            bins = np.random.default_rng((seed, int(frame["pack_group"].iloc[0]))).permutation(bins.max() + 1)[bins]
        return frame.assign(sequence_id=frame["pack_group"] * (1 << 32) + bins, offset=at).drop(columns=["pack_group", *["number"] * ordered])

    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    packed = dealt.groupBy("pack_group").applyInPandas(fit, f"{PIECES}, sequence_id long, offset long")
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))
