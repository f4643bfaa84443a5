"""A kept index of vectors: a coarse quantiser over every row, cells as partitions, probes set by measured recall.

The centres are fitted to a sample of at most about `SAMPLE` rows; every row then goes to its nearest centre's cell, and
rows that have no place there (null, of another length, with parts that aren't finite) to a cell that each search reads.
How many cells a search probes is measured when the index is built: the exact neighbours of `TRIALS` of its rows are
found by reading all cells, and the probes are the fewest whose cells hold the wanted share of them. Vectors without
structure so get many probes and lose little; clustered ones get few.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .matching import top

#: Rows that centres are fitted to (in expectation), rounds of fitting, the most cells, rows whose neighbours are measured.
SAMPLE, ROUNDS, MOST_CELLS, TRIALS = 65_536, 8, 4_096, 256
#: Queries that are held against the index at once, and rows compared with them at once.
QUERY_BLOCK, ROWS = 4_096, 1_024
#: The cell of rows that the quantiser can't place.
REST = -1


@dataclass(frozen=True)
class VectorIndex:
    """Rows (id, v, row, cell) under path/rows; probes cells are read for a query of k neighbours at the wanted recall."""

    path: str
    schema: StructType
    centres: np.ndarray
    probes: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def cells_of(self, queries: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The cells to probe for each query, those of the largest products with their centres."""
        n = min(len(self.centres), self.probes if probes is None else probes)
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")[:, :n]


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(vectors[i : i + ROWS] @ centres.T - half, axis=1) for i in range(0, len(vectors), ROWS)])


def fit(vectors: np.ndarray, cells: int, seed: int = 1) -> np.ndarray:
    """Centres by Lloyd's rounds from distinct rows; an emptied centre takes a random row."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(vectors, axis=0)
    centres = distinct[rng.choice(len(distinct), min(cells, len(distinct)), replace=False)].copy()
    for _ in range(ROUNDS):
        at = _nearest(vectors, centres)
        order = np.argsort(at, kind="stable")
        found, first = np.unique(at[order], return_index=True)
        sums, sizes = np.add.reduceat(vectors[order], first, axis=0), np.diff(np.append(first, len(at)))
        centres = distinct[rng.choice(len(distinct), len(centres))].copy()
        centres[found] = sums / sizes[:, None]
    return centres


def _placed(v: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows can be placed, their matrix)."""
    ok = np.array([x is not None and len(x) == width and bool(np.isfinite(np.asarray(x, float)).all()) for x in v], bool)
    return ok, np.array([*v[ok]], float).reshape(-1, width)


def build(vectors: DataFrame, path: str, *, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, k: int = 20, recall: float = 0.95, sample: int = SAMPLE) -> VectorIndex:
    """Index every row of vectors under path, a new folder in the shared store. cells: by default the root of the row count.

    Ties and repeated rows are rows like any other, copies share a cell, whose rows are dealt over tasks and files by
    range; other columns are kept in a struct, whatever their names. The vectors' length is that of most sampled rows.
    An empty table makes an index without cells, in which nothing is found.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.struct("*").alias("row"))
    count = named.count()
    some = named.where(F.pmod(F.xxhash64("id", "v"), F.lit(max(1, -(-count // sample)))) == 0) if count > sample else named
    k_cells = min(MOST_CELLS, max(1, round(count**0.5))) if cells is None else cells

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists = [x for frame in frames for x in frame["v"] if x is not None and len(x)]
        if lists:
            widths, often = np.unique([len(x) for x in lists], return_counts=True)
            _, matrix = _placed(pd.Series(lists), int(widths[np.argmax(often)]))
            if len(matrix):
                yield pd.DataFrame({"centre": list(fit(matrix, k_cells))})

    # One task holds the sample, which is bounded; so are the centres that the driver reads.
    fitted = some.select("v").repartition(1).mapInPandas(learn, "centre array<double>").collect()
    centres = np.array([r.centre for r in fitted], float)

    @F.pandas_udf("int")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            out = np.full(len(v), REST, np.int32)
            if len(centres):
                ok, matrix = _placed(v, centres.shape[1])
                if ok.any():
                    out[ok] = _nearest(matrix, centres)
            yield pd.Series(out)

    dealt = named.withColumn("cell", cell("v")).repartitionByRange("cell", F.xxhash64("id"))
    dealt.write.partitionBy("cell").parquet(f"{path}/rows")
    index = VectorIndex(path, StructType([*named.schema]).add("cell", IntegerType()), centres, len(centres))
    index = replace(index, probes=_probes(spark, index, count, k, recall))
    kept = [(json.dumps({"probes": index.probes, "centres": centres.tolist(), "schema": index.schema.json()}),)]
    spark.createDataFrame(kept, "value string").coalesce(1).write.text(f"{path}/quantiser")
    return index


def load(spark: SparkSession, path: str) -> VectorIndex:
    found = json.loads(spark.read.text(f"{path}/quantiser").head()[0])
    return VectorIndex(path, StructType.fromJson(json.loads(found["schema"])), np.array(found["centres"], float), found["probes"])


def _probes(spark: SparkSession, index: VectorIndex, count: int, k: int, recall: float) -> int:
    """The fewest cells, in the order of a query's products, that hold the wanted share of exact neighbours.

    The mean over the tried rows must exceed it by two standard errors.
    """
    cells = len(index.centres)
    if cells < 2:
        return cells
    rows = index.rows(spark).where(F.col("cell") != REST)
    # Distinct vectors: copies are each other's neighbours in one cell, which would flatter the quantiser.
    some = rows.where(F.pmod(F.xxhash64("v"), F.lit(max(1, count // (8 * TRIALS)))) == 0).dropDuplicates(["v"])
    tried = some.orderBy(F.xxhash64(F.lit("trial"), "v")).limit(TRIALS).select(F.col("id").alias("query_id"), F.col("v").alias("q")).collect()
    found = _block(spark, index, tried, k + 1, None, cells).where(F.col("cell") != REST)
    near = top(found, ["query_id"], [F.desc("score"), F.asc("id")], k + 1).where("query_id <> id").collect()  # TRIALS times k rows
    order = index.cells_of(np.array([r.q for r in tried]), cells)
    number, place = {r.query_id: i for i, r in enumerate(tried)}, np.argsort(order, axis=1)
    held = np.zeros((len(tried), cells))
    for r in near:
        held[number[r.query_id], place[number[r.query_id], r.cell]] += 1
    held = held[held.any(axis=1)]
    if not len(held):
        return cells
    share = held.cumsum(axis=1) / held.sum(axis=1, keepdims=True)
    sure = share.mean(axis=0) - 2 * share.std(axis=0) / np.sqrt(len(held)) >= recall
    return int(np.argmax(sure)) + 1


def _padded(lists, width: int) -> np.ndarray:
    """Rows cut or filled with zeros to a width: products then run over the shorter length."""
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : min(width, len(x))] = np.array(x[:width], float)
    return out


def search(spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int, *, where: Callable[[Column], Column] | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, id, rank, score): the k largest products among the rows in each query's probed cells.

    queries: (query_id long, q array<double>), a stated set, which comes in blocks of about QUERY_BLOCK; where: a condition
    on the struct of an indexed row, met before the k are chosen. Only folders of probed cells are read, each task keeps the k best
    of each query in fixed arrays, and only these are shuffled. Of equal scores (to six places) the smaller id is first.
    A query of another length than the centres' probes all cells. Null vectors, null queries and products that aren't
    finite find nothing. Queries of one id are variants of one question: a row's score is its best over them. A row id
    that the index holds more than once is found once, with its best score.
    """
    queries = queries.select("query_id", "q").where("q is not null").distinct()
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)) == b) if blocks > 1 else queries
        found = _block(spark, index, part.collect(), k, where, probes)
        out = found if out is None else out.unionByName(found)
    out = out.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top(out, ["query_id"], [F.desc("score"), F.asc("id")], k).withColumnRenamed("_rank", "rank").select("query_id", "id", "rank", "score")


def _block(spark: SparkSession, index: VectorIndex, asked: list, k: int, where, probes: int | None) -> DataFrame:
    names, width = np.array([r.query_id for r in asked], np.int64), max([1, *(len(r.q) for r in asked)])
    matrix, cells = _padded([r.q for r in asked], width), len(index.centres)
    probed = np.ones((cells + 1, len(asked)), bool)  # the last row is that of REST
    own = np.array([cells > 0 and len(r.q) == index.centres.shape[1] for r in asked], bool)
    if own.any():
        mine = np.flatnonzero(own)
        probed[:cells, mine] = False
        chosen = index.cells_of(matrix[mine, : index.centres.shape[1]], probes)
        probed[chosen.ravel(), np.repeat(mine, chosen.shape[1])] = True
    rows = index.rows(spark) if asked else index.rows(spark).where("false")
    if not probed.all(axis=1).all():
        read = [int(c) if c < cells else REST for c in np.flatnonzero(probed.any(axis=1))]
        rows = rows.where(F.col("cell").isin(read))
    if where is not None:
        rows = rows.where(where(F.col("row")))

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, score, ids, cell = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = np.full(len(names), -np.inf)
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                some = frame.iloc[at : at + ROWS]
                products = np.round(_padded(some["v"].tolist(), width) @ matrix.T, 6)
                products[~probed[some["cell"].to_numpy()] | ~np.isfinite(products)] = -np.inf
                if len(some) > k:
                    least = np.maximum(least, np.partition(products, len(some) - k, axis=0)[len(some) - k])
                r, q = np.nonzero((products >= least) & (products > -np.inf))
                new = q, products[r, q], some["id"].to_numpy()[r], some["cell"].to_numpy()[r]
                query, score, ids, cell = map(np.concatenate, zip((query, score, ids, cell), new, strict=True))
                order = np.lexsort((ids, -score, query))
                place = np.arange(len(query)) - np.searchsorted(query[order], query[order])
                full = order[place == k - 1]
                least[query[full]] = score[full]
                query, score, ids, cell = (x[order[place < k]] for x in (query, score, ids, cell))
        yield pd.DataFrame({"query_id": names[query], "id": ids, "cell": cell, "score": score})

    return rows.where("v is not null").select("id", "v", "cell").mapInPandas(best, "query_id long, id long, cell int, score double")
