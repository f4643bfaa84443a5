"""Dot products of many queries with all rows of a table, tile by tile: Spark deals out pairs of tiles, NumPy multiplies them.

A product is summed from the first component to the last in double precision, as a fold over the two arrays does it, so
the scores are the fold's to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a tile at most, queries that meet it in one task, and products that a task holds at a time.
ROWS, QUERIES, HELD = 8_192, 4_096, 1 << 17
#: Half of a rounded score's last place, and something for good measure.
MARGIN = 2e-6

#: From (queries, ids, products of some queries with the tile in a row each) to picked (query, row, product).
Pick = Callable[[pa.Table, pa.Table], pa.Table]


class Tiled(NamedTuple):
    """rows (columns of queries, id, score not rounded); the length of vectors in tiles; how many rows and queries no tile takes."""

    rows: DataFrame
    length: int
    odd_rows: int
    odd_queries: int


def regular(v: Column, length: int) -> Column:
    """Whether an array has so many components, none of them null, not a number or very large."""
    return F.coalesce((F.size(v) == length) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < 1e100)), F.lit(False))


def tiled(index: DataFrame, queries: DataFrame, pick: Pick, keep: list[str], id_col: str = "vec_id", vector_col: str = "embedding") -> Tiled:
    """What pick finds in each pair of a tile of rows and a block of queries (q, keep)."""
    rows = index.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    length = max(common["n"] or 0, 0) if common else 0
    asked = queries.select(*keep, "q")
    n_rows, odd_rows = _counted(rows, regular(F.col("v"), length))
    n_queries, odd_queries = _counted(asked, regular(F.col("q"), length))
    cores = index.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, -(-n_rows // ROWS), min(cores, n_rows // 256))
    blocks = max(1, -(-n_queries // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = (F.col("tile") * blocks + F.col("block")).alias("part")
    left = asked.where(regular(F.col("q"), length)).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).select("*", every(tiles).alias("tile"))
    right = rows.where(regular(F.col("v"), length)).withColumn("tile", F.pmod(F.xxhash64("id", "v"), F.lit(tiles)).cast("int")).select("*", every(blocks).alias("block"))
    sides = [d.select(*columns, place).repartition(tiles * blocks, "part").groupBy("part") for d, columns in ((left, [*keep, "q"]), (right, ["id", "v"]))]
    shape = ", ".join(f"`{c}` {t}" for c, t in [(c, queries.schema[c].dataType.simpleString()) for c in keep] + [("id", rows.schema["id"].dataType.simpleString()), ("score", "double")])

    def run(qs: pa.Table, vs: pa.Table) -> pa.Table:
        if not qs.num_rows or not vs.num_rows:
            found = qs.slice(0, 0).select(keep).append_column("id", vs.slice(0, 0)["id"])
            return found.append_column("score", pa.array([], pa.float64()))
        return pick(qs, vs)

    return Tiled(sides[0].cogroup(sides[1]).applyInArrow(run, shape), length, odd_rows, odd_queries)


def _counted(d: DataFrame, ok: Column) -> tuple[int, int]:
    """Rows that are ok, and others."""
    found = d.agg(F.count_if(ok), F.count_if(~ok)).head()
    return found[0], found[1]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
    return flat.reshape(len(column), -1)


def products(q: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, products of it and those behind it with all rows), a few queries at a time."""
    across = np.ascontiguousarray(v.T)
    step = max(1, HELD // max(1, len(v)))
    for at in range(0, len(q), step):
        some = q[at : at + step]
        total, part = np.zeros((len(some), len(v))), np.empty((len(some), len(v)))
        for d in range(v.shape[1]):
            np.multiply(some[:, d, None], across[d], out=part)
            total += part
        yield at, total


def _picked(qs: pa.Table, vs: pa.Table, keep: list[str], found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    q, v, score = (np.concatenate(x) for x in zip(*found, strict=True))
    out = qs.select(keep).take(pa.array(q))
    return out.append_column("id", vs["id"].take(pa.array(v))).append_column("score", pa.array(score))


def nearest(k: int) -> Pick:
    """Of each query the rows that may be among its first k by rounded score and id: those near the k-th product."""

    def pick(qs: pa.Table, vs: pa.Table) -> pa.Table:
        vs = vs.sort_by("id")
        v, found = _matrix(vs["v"]), []
        for at, total in products(_matrix(qs["q"]), v):
            least = np.partition(total, len(v) - k, axis=1)[:, len(v) - k] - MARGIN if len(v) > k else np.full(len(total), -np.inf)
            for i, (row, limit) in enumerate(zip(total, least, strict=True)):
                near = np.flatnonzero(row >= limit)
                if len(near) > 4 * k:
                    # Of rows with the very same product only the first k by id can count.
                    order = near[np.argsort(-row[near], kind="stable")]
                    begins = np.flatnonzero(np.concatenate(([True], row[order[1:]] != row[order[:-1]])))
                    near = order[np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order)))) < k]
                found.append((np.full(len(near), at + i), near, row[near]))
        return _picked(qs, vs, ["query_id"], found)

    return pick


def best(by: str) -> Pick:
    """Of each row its largest product with the queries of each value of a column."""

    def pick(qs: pa.Table, vs: pa.Table) -> pa.Table:
        v, q, found = _matrix(vs["v"]), _matrix(qs["q"]), []
        groups = qs[by].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        for group in np.unique(groups):
            members = np.flatnonzero(groups == group)
            most = np.full(len(v), -np.inf)
            for _, total in products(q[members], v):
                np.maximum(most, total.max(axis=0), out=most)
            found.append((np.full(len(v), members[0]), np.arange(len(v)), most))
        return _picked(qs, vs, [by], found)

    return pick
