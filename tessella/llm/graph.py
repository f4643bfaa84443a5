"""Connected components of a graph of links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_enough, with_python, written

#: Links that one task may hold (16 bytes each); a larger graph goes through the distributed steps.
TASK_LINKS = 1_000_000


def tree(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links connect it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [frame[["u", "v"]].to_numpy(np.int64) for frame in frames]
        if parts:
            names, index = np.unique(np.concatenate(parts), return_inverse=True)
            index = index.reshape(-1, 2)
            yield pd.DataFrame({"node": names, "root": names[tree(len(names), index[:, 0], index[:, 1])]})

    with_python(edges.sparkSession)
    return edges.coalesce(1).mapInPandas(run, "node long, root long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).head())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (u, v: long): root is the smallest node it is linked to, itself included.

    Each step replaces links by links to the smallest neighbour; minima are aggregated before the shuffle, and the
    minima's side of the join is broadcast only when it is counted small. Steps go on until nothing changes, a number
    of rounds logarithmic in the size of a component. A graph of at most TASK_LINKS links takes one bounded task.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(edges)
    if state[0] <= TASK_LINKS:
        return _in_one_task(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = small_enough(written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least"), 24)
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = small_enough(written(large.groupBy("u").agg(F.min("v").alias("m")), "least"), 24)
        star = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(star.where("u <> v").distinct(), "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
