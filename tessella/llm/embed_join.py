"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors a cosine of at least t is a squared distance of at most 2 - 2t. Vectors are rotated onto the principal
axes of a bounded sample and cut into `BLOCKS` blocks; each block gets a part of the squared distance in proportion to
its share of the variance, so a pair within the whole distance is within the budget of one block at least. The leading
coordinate cuts the vectors into tiles of at most about `TILE`, and a vector meets the tiles that the whole distance
reaches, each pair of tiles once. Inside a pair of tiles each block is joined by itself, unless the tiles lie further
apart in it than its budget. A pair found in a block counts in the first block that admits it, and is verified there in
double precision on the vectors as given.

What leaves a pair of tiles is bounded by their vectors, not their pairs: each vector's number of links, and a tree of
links for the components. Vectors with the same bytes are one class and meet others once.

Vectors of one leading coordinate, however many, are spread over several tiles by a hash.

On vectors without structure the tiles' leading coordinates rule out little; a vector is then shuffled once for each
tile. Tiles are as large as a task may hold, and vectors go as they were given, without their rotated coordinates. The
filter inside a pair of tiles still leaves few pairs to verify.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_enough, with_python, written
from .graph import connected_components, tree
from .textvec import mix

SIMILARITY, BLOCKS = 0.9, 4
#: Vectors of up to 64 dimensions in a tile, of longer ones fewer in proportion; a small table is cut further, for all cores, into tiles of at least LEAST_TILE.
TILE, LEAST_TILE = 65_536, 4_096
#: Vectors of a tile that are multiplied at once.
ROWS, COLUMNS = 256, 16_384
#: Vectors of the sample that the rotation and the budgets come from.
SAMPLE = 4_096
#: Copies of vectors that leave the dealing step at once.
DEAL_ROWS = 10_000
#: More than single precision can be off in a squared distance of rotated unit vectors.
SLACK = 1e-5


def rotation(sample: np.ndarray, blocks: int, budget: float) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Principal axes (as columns) and each block's (from, to, budget)."""
    dim = sample.shape[1]
    values, axes = np.linalg.eigh(sample.T @ sample / len(sample))
    values, axes = np.maximum(values[::-1], 1e-12), axes[:, ::-1]
    cuts = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
    share = [values[a:z].sum() / values.sum() for a, z in zip(cuts, cuts[1:], strict=False)]
    return axes, [(int(a), int(z), budget * s + SLACK) for a, z, s in zip(cuts, cuts[1:], share, strict=False)]


def _units(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def box_gap(x: np.ndarray, y: np.ndarray) -> float:
    """The squared distance between the boxes around two sets of points."""
    gap = np.maximum(0, np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0))).astype(np.float64)
    return float((gap * gap).sum())


def tile_links(block: int, blocks: list[tuple[int, int, float]], left: tuple, right: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two tiles (ids, counts, raw vectors, rotated vectors): each id's links, and its root or itself; left is right: within one."""
    same = left is right
    ids = left[0] if same else np.concatenate((left[0], right[0]))
    shift = 0 if same else len(left[0])
    links = np.zeros(len(ids), np.int64)
    a, z, bound = blocks[block]
    y = right[3][:, a:z]
    half = lambda m: (m * m).sum(axis=1, keepdims=True) / 2
    columns = np.hstack((y, np.ones((len(y), 1), np.float32), -half(y))).T.copy()
    norm = [np.linalg.norm(t[2].astype(np.float64), axis=1) for t in (left, right)]
    counts = left[1] if same else np.concatenate((left[1], right[1]))
    label = np.arange(len(ids))
    for r, s in ((r, s) for r in range(0, len(left[0]), ROWS) for s in range(0, len(y), COLUMNS)):
        if same and s + COLUMNS <= r:
            continue
        x = left[3][r : r + ROWS, a:z]
        near = np.hstack((x, -half(x), np.ones((len(x), 1), np.float32))) @ columns[:, s : s + COLUMNS]
        i, j = np.nonzero(near >= -bound / 2 - SLACK)
        i, j = i + r, j + s
        if same:
            i, j = i[i < j], j[i < j]
        for c in range(0, len(i), 65_536):
            p, q = i[c : c + 65_536], j[c : c + 65_536]
            gap = (left[3][p].astype(np.float64) - right[3][q].astype(np.float64)) ** 2
            within = np.stack([gap[:, f:t].sum(axis=1) <= b for f, t, b in blocks])
            mine = within[block] & (within.argmax(axis=0) == block)
            p, q = p[mine], q[mine]
            cosine = (left[2][p].astype(np.float64) * right[2][q].astype(np.float64)).sum(axis=1) / (norm[0][p] * norm[1][q])
            hit = cosine >= threshold
            # Hits are folded as they come, so pairs take no more room than one part of them.
            u, v = p[hit], q[hit] + shift
            np.add.at(links, u, counts[v])
            np.add.at(links, v, counts[u])
            u, v = label[u], label[v]
            apart = u != v
            if apart.any():
                label = tree(len(ids), u[apart], v[apart])[label]
    return ids, links, ids[label]


def tiles_for(total: int, dim: int, cores: int, tile: int = TILE) -> int:
    """Into how many tiles vectors are cut: as few as tasks can hold, but enough pairs of tiles for all cores."""
    return max(1, -(-total // max(1, min(tile, tile * 64 // dim))), min(-(-total // LEAST_TILE), math.isqrt(6 * cores) + 1))


def meetings(rid: np.ndarray, lead: np.ndarray, cuts: list[float], reach: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, i, j, whether it is of the right tile) of every pair of tiles i <= j that a row takes part in, DEAL_ROWS at a time."""
    some = mix(rid.view(np.uint64)).astype(np.int64) & 0x7FFFFFFF
    # Between equal cuts lie tiles of one coordinate; a vector of that coordinate is in any of them.
    least, most = (np.searchsorted(cuts, lead, side=side) for side in ("left", "right"))
    own = least + some % (most - least + 1)
    low, high = np.searchsorted(cuts, lead - reach, side="left"), np.searchsorted(cuts, lead + reach, side="right")
    upto = np.cumsum(high - low + 1)
    for first in range(0, int(upto[-1]) if len(upto) else 0, DEAL_ROWS):
        nth = np.arange(first, min(first + DEAL_ROWS, int(upto[-1])))
        at = np.searchsorted(upto, nth, side="right")
        j = high[at] - (upto[at] - 1 - nth)
        yield at, np.minimum(own[at], j), np.maximum(own[at], j), own[at] > j


def _links(classes: DataFrame, dim: int, threshold: float, kind: str, tile: int) -> DataFrame:
    """(rid, links, root) parts of vectors (rid, n, x) of one length."""
    spark = classes.sparkSession
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("rid")).limit(SAMPLE).select("x").collect()
    axes, blocks = rotation(_units(np.stack([np.frombuffer(r["x"], kind) for r in sample])), BLOCKS, 2 - 2 * threshold)

    def turn(x: np.ndarray) -> np.ndarray:
        return (_units(x) @ axes).astype(np.float32)

    def unpack(raw: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(raw), kind).reshape(-1, dim)

    def rotate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(lead=turn(unpack(frame["x"]))[:, 0].astype(np.float64))

    turned = written(classes.mapInPandas(rotate, "rid long, n long, x binary, lead double"), "turned")
    tiles = tiles_for(total, dim, spark.sparkContext.defaultParallelism, tile)
    cuts = []
    if tiles > 1:
        quantiles = [i / tiles for i in range(1, tiles)]
        cuts = sorted(turned.agg(F.percentile_approx("lead", quantiles, 20 * tiles + 1_000)).head()[0])
    reach = (2 - 2 * threshold) ** 0.5 + SLACK

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, i, j, right in meetings(frame["rid"].to_numpy(np.int64), frame["lead"].to_numpy(np.float64), cuts, reach):
                yield frame.iloc[at][["rid", "n", "x"]].assign(i=i, j=j, right=right)

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        def side(part: pd.DataFrame) -> tuple:
            x = unpack(part["x"])
            return part["rid"].to_numpy(), part["n"].to_numpy(), x, turn(x)

        found = [pd.DataFrame({"rid": [], "links": [], "root": []}).astype("int64")]
        if frame["i"].iloc[0] == frame["j"].iloc[0]:
            both = left = side(frame)
        else:
            left, both = side(frame[~frame["right"]]), side(frame[frame["right"]])
        if not len(left[0]) or not len(both[0]):
            return found[0]
        for b, (a, z, bound) in enumerate(blocks):
            if box_gap(left[3][:, a:z], both[3][:, a:z]) <= bound:
                ids, links, root = tile_links(b, blocks, left, both, threshold)
                some = links > 0
                found.append(pd.DataFrame({"rid": ids[some], "links": links[some], "root": root[some]}))
        return pd.concat(found)

    dealt = turned.mapInPandas(deal, "rid long, n long, x binary, i int, j int, right boolean")
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * tiles * (tiles + 1), 20_000))
    return dealt.repartition(wide, "i", "j").groupBy("i", "j").applyInPandas(join, "rid long, links long, root long")


def near_vectors(vectors: DataFrame, *, threshold: float = SIMILARITY, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    n_links counts the other rows of a cosine of at least the threshold, component_id is the smallest id that links
    reach, kept says whether that is the row's own. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do vectors of different lengths; their rows are components of their own. Each
    length is a job of its own. An empty table gives no rows; other columns are not read, whatever they are called. Rows
    that repeat an id are vectors of their own. A component of rows without id has a null id, and these are kept.
    """
    with_python(vectors.sparkSession)
    single = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    x = F.col(vector_col).cast("array<float>" if single else "array<double>")

    # A power of two takes out the scale exactly, so squares neither overflow nor vanish.
    def bytes_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = []
            for v in frame["v"]:
                a = None if v is None else np.asarray(v, dtype=np.float64)
                ok = a is not None and len(a) and np.isfinite(a).all() and a.any()
                raw.append(np.ldexp(a, -np.frexp(np.abs(a).max())[1]).astype(kind).tobytes() if ok else None)
            yield frame[["vec_id"]].assign(x=raw, dim=[None if r is None else len(r) // np.dtype(kind).itemsize for r in raw], digest=[None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]).astype({"dim": "Int64"})

    # The id is text on its way through pandas, which makes floats of integers with nulls.
    rows = vectors.select(F.col(id_col).cast("string").alias("vec_id"), x.alias("v")).mapInPandas(bytes_of, "vec_id string, x binary, dim int, digest binary")
    rows = written(rows.withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    classes = written(rows.where("x is not null").groupBy("digest").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("n"), F.first("x").alias("x"), F.first("dim").alias("dim")), "classes")
    found = None
    for (dim,) in sorted(tuple(r) for r in classes.select("dim").distinct().collect()):
        part = _links(classes.where(F.col("dim") == dim).select("rid", "n", "x"), dim, threshold, kind, tile)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found, "links")
    roots = connected_components(found.where("rid <> root").select(F.col("rid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rid")
    sums = found.groupBy("rid").agg(F.sum("links").alias("links"))
    known = classes.select("digest", "rid", "n").join(small_enough(written(sums, "sums"), 24), "rid", "left").join(small_enough(written(roots, "roots"), 24), "rid", "left")
    known = known.where("n > 1 or links is not null").select("digest", F.coalesce("root", "rid").alias("part"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    placed = written(rows.select("vec_id", "digest").join(small_enough(written(known, "known"), 48), "digest", "left"), "placed")
    least = small_enough(written(placed.where("part is not null").groupBy("part").agg(F.min("vec_id").alias("least")), "least"), 24)
    out = placed.join(least, "part", "left")
    component = F.when(F.col("part").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
