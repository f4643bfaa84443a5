"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a hashed order, form blocks of `block_docs`. Block j (from 1) of a source of weight w is
released in slot floor((j - 1) / w) and due by slot ceil(j / w); one block is served in a slot, the released one with
the earliest deadline first. After any number of slots a source has had its share to within less than one block.

Windows are taken in whole numbers of 1/`UNITS` of the weights, so this holds against the weights as given, however
many slots there are. The driver simulates every slot; blocks grow with the input so that there are about `SLOTS` of
them at most (and one for each source at least), which bounds the schedule (8 bytes a slot) and its broadcast. When a
source runs out, the rest go on with their weights scaled up; there are at most as many such phases as sources, each of
which costs the driver a step for each source left. Nothing is dropped and nothing repeats.

Rows get their places without gathering a source: ranks come from counts of hashed buckets. `mixed_order` then cuts the
slots into as many stretches as there are partitions, looks up the hash at which each source enters each stretch, and
so knows a row's stretch from its source and hash alone: whole rows cross the network once.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, small_enough, written

#: Slots of a schedule, at about which the blocks begin to grow.
SLOTS = 1 << 20
#: Parts of the whole that weights are counted in: finer than any number of slots. A smaller weight waits for the rest.
UNITS = 1 << 80


def to_units(weights: dict[int, float], period: int) -> dict[int, int]:
    """Whole units that sum to the period, by largest remainder: less than one unit from the weights."""
    total = sum(map(Fraction, weights.values()))
    exact = {k: Fraction(w) * period / total for k, w in weights.items()}
    units = {k: math.floor(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (units[k] - exact[k], k))[: period - sum(units.values())]:
        units[k] += 1
    return units


def edf(units: dict[int, int]) -> Iterator[int]:
    """The source of each slot, without end: earliest deadline first among released blocks."""
    total = sum(units.values())
    # A source's next block waits for its release, then for its deadline; later blocks of it have later ones.
    waiting, queue = [(0, k, 1) for k, u in units.items() if u], []
    heapq.heapify(waiting)
    for slot in itertools.count():
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(queue, (-(-j * total // units[k]), k, j))
        deadline, k, j = heapq.heappop(queue)
        assert slot < deadline, "a feasible set of windows always meets its deadlines"
        heapq.heappush(waiting, (j * total // units[k], k, j + 1))
        yield k


def edf_period(units: dict[int, int], period: int) -> dict[int, list[int]]:
    """Slots of each source among the first `period`."""
    out = {k: [] for k in units}
    for slot, k in enumerate(itertools.islice(edf(units), period)):
        out[k].append(slot)
    return out


def served(blocks: dict[int, int], weights: dict[int, float]) -> Iterator[int]:
    """The source of each slot until all blocks are served; a phase ends when a source runs out."""
    left = {k: n for k, n in blocks.items() if n}
    units = to_units({k: weights[k] for k in left}, UNITS) if left else {}
    while left:
        # Of what is left only the shares among each other count; a weight below the unit waits for the rest.
        now = {k: units[k] for k in left}
        for k in edf(now if any(now.values()) else dict.fromkeys(now, 1)):
            yield k
            left[k] -= 1
            if not left[k]:
                del left[k]
                break


def _hash(id_col: str, seed: int):
    return F.xxhash64(F.lit(seed), F.col(id_col))


def _ranked(docs: DataFrame, id_col: str, source_col: str, rows: int, seed: int) -> DataFrame:
    """(doc_id, source, h, rank): rank from 0 in a hashed order within the source, found without gathering a source."""
    buckets = max(64, min(65_536, rows // 500))
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), _hash(id_col, seed).alias("h"))
    # By the upper bits, so that buckets follow each other in the order of h.
    hashed = hashed.withColumn("bucket", F.floor((F.shiftright("h", 32) + (1 << 31)) * buckets / (1 << 32)))
    sizes = hashed.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).drop("n")
    inside = hashed.withColumn("in_bucket", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id")) - 1)
    b = before.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "before")
    joined = inside.join(b, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    return joined.select("doc_id", "source", "h", (F.col("before") + F.col("in_bucket")).cast("long").alias("rank"))


@dataclass
class Schedule:
    """The slots of each source's blocks."""

    names: list[str | None]
    rows: list[int]
    slots: list[np.ndarray]
    block_docs: int

    @classmethod
    def of(cls, docs: DataFrame, weights: dict[str | None, float] | None, block_docs: int | None, source_col: str) -> Schedule:
        counts = {r[0]: r[1] for r in docs.groupBy(F.col(source_col).cast("string")).count().collect()}
        names = sorted(counts, key=lambda s: (s is not None, s or ""))
        floor = min((w for w in (weights or {}).values() if w > 0), default=1.0)
        share = {i: (weights.get(s, floor) or floor) if weights else math.sqrt(counts[s]) for i, s in enumerate(names)}
        size = block_docs or max(BLOCK_DOCS, -(-sum(counts.values()) // SLOTS))
        blocks = {i: -(-counts[s] // size) for i, s in enumerate(names)}
        order = np.fromiter(served(blocks, share), np.int32, sum(blocks.values()))
        ends = np.cumsum([blocks[i] for i in range(len(names))], dtype=np.int64)
        return cls(names, [counts[s] for s in names], np.split(np.argsort(order, kind="stable"), ends[:-1]) if names else [], size)

    def table(self, docs: DataFrame, period: int) -> DataFrame:
        """(_source, _part, slots): the slots of `period` blocks in a row, broadcast if they are few."""
        rows = [(s, n, mine[c : c + period].tolist()) for s, mine in zip(self.names, self.slots, strict=True) for n, c in enumerate(range(0, len(mine), period))]
        made = docs.sparkSession.createDataFrame(rows, "_source string, _part long, slots array<long>")
        return small_enough(made, 8 * min(period, max(map(len, self.slots), default=1)) + 64)

    def placed(self, ranked: DataFrame, period: int, slot: str, inside: str, source: str, rank: str) -> DataFrame:
        """ranked with the slot and the place in it of each row's rank in its source; temporary columns stay."""
        block = F.floor(F.col(rank) / self.block_docs)
        on = F.col(source).eqNullSafe(F.col("_source")) & (F.floor(block / period) == F.col("_part"))
        at = F.get("slots", F.pmod(block, F.lit(period)).cast("int"))
        return ranked.join(self.table(ranked, period), on).withColumn(slot, at).withColumn(inside, F.pmod(rank, F.lit(self.block_docs)).cast("int"))


#: Documents in a block of a small input.
BLOCK_DOCS = 64


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, *, block_docs: int | None = None, period: int = 1_000, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, block, slot, in_block; (slot, in_block) is the mixed order.

    weights: target share by source; sources without one share the smallest given weight. None: the square root of
    each source's number of documents, which lifts small sources. A null source is a source of its own. Rows that
    repeat an id are rows like any other (their order among each other is arbitrary but each gets its own place). An
    empty table gives no rows; other columns, texts among them, are not read. block_docs: None for `BLOCK_DOCS`, or
    more where that makes over `SLOTS` blocks. period: a source's slots in one row of the schedule.
    """
    plan = Schedule.of(docs, weights, block_docs, source_col)
    ranked = _ranked(docs, id_col, source_col, sum(plan.rows), seed)
    placed = plan.placed(ranked, period, "slot", "in_block", "source", "rank")
    return placed.select("doc_id", "source", F.floor(F.col("rank") / plan.block_docs).alias("block"), "slot", "in_block")


def _stretches(docs: DataFrame, plan: Schedule, parts: int, seed: int, id_col: str, source_col: str) -> DataFrame:
    """(_s, hashes, nth, first): per source the hash, number and first rank at which it enters each stretch of slots."""
    total, enters = sum(map(len, plan.slots)), {}
    for i, mine in enumerate(plan.slots):
        block = np.searchsorted(mine, np.arange(parts) * total // parts)
        for nth in range(parts):  # a later stretch that begins with the same block takes it
            if block[nth] < len(mine):
                enters.setdefault(i, {})[int(block[nth]) * plan.block_docs] = nth
    rows = [(plan.names[i], rank, nth) for i, found in enters.items() for rank, nth in found.items()]
    at = docs.sparkSession.createDataFrame(rows, "_s string, _r long, nth int")
    ranked = _ranked(docs, id_col, source_col, sum(plan.rows), seed)
    found = ranked.join(small_enough(at, 64), F.col("source").eqNullSafe(F.col("_s")) & (F.col("rank") == F.col("_r")))
    # Rows of equal hash stay together, so a stretch begins with the first rank of its hash.
    entry = F.struct("h", "nth", F.col("rank").alias("first"))
    made = found.groupBy("_s").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return made.select("_s", F.col("e.h").alias("hashes"), F.col("e.nth").alias("nth"))


def mixed_order(docs: DataFrame, weights: dict[str | None, float] | None = None, *, block_docs: int | None = None, period: int = 1_000, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs, all rows and columns, in partitions of consecutive slots, each sorted in the mixed order.

    Null sources, null and repeated ids, an empty table: as mix says. Rows that repeat an id come in any order among
    each other and share a partition. Columns of any name stay as they are.
    """
    plan = Schedule.of(docs, weights, block_docs, source_col)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = fresh(docs, "_mix_h", "_mix_source", "_mix_part", "_mix_rank", "_mix_slot", "_mix_in", "_source", "_part", "slots", "_s", "hashes", "nth")
    h, source, part, rank, slot, inside = names[:6]
    if names[6:] != ["_source", "_part", "slots", "_s", "hashes", "nth"]:
        plain = fresh(docs, *(f"_mix_c{i}" for i in range(len(docs.columns))))
        renamed = docs.toDF(*plain)
        made = mixed_order(renamed, weights, block_docs=block_docs, period=period, seed=seed, id_col=plain[docs.columns.index(id_col)], source_col=plain[docs.columns.index(source_col)])
        return made.toDF(*docs.columns)
    keyed = docs.withColumn(h, _hash(id_col, seed)).withColumn(source, F.col(source_col).cast("string"))
    enters = written(_stretches(docs, plan, parts, seed, id_col, source_col), "stretches")
    longest = max(1, parts.bit_length())
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(longest))))
    past = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get("hashes", n + step - 1) <= F.col(h), n + step).otherwise(n))
    dealt = keyed.join(small_enough(enters, 24 * parts), F.col(source).eqNullSafe(F.col("_s"))).withColumn(part, F.coalesce(F.get("nth", past - 1), F.lit(0)))
    dealt = dealt.drop("_s", "hashes", "nth")
    # A source's ranks in a stretch begin where those of the stretches before it end.
    sizes = dealt.groupBy(source, part).agg(F.count(F.lit(1)).alias("slots"))
    before = sizes.withColumn("nth", F.sum("slots").over(Window.partitionBy(source).orderBy(part)) - F.col("slots"))
    before = small_enough(written(before.select(F.col(source).alias("_s"), F.col(part).alias("_part"), "nth"), "before"), 48)
    dealt = dealt.join(before, F.col(source).eqNullSafe(F.col("_s")) & (F.col(part) == F.col("_part"))).drop("_s", "_part")
    dealt = dealt.repartitionById(parts, F.col(part))
    ranked = dealt.withColumn(rank, F.col("nth") + F.row_number().over(Window.partitionBy(part, source).orderBy(h, id_col)) - 1)
    placed = plan.placed(ranked, period, slot, inside, source, rank)
    return placed.sortWithinPartitions(slot, inside).select(*docs.columns)
