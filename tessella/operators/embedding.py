"""The embedding stage: role prefixes, a pluggable embedder in Arrow batches, and the native hash embedder."""

from __future__ import annotations

import functools
import random
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import store
from ..functions import text as X

DIMENSIONS = 384
#: Requests that a task has under way at a time.
IN_FLIGHT = 4


def with_prefix(c: Column, prefix: str) -> Column:
    """The text under a role prefix, which ends in white space."""
    if not prefix:
        return c
    return F.concat(F.lit(prefix if prefix[-1].isspace() else f"{prefix} "), c)


def hash_entries(rows: DataFrame, key: str, text: str, *carry: str) -> DataFrame:
    """Sparse unit vectors by signed feature hashing: key, carried columns, bucket, weight.

    A token's bucket is the first four bytes of its SHA-256 modulo the dimensions, its sign the parity of the fifth.
    """
    # Texts are dealt out by key once; grouping by (key, bucket) and the norm by key then need no further exchange. The
    # number of tasks grows with the rows, so that what a task groups and sorts doesn't.
    token = rows.select(key, *carry, text).repartition(store.tasks_for(rows.select(key)), F.col(key)).select(key, *carry, F.explode(X.alnum_tokens(F.col(text))).alias("t")).withColumn("h", F.sha2("t", 256))
    bucket = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(DIMENSIONS)).cast("int")
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    sums = token.groupBy(key, *carry, bucket.alias("bucket")).agg(F.sum(sign).alias("x")).where("x <> 0")
    return sums.withColumn("weight", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))).drop("x")


def sparse(entries: DataFrame, *by: str) -> DataFrame:
    """One row a vector: its key columns and `entries`, an array of (bucket, weight) in order of buckets."""
    return entries.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bucket", "weight"))).alias("entries"))


def dense(entries: Column) -> Column:
    """The DIMENSIONS weights of a sparse vector's entries."""
    found = F.map_from_entries(entries)
    return F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(F.try_element_at(found, i), F.lit(0.0)))


def sparse_dot(entries: Column, weights: Column) -> Column:
    """Dot product of a sparse vector's entries with a dense one."""
    return F.aggregate(entries, F.lit(0.0), lambda total, e: total + e.weight * F.get(weights, e.bucket))


def hash_sql(table: str, key: str, text: str, carry: str = "") -> str:
    """WITH clause that ends in hashed_<table>."""
    return f"WITH {hash_ctes(table, key, text, carry)}"


def hash_ctes(table: str, key: str, text: str, carry: str = "") -> str:
    more = f", {carry}" if carry else ""
    return f"""tok_{table} AS (SELECT {key}{more}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS t FROM {table}),
 hex_{table} AS (SELECT {key}{more}, sha256(t) AS h FROM tok_{table}),
 sum_{table} AS (SELECT {key}{more}, (('0x' || substr(h, 1, 8))::BIGINT % {DIMENSIONS})::INT AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM hex_{table} GROUP BY ALL HAVING x <> 0),
 hashed_{table} AS (SELECT {key}{more}, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS weight FROM sum_{table})"""


class TransientError(Exception):
    """A failure worth another attempt (rate limits, server errors, broken transport)."""


def with_retry(call: Callable, attempts: int = 3, base: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """call(), again after TransientError, waiting base * 2**(n - 1) and up to half of base more."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except TransientError:
            if n == attempts:
                raise
            sleep(base * 2 ** (n - 1) + random.uniform(0, base / 2))


def in_flight(calls: Iterator[Callable], bound: int = IN_FLIGHT) -> Iterator:
    """The results of calls in their order, at most `bound` of them running at a time.

    Later calls wait for the oldest result to be taken, so no more than `bound` inputs or results are held.
    """
    with ThreadPoolExecutor(bound) as pool:
        window: deque = deque()
        for call in calls:
            if len(window) == bound:
                yield window.popleft().result()
            window.append(pool.submit(call))
        while window:
            yield window.popleft().result()


def _batched(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Frames of exactly `rows` rows but the last, whatever the sizes that they come in."""
    held = None
    for frame in frames:
        held = frame if held is None or held.empty else pd.concat((held, frame), ignore_index=True)
        for k in range(0, len(held) - rows + 1, rows):
            yield held.iloc[k : k + rows]
        held = held.iloc[len(held) - len(held) % rows :].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]] | None, *, key: str, text: str, prefix: str = "", batch: int = 64, bound: int = IN_FLIGHT, wait: float = 0.5, errors: bool = False) -> DataFrame:
    """key and embedding for each row, through any embedder that takes a list of texts.

    Each task sends batches of `batch` texts, up to `bound` of them at a time, and puts the results back in order; one
    that fails for a while is sent again after `wait` seconds, twice as long each time, three times in all. Without an
    embedder it refuses. errors: what fails becomes rows without embedding that say why in a column `error` of at most
    500 characters, and the rest goes on; without it the first failure ends the job. A batch that is refused is halved
    until what is refused stands alone; one that only fails for a while, three times in all, fails as a whole.
    """
    refused = "no embedding model is configured"
    if embedder is None and not errors:
        raise ValueError(refused)
    field = rows.schema[key].dataType.simpleString()
    shape = f"{key} {field}, embedding array<float>" + ", error string" * errors

    def answers(texts: list[str]) -> list[tuple[list[float] | None, str]]:
        """A vector or an error for each text."""
        try:
            if embedder is None:
                raise ValueError(refused)
            vectors = with_retry(lambda: embedder(texts), base=wait)
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            return [(list(map(float, v)), "") for v in vectors]
        except Exception as e:  # noqa: BLE001 - one text must not end the others
            if not errors:
                raise
            whole = len(texts) == 1 or embedder is None or isinstance(e, TransientError)
            error = (str(e) if isinstance(e, ValueError) else f"{type(e).__name__}: {e}")[:500]
        if whole:
            return [(None, error)] * len(texts)
        half = len(texts) // 2
        return answers(texts[:half]) + answers(texts[half:])

    def one(part: pd.DataFrame) -> pd.DataFrame:
        vectors, failed = zip(*answers(part["t"].tolist()), strict=True)
        return pd.DataFrame({key: part[key].to_numpy(), "embedding": list(vectors)} | ({"error": list(failed)} if errors else {}))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_flight((functools.partial(one, part) for part in _batched(frames, batch)), bound)

    return rows.select(key, with_prefix(F.col(text), prefix).alias("t")).mapInPandas(run, shape)


def check_dimension(index: DataFrame, probe: int) -> None:
    """Refuse vectors of another length than the index has."""
    row = index.select(F.size("embedding").alias("n")).head()
    if row is not None and row["n"] != probe:
        raise ValueError(f"the index has {row['n']} dimensions, the model {probe}: rebuild the index first")
