"""Leases on notebooks, kept in a store that all drivers share.

A lease is taken by compare-and-set: who wants it reads the present version of the store, decides, and puts up the next
version, which the store lets only one writer do; the others read again. Every grant has a token one higher than the one
before, so that a holder whose lease has gone stale and to another can neither release it nor be taken for its holder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..operators.tables import LEASE_SECONDS
from . import files

LEASES = "notebook_id long, holder string, token long, acquired_at double"


def leases(spark: SparkSession, path: str) -> DataFrame:
    """(notebook_id, holder, token, acquired_at) of all notebooks ever leased; no holder: released."""
    try:
        return files.read_keyed(spark, path)
    except ValueError:
        return spark.createDataFrame([], LEASES)


def acquire(contenders: DataFrame, path: str, now: float, tries: int = 5) -> DataFrame:
    """(notebook_id, holder, token) of the contenders (notebook_id, holder) that get the lease, one a notebook at most.

    A lease that is held and not older than LEASE_SECONDS is left alone; of several contenders for a free one the first
    by name gets it. Contenders are thinned out before they are shuffled, however many want one notebook. Contenders
    without a notebook or a name get nothing.
    """
    spark = contenders.sparkSession
    first = store.written(contenders.where("notebook_id is not null and holder is not null").groupBy("notebook_id").agg(F.min("holder").alias("holder")))
    for left in range(tries - 1, -1, -1):
        held = leases(spark, path).select("notebook_id", F.col("holder").alias("_held"), "token", "acquired_at")
        fresh = F.col("_held").isNotNull() & (F.lit(now) - F.col("acquired_at") <= LEASE_SECONDS)
        free = first.join(held, "notebook_id", "left").where(~F.coalesce(fresh, F.lit(False)))
        won = store.written(free.select("notebook_id", "holder", (F.coalesce("token", F.lit(0)) + 1).cast("long").alias("token"), F.lit(float(now)).alias("acquired_at")))
        try:
            files.write_keyed(won, path, "notebook_id", buckets=16)
            return won.select("notebook_id", "holder", "token")
        except RuntimeError:
            if not left:
                raise
    raise AssertionError


def release(held: DataFrame, path: str, tries: int = 5) -> DataFrame:
    """(notebook_id) of the leases given back: of `held` (notebook_id, token) those whose token is still the present one."""
    spark = held.sparkSession
    mine = store.written(held.select("notebook_id", "token").distinct())
    for left in range(tries - 1, -1, -1):
        present = leases(spark, path).where("holder is not null").select("notebook_id", "token")
        free = store.written(present.join(mine, ["notebook_id", "token"], "left_semi").select("notebook_id", F.lit(None).cast("string").alias("holder"), "token", F.lit(None).cast("double").alias("acquired_at")))
        try:
            files.write_keyed(free, path, "notebook_id", buckets=16)
            return free.select("notebook_id")
        except RuntimeError:
            if not left:
                raise
    raise AssertionError
