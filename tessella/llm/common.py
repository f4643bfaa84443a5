"""What the training-data operators share: reading tables and cutting lineage through the shared folder."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _ship(application: str) -> None:
    """Send this package's source to the executors' Python workers, once for each application."""
    root = Path(__file__).resolve().parents[1]
    target = f"{tempfile.mkdtemp(prefix='tessella-')}/tessella.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    SparkSession.getActiveSession().sparkContext.addPyFile(target)


def with_python(spark: SparkSession) -> None:
    """Make ready for Python functions on executors: the package is there, and an Arrow batch has few rows.

    Texts are long, and Python workers share the executor's memory.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    _ship(spark.sparkContext.applicationId)


#: Rows in one Arrow batch.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Only a local session (tests) may lack it; then a temporary folder is taken and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        discard(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone when the interpreter ends
        pass


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: what follows never recomputes them."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, whatever its case rules."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes up to which a keyed side may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20


def small_enough(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit, else df as it is."""
    return F.broadcast(df) if df.count() * bytes_per_row <= limit else df


def held_out(doc_id: Column, folds: int, rest: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == rest


def without_rows(docs: DataFrame, dropped: DataFrame, key: dict[str, Column]) -> DataFrame:
    """The rows of docs whose key is not in dropped (columns of the key's names); nulls equal nulls.

    The dropped keys are broadcast when few by count, else both sides shuffle.
    """
    names = dict(zip(key, fresh(docs, *(f"_drop_{k}" for k in key)), strict=True))
    side = dropped.select(*(F.col(k).alias(names[k]) for k in key)).distinct()
    side = small_enough(side, 64)
    on = [value.eqNullSafe(F.col(names[k])) for k, value in key.items()]
    return docs.join(side, on, "left_anti")
