"""The folder that driver and executors share, tables kept in it for a session, and how sides of joins are dealt."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes up to which a side of a join may be broadcast.
BROADCAST_BYTES = 64 << 20

_kept: dict[tuple[str, str], str] = {}
_made: dict[tuple[str, str], object] = {}
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session may lack it and take a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="tessella-kept-")
    return _local[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone when the interpreter ends
        pass


def state_of(spark: SparkSession, path: str) -> str:
    """What tells the files under a path from other ones: their number, bytes, names and times."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    named = F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))
    return str(tuple(files.agg(F.count(F.lit(1)), F.sum("length"), named).head()))


def kept(spark: SparkSession, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of this key, written to the shared folder when it is first asked for, read from there ever after."""
    name = spark.sparkContext.applicationId, key
    if name not in _kept:
        path = f"{shared_dir(spark)}/tessella/kept-{uuid.uuid4().hex}"
        make().write.parquet(path)
        atexit.register(_forget, spark, path)
        _kept[name] = path
    return spark.read.parquet(_kept[name])


def kept_in_folder[T](spark: SparkSession, key: str, make: Callable[[str], T]) -> T:
    """What make returns, made once a session; it has a folder of the shared one to write to."""
    name = spark.sparkContext.applicationId, key
    if name not in _made:
        path = f"{shared_dir(spark)}/tessella/kept-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, path)
        _made[name] = make(path)
    return _made[name]


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/tessella/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with its rows' numbers, from 1, in the order of a column: ranges are sorted apart and begin where those before end."""
    ranges = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_m", F.monotonically_increasing_id())
    made = written(ranges.withColumn("_range", F.shiftright("_m", 33)))
    sizes = made.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return made.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + inside + 1).drop("_m", "_range", "_before")


#: Rows of texts in one task.
TASK_ROWS = 4_000


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """How many tasks df's counted rows make at so many a task, one a core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """df dealt out evenly, at most about `rows` rows a task and one task a core at least.

    How its files are split says little: a file's rows may lie in one row group, whose one task would do all the work.
    """
    return df.repartition(tasks_for(df, rows))


def small_enough(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """df with a broadcast hint if its counted rows fit, else as it is."""
    return F.broadcast(df) if df.count() * bytes_per_row <= BROADCAST_BYTES else df
