"""Tables written to the folder that the cluster shares: what a plan reads more than once, or must outlive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession

#: Tables that are still there, oldest first: their session and folder.
_TABLES: list[tuple[SparkSession, str]] = []
#: Rows of the tables read that ``dealt`` gives a task.
ROWS = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode without it, a temporary one that becomes the setting."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", folder := tempfile.mkdtemp(prefix="genolake-"))
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, deleted at the end of the driver's process if not before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.unregister(forget)
        atexit.register(forget)
    _TABLES.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """The number of tables so far, for ``forget``."""
    return len(_TABLES)


def forget(since: int = 0, but: DataFrame | None = None) -> None:
    """Deletes the tables from the place ``since`` on, but for that of the DataFrame ``but``."""
    files = but.inputFiles() if but is not None else []
    kept = []
    for spark, path in _TABLES[since:]:
        if files and path.rsplit("/", 1)[-1] in files[0]:
            kept.append((spark, path))
            continue
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # noqa: BLE001, S110  the driver is shutting down; a table that stays does no harm
            pass
    _TABLES[since:] = kept


def drop(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    files = df.inputFiles()
    for k in range(len(_TABLES) - 1, -1, -1):
        if files and _TABLES[k][1].rsplit("/", 1)[-1] in files[0]:
            _TABLES.append(_TABLES.pop(k))
            forget(len(_TABLES) - 1)
            return


def rows_read(df: DataFrame) -> int:
    """The rows of all Parquet files that a DataFrame reads, from their footers; 0 if it reads none."""
    files = [unquote(f) for f in df.inputFiles() if f.endswith(".parquet")]
    return df.sparkSession.read.schema("_ int").parquet(*files).count() if files else 0


def dealt(df: DataFrame, *keys: str | Column, of: DataFrame | None = None, work: int = 1) -> DataFrame:
    """The same rows, by keys in as many partitions as the tables read (by ``of``, if given) ask for, so that a task's part doesn't grow with them; small ones as Spark deals them.

    ``work`` times as many, where a row is much work.
    """
    n = -(-rows_read(df if of is None else of) * work // ROWS)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df
