"""Tables in the folder that driver and executors share. Lineage is cut there, never on one machine."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.gettempdir()}/quern-{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. ``release`` deletes it, as does the session's regular end."""
    if not _paths:
        atexit.register(release, spark)
    _paths.append(f"{shared_folder(spark)}/quern/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


_paths: list[str] = []

#: Rows of a table of numbers that are broadcast at most; more are joined by a shuffle.
FEW_ROWS = 300_000


def made() -> list[str]:
    """The paths given out and not released, in order."""
    return [*_paths]


def release(spark: SparkSession, paths: Sequence[str] | None = None) -> int:
    """Deletes tables written here, all of them or those at some paths, and tells how many. For when the
    results that read them have been read or written elsewhere: later reads of those fail."""
    found = [p for p in _paths if paths is None or p in set(paths)]
    _paths[:] = [p for p in _paths if p not in set(found)]
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return 0
    for path in found:
        removed(spark, path)
    return len(found)


def if_few(numbers: DataFrame) -> DataFrame:
    """A narrow table, marked to be broadcast if it has at most ``FEW_ROWS`` rows."""
    return F.broadcast(numbers) if numbers.limit(FEW_ROWS + 1).count() <= FEW_ROWS else numbers


def spare(name: str, taken: Sequence[str]) -> str:
    """A column name that is not taken, whatever its case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of a plan, written as Parquet to the shared folder and read from there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, name: str) -> DataFrame:
    """The rows with a number of their own, ``name``: written, so that each later reading finds the same."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "keyed")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder below the shared one."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows with a plan that starts at a written table."""
    return written(df, "cut")
