"""Shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side may be broadcast, and bytes of its widest row times its rows; beyond either a shuffle join is used.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


#: The own folder of a local session that names none.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session that names none (tests) gets an own one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='dossier-')}"
        atexit.register(shutil.rmtree, _own[context.applicationId].removeprefix("file://"), ignore_errors=True)
    return _own[context.applicationId]


def spill_folder(spark: SparkSession) -> str:
    """A path in the shared folder that a task may spill to, '' where the shared folder is no file system path."""
    scheme, mark, path = shared_folder(spark).partition(":")
    path = path if mark else scheme
    return re.sub("^/+", "/", path) + "/spill" if not mark or scheme == "file" else ""


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=eager)


def join_checked(left: DataFrame, right: DataFrame, on, how: str, rows: int, row_bytes: int = 64) -> DataFrame:
    """Join that broadcasts ``right`` only if its counted ``rows`` (of at most about ``row_bytes``) are within the bounds."""
    small = rows <= BROADCAST_ROWS and rows * row_bytes <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right, on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def earliest_rows(df: DataFrame, key: str = "id", order: str = "loaded_at") -> DataFrame:
    """One row for each non-null ``key``: the one with the smallest ``order`` (nulls last).

    ``df`` is read straight from files.  Only keys with several rows are joined back, so the
    wide columns are neither sorted nor shuffled; ties are broken by file and position.
    """
    place = F.struct(
        F.col(order).isNull().alias("late"), F.col(order).alias("at"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    df = df.where(F.col(key).isNotNull())
    again = cut(
        df.groupBy(F.col(key).alias("__key"))
        .agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias("__keep"))
        .where("__n > 1").select("__key", "__keep")
    )
    joined = join_checked(df.withColumn("__place", place), again, F.col(key) == F.col("__key"), "left", again.count(), 400)
    return joined.where(F.col("__key").isNull() | (F.col("__place") == F.col("__keep"))).drop("__key", "__keep", "__place")
