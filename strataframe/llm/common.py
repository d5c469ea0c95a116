"""Helpers shared by the training-data operators: scratch tables, names, word patterns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` with at least as many partitions as there are cores, where it is read from fewer files of one split each.

    For operators that work long on a row. Inputs of many or large files have their splits and stay as they are.
    """
    spark = df.sparkSession
    files, cores = df.inputFiles(), spark.sparkContext.defaultParallelism
    if not 0 < len(files) < cores:
        return df
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    for name in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen() > split:
            return df
    return df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="strataframe-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._strataframe_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table that ``cut`` wrote, once nothing reads it any more."""
    path = getattr(df, "_strataframe_path", None)
    if path:
        _delete(df.sparkSession, path)
        _made[:] = [(s, p) for s, p in _made if p != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row, also where lambdas of ``body`` use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
