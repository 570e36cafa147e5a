"""Tables written to the shared folder of spark.checkpoint.dir.

They cut lineage as checkpoint() does, survive the loss of an executor, and as Parquet they are
compressed and can be read by column.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is named: a temporary one if all tasks run on this machine (tests, local use), else an error, since tasks elsewhere would not see it."""
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = f"file://{tempfile.mkdtemp(prefix='keyloom-')}"
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: What is stored in the shared folder and nobody has deleted, by application.
_HELD: dict[str, set[str]] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which clean() deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _HELD.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Deletes all tables stored in the shared folder by this application: for when no result that was built on them is to be read any more."""
    for path in _HELD.pop(spark.sparkContext.applicationId, set()):
        remove(spark, path)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, computed once and read back from the shared folder. The result has the attribute stored_at."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_bytes(df: DataFrame) -> int:
    """Bytes of a written() table."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    fs = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    return fs.getContentSummary(path).getLength()


def discard(df: DataFrame) -> None:
    """Deletes a written() table that no later plan reads."""
    remove(df.sparkSession, df.stored_at)
    _HELD.get(df.sparkSession.sparkContext.applicationId, set()).discard(df.stored_at)
