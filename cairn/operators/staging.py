"""Cutting plans into stages: checkpoints, barriers for the optimizer, and folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary folder in local mode, else an error:
    on a cluster each executor would write to a disk of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-shared-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the cluster's shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(frame: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder, so that a lost executor costs no recomputation."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(frame.sparkSession))
    return frame.checkpoint()


def sealed(frame: DataFrame, *names: str) -> DataFrame:
    """The frame, whose columns `names` later filters don't repeat.

    Spark pushes a filter below a projection by writing the projection's expressions into it. The output of a generator
    it can't push through, while filters on the other columns still reach the scan and unused columns are still pruned.
    """
    others = [F.col(quoted(c)) for c in frame.columns if c not in names]
    return frame.select(*others, F.inline(F.array(F.struct(*(F.col(quoted(c)) for c in names))))).select(*map(quoted, frame.columns))


def compiled(spark: SparkSession) -> None:
    """Keeps Spark from generating methods that the JVM only interprets: HotSpot compiles none over 8,000 bytes, and a stage of
    many columns is one such method unless this limit makes Spark split it. A session that has a limit of its own keeps it."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535":
        spark.conf.set(name, 8000)


def quoted(name: str) -> str:
    """The column's name as an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of the path, the path as its object)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)
