"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset and the master is this process (tests), a folder of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    at = sc._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparklex"))
        at = sc._jsc.sc().getCheckpointDir()
    return named or at.get()


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CUTTING = threading.RLock()  # the setting is the session's


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() into the shared folder; the shuffle files behind it go at once, as nothing reads them again."""
    conf = df.sparkSession.conf
    shared(df.sparkSession)
    with _CUTTING:
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            return df.select("*").checkpoint()  # a plan of its own, made under that setting
        finally:
            if before is None:
                conf.unset(CLEANUP)
            else:
                conf.set(CLEANUP, before)


def name(c: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + c.replace("`", "``") + "`")


def fresh(df: DataFrame, want: str) -> str:
    """A column name like `want` that df does not use."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
