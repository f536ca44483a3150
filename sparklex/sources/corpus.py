"""Corpora: text files with one record a line, or any table with a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(text): lines end at LF only; one CR before it goes."""
    return spark.read.text(list(paths), lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("text"))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", text: str = "text") -> DataFrame:
    return spark.read.format(fmt).load(path).select(F.col(text).alias("text"))


#: Bytes of input that a core should have before a scan's own tasks are taken as they come.
BYTES_PER_CORE = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df on all cores, if it is so small that its files' row groups may leave most of them idle.

    A row group is read by one task. Rows are dealt anew only below BYTES_PER_CORE of input for each core, so
    what is shuffled stays that small; a larger table keeps its own tasks and gets no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * BYTES_PER_CORE else df
