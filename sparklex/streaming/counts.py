"""Word counts kept up to date over a stream, for training at any moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_word_counts(stream: DataFrame, pieces: Column) -> DataFrame:
    """The streaming aggregate (word, freq); write it in complete or update mode."""
    return stream.select(F.explode(pieces).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def start_counts(stream: DataFrame, pieces: Column, name: str, checkpoint: str) -> StreamingQuery:
    """Counts as the in-memory table `name`."""
    return stream_word_counts(stream, pieces).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
