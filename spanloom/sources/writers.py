"""Sinks: parquet by split, vocabulary text, report text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet_by(df: DataFrame, path: str, *partitions: str) -> None:
    """Write parquet, one folder per value; rows of a value are spread over its tasks, never gathered into one."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def rebased(shards: DataFrame, order: list[str], size: str, start: str) -> DataFrame:
    """Shard-local positions moved by the sizes of the shards before: (shard_no..., size) totals are a row a shard."""
    from pyspark.sql import Window

    totals = shards.groupBy(*order).agg(F.sum(size).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.join(F.broadcast(totals.select(*order, before.alias("__before"))), order).withColumn(start, F.col(start) + F.col("__before")).drop("__before")


def vocabulary_text(vocabulary: DataFrame, path: str) -> None:
    """Lines `symbol count` in order of id, in files whose names keep that order."""
    vocabulary.sort("entity_id").select(F.concat_ws(" ", "symbol", "cnt").alias("value")).write.mode("overwrite").text(path)


def report_text(lines: DataFrame, path: str, order: str = "rank", line: str = "line") -> None:
    lines.sort(order).select(F.col(line).alias("value")).write.mode("overwrite").text(path)
