"""Exact global places of rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import staged


def exact_rank(df: DataFrame, order: list[Column | str], name: str = "rank", first: int = 0) -> DataFrame:
    """df with its place in `order` as a long from `first`; rows that tie on all of `order` follow each other in no fixed order.

    Rows are sorted by ranges of the whole order, so ties on its first columns are dealt to many tasks.  The sorted rows
    are written once with their place in their range, which the sizes of the ranges before complete: one
    number a range, counted from what was written, so cuts that a lost executor would draw anew do no harm.
    """
    spark = df.sparkSession
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_place": inside}), "ranked")
    sizes = sorted((r["_range"], r["n"]) for r in rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], first
    for k, n in sizes:
        before.append((k, total))
        total += n
    offsets = spark.createDataFrame(before, "_of_range int, _before long")
    placed = rows.join(F.broadcast(offsets), F.col("_range") == F.col("_of_range"))
    return placed.withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_of_range", "_before")
