"""Vectors of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pooled(rows: DataFrame, group: str, vector: str = "vector", how: str = "mean", order: str | None = None, normalize: bool = False) -> DataFrame:
    """(group, n, vector): a group's vectors as one, by the mean or the greatest of each element, or its first by ``order``.

    Elements are summed by group and place before they are shuffled, so no task holds a group's
    vectors. Null vectors don't count; a null element is left out of its place; a group without any vector
    has none. With normalize the result has length 1 (a zero vector stays).
    """
    if how not in ("mean", "max", "first"):
        raise ValueError(f"unknown pooling {how}")
    rows = rows.where(F.col(vector).isNotNull())
    if how == "first":
        out = rows.groupBy(group).agg(F.count("*").alias("n"), F.min_by(F.col(vector).cast("array<double>"), F.struct(order)).alias("vector"))
    else:
        elements = rows.select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
        each = (F.avg("x") if how == "mean" else F.max("x")).alias("x")
        placed = elements.groupBy(group, "i").agg(each, F.count("*").alias("n"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"])
        out = placed.groupBy(group).agg(F.max("n").alias("n"), listed.alias("vector"))
    if normalize:
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
        out = out.withColumn("vector", F.when(norm > 0, F.transform("vector", lambda x: x / norm)).otherwise(F.col("vector")))
    return out.select(group, "n", "vector")
