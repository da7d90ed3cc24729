"""Fusion of ranked channels: one union and one grouping, whatever their number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.retrieve import DIGITS


def channels_of(results: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, doc_id, channel, position, weight, score, rank) of named channels; position is the channel's order."""
    parts = [
        df.select("query_id", "doc_id", "score", "rank").withColumns(
            {"channel": F.lit(name), "position": F.lit(i), "weight": F.lit(float((weights or {}).get(name, 1.0)))}
        )
        for i, (name, df) in enumerate(results.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def channel_map() -> Column:
    """Map of channel to its rank, score and weight, in the channels' order."""
    entry = F.struct("position", "channel", F.struct("rank", "score", "weight").alias("v"))
    return F.map_from_entries(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["channel"], e["v"])))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """Rank by score; at ties documents come in the order of the first channel that has them."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.position", "first.rank", "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("first")


def fuse(channels: DataFrame, k: int, rrf_k: int = 60, *, mode: str = "rrf", total: int | None = None, support_bonus: float = 0.0,
         single_penalty: float = 0.0, missing_penalty: float = 0.0, min_support: int = 1) -> DataFrame:
    """Reciprocal rank fusion, with the consensus and robust variants' support terms.

    Gives query_id, doc_id, rrf_score, support_count, channels, score and rank.
    """
    rows = channels.groupBy("query_id", "doc_id").agg(
        F.sum(F.col("weight") / (rrf_k + F.col("rank"))).alias("rrf_score"),
        F.count("*").cast("int").alias("support_count"),
        channel_map().alias("channels"),
        F.min(F.struct("position", "rank")).alias("first"),
    )
    score = F.col("rrf_score")
    if mode != "rrf":
        score += support_bonus * F.col("support_count") - F.when(F.col("support_count") == 1, single_penalty).otherwise(0.0)
    if mode == "robust_rank":
        score -= missing_penalty * (F.lit(total) - F.col("support_count"))
    rows = rows.where(F.col("support_count") >= min_support)
    return ranked(rows.withColumn("score", F.round(score, 9)).withColumn("rrf_score", F.round("rrf_score", 9)), k)


def min_max(results: DataFrame) -> DataFrame:
    """results with norm: scores spread over 0 to 1 within a query; all equal gives 1."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return results.withColumn("norm", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def hybrid(dense: DataFrame, bm25: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """alpha * dense + (1 - alpha) * BM25 over min-max scores; a missing channel counts 0."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")
    both = reduce(
        DataFrame.unionByName,
        [min_max(df).select("query_id", "doc_id", "score", "norm", "rank", F.lit(i).alias("position")) for i, df in enumerate((dense, bm25))],
    )
    of = lambda i, c: F.coalesce(F.max(F.when(F.col("position") == i, F.col(c))), F.lit(0.0))
    rows = both.groupBy("query_id", "doc_id").agg(
        of(0, "score").alias("dense_raw"),
        of(1, "score").alias("bm25_raw"),
        of(0, "norm").alias("dense_norm"),
        of(1, "norm").alias("bm25_norm"),
        F.min(F.struct("position", "rank")).alias("first"),
    )
    score = F.round(alpha * F.col("dense_norm") + (1 - alpha) * F.col("bm25_norm"), 9)
    rows = rows.withColumn("score", score)
    return ranked(rows.withColumns({c: F.round(c, DIGITS) for c in ("dense_norm", "bm25_norm")}), k)
