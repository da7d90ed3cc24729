"""Sharding by sampled splitters."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import Scratch

UNIT = float(1 << 53)


def unit(column: Column) -> Column:
    """A value in [0, 1) from a 64-bit hash, the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit("sample")), 11) / F.lit(UNIT)


def bounds(sample: list[tuple[int, int]], ranges: int) -> list[tuple[int, int]]:
    """Up to ranges-1 distinct boundary keys at even quantiles of a size-weighted sample."""
    sample = sorted(sample)
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def balanced(sizes: dict, shards: int) -> dict:
    """Range to shard: descending sizes, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[key] = s
        heapq.heappush(heap, (load + size, s))
    return out


def shard(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_shard: int = 64,
    most_per_shard: int = 1024,
    rows_per_range: int = 50_000,
    sample_per_range: int = 12,
) -> DataFrame:
    """docs' ids with their size, shard and slot, so that all shards hold nearly equal bytes.

    The key is a hash of the text, then one of the id: equal texts lie side by side and share a
    shard; only a text whose copies exceed a whole shard is parted, by id. A sample of keys, each
    drawn in proportion to its size, gives boundaries at even quantiles; ranges that then hold
    more than their share are subdivided, first by text. A text with more than a range's share is
    a unit of its own. Units go, largest first, to the lightest shard, at ties the one of least
    number. Slots are numbered in pieces of bounded size, also within one text's copies. The
    driver sees at most shards * most_per_shard * sample_per_range sampled keys and twice
    shards * most_per_shard piece sizes, whatever the input.

    Size is the text's UTF-8 bytes plus 8; null text counts none, and nulls are equal texts.
    Null ids and repeated rows are placed like others. Empty input gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.col(text_col)
    rows = scratch.save(
        docs.select(
            F.col(id_col).alias("k"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
            F.xxhash64(text).alias("h"),
            F.xxhash64(F.col(id_col), F.lit("id")).alias("g"),
        ),
        "rows",
    )
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    ranges = shards * min(most_per_shard, max(per_shard, -(-n // (shards * rows_per_range))))
    rate = ranges * sample_per_range / max(total, 1)
    drawn = rows.where(unit(F.struct("h", "g")) < F.col("size") * F.lit(rate)).select("h", "g")
    cuts = bounds([tuple(x) for x in drawn.collect()], ranges)

    # A range is the number of boundary texts at or below the key.
    place = spark.sparkContext.broadcast(np.array(sorted({h for h, _ in cuts}), dtype=np.int64))

    @F.arrow_udf("long")
    def range_of(h: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(place.value, h.to_numpy(), side="right"), pa.int64())

    rows = rows.withColumn("r", range_of("h"))
    held = rows.groupBy("r").agg(F.sum("size").alias("s")).collect()
    share = max(1.0, total / ranges)
    parts = [(x["r"], -(-x["s"] // int(share))) for x in held if x["s"] > 1.5 * share]
    over = rows.join(F.broadcast(spark.createDataFrame(parts, "r long, parts long")), "r", "left")
    # Overfull ranges are cut at their texts; a text above the share is cut by id, into pieces of one unit unless it exceeds a shard.
    texts = over.where("parts > 1").groupBy("h").agg(F.sum("size").alias("text_size")).where(F.col("text_size") > F.lit(1.5 * share))
    texts = texts.select("h", F.ceil(F.col("text_size") / share).cast("long").alias("copies"), (F.col("text_size") > F.lit(total / shards)).alias("apart"))
    over = over.join(F.broadcast(scratch.save(texts, "texts")), "h", "left")  # at most one text a range's share
    by_text = F.pmod(F.xxhash64("h", F.lit("part")), F.col("parts"))
    by_id = F.pmod(F.xxhash64("g", F.lit("part")), F.col("copies"))
    unit_of = F.when(F.col("copies").isNotNull(), F.when(F.col("apart"), F.xxhash64("h", by_id)).otherwise(F.xxhash64("h", F.lit("unit"))))
    unit_of = F.coalesce(unit_of, F.when(F.col("parts") > 1, F.xxhash64("r", by_text)).otherwise(F.xxhash64("r")))
    over = over.withColumn("unit", unit_of).withColumn("piece", F.xxhash64("unit", F.coalesce(by_id, F.lit(0).cast("long"))))
    over = scratch.save(over.select("k", "size", "crc", "h", "g", "unit", "piece"), "placed")
    pieces = over.groupBy("unit", "piece").agg(F.sum("size").alias("s"), F.count("*").alias("c")).collect()
    units: dict[int, int] = {}
    for x in pieces:
        units[x["unit"]] = units.get(x["unit"], 0) + x["s"]
    where = balanced(units, shards)
    placed, filled = [], [0] * shards
    for x in sorted(pieces, key=lambda x: (x["unit"], x["piece"])):
        s = where[x["unit"]]
        placed.append((x["piece"], s, filled[s]))
        filled[s] += x["c"]
    table = F.broadcast(spark.createDataFrame(placed, "piece long, shard int, base long"))
    rank = F.row_number().over(Window.partitionBy("piece").orderBy("h", "g", "k", "size"))
    return over.withColumn("rank", rank).join(table, "piece").select(
        F.col("k").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def documents_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents in 24 shards of nearly equal bytes."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
