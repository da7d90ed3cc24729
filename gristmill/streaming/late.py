"""Documents that arrive after the index was built, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gristmill.functions import text as T
from gristmill.operators.retrieve import SHIPPED_QUERIES, Bm25Index, shipped_lifts, shipped_scores, type_of


def score_arrivals(arrivals: DataFrame, index: Bm25Index, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of streamed (doc_id, text): scored by the index's fixed statistics, without state.

    Each arrival's distinct terms meet the queries' terms inside its own row, so the stream needs no
    grouping, and time grows with the terms that they share. Queries are shipped to the tasks.
    """
    lifts = shipped_lifts(index, queries, known=False)
    if lifts is None:
        raise ValueError(f"more than {SHIPPED_QUERIES} queries")
    return shipped_scores(T.doc_terms(arrivals), lifts, type_of(queries, "query_id"))


def first_arrivals(arrivals: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each document once, within the watermark's delay; needs ts."""
    return arrivals.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["doc_id"])


def arrival_counts(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by type and window of time; ts must be a timestamp."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def running_top_k(arrivals: DataFrame, index: Bm25Index, queries: DataFrame, k: int, delay: str = "10 minutes") -> DataFrame:
    """(query_id, doc_id, score, rank) as a stream in update mode: each query's k best of all arrivals (doc_id, text, ts) so far.

    A document counts once within the watermark's delay, and not if it comes after it. Arrivals are
    scored by the index's fixed statistics where they are, and only a task's best of each query are
    shuffled. The state of a query is its k best, so it stays small however long the stream runs; a query's rows follow whenever they change.
    """
    import pandas as pd

    lifts = shipped_lifts(index, queries)
    if lifts is None:
        raise ValueError(f"more than {SHIPPED_QUERIES} queries")
    q, d = type_of(queries, "query_id"), type_of(arrivals, "doc_id")
    scores = shipped_scores(T.doc_terms(first_arrivals(arrivals, delay)), lifts, q, k)

    def update(key, batches, state):
        ids, scores = (list(x) for x in state.get) if state.exists else ([], [])
        before, found = (ids, scores), dict(zip(ids, scores))
        for rows in batches:
            found.update(zip(rows["doc_id"].tolist(), rows["score"].tolist()))
        best = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]
        ids, scores = [x for x, _ in best], [float(x) for _, x in best]
        state.update((ids, scores))
        if (ids, scores) != before:
            yield pd.DataFrame({"query_id": [key[0]] * len(ids), "doc_id": ids, "score": scores, "rank": range(1, len(ids) + 1)})

    out = f"query_id {q}, doc_id {d}, score double, rank int"
    return scores.groupBy("query_id").applyInPandasWithState(update, out, f"ids array<{d}>, scores array<double>", "update", "NoTimeout")


def last_rows(stream: DataFrame, key: str, folder: str, checkpoint: str) -> DataFrame:
    """What a stream in update mode last said of each key, once all that is available has run; rows of a key come together."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/{number}")  # a batch that runs again replaces its rows

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    newest = rows.groupBy(key).agg(F.max("_batch").alias("_batch"))
    return rows.join(newest, [key, "_batch"], "left_semi").drop("_batch")
