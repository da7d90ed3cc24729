"""Near-duplicate clusters among one query's candidates: order-dependent, a query at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gristmill.functions import text as T


def leader_clusters(candidates: DataFrame, threshold: float = 0.72) -> DataFrame:
    """candidates (query_id, doc_id, rank, text, ...) with cluster_id.

    In rank order a candidate joins the first cluster whose leader's words have at least the
    threshold's Jaccard similarity, else it leads a new one. A query's candidates are few (the
    retrieval depth), so each query is one call that sees its rows once. Texts without words lead
    clusters of their own.
    """
    rows = candidates.withColumn("_words", F.array_distinct(T.tokens(F.col("text"))))

    def lead(pdf):
        pdf = pdf.sort_values(["rank", "doc_id"], ignore_index=True)
        leaders: list[set] = []
        ids = []
        for words in map(set, pdf["_words"]):
            at = next((i for i, x in enumerate(leaders) if words and x and len(words & x) / len(words | x) >= threshold), len(leaders))
            if at == len(leaders):
                leaders.append(words)
            ids.append(at)
        return pdf.drop(columns="_words").assign(cluster_id=ids)

    return rows.groupBy("query_id").applyInPandas(lead, StructType([*candidates.schema.fields, StructField("cluster_id", IntegerType())]))


def cluster_stats(clustered: DataFrame) -> DataFrame:
    """Per query and cluster: size, documents in order and how many are poisoned (is_adv)."""
    return clustered.groupBy("query_id", "cluster_id").agg(
        F.count("*").alias("size"), F.sort_array(F.collect_list("doc_id")).alias("doc_ids"), F.count_if("is_adv").alias("adv_doc_count")
    )


def cap_clusters(clustered: DataFrame, cap: int, k: int) -> DataFrame:
    """At most ``cap`` candidates of a cluster and k of a query, in rank order; ranks are given anew."""
    by_cluster = Window.partitionBy("query_id", "cluster_id").orderBy("rank")
    kept = clustered.withColumn("_n", F.row_number().over(by_cluster))
    if cap > 0:
        kept = kept.where(F.col("_n") <= cap)
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("rank", "_n").withColumnRenamed("_r", "rank")
