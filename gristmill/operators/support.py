"""How many documents, clusters and channels stand behind each answer.

Candidates are (query_id, doc_id, rank, cluster_id, channels, mentions, ...); echo_penalty and
low_grounding, where present, say which documents copy the query or miss its topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded(candidates: DataFrame, primary_only: bool = False) -> DataFrame:
    """A row per mention (or per first mention) with answer_key, label and position."""
    if primary_only:
        rows = candidates.where(F.size("mentions") > 0).withColumn("m", F.element_at("mentions", 1)).withColumn("position", F.lit(0))
    else:
        rows = candidates.select("*", F.posexplode("mentions").alias("position", "m"))
    return rows.withColumns({"answer_key": F.col("m.key"), "label": F.col("m.label")}).drop("m")


def distinct(column: str, condition: Column | None = None) -> Column:
    return F.count_distinct(F.col(column) if condition is None else F.when(condition, F.col(column)))


def channel_count() -> Column:
    return F.size(F.array_distinct(F.flatten(F.collect_list("channels")))).cast("long")


def first_label() -> Column:
    return F.min_by("label", F.struct("rank", "position"))


def answer_support(candidates: DataFrame, grounded_only: bool = False) -> DataFrame:
    """Per query and answer: documents, clusters, channels, mentions and the first label."""
    rows = candidates.where(~F.col("low_grounding")) if grounded_only else candidates
    return exploded(rows).groupBy("query_id", "answer_key").agg(
        first_label().alias("label"),
        distinct("doc_id").alias("doc_count"),
        distinct("cluster_id").alias("cluster_count"),
        channel_count().alias("channel_count"),
        F.count("*").alias("mention_count"),
    )


def reference_support(candidates: DataFrame) -> DataFrame:
    """Per query and kind of known answer: documents, clusters and labels."""
    rows = candidates.select("query_id", "doc_id", "cluster_id", F.explode("reference").alias("m"))
    return rows.groupBy("query_id", F.col("m.kind").alias("kind")).agg(
        distinct("doc_id").alias("doc_count"), distinct("cluster_id").alias("cluster_count"), F.sort_array(F.collect_set("m.label")).alias("labels")
    )


def is_echo() -> Column:
    return (F.col("echo_penalty") > 0) | F.col("low_grounding")


def robust_support(candidates: DataFrame, primary_only: bool = False) -> DataFrame:
    """answer_support with clusters free of echo, grounded clusters, and echo and off-topic documents.

    With primary_only each document counts for its first mention alone, with ranks and best score.
    """
    extra = [F.sort_array(F.collect_list("rank")).alias("ranks"), F.min("rank").alias("best_rank"), F.max("score").alias("best_score")] if primary_only else []
    return exploded(candidates, primary_only).groupBy("query_id", "answer_key").agg(
        first_label().alias("label"),
        distinct("doc_id").alias("doc_count"),
        distinct("cluster_id").alias("cluster_count"),
        channel_count().alias("channel_count"),
        distinct("cluster_id", ~is_echo()).alias("non_echo_clusters"),
        distinct("cluster_id", ~F.col("low_grounding")).alias("grounded_clusters"),
        distinct("doc_id", is_echo()).alias("echo_docs"),
        distinct("doc_id", F.col("low_grounding")).alias("low_grounding_docs"),
        *extra,
    )


def coverage(candidates: DataFrame, min_coverage: float = 0.25, min_answers: int = 1) -> DataFrame:
    """Per query: how much the candidates mention, and whether to score by evidence instead, with the reason."""
    docs = candidates.groupBy("query_id").agg(
        F.count("*").alias("doc_count"), F.count_if(F.size("mentions") > 0).alias("mentioned_doc_count"), F.sum(F.size("mentions")).alias("mention_count")
    )
    answers = answer_support(candidates.select("query_id", "doc_id", "cluster_id", "rank", "channels", "mentions")).groupBy("query_id").agg(
        F.count("*").alias("unique_answer_count"), F.max("doc_count").alias("max_doc_count"), F.max("cluster_count").alias("max_cluster_count")
    )
    rows = docs.join(answers, "query_id", "left").na.fill(0)
    rows = rows.withColumn("doc_coverage", F.col("mentioned_doc_count") / F.col("doc_count"))
    reason = (
        F.when(F.col("doc_coverage") < min_coverage, "low_answer_doc_coverage")
        .when(F.col("unique_answer_count") < min_answers, "too_few_unique_answers")
        .otherwise("answer_support_sufficient")
    )
    return rows.withColumn("reason", reason).withColumn("evidence_mode", F.col("reason") != "answer_support_sufficient")


def head_stats(accepted: DataFrame, head_k: int = 3) -> DataFrame:
    """Per query and first answer: documents, clusters, and how many sit in the head and behind it (by position)."""
    return exploded(accepted, True).groupBy("query_id", "answer_key").agg(
        distinct("doc_id").alias("doc_count"),
        distinct("cluster_id").alias("cluster_count"),
        F.count_if(F.col("place") <= head_k).alias("head_count"),
        F.count_if(F.col("place") > head_k).alias("supplement_count"),
        F.min("place").alias("best_rank"),
    )


def margin_scores(stats: DataFrame, cluster=1.0, channel=0.25, echo=0.75, isolated=0.5, conflict=0.25) -> DataFrame:
    """robust_support(primary_only) with independent clusters, echo ratio, support_score and place among the query's answers."""
    w = Window.partitionBy("query_id")
    rows = stats.withColumn("independent", F.when(F.col("non_echo_clusters") > 0, F.col("non_echo_clusters")).otherwise(F.col("cluster_count")))
    rows = rows.withColumns({"echo_ratio": F.col("echo_docs") / F.col("doc_count"), "isolated": F.col("cluster_count") <= 1})
    gap = F.max("independent").over(w) - F.col("independent")
    score = (
        cluster * F.col("independent")
        + channel * F.greatest(F.col("channel_count") - 1, F.lit(0))
        - echo * F.col("echo_ratio")
        - isolated * F.col("isolated").cast("int")
        - conflict * gap
    )
    rows = rows.withColumn("support_score", F.round(score, 9))
    order = w.orderBy(F.desc("support_score"), F.desc("independent"), F.desc("cluster_count"), F.desc("channel_count"), "best_rank", "answer_key")
    return rows.withColumn("place", F.row_number().over(order))


def contradiction(candidates: DataFrame, accepted: DataFrame, min_answers: int = 2) -> DataFrame:
    """Per query what kind of conflict the accepted documents show, with the counts that it rests on.

    Answers are those of first mentions. top1_support_margin is the best other answer's lead over
    the first document's answer, so a positive one speaks against it.
    """
    supported = (F.col("non_echo_clusters") >= 2) | (F.col("cluster_count") >= 2)
    top = accepted.where(F.col("place") == 1).select("query_id", F.get(F.col("mentions"), F.lit(0))["key"].alias("top1_answer"))
    rows = robust_support(accepted, True).join(top, "query_id", "left").withColumn("is_top", F.coalesce(F.col("answer_key") == F.col("top1_answer"), F.lit(False)))
    names = {"cluster_count": "cluster_count", "non_echo_clusters": "non_echo_cluster_count", "channel_count": "channel_count", "doc_count": "doc_count", "echo_docs": "query_echo_doc_count"}
    of_top = [F.max(F.when(F.col("is_top"), F.col(c))).alias(f"top1_{name}") for c, name in names.items()]
    best = [F.max(c).alias(f"selected_max_{names[c]}") for c in ("non_echo_clusters", "cluster_count", "channel_count")]
    others = [F.max(F.when(~F.col("is_top"), F.col(c))).alias(f"best_alternative_{names[c]}") for c in ("non_echo_clusters", "cluster_count")]
    summed = rows.groupBy("query_id").agg(
        F.count("*").alias("selected_answer_count"),
        F.count_if(supported).alias("supported_answer_count"),
        F.count_if(F.col("cluster_count") <= 1).alias("isolated_selected_answer_count"),
        F.count_if(F.col("non_echo_clusters") == 0).alias("query_echo_only_answer_count"),
        *of_top, *best, *others, F.max("is_top").alias("has_top"),
    )
    wide = robust_support(candidates, True).groupBy("query_id").agg(F.count("*").alias("candidate_answer_count"), F.count_if(supported).alias("candidate_supported_answer_count"))
    rows = candidates.select("query_id").distinct().join(wide, "query_id", "left").join(summed, "query_id", "left").join(top, "query_id", "left")
    rows = rows.na.fill(0).na.fill(False)
    of = F.col
    conflict = of("selected_answer_count") >= min_answers
    isolated = of("has_top") & (of("top1_cluster_count") <= 1)
    has_best = of("has_top") & (of("top1_non_echo_cluster_count") >= of("selected_max_non_echo_cluster_count")) & (of("top1_cluster_count") >= of("selected_max_cluster_count"))
    alternative = (of("best_alternative_non_echo_cluster_count") >= 2) | (of("best_alternative_cluster_count") >= 2)
    flags = {
        "top1_isolated_with_alternative": conflict & isolated & alternative,
        "top1_not_best_support": conflict & of("has_top") & ~has_best,
        "multi_supported_conflict": conflict & (of("supported_answer_count") >= 2),
        "no_strong_answer": conflict & (of("supported_answer_count") == 0),
    }
    kind = F.when(~conflict, "none")
    for name, flag in flags.items():
        kind = kind.when(flag, name)
    clusters, free = (of(f"best_alternative_{x}") - of(f"top1_{x}") for x in ("cluster_count", "non_echo_cluster_count"))
    counts = [c for c in rows.columns if c.endswith("_count")]
    return rows.select(
        "query_id", "top1_answer", *counts, conflict.alias("conflict_detected"), (of("candidate_answer_count") >= min_answers).alias("candidate_conflict_detected"),
        isolated.alias("top1_isolated"), has_best.alias("top1_has_best_support"), F.when(free == 0, clusters).otherwise(free).alias("top1_support_margin"),
        *(flag.alias(name) for name, flag in flags.items()), flags["no_strong_answer"].alias("severe_conflict"), kind.otherwise("weak_conflict").alias("conflict_type"),
    )
