"""The evidence pipeline: gates, clusters, mentions, scores, then the choice of documents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators import choose, cluster, mentions, score, select, support
from gristmill.sources.store import stored


@dataclass(frozen=True)
class HardenConfig:
    threshold: float = 0.72
    most_mentions: int = 5
    reader_heuristics: int = 2
    focused: bool = False
    mode: str = "support"
    provenance_gate: bool = False
    authority_gate: bool = False
    use_echo: bool = True
    use_grounding: bool = True
    choose: choose.ChooseConfig = field(default_factory=choose.ChooseConfig)
    echo: score.EchoConfig = field(default_factory=score.EchoConfig)
    grounding: score.GroundingConfig = field(default_factory=score.GroundingConfig)
    scores: score.ScoreConfig = field(default_factory=score.ScoreConfig)


@dataclass
class Hardened:
    """What the pipeline gives, all by query: documents, what they say against each other, the answers behind it, and what each step of the choice noted."""

    documents: DataFrame
    conflicts: DataFrame
    answers: DataFrame
    references: DataFrame | None
    trace: DataFrame


def features(candidates: DataFrame, queries: DataFrame, c: HardenConfig) -> DataFrame:
    """candidates (query_id, doc_id, rank, text, channels, provenance) with clusters, mentions and penalties; texts go.

    queries may bring answers, an array of (kind, answer), for reference mentions. candidates may
    bring reader, a model's mentions, which come before the heuristic ones.
    """
    known = [x for x in ("answers",) if x in queries.columns]
    rows = cluster.leader_clusters(candidates, c.threshold).join(queries.select("query_id", "query", *known), "query_id")
    find = mentions.focused_mentions if c.focused else mentions.raw_mentions
    query, text = F.col("query"), F.col("text")
    none = F.struct(F.lit(0).alias("overlap"), F.lit(0.0).alias("coverage"), F.lit(0).alias("content_tokens"), F.lit(False).alias("low"), F.lit(0.0).alias("penalty"))
    rows = rows.withColumns(
        {
            "mentions": mentions.merge_mentions(F.col("reader"), find(query, text, c.most_mentions), c.reader_heuristics, c.most_mentions)
            if "reader" in candidates.columns
            else find(query, text, c.most_mentions),
            "echo_penalty": score.echo_penalty(score.echo_stats(query, text, c.echo), c.echo) if c.use_echo else F.lit(0.0),
            "ground": score.grounding(query, text, c.grounding) if c.use_grounding else none,
        }
    )
    if known:
        rows = rows.withColumn("reference", mentions.reference_mentions(text, F.col("answers"))).drop("answers")
    return rows.withColumn("low_grounding", F.col("ground.low")).drop("text", "query")


def rescored(rows: DataFrame, c: HardenConfig) -> DataFrame:
    """rows with score: by evidence for queries whose candidates mention too little, else by answers' support."""
    if c.mode == "robust":
        other = score.robust_score(rows, c.scores, c.grounding)
    else:
        other = score.support_score(rows, support.answer_support(rows, c.scores.use_grounding), c.scores)
    return score.by_mode(rows, support.coverage(rows), score.evidence_score(rows, c.scores, c.grounding), other)


def top_answers(rows: DataFrame, most: int = 10) -> DataFrame:
    """The answers of each query that most clusters, then documents, back: at most ``most``, with their place."""
    order = Window.partitionBy("query_id").orderBy(F.desc("cluster_count"), F.desc("doc_count"), "answer_key")
    found = support.answer_support(rows).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return found.select("query_id", "place", "answer_key", "label", "doc_count", "cluster_count", "mention_count")


def harden(candidates: DataFrame, queries: DataFrame, k: int, c: HardenConfig = HardenConfig(), required: DataFrame | None = None) -> Hardened:
    """The k documents of each query to show, placed 1 to k, and what the candidates and they say.

    Gated documents leave gaps in rank, as ranks are those of retrieval. What later steps read
    (depth rows a query, without texts) is written once after the features and once after the
    scores, so no step's plan holds another's. queries may also bring policy_margin and
    policy_high for the margin gate.
    """
    rows = candidates
    if c.provenance_gate:
        rows = select.provenance_gate(rows).where("eligible").drop("eligible", "provenance_class")
    if c.authority_gate and required is not None:
        rows = select.authority_gate(rows, required)
    rows = stored(features(rows, queries, c))
    rows = stored(rescored(rows, c))
    trace = stored(choose.traced(rows, queries, k, c.choose))
    shown = rows.drop("score").join(choose.shown(trace), ["query_id", "doc_id"])
    references = support.reference_support(rows) if "reference" in rows.columns else None
    return Hardened(shown, support.contradiction(rows, shown), top_answers(rows), references, trace)
