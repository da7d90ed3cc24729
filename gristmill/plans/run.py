"""A run from one JSON configuration: retrieval, poison, the evidence pipeline, metrics, prompts and the run's summary row."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import choose, evaluate, score, summary
from gristmill.plans import harden, retrievers
from gristmill.sources.store import few, stored

# The configuration's keys, by section, and the field that each sets. Defaults are those of the fields.
GUARD = {"top_n": "top_n", "min_promotion_margin": "min_margin", "max_promotion_original_rank": "most_rank", "min_answer_clusters": "min_clusters"}
TOP1 = {
    "window": "window", "min_conflict_answers": "min_conflict", "isolated_cluster_threshold": "isolated_clusters", "alternative_cluster_threshold": "alternative_clusters",
    "penalty": "penalty", "supported_answer_bonus": "bonus", "query_echo_extra_penalty": "echo_extra", "max_supplement_rank": "supplement_rank",
}
HEAD = {
    "head_k": "head", "supplement_k": "supplement", "min_conflict_answers": "min_conflict", "independent_support_threshold": "supported_clusters", "isolated_penalty": "isolated_penalty",
    "supported_answer_bonus": "supported_bonus", "supplement_bonus": "supplement_bonus", "protect_rank1": "protect_first", "allow_supplement_new_answers": "new_answers",
    "max_supplement_promotion_rank": "supplement_rank", "high_risk_abstain": "abstain",
}
MARGIN = {
    "window": "window", "top_answer_penalty": "penalty", "alternative_bonus": "bonus", "supplement_bonus": "supplement", "echo_doc_extra_penalty": "echo_extra",
    "low_grounding_extra_penalty": "low_extra", "min_supplement_rank": "first_supplement", "max_supplement_rank": "last_supplement", "penalize_top_only_if_weak": "only_if_weak",
    "preserve_rank1_if_no_alternative": "keep_if_no_alternative", "fallback_answer_when_clean": "keep_if_clean", "high_risk_abstain": "abstain",
}
CONTEXT = {
    "threshold": "threshold", "max_threshold": "max_threshold", "dynamic_threshold": "dynamic", "weak_independent_clusters": "weak_clusters", "weak_channel_count": "weak_channels",
    "echo_ratio_threshold": "echo_ratio", "strong_alternative_min_clusters": "strong_clusters", "min_conflict_answers": "min_conflict", "weak_top_delta": "weak_delta",
    "echo_top_delta": "echo_delta", "multi_supported_delta": "multi_delta", "no_strong_answer_delta": "no_strong_delta", "high_risk_delta": "high_risk_delta", "max_alternatives": "alternatives",
}
GREEDY = {
    "pool_depth": "pool", "max_cluster_docs": "per_cluster", "max_answer_docs": "per_answer", "max_query_overlap_docs": "echo_docs", "duplicate_cluster_penalty": "cluster_penalty",
    "answer_concentration_penalty": "answer_penalty", "query_overlap_concentration_penalty": "echo_penalty", "low_margin_answer_penalty": "low_margin_penalty",
    "isolated_rank1_penalty": "isolated_penalty", "support_bonus": "support_bonus", "channel_bonus": "channel_bonus", "new_answer_cluster_bonus": "new_cluster_bonus", "min_gain": "min_gain",
}
ECHO = {
    "mode": "mode", "prefix_window_tokens": "window", "overlap_threshold": "overlap", "ngram_n": "n", "ngram_overlap_threshold": "ngram_overlap", "min_novelty_tokens": "min_novel",
    "min_novelty_ratio": "min_novelty", "exact_prefix_penalty": "prefix_penalty", "high_overlap_penalty": "overlap_penalty", "query_copy_enabled": "query_copy",
    "textual_cues_enabled": "textual_cues", "assertion_penalty": "assertion_penalty", "instruction_penalty": "instruction_penalty", "short_assertion_doc_tokens": "short_tokens",
    "short_assertion_extra_penalty": "short_extra", "untrusted_claim_penalty": "untrusted_penalty",
}
GROUNDING = {
    "grounding_min_query_coverage": "min_coverage", "grounding_min_overlap": "min_overlap", "grounding_short_doc_token_threshold": "short_tokens", "grounding_low_support_penalty": "low_penalty",
    "grounding_short_doc_penalty": "short_penalty",
}
SCORES = {
    "diversity_bonus": "bonus", "duplicate_cluster_penalty": "duplicate", "max_bonus_clusters": "most_clusters", "robust_channel_bonus": "channel",
    "robust_query_echo_support_penalty": "echo_support", "robust_isolated_answer_penalty": "isolated", "evidence_mode_grounding_bonus": "grounding_bonus",
    "evidence_mode_query_coverage_bonus": "coverage_bonus", "evidence_mode_singleton_cluster_bonus": "singleton",
}


def filled(kind: type, keys: dict[str, str], given: dict[str, Any], **defaults: Any):
    """A settings object of that kind from a section's values, each cast to its field's type."""
    types = {f.name: type(f.default) for f in fields(kind)}
    values = defaults | {field: given[key] for key, field in keys.items() if given.get(key) is not None}
    return kind(**{field: types[field](value) if types[field] in (int, float, bool, str) else value for field, value in values.items()})


def hardening(config: dict[str, Any]) -> harden.HardenConfig:
    """The evidence pipeline's settings from its section; a step without ``enabled`` is left out."""
    of = lambda name: config.get(name) or {}
    answers, cluster, contradiction, margin, echo = map(of, ("answer_support", "cluster", "contradiction", "margin_gate", "query_echo"))
    cap = int(cluster.get("cap", 1)) if cluster.get("enabled", True) else 0
    per_answer = int(answers.get("max_docs_per_answer", 0)) if answers.get("enabled", True) else 0
    conflict = int(contradiction.get("min_conflict_answers", 2))
    full, window = str(margin.get("mode", "simple")).lower() == "complex", int(margin.get("window", 10))
    threshold = float(margin.get("threshold", 0.75))
    extra = {} if full else {"echo_extra": 0.0, "low_extra": 0.0}
    gate = None
    if margin.get("enabled", False):
        context = filled(score.MarginConfig, CONTEXT, margin, dynamic=full, max_threshold=threshold + 0.75, min_conflict=conflict)
        gate = filled(choose.MarginGateConfig, MARGIN, margin | ({} if full else {"echo_doc_extra_penalty": 0.0, "low_grounding_extra_penalty": 0.0}), only_if_weak=full, last_supplement=window, context=context, **extra)
    head = of("head_filter")
    on = lambda name, kind, keys, **defaults: filled(kind, keys, of(name), **defaults) if of(name).get("enabled", False) else None
    steps = choose.ChooseConfig(
        per_cluster=cap, per_answer=per_answer, guard=on("rank_guard", choose.GuardConfig, GUARD), top1=on("top1_dominance", choose.Top1Config, TOP1), margin=gate,
        head=on("head_filter", choose.HeadConfig, HEAD, conservative=str(head.get("mode", "conservative")).lower() == "conservative"),
        greedy=on("constrained_selection", choose.GreedyConfig, GREEDY, pool=window, per_cluster=max(1, cap), per_answer=per_answer, min_conflict=conflict),
    )
    grounded = bool(answers.get("grounding_enabled", False))
    conflict_penalty = float(contradiction.get("conflict_penalty", 0.004)) if contradiction.get("enabled", True) else 0.0
    scores = filled(score.ScoreConfig, SCORES, answers, rank_k=int(config.get("rank_k", 60)), conflict=conflict_penalty, min_conflict=conflict, use_grounding=grounded)
    return harden.HardenConfig(
        threshold=float(cluster.get("jaccard_threshold", 0.72)), most_mentions=int(answers.get("max_mentions_per_doc", 5)), focused=bool(answers.get("use_query_focus", False)),
        mode=str(answers.get("answer_scoring_mode", "support")).lower(), provenance_gate=bool(of("provenance_gate").get("enabled", False)),
        authority_gate=bool(of("consequence_policy").get("enforce_authoritative_source", False)), use_echo=bool(echo.get("enabled", False)), use_grounding=grounded,
        reader_heuristics=int(answers.get("qa_heuristic_top_k", 2)), choose=steps, echo=filled(score.EchoConfig, ECHO, echo), grounding=filled(score.GroundingConfig, GROUNDING, answers), scores=scores,
    )


def read_config(spark: SparkSession, path: str) -> dict[str, Any]:
    """A configuration file, which is small, by Spark's reader, so that it may be wherever the data are."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


@dataclass
class Run:
    """results (query_id, doc_id, rank, score, support_count, hit), prompts (query_id, prompt), trace (null without hardening) and summary, one row."""

    results: DataFrame
    prompts: DataFrame
    trace: DataFrame | None
    summary: DataFrame


def run(config: dict[str, Any], given: retrievers.Inputs, poison: DataFrame, responses: DataFrame | None = None, run_id: str = "run") -> Run:
    """What a configuration says, over the given tables.

    The retriever gives the candidates (candidate_depth where they are hardened, else top_k), the
    evidence section chooses top_k of them, and these are the run's results. poison (query_id,
    doc_id) is what counts as a hit. responses (ord, response, incorrect_answer), if there are any, give attack success.
    """
    evidence, k = config.get("evidence_hardening") or {}, int(config.get("top_k", 5))
    kind = str((config.get("retriever") or {}).get("type", "dense")).lower()
    on = bool(evidence.get("enabled", False))
    depth = max(k, int(evidence.get("candidate_depth", 30))) if on else k
    found = stored(retrievers.build(config.get("retriever") or {}, given, depth))
    texts = given.documents.select("doc_id", "text", *(["provenance"] if "provenance" in given.documents.columns else []))
    channels = F.map_keys("channels") if "channels" in found.columns else F.array(F.lit(kind))
    support = F.col("support_count") if "support_count" in found.columns else F.lit(1)
    found = found.select("query_id", "doc_id", "rank", "score", channels.alias("channels"), support.cast("int").alias("support_count"))
    trace = None
    if on:
        rows = few(found).join(texts, "doc_id")
        rows = rows if "provenance" in rows.columns else rows.withColumn("provenance", F.lit("indexed_corpus"))
        hardened = harden.harden(rows.drop("support_count"), given.queries, k, hardening(evidence), required=given.queries if "require_authority" in given.queries.columns else None)
        trace = hardened.trace
        chosen = hardened.documents.select("query_id", "doc_id", F.col("place").alias("rank"), "score")
        results = chosen.join(found.select("query_id", "doc_id", "support_count"), ["query_id", "doc_id"])
    else:
        results = found.drop("channels")
    results = stored(evaluate.poison_hits(results, poison))
    contexts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    shown = few(results).join(texts.select("doc_id", "text"), "doc_id").groupBy("query_id").agg(contexts.alias("contexts"))
    prompts = given.queries.select("query_id", "query").join(shown, "query_id").select("query_id", T.prompt(F.col("query"), F.col("contexts")).alias("prompt"))
    spark = results.sparkSession
    alpha = (config.get("retriever") or {}).get("alpha")
    row = (run_id, str(config.get("dataset", "nq")), kind, float(alpha) if alpha is not None else None, k, *(int(config.get(x, d)) for x, d in (("adv_per_query", 5), ("M", 10), ("repeat_times", 10))))
    runs = spark.createDataFrame([row], "run_id string, dataset string, retriever string, alpha double, top_k int, adv_per_query int, per_iteration int, repeat_times int")
    facts = results.withColumn("run_id", F.lit(run_id))
    hits = facts.where(F.col("rank") <= k).groupBy("run_id", "query_id").agg(F.count_if("hit").alias("hits"))
    said = responses.withColumn("run_id", F.lit(run_id)) if responses is not None else None
    made = summary.run_summary(runs, hits, facts, said, traces=trace.withColumn("run_id", F.lit(run_id)) if trace is not None else None)
    return Run(results, prompts, trace, made)
