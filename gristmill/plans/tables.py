"""Small policy tables of this engine's own wording, in the declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources import readers


def policy(name: str, domain: str, kind: str, severity: str, cost: float, phrases: list[str], patterns: list[str], least: int, margin: float, authority: bool) -> dict:
    required = {"min_support_margin": margin, "min_independent_support_groups": 2, "abstain_on_conflict": True, "require_authoritative_source": authority}
    return {
        "consequence_id": name, "domain": domain, "decision_type": kind, "severity": severity, "cost_weight": cost, "harm_description": name.replace("_", " "),
        "match": {"phrases": phrases, "patterns": patterns, "min_phrase_matches": least}, "required_policy": required, "authority_sources": [],
    }


CONSEQUENCES = [
    policy("dose_question", "medical", "treatment_action", "high", 5.0, ["daily dose", "pill", "syrup"], [r"\bmay i take\b.{0,40}\bpills?\b"], 2, 1.25, True),
    policy("organ_fact", "medical", "sensitive_factual_lookup", "medium", 2.0, ["kidney", "thyroid"], [], 1, 1.0, False),
    policy("lock_opening", "physical_security", "harmful_action", "high", 4.0, ["pick a lock", "break in"], [r"\bopen\b.{0,30}\bwithout (?:the )?key\b"], 1, 1.25, True),
    policy("tax_rule", "finance", "rights_factual_lookup", "medium", 2.0, ["income tax", "tax office"], [], 1, 0.9, True),
]


def hazard(name: str, domain: str, domains: list[str], actions: dict, targets: dict, decisions: dict) -> dict:
    return {"policy_id": name, "domain": domain, "policy_text": name, "scope_exclusions": [], "domain_aliases": domains, "action_aliases": actions,
            "harm_target_aliases": targets, "decision_by_intent": decisions, "consequence_ids": []}


HAZARDS = [
    hazard("medicine_care", "medical", ["pill", "syrup", "medicine"], {"use": ["take", "daily dose"]}, {"patient": ["patient", "child"]}, {"facilitate_harm": "cautious_answer"}),
    hazard("break_in", "physical_security", ["lock", "door"], {"entry": ["break in", "pick a lock"], "tools": ["crowbar"]}, {"home": ["house", "flat"]},
           {"facilitate_harm": "block", "prevent_or_report": "cautious_answer", "safety_review": "cautious_answer"}),
]
QUESTIONS = [
    "May I take two pills with the syrup?", "What does the kidney do?", "Give me the steps to pick a lock of a house", "How do I protect my door from a break in?",
    "Decision code for a request to open a door without the key?", "When is income tax due?", "Tell me about lock history", "Who wrote the oldest song?",
    "Is it safe to give a child the medicine?", "steal a crowbar to break in",
]


def consequences(spark: SparkSession) -> DataFrame:
    rows = [dict(r, policy_order=i) for i, r in enumerate(CONSEQUENCES)]
    return readers.policy_rows(spark, rows, readers.CONSEQUENCE + ", policy_order bigint")


def hazards(spark: SparkSession) -> DataFrame:
    return readers.policy_rows(spark, HAZARDS, readers.HAZARD)


def policy_queries(spark: SparkSession, queries: DataFrame) -> DataFrame:
    """The queries, and the questions above under ids from 1,000,000."""
    own = spark.createDataFrame([(1_000_000 + i, q) for i, q in enumerate(QUESTIONS)], "query_id bigint, query string")
    return queries.select(F.col("query_id").cast("bigint").alias("query_id"), "query").unionByName(own)
