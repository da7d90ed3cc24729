"""Settings from a configuration, and a run over the given tables."""

import json

import pytest
from pyspark.sql import functions as F

from gristmill.operators import choose
from gristmill.plans import harden, queries, run

SF = "/root/testdata/sf0.001"


def test_settings():
    assert run.hardening({}).choose == choose.ChooseConfig() and not run.hardening({}).use_echo
    c = run.hardening({"cluster": {"cap": 2, "jaccard_threshold": 0.5}, "answer_support": {"max_docs_per_answer": 2, "grounding_enabled": True, "diversity_bonus": 0.01}, "contradiction": {"min_conflict_answers": 3},
                       "margin_gate": {"enabled": True, "threshold": 1, "window": 8}, "constrained_selection": {"enabled": True}, "head_filter": {"enabled": True, "mode": "open"}, "rank_guard": {"enabled": True, "top_n": 2}})
    assert (c.threshold, c.choose.per_cluster, c.choose.per_answer, c.use_grounding, c.scores.bonus, c.scores.min_conflict) == (0.5, 2, 2, True, 0.01, 3)
    gate = c.choose.margin
    assert (gate.window, gate.last_supplement, gate.only_if_weak, gate.echo_extra, gate.low_extra) == (8, 8, False, 0.0, 0.0)  # the simple mode
    assert (gate.context.threshold, gate.context.max_threshold, gate.context.dynamic, gate.context.min_conflict) == (1.0, 1.75, False, 3)
    assert (c.choose.greedy.pool, c.choose.greedy.per_cluster, c.choose.greedy.per_answer) == (8, 2, 2) and not c.choose.head.conservative and c.choose.guard.top_n == 2
    full = run.hardening({"margin_gate": {"enabled": True, "mode": "complex"}}).choose.margin
    assert full == choose.MarginGateConfig() and c.choose.top1 is None


def test_run(spark):
    made = queries.configured(spark, SF)
    rows = made.summary.collect()
    assert len(rows) == 1 and rows[0].top_k == 5 and rows[0].head_filter_enabled and 0 <= rows[0].margin_gate_trigger_rate <= 1
    results = made.results.collect()
    assert all(1 <= r.rank <= 5 for r in results) and len({(r.query_id, r.rank) for r in results}) == len(results)
    own = {(r.query_id, r.doc_id) for r in queries.poison(spark, SF).collect()}
    assert all(r.hit == ((r.query_id, r.doc_id) in own) for r in results)
    assert rows[0].num_queries == len({r.query_id for r in results}) == made.prompts.count() == made.trace.count()
    texts = {r.doc_id: r.text for r in queries.docs(spark, SF).collect()}
    prompts = {r.query_id: r.prompt for r in made.prompts.collect()}
    assert all((texts[r.doc_id] or "") in prompts[r.query_id] for r in results)
