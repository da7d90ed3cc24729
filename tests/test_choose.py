"""The steps of choosing documents on cases worked out by hand, and the whole pipeline over them."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gristmill.operators import choose as ch
from gristmill.plans import harden, queries

SF = "/root/testdata/sf0.001"


def row(doc, rank, score, cluster, *keys, channels=("bm25",), echo=0.0, low=False):
    return ch.Row(doc, rank, score, cluster, list(keys), list(channels), echo, low)


def names(rows):
    return "".join(r.doc for r in rows)


def test_guard_puts_the_first_back():
    rows = [row("b", 2, 0.5, 0, "x"), row("a", 1, 0.4999, 1, "y"), row("c", 3, 0.3, 2, "x")]
    assert names(ch.guarded(rows, ch.GuardConfig())) == "abc"  # a lead below the margin
    assert rows[0].flags == {"guard_blocked"}
    rows = [row("b", 2, 0.5, 0, "x"), row("a", 1, 0.4, 1, "y")]
    assert names(ch.guarded(rows, ch.GuardConfig())) == "ba"
    assert names(ch.guarded(rows, ch.GuardConfig(min_clusters=2))) == "ab"  # one cluster backs x
    assert names(ch.guarded([row("b", 25, 0.5, 0, "x"), row("a", 1, 0.4, 1, "y")], ch.GuardConfig())) == "ab"  # from too far behind
    assert names(ch.guarded([row("b", 2, 0.5, 0), row("a", 1, 0.4, 1, "y")], ch.GuardConfig())) == "ab"  # no answer


def test_guard_of_several_places_moves_each_to_the_front():
    rows = [row("c", 3, 0.5, 0, "x"), row("d", 4, 0.4999, 1, "x"), row("a", 1, 0.4998, 2, "x"), row("b", 2, 0.4997, 3, "x")]
    # a comes before c; then place 2 holds c in place of b, so b goes to the very front.
    assert names(ch.guarded(list(rows), ch.GuardConfig(top_n=2))) == "bacd"
    assert names(ch.guarded(list(rows), ch.GuardConfig(top_n=1))) == "acdb"


def test_caps_in_turn():
    rows = [row("a", 1, 5, 0, "x"), row("b", 2, 4, 0, "y"), row("c", 3, 3, 1, "x"), row("d", 4, 2, 2, "y"), row("e", 5, 1, 3)]
    assert names(ch.capped(rows, 5, 1, 1)) == "ade"  # b is turned down by its cluster, so y is still free
    assert names(ch.capped(rows, 2, 1, 1)) == "ad" and names(ch.capped(rows, 5, 0, 0)) == "abcde"


def test_lone_top_loses():
    rows = [row("a", 1, 0.5, 0, "x", echo=0.01), row("b", 2, 0.49, 1, "y"), row("c", 3, 0.48, 2, "y"), row("d", 4, 0.1, 3)]
    out = ch.without_lone_top(list(rows), 4, ch.Top1Config())
    assert names(out) == "bcad" and rows[0].score == pytest.approx(0.467) and rows[1].score == 0.49  # the bonus only orders
    backed = [row("a", 1, 0.5, 0, "x"), row("b", 2, 0.49, 1, "x"), row("c", 3, 0.48, 2, "y")]
    assert names(ch.without_lone_top(backed, 3, ch.Top1Config())) == "abc" and not backed[0].flags
    lone = [row("a", 1, 0.5, 0, "x"), row("b", 2, 0.4, 1, "y")]
    assert names(ch.without_lone_top(lone, 2, ch.Top1Config())) == "ab" and lone[0].score == pytest.approx(0.475)  # also without an alternative
    far = [row("a", 1, 0.5, 0, "x"), row("b", 2, 0.3, 1, "z"), row("c", 3, 0.3, 2, "w"), row("d", 4, 0.499, 3, "y"), row("e", 5, 0.498, 4, "y")]
    assert names(ch.without_lone_top(far, 5, ch.Top1Config(supplement_rank=3))) == "abdec"  # supplements wait until place 3


def test_margin_gate():
    c = ch.ChooseConfig(margin=ch.MarginGateConfig())
    rows = [row("a", 1, 0.5, 0, "x"), row("b", 2, 0.49, 1, "y"), row("c", 3, 0.3, 2, "z"), row("d", 4, 0.485, 1, "y")]
    out = ch.with_margin(rows[:3], rows, 3, c, False, 0.0)
    assert names(out) == "dac"  # d wins as a supplement, b is of its cluster
    assert all("margin_triggered" in r.flags for r in rows)
    sure = [row("a", 1, 0.5, 0, "x"), row("b", 2, 0.49, 1, "x"), row("c", 3, 0.3, 2, "x"), row("d", 4, 0.2, 3, "y")]
    assert names(ch.with_margin(list(sure), sure, 4, c, False, 0.0)) == "abcd" and not sure[0].flags
    held = replace(c, margin=replace(c.margin, context=replace(c.margin.context, max_threshold=9.0)))
    assert names(ch.with_margin(list(sure), sure, 4, held, False, 5.0)) and sure[0].flags  # a policy's floor


def test_margin_scores_move_and_stay():
    rows = [row("a", 1, 0.5, 0, "x"), row("b", 2, 0.49, 1, "y"), row("d", 4, 0.485, 2, "z")]
    ch.with_margin(rows[:2], rows, 2, ch.ChooseConfig(margin=ch.MarginGateConfig()), False, 0.0)
    top, close = rows[0].score, {r.doc: r.score for r in rows[1:]}
    assert top == pytest.approx(0.48) and close == {"b": pytest.approx(0.502), "d": pytest.approx(0.509)}  # d is a supplement of rank 4


def test_head_filter():
    rows = [row("a", 1, 0.5, 0, "x"), row("b", 2, 0.49, 1, "y"), row("c", 3, 0.48, 2, "z"), row("d", 4, 0.475, 3, "z"), row("e", 5, 0.1, 4)]
    out = ch.with_head(list(rows), 5, ch.HeadConfig())
    assert names(out) == "acdbe" and [r.score for r in rows] == [0.5, 0.49, 0.48, 0.475, 0.1]  # lone b loses, scores stay
    open_ = ch.with_head(list(rows), 5, ch.HeadConfig(conservative=False))
    assert names(open_)[:2] == "dc"  # z gains by its two clusters, d also as a supplement
    assert names(ch.with_head([rows[2], rows[3]], 2, ch.HeadConfig())) == "cd"  # one answer, no dispute


def test_greedy_choice_and_filling():
    rows = [row("a", 1, 0.5, 0, "x"), row("b", 2, 0.49, 0, "x"), row("c", 3, 0.48, 0, "y"), row("d", 4, 0.2, 1, "x")]
    out = ch.greedily(rows[:2], rows, 3, ch.GreedyConfig())
    # a, then d of another cluster; then the cluster cap leaves none, so b fills up in pool order.
    assert names(out) == "adb" and out[2].flags == {"filled"} and out[2].gain is None
    echo = [row("a", 1, 0.5, 0, "x", echo=0.01), row("b", 2, 0.499, 1, "x", echo=0.01), row("c", 3, 0.485, 2, "x")]
    assert names(ch.greedily(echo[:2], echo, 2, ch.GreedyConfig())) == "ac"  # a second echo costs more than b leads
    assert names(ch.greedily(rows[:1], rows, 3, ch.GreedyConfig())) == "a"


def test_whole_pipeline(spark):
    found = queries.hardened(spark, SF)
    docs = found.documents.collect()
    by_query = {}
    for r in docs:
        by_query.setdefault(r.query_id, []).append(r)
    for rows in by_query.values():
        rows.sort(key=lambda r: r.place)
        assert [r.place for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 5
        assert len({r.doc_id for r in rows}) == len(rows) and all(r.provenance == "indexed_corpus" for r in rows)
        taken = [r for r in rows if not r.filled]
        assert len({r.cluster_id for r in taken}) == len(taken)  # only filling goes beyond the cap
    assert {r.query_id for r in found.conflicts.collect()} == set(by_query)
    assert found.answers.groupBy("query_id").count().where("count > 10").count() == 0
    assert {r.kind for r in found.references.collect()} <= {"correct", "incorrect"}


def test_plain_choice_is_caps_by_score(spark):
    rows = queries.chosen(spark, SF).select("query_id", "doc_id", "place")
    from gristmill.operators import score, select, support

    staged = queries.staged(spark, SF)
    scored = score.support_score(staged, support.answer_support(staged))
    want = select.accepted(select.caps(select.by_score(scored), 5)).select("query_id", "doc_id", "place")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))


def test_policies_reach_the_margin_gate(spark):
    asked = spark.createDataFrame([(1, "q", 1.25, True), (2, "q", 0.75, False)], "query_id bigint, query string, policy_margin double, policy_high boolean")
    mention = "array<struct<key: string>>"
    rows = [(q, d, r, s, c, [{"key": k}], ["bm25", "dense"], 0.0, False) for q in (1, 2) for d, r, s, c, k in (("a", 1, 0.5, 0, "x"), ("b", 2, 0.49, 1, "x"), ("c", 3, 0.48, 2, "y"))]
    df = spark.createDataFrame(rows, f"query_id bigint, doc_id string, rank int, score double, cluster_id int, mentions {mention}, channels array<string>, echo_penalty double, low_grounding boolean")
    out = ch.choose(df, asked, 3, ch.ChooseConfig(margin=ch.MarginGateConfig(context=replace(ch.MarginConfig(), max_threshold=9.0))))
    got = {r.query_id: r.t for r in out.groupBy("query_id").agg(F.max("margin_triggered").alias("t")).collect()}
    # x leads by 1 + 0.5 + 0.25 = 1.75; high risk asks for 0.75 + 0.35, a floor of 1.25 for no more.
    assert got == {1: False, 2: False}
    high = ch.choose(df, asked.withColumn("policy_margin", F.lit(2.0)), 3, ch.ChooseConfig(margin=ch.MarginGateConfig(context=replace(ch.MarginConfig(), max_threshold=9.0))))
    assert all(r.margin_triggered for r in high.collect())


def test_unknown_settings_raise(spark):
    from gristmill.plans import retrievers

    with pytest.raises(ValueError):
        retrievers.build({"type": "none"}, queries.inputs(spark, SF), 3)
    with pytest.raises(ValueError):
        retrievers.build({"type": "secure_ensemble"}, queries.inputs(spark, SF), 3)
    assert harden.HardenConfig().choose.per_cluster == 1


def test_a_reader_comes_first(spark):
    from gristmill.operators import mentions

    df = spark.createDataFrame([(1, "d", 1, "In 1999 Anna met Peter Parker.", ["bm25"], "indexed_corpus"), (1, "e", 2, "Berlin has 12 zoos.", ["bm25"], "indexed_corpus")],
                               "query_id bigint, doc_id string, rank int, text string, channels array<string>, provenance string")
    asks = spark.createDataFrame([(1, "who is it")], "query_id bigint, query string")
    reader = F.when(F.col("doc_id") == "d", F.array(mentions.mention(F.lit("Peter"), "reader"))).otherwise(F.slice(F.array(mentions.mention(F.lit("x"), "reader")), 1, 0))
    rows = {r.doc_id: [m.key for m in r.mentions] for r in harden.features(df.withColumn("reader", reader), asks, harden.HardenConfig()).collect()}
    plain = {r.doc_id: [m.key for m in r.mentions] for r in harden.features(df, asks, harden.HardenConfig()).collect()}
    assert rows["d"][0] == "peter" and len(rows["d"]) <= 3 and rows["e"] == plain["e"] and "peter" not in plain["d"][:1]
