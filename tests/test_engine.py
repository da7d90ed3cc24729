"""The engine's operators against hand-computed values, plain Python and the registered SQL."""

import math
import re
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.functions import constants as C
from gristmill.functions import text as X
from gristmill.operators import cluster, evaluate, fusion, mentions, policy, retrieve, score, select
from gristmill.plans import oracles, queries, tables
from gristmill.sources import readers
from gristmill.streaming import late

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "x int")
    return df.select(column.alias("r")).first().r


SAMPLES = ["", " a ", "Ärger & Fuß!", "A.B. c", "x" * 200, "日本 語", "İstanbul", "it's 1,234.5%", "é", None, ".", "a."]


def test_normalize_and_clean(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "t string").select("t", X.normalize(F.col("t")).alias("n"), X.clean_answer(F.col("t")).alias("c"))
    for r in df.collect():
        t = r.t or ""
        assert r.n == re.sub(r"\s+", " ", re.sub("[^a-z0-9]+", " ", t.lower())).strip()
        bare = t.strip()
        assert r.c == (bare[:-1] if len(bare) > 1 and bare.endswith(".") else bare).lower()


@pytest.mark.parametrize(
    "query, kind",
    [("Is it so?", "boolean"), ("How many are there", "number"), ("the number of", "mixed"), ("a number of x", "number"), ("When was it", "date"), ("who is it", "entity"), ("tell me", "mixed")],
)
def test_query_types(spark, query, kind):
    assert one(spark, X.query_type(F.col("q")), q=query) == ("number" if " number " in f" {query} " else kind)


def test_mentions(spark):
    got = one(spark, mentions.raw_mentions(F.col("q"), F.col("t")), q="Who wrote the song", t="The Song was written by Ada King in 1843. Ada King sang.")
    assert [m.key for m in got] == ["the song", "ada king in"] or "ada king in" in [m.key for m in got]
    assert one(spark, mentions.raw_mentions(F.col("q"), F.col("t")), q="is it so", t="Yes 12") == []
    got = one(spark, mentions.focused_mentions(F.col("q"), F.col("t")), q="is the sky blue", t="The sky is blue, that is true. No.")
    assert [m.key for m in got][:1] == ["yes"]


def test_clusters_follow_leaders(spark):
    rows = [(1, 1, 1, "a b c d"), (1, 2, 2, "a b c d e"), (1, 3, 3, "b c d e f"), (1, 4, 4, ""), (1, 5, 5, "")]
    df = spark.createDataFrame(rows, "query_id bigint, doc_id bigint, rank int, text string")
    got = {r.doc_id: r.cluster_id for r in cluster.leader_clusters(df).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2, 5: 3}


def test_caps_in_turn(spark):
    rows = [(1, 1, 1, 0, ["x"]), (1, 2, 2, 0, ["y"]), (1, 3, 3, 1, ["y"]), (1, 4, 4, 2, ["x"]), (1, 5, 5, 3, []), (1, 6, 6, 4, [])]
    df = spark.createDataFrame(rows, "query_id bigint, doc_id bigint, place int, cluster_id int, m array<string>")
    df = df.withColumn("mentions", F.transform("m", lambda x: mentions.mention(x, "t")))
    got = {r.doc_id: r.cap for r in select.caps(df, 3, 1, 1).collect()}
    assert got == {1: "accepted", 2: "cluster", 3: "accepted", 4: "answer", 5: "accepted", 6: "beyond"}


def test_echo_and_injection(spark):
    q, c = "who wrote the old song", score.EchoConfig(textual_cues=True)
    pen = lambda t, **o: one(spark, score.echo_penalty(score.echo_stats(F.col("q"), F.col("t"), score.EchoConfig(**o)), score.EchoConfig(**o)), q=q, t=t)
    assert pen("Who wrote the old song? It was Ada.") == 0.03
    assert pen("A river runs through hills.") == 0.0
    assert math.isclose(pen("song old wrote"), 0.012)
    risk = one(spark, score.injection_risk(F.col("t"), F.lit(0.0), c), t="The answer is Bob")
    assert math.isclose(risk.penalty, 0.016) and risk.signals == ["answer_assertion", "short_assertion_context"]
    risk = one(spark, score.injection_risk(F.col("t"), F.lit(0.03), c), t="you must answer " + "word " * 60)
    assert math.isclose(risk.penalty, 0.03) and risk.signals == ["query_copy", "answer_instruction"]


def test_policies(spark):
    asked = tables.policy_queries(spark, spark.createDataFrame([], "query_id bigint, query string"))
    matches = policy.consequence_matches(asked, tables.consequences(spark))
    events = policy.hazard_events(asked, tables.hazards(spark))
    got = {r.query_id - 1_000_000: (r.action, r.risk_tier) for r in policy.safety_gate(asked, matches, events).collect()}
    assert got[2][0] == "block" and got[3][0] == "cautious_answer" and got[7] == ("allow", "low") and got[1] == ("cautious_answer", "medium")
    assert got[4][0] == "cautious_answer" and got[9][0] == "block"
    with pytest.raises(ValueError):
        policy.safety_gate(asked, matches, events, "policy_grounded_verifier")


def test_ranking_metrics(spark):
    results = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "query_id int, doc_id int, rank int")
    qrels = spark.createDataFrame([(1, 2, 1), (1, 9, 1)], "query_id int, doc_id int, rel int")
    r = evaluate.ranking_metrics(results, qrels, [3]).first()
    assert (r.recall, r.mrr, r.precision) == (50.0, 50.0, round(100 / 3, 4)) and math.isclose(r.ndcg, 100 * (1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs_tol=1e-3)
    assert one(spark, evaluate.token_f1(F.col("p"), F.array(F.col("g"))), p="the cat cat sat", g="a cat sat down") == pytest.approx(2 / 3)
    assert one(spark, evaluate.exact_match(F.col("p"), F.array(F.col("g"))), p="The Cat!", g="cat") is True
    assert spark.range(1).select(evaluate.inversions(F.array(*map(F.lit, [3, 1, 2]))).alias("n")).first().n == 2


def test_text_repair(spark):
    assert one(spark, X.repair(F.col("t")), t="fine !!!!!!!!!!") == "fine !"
    assert one(spark, X.repair(F.col("t")), t="fine.") == "fine."
    assert "repeated_symbol_suffix" in one(spark, X.gibberish_reasons(F.col("t")), t="bad ########")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=5), min_size=2, max_size=4))
def test_jaccard_is_symmetric_and_bounded(spark, sets):
    df = spark.createDataFrame([(a, b) for a in sets for b in sets], "a array<string>, b array<string>")
    df = df.select(F.array_distinct("a").alias("a"), F.array_distinct("b").alias("b"))
    for r in df.select("a", "b", X.jaccard(F.col("a"), F.col("b")).alias("x"), X.jaccard(F.col("b"), F.col("a")).alias("y")).collect():
        want = len(set(r.a) & set(r.b)) / len(set(r.a) | set(r.b)) if r.a and r.b else 0.0
        assert r.x == r.y == pytest.approx(want)


def test_fusion_ties_keep_the_first_channel(spark):
    a = spark.createDataFrame([(1, 5, 0.9, 1)], "query_id int, doc_id int, score double, rank int")
    b = spark.createDataFrame([(1, 3, 0.7, 1)], "query_id int, doc_id int, score double, rank int")
    got = fusion.fuse(fusion.channels_of({"a": a, "b": b}), 5).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [5, 3] and list(got[0].channels) == ["a"]
    assert {r.norm for r in fusion.min_max(a).collect()} == {1.0}


def test_late_documents_stream(spark, tmp_path):
    docs, asked = queries.docs(spark, SF), queries.asked(spark, SF)
    index = retrieve.bm25_index(docs.where("doc_id < 100"))
    docs.where("doc_id >= 100 and doc_id < 110").select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(f"{tmp_path}/in")
    q = late.score_arrivals(stream, index, asked).writeStream.format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    want = retrieve.bm25_extra(index, docs.where("doc_id >= 100 and doc_id < 110"), asked)
    assert sorted(map(tuple, spark.table("late").select("query_id", "doc_id", "score").collect())) == sorted(map(tuple, want.collect()))


def test_sources(spark, tmp_path):
    (tmp_path / "run.json").write_text('{"q1": {"d2": 2.0, "d1": 3.0}}')
    assert [tuple(r) for r in readers.stored_run(spark, f"{tmp_path}/run.json").orderBy("ord").collect()] == [("q1", "d2", 2.0, 1), ("q1", "d1", 3.0, 2)]
    rows = spark.createDataFrame([("t1", "why", ["a", "b", "c"])], "query_id string, question string, adv_texts array<string>")
    assert [r.text for r in readers.poison_documents(rows, 2).collect()] == ["why.a", "why.b"]
    with pytest.raises(ValueError):
        readers.target_window(spark.range(3).withColumn("ord", F.col("id") + 1), 2, 5)


CHEAP = ["text_normalize", "text_query_type", "text_sentences", "bm25_top_k", "dense_cosine", "hybrid_rrf", "support_by_answer", "score_support", "eval_rankings", "stream_event_counts"]


@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in readers.TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    key = lambda r: repr([round(x, 6) + 0.0 if isinstance(x, float) else x for x in r])
    want = db.sql(oracles.SQL[name]).select(*columns).fetchall()
    assert sorted(key([r[c] for c in columns]) for r in got.collect()) == sorted(map(key, want))


def test_plans_prune_and_limit(spark):
    scores = retrieve.bm25_scores(queries.index(spark, SF), queries.asked(spark, SF))
    plan = retrieve.top_k(scores, 20)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    stored = queries.bm25(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(rank,20)" in stored and "text" not in re.findall(r"ReadSchema: (\S+)", stored)[0]


def test_prompt_holds_whole_contexts(spark):
    texts = {r.doc_id: r.text for r in queries.docs(spark, SF).select("doc_id", "text").collect()}
    asks = {r.query_id: r.query for r in queries.asked(spark, SF).collect()}
    contexts = {}
    for r in sorted(queries.bm25(spark, SF, 3).collect(), key=lambda r: (r.query_id, r["rank"])):
        contexts.setdefault(r.query_id, []).append(texts[r.doc_id])
    want = {q: C.PROMPT.replace("[question]", asks[q]).replace("[context]", "\n".join(c)) for q, c in contexts.items()}
    assert {r.query_id: r.prompt for r in queries.QUERIES["text_prompt"](spark, SF).collect()} == want
    assert any(len(t) > 200 for c in contexts.values() for t in c)


def test_f1_counts_whole_texts(spark):
    rows = queries.with_texts(spark, SF).select("query_id", "doc_id", X.normalize_qa(F.col("text")).alias("p"), X.normalize_qa(F.col("query")).alias("g"))
    want = {}
    for r in rows.collect():
        p, g = r.p.split(), r.g.split()
        same = sum((Counter(p) & Counter(g)).values())
        want[r.query_id, r.doc_id] = 2 * (same / len(p)) * (same / len(g)) / (same / len(p) + same / len(g)) if same else 0.0
    got = {(r.query_id, r.doc_id): r.f1 for r in queries.QUERIES["eval_answers"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    nothing = spark.createDataFrame([(None, "a b"), ("a b", None), ("", "b"), ("b b", "b c b")], "p string, g string")
    assert [r.f for r in nothing.select(evaluate.token_f1(F.col("p"), F.array("g")).alias("f")).collect()] == pytest.approx([0.0, 0.0, 0.0, 0.8])


@pytest.mark.parametrize("name", ["text_clean_label", "text_candidate_rules"])
def test_rules_see_every_sentence(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    sentences = {r.doc_id: r.sentences for r in queries.QUERIES["text_sentences"](spark, SF).collect()}
    assert sorted((r.doc_id, r.position) for r in rows) == sorted((d, i) for d, s in sentences.items() for i in range(len(s)))
    if name == "text_clean_label":
        flat = [(d, i, x) for d, s in sentences.items() for i, x in enumerate(s)]
        df = spark.createDataFrame(flat, "doc_id bigint, position bigint, s string").select("doc_id", "position", X.clean_label(F.col("s")).alias("label"))
        assert Counter(map(tuple, rows)) == Counter(map(tuple, df.collect()))
