"""Readers, the stored index, retrievers, Unicode forms and run summaries on small tables made here."""

import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as X
from gristmill.operators import evaluate, mentions, retrieve, summary
from gristmill.plans import queries, retrievers
from gristmill.sources import readers, store

SF = "/root/testdata/sf0.001"
TEXTS = ["café café naïve", "हिन्दी में लिखा", "a_b 12 x٣", "", None, "Straße ΣΑΣ", "日本 語"]


def test_tokens_are_those_of_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    want = {i: re.findall(r"\b\w+\b", (t or "").lower()) for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.t for r in df.select("doc_id", X.tokens(F.col("text")).alias("t")).collect()} == want
    counted = {(r.doc_id, r.term): (r.tf, r.dl) for r in X.term_counts(df).collect()}
    assert counted == {(i, x): (w.count(x), len(w)) for i, w in want.items() for x in w}
    assert {r.doc_id: r.n for r in df.select("doc_id", X.token_count(F.col("text")).alias("n")).collect()} == {i: len(w) for i, w in want.items()}


def test_composed_and_decomposed_forms_meet(spark):
    text = "Un café naïve à Zürich"
    rows = [(unicodedata.normalize(form, text), [unicodedata.normalize(other, "CAFÉ naïve")]) for form in ("NFC", "NFD") for other in ("NFC", "NFD")]
    rows += [(text, ["cafe naive"]), (text, [""]), (text, []), (None, ["x"]), (text, None), (text, ["naïve café"])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, answers array<string>")
    got = [r.h for r in df.withColumn("h", evaluate.has_answer(F.col("text"), F.col("answers"))).orderBy("i").collect()]
    assert got == [True] * 4 + [False, True, False, False, False, False]
    forms = df.limit(2).select(X.reader_tokens(F.col("text")).alias("t")).distinct().count()
    assert forms == 1


def test_index_is_written_and_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, ""), (4, None)], "doc_id bigint, text string")
    asks = spark.createDataFrame([(7, "a c z")], "query_id bigint, query string")
    index = retrieve.bm25_index(docs)
    retrieve.write_index(index, f"{tmp_path}/i")
    again = retrieve.read_index(spark, f"{tmp_path}/i")
    assert retrieve.bm25_scores(again, asks).collect() == retrieve.bm25_scores(index, asks).collect() != []
    index.docs.limit(2).write.mode("overwrite").parquet(f"{tmp_path}/i/docs")
    with pytest.raises(ValueError):
        retrieve.read_index(spark, f"{tmp_path}/i")


def test_pruned_search_gives_the_same_rows(spark):
    """Over whole tables, for few and many results, other constants, repeated texts (ties) and blocks of a few postings."""
    docs, asks = queries.docs(spark, SF).select("doc_id", "text"), queries.asked(spark, SF).unionByName(spark.createDataFrame([(900, "zzz none"), (901, "")], "query_id bigint, query string"))
    docs = docs.unionByName(docs.where("doc_id < 60").withColumn("doc_id", F.expr("doc_id + 5000"))).cache()
    before, retrieve.POSTINGS = retrieve.POSTINGS, 16
    try:
        index = retrieve.bm25_index(docs, lambda name, df: df.cache())
        for k, k1, b in ((1, retrieve.K1, retrieve.B), (20, retrieve.K1, retrieve.B), (20, 0.9, 0.4), (5000, retrieve.K1, retrieve.B)):
            want = retrieve.top_k(retrieve.bm25_scores(index, asks, k1, b), k)
            assert sorted(map(tuple, retrieve.bm25_top_k(index, asks, k, k1, b).collect())) == sorted(map(tuple, want.collect()))
        read = retrieve.postings_read(index, asks, 5).agg(F.sum("postings"), F.sum("read"), F.sum("looked_up")).first()
        assert read[1] + read[2] < 0.8 * read[0]
        assert index.blocks.agg(F.max("size")).first()[0] < 64
    finally:
        retrieve.POSTINGS = before


def test_extras_are_kept_that_can_be_among_the_best(spark):
    docs, asks = queries.docs(spark, SF).select("doc_id", "text"), queries.asked(spark, SF)
    index, extra = retrieve.bm25_index(docs.where("doc_id >= 60")), docs.where("doc_id < 60").unionByName(spark.createDataFrame([(-1, None), (-2, "zz")], "doc_id bigint, text string"))
    asks = asks.unionByName(spark.createDataFrame([(900, "nothing shared"), (901, docs.first()["text"][:30])], "query_id bigint, query string"))
    for k in (1, 7, 500):
        full = retrieve.top_k(retrieve.bm25_extra(index, extra, asks), k)
        assert sorted(map(tuple, retrieve.top_k(retrieve.bm25_extra(index, extra, asks, k=k), k).collect())) == sorted(map(tuple, full.collect()))


def test_a_changed_input_has_another_version(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(300).repartition(300).write.parquet(path)
    first = store.version(spark.read.parquet(path))
    assert first == store.version(spark.read.parquet(path))
    spark.range(5).coalesce(1).write.mode("append").parquet(path)
    assert first != store.version(spark.read.parquet(path))


def test_vectors_in_blocks_are_those_shipped(spark):
    rows, asks = queries.vectors(spark, SF)
    for metric in ("dot", "cosine"):
        shipped = sorted(map(tuple, retrieve.dense_top_k(rows, asks, 5, metric).collect()))
        assert shipped == sorted(map(tuple, retrieve.dense_top_k(rows, asks, 5, metric, most=3).collect()))
    assert retrieve.dense_top_k(rows, asks.limit(0), 5).count() == 0


def test_missing_queries_of_a_run_raise(spark):
    run = spark.createDataFrame([(1, 10, 0.5, 1), (1, 11, 0.4, 2), (2, 10, 0.3, 1)], "query_id bigint, doc_id bigint, score double, ord int")
    docs = spark.createDataFrame([(10, "x")], "doc_id bigint, text string")
    asks = spark.createDataFrame([(1, "q")], "query_id bigint, query string")
    given = retrievers.Inputs(docs, asks, run=run)
    config = {"type": "dense", "dense": {"use_precomputed": True}}
    assert [tuple(r) for r in retrievers.build(config, given, 2).collect()] == [(1, 10, 0.5, 1)]
    given.queries = asks.union(spark.createDataFrame([(9, "q")], asks.schema))
    with pytest.raises(Exception, match="no query 9"):
        retrievers.build(config, given, 2).collect()


def test_encoding_is_batched(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(9)] + [(9, None)], "id bigint, text string")
    got = {r.id: r.vector for r in retrievers.encode(df, "id", "text", lambda: lambda texts: [[len(t), len(texts)] for t in texts], batch=4).collect()}
    assert {i: v[0] for i, v in got.items()} == {i: float(i % 9) for i in range(10)} and max(v[1] for v in got.values()) <= 4


def test_numbers_and_stored_tables(spark, tmp_path):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "x bigint, y bigint").repartition(5)
    assert [(r.x, r.ord) for r in store.numbered(df, F.col("x")).orderBy("ord").collect()] == [(i, i + 1) for i in range(101)]
    df.write.parquet(f"{tmp_path}/t")
    table, made = spark.read.parquet(f"{tmp_path}/t"), []
    read = lambda: store.once([spark.read.parquet(f"{tmp_path}/t")], "test", lambda: made.append(1) or table.where("x < 3")).count()
    assert read() == read() == 3 and len(made) == 1
    spark.range(5).select(F.col("id").alias("x"), F.col("id").alias("y")).write.mode("overwrite").parquet(f"{tmp_path}/t")
    spark.catalog.refreshByPath(f"{tmp_path}/t")
    store.once([spark.read.parquet(f"{tmp_path}/t")], "test", lambda: made.append(1) or spark.read.parquet(f"{tmp_path}/t"))
    assert len(made) == 2  # other files, so another table


def test_readers_of_files(spark, tmp_path):
    lines = [json.dumps({"consequence_id": f"c{i}", "severity": "low", "match": {"phrases": ["x"], "patterns": [], "min_phrase_matches": 1}}) for i in range(4)]
    (tmp_path / "p.jsonl").write_text("\n".join([lines[0], "", *lines[1:]]) + "\n")
    assert [r.consequence_id for r in readers.consequence_policies(spark, f"{tmp_path}/p.jsonl").orderBy("policy_order").collect()] == ["c0", "c1", "c2", "c3"]
    (tmp_path / "bad.jsonl").write_text("{not json\n")
    with pytest.raises(Exception):
        readers.consequence_policies(spark, f"{tmp_path}/bad.jsonl").collect()
    (tmp_path / "h.jsonl").write_text(json.dumps({"policy_id": "h", "decision_by_intent": {"unknown": "allow"}}))
    assert readers.hazard_policies(spark, f"{tmp_path}/h.jsonl").first().decision_by_intent == {"unknown": "allow"}
    (tmp_path / "a.json").write_text(json.dumps([{"question": f"a{i}"} for i in range(4)]))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps({"question": f"b{i}"}) for i in range(4)))
    files = [f"{tmp_path}/a.json", f"{tmp_path}/b.jsonl"]
    asked = lambda **o: [r.question for r in readers.finetune_examples(spark, files, **o).orderBy("ord").collect()]
    assert asked() == ["a0", "a1", "a2", "a3", "b0", "b1", "b2", "b3"] and asked(most=5)[-1] == "b0"
    assert asked(rank=1, world=3) == ["a0", "a3", "b2"] and asked(rank=0, world=3) == ["a2", "b1"]
    folder = tmp_path / "msmarco"
    (folder / "qrels").mkdir(parents=True)
    (folder / "corpus.jsonl").write_text(json.dumps({"_id": "d", "title": "t", "text": "x"}))
    (folder / "queries.jsonl").write_text(json.dumps({"_id": "q", "text": "x"}))
    (folder / "qrels" / "train.tsv").write_text("query-id\tcorpus-id\tscore\nq\td\t1\n")
    corpus, asks, qrels = readers.beir(spark, str(tmp_path), "msmarco", "test")
    assert (corpus.count(), asks.first().query_id, qrels.first().rel) == (1, "q", 1)
    (tmp_path / "w.tsv").write_text("id\ttext\ttitle\n1\tbody\thead\n")
    assert tuple(readers.passages(spark, f"{tmp_path}/w.tsv").first()) == ("1", "head", "body")


def test_models_that_are_missing():
    assert mentions.with_fallback(None, "no weights") == (None, "no weights")
    with pytest.raises(RuntimeError, match="no weights"):
        mentions.with_fallback(None, "no weights", required=True)


def test_report_of_runs(spark):
    facts = queries.run_facts(spark, SF)
    rows = {r.run_name: r for r in summary.flat_rows(summary.run_summary(**facts), "summary").collect()}
    n = {r.run_id: r.n for r in facts["hits"].groupBy("run_id").agg(F.count("*").alias("n")).collect()}
    assert rows["all"].complete == (n["all"] == 40) and not rows["even"].complete and rows["even"].expected_queries == 21
    assert json.loads(rows["all"].asr_by_iter) and json.loads(rows["all"].answer_level_conflict_type_counts)
    offline = summary.run_summary(**facts, offline=True)
    assert not [c for c in offline.columns if c.startswith("query_safety_gate")] and "answer_level_conflict_detected_rate" in offline.columns
    both = queries.QUERIES["summary_flat"](spark, SF).collect()
    assert [(r.run_name, r.source_type) for r in both] == [("all", "summary"), ("even", "result_recomputed")]


def test_same_sample_for_a_seed(spark):
    asks = queries.asked(spark, SF)
    first, again, other = ({r.query_id for r in retrievers.sampled_queries(d, 7, s).collect()} for d, s in ((asks, 1), (asks.repartition(3), 1), (asks, 2)))
    assert first == again != other and len(first) == 7


def test_case_folding_is_that_of_python(spark):
    texts = [f"a{c}b" for c in X.FOLDED] + ["Straße ẞ ſo ﬁn ﬄ ŉ İ K", "ÀÉ", None]
    assert len(X.FOLDED) > 10
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.withColumn("x", X.normalize_policy(F.col("t"))).orderBy("i").collect()]
    assert got == [re.sub("[^a-z0-9]+", " ", (t or "").casefold()).strip() for t in texts]


def test_run_names():
    base = {"dataset": "nq", "model_name": "m", "top_k": 5, "M": 10, "repeat_times": 2, "adv_per_query": 5}
    assert readers.run_name(base | {"retriever": {"type": "bm25"}}) == "nq-bm25-m-Top5-M10x2"
    assert readers.run_name(base | {"retriever": {"type": "hybrid", "alpha": 0.25}, "attack_method": "hotflip"}) == "nq-hybrid-m-Top5-M10x2-alpha0p25-adv-hotflip-5"
    hard = {"enabled": True, "candidate_depth": 30, "head_filter": {"enabled": True}}
    name = readers.run_name(base | {"retriever": {"type": "robust_ensemble"}, "evidence_hardening": hard, "skip_llm": True})
    assert name == "nq-robust_ensemble-m-Top5-M10x2-consensus_rrf-s1-cap0-eh30-c1-a1-ac0-x1-hf3-hs2-cons-retrieval-only"
    assert readers.run_name({"run_name": "own"}) == "own"


def test_reader_spans(spark):
    schema = "query_id int, query string, doc_id int, start int, end int, start_logit double, end_logit double, label string"
    rows = [(1, "who made it", 7, 3, 4, 2.0, 1.0, "Ada Lovelace."), (1, "who made it", 7, 9, 10, 1.0, 1.0, "ada lovelace"), (1, "who made it", 7, 5, 4, 9.0, 9.0, "backwards"),
            (1, "who made it", 7, 1, 20, 9.0, 9.0, "far too long a span"), (1, "who made it", 7, 2, 3, 1.5, 1.0, "made it"), (1, "who made it", 8, 0, 1, 0.1, 0.1, "Turing"), (1, "who made it", 7, 6, 7, 1.0, 1.5, "Babbage")]
    got = mentions.reader_spans(spark.createDataFrame(rows, schema), 2, min_score=1.0).orderBy("doc_id", "rank").collect()
    assert [(r.doc_id, r.key, r.score, r["rank"]) for r in got] == [(7, "ada lovelace", 3.0, 1), (7, "babbage", 2.5, 2)]
