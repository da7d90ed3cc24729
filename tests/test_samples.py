"""Samples, pooled vectors, span search, streams and stored runs, each against a plain version."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import mentions, retrieve, sampling, vectors
from gristmill.sources import readers
from gristmill.streaming import late


@pytest.mark.parametrize("n_docs", [40, 3000])
def test_negatives(spark, n_docs):
    docs = spark.range(n_docs).withColumnRenamed("id", "doc_id")
    asks = spark.range(60).withColumnRenamed("id", "query_id")
    positives = spark.createDataFrame([(q, d) for q in range(60) for d in range(q % 7)] + [(3, 10**9)], "query_id bigint, doc_id bigint")
    got = sorted(map(tuple, sampling.negatives(asks, docs, positives, 15).collect()))
    assert got == sorted(map(tuple, sampling.negatives(asks, docs.repartition(5), positives, 15).collect()))
    assert Counter(q for q, _, _ in got) == {q: 15 for q in range(60)} and len({(q, d) for q, d, _ in got}) == len(got)
    assert not {(q, d) for q, d, _ in got} & {(q, d) for q in range(60) for d in range(q % 7)}
    assert got != sorted(map(tuple, sampling.negatives(asks, docs, positives, 15, seed=13).collect()))
    half = n_docs // 2  # even over the documents: the later half's share, within five standard deviations
    share = sum(15 * half / (n_docs - q % 7) for q in range(60))
    assert abs(sum(d >= n_docs - half for _, d, _ in got) - share) < 5 * (len(got) / 4) ** 0.5


def test_all_negatives_where_few_are_left(spark):
    docs, asks = spark.range(5).withColumnRenamed("id", "doc_id"), spark.range(2).withColumnRenamed("id", "query_id")
    positives = spark.createDataFrame([(0, 1), (0, 2)], "query_id bigint, doc_id bigint")
    got = {(q, d) for q, d, _ in sampling.negatives(asks, docs, positives, 10).collect()}
    assert got == {(0, 0), (0, 3), (0, 4)} | {(1, d) for d in range(5)}


@pytest.mark.parametrize("power, total", [(0.5, 700), (1.0, 2000), (0.0, 997), (0.3, 5)])
def test_temperature(spark, power, total):
    sizes = {"a": 1300, "b": 120, "c": 9, None: 1}
    rows = spark.createDataFrame([(g, i, "x") for g, n in sizes.items() for i in range(n)], "g string, key bigint, other string")
    got = sampling.by_temperature(rows, "g", "key", total, power).collect()
    taken, whole = Counter(), sum(n**power for n in sizes.values())
    for r in got:
        taken[r.g] += r.copies
    assert sum(taken.values()) == total and all(abs(taken[g] - total * n**power / whole) <= 1 for g, n in sizes.items())
    for g, n in sizes.items():
        copies = Counter(r.copies for r in got if r.g == g)
        assert max(copies, default=0) - (min(copies) if sum(copies.values()) == n else 0) <= 1  # evenly among a group's rows
    again = {(r.g, r.key): r.copies for r in sampling.by_temperature(rows.repartition(4), "g", "key", total, power).collect()}
    assert again == {(r.g, r.key): r.copies for r in got}


def test_pooled(spark):
    data = [(1, 0, [1.0, 2.0]), (1, 1, [3.0, None]), (1, 2, None), (2, 5, [0.0, 0.0]), (2, 4, [0.0, 0.0]), (3, 1, None)]
    rows = spark.createDataFrame(data, "g int, ord int, vector array<double>")
    of = lambda **o: {r.g: (r.n, r.vector) for r in vectors.pooled(rows, "g", **o).collect()}
    assert of() == {1: (2, [2.0, 2.0]), 2: (2, [0.0, 0.0])}
    assert of(how="max") == {1: (2, [3.0, 2.0]), 2: (2, [0.0, 0.0])}
    assert of(how="first", order="ord")[1] == (2, [1.0, 2.0])
    assert of(normalize=True)[1][1] == pytest.approx([0.5**0.5] * 2) and of(normalize=True)[2][1] == [0.0, 0.0]
    with pytest.raises(ValueError):
        vectors.pooled(rows, "g", how="none")


def test_span_search(spark):
    rng = random.Random(2)
    texts = {d: [(rng.choice([0.5, 1.0, 2.5, -1.0]), rng.choice([0.0, 1.5, 3.0])) for _ in range(n)] for d, n in enumerate([3, 64, 65, 200, 131])}
    rows = spark.createDataFrame([(0, d, [(float(a), float(b)) for a, b in t]) for d, t in texts.items()], "query_id int, doc_id int, w array<struct<a: double, b: double>>")
    windows = mentions.text_windows(rows, "w", 64, 40)
    assert {r.doc_id: r.n for r in windows.groupBy("doc_id").agg(F.max(F.col("offset") + F.size("w")).alias("n")).collect()} == {d: len(t) for d, t in texts.items()}
    windows = windows.select("query_id", "doc_id", "offset", F.transform("w", lambda x: x["a"]).alias("start_logits"), F.transform("w", lambda x: x["b"]).alias("end_logits"))
    got = {}
    for r in mentions.span_search(windows, 6, 9, 7, 5).orderBy("rank").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.start_logit, r.end_logit))
    for d, t in texts.items():
        found = set()
        for o in range(0, max(len(t) - 64 + 39, 0) // 40 * 40 + 1, 40):
            place = range(o, min(len(t), o + 64))
            starts, ends = sorted(place, key=lambda i: (-t[i][0], i))[:9], sorted(place, key=lambda i: (-t[i][1], i))[:7]
            found |= {(s, e, t[s][0], t[e][1]) for s in starts for e in ends if 0 <= e - s < 5}
        assert got.get(d, []) == sorted(found, key=lambda x: (-(x[2] + x[3]), x[0], x[1]))[:6]


def test_a_large_run_is_read_in_splits(spark, tmp_path):
    rng = random.Random(1)
    run = {f"q {i} \"x\" é": {f"d{rng.randrange(10**6)}": round(rng.random(), 6) for _ in range(rng.randrange(0, 40))} for i in range(3000)}
    (tmp_path / "run.json").write_text(json.dumps(run, indent=1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        rows = readers.stored_run(spark, f"{tmp_path}/run.json")
        assert rows.rdd.getNumPartitions() > 4
        got = {}
        for r in rows.orderBy("query_id", "ord").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {q: list(d.items()) for q, d in run.items() if d}
    (tmp_path / "bad.json").write_text('{"q": {"d}": 1.0}}')
    with pytest.raises(Exception):
        readers.stored_run(spark, f"{tmp_path}/bad.json").collect()


def test_stored_vectors_are_told_from_others(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(50)], "doc_id bigint, vector array<double>")
    readers.write_vectors(rows, f"{tmp_path}/v", "m")
    ids = rows.select("doc_id")
    assert readers.read_vectors(spark, f"{tmp_path}/v", "m", ids.orderBy(F.desc("doc_id"))).count() == 50
    for other in (ids.where("doc_id > 0"), ids.unionByName(ids.limit(1)), ids.withColumn("doc_id", F.when(F.col("doc_id") == 3, 77).otherwise(F.col("doc_id"))), ids.where("doc_id <> 3").unionByName(ids.where("doc_id = 4"))):
        assert readers.read_vectors(spark, f"{tmp_path}/v", "m", other) is None
    assert readers.read_vectors(spark, f"{tmp_path}/v", "other", ids) is None


def test_running_top_k_over_two_batches(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} both w{i % 3}") for i in range(200)], "doc_id bigint, text string")
    asks = spark.createDataFrame([(1, "w1 w2 both"), (2, "w6"), (3, "nothing")], "query_id bigint, query string")
    index = retrieve.bm25_index(docs.where("doc_id < 100"))
    at = lambda minutes: F.timestamp_seconds(F.lit(1_700_000_000) + minutes * 60)
    arrivals = docs.where("doc_id >= 100").withColumn("ts", at(F.col("doc_id")))
    arrivals.where("doc_id < 150").coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = arrivals.schema

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        return late.last_rows(late.running_top_k(stream, index, asks, 5), "query_id", f"{tmp_path}/out", f"{tmp_path}/cp")

    want = lambda rows: sorted(map(tuple, retrieve.top_k(retrieve.bm25_extra(index, rows, asks).where("score > 0"), 5).select("query_id", "doc_id", "score", "rank").collect()))
    assert sorted(map(tuple, run().collect())) == want(arrivals.where("doc_id < 150").select("doc_id", "text"))
    # A second batch after a restart: new ones, one that came before, and one that comes too late.
    too_late = spark.createDataFrame([(999, "w1 w2 both w6 w6")], "doc_id bigint, text string").withColumn("ts", at(F.lit(0)))
    more = arrivals.where("doc_id >= 150").unionByName(arrivals.where("doc_id = 149")).unionByName(too_late)
    more.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, run().collect())) == want(arrivals.select("doc_id", "text"))
