"""The quantised index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import quantised, retrieve
from gristmill.plans import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_recall_at_twenty(spark, metric):
    rows = queries.vectors(spark, SF)[0].cache()
    asks = rows.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    index = quantised.build(rows, 8, metric, keep=lambda name, df: df.cache())
    assert index.codes.count() == rows.count()
    got = quantised.top_k(index, asks, 20).toPandas()
    exact = retrieve.dense_top_k(rows, asks, 20, metric).toPandas()
    both = got.merge(exact, on=["query_id", "doc_id"])
    assert len(both) / len(exact) >= 0.9 and (both["score_x"] == both["score_y"]).all()
    assert got.groupby("query_id")["rank"].apply(lambda r: sorted(r) == list(range(1, 21))).all()


def test_codes_name_the_nearest_centroids(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(700, 11)).round(3)
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "doc_id bigint, vector array<double>")
    index = quantised.build(rows, 3, "dot", sample=500, keep=lambda name, df: df.cache())
    books = quantised.books_of(index.codebooks)
    assert [b.shape for b in books] == [(256, 4), (256, 4), (256, 3)]
    for r in index.codes.limit(60).collect():
        at = 0
        for code, book in zip(r["codes"], books):
            apart = ((points[r["doc_id"], at : at + book.shape[1]] - book) ** 2).sum(axis=1)
            assert apart[code] <= apart.min() + 1e-9
            at += book.shape[1]


def test_odd_vectors_few_points_and_blocks(spark, tmp_path):
    data = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)] + [(90, None), (91, [float("nan"), 0.0, 0.0]), (92, [None, 1.0, 1.0]), (93, [float("inf"), 1.0, 1.0]), (94, [0.0, 0.0, 0.0])]
    rows = spark.createDataFrame(data, "doc_id bigint, vector array<double>")
    asks = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, None)], "query_id bigint, vector array<double>")
    index = quantised.build(rows, 2, "dot")
    assert {r[0] for r in index.codes.select("doc_id").collect()} == {*range(40), 94}
    quantised.write(index, f"{tmp_path}/pq")
    again = quantised.read(spark, f"{tmp_path}/pq")
    got = sorted(map(tuple, quantised.top_k(again, asks, 6).collect()))
    assert got == sorted(map(tuple, retrieve.dense_top_k(rows.where("doc_id < 90 or doc_id = 94"), asks.where("vector is not null"), 6).collect()))
    assert got == sorted(map(tuple, quantised.top_k(again, asks, 6, most=0).collect()))
    assert quantised.top_k(quantised.build(rows.where(F.lit(False)), 2), asks, 6).count() == 0
    again.codes.withColumn("codes", F.lit(b"abc")).write.mode("overwrite").parquet(f"{tmp_path}/pq/codes2")
    spark.read.parquet(f"{tmp_path}/pq/codes2").write.mode("overwrite").parquet(f"{tmp_path}/pq/codes")
    with pytest.raises(ValueError):
        quantised.read(spark, f"{tmp_path}/pq")


def test_ties_are_cut_exactly():
    scores = np.array([[1.0, 3.0, 3.0, 3.0, 0.0], [2.0] * 5])
    docs = np.array([9, 7, 3, 5, 1])
    assert [docs[x].tolist() for x in retrieve.best_columns(scores, docs, 2)] == [[3, 5], [1, 3]]
    assert [docs[x].tolist() for x in retrieve.best_columns(scores, docs, 9)] == [[3, 5, 7, 9, 1], [1, 3, 5, 7, 9]]
