"""Product-quantised vectors: a byte for each part of a vector, near ones by distance tables, and exact scores of those that remain."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.operators import retrieve
from gristmill.sources.store import few

CODES = 256
#: Codebooks are fitted on at most this many vectors, those of least hash; all vectors are coded.
SAMPLE = 1 << 16
STEPS = 20


@dataclass
class PqIndex:
    """codebooks(part, code, centroid) and codes(doc_id, codes, vector): a byte a part for each vector, beside the vector for exact scores."""

    codebooks: DataFrame
    codes: DataFrame
    metric: str


def usable(vector: Column) -> Column:
    """Vectors that are null, or hold a null or a number that is not finite, are not indexed."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def prepared(vectors: DataFrame, metric: str) -> DataFrame:
    """(doc_id, vector as double, scaled): scaled to length 1 for the cosine."""
    rows = vectors.select("doc_id", F.col("vector").cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    return rows.withColumn("scaled", retrieve.unit(F.col("vector")) if metric == "cosine" else F.col("vector"))


def lloyd(points: np.ndarray, seed: int) -> np.ndarray:
    """At most CODES centroids of points; a centroid that loses all its points moves to the point that is farthest from its own."""
    rng, distinct = np.random.default_rng(seed), np.unique(points, axis=0)
    if len(distinct) <= CODES:
        return distinct
    centroids = distinct[rng.choice(len(distinct), CODES, replace=False)]
    for _ in range(STEPS):
        apart = squares(points, centroids)
        own = apart.argmin(axis=1)
        counts = np.bincount(own, minlength=CODES)
        sums = np.stack([np.bincount(own, weights=points[:, j], minlength=CODES) for j in range(points.shape[1])], axis=1)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        lost = np.flatnonzero(counts == 0)
        if len(lost):
            moved[lost] = points[np.argsort(-apart[np.arange(len(points)), own], kind="stable")[: len(lost)]]
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(axis=1)[None, :]


def fit(rows: DataFrame, parts: int, sample: int = SAMPLE, seed: int = 12) -> DataFrame:
    """(part, code, centroid) by k-means on a sample of bounded size, a task for each part."""
    n = rows.count()
    drawn = rows.withColumn("_draw", F.xxhash64("doc_id", F.lit(seed)))
    if n > sample:  # a few more than wanted by their hash alone, so that few are sorted
        drawn = drawn.where(F.pmod("_draw", F.lit(1 << 20)) < F.lit(min(1.0, 1.2 * sample / n + 1e-4) * (1 << 20)))
    drawn = drawn.orderBy("_draw", "doc_id").limit(sample)
    size = F.size("scaled")
    bounds = lambda i: F.floor(size / parts).cast("int") * i + F.least(F.lit(i), size % parts)
    pieces = F.array(*(F.struct(F.lit(i).alias("part"), F.slice("scaled", bounds(i) + 1, bounds(i + 1) - bounds(i)).alias("piece")) for i in range(parts)))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        centroids = lloyd(retrieve.matrix(pdf["piece"]), seed + part)
        return pd.DataFrame({"part": part, "code": range(len(centroids)), "centroid": list(centroids)})

    return drawn.select(F.explode(pieces).alias("p")).select("p.part", "p.piece").groupBy("part").applyInPandas(train, "part int, code int, centroid array<double>")


def books_of(codebooks: DataFrame) -> list[np.ndarray]:
    """The centroids by part; at most 256 vectors in all reach the driver for each part."""
    pdf = codebooks.toPandas().sort_values(["part", "code"])
    return [retrieve.matrix(rows["centroid"]) for _, rows in pdf.groupby("part")]


def build(vectors: DataFrame, parts: int = 8, metric: str = "dot", sample: int = SAMPLE, keep=lambda name, df: df) -> PqIndex:
    """The index of all usable vectors, of one length; ``keep(name, table)`` may store its tables."""
    rows = prepared(vectors, metric)
    codebooks = keep("codebooks", fit(rows, parts, sample))
    books = rows.sparkSession.sparkContext.broadcast(books_of(codebooks))

    def encode(batches):
        for pdf in batches:
            for at in range(0, len(pdf), retrieve.BLOCK):
                part = pdf.iloc[at : at + retrieve.BLOCK]
                m = retrieve.matrix(part["scaled"])
                edges = np.concatenate([[0], np.cumsum([b.shape[1] for b in books.value])])
                codes = np.stack([squares(m[:, a:b], book).argmin(axis=1) for a, b, book in zip(edges, edges[1:], books.value)], axis=1).astype(np.uint8)
                yield pd.DataFrame({"doc_id": part["doc_id"], "codes": [c.tobytes() for c in codes], "vector": part["vector"]})

    kind = vectors.schema["doc_id"].dataType.simpleString()
    return PqIndex(codebooks, keep("codes", rows.mapInPandas(encode, f"doc_id {kind}, codes binary, vector array<double>")), metric)


def write(index: PqIndex, path: str) -> None:
    index.codebooks.withColumn("metric", F.lit(index.metric)).write.mode("overwrite").parquet(f"{path}/codebooks")
    index.codes.write.mode("overwrite").parquet(f"{path}/codes")


def read(spark: SparkSession, path: str) -> PqIndex:
    """A written index; an error if its codes have other parts than its codebooks."""
    books, codes = spark.read.parquet(f"{path}/codebooks"), spark.read.parquet(f"{path}/codes")
    parts = books.agg(F.count_distinct("part")).first()[0]
    if codes.where(F.octet_length("codes") != parts).limit(1).count():
        raise ValueError(f"the codes of the index in {path} are not those of its codebooks")
    metric = books.select("metric").first()
    return PqIndex(books.drop("metric"), codes, metric[0] if metric else "dot")


def top_k(index: PqIndex, queries: DataFrame, k: int, depth: int | None = None, most: int | None = None) -> DataFrame:
    """The k best of each query among the ``depth`` (10 * k) best by codes, by their exact scores.

    A query's table has its product with each centroid; a vector's score by codes is the sum of one
    entry a part. Blocks of codes leave each query's ``depth`` best, and only those of the whole
    index meet their vectors. Queries that are not usable have no rows.
    """
    depth = depth or 10 * k
    books = index.codes.sparkSession.sparkContext.broadcast(books_of(index.codebooks))
    asked = prepared(queries.withColumnRenamed("query_id", "doc_id"), index.metric).select(F.col("doc_id").alias("query_id"), F.col("scaled").alias("vector"))

    def near(asks: pd.DataFrame, block: pd.DataFrame):
        q = retrieve.matrix(asks["vector"])
        edges = np.concatenate([[0], np.cumsum([b.shape[1] for b in books.value])])
        codes = np.frombuffer(b"".join(block["codes"]), dtype=np.uint8).reshape(len(block), -1)

        def score(tile):
            out = np.zeros((len(q[tile]), len(block)))
            for j, (a, b, book) in enumerate(zip(edges, edges[1:], books.value)):
                out += (q[tile, a:b] @ book.T)[:, codes[:, j]]
            return out

        yield from retrieve.top_of_block(asks["query_id"].to_numpy(), block["doc_id"].to_numpy(), depth, score)

    schema = retrieve.result_schema(index.codes, queries)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    likely = retrieve.block_results(index.codes.select("doc_id", "codes"), asked, "codes", schema, near, most)
    likely = likely.withColumn("place", F.row_number().over(order)).where(F.col("place") <= depth).select("query_id", "doc_id")
    met = likely.join(index.codes.select("doc_id", "vector"), "doc_id").join(few(asked.withColumnRenamed("vector", "q")), "query_id")
    vector = retrieve.unit(F.col("vector")) if index.metric == "cosine" else F.col("vector")
    scored = met.select("query_id", "doc_id", F.round(retrieve.finite(retrieve.dot(F.col("q"), vector)), retrieve.DIGITS).alias("score"))
    return retrieve.top_k(scored, k)
