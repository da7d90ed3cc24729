"""A quality classifier whose prior is a hierarchy of site and path rates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import Scratch, broadcast_if_few, columns_of, shingle_sets, slices, text_bytes, trimmed

FEATURES = ("log_words", "word_length", "upper", "symbols", "pipes", "bangs", "digits", "distinct", "line_ends", "spaces")
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[65:91] = 1
_CLASS[[ord(c) for c in "#$%&*@^~=<>{}[]\\_+`"]] = 2
_CLASS[ord("|")] = 3
_CLASS[[ord(c) for c in "!?"]] = 4
_CLASS[48:58] = 5
_CLASS[ord("\n")] = 6
_CLASS[[9, 11, 12, 13, 32]] = 7


def text_features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each whole text."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    which = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(which * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    distinct, words = np.ones(n), np.zeros(n)
    words = counts[:, 6] + counts[:, 7] + 1
    for i, shingles in enumerate(shingle_sets(column, width=3)):
        distinct[i] = min(1.0, len(shingles) / max(1.0, words[i] - 2))
    share = counts / size[:, None]
    out = [np.log1p(words), np.minimum(size / words, 30) / 10, *(share[:, k] for k in (1, 2, 3, 4, 5)), distinct, share[:, 6], share[:, 7]]
    return np.stack(out, axis=1)


def features(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        found = [text_features(part) for part in slices(texts)]
        values = np.concatenate(found) if found else np.zeros((0, len(FEATURES)))
        offsets = np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES)
        return trimmed(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel())))

    return of(text)


class Logistic:
    """Logistic regression by Newton steps on standardised features, with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.scale])
        w, keep = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        keep[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w[1:] / self.scale
        self.bias = float(w[0] - self.mean @ self.weights)

    def logit(self, x: Column) -> Column:
        terms = F.aggregate(F.zip_with(x, F.array(*map(F.lit, self.weights.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
        return F.least(F.greatest(terms + F.lit(self.bias), F.lit(-12.0)), F.lit(12.0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> Logistic | None:
    """The document classifier, from at most about ``most`` labelled documents; None without both classes.

    The sample is by hash of the id, at a rate that the number of labels sets; it is small enough
    to broadcast, so no text is shuffled.
    """
    labels = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("y"))
    rate = min(1.0, most / max(1, labels.count()))
    labels = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000)))
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
        .join(F.broadcast(labels), "doc_id")
        .select(features(F.coalesce("t", F.lit(""))).alias("x"), "y")
        .limit(2 * most)
        .collect()
    )
    y = np.array([r["y"] for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return None
    return Logistic(np.array([r["x"] for r in rows]), y)


def strength(groups: DataFrame, rate: Column, centre: Column, least: float = 2.0, most: float = 1000.0) -> float:
    """How many documents a group's prior counts for, by the method of moments over all groups.

    The groups' rates spread around their centres by the documents' own chance (rate * (1 - rate)
    / n) and by how much groups truly differ; what is left over for the latter sets the strength.
    """
    spread = F.sum(F.col("n") * (rate - centre) ** 2) / F.sum("n")
    noise = F.sum(centre * (1 - centre)) / F.sum("n")
    chance = F.sum(F.col("n") * centre * (1 - centre)) / F.sum("n")
    s, e, c = groups.where("n > 0").agg(spread, noise, chance).first()
    if s is None or c is None or c <= 0 or s - e <= 0:
        return most
    return float(min(most, max(least, c / (s - e) - 1)))


def own_scores(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, most_labels: int) -> tuple[DataFrame, Logistic | None]:
    """id, h, p and z (the document classifier's log odds), and the classifier; z is 0 without one."""
    model = fit(docs, labels, id_col, text_col, most_labels)
    own = model.logit(features(F.coalesce(text_col, F.lit("")))) if model else F.lit(0.0)
    columns = [F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("h"), F.col(path_col).cast("string").alias("p"), own.alias("z")]
    return docs.select(*columns), model


def rates(scratch: Scratch, scores: DataFrame) -> tuple[DataFrame, float, float, float]:
    """A row for each (h, p) with the sums of it and its host, the global rate, and the strengths of hosts and paths."""
    paths = scores.withColumn("q", 1 / (1 + F.exp(-F.col("z")))).groupBy("h", "p").agg(F.count("*").alias("n"), F.sum("q").alias("s"))
    paths = scratch.save(paths, "paths")
    total, whole = paths.agg(F.sum("n"), F.sum("s")).first()
    if not total:
        total, whole = 1, 0.5
    g = min(max(whole / total, 1e-4), 1 - 1e-4)
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    k_host = strength(hosts, F.col("s") / F.col("n"), F.lit(g))
    hosts = hosts.select("h", F.col("n").alias("hn"), F.col("s").alias("hs"), ((F.col("s") + k_host * g) / (F.col("n") + k_host)).alias("hr"))
    table = paths.alias("a").join(hosts.alias("b"), F.expr("a.h <=> b.h")).select("a.h", "p", "n", "s", "hn", "hs", "hr")
    table = scratch.save(table, "rates")
    return table, g, k_host, strength(table, F.col("s") / F.col("n"), F.col("hr"))


def judged(rows: DataFrame, table: DataFrame, g: float, k_host: float, k_path: float) -> DataFrame:
    """rows (with h, p, z) with host_rate, path_rate (both without the row itself) and quality."""
    joined = rows.alias("d").join(broadcast_if_few(table).alias("t"), F.expr("d.h <=> t.h and d.p <=> t.p"))
    q = 1 / (1 + F.exp(-F.col("d.z")))
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = lambda c: F.log(c / (1 - c))
    host = clip((F.col("t.hs") - q + k_host * g) / (F.col("t.hn") - 1 + k_host))
    joined = joined.select("d.*", host.alias("host_rate"), F.col("t.n").alias("t_n"), F.col("t.s").alias("t_s"))
    path = clip((F.col("t_s") - 1 / (1 + F.exp(-F.col("z"))) + k_path * F.col("host_rate")) / (F.col("t_n") - 1 + k_path))
    joined = joined.withColumn("path_rate", path).drop("t_n", "t_s")
    final = F.col("z") - F.lit(float(np.log(g / (1 - g)))) + odds(F.col("path_rate"))
    return joined.withColumn("quality", 1 / (1 + F.exp(-final)))


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    most_labels: int = 20_000,
    threshold: float = 0.5,
) -> DataFrame:
    """id, doc_score, host_rate, path_rate, quality and kept of every row.

    The document classifier is fitted on a bounded sample of labels. Its probabilities are summed
    over all documents by (host, path); each host's rate is shrunk toward the global rate and each
    path's toward its host's, by strengths that the spread of all hosts and paths gives, leaving
    out the document in question. A document's odds are its own evidence times the odds of its
    path. Texts are read once for the scores (and labelled ones for the fit); the scores are
    written, and only sums per path are shuffled.

    Null and empty texts are scored on their features like others. Null hosts and paths are groups
    of their own. Null ids have no label but get a score. Without labels of both classes every
    document is kept, with probability 1/2. Repeated rows count once each; ties at ``threshold``
    are kept. Empty input gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    scores, model = own_scores(docs, labels, id_col, text_col, host_col, path_col, most_labels)
    names = ["doc_score", "host_rate", "path_rate", "quality", "kept"]
    if model is None:
        half = F.lit(0.5)
        return scores.select(F.col("id").alias(id_col), *(c.alias(n) for c, n in zip((F.lit(0.0), half, half, half, F.lit(True)), names)))
    scores = scratch.save(scores, "scores")
    found = judged(scores, *rates(scratch, scores))
    return found.select(F.col("id").alias(id_col), F.col("z").alias("doc_score"), *names[1:4], (F.col("quality") >= threshold).alias("kept"))


def good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    most_labels: int = 20_000,
    threshold: float = 0.5,
) -> DataFrame:
    """The rows of docs that ``score`` keeps, with all their columns.

    Texts are read and scored a second time, as joining scores to rows would shuffle them.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    scores, model = own_scores(docs, labels, id_col, text_col, host_col, path_col, most_labels)
    if model is None:
        return docs
    table = rates(scratch, scores)
    own = model.logit(features(F.coalesce(text_col, F.lit(""))))
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), F.col(host_col).cast("string").alias("h"), F.col(path_col).cast("string").alias("p"), own.alias("z"))
    return judged(rows, *table).where(F.col("quality") >= threshold).select("row.*")


def documents_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the quality of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, labels)
