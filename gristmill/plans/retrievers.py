"""Retrievers by name: a configuration becomes the DataFrame plan that gives (query_id, doc_id, score, rank)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import cluster, fusion, retrieve
from gristmill.sources.store import few, stored


@dataclass
class Inputs:
    """What retrieval may need: documents with text, queries, an index, vectors of both, a stored run, and documents outside the index.

    extra and extra_vectors are scored with the index's own statistics and ranked among its documents.
    """

    documents: DataFrame
    queries: DataFrame
    index: retrieve.Bm25Index | None = None
    vectors: DataFrame | None = None
    query_vectors: DataFrame | None = None
    run: DataFrame | None = None
    extra: DataFrame | None = None
    extra_vectors: DataFrame | None = None


def bm25(config: dict[str, Any], given: Inputs, k: int) -> DataFrame:
    options = {name: float(config.get("bm25", {}).get(name, default)) for name, default in (("k1", retrieve.K1), ("b", retrieve.B))}
    index = given.index or retrieve.bm25_index(given.documents)
    found = retrieve.bm25_top_k(index, given.queries, k, **options)
    if given.extra is None:
        return found
    return retrieve.merge_top_k(found.drop("rank"), retrieve.bm25_extra(index, given.extra, given.queries, **options, k=k), k).drop("is_extra")


def dense(config: dict[str, Any], given: Inputs, k: int) -> DataFrame:
    """Exact search, or a stored run's first k; documents outside are scored by their vectors."""
    options = config.get("dense", {})
    if options.get("use_precomputed"):
        if given.run is None:
            raise ValueError("a precomputed dense channel needs a stored run")
        base = retrieve.run_results(given.run, given.documents, k, given.queries)
    else:
        if given.vectors is None or given.query_vectors is None:
            raise ValueError("a dense channel needs vectors of documents and queries")
        base = retrieve.dense_top_k(given.vectors, given.query_vectors, k, options.get("score", "dot"))
    if given.extra_vectors is None:
        return base
    extra = retrieve.dense_top_k(given.extra_vectors, given.query_vectors, k, options.get("score", "dot")).drop("rank")
    return retrieve.merge_top_k(base.drop("rank"), extra, k).drop("is_extra")


def depth(config: dict[str, Any], k: int) -> int:
    return max(k, int(config.get("candidate_depth", 100)))


def rrf(config: dict[str, Any], given: Inputs, k: int) -> DataFrame:
    n = depth(config, k)
    weights = {name: float(config.get(f"{name}_weight", 1.0)) for name in ("dense", "bm25")}
    channels = fusion.channels_of({"dense": dense(config, given, n), "bm25": bm25(config, given, n)}, weights)
    return fusion.fuse(channels, k, rrf_k=int(config.get("rrf_k", 60)))


def hybrid(config: dict[str, Any], given: Inputs, k: int) -> DataFrame:
    n = depth(config, k)
    return fusion.hybrid(dense(config, given, n), bm25(config, given, n), k, float(config.get("alpha", 0.5)))


def ensemble(config: dict[str, Any], given: Inputs, k: int) -> DataFrame:
    n, rows, weights = depth(config, k), {}, {}
    for i, channel in enumerate(config.get("channels", [])):
        kind = str(channel.get("type", "dense")).lower()
        if kind not in CHANNELS:
            raise ValueError(f"an ensemble has no channel of type {kind}")
        name = str(channel.get("name", f"{kind}_{i}"))
        rows[name], weights[name] = CHANNELS[kind](channel, given, n), float(channel.get("weight", 1.0))
    if not rows:
        raise ValueError("an ensemble needs channels")
    cap = int(config.get("cluster_cap", 0))
    fused = fusion.fuse(
        fusion.channels_of(rows, weights), n if cap else k, mode=config.get("fusion", "consensus_rrf"), total=len(rows), rrf_k=int(config.get("rrf_k", 60)),
        support_bonus=float(config.get("support_bonus", 0.02)), single_penalty=float(config.get("single_penalty", 0.05)),
        missing_penalty=float(config.get("missing_penalty", 0.02)), min_support=int(config.get("min_support", 1)),
    )
    if not cap:
        return fused
    known = given.documents.select("doc_id", "text")
    if given.extra is not None:
        known = known.unionByName(given.extra.select("doc_id", "text"))
    grouped = cluster.leader_clusters(few(stored(fused)).join(known, "doc_id"), float(config.get("cluster_jaccard_threshold", 0.72)))
    return cluster.cap_clusters(grouped.drop("text"), cap, k)


CHANNELS: dict[str, Callable[[dict[str, Any], Inputs, int], DataFrame]] = {"dense": dense, "bm25": bm25}
RETRIEVERS = CHANNELS | dict.fromkeys(("rrf", "rrf_hybrid"), rrf) | dict.fromkeys(("hybrid", "normalized_hybrid", "paper_hybrid"), hybrid)
RETRIEVERS |= dict.fromkeys(("secure_ensemble", "consensus_ensemble", "robust_ensemble"), ensemble)


def build(config: dict[str, Any], given: Inputs, k: int) -> DataFrame:
    """The k best of each query by the retriever that config names (type) and sets up."""
    kind = str(config.get("type", "dense")).lower()
    if kind not in RETRIEVERS:
        raise ValueError(f"unknown retriever type {kind}")
    return RETRIEVERS[kind](config, given, k)


def truth_contexts(qrels: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, contexts): the texts of each query's judged documents that exist, in qrels' order (ord)."""
    rows = qrels.join(documents.select("doc_id", "text"), "doc_id")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "doc_id", "text"))), lambda x: x["text"])
    return rows.groupBy("query_id").agg(texts.alias("contexts"))


def sampled_queries(queries: DataFrame, n: int, seed: int = 12) -> DataFrame:
    """n queries drawn without replacement, the same ones for a seed: those of least hash."""
    return queries.withColumn("_draw", F.xxhash64(F.col("query_id"), F.lit(seed))).orderBy("_draw", "query_id").limit(n).drop("_draw")


def encode(rows: DataFrame, id_col: str, text_col: str, encoder: Callable[[], Callable[[list[str]], Any]], batch: int = 64) -> DataFrame:
    """(id, vector) by a model: ``encoder`` is called once a task and gives a function from texts to vectors, in batches."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(frames):
        import pandas as pd

        model = encoder()
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({id_col: part[id_col], "vector": [list(map(float, v)) for v in model([t or "" for t in part[text_col]])]})

    return rows.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, vector array<float>")
