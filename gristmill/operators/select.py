"""Order, caps and gates of a query's candidates; ``choose`` has what goes on from there.

Candidates are rows (query_id, doc_id, rank, score, cluster_id, mentions, ...). A query has at most
the retrieval depth of them, so what depends on order folds or runs within a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import constants as C
from gristmill.functions import text as T


def answer() -> Column:
    """A candidate's first answer; null without mentions."""
    return F.get(F.col("mentions"), F.lit(0))["key"]


def by_score(candidates: DataFrame) -> DataFrame:
    """candidates with place: by score, then by original rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return candidates.withColumn("place", F.row_number().over(order))


def renumbered(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def caps(placed: DataFrame, k: int, per_cluster: int = 1, per_answer: int = 0) -> DataFrame:
    """placed with cap: accepted, cluster, answer or beyond, going through each query in order until k are accepted.

    A document that one cap turns down does not count for the other.
    """
    pool = F.array_sort(F.collect_list(F.struct("place", "doc_id", "cluster_id", F.coalesce(answer(), F.lit("")).alias("answer"))))
    kind = placed.schema["doc_id"].dataType.simpleString()
    none = F.array().cast(f"array<struct<doc_id: {kind}, cluster_id: int, answer: string, cap: string>>")

    def step(done, row):
        taken = F.filter(done, lambda d: d["cap"] == "accepted")
        in_cluster = F.size(F.filter(taken, lambda d: d["cluster_id"] == row["cluster_id"]))
        of_answer = F.size(F.filter(taken, lambda d: d["answer"] == row["answer"]))
        verdict = F.when(F.size(taken) >= k, "beyond")
        if per_cluster > 0:
            verdict = verdict.when(in_cluster >= per_cluster, "cluster")
        if per_answer > 0:
            verdict = verdict.when((row["answer"] != "") & (of_answer >= per_answer), "answer")
        new = F.struct(row["doc_id"].alias("doc_id"), row["cluster_id"].cast("int").alias("cluster_id"), row["answer"].alias("answer"), verdict.otherwise("accepted").alias("cap"))
        return F.concat(done, F.array(new))

    folded = placed.groupBy("query_id").agg(F.aggregate(pool, none, step).alias("d")).select("query_id", F.explode("d").alias("d"))
    return placed.join(folded.select("query_id", "d.doc_id", "d.cap"), ["query_id", "doc_id"])


def accepted(capped: DataFrame) -> DataFrame:
    """The accepted documents, placed 1 to k."""
    return renumbered(capped.where("cap = 'accepted'").drop("cap"), F.col("place"))


# --- gates on where documents come from ------------------------------------------------------------


def provenance_class(provenance: Column) -> Column:
    where = T.normalize(provenance)
    return F.when(where.isin(*C.TRUSTED_PROVENANCE), "trusted").when(where.isin(*C.UNTRUSTED_PROVENANCE), "untrusted").otherwise("unknown")


def provenance_gate(candidates: DataFrame, unknown: str = "quarantine") -> DataFrame:
    """candidates with provenance_class and eligible; unknown provenance is quarantined or allowed."""
    if unknown not in ("quarantine", "allow"):
        raise ValueError("unknown must be quarantine or allow")
    kind = provenance_class(F.col("provenance"))
    return candidates.withColumn("provenance_class", kind).withColumn("eligible", (kind == "trusted") | ((kind == "unknown") & F.lit(unknown == "allow")))


def provenance_diagnostics(gated: DataFrame) -> DataFrame:
    """Per query: counts by class and the first 20 quarantined documents."""
    out = F.transform(F.slice(F.array_sort(F.collect_list(F.when(~F.col("eligible"), F.struct("rank", "doc_id")))), 1, 20), lambda x: x["doc_id"])
    return gated.groupBy("query_id").agg(
        F.count("*").alias("input_count"), F.count_if("eligible").alias("eligible_count"), F.count_if(F.col("provenance_class") == "trusted").alias("trusted_count"),
        F.count_if(~F.col("eligible") & (F.col("provenance_class") == "untrusted")).alias("untrusted_quarantined"),
        F.count_if(~F.col("eligible") & (F.col("provenance_class") == "unknown")).alias("unknown_quarantined"), out.alias("quarantined"),
    )


def authority_gate(candidates: DataFrame, required: DataFrame, authoritative: tuple[str, ...] = tuple(C.TRUSTED_PROVENANCE)) -> DataFrame:
    """candidates without those of no authority, for the queries (query_id, require_authority) whose policy asks for it."""
    rows = candidates.join(required.select("query_id", "require_authority"), "query_id", "left")
    keep = ~F.coalesce("require_authority", F.lit(False)) | T.normalize(F.col("provenance")).isin(*authoritative)
    return rows.where(keep).drop("require_authority")
