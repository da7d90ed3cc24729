"""Sources with declared schemas, and sinks."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources.store import numbered

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
AUTHORITY = "array<struct<name: string, url: string, authority: string, jurisdiction: string, accessed_at: string>>"
CONSEQUENCE = (
    "consequence_id string, domain string, decision_type string, severity string, cost_weight double, harm_description string, applicable_condition string,"
    " match struct<phrases: array<string>, patterns: array<string>, min_phrase_matches: int>,"
    " required_policy struct<min_support_margin: double, min_independent_support_groups: int, abstain_on_conflict: boolean, require_authoritative_source: boolean>,"
    f" authority_sources {AUTHORITY}"
)
HAZARD = (
    "policy_id string, domain string, policy_text string, scope_exclusions array<string>, domain_aliases array<string>, action_aliases map<string, array<string>>,"
    " harm_target_aliases map<string, array<string>>, decision_by_intent map<string, string>, consequence_ids array<string>"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str) -> None:
    """All tables of a folder as temporary views for SQL."""
    for name in TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)


def beir_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, title string, text string").json(path).withColumnRenamed("_id", "doc_id")


def beir_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("query_id"), F.col("text").alias("query"))


def beir(spark: SparkSession, folder: str, name: str, split: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus, queries and qrels of a data set's folder; of msmarco only the train split is judged."""
    path, split = f"{folder}/{name}", "train" if name == "msmarco" else split
    return beir_corpus(spark, f"{path}/corpus.jsonl"), beir_queries(spark, f"{path}/queries.jsonl"), beir_qrels(spark, f"{path}/qrels/{split}.tsv")


def beir_qrels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_id string, doc_id string, rel int").csv(path, sep="\t", header=True)


def titled(corpus: DataFrame) -> DataFrame:
    """Title and text in one, the title alone where there is no text."""
    title, text = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    both = F.when(title == "", text).when(text == "", title).otherwise(F.concat_ws("\n", title, text))
    return corpus.withColumn("text", both)


def index_subset(corpus: DataFrame, qrels: DataFrame, most: int) -> DataFrame:
    """The first ``most`` documents in corpus order (ord) and all relevant ones of qrels."""
    relevant = qrels.where(F.col("rel") > 0).select("doc_id").distinct().withColumn("_rel", F.lit(True))
    rows = corpus.join(relevant, "doc_id", "left")
    return rows.where(F.coalesce(F.col("ord") <= most, F.lit(False)) | F.coalesce("_rel", F.lit(False))).drop("_rel").dropDuplicates(["doc_id"])


def poison_documents(targets: DataFrame, per_query: int, mode: str = "question_prefix") -> DataFrame:
    """Rows of targets' labelled texts: id, text (after the question or alone), where they come from and for whom."""
    if mode not in ("question_prefix", "suffix_only"):
        raise ValueError(mode)
    rows = targets.select("query_id", "question", F.posexplode(F.slice("adv_texts", 1, per_query)).alias("i", "t"))
    text = F.concat_ws(".", "question", "t") if mode == "question_prefix" else F.col("t")
    return rows.select(
        F.concat_ws("::", F.lit("adv"), "query_id", "i").alias("doc_id"), text.alias("text"), F.lit("runtime_external").alias("provenance"),
        F.col("query_id").alias("target_id"), F.col("i").alias("adv_idx"), F.lit(True).alias("is_adv"),
    )


def targets(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, question string, `correct answer` string, `incorrect answer` string, adv_texts array<string>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(
        F.col("id").alias("query_id"), "question", F.col("correct answer").alias("correct_answer"), F.col("incorrect answer").alias("incorrect_answer"), "adv_texts"
    )


def target_window(rows: DataFrame, offset: int, size: int) -> DataFrame:
    """Rows offset+1 to offset+size by ord; an error where there are fewer."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    found = rows.where(F.col("ord").between(offset + 1, offset + size))
    if found.count() < size:
        raise ValueError("too few targets")
    return found


def stored_run(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of ranked objects as (query_id, doc_id, score, ord); the order within a query is kept.

    The file is cut at closing braces, one query a record, so splits of a large file are read by as
    many tasks. Ids must therefore hold no closing brace: what is no query's object raises an error.
    """
    rows = spark.read.text(path, lineSep="}").select(F.regexp_replace("value", r"^\s*[{,]?\s*|\s+\z", "").alias("value")).where("value <> ''")
    whole = F.concat(F.lit("{"), F.col("value"), F.lit("}}"))
    parsed = F.from_json(whole, "map<string, map<string, double>>", {"mode": "FAILFAST"})
    rows = rows.select(F.explode(parsed).alias("query_id", "docs"))
    return rows.select("query_id", F.posexplode(F.map_entries("docs")).alias("p", "e")).select("query_id", "e.key", "e.value", (F.col("p") + 1).alias("ord")).toDF(
        "query_id", "doc_id", "score", "ord"
    )


def consequence_policies(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, CONSEQUENCE)


def hazard_policies(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, HAZARD).drop("policy_order")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small file's JSON lines with their place in it (policy_order); blank lines are skipped, others must parse."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("policy_order", "line"))
    parsed = F.from_json(F.col("line"), schema, {"mode": "FAILFAST"})
    return lines.where(F.trim("line") != "").select(parsed.alias("p"), F.col("policy_order").cast("long").alias("policy_order")).select("p.*", "policy_order")


def policy_rows(spark: SparkSession, rows: list[dict[str, Any]], schema: str) -> DataFrame:
    """A small policy table from Python values."""
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schema).alias("p")).select("p.*")


def passages(spark: SparkSession, path: str) -> DataFrame:
    """Passages from JSON lines, or else from tab-separated id, text, title with a header."""
    if path.endswith((".jsonl", ".json")):
        return spark.read.schema("id string, title string, text string").json(path)
    return spark.read.schema("id string, text string, title string").csv(path, sep="\t", header=True).select("id", "title", "text")


def finetune_examples(spark: SparkSession, paths: list[str], rank: int = -1, world: int = 1, most: int = 0) -> DataFrame:
    """Examples of JSON arrays (.json) and JSON lines (.jsonl) in the paths' order, numbered from 1 (ord).

    With a rank, only those whose number leaves it when divided by world; with most, only the first so many.
    """
    ctx = "array<struct<title: string, text: string>>"
    schema = f"question string, positive_ctxs {ctx}, negative_ctxs {ctx}, hard_negative_ctxs {ctx}"
    parts = []
    for at, path in enumerate(paths):
        rows = spark.read.schema(schema).json(path, multiLine=path.endswith(".json"))
        parts.append(rows.withColumns({"_file": F.lit(at), "_place": F.monotonically_increasing_id()}))
    rows = numbered(reduce(DataFrame.unionByName, parts), F.col("_file"), F.col("_place")).drop("_file", "_place")
    if most > 0:
        rows = rows.where(F.col("ord") <= most)
    return rows.where(F.col("ord") % world == rank) if rank > -1 else rows


def qa_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("question string, answers array<string>, ctxs array<struct<id: string, title: string, text: string>>").json(path)


def embedding_cache_key(ids: DataFrame) -> DataFrame:
    """One row: sha1 of the first and last 100 ids in order (ord) and their number."""
    ends = ids.orderBy("ord").limit(100).unionByName(ids.orderBy(F.desc("ord")).limit(100)).distinct()
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("doc_id").cast("string").alias("d")))), lambda x: x["d"]), "|")
    return ends.agg(listed.alias("k")).crossJoin(ids.agg(F.count("*").alias("n"))).select("n", F.sha1(F.concat_ws("|", "k", "n")).alias("key"))


def ids_digest(ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """One row (n, digest, mixed) that tells two bags of ids apart whatever their order: their number, and sums of two hashes, which partial results add up to."""
    text = F.col(column).cast("string")
    total = F.sum(F.xxhash64(text, F.lit("ids")).cast("decimal(20,0)")).cast("decimal(38,0)")
    return ids.agg(F.count("*").alias("n"), F.coalesce(total, F.lit(0)).cast("decimal(38,0)").alias("digest"), F.coalesce(F.bit_xor(F.xxhash64(F.lit("mixed"), text)), F.lit(0)).alias("mixed"))


def write_vectors(vectors: DataFrame, path: str, model: str) -> None:
    """The vectors, and beside them the model's name and a digest of the ids."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    written = vectors.sparkSession.read.parquet(f"{path}/vectors")
    ids_digest(written).withColumn("model", F.lit(model)).write.mode("overwrite").parquet(f"{path}/of")


def read_vectors(spark: SparkSession, path: str, model: str, ids: DataFrame) -> DataFrame | None:
    """The stored vectors, if they are the model's and have exactly these ids, each as often; else None. Only digests are compared."""
    of = spark.read.parquet(f"{path}/of").first()
    asked = ids_digest(ids).first()
    same = of is not None and of["model"] == model and all(of[c] == asked[c] for c in ("n", "digest", "mixed"))
    return spark.read.parquet(f"{path}/vectors") if same else None


def write_results(results: DataFrame, path: str) -> None:
    """JSON by iteration, so that each can be written as it ends."""
    results.write.mode("append").partitionBy("iter").json(path)


def write_summary(summary: DataFrame, columns: list[str], path: str) -> None:
    summary.select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=True)


def console_table(summary: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers with four digits, and a dash for null."""
    shown = [
        F.coalesce(F.format_string("%.4g", F.col(c).cast("double")) if summary.schema[c].dataType.typeName() in ("double", "float") else F.col(c).cast("string"), F.lit("-")).alias(c)
        for c in columns
    ]
    return summary.select(*shown)


def run_summaries(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(summaries, results without one) of a folder, by file stem; unreadable files give null fields and are left out."""
    path = F.col("_metadata.file_name")
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(f"{folder}/*.json", multiLine=True).withColumn("file", path)
    rows = rows.withColumn("stem", F.regexp_replace("file", r"(\.summary)?\.json$", ""))
    done = rows.where(F.col("file").endswith(".summary.json"))
    return done, rows.where(~F.col("file").endswith(".summary.json")).join(done.select("stem"), "stem", "left_anti")


ALPHA = ("hybrid", "normalized_hybrid", "paper_hybrid")
ENSEMBLES = ("secure_ensemble", "consensus_ensemble", "robust_ensemble")


def run_name(config: dict[str, Any]) -> str:
    """A run's own name, or one that its settings alone decide: what is fused, hardened, attacked and skipped adds a part each."""
    if config.get("run_name"):
        return config["run_name"]
    retriever = config["retriever"]
    kind = retriever["type"]
    parts = [config["dataset"], kind, config["model_name"], f"Top{config['top_k']}", f"M{config['M']}x{config['repeat_times']}"]
    if kind.lower() in ALPHA:
        parts.append("alpha" + f"{float(retriever.get('alpha', 0.5)):g}".translate(str.maketrans("-.", "mp")))
    if kind.lower() in ENSEMBLES:
        parts += [retriever.get("fusion", "consensus_rrf"), f"s{retriever.get('min_support', 1)}", f"cap{retriever.get('cluster_cap', 0)}"]
    hardening = config.get("evidence_hardening") or {}
    if hardening.get("enabled"):
        of = lambda section, key, default: (hardening.get(section) or {}).get(key, default)
        on = lambda section: int(bool(of(section, "enabled", True)))
        parts += [f"eh{hardening.get('candidate_depth', config['top_k'])}", f"c{of('cluster', 'cap', 1)}", f"a{on('answer_support')}"]
        parts += [f"ac{of('answer_support', 'max_docs_per_answer', 0)}", f"x{on('contradiction')}"]
        if of("head_filter", "enabled", False):
            parts += [f"hf{of('head_filter', 'head_k', 3)}", f"hs{of('head_filter', 'supplement_k', 2)}", str(of("head_filter", "mode", "conservative")).lower()[:4]]
    if str(config.get("attack_method") or "none").lower() != "none":
        parts += ["adv", config["attack_method"], str(config["adv_per_query"])]
    return "-".join(map(str, parts + (["retrieval-only"] if config.get("skip_llm") else [])))
