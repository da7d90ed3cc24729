"""The corpus pipeline: five stages, each one operator over all that the stage before kept.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Rows with
null ids, null or empty texts, null sources or languages, and repeated rows pass every stage by
the rules that each states; texts of any length are taken whole; other columns of documents,
whatever they are called, stay with their rows; empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import lines, mixing, neardup, packing, quality
from gristmill.llm.common import Scratch, columns_of, spent


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null and empty texts are judged by their features and site like others; without labels of both
    classes all stay. Each of repeated rows is judged alike. Ties at one half stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.good(docs, labels)


def without_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many texts of their source hold, copies counting once; n_chars follows the text.

    No row goes. Null texts and those of a null source stay as they are; a text of boilerplate alone may become empty.
    """
    text = lines.drop_site_lines_of_pages(docs)
    length = F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))
    return text.withColumn("n_chars", length).select(*columns_of(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (80% of their five-word shingles): that of the least id.

    Rows with a null id, and rows without words, are near nothing and stay; of equal rows with one id one stays.
    """
    return neardup.without_near_duplicates(docs, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: up to twice, and some not at all.

    Null sources are one source; documents without words are taken once. Repeated rows are dealt as rows of their own.
    """
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, one row each; null and empty texts are the single end id.

    Copies of a document are packed apart. Ties of cost go to the sequence of least number.
    """
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


STAGES = [
    ("quality", good_documents),
    ("lines", without_site_lines),
    ("near_duplicates", one_of_each_group),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: SQL expresses neither the fitted classifier nor the packing; tests/llm/test_run.py holds run() against a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next.

    A stage's own tables and its predecessor's output go once it is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        before = docs
        with spent():
            docs = scratch.save(stage(spark, before, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
