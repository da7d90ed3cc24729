"""Operator 13: ranked lexical search over a two-level index, bytes for bounds and term counts for exact scores."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import Scratch, batch_slices, broadcast_if_few, frugal

#: Impacts are below a million and are rounded up to whole steps, which fit a byte.
SCALE, STEP = 1_000_000, 4000
K = 50
#: A block ends with the text that brings it to so many bytes; its documents are numbered in two bytes.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 1 << 16
#: Queries are asked in groups of about this many.
CHUNK = 256
NO_ID = -(2**63)

#: Terms are runs of bytes beyond ASCII, letters and digits, A-Z made small; all else is a space.
_TERM = bytearray(b" " * 256)
for _c in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _TERM[_c] = _c
for _c in range(0x41, 0x5B):
    _TERM[_c] = _c + 32
TERM = bytes(_TERM)


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text in order."""
    return text.encode().translate(TERM).split() if text else []



def damped(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m, the length part of the divisor, of documents with n terms."""
    return 50 + (50 * n * documents) // max(1, total)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def narrow(values: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; ``wide`` reads them."""
    top = int(values.max())
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{len(data) // n}").astype(np.int64)


class Index:
    """postings(block, term, df, ords, impacts, tfs), docs(block, keys, lengths), and the numbers of documents with terms and of terms.

    A block's row of a term lists the documents of the block that hold it (two bytes each), their
    impacts rounded up (a byte each, the first level) and the term's counts (the second). Bounds read
    the first level alone. Every document of the input is in one block.
    """

    def __init__(self, postings: DataFrame, docs: DataFrame, documents: int, total: int):
        self.postings, self.docs, self.documents, self.total = postings, docs, documents, total


def build(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> Index:
    """The index of all documents: one reading for the two totals that impacts need, one for the blocks; nothing is shuffled but counts."""

    def sizes(batches):
        for batch in batches:
            held = total = 0
            for part in batch_slices(batch, 0):
                for text in part.column(0).to_pylist():
                    n = len(terms_of(text))
                    held, total = held + (n > 0), total + n
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([total], pa.int64())], names=["held", "total"])

    counted = docs.select(text_col).mapInArrow(frugal(sizes), "held long, total long").agg(F.sum("held"), F.sum("total")).first()
    documents, total = counted[0] or 0, counted[1] or 0

    def block(at, keys, lengths, ids, names):
        n = np.array(lengths, dtype=np.int64)
        if ids:
            found = np.concatenate(ids) * len(keys)
            found += np.repeat(np.arange(len(keys)), n)
            found, tf = np.unique(found, return_counts=True)
            term, ords = np.divmod(found, len(keys))
            q = -(-impact(tf, damped(n, documents, total)[ords]) // STEP)
            edges = np.flatnonzero(np.diff(term, prepend=-1, append=-1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int64()), pa.array([None], pa.string()), pa.array([0], pa.int64()), *(pa.array([None], pa.binary()) for _ in range(3)), pa.array([keys], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64()))],
            names=columns,
        )
        if not ids:
            return
        words = np.empty(len(names), dtype=object)
        for w, i in names.items():
            words[i] = w
        ords, q = ords.astype("<u2"), q.astype(np.uint8)
        for lo in range(0, len(edges) - 1, 50_000):
            cut = edges[lo : lo + 50_001].tolist()
            rows = list(zip(cut[:-1], cut[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), at)),
                    pa.array([words[term[a]].decode() for a, _ in rows], pa.string()),
                    pa.array(np.diff(cut), pa.int64()),
                    pa.array([ords[a:b].tobytes() for a, b in rows], pa.binary()),
                    pa.array([q[a:b].tobytes() for a, b in rows], pa.binary()),
                    pa.array([narrow(tf[a:b]) for a, b in rows], pa.binary()),
                    pa.nulls(len(rows), pa.list_(pa.int64())),
                    pa.nulls(len(rows), pa.list_(pa.int64())),
                ],
                names=columns,
            )

    columns = ["block", "term", "df", "ords", "impacts", "tfs", "keys", "lengths"]

    def run(batches):
        number = count(TaskContext.get().partitionId() << 32)
        fresh = lambda: ([], [], [], defaultdict(count().__next__))
        keys, lengths, ids, names = fresh()
        size = 0
        for batch in batches:
            for part in batch_slices(batch):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = terms_of(text)
                    keys.append(key)
                    lengths.append(len(found))
                    ids.append(np.fromiter(map(names.__getitem__, found), np.int64, len(found)))
                    size += len(text or "")
                    if size >= block_bytes or len(keys) == block_rows:
                        yield from block(next(number), keys, lengths, ids, names)
                        keys, lengths, ids, names = fresh()
                        size = 0
        if keys:
            yield from block(next(number), keys, lengths, ids, names)

    kinds = "block long, term string, df long, ords binary, impacts binary, tfs binary, keys array<bigint>, lengths array<bigint>"
    table = scratch.save(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(frugal(run), kinds), "index")
    postings = table.where("term is not null").select(*columns[:6])
    return Index(postings, table.where("term is null").select("block", "keys", "lengths"), documents, total)


def asked_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term): each term of each query once; texts that share an id are one query."""

    def run(batches):
        for batch in batches:
            found = [[x.decode() for x in dict.fromkeys(terms_of(t))] for t in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([w for x in found for w in x], pa.string())], names=["item", "term"])

    kind = queries.schema[id_col].dataType.simpleString()
    return queries.select(id_col, text_col).mapInArrow(run, f"item {kind}, term string").distinct()


class Bounds:
    """A block's rows of query terms as arrays, and by query its (row, weight) pairs."""

    def __init__(self, table: pa.Table):
        self.ords = [np.frombuffer(x, dtype="<u2") for x in table["ords"].to_pylist()]
        self.up = [np.frombuffer(x, dtype=np.uint8).astype(np.int64) for x in table["impacts"].to_pylist()]
        self.size = 1 + max((int(x[-1]) for x in self.ords), default=-1)
        self.queries: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for row, wanted in enumerate(table["wanted"].to_pylist()):
            for x in wanted:
                self.queries[x["q"]].append((row, x["w"]))

    def upper(self, q: int) -> np.ndarray:
        out = np.zeros(self.size, dtype=np.int64)
        for row, w in self.queries[q]:
            out[self.ords[row]] += w * self.up[row]
        return out * STEP

    def lower(self, q: int) -> np.ndarray:
        out = np.zeros(self.size, dtype=np.int64)
        for row, w in self.queries[q]:
            out[self.ords[row]] += w * np.maximum(self.up[row] - 1, 0)
        return out * STEP


def largest(values: np.ndarray, k: int) -> np.ndarray:
    return values if len(values) <= k else np.partition(values, len(values) - k)[-k:]


def search(scratch: Scratch, index: Index, queries: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id_col, rank, doc_id, score): the k best documents of each query with a score above 0, equal scores by ascending doc_id.

    First each block gives, for each query, its k greatest lower bounds and its greatest upper bound,
    from impacts in bytes alone. A query's k-th lower bound over all blocks is at most its k-th
    score, so only documents whose upper bound reaches it are scored exactly, in their
    blocks, from the counts; a block passes on its k best. Blocks that no bound reaches are not read again.

    Null query texts have no terms and no rows, as queries have without terms of the index. Null
    document ids come first among equals. Rows that repeat an id are documents of their own. Empty tables give no rows.
    """
    asked = scratch.save(asked_terms(queries, id_col, text_col), "asked")
    found = index.postings.select("term", "df").join(broadcast_if_few(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    items = scratch.save(asked.select("item").distinct().coalesce(1).select("item", F.monotonically_increasing_id().alias("q")), "items")
    chunks = max(1, -(-items.count() // chunk))
    weights = asked.join(found.select("term", weight.alias("w")), "term").where("w > 0")
    weights = weights.join(broadcast_if_few(items), F.equal_null(weights["item"], items["item"])).select("term", "w", "q", F.pmod("q", F.lit(chunks)).alias("chunk"))
    wanted = scratch.save(weights.groupBy("chunk", "term").agg(F.collect_list(F.struct("q", "w")).alias("wanted")), "wanted")
    few = broadcast_if_few(wanted)

    def bounds(table: pa.Table) -> pa.Table:
        block, at, held = table["block"][0].as_py(), table["chunk"][0].as_py(), Bounds(table)
        qs = list(held.queries)
        tops, lows = [], []
        for q in qs:
            tops.append(int(held.upper(q).max()))
            low = held.lower(q)
            lows.append(largest(low[low > 0], k))
        n = len(qs)
        return pa.table({"block": pa.array([block] * n, pa.int64()), "chunk": pa.array([at] * n, pa.int64()), "q": pa.array(qs, pa.int64()), "top": pa.array(tops, pa.int64()), "lows": pa.array(lows, pa.list_(pa.int64()))})

    first = index.postings.select("block", "term", "ords", "impacts").join(few, "term").drop("term").groupBy("block", "chunk")
    bounded = scratch.save(first.applyInArrow(bounds, "block long, chunk long, q long, top long, lows array<bigint>"), "bounds")
    low = bounded.select("q", F.explode("lows").alias("low"))
    kth = low.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))).where(F.col("at") <= k)
    kth = scratch.save(kth.groupBy("q").agg(F.when(F.count("*") == k, F.min("low")).otherwise(F.lit(0)).alias("least")), "kth")
    reached = bounded.join(broadcast_if_few(kth), "q", "left").withColumn("least", F.coalesce("least", F.lit(0))).where("top > 0 and top >= least")
    reached = scratch.save(reached.groupBy("block", "chunk").agg(F.collect_list(F.struct("q", "least")).alias("asked")), "reached")
    documents, total = index.documents, index.total

    def exact(rows: pa.Table, block: pa.Table) -> pa.Table:
        qs, ids, scores = [], [], []
        if rows.num_rows and block.num_rows:
            held = Bounds(rows)
            tfs = [wide(x, len(o)) for x, o in zip(rows["tfs"].to_pylist(), held.ords)]
            keys = block["keys"][0].values.fill_null(NO_ID).to_numpy()
            m = damped(block["lengths"][0].values.to_numpy(), documents, total)
            for x in block["asked"][0].as_py():
                likely = held.upper(x["q"])
                likely = (likely > 0) & (likely >= x["least"])
                score = np.zeros(held.size, dtype=np.int64)
                for row, w in held.queries[x["q"]]:
                    ords = held.ords[row]
                    taken = likely[ords]
                    at = ords[taken]
                    score[at] += w * impact(tfs[row][taken], m[at])
                at = np.flatnonzero(score)
                at = at[np.lexsort((keys[at], -score[at]))[:k]]
                qs += [x["q"]] * len(at)
                ids.append(keys[at])
                scores.append(score[at])
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        scores = np.concatenate(scores) if scores else np.zeros(0, np.int64)
        return pa.table({"q": pa.array(qs, pa.int64()), "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "score": pa.array(scores, pa.int64())})

    again = index.postings.join(few, "term").drop("term", "df").join(broadcast_if_few(reached.select("block", "chunk")), ["block", "chunk"], "left_semi")
    scored = again.groupBy("block", "chunk").cogroup(reached.join(index.docs, "block").groupBy("block", "chunk")).applyInArrow(exact, "q long, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(broadcast_if_few(items), "q").select(F.col("item").alias(id_col), "rank", "doc_id", "score")


def items_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all documents for each benchmark item."""
    scratch = Scratch(spark, "search")
    index = build(scratch, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(scratch, index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, total GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id), total GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
