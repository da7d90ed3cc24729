"""Packing of tokenized documents into sequences, by estimated attention cost."""

from __future__ import annotations

import base64
import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import batch_slices, frugal

END = 1
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, cost double"


class BatchTokenizer:
    """Token ids of whole texts by a byte-level BPE vocabulary given as ranks.

    The vocabulary's pattern takes a look ahead only for runs of white space, and looking ahead
    is what makes it slow. Texts where every white-space character stands alone (a space or a
    line end) are parted by the same pattern without it, with the same ids. Tokens ``added`` to
    the vocabulary (text: id) get their own id wherever a text holds them.
    """

    #: The contractions and classes of the vocabulary's own pattern.
    PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
    RARE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.added = dict(added or {})
        self.full, self.plain = (
            tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens=self.added) for name, p in (("full", pattern), ("plain", self.PLAIN))
        )

    def is_plain(self, text: str) -> bool:
        pairs = "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1:].isspace()
        return not (pairs or any(c in text for c in self.RARE))

    def encode(self, text: str | None) -> np.ndarray:
        if text and any(token in text for token in self.added):
            ids = self.full.encode(text, allowed_special="all")
        else:
            ids = (self.plain if self.is_plain(text) else self.full).encode_ordinary(text) if text else []
        ids.append(END)
        return np.frombuffer(array("I", ids), dtype=np.uint32)


def added_tokens(json_path: str) -> dict[str, int]:
    """The tokens that a tokenizer's JSON file adds to its vocabulary, with their ids."""
    with open(json_path, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def assign(lengths: list[int], size: int, linear: float, quadratic: float) -> tuple[list[list[tuple[int, int, int]]], list[float], list[int]]:
    """Pieces (document, start, length) by sequence, the sequences' costs and their capacities.

    The capacities sum to the tokens: full sequences, and a rest split into powers of two, which
    need no padding. Whole capacities are first cut off documents of more than ``size`` tokens.
    Then in descending length each piece goes to the sequence of lowest cost that still holds it;
    pieces that none holds are cut to fill what is left, lowest cost first.
    """
    total = sum(lengths)
    rest = total % size
    capacity = [size] * (total // size) + [1 << k for k in reversed(range(size.bit_length())) if rest >> k & 1]
    n = len(capacity)
    free, cost = np.array(capacity, dtype=np.int64), np.zeros(n)
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]

    def put(s: int, doc: int, start: int, length: int) -> None:
        held[s].append((doc, start, length))
        free[s] -= length
        cost[s] += linear * length + quadratic * length * length

    left, at = [], 0
    for doc, length in enumerate(lengths):
        start = 0
        while length - start >= size:
            put(at, doc, start, size)
            at, start = at + 1, start + size
        if length > start:
            left.append((length - start, doc, start))
    left.sort(key=lambda x: (-x[0], x[1]))
    over = []
    for length, doc, start in left:
        fits = np.flatnonzero(free >= length)
        if len(fits):
            put(int(fits[np.argmin(cost[fits])]), doc, start, length)
        else:
            over.append((length, doc, start))
    gaps = [int(s) for s in np.argsort(cost, kind="stable") if free[s] > 0]
    for length, doc, start in over:
        while length:
            take = min(length, int(free[gaps[0]]))
            put(gaps[0], doc, start, take)
            length, start = length - take, start + take
            if not free[gaps[0]]:
                gaps.pop(0)
    return held, cost.tolist(), capacity


def pack(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    window_tokens: int = 3_000_000,
    added: dict[str, int] | None = None,
) -> DataFrame:
    """One row per piece: the document's id, where the piece starts, its tokens and its sequence.

    Each task packs what it reads in windows of about ``window_tokens``, so memory is bounded,
    nothing is shuffled, and a lost task is simply run again. A window pads nothing: its rest
    goes into sequences of a power of two. Sequences are numbered by task and within it.

    Null or empty text is the single end id. Null ids and repeated rows are packed like others.
    Very long texts give full sequences of their own and a remainder. Empty input gives no rows.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}"

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder, sequence = BatchTokenizer(ranks_path, pattern, added), task << 32
        keys: list = []
        ids: list[np.ndarray] = []
        tokens = 0

        def close():
            nonlocal sequence
            held, cost, capacity = assign([len(x) for x in ids], size, linear, quadratic)
            rows = []
            for s, pieces in enumerate(held):
                offset = 0
                for doc, start, length in pieces:
                    piece = ids[doc][start : start + length]
                    rows.append((doc, start, length, zlib.crc32(piece.astype("<u4").tobytes()), len(ids[doc]), sequence + s, offset, capacity[s], cost[s]))
                    offset += length
            sequence += len(held)
            for i in range(0, len(rows), 50_000):
                doc, *columns = zip(*rows[i : i + 50_000])
                types = [pa.int64()] * 7 + [pa.float64()]
                arrays = [pa.array([keys[d] for d in doc], type=key_type)] + [pa.array(c, type=t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "cost"]
        key_type = pa.int64()
        for batch in batches:
            key_type = batch.schema.field(0).type
            for part in batch_slices(batch):
                found = [encoder.encode(x) for x in part.column(1).to_pylist()]
                ids += found
                keys += part.column(0).to_pylist()
                tokens += sum(map(len, found))
                if tokens >= window_tokens:
                    yield from close()
                    keys, ids, tokens = [], [], 0
        if ids:
            yield from close()

    return docs.select(id_col, text_col).mapInArrow(frugal(run), schema)


def documents_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents in sequences of at most 2048 tokens.

    The ids are those of byte_bpe_50k.json with its added tokens; the ranks are the same vocabulary.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", F.round("cost", 3).alias("cost")
    )
