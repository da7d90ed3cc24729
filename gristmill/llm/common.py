"""Shared pieces: intermediate tables, numpy shingling of whole Arrow batches, components of a graph."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources.store import folder

U64 = np.uint64


_HELD: list[list[Scratch]] = []


class Scratch:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    A table survives the loss of executors and cuts the lineage. ``drop`` removes tables that no
    later step reads; ``spent`` removes all that operators called inside it have made.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        for held in _HELD:
            held.append(self)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            if path := getattr(table, "_scratch_path", None):
                self._delete(path)

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def spent():
    """All tables made by operators that are called inside go at its end; save what is read later elsewhere."""
    held: list[Scratch] = []
    _HELD.append(held)
    try:
        yield
    finally:
        _HELD.remove(held)
        for scratch in held:
            scratch.clear()


#: A table of at most this many rows of a few numbers each is broadcast (some 64 MB); others are shuffled.
FEW_ROWS = 1_000_000


def broadcast_if_few(table: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """The saved table, marked for broadcast where its count is small; Spark joins it by a shuffle where it is not."""
    return F.broadcast(table) if table.count() <= most else table


def named(column: str) -> str:
    """A column's name as one part, whatever dots and backticks it has."""
    return "`" + column.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df under their names, whatever these are."""
    return [F.col(named(c)) for c in df.columns]


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that df has no column of, whatever its extra columns are called."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


# --- numpy over the text column of an Arrow batch --------------------------------------------

#: A word is [^\x20\x09-\x0D]+; these six bytes part words in UTF-8 as well.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE, STEP = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n-1, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = U64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[where[0] : where[-1]] if n else data[:0], where - where[0]


@lru_cache(maxsize=1)
def _c_library():
    return ctypes.CDLL(None)


def trimmed(result=None):
    """Gives memory that Python has freed back to the system, as workers stay between tasks; passes its argument on."""
    pa.default_memory_pool().release_unused()
    if hasattr(_c_library(), "malloc_trim"):
        _c_library().malloc_trim(0)
    return result


def frugal(run):
    """A generator over batches that trims memory when a task ends."""

    @wraps(run)
    def inner(batches):
        yield from run(batches)
        trimmed()

    return inner


def slices(column: pa.Array, most: int = 1 << 19, rows: int = 500) -> Iterator[pa.Array]:
    """The string column in runs of at most ``rows`` values and, but for longer single ones, ``most`` bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(column):
        end = int(np.searchsorted(total, total[at] + most, side="right")) - 1
        end = max(at + 1, min(end, at + rows))
        yield column.slice(at, end - at)
        at = end


def batch_slices(batch: pa.RecordBatch, column: int = 1, most: int = 1 << 19, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batch in the runs that ``slices`` makes of one of its columns."""
    at = 0
    for part in slices(batch.column(column), most, rows):
        yield batch.slice(at, len(part))
        at += len(part)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the n+1 offsets of each text's words."""
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_text = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts_text] = inside[starts_text]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return mixed(hashes + (ends - starts).astype(U64) * STEP), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int = 5, lower: bool = True, words: bool = False) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``width`` words.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    data, offsets = text_bytes(column)
    hashes, bounds = word_hashes(data, offsets, lower)
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), dtype=U64)
    for j in range(width):
        rolled = rolled * STEP + hashes[j : j + len(rolled)]
    rolled = mixed(rolled + U64(width))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            whole = 0
            for h in hashes[a:b].tolist():
                whole = (whole * int(STEP) + h) & 0xFFFFFFFFFFFFFFFF
            yield mixed(np.array([whole], dtype=U64) + U64(b - a))
        else:
            yield np.zeros(0, dtype=U64)


def binary_array(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, type=pa.binary())


# --- components -------------------------------------------------------------------------------


#: Edges are contracted this many at a time.
EDGES = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of some edges: least labels spread along edges and are then halved."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (u, v, label[u], label[v]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a partition's edges (u, v) join, as one star for each component among EDGES of them."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def close():
        u, v = stars(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        if sum(len(u) for u, _ in held) >= EDGES:
            yield close()
            held = []
    if held:
        yield close()


def components(scratch: Scratch, edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b) that is not itself its root, the least node reachable.

    Each partition first contracts its own edges to stars. Then large-star and small-star steps
    alternate (Kiveris et al., 2014): each is a grouped minimum and a join, pre-aggregated before
    the shuffle, and written out; adaptive execution splits the join of a node with very many edges. It ends when all edges lead to a root.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    now = scratch.save(ends.mapInArrow(contracted, "u long, v long").distinct(), "edges")
    for _ in range(limit):
        seen = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        seen = seen.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        if not seen.where("up > 1 or (up > 0 and down > 0)").limit(1).count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = scratch.save(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        scratch.drop(now)
        now = after
    raise RuntimeError(f"the components did not settle in {limit} steps")
