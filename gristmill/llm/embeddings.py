"""Embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import Scratch, broadcast_if_few, components, frugal, stars

#: Blocks of about this many rotated dimensions; a block's grid lies over its first two.
BLOCK = 8
#: Grid cells are this many times as wide as a block's distance budget.
WIDTH = 3
#: A cell is searched in tiles of at most this many vectors, of which a tile holds one block's share.
TILE = 8192
#: Inside a tile so many dimensions of the block that the grid leaves are cut into strips as wide as the budget.
STRIPS = 2
#: So many sorted rows are tested at a time with all within the radius of any of them.
RUN = 16
#: The cell of a label whose vectors fit one tile: there is nothing for a grid to part.
ONLY = 0
#: Rotated unit vectors are rounded to whole multiples of 1/UNIT, so distances are exact in doubles
#: and every task sees the same ones.
UNIT = float(1 << 20)


@lru_cache(maxsize=16)
def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation, so that no block depends on how the vectors were made."""
    q, r = np.linalg.qr(np.random.default_rng(20_240_501 + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dim), max(1, -(-dim // BLOCK)))


def budgets(dim: int, threshold: float) -> list[float]:
    """Each block's share of the squared distance that the threshold allows, in units, with rounding allowed for.

    If two vectors are within the whole budget, at least one block is within its share.
    """
    whole = max(0.0, 2 * (1 - threshold)) + 1e-9
    return [(np.sqrt(whole * len(b) / dim) * UNIT + np.sqrt(len(b))) ** 2 for b in blocks(dim)]


def rotated(vectors: np.ndarray) -> np.ndarray:
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.rint(units @ rotation(vectors.shape[1]) * UNIT)


def packed(x: np.ndarray) -> bytes:
    """The components in four bytes each where that loses nothing, else in eight."""
    short = x.astype("<f4")
    return (short if (short == x).all() else x).tobytes()


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """The packed vectors of one length, as doubles."""
    rows = column.to_pylist()
    short = np.array([len(row) == 4 * dim for row in rows], dtype=bool)
    out = np.empty((len(rows), dim))
    for mine, kind in ((short, "<f4"), (~short, "<f8")):
        out[mine] = np.frombuffer(b"".join(compress(rows, mine)), dtype=kind).reshape(-1, dim)
    return out


def cells_of(points: np.ndarray, threshold: float, few: np.ndarray | None = None) -> tuple[list[list[int]], list[list[int]]]:
    """For each vector the cells where it lives and where it looks for others, as (block, row, column) hashes with the block.

    A vector lives in one cell a block and looks into those neighbours that come later (by row, then
    column) and that its budget reaches. So every pair within a block's budget meets there once.
    Vectors of labels that fit a tile (few) live in the cell ONLY of each block.
    """
    few = np.zeros(len(points), dtype=bool) if few is None else few
    dim = points.shape[1]
    homes, looks = [], []
    for b, (columns, budget) in enumerate(zip(blocks(dim), budgets(dim, threshold))):
        radius = np.sqrt(budget)
        width = WIDTH * radius
        x = points[:, columns[0]]
        y = points[:, columns[1]] if len(columns) > 1 else np.zeros(len(points))
        row, column = np.floor(x / width), np.floor(y / width)
        down, left, right = np.floor((x + radius) / width) > row, np.floor((y - radius) / width) < column, np.floor((y + radius) / width) > column
        homes.append((b, row, column, np.ones(len(points), dtype=bool)))
        for dr, dc, reached in ((0, 1, right), (1, -1, down & left), (1, 0, down), (1, 1, down & right)):
            looks.append((b, row + dr, column + dc, reached))

    def listed(found):
        out: list[list[int]] = [[] for _ in range(len(points))]
        for b, r, c, reached in found:
            keys = ((r.astype(np.int64) + (1 << 23)) << 24) + (c.astype(np.int64) + (1 << 23))
            for i in np.flatnonzero(reached & ~few).tolist():
                out[i].append((b << 48) + int(keys[i]))
        return out

    lived, looked = listed(homes), listed(looks)
    for i in np.flatnonzero(few).tolist():
        lived[i] = [(b << 48) + ONLY for b in range(len(homes))]
    return lived, looked


def with_cells(classes: DataFrame, threshold: float) -> DataFrame:
    """label, dim, rep, n, homes, looks, and the rotated vector's share of every block."""

    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                points = rotated(unpacked(part.column(4), int(dim)))
                homes, looks = cells_of(points, threshold, part.column(5).to_numpy(zero_copy_only=False))
                short = points.astype("<f4")  # whole numbers below 2**24
                shares = [[row[b[0] : b[-1] + 1].tobytes() for b in blocks(int(dim))] for row in short]
                lists = [pa.array(homes, pa.list_(pa.int64())), pa.array(looks, pa.list_(pa.int64())), pa.array(shares, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *lists], names=[*part.schema.names[:4], "homes", "looks", "shares"])

    sizes = classes.groupBy("label", "dim").agg((F.count("*") <= TILE).alias("few"))
    return classes.join(sizes, ["label", "dim"]).select("label", "dim", "rep", "n", "vector", "few").mapInArrow(
        frugal(run), "label long, dim long, rep long, n long, homes array<long>, looks array<long>, shares array<binary>"
    )


def near_pairs(x: np.ndarray, y: np.ndarray | None, budget: float, used: int = 2, tests: list[int] | None = None):
    """(i, j) of the rows of x and y within the squared distance, chunk by chunk; with y None, pairs i < j of x.

    Strips of the radius's width along one dimension after another part what cannot meet; inside
    the last strips rows are sorted by a further dimension, and only runs within the radius are
    tested. The first dimensions are passed over where the grid has used them. tests counts the tested pairs.
    """
    radius, depth = np.sqrt(budget), STRIPS
    first = used if x.shape[1] > used else 0

    def tested(i, j, same):
        column = min(first + depth, x.shape[1] - 1)
        other = x if y is None else y
        i, j = i[np.argsort(x[i, column], kind="stable")], j[np.argsort(other[j, column], kind="stable")]
        keys = other[j, column]
        for at in range(0, len(i), RUN):
            mine = i[at : at + RUN]
            low, high = np.searchsorted(keys, [x[mine[0], column] - radius, x[mine[-1], column] + radius], side="left")
            theirs = j[low : high + 1]
            if not len(theirs):
                continue
            if tests is not None:
                tests.append(len(mine) * len(theirs))
            p, q = x[mine], other[theirs]
            near = (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * (p @ q.T) <= budget
            if same:
                near &= theirs[None, :] > mine[:, None]
            a, b = np.nonzero(near)
            if len(a):
                yield mine[a], theirs[b]

    def parted(i, j, level, same):
        if level == depth or first + level >= x.shape[1] - 1 or len(i) * len(j) < 16 * RUN:
            yield from tested(i, j, same)
            return
        column, other = first + level, x if y is None else y
        strip_i, strip_j = np.floor(x[i, column] / radius), np.floor(other[j, column] / radius)
        rows_j = {s: j[strip_j == s] for s in np.unique(strip_j)}
        for s in np.unique(strip_i):
            mine = i[strip_i == s]
            for t in (s,) if same else (s - 1, s, s + 1):
                if t in rows_j:
                    yield from parted(mine, rows_j[t], level + 1, same)
            if same and s + 1 in rows_j:
                yield from parted(mine, rows_j[s + 1], level + 1, False)

    for i, j in parted(np.arange(len(x)), np.arange(len(x if y is None else y)), 0, y is None):
        yield (np.minimum(i, j), np.maximum(i, j)) if y is None else (i, j)


def candidates(threshold: float):
    """Per tile of block shares: the rows that have another within the block's budget."""

    def run(batches):
        for key, (ids, weights, sides, shares) in tiles(batches, lambda column, key: block_shares(column)):
            _, dim, block, cell, _ = key
            budget, used = budgets(dim, threshold)[block], grid_dimensions(cell)
            lives, looks = np.flatnonzero(sides != 1), np.flatnonzero(sides == 1)
            busy = np.zeros(len(ids), dtype=bool)
            if len(sides) and sides[0] == 2:
                for i, j in near_pairs(shares, None, budget, used):
                    busy[i] = busy[j] = True
            else:
                for i, j in near_pairs(shares[lives], shares[looks], budget, used):
                    busy[lives[i]] = busy[looks[j]] = True
            found = np.flatnonzero(busy)
            if len(found):
                columns = [np.full(len(found), k, dtype=np.int64) for k in key]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*columns, ids[found], weights[found], sides[found]]], names=[*KEY, "rep", "n", "side"])

    return run


def grid_dimensions(cell: int) -> int:
    """How many of a block's dimensions the grid has parted a cell's vectors by."""
    return 0 if cell & ((1 << 48) - 1) == ONLY else 2


def block_shares(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype="<f4").reshape(len(rows), -1).astype(np.float64)


def compared(threshold: float):
    """Per tile of candidates: for every vector with links its weight of linked ones and the least vector it reaches there."""

    def links(block: int, used: int, vectors: np.ndarray, rows: np.ndarray, columns: np.ndarray, same: bool):
        points, dim = rotated(vectors), vectors.shape[1]
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        allowed = budgets(dim, threshold)
        parts = blocks(dim)

        def distances(i, j, b):
            d = points[i][:, parts[b]] - points[j][:, parts[b]]
            return np.einsum("ij,ij->i", d, d)

        own = points[:, parts[block]]
        for i, j in near_pairs(own[rows], None if same else own[columns], allowed[block], used):
            i, j = rows[i], columns[j]
            for part in range(0, len(i), 100_000):
                a, b = i[part : part + 100_000], j[part : part + 100_000]
                for earlier in range(block):  # a pair that meets in several blocks counts in the first
                    late = distances(a, b, earlier) > allowed[earlier]
                    a, b = a[late], b[late]
                sure = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norms[a] * norms[b]) >= threshold
                yield a[sure], b[sure]

    def run(batches):
        for key, (ids, weights, sides, vectors) in tiles(batches, lambda column, key: unpacked(column, key[1])):
            _, dim, block, cell, _ = key
            lives, looks = np.flatnonzero(sides != 1), np.flatnonzero(sides == 1)
            both = len(sides) > 0 and sides[0] == 2
            count = np.zeros(len(ids), dtype=np.int64)
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), dtype=np.int64)
            place[order] = np.arange(len(ids))  # so that the least label is the least id
            tree = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for a, b in links(block, grid_dimensions(cell), vectors, lives, lives, True) if both else links(block, grid_dimensions(cell), vectors, lives, looks, False):
                np.add.at(count, a, weights[b])
                np.add.at(count, b, weights[a])
                tree.append((place[a], place[b]))
                if sum(len(x) for x, _ in tree) > 1 << 20:
                    tree = [stars(*(np.concatenate(x) for x in zip(*tree)))]
            found = np.flatnonzero(count)
            if len(found):
                node, root = stars(*(np.concatenate(x) for x in zip(*tree)))
                ends = np.arange(len(ids))
                ends[node] = root
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[found]), pa.array(count[found]), pa.array(ids[order[ends[place[found]]]])], names=["rep", "links", "root"]
                )

    return run


KEY = ("label", "dim", "block", "cell", "meet")


def tiles(batches, read):
    """(key, [ids, weights, sides, read(the last column)]) of consecutive rows with one KEY."""
    held, current = [], None

    def closed():
        return current, [np.concatenate([h[k] for h in held]) for k in range(4)]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(len(KEY))], axis=1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(keys[a].tolist())
            if current is not None and key != current:
                yield closed()
                held = []
            current = key
            part = batch.slice(a, b - a)
            held.append([*(part.column(len(KEY) + k).to_numpy() for k in range(3)), read(part.column(len(KEY) + 3), key)])
    if held:
        yield closed()


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def similar_vectors(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label"
) -> DataFrame:
    """One row per vector: its id, n_links, component_id (least id reachable by links, itself included) and kept.

    Vectors link when their labels are equal and not null and their cosine, in doubles, is at least
    ``threshold``. Equal vectors of a label are one class with a weight. Rotated unit vectors are
    split into blocks; within the whole squared distance 2 - 2 * threshold at least one block is
    within its proportional budget, so a range join of every block finds all candidates. The join
    ships each block's share of a vector to its cells of a grid; inside a cell, strips and sorted
    runs along further dimensions part what cannot meet. Whole vectors follow only where their
    share has another within the budget; there each pair is counted in the first block that brings
    it together and confirmed on the full vectors. Cells with many vectors are searched tile by
    tile; a task keeps one tile and emits a row for each vector, not for each pair.

    Labels are whole numbers, or else told apart by a 64-bit hash. Null, empty and zero vectors, those with null or infinite components or NaN, and those without
    a label or id link with nothing. Vectors of unequal length do not link. Repeated rows are
    vectors of their own. Empty input gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    v = F.col(vector_col).cast("array<double>")
    label = F.lit(0).cast("long")
    if label_col:
        whole = vectors.schema[label_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
        label = F.col(label_col).cast("long") if whole else F.when(F.col(label_col).isNotNull(), F.xxhash64(F.col(label_col).cast("string")))
    base = vectors.select(F.col(id_col).alias("id"), label.alias("label"), v.alias("v"))
    usable = F.col("v").isNotNull() & F.forall("v", is_finite) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull()
    base = base.withColumn("usable", F.coalesce(usable, F.lit(False)))
    base = base.select("id", "label", "v", "usable", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("v"), "v").alias("h2"))
    same = ["label", "h1", "h2"]
    classes = base.where("usable").groupBy(*same).agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))

    def pack(batches):
        for batch in batches:
            lists = batch.column(5)
            dims = np.diff(lists.offsets.to_numpy())
            rows = [np.array(x, dtype="<f8") for x in lists.to_pylist()]
            rows = [x / 2.0 ** np.floor(np.log2(np.abs(x).max())) for x in rows]  # a power of two changes no cosine
            vector = pa.array([packed(x) for x in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(dims.astype(np.int64)), vector], names=names)

    names = ["label", "h1", "h2", "rep", "n", "dim", "vector"]
    classes = classes.select("label", "h1", "h2", "rep", "n", "v").mapInArrow(
        pack, "label long, h1 long, h2 long, rep long, n long, dim long, vector binary"
    )
    classes = scratch.save(classes, "classes")
    placed = scratch.save(with_cells(classes, threshold), "cells")
    whole = ["label", "dim", "cell"]
    homes = placed.select("label", "dim", F.explode("homes").alias("cell")).groupBy(*whole).agg(F.count("*").alias("lives"))
    looks = placed.select("label", "dim", F.explode("looks").alias("cell")).groupBy(*whole).agg(F.count("*").alias("looks"))
    sizes = homes.join(looks, whole, "left").select(
        *whole,
        F.ceil(F.col("lives") / TILE).cast("long").alias("h"),
        F.coalesce(F.ceil(F.col("looks") / TILE), F.lit(0)).cast("long").alias("l"),
        (F.col("lives") + F.coalesce("looks", F.lit(0))).alias("c"),
    )
    sizes = scratch.save(sizes.where("c > 1").drop("c"), "sizes")

    def meet(i: Column, j: Column, side) -> Column:
        return F.struct((i * (1 << 31) + j).cast("long").alias("meet"), F.lit(side).cast("long").alias("side"))

    def counted(n: str) -> Column:
        return F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<bigint>"))

    zero = F.lit(0).cast("long")
    part_h = F.pmod(F.xxhash64("rep", F.lit("tile")), F.col("h"))
    part_l = F.pmod(F.xxhash64("rep", F.lit("tile")), F.greatest(F.col("l"), F.lit(1)))
    # Tiles of those that live in a cell meet each other (one side as lookers) and every tile of lookers.
    within = F.transform(
        counted("h"),
        lambda j: F.when(j == part_h, meet(zero + j, zero + j, 2)).when(part_h < j, meet(part_h, j, 0)).otherwise(meet(j, part_h, 1)),
    )
    outer = F.transform(counted("l"), lambda j: meet(part_h + (1 << 30), j, 0))
    probing = F.transform(counted("h"), lambda i: meet(i + (1 << 30), part_l, 1))
    block = F.shiftright("cell", 48)
    share = F.get(F.col("shares"), block.cast("int")).alias("share")

    def in_cells(kind: str) -> DataFrame:
        rows = placed.select("label", "dim", "rep", "n", "shares", F.explode(kind).alias("cell"))
        return rows.select("label", "dim", "rep", "n", "cell", share).join(broadcast_if_few(sizes), whole)

    living = in_cells("homes").withColumn("m", F.explode(F.concat(within, outer)))
    looking = in_cells("looks").withColumn("m", F.explode(probing))
    rows = living.unionByName(looking).select("label", "dim", block.alias("block"), "cell", "m.meet", "rep", "n", F.col("m.side").alias("side"), "share")
    key = ", ".join(f"{k} long" for k in KEY)
    busy = rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(frugal(candidates(threshold)), f"{key}, rep long, n long, side long")
    busy = scratch.save(busy, "busy")
    scratch.drop(placed)
    # Whole vectors go only where their block has found company.
    rows = busy.join(classes.select("label", "dim", "rep", "vector"), ["label", "dim", "rep"]).select(*KEY, "rep", "n", "side", "vector")
    found = rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(frugal(compared(threshold)), "rep long, links long, root long")
    found = scratch.save(found, "found")
    scratch.drop(busy)
    roots = components(scratch, found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    ends = classes.select(*same, "rep", "n").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    ends = ends.select(*same, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    out = base.drop("v").alias("v").join(ends.alias("e"), F.expr("v.usable and v.label = e.label and v.h1 = e.h1 and v.h2 = e.h2"), "left")
    root = F.coalesce(F.col("e.root"), F.col("v.id").cast("long"))
    return out.select(
        F.col("v.id").alias(id_col),
        F.coalesce("e.n_links", F.lit(0)).cast("long").alias("n_links"),
        root.alias("component_id"),
        F.coalesce(root == F.col("v.id"), F.lit(True)).alias("kept"),
    )


def vectors_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: links among all embeddings of a label."""
    return similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e
  from embeddings
  where label is not null and vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as norm from v),
links as (
  select a.vec_id as x, b.vec_id as y
  from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98::double),
reach as (select vec_id as x, vec_id as y from embeddings union select r.x, l.y from reach r join links l on r.y = l.x)
select e.vec_id, coalesce(n, 0)::bigint as n_links, m as component_id, e.vec_id = m as kept
from embeddings e
join (select x, min(y) as m from reach group by x) r on r.x = e.vec_id
left join (select x, count(*) as n from links group by x) k on k.x = e.vec_id
"""
