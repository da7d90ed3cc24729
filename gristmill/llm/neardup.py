"""MinHash near-duplicates by an LSH forest: sorted signature orders, neighbours by common prefix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import Scratch, batch_slices, columns_of, components, fresh, frugal, mixed, named, shingle_sets, spent

#: Signature length; the number of orders (trees), which start at even steps of it; and the least
#: common prefix that makes two documents neighbours in an order.
LENGTH, TREES, DEPTH = 64, 16, 3
STRIDE = LENGTH // TREES
#: A region's depth is raised until at most this many signatures share its prefix; these are compared with each other.
LEAF = 4
#: How many of its likest neighbours from all orders a document is first confirmed with; what this
#: leaves open is done in full afterwards.
MATES = 4
#: Rows of an order that are scanned at a time.
WINDOW = 20_000
#: Where a region still holds several components it is compared in tiles of at most this many signatures.
TILE = 1024
#: A tile with more possible pairs a row than this is dense: its full sets are compared together,
#: at most SET_TILE of them with as many others, and fewer where sets are large (SET_SHINGLES in all).
DENSE, SET_TILE, SET_SHINGLES = 4, 2048, 2_000_000
_FACTORS = mixed(np.arange(1, LENGTH + 1, dtype=np.uint64)) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """LENGTH minima of the hashes under as many odd multipliers, in blocks so that memory is bounded."""
    out = np.full(LENGTH, ~np.uint64(0))
    for i in range(0, len(shingles), 8192):
        np.minimum(out, np.multiply.outer(shingles[i : i + 8192], _FACTORS).min(axis=0), out=out)
    return mixed(out)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (shingles), s1, s2 (two sums over the set that stand for it), sketch (a byte per minimum), prefix (a hash per tree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch):
                n, one, two, sketches, prefixes = [], [], [], [], []
                for shingles in shingle_sets(part.column(1)):
                    n.append(len(shingles))
                    one.append(int(shingles.sum(dtype=np.uint64).astype(np.int64)))
                    two.append(int(mixed(shingles + np.uint64(77)).sum(dtype=np.uint64).astype(np.int64)))
                    if not len(shingles):
                        sketches.append(b"")
                        prefixes.append([])
                        continue
                    s = signature(shingles)
                    sketches.append((s & np.uint64(255)).astype(np.uint8).tobytes())
                    head = np.zeros(TREES, dtype=np.uint64)
                    for d in range(DEPTH):
                        head = mixed(head + s[(np.arange(TREES) * STRIDE + d) % LENGTH])
                    prefixes.append(head.astype(np.int64).tolist())
                columns = [pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns, pa.array(prefixes, pa.list_(pa.int64()))], names=["id", "n", "s1", "s2", "sketch", "prefix"]
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(
        frugal(run), "id long, n long, s1 long, s2 long, sketch binary, prefix array<long>"
    )


def shingle_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the full sorted set of its shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch):
                sets = [x.astype(np.int64) for x in shingle_sets(part.column(1))]
                offsets = np.cumsum([0, *map(len, sets)])
                values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), column], names=["id", "shingles"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(frugal(run), "id long, shingles array<long>")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Runs of rows with equal first ``keys`` columns (64-bit), as one array a column; rows come sorted by them."""
    held: list[list[np.ndarray]] = []
    current = None
    for batch in batches:
        columns = [
            np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False)
            for c in batch.columns
        ]
        if not batch.num_rows:
            continue
        key = np.stack(columns[:keys], axis=1)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            if current is not None and tuple(key[a]) != current:
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            current = tuple(key[a])
            held.append([c[a:b] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def alike(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The share of equal bytes, with one in 256 expected to be equal by chance taken off."""
    same = (others == sketch).mean(axis=1)
    return (same - 1 / 256) / (1 - 1 / 256)


def pair_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def near_in_size(sizes: np.ndarray, size: int, ratio: float) -> np.ndarray:
    return np.minimum(sizes, size) >= ratio * np.maximum(sizes, size) - 1e-9


def common_prefix(trees: np.ndarray, prefixes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For each row but the first how many leading minima it shares with the row before it; 0 below DEPTH."""
    same = (trees[1:] == trees[:-1]) & (prefixes[1:] == prefixes[:-1])
    other = labels[1:, DEPTH:] != labels[:-1, DEPTH:]
    deep = np.where(other.any(axis=1), other.argmax(axis=1), LENGTH - DEPTH)
    return np.where(same, DEPTH + deep, 0)


def neighbours(shared: np.ndarray, n: int) -> list[tuple[np.ndarray, int]]:
    """(first rows, step) of the pairs that adaptive depth makes candidates, from common prefixes in sorted order.

    Rows next to each other always are. Rows up to LEAF - 1 apart are if at most LEAF rows share
    what the two have in common: sparse regions so keep the least depth, dense ones go deeper.
    """
    wall = np.zeros(n + 2 * LEAF + 1, dtype=np.int64)
    wall[LEAF + 1 : LEAF + n] = shared  # wall[LEAF + i] is the prefix that rows i - 1 and i share
    out = []
    least = np.full(n, LENGTH)
    for step in range(1, min(LEAF, n)):
        rows = np.arange(n - step)
        least = np.minimum(least[: n - step], shared[step - 1 :])
        good = least >= DEPTH
        if step > 1:
            size, left, right = np.full(n - step, step + 1), good.copy(), good.copy()
            for k in range(LEAF - step):
                left &= wall[LEAF + rows - k] >= least
                right &= wall[LEAF + rows + step + 1 + k] >= least
                size += left.astype(int) + right
            good &= size <= LEAF
        out.append((rows[good], step))
    return out


def scanned(close: float, ratio: float):
    """Rows whose region others may share, in sorted order, each with those candidates after it that look close.

    A window's last rows are scanned again with the next, so no pair is lost between them. Regions
    at a partition's ends may go on in the next one, so their rows count as shared.
    """

    def run(batches):
        tail, first, done = None, True, 0
        for batch, last in _with_last(batches):
            for at in range(0, max(1, batch.num_rows), WINDOW):
                part = batch.slice(at, WINDOW)
                ends = last and at + WINDOW >= batch.num_rows
                columns = [part.column(k).to_numpy() for k in (0, 1, 2, 3)]
                columns.append(np.frombuffer(b"".join(part.column(4).to_pylist()), dtype=np.uint8).reshape(-1, LENGTH))
                if tail is not None:
                    columns = [np.concatenate([x, y]) for x, y in zip(tail, columns)]
                n = len(columns[0])
                if not n:
                    continue
                trees, prefixes, ids, sizes, labels = columns
                shared = common_prefix(trees, prefixes, labels)
                mates: list[list] = [[] for _ in range(n)]
                for rows, step in neighbours(shared, n):
                    alikeness = alike(labels[rows + step], labels[rows])
                    good = (alikeness >= close) & near_in_size(sizes[rows], sizes[rows + step], ratio) & (ids[rows] != ids[rows + step])
                    for i, value in zip(rows[good].tolist(), alikeness[good].tolist()):
                        mates[i].append({"id": int(ids[i + step]), "alike": value})
                together = np.zeros(n, dtype=bool)
                together[1:] |= shared > 0
                together[:-1] |= shared > 0
                breaks = np.flatnonzero(shared == 0)
                if first:
                    together[: breaks[0] + 1 if len(breaks) else n] = True
                if ends:
                    together[breaks[-1] + 1 if len(breaks) else 0 :] = True
                # The last rows wait for the next window; the one before them is only looked back at.
                stay = n if ends else max(0, n - LEAF)
                keep = np.flatnonzero(together[done:stay]) + done
                if len(keep):
                    arrays = [pa.array(c[keep]) for c in columns[:4]] + [pa.array([row.tobytes() for row in labels[keep]], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array([mates[i] for i in keep.tolist()], MATE)], names=["tree", "p", "id", "n", "label", "mates"])
                start = max(0, stay - LEAF)
                tail, done = [c[start:] for c in columns], stay - start
                first = first and not (len(breaks) and breaks[0] < stay)

    return run


MATE = pa.list_(pa.struct([("id", pa.int64()), ("alike", pa.float64())]))


def _with_last(batches):
    """(batch, whether it is the last)."""
    before = None
    for batch in batches:
        if before is not None:
            yield before, False
        before = batch
    if before is not None:
        yield before, True


def cross_pairs(possible: float, ratio: float, dense: int):
    """Pairs of a tile that are still in different components and whose signatures allow the similarity.

    Rows of side 0 meet those of side 1; rows of side 2 meet each other. A tile with more than
    ``dense`` such pairs a row emits none of them but its rows that have some (b is null, head is
    the least of them): their full sets are then compared together.
    """

    def run(batches):
        for _, _, ids, sizes, sketch, roots, sides in grouped(batches, 2):
            a, b, count = [], [], 0
            busy = np.zeros(len(ids), dtype=bool)
            right = np.flatnonzero(sides == 1)
            for i in np.flatnonzero(sides != 1).tolist():
                others = np.arange(i + 1, len(ids)) if sides[i] == 2 else right
                others = others[(roots[others] != roots[i]) & near_in_size(sizes[others], sizes[i], ratio)]
                others = others[alike(sketch[i], sketch[others]) >= possible]
                if len(others):
                    busy[i] = busy[others] = True
                    count += len(others)
                    if count <= dense * len(ids):
                        a.append(np.full(len(others), ids[i]))
                        b.append(ids[others])
            if count > dense * len(ids):
                members = ids[busy]
                none = pa.nulls(len(members), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(members), none, pa.array(np.full(len(members), members.min()))], names=["a", "b", "head"])
            elif a:
                a, b = np.concatenate(a), np.concatenate(b)
                low, high = pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))
                yield pa.RecordBatch.from_arrays([low, high, pa.nulls(len(a), pa.int64())], names=["a", "b", "head"])

    return run


def exact_links(numerator: int, denominator: int, width: int = 4096):
    """A spanning forest of the links across components in each tile, from the rows' full sets.

    Intersections are a product of 0/1 matrices over the shingles that several rows have, a stretch
    of them at a time; sums below 2**24 are exact in single precision.
    """

    def run(batches):
        for _, ids, roots, sides, sets in set_tiles(batches):
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            owner = np.repeat(np.arange(len(sets)), sizes)
            _, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            often = times > 1
            kept = often[inverse]
            column, owner = (np.cumsum(often) - 1)[inverse[kept]], owner[kept]
            order = np.argsort(column, kind="stable")
            column, owner = column[order], owner[order]
            left = np.flatnonzero(sides != 1)
            right = left if len(left) and sides[left[0]] == 2 else np.flatnonzero(sides == 1)
            shared = np.zeros((len(left), len(right)), dtype=np.float32)
            place_l, place_r = np.full(len(ids), -1), np.full(len(ids), -1)
            place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
            for at in range(0, int(often.sum()), width):
                x, y = np.searchsorted(column, [at, at + width])
                c, o = column[x:y] - at, owner[x:y]
                ml, mr = np.zeros((len(left), width), dtype=np.float32), np.zeros((len(right), width), dtype=np.float32)
                in_l, in_r = place_l[o] >= 0, place_r[o] >= 0
                ml[place_l[o[in_l]], c[in_l]] = 1
                mr[place_r[o[in_r]], c[in_r]] = 1
                shared += ml @ mr.T
            pairs = []
            for at in range(0, len(left), 256):
                own, both = left[at : at + 256], shared[at : at + 256].astype(np.int64)
                union = sizes[own][:, None] + sizes[right][None, :] - both
                i, j = np.nonzero((both * denominator >= union * numerator) & (roots[own][:, None] != roots[right][None, :]))
                pairs.append((own[i], right[j]))
            parent: dict[int, int] = {}

            def top(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            a, b = [], []
            for x, y in ((x, y) for i, j in pairs for x, y in zip(i.tolist(), j.tolist())):
                u, v = top(int(roots[x])), top(int(roots[y]))
                if u != v:
                    parent[u] = v
                    a.append(ids[x])
                    b.append(ids[y])
            if a:
                a, b = np.array(a), np.array(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def set_tiles(batches):
    """(key, ids, roots, sides, sets) of consecutive rows with one key; rows are k, id, root, side, shingles."""
    held, current = [], None

    def closed():
        return (current, *(np.array([h[i] for h in held], dtype=np.int64) for i in range(3)), [h[3] for h in held])

    for batch in batches:
        keys, ids, roots, sides = (batch.column(i).to_pylist() for i in range(4))
        lists = batch.column(4)
        for n, row in enumerate(zip(keys, ids, roots, sides)):
            if current is not None and row[0] != current:
                yield closed()
                held = []
            current = row[0]
            held.append((*row[1:], lists[n].values.to_numpy()))
    if held:
        yield closed()


def verified(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs whose full sets have denominator * intersection >= numerator * union."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (shared * denominator >= union * numerator).alias("linked"))
    return both.where("linked").select("a", "b")


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: its id, n_shingles, component_id (least id reachable by links) and kept.

    Documents link when percent of the union of their sets of five-word shingles is shared. Equal
    sets are one class at once. The forest is TREES sorted orders of the signatures, cut into even
    ranges whatever is frequent. Each order is scanned: rows that share a prefix of DEPTH minima
    or more are neighbours, the depth raised in dense regions until few share a prefix, and a
    document is confirmed on full sets with the likest of its neighbours. Then components are
    found, and what this leaves open is done in full: in every region of depth DEPTH that still
    holds several components all pairs across components that the signatures allow are confirmed
    too, regions above TILE tile by tile; dense tiles compare their full sets in place and emit no
    pairs but links. So a region's size caps nothing; a link is missed only if no order brings its
    two signatures to a common prefix (at 85% one link in four million, at 80% one in a hundred
    thousand) or if they agree in far fewer minima than the similarity makes likely (five standard
    deviations).

    Ids are whole numbers. Null and empty texts have no shingles and link with nothing. Null ids
    are reported without links. Rows that repeat an id are one document if their sets are equal;
    otherwise each row is linked as itself and the id's component is the least of all. Ties
    between equal texts go to the least id. Empty input gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    share = percent / 100
    base = scratch.save(signatures(docs, id_col, text_col), "signatures")
    same = [F.col("n"), F.col("s1"), F.col("s2")]
    classes = base.where("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.save(classes, "classes")
    # One row of each class: its least id's.
    reps = base.join(classes.select("n", "s1", "s2", F.col("rep").alias("id")), ["n", "s1", "s2", "id"]).dropDuplicates(["n", "s1", "s2", "id"])
    rows = reps.select("id", "n", "sketch", F.posexplode("prefix").alias("tree", "p"))
    turn = F.col("tree") * STRIDE
    label = F.concat(F.substr("sketch", turn + 1, F.lit(LENGTH)), F.substr("sketch", F.lit(1), turn))
    rows = rows.select(F.col("tree").cast("long").alias("tree"), "p", "id", "n", label.alias("label"))
    order = ["tree", "p", "label", "id"]
    forest = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        frugal(scanned(min(0.99, share + 0.03), share)), "tree long, p long, id long, n long, label binary, mates array<struct<id: long, alike: double>>"
    )
    forest = scratch.save(forest, "forest")
    needed = forest.select("id").distinct()
    sets = scratch.save(
        shingle_table(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(needed, "id", "left_semi"), "id", "t")
        .withColumn("n", F.size("shingles"))
        .join(reps.select("id", F.col("n").cast("int").alias("n")), ["id", "n"], "left_semi")
        .dropDuplicates(["id", "n"])
        .select("id", "shingles"),
        "sets",
    )

    mates = forest.select("id", F.explode("mates").alias("m")).select(F.greatest("id", "m.id").alias("a"), F.least("id", "m.id").alias("b"), F.col("m.alike").alias("alike"))
    likest = Window.partitionBy("a").orderBy(F.col("alike").desc(), "b")
    first = mates.distinct().withColumn("nth", F.row_number().over(likest)).where(F.col("nth") <= MATES)
    first = scratch.save(first.select(F.col("b").alias("a"), F.col("a").alias("b")), "pairs")
    linked = scratch.save(verified(first, sets, percent, 100), "links")
    roots = scratch.save(components(scratch, linked), "roots")

    known = forest.select("tree", "p", "id", "n", F.col("label").alias("sketch")).join(roots.withColumnRenamed("node", "id"), "id", "left")
    known = scratch.save(known.withColumn("root", F.coalesce("root", "id")), "known")
    scratch.drop(forest)
    possible = share - 5 * (share * (1 - share) / LENGTH) ** 0.5
    rest = (
        met(known, ["tree", "p"])
        .select("k", "tree", "id", "n", "sketch", "root", "side")
        .repartition("k", "tree")
        .sortWithinPartitions("k", "tree", "id")
        .mapInArrow(frugal(cross_pairs(possible, share, DENSE)), "a long, b long, head long")
    )
    rest = scratch.save(rest, "rest")
    scratch.drop(known)
    pairs = rest.where("b is not null").select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    links = scratch.save(linked.unionByName(verified(scratch.save(pairs, "pairs"), sets, percent, 100)), "links")
    members = rest.where("b is null").select("a", F.col("head").alias("b"))
    if members.limit(1).count():
        # Rows of dense tiles, each in the one group that its tiles chain together: every pair meets once.
        chained = components(scratch, members)
        chained = chained.unionByName(chained.select(F.col("root").alias("node"), "root").distinct())
        now = scratch.save(components(scratch, links), "roots")
        group = chained.select(F.col("node").alias("id"), F.col("root").alias("p")).withColumn("tree", F.lit(0).cast("long"))
        group = group.join(now.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        sizes = classes.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n"))
        group = scratch.save(group.join(sizes, "id"), "group")
        mean = group.groupBy("tree", "p").agg(F.avg("n").alias("mean"))
        fits = F.least(F.lit(SET_TILE), F.greatest(F.lit(16), F.floor(F.lit(SET_SHINGLES) / F.col("mean"))))
        tiles = met(group.join(mean, ["tree", "p"]).withColumn("size", fits), ["tree", "p"], F.max("size")).select("k", "id", "root", "side").join(sets, "id")
        tiles = tiles.select("k", "id", "root", "side", "shingles").repartition("k").sortWithinPartitions("k", "id")
        exact = tiles.mapInArrow(frugal(exact_links(percent, 100)), "a long, b long")
        links = scratch.save(links.unionByName(exact), "links")
    scratch.drop(sets)
    # Ids that stand for two different sets (repeated ids) hold their classes together.
    twice = classes.select("n", "s1", "s2", "rep").join(base.select("n", "s1", "s2", "id").distinct(), ["n", "s1", "s2"])
    twice = twice.groupBy("id").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    ties = twice.select(F.explode("reps").alias("b"), F.array_min("reps").alias("a"))
    roots = scratch.save(components(scratch, links.unionByName(ties.select("a", "b"))), "roots")
    ends = classes.join(roots, F.col("rep") == F.col("node"), "left").select("n", "s1", "s2", F.coalesce("root", "rep").alias("root"))
    out = base.alias("d").join(ends.alias("e"), F.expr("d.n = e.n and d.s1 = e.s1 and d.s2 = e.s2 and d.id is not null"), "left")
    root = F.coalesce(F.col("e.root"), F.col("d.id"))
    return out.select(F.col("d.id").alias(id_col), F.col("d.n").alias("n_shingles"), root.alias("component_id"), F.coalesce(root == F.col("d.id"), F.lit(True)).alias("kept"))


def met(known: DataFrame, region: list[str], size: Column | None = None) -> DataFrame:
    """Rows of regions that hold several components, once for every tile (k) where they meet others, with their side.

    The largest component's members need only meet the others, so a huge group of near copies is
    passed once a tile of those; the others meet each other as well. A tile has about TILE rows, or
    what the aggregate ``size`` says of a region's components.
    """
    size = F.max(F.lit(TILE)) if size is None else size
    counts = known.groupBy(*region, "root").agg(F.count("*").alias("m"), size.alias("size"))
    several = counts.groupBy(*region).agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("c"), F.max("size").alias("size"))
    several = several.where("c > top.m").select(
        *region,
        F.col("top.root").alias("top"),
        F.greatest(F.lit(1), F.ceil(F.col("top.m") / F.col("size"))).cast("long").alias("tops"),
        F.greatest(F.lit(1), F.ceil((F.col("c") - F.col("top.m")) / F.col("size"))).cast("long").alias("others"),
    )
    rows = known.drop("size").join(several, region).withColumn("main", F.col("root") == F.col("top"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("id", F.lit("tile")), F.when(F.col("main"), F.col("tops")).otherwise(F.col("others"))))

    def meet(i: Column, j: Column, side) -> Column:
        return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), side.cast("long").alias("side"))

    def counted(n: str) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)

    own = F.col("tile")
    with_main = F.transform(counted("tops"), lambda j: meet(own, -1 - j, F.lit(0)))
    among = F.transform(
        counted("others"), lambda j: meet(F.least(j, own), F.greatest(j, own), F.when(j == own, 2).when(own < j, 0).otherwise(1))
    )
    of_main = F.transform(counted("others"), lambda i: meet(i, -1 - own, F.lit(1)))
    rows = rows.withColumn("m", F.explode(F.when(F.col("main"), of_main).otherwise(F.concat(with_main, among))))
    return rows.withColumn("k", F.xxhash64(*region, "m.i", "m.j")).withColumn("side", F.col("m.side"))


def without_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the least id.

    Of rows that repeat a kept id and its text one stays, the least by its other columns. Where
    an id has different texts, each is a document of its own that only its links collapse.
    Rows with a null id all stay.
    """
    key, texts, rows, component, place = fresh(docs, "kept_id", "texts", "kept_rows", "kept_group", "kept_place")
    scratch = Scratch(docs.sparkSession, "kept")
    known = docs.where(F.col(id_col).isNotNull())
    if known.groupBy(id_col).agg(F.countDistinct(F.xxhash64(text_col)).alias(texts)).where(F.col(texts) > 1).limit(1).count():
        known = known.withColumn(key, F.xxhash64(id_col, text_col))
        with spent():
            found = near_duplicates(known.select(key, text_col), percent, key, text_col)
            found = scratch.save(found.groupBy(key, F.col("component_id").alias(component)).agg(F.count("*").alias(rows)), "found")
        ids = known.select(key, F.col(id_col).alias(texts)).distinct()
        found = found.join(ids, key).groupBy(component).agg(F.min(F.struct(texts, key, rows)).alias(place)).select(f"{place}.{key}", f"{place}.{rows}")
    else:
        with spent():
            found = near_duplicates(docs, percent, id_col, text_col).where(F.col("kept") & F.col(id_col).isNotNull())
            found = scratch.save(found.groupBy(F.col(id_col).alias(key)).agg(F.count("*").alias(rows)), "found")
        known = known.withColumn(key, F.col(id_col))
    found = scratch.save(found, "kept")
    out = known.join(found.where(F.col(rows) == 1).select(key), key, "left_semi").select(*columns_of(docs))
    often = found.where(F.col(rows) > 1).select(key)
    if often.limit(1).count():
        order = [F.col(named(f.name)) for f in docs.schema if isinstance(f.dataType, T.AtomicType)]
        same = known.join(often, key, "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
        out = out.unionByName(same.where(F.col(place) == 1).select(*columns_of(docs)))
    if docs.where(F.col(id_col).isNull()).limit(1).count():
        out = out.unionByName(docs.where(F.col(id_col).isNull()))
    return out


def documents_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: near duplicates among all documents at 85%."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (
  select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))
                             when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from sh group by all),
i as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b using (s) where a.doc_id < b.doc_id group by all),
l as (select x, y from i join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
links as (select x, y from l union all select y, x from l),
reach as (select doc_id as x, doc_id as y from documents union select r.x, l.y from reach r join links l on r.y = l.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m as component_id, d.doc_id = m as kept
from documents d left join n using (doc_id) join (select x, min(y) as m from reach group by x) r on r.x = d.doc_id
"""
