"""Threshold-scaled document fingerprints, and each document's next one in id order."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import batch_slices, frugal, mixed, shingle_sets, slices

#: Every shingle hash below this share of the hash space is kept, for texts of any size.
FRACTION = 1 / 2
LIMIT = np.uint64(int(FRACTION * 2**64))


class Sketch:
    """The shingle hashes below LIMIT, by their high 32 bits, with the number and a digest of all shingles.

    Every sketch keeps all hashes below one limit, so sketches merge by union, and what two of
    them share tells of both sets however unequal they are. An estimate over n kept hashes has a
    standard error of about sqrt(x * (1 - x) / n): texts of a few words keep few, and a set of
    one or two shingles may keep none. The digest tells such sets apart.
    """

    __slots__ = ("hashes", "size", "digest")

    def __init__(self, hashes: np.ndarray, size: int, digest: int | None):
        self.hashes, self.size, self.digest = hashes, size, digest

    @classmethod
    def of(cls, shingles: np.ndarray) -> Sketch:
        """From the sorted distinct shingle hashes."""
        kept = shingles[: np.searchsorted(shingles, LIMIT)]
        return cls(np.unique((kept >> np.uint64(32)).astype(np.uint32)), len(shingles), int(mixed(shingles).sum(dtype=np.uint64)))

    def encoded(self) -> str:
        """size:digest:hashes, the hashes as little-endian 32-bit values in base64."""
        digest = "" if self.digest is None else f"{self.digest:016x}"
        return f"{self.size}:{digest}:{base64.b64encode(self.hashes.astype('<u4').tobytes()).decode()}"

    @classmethod
    def decoded(cls, text: str) -> Sketch:
        size, digest, hashes = text.split(":")
        return cls(np.frombuffer(base64.b64decode(hashes), dtype="<u4"), int(size), int(digest, 16) if digest else None)

    def merged(self, other: Sketch) -> Sketch:
        """The sketch of the union of both sets; its size is an estimate, and it has no digest."""
        hashes = np.union1d(self.hashes, other.hashes)
        return Sketch(hashes, max(self.size, other.size, round(len(hashes) / FRACTION)), None)

    def _same(self, other: Sketch) -> bool:
        return self.size == other.size and self.digest is not None and self.digest == other.digest

    def likeness(self, other: Sketch) -> float:
        """Estimated Jaccard similarity; two empty sets are alike, an empty and another are not."""
        if self._same(other) or not self.size or not other.size:
            return float(self.size == other.size)
        shared = len(np.intersect1d(self.hashes, other.hashes, assume_unique=True))
        union = len(self.hashes) + len(other.hashes) - shared
        return shared / union if union else 0.0

    def containment(self, other: Sketch) -> float:
        """Estimated share of this set that the other holds, whatever their sizes."""
        if not self.size or self._same(other):
            return 1.0
        shared = len(np.intersect1d(self.hashes, other.hashes, assume_unique=True))
        return shared / len(self.hashes) if len(self.hashes) else 0.0


def sketches(column: pa.Array) -> list[Sketch]:
    return [Sketch.of(x) for x in shingle_sets(column)]


def fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of each whole text; null counts as empty, equal texts have equal ones. out_col must be new."""
    if out_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {out_col} already")

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([x.encoded() for part in slices(texts) for x in sketches(part)], pa.string())

    return df.withColumn(out_col, of(F.col(text_col)))


SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def cut_ids(ids: DataFrame, n: int, total: int, bytes_per_range: int, most_ranges: int) -> list[int]:
    """Ids at which ranges of about that many bytes begin; ids is id, bytes.

    Quantiles of the ids part them finely; neighbours whose bytes fit are put together. The driver
    sees four numbers for each of at most ``most_ranges`` ranges.
    """
    ranges = min(most_ranges, -(-total // bytes_per_range), n)
    if ranges < 2:
        return []
    fine = min(n, 4 * ranges)
    cuts = ids.select(F.percentile_approx("id", [i / fine for i in range(1, fine)], 20 * fine)).first()[0] or []
    cuts = sorted(set(cuts))
    sizes = ids.where("id is not null").groupBy(range_of(ids.sparkSession, cuts)("id").alias("r")).agg(F.sum("bytes").alias("s")).collect()
    sizes = {x["r"]: x["s"] for x in sizes}
    target, held, out = max(bytes_per_range, total / ranges), sizes.get(0, 0), []
    for i, cut in enumerate(cuts, 1):
        if held and held + sizes.get(i, 0) > target:
            out.append(cut)
            held = 0
        held += sizes.get(i, 0)
    return out


def range_of(spark: SparkSession, cuts: list[int]):
    """A function from an id to the number of cuts at or below it."""
    low = spark.sparkContext.broadcast(np.array(cuts, dtype=np.int64))

    @F.arrow_udf("long")
    def of(x: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(low.value, x.fill_null(-(2**63)).to_numpy(), side="right"), pa.int64())

    return of


def dealing_keys(spark: SparkSession, n: int) -> list[int]:
    """A key for each of n partitions that repartition(n, key) sends there."""
    found: dict[int, int] = {}
    start, step = 0, 64 * n + 1000
    while len(found) < n:
        keys = spark.range(start, start + step).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("k"))
        for x in keys.collect():
            found.setdefault(x["p"], x["k"])
        start += step
    return [found[p] for p in range(n)]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_per_range: int = 16 << 20, most_ranges: int = 10_000) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness to it and to the next document.

    The edited text has its last floor(n/4) code points replaced by the first as many (or all) of
    the next document in ascending id; after the last comes the first. Ids are cut into ranges of
    about equal bytes, each dealt to a partition of its own; a range's first document also goes to
    the end of the range before it, so each text is shuffled once and a task streams its range.

    Ids are whole numbers. Null texts are empty. Null ids come first. Rows with one id come in
    order of their text and share a range. A single document is its own next. Empty input gives no rows.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("id"), (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 16).alias("bytes"))
    n, total = ids.agg(F.count("*"), F.sum("bytes")).first()
    cuts = cut_ids(ids, n, total or 0, bytes_per_range, most_ranges)
    first = ids.agg(F.min("id").alias("m"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    start = None if first["nulls"] else first["m"]
    key_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("k"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    ).withColumn("r", range_of(spark, cuts)("id"))
    # All rows that share a range's first id are guests of the range before; only the first is read there.
    begins = F.col("id").isin(cuts) if len(cuts) < 200 else F.col("id").isin(set(cuts))
    is_first = F.col("id").isNull() if start is None else F.col("id") == F.lit(start)
    places = F.array_compact(
        F.array(
            F.struct(F.col("r").alias("r"), F.lit(0).alias("guest")),
            F.when(begins, F.struct((F.col("r") - 1).alias("r"), F.lit(1).alias("guest"))),
            F.when(is_first, F.struct(F.lit(len(cuts)).cast("long").alias("r"), F.lit(1).alias("guest"))),
        )
    )
    dealt = (
        rows.withColumn("p", F.explode(places))
        .select("k", "id", "t", F.col("p.r").alias("r"), F.col("p.guest").alias("guest"))
        .repartition(len(cuts) + 1, F.get(F.array(*map(F.lit, dealing_keys(spark, len(cuts) + 1))).cast("array<bigint>"), F.col("r").cast("int")))
        .sortWithinPartitions("r", "guest", F.col("id").asc_nulls_first(), "t")
        .select("k", "t", "r", "guest")
    )

    def edited(text, following):
        quarter = len(text) // 4
        return text[: len(text) - quarter] + following[:quarter] if quarter else text

    def run(batches):
        last, done = None, None  # the row before (range, key, text, sketch) and the range whose guest was read
        for batch in batches:
            for part in batch_slices(batch):
                at, keys, texts, guests = (part.column(j).to_pylist() for j in (2, 0, 1, 3))
                pairs = []
                for row, guest in zip(zip(at, keys, texts, sketches(part.column(1))), guests):
                    if guest and row[0] == done:
                        continue
                    if last is not None and last[0] == row[0]:
                        pairs.append((last, row))
                    last, done = (None, row[0]) if guest else (row, done)
                if not pairs:
                    continue
                changed = [edited(x[2], y[2]) for x, y in pairs]
                theirs = sketches(pa.array(changed, type=pa.string()))
                out = [
                    [x[1] for x, _ in pairs],
                    [len(x[2]) for x, _ in pairs],
                    [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                    [x[3].encoded() for x, _ in pairs],
                    [z.encoded() for z in theirs],
                    [x[3].likeness(z) for (x, _), z in zip(pairs, theirs)],
                    [x[3].likeness(y[3]) for x, y in pairs],
                ]
                kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds)], names=names)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return dealt.mapInArrow(frugal(run), f"{id_col} {key_type}, {SCHEMA}")


def documents_fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents and their edited texts."""
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
