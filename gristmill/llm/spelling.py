"""Operator 11: spelling variants of frequent words, by letter-parity masks that agree in a band."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import Scratch, batch_slices, broadcast_if_few, frugal

LEAST_LENGTH, LEAST_COUNT, RATIO, DROPPED = 6, 5, 5, 199
#: A task holds counts of at most this many words before it passes them on.
HELD = 1 << 19

#: In Latin-1 a run's letters keep their place, A-Z become small and all else is a space.
_RUNS = bytearray(b" " * 256)
for _c in (*range(0x61, 0x7B), *range(0xC0, 0x100)):
    _RUNS[_c] = _c
for _c in range(0x41, 0x5B):
    _RUNS[_c] = _c + 32
RUNS = bytes(_RUNS)

#: Letters in order of frequency are dealt to the three bands in turn, so that each tells words apart about as well.
FREQUENT = "etaoinsrhldcumfpgwybvkxjqz"
BAND = 21
#: Every third bit: the sub-bands of what a band leaves.
THIRD = sum(1 << i for i in range(0, 2 * BAND, 3))


def letter_bit(code: int) -> int:
    """The bit of a letter: band i holds bits 21 * i to 21 * i + 20, nine for a-z and twelve that the others share."""
    at = FREQUENT.find(chr(code)) if code < 0x80 else code - 0xC0
    return BAND * (at % 3) + (at // 3 if code < 0x80 else 9 + at // 3 % 12)


def words_of(doc_id, text: str | None, dropped: int = DROPPED, least_length: int = LEAST_LENGTH) -> Counter:
    """The words of a text with their occurrences; where ``dropped`` divides a run's checksum, it lacks a letter."""
    out: Counter = Counter()
    if not text:
        return out
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(text.encode("latin-1", "replace").translate(RUNS).split(b" ")).items():
        if len(run) < least_length:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % dropped == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least_length:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped: int = DROPPED, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) over all texts: counted in each task and then summed by word."""

    def run(batches):
        held: Counter = Counter()

        def close():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in batch_slices(batch):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held.update(words_of(key, text, dropped, least_length))
                    if len(held) >= HELD:
                        yield close()
                        held.clear()
        yield close()

    return docs.select(id_col, text_col).mapInArrow(frugal(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def parity_mask(word: Column) -> Column:
    """The parity of each letter's count, as 63 bits in three bands."""
    bits = F.array(*(F.lit(1 << letter_bit(c) if 0x61 <= c < 0x7B or c >= 0xC0 else 0).cast("long") for c in range(0x61, 0x100)))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.get(bits, F.ascii(c) - 0x61)))


def band(mask: Column, i: int) -> Column:
    return F.shiftright(mask, BAND * i).bitwiseAND((1 << BAND) - 1)


def rest(mask: Column, i: int) -> Column:
    """The two bands beside band i."""
    j, k = (x for x in range(3) if x != i)
    return F.shiftleft(band(mask, j), BAND).bitwiseOR(band(mask, k))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every two words (word, n) that differ by one inserted, deleted or replaced letter, once, b no shorter than a.

    An edit flips at most two bits, so one of three bands is equal, and of the other two bands'
    three sub-bands one is equal as well. Words meet where both are, in the group of their length or
    that of the longer; a pair counts in the first place where it meets, so that none is found twice.
    The masks' difference is tested before the words are.
    """
    masked = words.select("word", "n", F.length("word").alias("size"), parity_mask(F.col("word")).alias("mask"))
    places = [(i, s) for i in range(3) for s in range(3)]
    sub = lambda m, i, s: rest(m, i).bitwiseAND(THIRD << s)
    key = F.array(*(F.struct(F.lit(i * 3 + s).alias("place"), band(F.col("mask"), i).alias("first"), sub(F.col("mask"), i, s).alias("second")) for i, s in places))
    laid = masked.withColumn("key", F.explode(key)).select("word", "n", "size", "mask", "key.*")
    short = laid.select(F.explode(F.array("size", F.col("size") + 1)).alias("longer"), "place", "first", "second", *(F.col(c).alias(f"a_{c}") for c in ("word", "n", "size", "mask")))
    long = laid.select(F.col("size").alias("longer"), "place", "first", "second", *(F.col(c).alias(f"b_{c}") for c in ("word", "n", "mask")))
    flipped = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    agree = [(band(flipped, i) == 0) & (sub(flipped, i, s) == 0) for i, s in places]
    first = F.coalesce(*(F.when(x, F.lit(at)) for at, x in enumerate(agree)))
    same = F.col("a_size") == F.col("longer")
    one = F.levenshtein("a_word", "b_word", 1) == 1
    likely = (F.bit_count(flipped) <= F.when(same, 2).otherwise(1)) & (~same | (F.col("a_word") < F.col("b_word"))) & (F.col("place") == first)
    met = short.alias("s").join(long.alias("l"), ["longer", "place", "first", "second"]).where(likely & one)
    return met.select(F.col("a_word").alias("a"), F.col("a_n"), F.col("b_word").alias("b"), F.col("b_n"))


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by doubling; counts grow along forms, so there are no rings."""
    now = scratch.save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = broadcast_if_few(now.select(F.col("word").alias("root"), F.col("root").alias("next")))
        after = scratch.save(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        scratch.drop(now)
        now = after.select("word", "root")
        now._scratch_path = after._scratch_path
        if not after.where("moved").limit(1).count():
            return now


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, dropped: int = DROPPED
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of enough letters and occurrences.

    Words are lower-cased runs of a-z and the letters U+00C0 to U+00FF. A word's form is its most
    frequent near word (ties: the smallest) where that has ``ratio`` times its occurrences; its root
    ends the chain of forms. Null texts have no words; a null id counts as an empty one in checksums;
    rows that repeat count again; empty tables give no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(word_counts(docs, id_col, text_col, dropped, least_length).where(F.col("n") >= least_count), "words")
    pairs = scratch.save(near_pairs(words), "pairs")
    ends = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = ends.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    taken = -F.col("best.n") >= ratio * F.col("n")
    formed = scratch.save(
        words.join(near, "word", "left").select(
            "word", F.when(taken, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, -F.col("best.n")).alias("form_n")
        ),
        "formed",
    )
    scratch.drop(words, pairs)
    followed = roots(scratch, formed.where("form is not null"))
    out = formed.join(followed, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def documents_spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the words of all documents."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The checksum by its bytes and table of 256 remainders, for each run of a document; near words by what one deletion leaves of them.
SQL = r"""
WITH RECURSIVE steps AS (
  SELECT range AS byte, list_reduce(list_prepend(range::BIGINT, range(8)), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END) AS left_over FROM range(256)),
tab AS (SELECT list(left_over ORDER BY byte) AS t FROM steps),
low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z\x{C0}-\x{FF}]+')) AS run FROM low),
seen AS (SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
summed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2),
    lambda i: (strpos('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1)),
    lambda r, b: xor(r // 256, t[xor(r % 256, b) + 1])), 4294967295) AS h
  FROM seen, tab),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM summed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
left_of AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
pairs AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM left_of a JOIN left_of b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM left_of a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM left_of a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM pairs GROUP BY word),
tops AS (SELECT p.word, min(encode(p.other)) AS form FROM pairs p JOIN near USING (word) WHERE p.other_n = near.top GROUP BY p.word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN decode(form) END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN near USING (word) LEFT JOIN tops USING (word)),
walk AS (SELECT word, word AS at FROM formed UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.at WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN formed f ON f.word = walk.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
