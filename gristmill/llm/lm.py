"""Operator 12: a log-bilinear language model, trained by noise-contrastive estimation and normalised when it scores."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import LOWER, Scratch, batch_slices, frugal

SMALL = LOWER.tobytes()
#: The end of a text counts as a word that no text can hold.
END = "\n"
ALPHA = 0.1
HELD = 1 << 19
#: A task knows the counts of so many frequent words; those of others are joined. Words of more bytes than that are others.
KNOWN, LONGEST = 1 << 18, 64


@dataclass(frozen=True)
class Shape:
    """inputs words have vectors of their own and outputs words are predicted one by one; others go by their last three letters,
    the most frequent endings each in a class of its own and the rest dealt to ``dealt`` classes. All are fixed sizes."""

    inputs: int = 4096
    outputs: int = 96
    endings: int = 64
    dealt: int = 32
    width: int = 16
    before: int = 2
    bag: int = 32
    noise: int = 64
    batch: int = 1024
    rate: float = 0.1

    @property
    def classes(self) -> int:
        return self.endings + self.dealt

    @property
    def n_in(self) -> int:
        return self.inputs + self.classes

    @property
    def n_out(self) -> int:
        return self.outputs + self.classes


def gathered(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows that have each place of n."""
    d = rows.shape[1]
    return np.bincount((at[:, None] * d + np.arange(d)).ravel(), weights=rows.ravel(), minlength=n * d).reshape(n, d).astype(np.float32)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(SMALL).split() if text else []


def learned_from(key) -> bool:
    """Whether a document is for training: its id's checksum leaves a remainder by ten."""
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 != 0


def checksum(id_col: str, before: str = "") -> Column:
    """The checksum that ``learned_from`` takes, in the JVM."""
    return F.crc32(F.encode(F.concat(F.lit(before), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), "utf-8"))


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n) over all training texts, ends among them: counted in each task and then summed by word."""

    def run(batches):
        held: Counter = Counter()

        def close():
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        end = END.encode()
        for batch in batches:
            for part in batch_slices(batch):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if learned_from(key):
                        held.update(words_of(text))
                        held[end] += 1
                        if len(held) >= HELD:
                            yield close()
                            held.clear()
        yield close()

    return docs.select(id_col, text_col).mapInArrow(frugal(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ending(word: Column) -> Column:
    return F.substring(word, -3, 3)


class Vocabulary:
    """What every task knows: frequent words with counts, the endings that are classes, and each class's size."""

    def __init__(self, shape: Shape, words: list[str], counts: list[int], endings: list[str], totals: dict[int, tuple[int, int]], n: int, v: int):
        self.shape, self.n, self.v = shape, n, v
        self.words = "\t".join(words).encode()
        self.counts = np.array([*counts, 0], dtype=np.int64)
        self.endings = {e.encode(): i for i, e in enumerate(endings)}
        #: log10 of the divisor of a word's share of its class, by class.
        self.size = np.array([np.log10(a + ALPHA * (b + 1)) for a, b in (totals.get(i, (0, 0)) for i in range(shape.classes))])
        self.base = np.log10(n + ALPHA * (v + 1))
        s = shape
        own = np.arange(len(words))
        classes = np.array([self.class_of(w.encode()) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        self.unit = np.where(own < s.outputs, own, s.outputs + classes)
        self.input = np.where(own < s.inputs, own, s.inputs + classes)
        mass = np.bincount(self.unit, weights=self.counts[:-1], minlength=s.n_out)[: s.n_out]
        self.unit, self.input = (np.append(x, 0) for x in (self.unit, self.input))  # where a word is none of them
        for i, (a, _) in totals.items():
            mass[s.outputs + i] = a
        self.share = (mass + 1) / (mass + 1).sum()
        self._at = None

    def __getstate__(self):
        return {**self.__dict__, "_at": None}

    def class_of(self, word: bytes) -> int:
        last = word[-3:] if word.isascii() else word.decode()[-3:].encode()
        found = self.endings.get(last)
        return self.shape.endings + zlib.crc32(last) % self.shape.dealt if found is None else found

    def ids(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among the frequent ones, or -1."""
        if self._at is None:
            self._at = {w: i for i, w in enumerate(self.words.split(b"\t"))}
        return np.fromiter(map(self._at.get, words, repeat(-1)), np.int64, len(words))

    def units(self, words: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's output unit and input vector."""
        unit, vector = self.unit[ids], self.input[ids]
        for i in np.flatnonzero(ids < 0).tolist():
            c = self.class_of(words[i])
            unit[i], vector[i] = self.shape.outputs + c, self.shape.inputs + c
        return unit, vector


def vocabulary(counts: DataFrame, shape: Shape, known: int = KNOWN) -> Vocabulary:
    """From the counts of all words; the driver gets about ``known`` words, the endings that are classes, and a row a class."""
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    step = F.floor(F.log2("n") * 16).cast("int")
    short = counts.where(F.octet_length("word") <= LONGEST)
    held, least, share = 0, 0, 1.0  # steps of counts from the top while they fit; of the last one a share by hash
    for r in sorted(short.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        least, share = r["step"], min(1.0, (known - held) / r["count"])
        held += r["count"]
        if held >= known:
            break
    drawn = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    rows = short.where((step > least) | ((step == least) & drawn)).select("word", "n").collect()
    rows.sort(key=lambda r: (-r["n"], r["word"]))
    top = [r["word"] for r in rows[: shape.outputs]]
    others = counts.where(~F.col("word").isin(top)) if top else counts
    by_ending = others.groupBy(ending(F.col("word")).alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    endings = [r["e"] for r in by_ending.orderBy(F.desc("n"), "e").limit(shape.endings).collect()]
    at = F.array_position(F.lit(endings) if endings else F.array().cast("array<string>"), F.col("e")) - 1
    dealt = shape.endings + F.pmod(F.crc32(F.encode("e", "utf-8")), F.lit(shape.dealt))
    totals = by_ending.groupBy(F.when(at >= 0, at).otherwise(dealt).alias("c")).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    return Vocabulary(shape, [r["word"] for r in rows], [r["n"] for r in rows], endings, {r["c"]: (r["n"], r["v"]) for r in totals}, n, v)


class Model:
    """Rows of one table: input vectors, output vectors with their biases in the last column, and weights of the places before a word."""

    def __init__(self, shape: Shape, rows: np.ndarray):
        self.shape, self.rows = shape, rows
        d, i, o = shape.width, shape.n_in, shape.n_out
        self.inputs, self.outputs, self.bias, self.places = rows[:i, :d], rows[i : i + o, :d], rows[i : i + o, d], rows[i + o :, :d]

    @classmethod
    def start(cls, vocabulary: Vocabulary) -> Model:
        """Small random vectors; the biases are the shares of the units, so that the model starts as a unigram."""
        s = vocabulary.shape
        rows = np.random.default_rng(12).normal(0, 0.1, (s.n_in + s.n_out + s.before + 1, s.width + 1)).astype(np.float32)
        model = cls(s, rows)
        model.bias[:] = np.log(vocabulary.share)
        model.places[:] = 1.0
        return model

    def contexts(self, x: np.ndarray, since: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The predicted vectors of the words at places ``at`` of the inputs x, of texts that start at ``since``."""
        s, a, b = self.shape, int(at[0]), int(at[-1]) + 1
        lo = max(0, a - s.bag)
        vectors = np.zeros((s.before + b - lo, s.width), dtype=np.float32)
        vectors[s.before :] = self.inputs[x[lo:b]]
        age = (at - since[at]).astype(np.float32)  # words of the text before the place
        out, near = np.zeros((b - a, s.width), dtype=np.float32), []
        for j in range(s.before):
            v = vectors[s.before + a - lo - 1 - j : s.before + b - lo - 1 - j] * (age > j)[:, None]
            near.append(v)
            out += v * self.places[j]
        run = np.zeros((b - lo + 1, s.width), dtype=np.float32)
        np.cumsum(vectors[s.before :], axis=0, out=run[1:])
        size = np.clip(age, 1, s.bag)[:, None]
        start = np.maximum(np.maximum(since[at], at - s.bag) - lo, 0)
        bag = (run[a - lo : b - lo] - run[start]) / size
        out += bag * self.places[s.before]
        return out, (lo, start, size, age, near, bag)


def laid_out(vocabulary: Vocabulary, texts: list[list[bytes]]) -> tuple:
    """The words of texts one after the other, each text with its end: words, places among the frequent, units, inputs, starts of texts, edges."""
    end = END.encode()
    words = [w for text in texts for w in (*text, end)]
    ids = vocabulary.ids(words)
    unit, vector = vocabulary.units(words, ids)
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return words, ids, unit, vector.astype(np.int32), np.repeat(edges[:-1], np.diff(edges)), edges


class Trainer:
    """Noise-contrastive steps with Adagrad over what a task reads, from a given model."""

    def __init__(self, model: Model, vocabulary: Vocabulary, seed: int):
        s = model.shape
        self.model, self.shape = Model(s, model.rows.copy()), s
        self.seen = np.zeros(len(model.rows), dtype=np.float64)
        self.squares = np.full(model.rows.shape, 1e-5, dtype=np.float32)
        self.rng = np.random.default_rng(seed)
        self.shares = np.cumsum(vocabulary.share)
        self.log_share = np.log(s.noise * vocabulary.share).astype(np.float32)

    def update(self, rows: np.ndarray, step: np.ndarray, columns: slice = slice(None)) -> None:
        held = self.squares[rows, columns] + step * step
        self.squares[rows, columns] = held
        self.model.rows[rows, columns] += self.shape.rate * step / np.sqrt(held)

    def step(self, unit: np.ndarray, x: np.ndarray, since: np.ndarray, at: np.ndarray) -> None:
        m, s = self.model, self.shape
        h, (lo, start, size, age, near, bag) = m.contexts(x, since, at)
        a, b = int(at[0]) - lo, int(at[-1]) + 1 - lo
        w = unit[at]
        noise = np.minimum(np.searchsorted(self.shares, self.rng.random(s.noise), side="right"), s.n_out - 1)
        q_w, q_n = m.outputs[w], m.outputs[noise]

        def up(z):
            np.negative(z, out=z)
            np.exp(np.minimum(z, 80, out=z), out=z)
            z += 1
            return np.reciprocal(z, out=z)

        g_w = 1 - up(np.einsum("ij,ij->i", h, q_w) + m.bias[w] - self.log_share[w])
        g_n = up(h @ q_n.T + (m.bias[noise] - self.log_share[noise]))
        np.negative(g_n, out=g_n)
        g_h = g_w[:, None] * q_w + g_n @ q_n
        scale = np.float32(1 / len(at))
        out = gathered(w, np.concatenate([h * g_w[:, None], g_w[:, None]], axis=1), s.n_out)
        out += gathered(noise, np.concatenate([g_n.T @ h, g_n.sum(axis=0)[:, None]], axis=1), s.n_out)
        # What the contexts pass on to the words that stand in them.
        g_x = np.zeros((s.before + b, s.width), dtype=np.float32)
        places = np.zeros_like(m.places)
        for j, v in enumerate(near):
            g_x[s.before + a - 1 - j : s.before + b - 1 - j] += g_h * m.places[j] * (age > j)[:, None]
            places[j] = np.einsum("ij,ij->j", g_h, v)
        places[s.before] = np.einsum("ij,ij->j", g_h, bag)
        g_x = g_x[s.before :]
        share = g_h * m.places[s.before] / size
        steps = gathered(start, share, b)
        steps[a:b] -= share
        g_x += np.cumsum(steps, axis=0)
        words = x[lo : lo + b]
        rows, at_rows, times = np.unique(words, return_inverse=True, return_counts=True)
        self.update(rows, gathered(at_rows, g_x, len(rows)) * scale, slice(0, s.width))
        self.update(slice(s.n_in, s.n_in + s.n_out), out * scale)
        self.update(slice(s.n_in + s.n_out, None), places * scale, slice(0, s.width))
        self.seen[rows] += times
        self.seen[s.n_in :] += len(at)

    def learn(self, unit: np.ndarray, x: np.ndarray, since: np.ndarray) -> None:
        for a in range(0, len(unit), self.shape.batch):
            self.step(unit, x, since, np.arange(a, min(len(unit), a + self.shape.batch)))


#: Rows of a model that travel together.
TOGETHER = 256


def summed(parts: DataFrame, *keys: str) -> DataFrame:
    """(slice, salt, weights, values) added up by slice and, as given, salt; a task adds as it reads and holds one sum a key."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for at, salt, weights, values in zip(*(batch.column(j).to_pylist() for j in range(4))):
                weights, values = np.frombuffer(weights), np.frombuffer(values)
                if (at, salt) in held:
                    held[at, salt][0] += weights
                    held[at, salt][1] += values
                else:
                    held[at, salt] = [weights.copy(), values.copy()]
        names = ["slice", "salt", "weights", "values"]
        rows = sorted(held)
        columns = [[k[0] for k in rows], [k[1] for k in rows], [held[k][0].tobytes() for k in rows], [held[k][1].tobytes() for k in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=names)

    return parts.repartition(*keys).mapInArrow(run, parts.schema)


def trained(scratch: Scratch, docs: DataFrame, known, vocabulary: Vocabulary, id_col: str, text_col: str, rounds: tuple[int, ...] = (1, 7)) -> Model:
    """The model after every training document was read once.

    Documents are dealt to rounds by their id's checksum, in these shares. In a round each task goes
    on from the common model over the documents it reads; the models are then averaged row by row,
    each weighing what it has read of the row.
    """
    spark, shape, parts = docs.sparkSession, vocabulary.shape, sum(rounds)
    model = Model.start(vocabulary)
    for number, share in enumerate(rounds):
        low, high = sum(rounds[:number]), sum(rounds[:number]) + share
        sent = spark.sparkContext.broadcast(model.rows)

        def learn(batches):
            task = TaskContext.get().partitionId()
            v = known.value
            trainer = Trainer(Model(shape, sent.value), v, task + 1000 * number)
            for batch in batches:
                for part in batch_slices(batch):
                    _, _, unit, x, since, _ = laid_out(v, [words_of(t) for t in part.column(1).to_pylist()])
                    trainer.learn(unit, x, since)
            if not trainer.seen.any():
                return
            values = trainer.model.rows * trainer.seen[:, None]
            for at in range(0, len(values), TOGETHER):
                cut = slice(at, at + TOGETHER)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at // TOGETHER], pa.int32()), pa.array([task % 64], pa.int32()), pa.array([trainer.seen[cut].tobytes()], pa.binary()), pa.array([values[cut].tobytes()], pa.binary())],
                    names=["slice", "salt", "weights", "values"],
                )

        mine = docs.where((checksum(id_col) % 10 != 0) & F.pmod(checksum(id_col, "round "), F.lit(parts)).between(low, high - 1))
        told = scratch.save(mine.select(id_col, text_col).mapInArrow(frugal(learn), "slice int, salt int, weights binary, values binary"), "told")
        by_salt = summed(told, "slice", "salt")
        rows = model.rows.copy()
        for r in summed(by_salt.withColumn("salt", F.lit(0)), "slice").collect():
            weights, values = np.frombuffer(r["weights"]), np.frombuffer(r["values"]).reshape(-1, shape.width + 1)
            seen = weights > 0
            rows[r["slice"] * TOGETHER :][: len(weights)][seen] = (values[seen] / weights[seen, None]).astype(np.float32)
        scratch.drop(told)
        model = Model(shape, rows)
    return model


def log_probabilities(model: Model, unit: np.ndarray, x: np.ndarray, since: np.ndarray, most: int = 512) -> np.ndarray:
    """The natural logarithm of each unit's probability after the words before it, over all units."""
    out = np.zeros(len(unit))
    outputs, ones = np.ascontiguousarray(model.outputs.T), np.ones(len(model.bias), dtype=np.float32)
    for a in range(0, len(unit), most):
        at = np.arange(a, min(len(unit), a + most))
        h, _ = model.contexts(x, since, at)
        z = h @ outputs
        z += model.bias
        np.minimum(z, 80, out=z)  # beyond it no sum would be finite
        own = z[np.arange(len(at)), unit[at]].astype(np.float64)
        np.exp(z, out=z)
        out[a : a + len(at)] = own - np.log(z @ ones)
    return out


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape | None = None, known: int = KNOWN) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    The probability of a word is that of its unit after the two words and the mean of the 32 words before it, by
    the model, times its smoothed share of its unit's occurrences; each unit leaves a share for words that no
    training text holds, so all add up to one. Counts cover all training texts, each of which is
    also read once in training.

    Null and empty texts are their end alone. A null id is held out. Rows that repeat an id are
    scored and counted each. Without training texts all counts are 0. Empty tables give no rows; other columns are not read.
    """
    shape = shape or Shape()
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    counts = scratch.save(word_counts(docs, id_col, text_col), "counts")
    vocab = vocabulary(counts, shape, known)
    sent = spark.sparkContext.broadcast(vocab)
    model = trained(scratch, docs, sent, vocab, id_col, text_col)
    weights = spark.sparkContext.broadcast(model.rows)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", id_col, "held_out", "n_tokens", "n_known", "base", "score", "rare"]
    rare_type = pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int64())]))

    def run(batches):
        number = count(TaskContext.get().partitionId() << 32)
        v, m = sent.value, Model(shape, weights.value)
        for batch in batches:
            for part in batch_slices(batch):
                keys = part.column(0).to_pylist()
                words, ids, unit, x, since, edges = laid_out(v, [words_of(t) for t in part.column(1).to_pylist()])
                score = log_probabilities(m, unit, x, since) / np.log(10)
                frequent, in_class = ids >= 0, unit >= shape.outputs
                own = np.where(frequent, np.log10(v.counts[ids] + ALPHA), 0.0)
                score += np.where(in_class, own - v.size[np.maximum(unit - shape.outputs, 0)], 0.0)
                totals = lambda a: np.add.reduceat(a, edges[:-1])
                rare: list[Counter] = [Counter() for _ in keys]
                other = np.flatnonzero(~frequent)
                for i, doc in zip(other.tolist(), (np.searchsorted(edges, other, side="right") - 1).tolist()):
                    rare[doc][words[i]] += 1
                known_words = frequent & (v.counts[ids] > 0)
                columns = [
                    pa.array([next(number) for _ in keys], pa.int64()),
                    part.column(0),
                    pa.array([not learned_from(k) for k in keys], pa.bool_()),
                    pa.array(np.diff(edges), pa.int64()),
                    pa.array(totals(known_words.astype(np.int64)), pa.int64()),
                    pa.array(totals(own) - np.diff(edges) * v.base, pa.float64()),
                    pa.array(totals(score), pa.float64()),
                    pa.array([[{"word": w.decode(), "tf": n} for w, n in r.items()] for r in rare], rare_type),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"row long, {id_col} {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word: string, tf: long>>"
    rows = scratch.save(docs.select(id_col, text_col).mapInArrow(frugal(run), schema), "rows")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf").join(counts, "word", "left")
    more = rare.groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ALPHA))).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("n_more")
    )
    more_of = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.drop("rare").join(more, "row", "left").select(
        id_col, "held_out", "n_tokens", (F.col("n_known") + more_of("n_more")).alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") + more_of("more")).alias("base_score"), (F.col("score") + more_of("more")).alias("score"),
    )


def documents_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
