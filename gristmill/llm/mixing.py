"""Mixing sources to target token counts by entropy balancing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import SPACE, Scratch, broadcast_if_few, named, slices, text_bytes, trimmed
from gristmill.sources.store import numbered

#: A word is a run of characters other than space and the five control characters of white space.
WORD = r"[^\x20\x09-\x0D]+"
MOST = 2.0


def words(text: Column) -> Column:
    """The number of words; null has none. A word begins at every byte in a word after one that is not."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        counts = []
        for part in slices(texts):
            data, offsets = text_bytes(part)
            begins = ~SPACE[data]
            begins[1:] &= SPACE[data[:-1]]
            first = offsets[:-1][offsets[:-1] < offsets[1:]]
            begins[first] = ~SPACE[data[first]]
            sums = np.concatenate([[0], np.cumsum(begins)])
            counts.append(sums[offsets[1:]] - sums[offsets[:-1]])
        return trimmed(pa.array(np.concatenate(counts) if counts else [], pa.int64()))

    return of(text)


def targets(scratch: Scratch, sources: DataFrame, weights: tuple[float, ...], share: float, most: float = MOST) -> DataFrame:
    """source, source_size, target: shares by weight, none above ``most`` times its source's size.

    Sources in code point order, null last, take the weights in turn. What is above a cap goes to
    the open sources by weight until none is above its own: the level, target / weight of the
    open ones, only rises. Every round is one sum over the sources, a row each; their order
    comes from ranges.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("ord") - 1) % len(weights) + 1).cast("int"))
    rows = numbered(sources, F.col("source").asc_nulls_last())
    rows = scratch.save(rows.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "weights")
    goal = float(rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level = -1.0
    while True:
        above = F.col("cap") < F.col("weight") * F.lit(level)
        capped, open_ = rows.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(~above, F.col("weight")).otherwise(0.0))).first()
        if not open_ or (goal - capped) / open_ <= level * (1 + 1e-12):
            break
        level = (goal - capped) / open_
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level)) if open_ else F.col("cap")
    return rows.select("source", "source_size", target.alias("target"))


def solve(scratch: Scratch, sizes: DataFrame, goals: DataFrame, most: float, steps: int = 100, near: float = 1e-9) -> DataFrame:
    """source, lam: the dual's root for every source by guarded Newton steps over grouped sizes.

    A document of size x (as a share of its source's mean) has rate min(most, exp(lam * x)), the
    entropy-nearest rates to 1 with the source's target as their sum of rate * size. The dual is
    convex and its slope monotone in lam, so each step's bracket shrinks; a Newton step outside
    it is replaced by the bracket's middle. Every step is one grouped sum over (source, size).
    A source is done within ``near`` of its target, or where its bracket has no number left inside.
    """
    state = scratch.save(
        goals.where("source_size > 0").select(
            "source",
            (F.col("target") / F.col("source_size")).alias("want"),
            F.lit(0.0).alias("lam"),
            F.lit(None).cast("double").alias("low"),
            F.lit(None).cast("double").alias("high"),
            (F.col("target") >= F.col("source_size") * most * (1 - 1e-12)).alias("full"),
            F.lit(False).alias("done"),
        ),
        "dual",
    )
    x = sizes.where("size > 0")
    mean = x.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.sum(F.col("size") * F.col("n")).alias("whole"))
    x = scratch.save(
        x.alias("x")
        .join(mean.alias("m"), F.expr("x.source <=> m.source"))
        .selectExpr("x.source", "x.size / m.mean as x", "x.size * x.n / m.whole as part"),
        "sizes",
    )
    for _ in range(steps):
        open_ = state.where("not done and not full").select("source", "lam")
        rate = F.exp(F.least(F.col("o.lam") * F.col("x.x"), F.lit(float(np.log(most)))))
        slope = F.when(F.col("o.lam") * F.col("x.x") < float(np.log(most)), rate * F.col("x.x")).otherwise(0.0)
        sums = (
            x.alias("x")
            .join(open_.alias("o"), F.expr("x.source <=> o.source"))
            .select(F.col("x.source").alias("s"), (rate * F.col("x.part")).alias("got"), (slope * F.col("x.part")).alias("slope"))
            .groupBy("s")
            .agg(F.sum("got").alias("got"), F.sum("slope").alias("slope"))
        )
        off = F.col("got") - F.col("want")
        low = F.when(off < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("lam") - off / F.col("slope"))
        middle = (
            F.when(F.col("low1").isNotNull() & F.col("high1").isNotNull(), (F.col("low1") + F.col("high1")) / 2)
            .when(F.col("high1").isNull(), F.greatest(F.col("lam") * 2, F.col("lam") + 1))
            .otherwise(F.least(F.col("lam") * 2, F.col("lam") - 1))
        )
        inside = F.coalesce(F.col("newton") > F.col("low1"), F.lit(True)) & F.coalesce(F.col("newton") < F.col("high1"), F.lit(True))
        inside &= F.col("newton").isNotNull() & (F.abs(F.col("newton") - F.col("lam")) <= 8)
        step = (
            state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("low1", low)
            .withColumn("high1", high)
            .withColumn("newton", newton)
            .withColumn("ready", F.col("done") | F.col("full") | F.coalesce((F.abs(off) <= near) | (F.col("high1") - F.col("low1") <= F.abs("lam") * 1e-15), F.lit(False)))
            .select(
                "source",
                "want",
                F.when(F.col("ready") | F.col("got").isNull(), F.col("lam")).when(inside, F.col("newton")).otherwise(middle).alias("lam"),
                F.col("low1").alias("low"),
                F.col("high1").alias("high"),
                "full",
                F.col("ready").alias("done"),
            )
        )
        new = scratch.save(step, "dual")
        scratch.drop(state)
        state = new
        if not state.where("not done").limit(1).count():
            break
    else:
        raise RuntimeError(f"the rates did not settle in {steps} steps")
    scratch.drop(x)
    return state.select("source", "lam", "full")


def rounded(rows, most: int):
    """For one source: how many copies the documents of each size get in all.

    In descending size, each size takes the whole copies nearest to what its rates and the rest
    carried so far ask for, so what one size cannot round is made up by smaller ones; where those
    could not make it up, it takes the number that leaves them least to miss.
    """
    rows = rows.sort_values("size", ascending=False)
    words = (rows["size"] * rows["n"]).astype(float)
    rest = (words.sum() - words.cumsum()).tolist()
    asked = (words * rows["rate"]).tolist()
    left, later, copies = sum(asked), sum(asked), []
    for size, n, own, smaller in zip(rows["size"].tolist(), rows["n"].tolist(), asked, rest):
        later -= own
        if not size:
            copies.append(n)
            continue
        want = math.floor((left - later) / size + 0.5)
        options = {min(max(c, 0), most * n) for c in (want, math.floor(left / size), math.ceil((left - most * smaller) / size))}
        missed = lambda c: max(0.0, left - c * size - most * smaller) + max(0.0, c * size - left)  # noqa: B023, E731
        c = min(sorted(options), key=lambda c: (round(missed(c), 6), abs(c - want)))  # noqa: B023
        left -= c * size
        copies.append(c)
    return rows.assign(copies=copies)[["source", "size", "n", "copies"]]


def planned(scratch: Scratch, slim: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """A row for each (source, size): source_size, target, base, limit, take and ties.

    Every document of the group is taken ``base`` times, and once more where its hash u is below
    ``limit``; of the ``ties`` rows at the limit (repeats of one document) ``take`` are. slim has
    source, size and u, a hash of id and text in [0, 2**63).
    """
    sizes = scratch.save(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    per_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = scratch.save(targets(scratch, per_source, weights, share, float(most)), "goals")
    dual = solve(scratch, sizes, goals, float(most))
    rate = F.when(F.col("full"), float(most)).otherwise(
        F.exp(F.least(F.col("lam") * F.col("size") * F.col("docs") / F.col("source_size"), F.lit(float(np.log(most)))))
    )
    full_docs = sizes.where("size > 0").groupBy("source").agg(F.sum("n").alias("docs"))
    rated = (
        sizes.alias("z")
        .join(goals.alias("g"), F.expr("z.source <=> g.source"))
        .join(dual.alias("d"), F.expr("z.source <=> d.source"), "left")
        .join(full_docs.alias("f"), F.expr("z.source <=> f.source"), "left")
        .select("z.source", "z.size", "z.n", F.coalesce(rate, F.lit(1.0)).alias("rate"))
    )
    plan = rated.groupBy("source").applyInPandas(lambda x: rounded(x, most), sizes.select("source", "size", "n").schema.add("copies", "long"))
    plan = plan.select("source", "size", "n", F.expr("copies div n").alias("base"), F.expr("copies % n").alias("extra"))
    plan = scratch.save(plan, "plan")

    # The extra-th least hash of a group of n: about sqrt(n) buckets in order, counted, then the one bucket that holds it.
    parts = plan.where("extra > 0").select("source", "size", "extra", F.ceil(F.sqrt("n")).cast("long").alias("parts"))
    parts = broadcast_if_few(scratch.save(parts, "parts"))
    same = F.expr("a.source <=> b.source and a.size = b.size")
    dealt = slim.alias("a").join(parts.alias("b"), same).select("a.source", "a.size", "b.extra", F.expr("cast(a.u / 9223372036854775808D * b.parts as long)").alias("bucket"), "a.u")
    before = Window.partitionBy("source", "size").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("source", "size", "extra", "bucket").agg(F.count("*").alias("c"))
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before.orderBy("bucket")), F.lit(0)))
    hit = broadcast_if_few(scratch.save(counts.where("before < extra and extra <= before + c").select("source", "size", "bucket", "before"), "hit"))
    inside = dealt.alias("a").join(hit.alias("b"), same & F.expr("a.bucket = b.bucket")).select("a.source", "a.size", "a.extra", "a.u", "b.before")
    inside = inside.groupBy("source", "size", "extra", "before", "u").agg(F.count("*").alias("ties"))
    inside = inside.withColumn("below", F.col("before") + F.coalesce(F.sum("ties").over(before.orderBy("u")), F.lit(0)))
    limits = inside.where("below < extra and extra <= below + ties").select("source", "size", F.col("u").alias("limit"), "ties", (F.col("extra") - F.col("below")).alias("take"))
    out = (
        plan.alias("p")
        .join(goals.alias("g"), F.expr("p.source <=> g.source"))
        .join(scratch.save(limits, "limits").alias("l"), F.expr("p.source <=> l.source and p.size = l.size"), "left")
        .selectExpr("p.source", "p.size", "g.source_size", "g.target", "p.base", "coalesce(l.limit, -1) as limit", "coalesce(l.take, 0) as take", "coalesce(l.ties, 0) as ties")
    )
    return scratch.save(out, "taken")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """row, size, source_size, target, copies for rows of row (a struct), source, size and u.

    Only the repeats of one document where a plan's limit falls must be told apart: equal rows
    are counted together before they are dealt in order.
    """
    joined = rows.alias("a").join(broadcast_if_few(plan).alias("p"), F.expr("a.source <=> p.source and a.size = p.size"))
    joined = joined.select("a.row", "p.*", "a.u")
    out = ["row", "size", "source_size", "target"]
    split = (F.col("u") == F.col("limit")) & (F.col("take") < F.col("ties"))
    more = F.when(F.col("u") <= F.col("limit"), F.col("base") + 1).otherwise(F.col("base"))
    if not plan.where("take < ties").limit(1).count():
        return joined.select(*out, more.alias("copies"))
    shared = joined.where(split).groupBy(*out, "source", "base", "take").agg(F.count("*").alias("c"))
    row = F.col("row") if "map<" not in rows.schema["row"].dataType.simpleString() else F.col("row").cast("string")  # maps have no order
    before = Window.partitionBy("source", "size").orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    shared = shared.withColumn("left", F.col("take") - F.coalesce(F.sum("c").over(before), F.lit(0)))
    shared = shared.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
    shared = shared.select(*out, F.when(F.col("i") <= F.col("left"), F.col("base") + 1).otherwise(F.col("base")).alias("copies"))
    return joined.where(~split).select(*out, more.alias("copies")).unionByName(shared)


def sized(docs: DataFrame, row: list[str], id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row (a struct of the columns named), source, size, u."""
    u = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 1)
    return docs.select(F.struct(*(F.col(named(c)) for c in row)).alias("row"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), u.alias("u"))


def allocation(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """k (the id), size, source_size, target and copies for each row.

    Tokens are words here. Rates come from entropy balancing under each source's target and are
    rounded into 0 to ``most`` whole copies. Documents of one source and size have one rate; of
    these the ones with least hash of id and text get the copies that don't divide evenly. The
    hash at which they end comes from counts by hash bucket, so no task sorts a whole group. A
    source's sizes meet in one task: distinct sizes only, at most sqrt(2 * words) of them.

    Null text has size 0; null source is one source, last in order; null ids and repeated rows
    are documents like others. A document of size 0 is copied once and counts nothing. A source
    without words has target 0. Empty input gives no rows. The text is read once.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    slim = scratch.save(sized(docs, [id_col], id_col, text_col, source_col), "slim")
    plan = planned(scratch, slim, weights, share, most)
    return with_copies(slim, plan).select(F.col("row")[id_col].alias("k"), "size", "source_size", "target", "copies")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """docs with each row as often as ``allocation`` takes it; columns of any name stay.

    Texts are read twice and not shuffled: what decides on a row is the plan of its source and
    size, and its own hash.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    slim = scratch.save(sized(docs, [id_col], id_col, text_col, source_col).drop("row"), "slim")
    plan = planned(scratch, slim, weights, share, most)
    scratch.drop(slim)
    rows = with_copies(sized(docs, docs.columns, id_col, text_col, source_col), plan).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def documents_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents, with the words that the mix takes of each."""
    plan = allocation(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return plan.select(F.col("k").alias("doc_id"), "size", "source_size", "target", taken, "copies")
