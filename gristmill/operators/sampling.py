"""Seeded samples that reruns draw again: negatives of a query, and rows by a temperature over their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.sources.store import few, numbered, stored

BUCKETS = 1 << 12


def negatives(queries: DataFrame, documents: DataFrame, positives: DataFrame, n: int, seed: int = 12) -> DataFrame:
    """(query_id, doc_id, draw): n documents of each query that are none of its positives, drawn evenly without repeats (all there are, if fewer).

    Documents are numbered once; a query draws numbers by hash, several times as many as it needs, and
    the first n that are neither repeats nor positives count. So no query meets all documents: of a
    small corpus (of fewer documents than draws), each query takes those of least hash instead.
    """
    asked = queries.select("query_id").distinct().join(positives.groupBy("query_id").agg(F.count_distinct("doc_id").alias("own")), "query_id", "left")
    asked = stored(asked.select("query_id", F.coalesce("own", F.lit(0)).alias("own")))
    ids = stored(numbered(documents.select("doc_id").distinct(), F.col("doc_id")))
    total, draws = ids.count(), 8 * n + 64
    most = asked.agg(F.max("own")).first()[0] or 0
    hashed = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(max(1, total)))
    if total <= 4 * (draws + most):  # bounded by what is drawn
        found = asked.select("query_id").crossJoin(F.broadcast(ids.select("doc_id"))).withColumn("draw", F.xxhash64("query_id", "doc_id", F.lit(seed)))
    else:
        drawn = asked.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws) + 8 * F.col("own"))).alias("draw"))
        drawn = drawn.withColumn("ord", hashed("query_id", "draw") + 1).groupBy("query_id", "ord").agg(F.min("draw").alias("draw"))
        found = ids.join(drawn, "ord").select("query_id", "doc_id", "draw")
    found = found.join(positives.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("draw", "doc_id")
    found = found.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= n)
    return found.select("query_id", "doc_id", "draw")


def by_temperature(rows: DataFrame, group: str, key: str, total: int, power: float = 1.0, seed: int = 12) -> DataFrame:
    """rows with copies: total rows in all (or within one a group), each group's share in proportion to its size to the power.

    A group's number is its share rounded down or up by systematic rounding over the groups in
    order, so it is within one of it. Its rows are taken whole times as often as the number holds
    them all, and those of least hash once more: the hash at which they end comes from counts by bucket, and only
    the bucket where they end is put in order. No group meets in one task. ``key`` is unique within its group.
    """
    count, hashed, size, want, bucket, below = (f"_{x}" for x in ("count", "hash", "size", "want", "bucket", "below"))
    marked = rows.withColumn(hashed, F.xxhash64(F.col(key), F.lit(seed))).withColumn(bucket, F.pmod(F.shiftright(hashed, 40), F.lit(BUCKETS)))
    by_bucket = stored(marked.groupBy(F.col(group), F.col(bucket)).agg(F.count("*").alias(count)))
    sizes = by_bucket.groupBy(group).agg(F.sum(count).alias(size)).withColumn("weight", F.pow(F.col(size), F.lit(power)))
    whole = sizes.agg(F.sum("weight").alias("all"))
    ordered = numbered(stored(sizes), F.col(group).asc_nulls_first())
    upto = stored(ordered.select("ord", "weight"))
    # Rounded running sums of the shares; their differences are the groups' numbers.
    running = F.sum("weight").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    ends = upto.withColumn("end", running).crossJoin(F.broadcast(whole)).withColumn("end", F.round(F.col("end") / F.col("all") * total).cast("long"))
    taken = ends.withColumn(want, F.col("end") - F.coalesce(F.lag("end").over(Window.orderBy("ord")), F.lit(0))).select("ord", want)
    plan = ordered.join(taken, "ord").select(group, size, want)
    before = F.coalesce(F.sum(count).over(Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = stored(by_bucket.withColumn(below, before).join(few(plan), F.equal_null(by_bucket[group], plan[group])).select(by_bucket[group], bucket, count, below, size, want))
    same = F.equal_null(F.col("a." + group), F.col("p." + group)) & (F.col("a." + bucket) == F.col("p." + bucket))
    joined = marked.alias("a").join(few(plan).alias("p"), same).select("a.*", *(f"p.{x}" for x in (count, below, size, want)))
    left = F.col(want) % F.col(size) - F.col(below)  # how many of the bucket are taken once more
    times = F.floor(F.col(want) / F.col(size))
    edge = (left > 0) & (left < F.col(count))
    inside = F.row_number().over(Window.partitionBy(group, bucket).orderBy(hashed, key))
    copies = joined.where(~edge).withColumn("copies", times + (left >= F.col(count)).cast("int")).unionByName(joined.where(edge).withColumn("copies", times + (inside <= left).cast("int")))
    return copies.where("copies > 0").drop(count, hashed, size, want, bucket, below)
