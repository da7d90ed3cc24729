"""Span lists as columns: their order, text form and digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: start and end are in code points, end exclusive; rank orders kinds that start together.
SPAN = "struct<start: bigint, rank: int, kind: string, end: bigint, found: string>"


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(spans: str, kinds: tuple[str, ...], is_base=None) -> list[Column]:
    """n_<kind> for every base kind, base_sha256 and spans, from a column of sorted spans.

    Base spans are those of the base kinds, or those that is_base(span) says.
    """
    column = F.col(spans)
    base = F.filter(column, is_base or (lambda s: s["kind"].isin(*kinds)))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    digest = F.sha2(joined(base).cast("binary"), 256).alias("base_sha256")
    return [*(count(k).alias(f"n_{k}") for k in kinds), digest, joined(column).alias("spans")]
