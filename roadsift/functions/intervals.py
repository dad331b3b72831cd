"""Interval overlap, containment and tolerance joins through time buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column, union: str = "sum", eps: float = 0.0) -> Column:
    """Temporal IoU; ``union`` is "sum" (lengths minus overlap) or "hull" (span of both)."""
    inter = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    if union == "hull":
        total = F.greatest(a1, b1) - F.least(a0, b0)
    else:
        total = (a1 - a0) + (b1 - b0) - inter
    total = F.greatest(total, F.lit(eps)) if eps else total
    return F.when(total > 0, inter / total).otherwise(F.lit(0.0))


def _spread(df: DataFrame, lo: Column, hi: Column, width: float) -> DataFrame:
    return (df.withColumn("_b0", F.floor(lo / width))
            .withColumn("_bucket", F.explode(F.sequence(F.col("_b0"), F.floor(hi / width)))))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], l: tuple[str, str], r: tuple[str, str],
                 pad: float = 0.0, width: float = 30.0) -> DataFrame:
    """Pairs with the same keys whose intervals touch once the left one is padded by ``pad`` on both sides.

    Both sides are cut into time buckets, so a log with most of the rows is joined bucket by bucket.
    Columns of the two sides must differ apart from the keys.
    """
    keys = list(keys)
    lo, hi = F.col(l[0]) - pad, F.col(l[1]) + pad
    a = _spread(left, lo, hi, width).withColumnRenamed("_b0", "_la")
    b = _spread(right, F.col(r[0]), F.col(r[1]), width).withColumnRenamed("_b0", "_rb")
    pairs = a.join(b, [*keys, "_bucket"]).where(
        (F.col("_bucket") == F.greatest("_la", "_rb"))
        & (F.col(r[0]) <= F.col(l[1]) + pad) & (F.col(r[1]) >= F.col(l[0]) - pad))
    return pairs.drop("_la", "_rb", "_bucket")


def near_join(left: DataFrame, right: DataFrame, keys: Sequence[str], l: str, r: str, tol: float) -> DataFrame:
    """Pairs with the same keys and |left.l - right.r| <= tol; bucket width equals the tolerance."""
    keys = list(keys)
    width = float(tol) if tol > 0 else 1e-6
    at = F.floor(F.col(l) / width)
    a = left.withColumn("_bucket", F.explode(F.array(at - 1, at, at + 1)))
    b = right.withColumn("_bucket", F.floor(F.col(r) / width))
    return a.join(b, [*keys, "_bucket"]).where(F.abs(F.col(l) - F.col(r)) <= tol).drop("_bucket")
