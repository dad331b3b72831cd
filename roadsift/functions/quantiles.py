"""Exact linear-interpolated quantiles for groups of any size.

The built-in exact ``percentile`` keeps every distinct value of a group in one task.  Here a mergeable
sketch first brackets each wanted rank; only the rows inside the bracket are counted by value, while the
rest of the group contributes one row below and one above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10000


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float],
                    out: str = "q", nearest: bool = False, fixed: bool = False) -> DataFrame:
    """One row per (key, p): ``p``, the exact quantile in ``out`` and the group size ``n``.

    ``nearest`` picks the order statistic nearest to rank (n-1)*p (half to even) instead of interpolating.  ``fixed`` says that the number of
    keys doesn't grow with the rows (columns, flags, folds): their brackets are then broadcast, so that no task gets all rows of a key.
    """
    keys = list(keys)
    slack = 2.0 / ACCURACY
    lows = [max(0.0, p - slack) for p in ps]
    highs = [min(1.0, p + slack) for p in ps]
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    brackets = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("_v", lows, F.lit(ACCURACY)).alias("_lows"),
        F.percentile_approx("_v", highs, F.lit(ACCURACY)).alias("_highs"))
    if keys:
        joined = values.join(F.broadcast(brackets) if fixed else brackets, keys)
    else:
        joined = values.withColumn("_b", brackets.select(F.struct("n", "_lows", "_highs")).scalar()) \
                       .select("_v", "_b.*")
    lo, hi = (lambda k: F.element_at("_lows", k + 1)), (lambda k: F.element_at("_highs", k + 1))
    v = F.col("_v")
    # what lies outside a bracket is counted where it is, one number per rank and side; only rows inside one become rows of their own
    beside = joined.groupBy(*keys).agg(F.max("n").alias("n"), *[c.alias(f"{name}{k}") for k in range(len(ps)) for name, c in (
        ("_below", F.count_if(v < lo(k))), ("_above", F.count_if(v > hi(k))), ("_max", F.max(F.when(v < lo(k), v))), ("_min", F.min(F.when(v > hi(k), v))))])
    nothing = F.lit(None).cast("double")
    sides = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(side).alias("_side"), nothing.alias("_at"), F.col(f"{name}{k}").alias("_rows"),
                               (F.col(f"_min{k}") if side else nothing).alias("_min"), (nothing if side else F.col(f"_max{k}")).alias("_max"))
                      for k, p in enumerate(ps) for side, name in ((0, "_below"), (2, "_above"))])
    beside = beside.select(*keys, "n", F.explode(sides).alias("_w")).select(*keys, "n", "_w.*").where("_rows > 0")
    ranks = F.array(*[F.when((v >= lo(k)) & (v <= hi(k)), F.lit(float(p))) for k, p in enumerate(ps)])
    within = joined.select(*keys, "n", "_v", F.explode(F.array_compact(ranks)).alias("p")).groupBy(*keys, "n", "p", F.col("_v").alias("_at")).agg(F.count(F.lit(1)).alias("_rows"))
    counted = beside.unionByName(within.select(*keys, "n", "p", F.lit(1).alias("_side"), "_at", "_rows", F.col("_at").alias("_min"), F.col("_at").alias("_max")))
    return _picked(counted, keys, out, nearest)


def _picked(counted: DataFrame, keys: Sequence[str], out: str, nearest: bool = False) -> DataFrame:
    """The quantile of each (key, p) from counts by value in its bracket and one count on either side."""
    w = Window.partitionBy(*keys, "p").orderBy("_side", "_at")
    counted = counted.withColumn("_end", F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rank = (F.col("n") - 1) * F.col("p")
    if nearest:
        low = high = F.bround(rank, 0) + 1
    else:
        low, high = F.floor(rank) + 1, F.ceil(rank) + 1

    def holds(r):
        return (F.col("_end") - F.col("_rows") < r) & (r <= F.col("_end"))

    def at(r):
        return F.when(holds(r), F.when(F.col("_side") == 0, F.col("_max"))
                      .when(F.col("_side") == 2, F.col("_min")).otherwise(F.col("_at")))

    found = counted.where(holds(low) | holds(high)).groupBy(*keys, "n", "p").agg(
        F.max(at(low)).alias("_lo"), F.max(at(high)).alias("_hi"))
    frac = F.lit(0.0) if nearest else (F.col("n") - 1) * F.col("p") - F.floor((F.col("n") - 1) * F.col("p"))
    return _between(found.withColumn("_f", frac), out).select(*keys, "p", "n", out)


def _between(df: DataFrame, out: str) -> DataFrame:
    """``_lo`` (1 - ``_f``) + ``_hi`` ``_f``, the first product unrounded, as SQL's quantile has it: a threshold is compared with the values it
    lies among, which may be equal but for their last bits.  The error of a product follows from its factors' halves."""
    def halves(c: Column) -> tuple[Column, Column]:
        high = c * 134217729.0 - (c * 134217729.0 - c)
        return high, c - high
    df = df.withColumns({"_e": 1 - F.col("_f"), "_q": F.col("_hi") * F.col("_f")}).withColumn("_p", F.col("_lo") * F.col("_e")).withColumn("_s", F.col("_p") + F.col("_q"))
    (a, b), (c, d) = halves(F.col("_lo")), halves(F.col("_e"))
    p, q, s = F.col("_p"), F.col("_q"), F.col("_s")
    rest = (p - (s - (s - p))) + (q - (s - p)) + (((a * c - p) + a * d + b * c) + b * d)
    # infinite or huge values have no halves
    return df.withColumn(out, F.when(F.col("_f") == 0, F.col("_lo")).when(F.isnan(s + rest), F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).otherwise(s + rest))


def column_quantiles(df: DataFrame, columns: dict[str, Column], p: float) -> dict[str, float | None]:
    """The exact quantile of every column of a table, all columns in the same passes; the driver gets one number each.

    The first pass brackets every column's rank, the second counts what lies beside the brackets; rows become rows of their own only for
    columns whose bracket holds different values, and only if they lie in it."""
    names = list(columns)
    values = df.select(*[c.cast("double").alias(f"c{k}") for k, c in enumerate(columns.values())])
    slack = 2.0 / ACCURACY
    ranks = [max(0.0, p - slack), min(1.0, p + slack)]
    first = values.agg(*[f for k in range(len(names)) for f in (F.count(f"c{k}").alias(f"n{k}"), F.percentile_approx(f"c{k}", ranks, F.lit(ACCURACY)).alias(f"b{k}"))]).first()
    known = [k for k in range(len(names)) if first[f"n{k}"]]
    if not known:
        return dict.fromkeys(names)
    lo, hi = {k: first[f"b{k}"][0] for k in known}, {k: first[f"b{k}"][1] for k in known}
    c = {k: F.col(f"c{k}") for k in known}
    beside = values.agg(*[f.alias(f"{name}{k}") for k in known for name, f in (
        ("below", F.count_if(c[k] < lo[k])), ("above", F.count_if(c[k] > hi[k])), ("max", F.max(F.when(c[k] < lo[k], c[k]))), ("min", F.min(F.when(c[k] > hi[k], c[k]))))]).first()
    rows = []
    for k in known:
        n, below, above = first[f"n{k}"], beside[f"below{k}"], beside[f"above{k}"]
        rows += [(k, n, p, 0, None, below, None, beside[f"max{k}"]), (k, n, p, 2, None, above, beside[f"min{k}"], None)]
        if lo[k] == hi[k]:
            rows.append((k, n, p, 1, lo[k], n - below - above, lo[k], lo[k]))
    counted = df.sparkSession.createDataFrame(rows, "field int, n long, p double, _side int, _at double, _rows long, _min double, _max double").where("_rows > 0")
    wide = [k for k in known if lo[k] < hi[k]]
    if wide:
        inside = F.array_compact(F.array(*[F.when((c[k] >= lo[k]) & (c[k] <= hi[k]), F.struct(F.lit(k).alias("field"), c[k].alias("_at"))) for k in wide]))
        within = values.select(F.explode(inside).alias("w")).groupBy("w.field", "w._at").agg(F.count(F.lit(1)).alias("_rows"))
        sizes = F.element_at(F.create_map(*[F.lit(x) for k in wide for x in (k, first[f"n{k}"])]), F.col("field")).cast("long")
        counted = counted.unionByName(within.select("field", sizes.alias("n"), F.lit(p).alias("p"), F.lit(1).alias("_side"), "_at", "_rows", F.col("_at").alias("_min"), F.col("_at").alias("_max")))
    found = {r["field"]: r["q"] for r in _picked(counted, ["field"], "q").collect()}
    return {name: found.get(k) for k, name in enumerate(names)}


def group_medians(df: DataFrame, keys: Sequence[str], value: str, out: str = "median", fixed: bool = False) -> DataFrame:
    return group_quantiles(df, keys, value, [0.5], out, fixed=fixed).select(*keys, out)


def wide_quantiles(df: DataFrame, keys: Sequence[str], value: str, names: dict[str, float]) -> DataFrame:
    """One row per key with one column per named quantile."""
    long = group_quantiles(df, keys, value, sorted(set(names.values())))
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(name) for name, p in names.items()])
