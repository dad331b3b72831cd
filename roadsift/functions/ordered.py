"""Order-dependent operators that never gather one whole key in one task.

Window functions over ``partitionBy(log)`` put every row of a log into a single task.  A log that
holds a third of the data would then decide the run time of the job, so the operators here cut each
key into chunks of at most ``CHUNK`` consecutive rows:

* ``row_index`` numbers the rows of every key through a range partitioning, which splits hot keys;
* ``with_halo`` copies the few rows a bounded look-around needs into the neighbouring chunk;
* ``running_sum`` and ``fill_edges`` carry one summary row per chunk over to the next chunks, and one per chunk of chunks over those: no
  task sees more than ``CHUNK`` rows of a key at either level (a key of 10^12 rows has under 4,000 at the last).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadsift.functions.durable import pinned

CHUNK = 16384


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "i", start: int = 0) -> DataFrame:
    """Number the rows of each key in the given order, from ``start``.

    The range partitioning covers keys *and* order, so that one key may span many tasks.  Only keys
    cut by a partition border need an offset: fewer rows than there are partitions, hence the broadcast.
    """
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = list(keys)
    ranged = pinned(df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
                    .withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    local = ranged.withColumn("_pos", F.row_number().over(within).cast("bigint") - 1)
    sizes = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sizes.withColumn("_before", F.sum("_rows").over(before))
               .where("_before > 0").drop("_rows"))
    on = [local[k].eqNullSafe(offsets[k]) for k in keys] + [local["_part"] == offsets["_part"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return (local.join(F.broadcast(offsets), cond, "left")
            .select(*[local[c] for c in df.columns],
                    (F.col("_pos") + F.coalesce(F.col("_before"), F.lit(0)) + start).alias(out)))


def chunk_of(i: str = "i", size: int = CHUNK) -> Column:
    return F.floor(F.col(i) / size)


def with_halo(df: DataFrame, i: str = "i", before: int = 0, after: int = 0, size: int = CHUNK) -> DataFrame:
    """Add ``_chunk`` and copy rows next to a chunk border into the neighbour; copies have ``_own = false``.

    A window over (keys, ``_chunk``) then sees ``before``/``after`` rows on each side of every own row.
    """
    own = chunk_of(i, size)
    offset = F.col(i) % size
    homes = F.array_compact(F.array(
        own,
        F.when(offset >= size - before, own + 1) if before else F.lit(None).cast("bigint"),
        F.when((offset < after) & (own > 0), own - 1) if after else F.lit(None).cast("bigint"),
    ))
    return df.withColumn("_chunk", F.explode(homes)).withColumn("_own", F.col("_chunk") == own)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_chunk")


def chunk_window(keys: Sequence[str], i: str = "i"):
    return Window.partitionBy(*keys, "_chunk").orderBy(i)


def running_sum(df: DataFrame, keys: Sequence[str], value: str, out: str, i: str = "i", size: int = CHUNK) -> DataFrame:
    """Inclusive running sum of ``value`` per key in the order of ``i``.

    Sum inside a chunk plus the totals of the chunks before it; the totals are ``CHUNK`` times fewer
    than the rows, and keys with one chunk contribute none.
    """
    keys = list(keys)
    chunked = df.withColumn("_chunk", chunk_of(i, size))
    local = chunked.withColumn(out, F.sum(value).over(
        chunk_window(keys, i).rowsBetween(Window.unboundedPreceding, 0)))
    totals = chunked.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_total")).withColumn("_super", chunk_of("_chunk", size))
    inner = totals.withColumn("_in", F.sum("_total").over(_over(keys, "_super", "_chunk").rowsBetween(Window.unboundedPreceding, -1)))
    outer = totals.groupBy(*keys, "_super").agg(F.sum("_total").alias("_all")).withColumn(
        "_before", F.sum("_all").over(_over(keys, None, "_super").rowsBetween(Window.unboundedPreceding, -1)))
    carry = inner.join(outer, [*keys, "_super"]).where("_chunk > 0").select(
        *keys, "_chunk", (F.coalesce("_before", F.lit(0)) + F.coalesce("_in", F.lit(0))).alias("_carry"))
    return (local.join(carry, [*keys, "_chunk"], "left")
            .withColumn(out, F.col(out) + F.coalesce(F.col("_carry"), F.lit(0)))
            .select(*df.columns, out))


def _over(keys: Sequence[str], level: str | None, order: str):
    """Rows of a key, or of one chunk of chunks of it, in order; without either they are dealt by a constant."""
    by = [*keys, *([level] if level else [])]
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)


def fill_edges(df: DataFrame, keys: Sequence[str], value: Column, prev: str, nxt: str, i: str = "i",
               size: int = CHUNK) -> DataFrame:
    """Last non-null ``value`` at or before each row (``prev``) and first one at or after it (``nxt``)."""
    keys = list(keys)
    chunked = df.withColumn("_value", value).withColumn("_chunk", chunk_of(i, size))
    w = chunk_window(keys, i)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    local = (chunked.withColumn(prev, F.last("_value", ignorenulls=True).over(back))
             .withColumn(nxt, F.first("_value", ignorenulls=True).over(ahead)))
    ends = chunked.groupBy(*keys, "_chunk").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(i))).alias("_last"),
        F.min_by("_value", F.when(F.col("_value").isNotNull(), F.col(i))).alias("_first"))
    ends = ends.withColumn("_super", chunk_of("_chunk", size))
    supers = ends.groupBy(*keys, "_super").agg(F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_chunk"))).alias("_end"),
                                               F.min_by("_first", F.when(F.col("_first").isNotNull(), F.col("_chunk"))).alias("_begin"))

    def around(w, last: str, first: str) -> list[Column]:
        return [F.last(last, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                F.first(first, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))]
    far = [c.alias(n) for c, n in zip(around(_over(keys, None, "_super"), "_end", "_begin"), ("_far_before", "_far_after"))]
    close = [c.alias(n) for c, n in zip(around(_over(keys, "_super", "_chunk"), "_last", "_first"), ("_before", "_after"))]
    carry = ends.select(*keys, "_super", "_chunk", *close).join(supers.select(*keys, "_super", *far), [*keys, "_super"]).select(
        *keys, "_chunk", F.coalesce("_before", "_far_before").alias("_before"), F.coalesce("_after", "_far_after").alias("_after"),
    ).where("_before IS NOT NULL OR _after IS NOT NULL")
    return (local.join(carry, [*keys, "_chunk"], "left")
            .withColumn(prev, F.coalesce(F.col(prev), F.col("_before")))
            .withColumn(nxt, F.coalesce(F.col(nxt), F.col("_after")))
            .select(*df.columns, prev, nxt))
