"""Values of recorded series at other times: one join by time bucket, whatever lies between the samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadsift.functions.ordered import chunk_window, fill_edges, own_rows, row_index, with_halo

WIDTH = 4.0


def at_times(series: DataFrame, queries: DataFrame, cols: Sequence[str], t: str = "t_s", qt: str = "q_t", key: str = "log_id", width: float = WIDTH) -> DataFrame:
    """``queries`` with the columns of the series at their times: linear between the samples before and after, the end values beyond them.

    Samples of ``width`` seconds of a log are one row, an array in time order that carries the last sample before it and the first one
    after it, so that a query finds its two samples in the row of its own bucket.  Rows of queries whose log has no sample get nulls.  Sample
    times of a log differ; columns of queries and series differ apart from the key.
    """
    sample = F.struct(F.col(t).cast("double").alias("t"), *[F.col(c).cast("double").alias(c) for c in cols])
    cells = series.groupBy(key, F.floor(F.col(t) / width).alias("_b")).agg(F.sort_array(F.collect_list(sample)).alias("_s"))
    asked = queries.withColumn("_b", F.floor(F.col(qt) / width))
    buckets = cells.unionByName(asked.select(key, "_b").distinct(), allowMissingColumns=True).groupBy(key, "_b").agg(F.first("_s", ignorenulls=True).alias("_s"))
    # what lies before and after a bucket: carried over chunks of buckets, as one log may hold most of them
    numbered = row_index(buckets, [key], ["_b"], out="_i")
    filled = fill_edges(numbered, [key], F.when(F.col("_s").isNotNull(), F.struct(F.get("_s", F.lit(0)).alias("first"), F.element_at("_s", -1).alias("last"))), "_back", "_ahead", i="_i")
    w = chunk_window([key], "_i")
    around = own_rows(with_halo(filled, "_i", 1, 1).withColumns({"_before": F.lag("_back").over(w)["last"], "_after": F.lead("_ahead").over(w)["first"]}))
    hit = asked.join(around.select(key, "_b", "_s", "_before", "_after"), [key, "_b"], "left")
    hit = hit.withColumns({"_p": F.coalesce(F.try_element_at(F.filter("_s", lambda s: s["t"] <= F.col(qt)), F.lit(-1)), "_before"),
                           "_n": F.coalesce(F.get(F.filter("_s", lambda s: s["t"] >= F.col(qt)), F.lit(0)), "_after")})
    p, n = F.col("_p"), F.col("_n")
    share = (F.col(qt) - p["t"]) / (n["t"] - p["t"])
    return hit.select(*queries.columns, *[F.when(p.isNull(), n[c]).when(n.isNull() | (p["t"] == n["t"]), p[c]).otherwise(p[c] + (n[c] - p[c]) * share).alias(c) for c in cols])
