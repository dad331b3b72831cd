"""SRC-12, SRC-13: a table of one row per key in hash buckets, of which a write touches only those that its keys fall into.

Every attempt carries an id that is recorded once its buckets are written.  An attempt that is repeated after that changes nothing; one that was
lost before it is run again whole, which leads to the same rows, as merging is idempotent.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from roadsift.functions.durable import stored
from roadsift.sources.io import insert_absent, upsert

BUCKET = "key_bucket"


class KeyedTable:
    """A folder with the rows below ``rows``, partitioned by bucket, and the attempts below ``attempts``."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, list(key), schema, buckets

    def _stored_rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(f"{self.path}/rows")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], f"{self.schema}, {BUCKET} int")

    def read(self) -> DataFrame:
        return self._stored_rows().drop(BUCKET)

    def attempts(self) -> DataFrame:
        try:
            return self.spark.read.schema("attempt string, touched int").parquet(f"{self.path}/attempts")
        except AnalysisException:
            return self.spark.createDataFrame([], "attempt string, touched int")

    def insert(self, new: DataFrame, attempt: str) -> int:
        """Rows whose key the table lacks; the number of buckets written."""
        return self._merge(new, attempt, lambda old, fresh: insert_absent(old, fresh, self.key))

    def upsert(self, new: DataFrame, attempt: str, seq: str = "load_seq") -> int:
        """The last write of each key by ``seq``; the number of buckets written."""
        return self._merge(new, attempt, lambda old, fresh: upsert(old, fresh, self.key, seq))

    def _merge(self, new: DataFrame, attempt: str, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        if not self.attempts().where(F.col("attempt") == attempt).isEmpty():
            return 0
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        columns = self.read().columns
        fresh = stored(new.select(*columns), "fresh-rows")
        touched = [r[0] for r in fresh.select(bucket.alias("b")).distinct().collect()]  # at most as many numbers as buckets
        if touched:
            old = self._stored_rows().where(F.col(BUCKET).isin(touched)).drop(BUCKET)
            # written aside first, as the buckets that are replaced are also read
            done = stored(merged(old, fresh).select(*columns), "merged-rows").withColumn(BUCKET, bucket)
            done.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.path}/rows")
        self.spark.createDataFrame([(attempt, len(touched))], "attempt string, touched int").coalesce(1).write.mode("append").parquet(f"{self.path}/attempts")
        return len(touched)
