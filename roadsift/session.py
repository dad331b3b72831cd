"""Session settings the operators rely on; all are runtime SQL settings, none touches the cluster."""

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    # HotSpot does not optimise methods above 8000 bytes of bytecode; wide expressions then run interpreted.
    # Beyond this size Spark splits the expressions into smaller methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # also where an aggregate reuses the join's partitioning: only a skewed join then pays for a shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # partial top-k before the shuffle also for the k = 24 of the actor tables
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="roadsift-"), "roadsift"), "zip", os.path.dirname(root), "roadsift")
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)


def tune(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark
