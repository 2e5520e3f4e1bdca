"""Spark settings these plans rely on. All are runtime SQL settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan joins by measured size, merge small partitions, split large ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Merged partitions stay small: rows of loans and months compress to some 13 bytes each, and a
    # task sorts several tables of its partition.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # Split a heavy join partition even when the aggregation behind it then needs its own shuffle;
    # that shuffle carries only partial aggregates.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Let a selective cohort of loans filter a large history before it is shuffled. It only takes
    # effect on scans above Spark's own size threshold, and drops only rows that cannot join.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
