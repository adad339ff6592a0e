"""Session settings the package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime SQL settings only, so they can be applied to a session that already runs.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",  # {"a":1,"a":2} is valid JSON, last one wins
    "spark.sql.analyzer.maxIterations": "500",  # nested bindings are resolved one level after the other
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and return the session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark
