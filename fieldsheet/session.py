"""Session settings the operators expect."""

from pyspark.sql import SparkSession


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """UTC, adaptive execution with skew handling, quick column building; sizes are left to the cluster."""
    return (builder.config("spark.sql.session.timeZone", "UTC")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true"))
