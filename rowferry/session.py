"""A session with the settings the plans here rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution does the run-time half of the work: it turns joins with a
# small side into broadcasts, splits skewed join partitions by map output, and
# merges small ones. Broadcasts stay under Spark's size check.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Fused loops beyond what the JIT compiles are slower than separate operators.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Plans here are built from many small expressions; skip a stack walk for each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Big5, GBK and friends as CSV encodings.
    "spark.sql.legacy.javaCharsets": "true",
}


def session(app: str = "rowferry", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
