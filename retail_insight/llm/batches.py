"""Arrow batches bounded by bytes, not by rows alone."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_BYTES = 4 << 20
_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let a batch of rows go to Python after ``most`` bytes (or one row), so
    that a task holds few whole texts at a time, however many rows its split
    has. A session that sets a bound of its own keeps it."""
    if _KEY not in spark.conf.getAll:
        spark.conf.set(_KEY, str(most))
