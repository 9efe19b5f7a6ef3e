"""Arrow batches of bounded size, for the steps that hold whole documents in Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, about. A worker holds one batch and what is made
#: of it, so rows are counted by what they hold: 10,000 pages are too many.
BATCH_BYTES = 4 << 20


def small_batches() -> None:
    """Hold the Arrow batches of the active session to ``BATCH_BYTES``."""
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
