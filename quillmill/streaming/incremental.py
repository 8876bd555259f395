"""Bounded incremental reads: what has arrived since the last run, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process_new(spark: SparkSession, path: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Apply a transform to the Parquet files that came since the last call, and append the result; then end."""
    stream = spark.readStream.schema(schema).parquet(path)
    query = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
