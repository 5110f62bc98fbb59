"""Incremental ingestion: a file stream into a versioned table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.store import Table


def ingest(spark: SparkSession, source: str, schema: str, table: Table, transform: Callable[[DataFrame], DataFrame], checkpoint: str, file_format: str = "parquet") -> StreamingQuery:
    """New files below source pass through transform and are merged by the table's key. A batch that is run
    again after a failure merges to the same rows."""
    stream = spark.readStream.schema(schema).format(file_format).load(source)
    return stream.writeStream.foreachBatch(lambda batch, _: table.upsert(transform(batch))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def crawl(changes: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a sink over the new, modified and renamed files of a crawl and count the outcomes: action, n."""
    from pyspark.sql import functions as F

    busy = changes.where(F.col("action").isin("new", "modified", "renamed"))
    done = apply(busy).select(F.col("status").alias("action"))
    idle = changes.where(F.col("action") == "unchanged").select(F.lit("skipped").alias("action"))
    return done.unionByName(idle).groupBy("action").agg(F.count("*").alias("n"))
