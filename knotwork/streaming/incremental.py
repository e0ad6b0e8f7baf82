"""Incremental upkeep of a graph: a stream of changed facts is folded in, and the result equals a full build.

The state is a table of facts by batch. A batch that runs again (the stream restarts, an executor is lost) replaces its own
part, and merging treats facts as a set, so replays change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators.graph import merge_edges

FACT = "source string, relation string, target string, confidence string, line int, via string, seq long"


def fold_in(spark: SparkSession, incoming: str, state: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """Takes all files of facts that are new below incoming, in batches, into the state table; ends when none is left."""

    def keep(batch: DataFrame, number: int) -> None:
        merged = batch.groupBy("source", "relation", "target", "confidence", "line", "via").agg(F.min("seq").alias("seq"))
        merged.write.mode("overwrite").parquet(f"{state}/batch={number}")

    stream = spark.readStream.schema(FACT).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_edges(spark: SparkSession, state: str) -> DataFrame:
    """The merged edges of all facts that were folded in."""
    return merge_edges(spark.read.parquet(state).select(*(c.split(" ")[0] for c in FACT.split(", "))))
