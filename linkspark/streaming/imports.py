"""Streaming imports: files of new rows arrive, each micro-batch is scored against a catalogue and its best matches kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkspark.operators.rank import top_k


def stream_of(spark: SparkSession, path: str, schema: str, max_files: int = 20) -> DataFrame:
    """Rows of parquet files as they appear; at most ``max_files`` a batch, so that a backlog does not swamp it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Feed every available micro-batch to the sink, then end; the checkpoint makes a restart go on where it stopped."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def best_matches(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], key: str, distance: str, tie: str, k: int = 5) -> DataFrame:
    """Top k of each key over all streamed rows, however they fell into batches.

    Each batch leaves its own top k below ``target`` (a batch that is repeated overwrites itself); the top k of those is
    that of all rows, since no row behind k others of its batch can be before k others of all.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        top_k(score(batch), key, distance, tie, k).drop("rank").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    run_available(stream_of(spark, source, schema), sink, checkpoint)
    return top_k(spark.read.parquet(target).drop("batch"), key, distance, tie, k)
