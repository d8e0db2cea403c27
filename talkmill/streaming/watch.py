"""Importing exports as they arrive in a folder: each batch of files is merged into the index's partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talkmill.jobs.index import PARTS, PartitionedIndex


def watch(spark: SparkSession, folder: str, index: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Merge JSON Lines exports that come into ``folder`` into the index at ``index``.

    A batch touches the partitions of the conversations that it changes. One that runs again after a failure comes to the same
    tables, and older copies of a conversation change nothing, whatever order the files come in.
    """

    def merge_batch(batch: DataFrame, n: int) -> None:
        PartitionedIndex(batch.sparkSession, index, parts).merge(batch.select(F.col("value").alias("raw")).filter("raw != ''"), n)

    return spark.readStream.format("text").load(folder).writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
