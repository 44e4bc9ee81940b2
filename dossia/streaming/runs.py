"""Streams: extraction that goes on where it stopped, event counts with late data, and cards kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dossia.functions.answers import extraction
from dossia.sources.store import add_batch


def answers_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("id string, answer string").json(path)


def extract_stream(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Turns answer files into extraction records; each file is handled once, also after a restart."""
    out = extraction(answers_stream(spark, source)).writeStream.format("parquet")
    return out.option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, time: str, group: str, window: str = "1 hour", lateness: str = "30 minutes") -> DataFrame:
    """Counts per window and group; rows later than the watermark no longer count in a stream."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), group).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), group, "n"
    )


def link_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a store of documents and cards up to date (see ``store.add_batch``): each batch reads and writes the partitions that its documents lead to.

    A batch that is repeated after a failure gives the same store again.
    """

    def upsert(batch: DataFrame, n: int) -> None:
        add_batch(batch.sparkSession, path, batch)

    return docs.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
