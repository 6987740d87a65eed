"""Streaming forms: sessions by inactivity, and index refresh per batch of new chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import lexical
from ..scratch import fresh_path


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the event files of a folder or glob."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(path)


def inactivity_sessions(events: DataFrame, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n_events) of stretches without a pause of `gap`; works on streams and tables."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        d = d.withWatermark("ts", late)
    g = d.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def run_available(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Read all that is there into a Parquet table in the shared folder and return it.

    In mode complete each batch replaces the table, in append each adds to it. A table per run: `name` is only its label.
    """
    spark, path = stream.sparkSession, fresh_path(stream.sparkSession, name)
    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(path)
    write = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)
    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def refresh_index(chunks: DataFrame, checkpoint: str, refresh: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Call `refresh` with each batch of new chunk rows: it rewrites the index tables of the sessions it names."""
    return chunks.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_lexical(chunks: DataFrame, checkpoint: str, index: str, session: str = "chat_session_id", key: str = "chunk_id", text: str = "text", most_segments: int = 8) -> StreamingQuery:
    """Bring a lexical index up to date with each batch of new chunk rows: they become a segment; beyond `most_segments` all segments become one.

    chunks: a stream of new chunks; index: folder of lexical.build_index. A batch that is sent again after a failure is known by its number.
    """

    def refresh(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        lexical.add_to_index(batch, index, session, key, text, once=(checkpoint, number))
        if lexical.segments(batch.sparkSession, index) > most_segments:
            lexical.compact_index(batch.sparkSession, index)

    return refresh_index(chunks, checkpoint, refresh)
