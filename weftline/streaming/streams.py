"""Structured Streaming: event-time windows, sessions, new sources, keyed state and exactly-once reconciliation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators import reconcile


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; ``ts`` comes as an instant."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    d = events.withWatermark("ts", late) if events.isStreaming else events
    g = d.groupBy(F.window("ts", width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, step: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    d = events.withWatermark("ts", late) if events.isStreaming else events
    g = d.groupBy(F.window("ts", width, step), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """An event that comes ``gap`` after the last one begins a session; Spark's window would still take it, so its gap is the last microsecond before."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    g = d.groupBy(F.session_window("ts", f"{gap} -1 microseconds"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(key, F.col("session_window.start").alias("start"), (F.col("session_window.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("end"), "n", "total")


def usage_increments(counts: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, seq, increment): cumulative totals of each document to increments, with state across batches.

    A total that falls starts anew; equal totals give nothing. ``counts``: key, seq, total.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = []
        for f in frames:
            for seq, total in f.sort_values("seq")[["seq", "total"]].itertuples(index=False):
                if total != last:
                    rows.append((k[0], int(seq), int(total - last if total > last else total)))
                last = int(total)
        state.update((last,))
        yield pd.DataFrame(rows, columns=[key, "seq", "increment"])

    return counts.groupBy(key).applyInPandasWithState(step, f"{key} string, seq bigint, increment bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Process what is there into Parquet files beside the checkpoint and return their rows; none pass through the driver.

    A batch of complete mode replaces the files of the one before; batches of other modes add theirs. One that is run again
    after a crash writes over its own.
    """
    spark, rows = stream.sparkSession, f"{checkpoint.rstrip('/')}/rows"
    spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]).write.mode("ignore").parquet(f"{rows}/none")

    def batch(d: DataFrame, number: int) -> None:
        d.write.mode("overwrite").parquet(f"{rows}/{'whole' if mode == 'complete' else number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(batch).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(rows)


def follow_sources(spark: SparkSession, folder: str, glob: str, store: reconcile.Store, process, checkpoint: str):
    """Watch a folder of transcripts: each batch of new or rewritten files goes through ``process(snapshot frame)``,
    which returns the tables to commit. The batch number is committed with the tables, so a batch that is run again
    after a crash changes nothing; a rewritten file replaces what it claimed before, however late it comes."""
    s = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    s = s.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("len"), F.sha2("content", 256).alias("fingerprint"), "content")

    def batch(d: DataFrame, number: int) -> None:
        try:
            done = store.table("stream_batches").agg(F.max("batch")).first()[0]
        except KeyError:
            done = None
        if done is not None and number <= done:
            return
        tables = process(d)
        tables["stream_batches"] = spark.range(1).select(F.lit(number).cast("bigint").alias("batch"))
        store.commit(tables, store.generation)

    return s.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
