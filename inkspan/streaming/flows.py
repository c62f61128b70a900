"""Structured Streaming: timelines with watermarks, the last row of every key, exact rate limits with state.

All flows run to the end of what is there (availableNow) or on and on with a processing time; checkpoints belong in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.session import ensure_checkpoint_dir


def _place(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/inkspan-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A table as a stream of its files, be it a folder of them or one file."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def event_timeline(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total) of an event stream; rows later than the watermark are dropped by the sink's mode append."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all input there is now; each batch is written under its number, so a repeated batch replaces itself."""
    spark = stream.sparkSession
    out, state = _place(spark, "out"), _place(spark, "state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}" if mode != "complete" else f"{out}/batch=0")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def latest_stream(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key of a stream so far, kept in Spark's state store; for output modes update and complete. Rows with a null key are left out."""
    others = [c for c in stream.columns if c not in keys]
    rank = F.struct(*order, *[c for c in others if c not in order])
    picked = stream.dropna(subset=keys).groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("last"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"last.{c}").alias(c) for c in stream.columns])


def admitted_stream(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(client, at, admitted) of a stream of (client, at): the state of a client is the times of its admitted requests in the window."""

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        for batch in batches:
            times = batch["micros"].sort_values()
            flags = []
            for t in times:
                recent = [r for r in recent if r > t - seconds * 1_000_000]
                flags.append(len(recent) < limit)
                if flags[-1]:
                    recent.append(int(t))
            yield pd.DataFrame({"client": key[0], "micros": times.to_numpy(), "admitted": flags})
        state.update((recent,))

    rows = requests.select("client", F.unix_micros(F.col("at").cast("timestamp")).alias("micros")).filter("client IS NOT NULL AND micros IS NOT NULL")
    return rows.groupBy("client").applyInPandasWithState(admit, "client string, micros long, admitted boolean", "recent array<long>", "append", "NoTimeout")
