"""Structured Streaming forms: windows under a watermark, and the message fold with keyed state."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators import events as E

LATE = "10 minutes"


def tumbling(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = LATE) -> DataFrame:
    w = F.window("ts", width, step)
    return events.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def stream_message_texts(events: DataFrame, key: str = "message_id") -> DataFrame:
    """key, version and what every micro-batch that touched a message adds to its content; `events.joined_versions` puts
    the whole together. The state of a message is the number of its last version.

    events: key, seq, event, text. A micro-batch's events of one message are taken in the order of seq.
    """
    rows = events.select(key, "seq", E.event_text(F.col("event"), F.col("text")).alias("t"))

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version = state.get[0] + 1 if state.exists else 1
        state.update((version,))
        yield pd.DataFrame({key: [group[0]], "version": [version], "content": ["".join(pd.concat(list(frames)).sort_values("seq")["t"])]})

    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} long, version long, content string", "version long", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what its source holds now, into Parquet at `path`; returns the table."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/_state").outputMode("append").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def run_to_versions(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream of updates over what its source holds now, into Parquet at `path`; returns all versions of its rows,
    with the number of their micro-batch as `version`. A batch that is run again replaces its rows."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/version={batch}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/_state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("version", T.LongType())])
    return stream.sparkSession.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, as processors with timers need; the setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stream_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A stream over a Parquet folder or a single file: a stream's source takes a lone file only by a pattern."""
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
