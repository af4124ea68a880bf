"""Incremental live views. Extensions: the streaming forms of the trend and of the patterns.

The trend keeps no state: each batch stores its sums, readers add them up, and now and then all are
folded into one table. The patterns' state is one small row per source. Rows are combined map-side
first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from flowrill.functions.flow_text import has_text
from flowrill.functions.numbers import number_or_zero
from flowrill.session import child_names, delete_path, path_exists


def live_trend(flows: DataFrame, window: str = "1 second", late: str | None = None) -> DataFrame:
    """Byte and packet rate sums per time window.

    By default no row is late: a window's state, one small row, is kept for good. With ``late``
    windows older than that are closed and later rows of theirs dropped; :class:`DroppedRows`
    counts them.
    """
    # Watermarks need a zoned timestamp; sessions run in UTC.
    timed = flows.withColumn("event_time", F.col("ts").cast("timestamp"))
    if late is not None:
        timed = timed.withWatermark("event_time", late)
    return (
        timed.groupBy(F.window("event_time", window).alias("w"))
        .agg(
            F.sum(number_or_zero("flow_bytes_s")).alias("bytes"),
            F.sum(number_or_zero("flow_packets_s")).alias("packets"),
        )
        .select(F.col("w.start").cast("timestamp_ntz").alias("ts"), "bytes", "packets")
    )


def trend_sums(flows: DataFrame, window: str = "1 second") -> DataFrame:
    """Byte and packet rate sums per time window of some flows."""
    start = F.window(F.col("ts").cast("timestamp"), window)["start"]  # sessions run in UTC
    return flows.where(F.col("ts").isNotNull()).groupBy(start.cast("timestamp_ntz").alias("ts")).agg(
        F.sum(number_or_zero("flow_bytes_s")).alias("bytes"),
        F.sum(number_or_zero("flow_packets_s")).alias("packets"),
    )


def _added(sums: DataFrame) -> DataFrame:
    return sums.groupBy("ts").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))


def _trend_parts(spark: SparkSession, output: str) -> list[tuple[str, int, str]]:
    """Complete tables as (kind, last batch, path), those that a folded one covers left out."""
    parts = []
    for name in child_names(spark, output):
        if path_exists(spark, f"{output}/{name}/_SUCCESS"):
            kind, last = name.split("-")
            parts.append((kind, int(last), f"{output}/{name}"))
    folded = max((last for kind, last, _ in parts if kind == "all"), default=-1)
    return [p for p in parts if (p[0] == "all" and p[1] == folded) or p[1] > folded]


def start_trend(
    flows: DataFrame, output: str, checkpoint: str, trigger: dict | None = None, window: str = "1 second",
    fold_every: int = 50,
) -> StreamingQuery:
    """Store the sums of every batch under its number; a repeated batch replaces its own.

    No flow is late and the stream has no state. Every ``fold_every`` batches the tables so far
    become one; only then those it covers are deleted.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if any(kind == "all" and last >= batch_id for kind, last, _ in _trend_parts(spark, output)):
            return  # repeated after it was folded
        trend_sums(batch, window).write.mode("overwrite").parquet(f"{output}/batch-{batch_id}")
        if batch_id % fold_every == fold_every - 1:
            fold_trend(spark, output)

    return (
        flows.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .foreachBatch(write_batch)
        .start()
    )


def fold_trend(spark: SparkSession, output: str) -> None:
    """Add up the tables so far into one, then delete them."""
    parts = _trend_parts(spark, output)
    if len(parts) < 2:
        return
    last = max(last for _, last, _ in parts)
    read_trend(spark, output).write.mode("overwrite").parquet(f"{output}/all-{last}")
    for *_, path in parts:
        delete_path(spark, path)


def read_trend(spark: SparkSession, output: str) -> DataFrame:
    """``ts, bytes, packets`` of all batches so far."""
    schema = "ts timestamp_ntz, bytes double, packets double"
    paths = [path for *_, path in _trend_parts(spark, output)]
    return _added(spark.read.schema(schema).parquet(*paths)) if paths else spark.createDataFrame([], schema)


def live_pattern_totals(flows: DataFrame) -> DataFrame:
    """Running per-source totals, the input of the pattern tests."""
    return (
        flows.where(has_text("src_ip"))
        .groupBy(F.col("src_ip").alias("ip"))
        .agg(
            F.sum(number_or_zero("syn")).cast("bigint").alias("syn"),
            F.sum(number_or_zero("ack")).cast("bigint").alias("ack"),
            F.sum(number_or_zero("rst")).cast("bigint").alias("rst"),
            F.sum(number_or_zero("flow_packets_s")).alias("rate"),
        )
    )


class DroppedRows(StreamingQueryListener):
    """Counts the rows that watermarks dropped, per query id and from all batches.

    Register with ``spark.streams.addListener`` before the query starts.
    """

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        dropped = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + dropped

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def start_updates(
    view: DataFrame, output: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write the changed rows of every batch under its batch number."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id").parquet(output)
        )

    return (
        view.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .foreachBatch(write_batch)
        .start()
    )


def read_updates(spark: SparkSession, output: str, view: DataFrame) -> DataFrame:
    """What :func:`start_updates` wrote so far; no rows if no batch had any."""
    schema = view.schema.add("batch_id", "long")
    if not path_exists(spark, output):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(output)


def current_state(updates: DataFrame, key: str) -> DataFrame:
    """The last written row of every key; one row per key and batch exists at most."""
    columns = [c for c in updates.columns if c not in (key, "batch_id")]
    newest = F.max_by(F.struct(*columns), "batch_id").alias("state")
    return updates.groupBy(key).agg(newest).select(key, "state.*")
