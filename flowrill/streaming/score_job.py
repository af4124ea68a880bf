"""Continuous scoring of growing captures, each row exactly once.

Progress lives in the streaming checkpoint and a batch is written under its batch number, replacing
what an interrupted attempt may have left. A batch that fails is retried from the same positions; a
malformed line goes to the quarantine table and does not stop the job. A batch is parsed once, into a
table next to the checkpoint's log, which the outputs are made of; executors hold none of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from flowrill.functions.numbers import text_to_double
from flowrill.plans.scoring import linear_label, scorable, score_flows
from flowrill.schema import CANONICAL_COLUMNS
from flowrill.session import delete_path, path_exists
from flowrill.sources.day_store import write_analysed
from flowrill.sources.tail import tail_captures
from flowrill.streaming.ingest import malformed_lines, parse_lines, stored_lines, typed_lines

Scorer = Callable[[DataFrame], DataFrame]


def model_scorer(model) -> Scorer:
    return lambda flows: score_flows(flows, model)


def linear_scorer(flows: DataFrame) -> DataFrame:
    """Scorer with fixed weights, for demonstration."""
    return scorable(flows).withColumn("label", linear_label())


def _counters(parsed: DataFrame) -> DataFrame:
    """Rows, malformed rows and rows of protocol 0 of a batch."""
    protocol_zero = ~F.col("malformed") & (text_to_double(F.col("fields.Protocol")) == 0)
    return parsed.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if("malformed").alias("malformed"),
        F.count_if(protocol_zero).alias("protocol_zero"),
    )


def _write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch's rows under its number, in place of what an earlier attempt left."""
    (
        rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        .partitionBy("batch_id").parquet(path)
    )


def start_scoring(
    spark: SparkSession,
    folder: str,
    output: str,
    quarantine: str,
    checkpoint: str,
    scorer: Scorer,
    columns: list[str] | None = None,
    trigger: dict | None = None,
    name: str = "flow_scoring",
    by_day: bool = True,
    metrics: str | None = None,
    **source_options,
) -> StreamingQuery:
    """Start scoring the captures of a folder; also what exists when the job starts.

    ``trigger`` is passed to the stream, for example ``{"processingTime": "1 second"}`` or
    ``{"availableNow": True}``, which plans one batch. With ``metrics`` the counters of every batch
    are written below it, under the batch's number. ``max_bytes_per_trigger`` among the options of
    the source bounds a batch; what was planned is kept next to the checkpoint's own log.
    """
    if "max_bytes_per_trigger" in source_options:
        source_options.setdefault("plan_log", f"{checkpoint}/planned")
    lines = tail_captures(spark, folder, columns or CANONICAL_COLUMNS, **source_options)
    parsed = parse_lines(lines, columns)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        stored = f"{checkpoint}/parsed/{batch_id}"
        try:
            lines = stored_lines(spark, batch, stored)
            write_analysed(scorer(typed_lines(lines, columns)), output, batch_id, by_day)
            _write_batch(malformed_lines(lines), quarantine, batch_id)
            if metrics is not None:
                _write_batch(_counters(lines), metrics, batch_id)
        finally:
            delete_path(spark, stored)

    return (
        parsed.writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .foreachBatch(write_batch)
        .start()
    )


def batch_metrics(spark: SparkSession, metrics: str) -> DataFrame:
    """Counters of all batches so far: batch_id, rows_in, malformed, protocol_zero."""
    schema = "rows_in bigint, malformed bigint, protocol_zero bigint, batch_id bigint"
    if not path_exists(spark, metrics):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(metrics)
