"""Traffic over time, spikes, newest and largest flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowrill.functions.flow_text import endpoint, protocol_name_traffic
from flowrill.functions.numbers import number_or_zero, round_half_up


def newest_first() -> list[Column]:
    return [F.col("ts").desc_nulls_last(), F.col("flow_id").asc()]


def oldest_first() -> list[Column]:
    return [F.col("ts").asc_nulls_last(), F.col("flow_id").asc()]


def traffic_trend(flows: DataFrame) -> DataFrame:
    """Byte and packet rate sums per timestamp."""
    return flows.groupBy("ts").agg(
        F.sum(number_or_zero("flow_bytes_s")).alias("bytes"),
        F.sum(number_or_zero("flow_packets_s")).alias("packets"),
    )


def trend_top_flow(flows: DataFrame) -> DataFrame:
    """Flow with the highest byte rate per timestamp; of equal ones the later in order."""
    best = F.max(F.struct(number_or_zero("flow_bytes_s").alias("bytes"), F.col("flow_id")))
    return flows.groupBy("ts").agg(best.alias("best")).select(
        "ts", F.col("best.flow_id").alias("top_flow_id"), F.col("best.bytes").alias("top_bytes")
    )


def traffic_spikes(flows: DataFrame) -> DataFrame:
    """Timestamps whose packets exceed mean + 2 population deviations, with the excess in percent.

    Needs two timestamps at least. Mean and deviation are one row, attached to every point.
    """
    points = flows.groupBy("ts").agg(F.sum(number_or_zero("flow_packets_s")).alias("packets"))
    stats = points.agg(
        F.avg("packets").alias("mean"),
        F.stddev_pop("packets").alias("deviation"),
        F.count(F.lit(1)).alias("points"),
    )
    above = round_half_up(
        (F.col("packets") - F.col("mean")) / F.nullif(F.col("mean"), F.lit(0.0)) * 100
    )
    return (
        points.crossJoin(F.broadcast(stats))  # one row
        .where(
            (F.col("points") >= 2)
            & (F.col("packets") > F.col("mean") + 2 * F.col("deviation"))
        )
        .select("ts", "packets", above.alias("percent_above_mean"))
    )


def recent_flows(flows: DataFrame, n: int = 100) -> DataFrame:
    """The n newest flows; each task keeps its own n, only those are merged."""
    return flows.orderBy(*newest_first()).limit(n)


def recent_rates(flows: DataFrame, n: int = 100) -> DataFrame:
    """Mean packet and byte rate of the n newest flows, 0 when there are none."""
    return recent_flows(flows.select("ts", "flow_id", "flow_packets_s", "flow_bytes_s"), n).agg(
        F.coalesce(F.avg(number_or_zero("flow_packets_s")), F.lit(0.0)).alias("packet_rate"),
        F.coalesce(F.avg(number_or_zero("flow_bytes_s")), F.lit(0.0)).alias("byte_rate"),
    )


def top_flows_by_bytes(flows: DataFrame, n: int = 10) -> DataFrame:
    return flows.orderBy(number_or_zero("flow_bytes_s").desc(), *oldest_first()).limit(n)


def top_flows_by_packets(flows: DataFrame, n: int = 10) -> DataFrame:
    """The n flows with the highest packet rate, with display columns."""
    top = flows.orderBy(number_or_zero("flow_packets_s").desc(), *oldest_first()).limit(n)
    return top.select(
        "flow_id",
        endpoint("src_ip", "src_port").alias("source"),
        endpoint("dst_ip", "dst_port").alias("destination"),
        protocol_name_traffic("protocol").alias("protocol"),
        number_or_zero("flow_bytes_s").alias("bytes_per_sec"),
        number_or_zero("flow_packets_s").alias("packets_per_sec"),
        number_or_zero("flow_duration").alias("duration"),
        F.coalesce(F.col("ts"), F.localtimestamp()).alias("ts"),
    )


def duration_profile(flows: DataFrame, n: int = 100) -> DataFrame:
    """The n shortest flows numbered from 0; the window runs over those n rows only."""
    order = [F.col("flow_duration").asc_nulls_last(), F.col("flow_id").asc()]
    shortest = flows.orderBy(*order).limit(n)
    return shortest.select(
        (F.row_number().over(Window.orderBy(*order)) - 1).alias("flow_index"),
        F.col("flow_duration").alias("duration"),
        number_or_zero("flow_bytes_s").alias("bytes"),
        number_or_zero("flow_packets_s").alias("packets"),
        "flow_id",
    )


def last_points(flows: DataFrame, n: int = 100) -> DataFrame:
    """The newest n points of the rate series, oldest first; flows without a time are no points."""
    points = flows.where(F.col("ts").isNotNull()).select(
        "ts", "flow_id",
        number_or_zero("flow_bytes_s").alias("bytes"),
        number_or_zero("flow_packets_s").alias("packets"),
    )
    latest = points.orderBy(F.col("ts").desc(), F.col("flow_id").desc()).limit(n)
    return latest.orderBy("ts", "flow_id")
