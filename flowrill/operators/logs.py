"""Searchable, sortable, paged connection log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from flowrill.functions.flow_text import endpoint, is_attack, protocol_name_log
from flowrill.functions.numbers import number_or_zero, round_half_up
from flowrill.operators.traffic import newest_first, oldest_first

# Fields a text filter may look at.
FILTER_FIELDS = ["label", "src_ip", "dst_ip", "protocol"]


def recent_log(flows: DataFrame, n: int = 1000) -> DataFrame:
    """The n newest flows."""
    return flows.orderBy(*newest_first()).limit(n)


def log_filter_any(log: DataFrame, text: str) -> DataFrame:
    """Rows whose source, destination, protocol number or label contains the text (case counts)."""
    if not text:
        return log
    hits = [
        F.coalesce(F.col(c).cast("string"), F.lit("")).contains(text)
        for c in ("src_ip", "dst_ip", "protocol", "label")
    ]
    return log.where(hits[0] | hits[1] | hits[2] | hits[3])


def log_filter_field(flows: DataFrame, field: str, text: str) -> DataFrame:
    """Rows whose field contains the text in any case; the protocol is compared by its name."""
    if not text:
        return flows
    if field not in flows.columns:
        raise ValueError(f"unknown log field {field!r}")
    value = protocol_name_log(field) if field == "protocol" else F.col(field).cast("string")
    return flows.where(F.lower(value).contains(text.lower()))


def log_order(flows: DataFrame, field: str, direction: str = "desc") -> list[Column]:
    """Sort keys: numbers and times by value, text without regard to case, ties in flow order."""
    if field not in flows.columns:
        raise ValueError(f"unknown log field {field!r}")
    if direction not in ("asc", "desc"):
        raise ValueError(f"unknown direction {direction!r}")
    is_text = isinstance(flows.schema[field].dataType, T.StringType)
    key = F.lower(F.coalesce(F.col(field), F.lit(""))) if is_text else F.col(field)
    first = key.asc_nulls_last() if direction == "asc" else key.desc_nulls_last()
    return [first, *oldest_first()]


def log_sorted(flows: DataFrame, field: str, direction: str = "desc") -> DataFrame:
    return flows.orderBy(*log_order(flows, field, direction))


def log_page_server(flows: DataFrame, page: int = 1, limit: int = 100, text: str = "") -> DataFrame:
    """One page of the filtered 1000-row log, with total, page and limit on every row.

    The window runs over the 1000-row log only.
    """
    matching = log_filter_any(recent_log(flows), text)
    numbered = matching.select(
        "*",
        F.row_number().over(Window.orderBy(*newest_first())).alias("position"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("total"),
    )
    start = (page - 1) * limit
    return numbered.where((F.col("position") > start) & (F.col("position") <= start + limit)).select(
        *flows.columns, "position", "total", F.lit(page).alias("page"), F.lit(limit).alias("page_limit")
    )


def log_page_client(
    flows: DataFrame,
    page: int = 1,
    size: int = 15,
    sort_field: str = "ts",
    direction: str = "desc",
    filter_field: str = "label",
    text: str = "",
) -> DataFrame:
    """One page of all filtered and sorted flows, with the number of matches and of pages.

    Each task keeps the rows up to the end of the page, so early pages cost one pass and no sort of
    the table.
    """
    matching = log_filter_field(flows, filter_field, text)
    totals = matching.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(size)).cast("bigint").alias("total_pages")
    )
    rows = (
        matching.orderBy(*log_order(matching, sort_field, direction))
        .offset((page - 1) * size)
        .limit(size)
    )
    return rows.crossJoin(F.broadcast(totals))  # one row


def log_display(rows: DataFrame) -> DataFrame:
    """Display columns of log rows, keeping any page columns."""
    extra = [c for c in ("total", "total_pages") if c in rows.columns]
    return rows.select(
        "flow_id",
        endpoint("src_ip", "src_port").alias("source"),
        endpoint("dst_ip", "dst_port").alias("destination"),
        protocol_name_log("protocol").alias("protocol"),
        F.col("flow_duration").alias("duration"),
        round_half_up(number_or_zero("flow_bytes_s")).alias("bytes_per_sec"),
        round_half_up(number_or_zero("flow_packets_s")).alias("packets_per_sec"),
        "ts",
        "label",
        is_attack("label").alias("is_attack"),
        *extra,
    )
