"""All dashboard views over one snapshot of a day."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from flowrill.operators import anomaly, hosts, logs, summary, traffic

# What the views read; caching only these keeps the snapshot small.
VIEW_COLUMNS = [
    "flow_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "ts", "flow_duration",
    "total_fwd_packet", "total_bwd_packets", "total_length_fwd", "total_length_bwd",
    "flow_bytes_s", "flow_packets_s", "fin", "syn", "rst", "psh", "ack", "urg", "cwr", "ece",
    "active_mean", "idle_mean", "label",
]

VIEWS = {
    "network_summary": summary.network_summary_server,
    "protocol_counts": summary.protocol_counts,
    "protocol_distribution": summary.protocol_distribution,
    "label_counts": summary.label_counts,
    "machine_details": hosts.host_profile,
    "traffic_trend": traffic.traffic_trend,
    "traffic_spikes": traffic.traffic_spikes,
    "recent_connections": traffic.recent_flows,
    "top_connections": traffic.top_flows_by_bytes,
    "recent_rates": traffic.recent_rates,
    "attack_stats": anomaly.attack_stats,
    "attacks": anomaly.attack_rows,
    "attacks_by_type": anomaly.attacks_by_type,
    "suspicious_ips": anomaly.suspicious_ips,
    "potential_scans": anomaly.potential_scans,
    "suspicious_patterns": anomaly.suspicious_patterns,
    "connection_logs": logs.recent_log,
}

_FLOW = (["flow_id", "label"], ["flow_duration"])
# View name -> columns that name a row, and columns with numbers, for the long form.
VIEW_ITEMS: dict[str, tuple[list[str], list[str]]] = {
    "network_summary": ([], ["total_connections", "total_bytes", "total_packets", "attack_count"]),
    "protocol_counts": (["protocol"], ["flows"]),
    "protocol_distribution": (["protocol_name"], ["flows"]),
    "label_counts": (["label"], ["flows"]),
    "machine_details": (["ip"], [*hosts.TRAFFIC, *hosts.SERVER_FLAGS, "active_mean", "idle_mean"]),
    "traffic_trend": (["ts"], ["bytes", "packets"]),
    "traffic_spikes": (["ts"], ["packets", "percent_above_mean"]),
    "recent_connections": _FLOW,
    "top_connections": _FLOW,
    "recent_rates": ([], ["packet_rate", "byte_rate"]),
    "attack_stats": (["attack_type", "severity"], ["flows"]),
    "attacks": _FLOW,
    "attacks_by_type": (["attack_type"], ["attacks"]),
    "suspicious_ips": (["ip"], ["attacks"]),
    "potential_scans": (["flow_id"], ["syn", "rst"]),
    "suspicious_patterns": (["ip", "pattern", "severity"], ["syn_count", "ack_count", "ratio", "rst_count", "packets_per_sec"]),
    "connection_logs": _FLOW,
}


def digits(metric: str) -> int:
    return 7 if metric in ("packet_rate", "byte_rate") else 2


def digest(rows: DataFrame, *keys: str) -> DataFrame:
    """Numbers per view, and a checksum of them with their names that does not depend on order."""
    shown = F.concat_ws("|", "item", "metric", (F.col("value") * 100).cast("decimal(38,0)").cast("string"))
    number = F.conv(F.substring(F.md5(shown), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*keys, "view").agg(
        F.count(F.lit(1)).alias("numbers"), F.sum(number).cast("string").alias("checksum")
    )


def long_form(views: dict[str, DataFrame], *kept: str) -> DataFrame:
    """Rows of several views as ``view, item, metric, value``, a row per number, after ``kept`` columns.

    Numbers are rounded, sums to two digits and means to seven: sums of floating-point numbers
    depend on their order.
    """
    frames = []
    for name, df in views.items():
        items, metrics = VIEW_ITEMS[name]
        item = F.concat_ws("|", *[F.col(c).cast("string") for c in items]) if items else F.lit("")
        pairs = [
            F.struct(F.lit(m).alias("metric"), F.round(F.col(m).cast("double"), digits(m)).alias("value")) for m in metrics
        ]
        frames.append(df.select(*kept, F.lit(name).alias("view"), item.alias("item"), F.inline(F.array(*pairs))))
    return reduce(DataFrame.unionByName, frames)


class DaySnapshot:
    """Every view computed from the same rows, however often the day table changes meanwhile.

    The day's needed columns are cached once (spilling to disk); views are lazy, so only those
    that are used run. Use as a context manager, or call :meth:`close`.
    """

    def __init__(self, flows: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.flows = flows.select(*[c for c in VIEW_COLUMNS if c in flows.columns]).persist(level)

    def view(self, name: str) -> DataFrame:
        return VIEWS[name](self.flows)

    def all(self) -> dict[str, DataFrame]:
        return {name: self.view(name) for name in VIEWS}

    def row_counts(self) -> DataFrame:
        """Rows per view, as one table."""
        frames = [
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("view"), "n_rows")
            for name, df in self.all().items()
        ]
        result = frames[0]
        for frame in frames[1:]:
            result = result.unionByName(frame)
        return result

    def contents(self) -> DataFrame:
        """Every number of every view, in the long form."""
        return long_form(self.all())

    def close(self) -> None:
        self.flows.unpersist()

    def __enter__(self) -> DaySnapshot:
        return self

    def __exit__(self, *exc) -> None:
        self.close()
