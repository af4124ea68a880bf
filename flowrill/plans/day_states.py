"""Mergeable states of the dashboard views, grouped by day.

A state is what a view needs to know of a day's flows: sums, maxima, distinct connections, or the
first rows of an order. States of two sets of flows merge into the state of their union, in any
order, so late flows count like others and new flows never make old ones be read again. Every
function here handles all days of its input at once; flows without a day are in no day's view.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowrill.functions.flow_text import has_text, is_attack, label_or_benign, protocol_name_summary
from flowrill.functions.numbers import number_or_zero, round_half_up, whole_or_zero
from flowrill.operators import anomaly, hosts, summary, traffic
from flowrill.plans.views import VIEW_COLUMNS

DAY = "flow_date"
RECENT, LOG, LARGEST, ATTACKS, SCANS = 100, 1000, 10, 100, 50

# State name -> key columns besides the day, summed columns, columns of which the maximum counts.
SUMMED: dict[str, tuple[list[str], list[str], list[str]]] = {
    "connections": (["src_ip", "src_port", "dst_ip", "dst_port"], ["bytes", "packets", "attacks"], []),
    "kinds": (["protocol", "label"], ["n"], []),
    "hosts": (["ip"], [*hosts.TRAFFIC, *hosts.SERVER_FLAGS], ["seen"]),
    "sources": (["ip"], ["attacks", "syn", "ack", "rst", "rate"], []),
    "points": (["ts"], ["bytes", "packets"], []),
}


def _many() -> Column:
    return (whole_or_zero("syn") > anomaly.SCAN_FLAGS_ABOVE) | (whole_or_zero("rst") > anomaly.SCAN_FLAGS_ABOVE)


# State name -> which flows, in which order, how many of a day.
FIRST_ROWS: dict[str, tuple[Callable[[], Column], Callable[[], list[Column]], int]] = {
    "newest": (lambda: F.lit(True), traffic.newest_first, LOG),
    "largest": (
        lambda: F.lit(True), lambda: [number_or_zero("flow_bytes_s").desc(), *traffic.oldest_first()], LARGEST,
    ),
    "attack_rows": (lambda: is_attack("label"), traffic.oldest_first, ATTACKS),
    "scan_rows": (_many, traffic.oldest_first, SCANS),
}
STATES = [*SUMMED, *FIRST_ROWS]


def _first(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of every day; a task keeps its own n of each before the exchange."""
    place = F.row_number().over(Window.partitionBy(DAY).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n).drop("place")


def with_day(flows: DataFrame) -> DataFrame:
    """What the views read, with the day; flows without a day are left out."""
    columns = [c for c in VIEW_COLUMNS if c in flows.columns]
    day = F.col(DAY) if DAY in flows.columns else F.col("ts").cast("date")
    return flows.select(day.alias(DAY), *columns).where(F.col(DAY).isNotNull())


def state_of(flows: DataFrame, name: str) -> DataFrame:
    """One state of the flows, by day."""
    return merged(state_rows(flows, name), name)


def state_rows(flows: DataFrame, name: str) -> DataFrame:
    """The flows as rows of a state, not merged yet, so that one exchange merges them with older states."""
    rows = with_day(flows)
    if name in FIRST_ROWS:
        return rows.where(FIRST_ROWS[name][0]())
    keys = SUMMED[name][0]
    rates = [number_or_zero("flow_bytes_s").alias("bytes"), number_or_zero("flow_packets_s").alias("packets")]
    if name == "connections":
        return rows.select(DAY, *keys, *rates, is_attack("label").cast("bigint").alias("attacks"))
    if name == "kinds":
        return rows.select(DAY, *keys, F.lit(1).cast("bigint").alias("n"))
    if name == "points":
        return rows.select(DAY, *keys, *rates)
    if name == "sources":
        return rows.select(
            DAY, F.col("src_ip").alias("ip"), is_attack("label").cast("bigint").alias("attacks"),
            *[number_or_zero(c).alias(c) for c in ("syn", "ack", "rst")],
            number_or_zero("flow_packets_s").alias("rate"),
        )
    return hosts.profile_roles(rows, [F.col(DAY)])


def merged(states: DataFrame, name: str) -> DataFrame:
    """The state of several ones, given as their rows together."""
    if name in FIRST_ROWS:
        _, order, n = FIRST_ROWS[name]
        return _first(states, order(), n)
    keys, sums, maxima = SUMMED[name]
    return states.groupBy(DAY, *keys).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima]
    )


def _counted(kinds: DataFrame, name: str, tests: list[tuple[str, Column]], value: str) -> DataFrame:
    """A row for each day and named test with the number of flows it holds for, zeros included."""
    row = kinds.groupBy(DAY).agg(
        *[F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, (_, test) in enumerate(tests)]
    )
    pairs = [F.struct(F.lit(shown).alias(name), F.col(f"n{i}").alias(value)) for i, (shown, _) in enumerate(tests)]
    return row.select(DAY, F.inline(F.array(*pairs)))


def _spikes(points: DataFrame) -> DataFrame:
    stats = points.groupBy(DAY).agg(
        F.avg("packets").alias("mean"), F.stddev_pop("packets").alias("deviation"), F.count(F.lit(1)).alias("points")
    )
    above = round_half_up((F.col("packets") - F.col("mean")) / F.nullif(F.col("mean"), F.lit(0.0)) * 100)
    return (
        points.join(stats, DAY).where("points >= 2 and packets > mean + 2 * deviation")
        .select(DAY, "ts", "packets", above.alias("percent_above_mean"))
    )


def _network(connections: DataFrame) -> DataFrame:
    return connections.groupBy(DAY).agg(
        F.count(F.lit(1)).alias("total_connections"), F.sum("bytes").alias("total_bytes"),
        F.sum("packets").alias("total_packets"), F.sum("attacks").alias("attack_count"),
    )


def _rates(newest: DataFrame) -> DataFrame:
    return _first(newest, traffic.newest_first(), RECENT).groupBy(DAY).agg(
        F.avg(number_or_zero("flow_packets_s")).alias("packet_rate"),
        F.avg(number_or_zero("flow_bytes_s")).alias("byte_rate"),
    )


def _patterns(sources: DataFrame) -> DataFrame:
    totals = sources.where(has_text("ip")).withColumns({c: F.col(c).cast("bigint") for c in ("syn", "ack", "rst")})
    return anomaly.patterns_from_totals(totals, [DAY])


def _label_tests(label: Column, names: list[str]) -> list[tuple[str, Column]]:
    return [(name, label == name) for name in names]


# View name -> the state it is made of, and how.
DAY_VIEWS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "network_summary": ("connections", _network),
    "protocol_counts": ("kinds", lambda s: s.groupBy(DAY, "protocol").agg(F.sum("n").alias("flows"))),
    "protocol_distribution": (
        "kinds",
        lambda s: _counted(s, "protocol_name", _label_tests(protocol_name_summary("protocol"), summary.PROTOCOL_BUCKETS), "flows"),
    ),
    "label_counts": ("kinds", lambda s: _counted(s, "label", _label_tests(F.col("label"), summary.SCORED_LABELS), "flows")),
    "machine_details": (
        "hosts",
        lambda s: s.select(DAY, "ip", *hosts.TRAFFIC, *hosts.SERVER_FLAGS, "seen.active_mean", "seen.idle_mean"),
    ),
    "traffic_trend": ("points", lambda s: s.select(DAY, "ts", "bytes", "packets")),
    "traffic_spikes": ("points", _spikes),
    "recent_connections": ("newest", lambda s: _first(s, traffic.newest_first(), RECENT)),
    "top_connections": ("largest", lambda s: s),
    "recent_rates": ("newest", _rates),
    "attack_stats": (
        "kinds",
        lambda s: _counted(s, "attack_type", _label_tests(label_or_benign("label"), anomaly.SCORED_LABELS), "flows")
        .withColumn("severity", anomaly.severity(F.col("attack_type"), F.col("flows"))),
    ),
    "attacks": ("attack_rows", lambda s: s),
    "attacks_by_type": ("kinds", lambda s: _counted(s, "attack_type", _label_tests(F.col("label"), anomaly.ATTACK_TYPES), "attacks")),
    "suspicious_ips": ("sources", lambda s: s.where("attacks > 0").select(DAY, "ip", "attacks")),
    "potential_scans": ("scan_rows", lambda s: s),
    "suspicious_patterns": ("sources", _patterns),
    "connection_logs": ("newest", lambda s: s),
}


def day_view(states: dict[str, DataFrame], name: str) -> DataFrame:
    """One view of every day, from its state."""
    state, view = DAY_VIEWS[name]
    return view(states[state])
