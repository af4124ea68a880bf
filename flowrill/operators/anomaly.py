"""Attack statistics and suspicious patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowrill.functions.flow_text import (
    BENIGN,
    DOS,
    SCORED_LABELS,
    has_text,
    is_attack,
    label_or_benign,
)
from flowrill.functions.numbers import number_or_zero, whole_or_zero
from flowrill.operators.traffic import oldest_first

# The attack types counted by name.
ATTACK_TYPES = ["DDOS", "DOS", "PORT SCAN", "BRUTE FORCE"]

# Thresholds.
SCAN_FLAGS_ABOVE = 5
SYN_ABOVE, SYN_PER_ACK = 20, 3
RST_MEDIUM_ABOVE, RST_HIGH_ABOVE = 30, 100
RATE_MEDIUM_ABOVE, RATE_HIGH_ABOVE = 1000.0, 10000.0
COUNT_MEDIUM_ABOVE, COUNT_HIGH_ABOVE = 10, 100


def attack_rows(flows: DataFrame, n: int = 100) -> DataFrame:
    """The first n flows not labelled BENIGN."""
    return flows.where(is_attack("label")).orderBy(*oldest_first()).limit(n)


def potential_scans(flows: DataFrame, n: int = 50) -> DataFrame:
    """The first n flows with more than five SYN or RST flags."""
    many = (whole_or_zero("syn") > SCAN_FLAGS_ABOVE) | (whole_or_zero("rst") > SCAN_FLAGS_ABOVE)
    return flows.where(many).orderBy(*oldest_first()).limit(n)


def attacks_by_type(flows: DataFrame, normalize: bool = False) -> DataFrame:
    """Flows per named attack type, zeros included; no rows when there are no flows.

    Labels are compared exactly, so the scored label ``DoS`` is not ``DOS``; ``normalize`` compares
    in upper case instead.
    """
    label = F.upper("label") if normalize else F.col("label")
    counters = [F.count_if(label == t).alias(f"n{i}") for i, t in enumerate(ATTACK_TYPES)]
    row = flows.agg(F.count(F.lit(1)).alias("total"), *counters).where(F.col("total") > 0)
    pairs = [
        F.struct(F.lit(t).alias("attack_type"), F.col(f"n{i}").alias("attacks"))
        for i, t in enumerate(ATTACK_TYPES)
    ]
    return row.select(F.inline(F.array(*pairs)))


def suspicious_ips(flows: DataFrame) -> DataFrame:
    """Attacks per source."""
    return (
        flows.where(is_attack("label"))
        .groupBy(F.col("src_ip").alias("ip"))
        .agg(F.count(F.lit(1)).alias("attacks"))
    )


def severity(label: Column, count: Column) -> Column:
    by_count = (
        F.when(count > COUNT_HIGH_ABOVE, "high")
        .when(count > COUNT_MEDIUM_ABOVE, "medium")
        .otherwise("low")
    )
    # A type that never occurred keeps the level it started with.
    return F.when(label == BENIGN, "low").when(count == 0, "high").otherwise(by_count)


def attack_stats(flows: DataFrame) -> DataFrame:
    """Flows and severity of BENIGN and DoS; a missing label is read as BENIGN."""
    label = label_or_benign("label")
    row = flows.agg(
        F.count_if(label == BENIGN).alias("benign"), F.count_if(label == DOS).alias("dos")
    )
    pairs = F.array(
        F.struct(F.lit(BENIGN).alias("attack_type"), F.col("benign").alias("flows")),
        F.struct(F.lit(DOS).alias("attack_type"), F.col("dos").alias("flows")),
    )
    return row.select(F.inline(pairs)).withColumn(
        "severity", severity(F.col("attack_type"), F.col("flows"))
    )


def _label_ips(flows: DataFrame) -> DataFrame:
    """One row per flow endpoint with its label; role 0 is the source, 1 the destination."""
    label = label_or_benign("label")
    return (
        flows.where(label.isin(*SCORED_LABELS))
        .select(
            label.alias("attack_type"), "ts", "flow_id",
            F.inline(
                F.array(
                    F.struct(F.col("src_ip").alias("ip"), F.lit(0).alias("role")),
                    F.struct(F.col("dst_ip").alias("ip"), F.lit(1).alias("role")),
                )
            ),
        )
        .where(has_text("ip"))
    )


def attack_related_ips(flows: DataFrame) -> DataFrame:
    """Distinct source and destination addresses per label."""
    return _label_ips(flows).select("attack_type", "ip").distinct()


def related_ips_preview(flows: DataFrame, n: int = 50) -> DataFrame:
    """The n addresses seen first per label, each with the number of addresses not shown.

    Addresses are reduced to one row per label first; each task then keeps only its first n per
    label, so that a label is never ranked as a whole in one task.
    """
    first = (
        _label_ips(flows)
        .groupBy("attack_type", "ip")
        .agg(F.min(F.struct("ts", "flow_id", "role")).alias("first_seen"))
    )
    order = Window.partitionBy("attack_type").orderBy("first_seen")
    shown = first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
    totals = attack_related_ips(flows).groupBy("attack_type").agg(F.count(F.lit(1)).alias("total"))
    # At most one row per scored label on this side.
    return shown.join(F.broadcast(totals), "attack_type").select(
        "attack_type", "position", "ip",
        F.greatest(F.col("total") - n, F.lit(0)).alias("more"),
    )


def affected_ip_count(flows: DataFrame) -> DataFrame:
    """Distinct addresses over all labels, combined map-side before they are counted."""
    return (
        _label_ips(flows).select("ip").distinct().agg(F.count(F.lit(1)).alias("affected_ips"))
    )


def suspicious_patterns(flows: DataFrame) -> DataFrame:
    """SYN scans, RST floods and high flow rates per source, from one aggregation."""
    totals = (
        flows.where(has_text("src_ip"))
        .groupBy(F.col("src_ip").alias("ip"))
        .agg(
            F.sum(number_or_zero("syn")).cast("bigint").alias("syn"),
            F.sum(number_or_zero("ack")).cast("bigint").alias("ack"),
            F.sum(number_or_zero("rst")).cast("bigint").alias("rst"),
            F.sum(number_or_zero("flow_packets_s")).alias("rate"),
        )
    )
    return patterns_from_totals(totals)


def patterns_from_totals(totals: DataFrame, kept: list[str] = ()) -> DataFrame:
    """The three tests on per-source totals ``ip, syn, ack, rst, rate``; ``kept`` columns stay."""
    syn, ack, rst, rate = (F.col(c) for c in ("syn", "ack", "rst", "rate"))
    no_count, no_number = F.lit(None).cast("bigint"), F.lit(None).cast("double")

    def finding(test: Column, name: str, severity: Column, **shown: Column) -> Column:
        return F.when(
            test,
            F.struct(
                F.lit(name).alias("pattern"),
                severity.alias("severity"),
                shown.get("syn", no_count).alias("syn_count"),
                shown.get("ack", no_count).alias("ack_count"),
                shown.get("ratio", no_number).alias("ratio"),
                shown.get("rst", no_count).alias("rst_count"),
                shown.get("rate", no_number).alias("packets_per_sec"),
            ),
        )

    findings = F.array(
        finding(
            (syn > SYN_ABOVE) & (syn > ack * SYN_PER_ACK), "SYN Scan", F.lit("high"),
            syn=syn, ack=ack, ratio=F.round(syn / F.nullif(ack, F.lit(0)), 2),
        ),
        finding(
            rst > RST_MEDIUM_ABOVE, "RST Flood",
            F.when(rst > RST_HIGH_ABOVE, "high").otherwise("medium"), rst=rst,
        ),
        finding(
            rate > RATE_MEDIUM_ABOVE, "High Flow Rate",
            F.when(rate > RATE_HIGH_ABOVE, "high").otherwise("medium"), rate=F.round(rate, 2),
        ),
    )
    return totals.select(*kept, "ip", F.inline(F.filter(findings, lambda f: f.isNotNull())))
