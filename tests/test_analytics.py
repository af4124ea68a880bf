"""Rules of the analytics operators on hand-made rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from flowrill.functions import flow_text as text
from flowrill.operators import anomaly, hosts, logs, summary, traffic
from flowrill.plans.views import DaySnapshot
from flowrill.sources.day_store import current_day_flows, flows_for_date, stored_flows_for_date, write_analysed

INF, NAN = float("inf"), float("nan")


def rows(df):
    return [r.asDict() for r in df.collect()]


def one(df):
    found = rows(df)
    assert len(found) == 1
    return found[0]


def test_server_summary_counts_distinct_connections_and_missing_labels(make_flows):
    flows = make_flows(
        {"label": None}, {"label": "DDOS"}, {"label": "BENIGN", "dst_port": 81},
        {"flow_bytes_s": INF}, {"flow_bytes_s": NAN}, {"flow_bytes_s": None, "src_ip": None},
    )
    result = one(summary.network_summary_server(flows))
    assert result == {
        "total_connections": 3, "total_bytes": 30.0, "total_packets": 6.0, "attack_count": 2,
    }
    assert one(summary.network_summary_client(flows))["total_connections"] == 6


def test_closed_counts_are_zero_filled_and_skip_unknown_labels(make_flows):
    flows = make_flows({"label": None}, {"label": "DDOS"}, {"protocol": 17}, {"protocol": 99})
    assert {r["label"]: r["flows"] for r in rows(summary.label_counts(flows))} == {"BENIGN": 2, "DoS": 0}
    by_protocol = {r["protocol_name"]: r["flows"] for r in rows(summary.protocol_distribution(flows))}
    assert by_protocol == {"TCP": 2, "UDP": 1, "ICMP": 0, "OTHER": 1}
    assert sum(by_protocol.values()) == flows.count()
    assert one(summary.attack_total(flows))["attacks"] == 0


def test_shares_hide_small_slices(make_flows):
    flows = make_flows(*[{"label": "DoS" if i < 2 else "BENIGN"} for i in range(100)])
    shown = {(r["distribution"], r["name"]): r["percent"] for r in rows(summary.distribution_share(flows))}
    assert shown == {("protocol", "TCP"): 100.0, ("label", "BENIGN"): 98.0}


def test_empty_table_gives_zeros_and_no_rows(make_flows):
    flows = make_flows({}).where("false")
    assert set(one(summary.network_summary_server(flows)).values()) == {0}
    assert set(one(summary.network_summary_client(flows)).values()) == {0}
    assert set(one(traffic.recent_rates(flows)).values()) == {0.0}
    for empty in (
        anomaly.attacks_by_type(flows), anomaly.suspicious_ips(flows), hosts.host_traffic(flows),
        traffic.traffic_spikes(flows), logs.recent_log(flows), summary.distribution_share(flows),
        anomaly.related_ips_preview(flows), hosts.host_activity_ema(flows),
    ):
        assert rows(empty) == []


@pytest.mark.parametrize(
    "dos, severity", [(0, "high"), (1, "low"), (10, "low"), (11, "medium"), (100, "medium"), (101, "high")]
)
def test_severity_thresholds(make_flows, dos, severity):
    flows = make_flows({"label": None}, *[{"label": "DoS"}] * dos)
    stats = {r["attack_type"]: (r["flows"], r["severity"]) for r in rows(anomaly.attack_stats(flows))}
    assert stats == {"BENIGN": (1, "low"), "DoS": (dos, severity)}


def test_attack_types_match_exactly_unless_normalized(make_flows):
    flows = make_flows({"label": "DoS"}, {"label": "DOS"}, {"label": "PORT SCAN"})
    exact = {r["attack_type"]: r["attacks"] for r in rows(anomaly.attacks_by_type(flows))}
    assert exact == {"DDOS": 0, "DOS": 1, "PORT SCAN": 1, "BRUTE FORCE": 0}
    loose = {r["attack_type"]: r["attacks"] for r in rows(anomaly.attacks_by_type(flows, normalize=True))}
    assert loose["DOS"] == 2


def test_suspicious_pattern_thresholds(make_flows):
    flows = make_flows(
        {"src_ip": "a", "syn": 20}, {"src_ip": "b", "syn": 21}, {"src_ip": "c", "syn": 30, "ack": 10},
        {"src_ip": "d", "syn": 31, "ack": 10}, {"src_ip": "e", "rst": 30}, {"src_ip": "f", "rst": 31},
        {"src_ip": "g", "rst": 101}, {"src_ip": "h", "rst": 100}, {"src_ip": "i", "flow_packets_s": 1000.0},
        {"src_ip": "j", "flow_packets_s": 1000.01}, {"src_ip": "k", "flow_packets_s": 10000.01},
        {"src_ip": "l", "flow_packets_s": 10000.0}, {"src_ip": None, "syn": 99}, {"src_ip": "", "syn": 99},
        {"src_ip": "m", "syn": 50, "rst": 40},
    )
    found = {(r["ip"], r["pattern"]): r for r in rows(anomaly.suspicious_patterns(flows))}
    assert {k: v["severity"] for k, v in found.items()} == {
        ("b", "SYN Scan"): "high", ("d", "SYN Scan"): "high", ("f", "RST Flood"): "medium",
        ("g", "RST Flood"): "high", ("h", "RST Flood"): "medium", ("j", "High Flow Rate"): "medium",
        ("k", "High Flow Rate"): "high", ("l", "High Flow Rate"): "medium",
        ("m", "SYN Scan"): "high", ("m", "RST Flood"): "medium",
    }
    assert found["b", "SYN Scan"]["ratio"] is None and found["d", "SYN Scan"]["ratio"] == 3.1


def test_scans_look_at_whole_flags(make_flows):
    flows = make_flows({"syn": 5, "rst": 5}, {"syn": 6}, {"rst": 6}, {"syn": None})
    assert [r["flow_id"] for r in rows(anomaly.potential_scans(flows))] == ["f0001", "f0002"]


def test_related_ips_in_order_of_first_sight(make_flows):
    flows = make_flows(
        {"src_ip": "s1", "dst_ip": "d1", "ts": "2024-01-01T00:00:02"},
        {"src_ip": "s2", "dst_ip": "s1", "ts": "2024-01-01T00:00:01", "label": ""},
        {"src_ip": None, "dst_ip": "d2", "ts": "2024-01-01T00:00:03"},
        {"src_ip": "x", "dst_ip": "y", "label": "PortScan"},
    )
    shown = rows(anomaly.related_ips_preview(flows, n=3))
    assert [r["ip"] for r in sorted(shown, key=lambda r: r["position"])] == ["s2", "s1", "d1"]
    assert {r["more"] for r in shown} == {1}
    assert one(anomaly.affected_ip_count(flows))["affected_ips"] == 4


def test_self_loop_host_counts_flags_twice_only_on_the_server_rule(make_flows):
    flows = make_flows({"src_ip": "h", "dst_ip": "h", "syn": 3, "active_mean": 4.0})
    both = one(hosts.host_flags_both(flows))
    source = one(hosts.host_flags_source(flows))
    volume = one(hosts.host_traffic(flows))
    assert (both["syn"], source["syn"]) == (6, 3)
    assert volume == {
        "ip": "h", "sent_bytes": 100.0, "received_bytes": 50.0, "sent_packets": 1.0,
        "received_packets": 1.0, "outbound_connections": 1, "inbound_connections": 1,
    }
    assert one(hosts.host_profile(flows))["active_mean"] == 4.0


def test_hosts_skip_missing_addresses_per_side(make_flows):
    flows = make_flows({"src_ip": None}, {"dst_ip": ""})
    found = {r["ip"]: (r["outbound_connections"], r["inbound_connections"]) for r in rows(hosts.host_traffic(flows))}
    assert found == {"2.2.2.2": (0, 1), "1.1.1.1": (1, 0)}
    zeros = {r["ip"]: r["syn"] for r in rows(hosts.host_flags_source(flows))}
    assert zeros == {"2.2.2.2": 0, "1.1.1.1": 0}
    assert rows(hosts.host_by_ip(flows, "8.8.8.8")) == []


def test_destination_ties_go_to_the_first_seen(make_flows):
    names = ["z", "y", "x", "w", "v", "u"]
    flows = make_flows(
        *[{"dst_ip": d, "ts": f"2024-01-01T00:00:{i:02d}"} for i, d in enumerate(names)],
        {"dst_ip": "u", "ts": "2024-01-01T00:01:00"},
    )
    top = sorted(rows(hosts.host_top_destinations(flows)), key=lambda r: r["rank"])
    assert [(r["destination"], r["connections"]) for r in top] == [
        ("u", 2), ("z", 1), ("y", 1), ("x", 1), ("w", 1)
    ]
    nested = one(hosts.nested_destinations(flows, 2))["common_destinations"]
    assert [(d["ip"], d["count"]) for d in nested] == [("u", 2), ("z", 1)]


def test_halving_mean_equals_the_recurrence_over_many_partitions(make_flows, spark):
    values = [float((i * 37) % 101) for i in range(2500)]
    flows = make_flows(
        *[{"active_mean": v, "idle_mean": v / 3} for v in values], {"src_ip": "other", "active_mean": 8.0}
    ).repartition(13)
    mean = 0.0
    for v in values:
        mean = (mean + v) / 2
    found = {r["ip"]: r for r in rows(hosts.host_activity_ema(flows, "minute"))}
    assert math.isclose(found["1.1.1.1"]["active_mean"], mean, rel_tol=1e-12)
    assert found["other"]["active_mean"] == 4.0


def test_last_activity_takes_the_newest_flow_of_either_role(make_flows):
    flows = make_flows(
        {"active_mean": 1.0, "ts": "2024-01-01T00:00:05"},
        {"src_ip": "q", "dst_ip": "1.1.1.1", "active_mean": 7.0, "ts": "2024-01-01T00:00:06"},
    )
    found = {r["ip"]: r["active_mean"] for r in rows(hosts.host_last_activity(flows))}
    assert found == {"1.1.1.1": 7.0, "2.2.2.2": 1.0, "q": 7.0}


def test_hosts_sorted_checks_its_field(make_flows):
    table = hosts.host_traffic(make_flows({}, {"src_ip": "b", "total_length_fwd": 500.0}))
    assert [r["ip"] for r in rows(hosts.hosts_sorted(table, "sent_bytes", "desc"))][0] == "b"
    with pytest.raises(ValueError):
        hosts.hosts_sorted(table, "no_such_field")


def test_top_flow_of_a_timestamp_is_the_later_of_equals(make_flows):
    flows = make_flows({"flow_bytes_s": 5.0}, {"flow_bytes_s": 9.0}, {"flow_bytes_s": 9.0}, {"flow_bytes_s": INF})
    assert one(traffic.trend_top_flow(flows))["top_flow_id"] == "f0002"


def test_spikes_use_the_population_deviation(make_flows):
    def at(minute, packets):
        return {"ts": f"2024-01-01T00:{minute:02d}:00", "flow_packets_s": packets}

    calm = [at(i, 10.0) for i in range(9)]
    found = one(traffic.traffic_spikes(make_flows(*calm, at(9, 110.0))))
    assert (found["packets"], found["percent_above_mean"]) == (110.0, 450)
    assert rows(traffic.traffic_spikes(make_flows(at(0, 500.0)))) == []


def test_recent_and_last_points(make_flows):
    flows = make_flows(
        *[{"ts": f"2024-01-01T00:00:{i % 3:02d}", "flow_packets_s": float(i)} for i in range(9)], {"ts": None}
    )
    assert [r["flow_id"] for r in rows(traffic.recent_flows(flows, 3))] == ["f0002", "f0005", "f0008"]
    assert [r["flow_id"] for r in rows(traffic.last_points(flows, 4))] == ["f0007", "f0002", "f0005", "f0008"]
    assert one(traffic.recent_rates(flows, 3))["packet_rate"] == 5.0
    assert [r["flow_index"] for r in rows(traffic.duration_profile(flows, 3))] == [0, 1, 2]


def test_log_filters(make_flows):
    flows = make_flows({"label": "DoS"}, {"label": None}, {"protocol": 99}, {"src_ip": "1.99.0.1"})
    assert len(rows(logs.log_filter_any(logs.recent_log(flows), "99"))) == 2
    assert len(rows(logs.log_filter_any(flows, "dos"))) == 0
    assert len(rows(logs.log_filter_field(flows, "label", "dos"))) == 1
    assert len(rows(logs.log_filter_field(flows, "protocol", "PROTOCOL 9"))) == 1
    assert len(rows(logs.log_filter_field(flows, "protocol", ""))) == 4


def test_log_pages(make_flows):
    flows = make_flows(*[{"ts": f"2024-01-01T00:00:{i:02d}"} for i in range(35)])
    page = rows(logs.log_page_client(flows, page=3, size=15))
    assert len(page) == 5 and {(r["total"], r["total_pages"]) for r in page} == {(35, 3)}
    assert page[-1]["flow_id"] == "f0000"
    server = rows(logs.log_page_server(flows, page=2, limit=20))
    assert [r["position"] for r in sorted(server, key=lambda r: r["position"])] == list(range(21, 36))
    shown = rows(logs.log_display(logs.log_page_client(flows, page=1)))
    assert shown[0]["source"] == "1.1.1.1:1000" and shown[0]["is_attack"] is False


def test_timestamps(spark):
    cases = {
        "15/01/2024 12:00:00 AM": "2024-01-15 00:00:00",
        "15/01/2024 12:00:00 PM": "2024-01-15 12:00:00",
        "5/1/2024 1:02:03 pm": "2024-01-05 13:02:03",
        "31/12/2023 13:05:00 PM": "2023-12-31 13:05:00",
        "2024-01-15 10:20:30": "2024-01-15 10:20:30",
        "junk": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    found = {r["t"]: r["p"] for r in df.select("t", text.parse_flow_timestamp("t").cast("string").alias("p")).collect()}
    assert found == cases
    shown = {r["t"]: r["p"] for r in df.select("t", text.time_text("t").alias("p")).collect()}
    assert shown["junk"] == "junk" and shown["15/01/2024 12:00:00 PM"] == "2024-01-15 12:00:00"


def test_protocol_names(spark):
    df = spark.createDataFrame([("6",), ("tcp",), ("Icmp",), ("47",), (None,)], "p string")
    found = [r[0] for r in df.select(text.protocol_text_summary("p")).collect()]
    assert found == ["TCP", "TCP", "ICMP", "OTHER", "OTHER"]


def test_one_day_and_missing_day(make_flows, tmp_path, spark):
    flows = make_flows({"ts": "2024-01-15T23:59:59"}, {"ts": "2024-01-16T00:00:00"}, {"ts": None})
    assert [r["flow_id"] for r in rows(flows_for_date(flows, "2024-01-15"))] == ["f0000"]
    assert rows(current_day_flows(flows, "2030-01-01")) == []
    write_analysed(flows, str(tmp_path / "store"))
    schema = spark.read.parquet(str(tmp_path / "store")).schema
    day = stored_flows_for_date(spark, str(tmp_path / "store"), "2024-01-16", schema)
    assert [r["flow_id"] for r in rows(day)] == ["f0001"]
    assert "PartitionFilters: [isnotnull(flow_date" in day._jdf.queryExecution().toString()
    assert rows(stored_flows_for_date(spark, str(tmp_path / "none"), "2024-01-16", schema)) == []


def test_day_snapshot_offers_every_view(make_flows):
    with DaySnapshot(make_flows({}, {"label": "DoS"})) as snapshot:
        counts = {r["view"]: r["n_rows"] for r in rows(snapshot.row_counts())}
    assert counts["network_summary"] == 1 and counts["connection_logs"] == 2
    assert counts["attacks"] == 1


def test_halving_mean_counts_every_flow(make_flows):
    """Old values count however many newer ones there are, as far as doubles go."""
    start = "2024-01-15T%02d:%02d:%02d"
    times = [start % (i // 3600, i // 60 % 60, i % 60) for i in range(1060)]
    flows = make_flows(*[{"active_mean": 0.0 if i else 1e300, "ts": t} for i, t in enumerate(times)])
    for unit in ("minute", "hour", "day"):
        assert math.isclose(rows(hosts.host_activity_ema(flows, unit))[0]["active_mean"], 1e300 * 2.0**-1060, rel_tol=1e-9)


def test_hot_source_is_pruned_before_the_shuffle(make_flows):
    plan = hosts.host_top_destinations(make_flows({}))._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.count("WindowGroupLimit") == 2


def test_filters_reach_the_scan(spark, sf_dir):
    from flowrill.sources.driver_tables import flows_from_tables

    day = flows_for_date(flows_from_tables(spark, sf_dir), "1998-09-24").select("flow_id")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan
    assert "l_extendedprice" not in plan
