"""SQL counterparts of all views in their long form, for one set of flows or for each day of them."""

from __future__ import annotations

from flowrill.operators.hosts import SERVER_FLAGS, TRAFFIC
from flowrill.plans.views import digits


def _num(column: str) -> str:
    return f"(case when abs({column}) < 'Infinity'::double then {column} else 0.0 end)"


_BYTES, _PACKETS = _num("flow_bytes_s"), _num("flow_packets_s")
_ATTACK = "(label is distinct from 'BENIGN')"
_READ_LABEL = "(case when label is null or label = '' then 'BENIGN' else label end)"
_NEWEST, _OLDEST = "ts desc nulls last, flow_id", "ts asc nulls last, flow_id"
_PROTOCOL = {"TCP": "protocol = 6", "UDP": "protocol = 17", "ICMP": "protocol = 1", "OTHER": "protocol not in (1, 6, 17) or protocol is null"}


def views_sql(flows: str, by_day: bool) -> str:
    """A select over the CTE ``flows``; with ``by_day`` its first column is ``flow_date``."""
    day = "flow_date, " if by_day else ""
    own = "group by flow_date" if by_day else ""
    part = "partition by flow_date" if by_day else ""
    same = "and a.flow_date = b.flow_date" if by_day else ""

    def rows(view: str, item: str, metrics: dict[str, str], source: str) -> str:
        names = ", ".join(f"'{m}'" for m in metrics)
        values = ", ".join(f"round(cast({v} as double), {digits(m)})" for m, v in metrics.items())
        return f"select {day}'{view}' as view, {item} as item, unnest([{names}]) as metric, unnest([{values}]) as value from {source}"

    def counted(view: str, tests: dict[str, str], metric: str, source: str = flows, having: str = "") -> str:
        items = ", ".join(f"'{k}'" for k in tests)
        values = ", ".join(f"cast(count(*) filter (where {t}) as double)" for t in tests.values())
        return (
            f"select {day}'{view}' as view, unnest([{items}]) as item, '{metric}' as metric, "
            f"unnest([{values}]) as value from {source} {own} {having}"
        )

    def ranked(order: str, n: int, where: str = "true") -> str:
        return (
            f"(select * from (select *, row_number() over ({part} order by {order}) as place "
            f"from {flows} where {where}) where place <= {n})"
        )

    def flow_rows(view: str, order: str, n: int, where: str = "true") -> str:
        return rows(view, "concat_ws('|', flow_id, label)", {"flow_duration": "flow_duration"}, ranked(order, n, where))

    severity = (
        "case when kind = 'BENIGN' then 'low' when n = 0 then 'high' when n > 100 then 'high' "
        "when n > 10 then 'medium' else 'low' end"
    )
    labels = ", ".join(f"count(*) filter (where {_READ_LABEL} = '{k}')" for k in ("BENIGN", "DoS"))
    roles = (
        f"(select src_ip as ip, 0 as role, * from {flows} union all select dst_ip, 1, * from {flows})"
    )
    traffic = {
        "sent_bytes": f"sum(case role when 0 then {_num('total_length_fwd')} else 0 end)",
        "received_bytes": f"sum(case role when 1 then {_num('total_length_bwd')} else 0 end)",
        "sent_packets": "sum(case role when 0 then total_fwd_packet else 0 end)",
        "received_packets": "sum(case role when 1 then total_bwd_packets else 0 end)",
        "outbound_connections": "count(*) filter (where role = 0)",
        "inbound_connections": "count(*) filter (where role = 1)",
    }
    machine = {name: traffic[name] for name in TRAFFIC} | {c: f"sum({c})" for c in SERVER_FLAGS}
    last = "partition by " + day + "ip order by ts desc, flow_id desc"
    hosts = (
        f"(select {day}ip, " + ", ".join(f"{v} as {k}" for k, v in machine.items())
        + f", max(active_mean) filter (where latest = 1) as active_mean, max(idle_mean) filter (where latest = 1) as idle_mean "
        f"from (select *, row_number() over ({last}) as latest from {roles}) group by {day}ip)"
    )
    trend = f"(select {day}ts, sum({_BYTES}) as bytes, sum({_PACKETS}) as packets from {flows} group by {day}ts)"
    stats = f"(select {day}avg(packets) as mean, stddev_pop(packets) as deviation, count(*) as points from {trend} {own})"
    spikes = f"(select a.*, mean from {trend} a join {stats} b on points >= 2 and packets > mean + 2 * deviation {same})"
    sources = (
        f"(select {day}src_ip as ip, sum(syn) as syn, sum(ack) as ack, sum(rst) as rst, sum({_PACKETS}) as rate "
        f"from {flows} group by {day}src_ip)"
    )

    def pattern(name: str, level: str, where: str, **shown: str) -> str:
        names = ["syn_count", "ack_count", "ratio", "rst_count", "packets_per_sec"]
        return rows(
            "suspicious_patterns", f"concat_ws('|', ip, '{name}', {level})",
            {m: shown.get(m, "null") for m in names}, f"(select * from {sources} where {where})",
        )

    parts = [
        rows(
            "network_summary", "''",
            {
                "total_connections": "count(distinct concat(src_ip, ':', src_port, '-', dst_ip, ':', dst_port))",
                "total_bytes": f"coalesce(sum({_BYTES}), 0)", "total_packets": f"coalesce(sum({_PACKETS}), 0)",
                "attack_count": f"count(*) filter (where {_ATTACK})",
            },
            f"{flows} {own}",
        ),
        rows("protocol_counts", "cast(protocol as varchar)", {"flows": "count(*)"}, f"{flows} group by {day}protocol"),
        counted("protocol_distribution", _PROTOCOL, "flows"),
        counted("label_counts", {k: f"label = '{k}'" for k in ("BENIGN", "DoS")}, "flows"),
        rows("machine_details", "ip", {m: m for m in [*machine, "active_mean", "idle_mean"]}, hosts),
        rows("traffic_trend", "cast(ts as varchar)", {"bytes": "bytes", "packets": "packets"}, trend),
        rows(
            "traffic_spikes", "cast(ts as varchar)",
            {"packets": "packets", "percent_above_mean": "floor((packets - mean) / mean * 100 + 0.5)"}, spikes,
        ),
        flow_rows("recent_connections", _NEWEST, 100),
        flow_rows("top_connections", f"{_BYTES} desc, {_OLDEST}", 10),
        rows(
            "recent_rates", "''",
            {"packet_rate": f"coalesce(avg({_PACKETS}), 0)", "byte_rate": f"coalesce(avg({_BYTES}), 0)"},
            f"{ranked(_NEWEST, 100)} {own}",
        ),
        f"select {day}'attack_stats' as view, concat_ws('|', kind, {severity}) as item, 'flows' as metric, cast(n as double) as value "
        f"from (select {day}unnest(['BENIGN', 'DoS']) as kind, unnest([{labels}]) as n from {flows} {own})",
        flow_rows("attacks", _OLDEST, 100, _ATTACK),
        counted(
            "attacks_by_type", {k: f"label = '{k}'" for k in ("DDOS", "DOS", "PORT SCAN", "BRUTE FORCE")}, "attacks",
            having="having count(*) > 0",
        ),
        rows("suspicious_ips", "src_ip", {"attacks": "count(*)"}, f"{flows} where {_ATTACK} group by {day}src_ip"),
        rows("potential_scans", "flow_id", {"syn": "syn", "rst": "rst"}, ranked(_OLDEST, 50, "syn > 5 or rst > 5")),
        pattern(
            "SYN Scan", "'high'", "syn > 20 and syn > ack * 3",
            syn_count="syn", ack_count="ack", ratio="round(syn / nullif(ack, 0), 2)",
        ),
        pattern("RST Flood", "case when rst > 100 then 'high' else 'medium' end", "rst > 30", rst_count="rst"),
        pattern("High Flow Rate", "case when rate > 10000 then 'high' else 'medium' end", "rate > 1000", packets_per_sec="rate"),
        flow_rows("connection_logs", _NEWEST, 1000),
    ]
    return "\nunion all\n".join(parts)


def digest_sql(flows: str) -> str:
    """The digest of each day's views."""
    return f"""
      select flow_date, view, count(*) as numbers,
        cast(sum(cast(concat('0x', substr(md5(concat_ws('|', item, metric, cast(cast(value * 100 as decimal(38,0)) as varchar))), 1, 15)) as bigint)) as varchar)
          as checksum
      from ({views_sql(flows, by_day=True)}) group by flow_date, view"""
