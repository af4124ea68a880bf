"""Registered queries over the driver tables, each with its SQL counterpart where SQL can say it.

Every query runs over whole tables. Floating-point sums are rounded for display here, because two
engines add in different orders; the operators themselves do not round.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowrill.functions import flow_text as text
from flowrill.operators import (
    anomaly,
    bayes,
    boosting,
    classifiers,
    clean,
    hosts,
    logs,
    metrics,
    neighbours,
    profile,
    sampling,
    scaling,
    summary,
    traffic,
)
from flowrill.plans import scoring, training
from flowrill.plans.day_states import DAY_VIEWS
from flowrill.plans.view_sql import digest_sql, views_sql
from flowrill.plans.views import VIEW_COLUMNS, DaySnapshot, digest, long_form
from flowrill.schema import (
    CANONICAL_COLUMNS,
    DUPLICATE_HEADER,
    MODEL_FEATURES,
    RATE_COLUMNS,
    short_name,
)
from flowrill.session import child_names, delete_path, folder_bytes, move_path, shared_dir, shuffles_removed
from flowrill.sources import captures
from flowrill.sources.day_store import (
    current_day_flows,
    flows_for_date,
    stored_flows_for_date,
    write_analysed,
)
from flowrill.sources.driver_tables import FLOWS_SQL, flow_stream, flows_from_tables
from flowrill.sources.models import load_model, save_model
from flowrill.streaming import live, refresh, score_job

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY = "1998-09-24"
NO_DAY = "1900-01-01"
HOST = "10.1.0.1"


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register ``fn(flows, spark, sf_dir)`` with SQL over the ``flows`` CTE."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(flows_from_tables(spark, sf_dir), spark, sf_dir)
        if sql is not None:
            ORACLES[name] = f"with {FLOWS_SQL}{',' + ctes if ctes else ''}\n{sql}"
        return fn

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def num(column: str) -> str:
    """SQL: finite number or zero."""
    return f"(case when abs({column}) < 'Infinity'::double then {column} else 0.0 end)"


BYTES, PACKETS = num("flow_bytes_s"), num("flow_packets_s")
ATTACK = "(label is distinct from 'BENIGN')"
FINITE_FLOWS = """
finite_flows as (
  select * from flows where flow_bytes_s < 'Infinity'::double and label is not null
)"""

# --- sources -----------------------------------------------------------------------------------


@query(
    "flows_for_date",
    f"select flow_id, src_ip, dst_ip, protocol, ts, flow_packets_s, label from flows "
    f"where flow_date = date '{DAY}'",
)
def _(flows, spark, sf_dir):
    return flows_for_date(flows, DAY).select(
        "flow_id", "src_ip", "dst_ip", "protocol", "ts", "flow_packets_s", "label"
    )


@query(
    "combine_captures",
    """
    select flow_id as "Flow ID", src_ip as "Src IP", cast(protocol as varchar) as "Protocol",
           cast(syn as varchar) as "SYN Flag Count", cast(null as varchar) as "Label"
    from flows where protocol = 6
    union all
    select flow_id, src_ip, cast(protocol as varchar), null, label from flows where protocol <> 6
    """,
)
def _(flows, spark, sf_dir):
    folder = shared_dir(spark, "captures")
    named = flows.select(
        F.col("flow_id").alias("Flow ID"), F.col("src_ip").alias("Src IP"),
        F.col("protocol").alias("Protocol"), F.col("syn").alias("SYN Flag Count"),
        F.col("label").alias("Label"),
    )
    tcp, other = F.col("Protocol") == 6, F.col("Protocol") != 6
    named.where(tcp).drop("Label").write.option("header", "true").mode("append").csv(folder)
    named.where(other).drop("SYN Flag Count").write.option("header", "true").mode("append").csv(folder)
    return captures.combine_captures(spark, folder).select(
        "Flow ID", "Src IP", "Protocol", "SYN Flag Count", "Label"
    )


_DAY_ROWS = (
    f"select flow_id, src_ip, ts, flow_packets_s, label from flows where flow_date = date '{DAY}'"
)
_DAY_COLUMNS = ["flow_id", "src_ip", "ts", "flow_packets_s", "label"]


@query("current_day_flows", _DAY_ROWS)
def _(flows, spark, sf_dir):
    return current_day_flows(flows, today=DAY).select(*_DAY_COLUMNS)


@query("write_analysed", "select flow_id, src_ip, ts, flow_packets_s, label from flows")
def _(flows, spark, sf_dir):
    path = shared_dir(spark, "analysed")
    rows = flows.select(*_DAY_COLUMNS, "flow_date")
    for attempt in range(2):  # the second attempt of a batch replaces the first
        write_analysed(rows, path, batch_id=3, by_day=False)
    return spark.read.parquet(path).select(*_DAY_COLUMNS)


@query("write_dataset", "select flow_id, flow_bytes_s, label from finite_flows", FINITE_FLOWS)
def _(flows, spark, sf_dir):
    path = shared_dir(spark, "dataset")
    captures.write_dataset(clean.drop_non_finite(flows), path)
    return spark.read.parquet(path).select("flow_id", "flow_bytes_s", "label")


@query(
    "read_flows",
    "select flow_id, src_ip, protocol, ts, total_length_fwd, flow_bytes_s, syn, label from flows",
)
def _(flows, spark, sf_dir):
    path = shared_dir(spark, "capture")
    _write_captures(flows, path)
    return clean.coerce_flows(captures.read_flows(spark, path, _STREAMED)).select(
        "flow_id", "src_ip", "protocol", "ts", "total_length_fwd", "flow_bytes_s", "syn", "label"
    )


# --- projections and filters -------------------------------------------------------------------

_LABEL_NAMES = [*text.ATTACK_CATEGORIES, "Other"]
_LABEL_LIST = ", ".join(f"'{n}'" for n in _LABEL_NAMES)
_CATEGORY_CASES = " ".join(f"when '{k}' then '{v}'" for k, v in text.ATTACK_CATEGORIES.items())
CATEGORISED = f"""
categorised as (
  select *, case attack_label {_CATEGORY_CASES} else 'Unknown' end as class_label
  from (select *, list_extract([{_LABEL_LIST}], cast((src_port - 1024) % {len(_LABEL_NAMES)} as int) + 1)
               as attack_label from flows)
)"""


def _categorised(flows: DataFrame) -> DataFrame:
    """Flows with a detailed attack label picked by source port, and its category."""
    position = ((F.col("src_port") - 1024) % len(_LABEL_NAMES) + 1).cast("int")
    labels = F.array(*[F.lit(n) for n in _LABEL_NAMES])
    return clean.add_attack_category(
        flows.withColumn("attack_label", F.element_at(labels, position)), "attack_label"
    )


@query(
    "attack_category",
    "select flow_id, attack_label, class_label from categorised where class_label <> 'Unknown'",
    CATEGORISED,
)
def _(flows, spark, sf_dir):
    return clean.drop_unknown(_categorised(flows)).select("flow_id", "attack_label", "class_label")


@query(
    "read_flows_latin1",
    'select flow_id as "Flow ID", attack_label as "Label", class_label from categorised',
    CATEGORISED,
)
def _(flows, spark, sf_dir):
    path = shared_dir(spark, "latin1")
    named = _categorised(flows).select(F.col("flow_id").alias("Flow ID"), F.col("attack_label").alias("Label"))
    named.write.option("header", "true").option("encoding", "ISO-8859-1").csv(path)
    rows = captures.read_flows(spark, path, ["Flow ID", "Label"], encoding="ISO-8859-1")
    return clean.add_attack_category(rows, "Label")


@query(
    "exclude_classes",
    """select flow_id, class_label from categorised where class_label not in
       ('Brute Force', 'Web Attack', 'Bot', 'Infiltration', 'Vulnerability Exploit')""",
    CATEGORISED,
)
def _(flows, spark, sf_dir):
    rare = ["Brute Force", "Web Attack", "Bot", "Infiltration", "Vulnerability Exploit"]
    return clean.exclude_classes(_categorised(flows), rare).select("flow_id", "class_label")


_TEXT_RATE = """case syn when 1 then 'abc' when 2 then '' when 3 then 'Infinity'
                else concat(cast(total_fwd_packet as {string}), '.5') end"""
_CAPTURE_COLUMNS = """
  flow_id as {q}Flow ID{q}, cast(src_port as {string}) as {q}Src Port{q},
  concat(' ', cast(protocol as {string}), ' ') as {q}Protocol{q}, timestamp_raw as {q}Timestamp{q},
  concat(cast(total_fwd_packet as {string}), '.7') as {q}Flow Duration{q},
  """ + _TEXT_RATE + """ as {q}Flow Bytes/s{q}, coalesce(label, '') as {q}Label{q}"""


@query(
    "coerce_flows",
    """
    select "Flow ID" as flow_id, cast("Src Port" as integer) as src_port,
      cast(trim("Protocol") as integer) as protocol, "Timestamp" as timestamp_raw,
      cast(trunc(try_cast("Flow Duration" as double)) as bigint) as flow_duration,
      try_cast("Flow Bytes/s" as double) as flow_bytes_s, nullif("Label", '') as label,
      strptime("Timestamp", '%d/%m/%Y %I:%M:%S %p') as ts,
      cast(strptime("Timestamp", '%d/%m/%Y %I:%M:%S %p') as date) as flow_date
    from capture
    """,
    "capture as (select " + _CAPTURE_COLUMNS.format(q='"', string="varchar") + " from flows)",
)
def _(flows, spark, sf_dir):
    capture = flows.selectExpr(
        *[
            f"{expr.strip()} as `{name}`"
            for expr, name in [
                ("flow_id", "Flow ID"),
                ("cast(src_port as string)", "Src Port"),
                ("concat(' ', cast(protocol as string), ' ')", "Protocol"),
                ("timestamp_raw", "Timestamp"),
                ("concat(cast(total_fwd_packet as string), '.7')", "Flow Duration"),
                (_TEXT_RATE.format(string="string"), "Flow Bytes/s"),
                ("coalesce(label, '')", "Label"),
            ]
        ]
    )
    return clean.coerce_flows(capture)


@query(
    "drop_non_finite",
    "select flow_id, flow_bytes_s, label from finite_flows",
    FINITE_FLOWS,
)
def _(flows, spark, sf_dir):
    return clean.drop_non_finite(flows).select("flow_id", "flow_bytes_s", "label")


@query(
    "drop_non_finite_rates",
    "select flow_id, flow_bytes_s, label from flows where flow_bytes_s < 'Infinity'::double",
)
def _(flows, spark, sf_dir):
    return clean.drop_non_finite_rates(flows).select("flow_id", "flow_bytes_s", "label")


@query("drop_protocol_zero", "select flow_id, protocol from flows where protocol <> 0")
def _(flows, spark, sf_dir):
    return clean.drop_protocol_zero(flows).select("flow_id", "protocol")


@query("model_features", f"select flow_id, {', '.join(MODEL_FEATURES)} from flows")
def _(flows, spark, sf_dir):
    return clean.select_model_features(flows, keep=["flow_id"])


@query(
    "align_features",
    f"select flow_id, {', '.join(c for c in MODEL_FEATURES if c != 'ack')}, 0.0::double as ack "
    "from flows",
)
def _(flows, spark, sf_dir):
    return clean.align_features(flows.drop("ack"), MODEL_FEATURES, keep=["flow_id"])


@query(
    "drop_identifiers",
    f"select {', '.join(MODEL_FEATURES)} from finite_flows",
    FINITE_FLOWS,
)
def _(flows, spark, sf_dir):
    kept = clean.select_model_features(
        clean.drop_non_finite(flows),
        keep=["flow_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "timestamp_raw", "label"],
    )
    return clean.drop_identifiers(kept)


_NUMERIC = [
    "src_port", "dst_port", "protocol", "flow_duration", "total_fwd_packet", "total_bwd_packets",
    "total_length_fwd", "total_length_bwd", "fwd_packet_length_mean", "flow_bytes_s",
    "flow_packets_s", "flow_iat_mean", "fin", "syn", "rst", "psh", "ack", "urg", "cwr", "ece",
    "active_mean", "idle_mean",
]


@query(
    "numeric_columns",
    " union all ".join(f"select '{c}' as column_name, count({c}) as present from flows" for c in _NUMERIC),
)
def _(flows, spark, sf_dir):
    names = clean.numeric_columns(flows)
    row = flows.agg(*[F.count(c).alias(c) for c in names])
    return row.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("present")) for c in names]))
    )


@query(
    "encode_label",
    """select flow_id, label, dense_rank() over (order by label) - 1 as label_code
       from flows where label is not null""",
)
def _(flows, spark, sf_dir):
    coded = clean.encode_label(flows.select("flow_id", "label"))
    return coded.withColumn("label_code", F.col("label_code").cast("bigint"))


@query(
    "decode_label",
    """select flow_id, case when code = 0 then 'BENIGN' when code = 1 then 'DoS' else '-1' end as label
       from (select flow_id, syn % 3 as code from flows)""",
)
def _(flows, spark, sf_dir):
    return clean.decode_label(flows.select("flow_id", (F.col("syn") % 3).alias("code")), "code").select(
        "flow_id", "label"
    )


@query(
    "protocol_name",
    """select flow_id, protocol,
         case protocol when 1 then 'ICMP' when 6 then 'TCP' when 17 then 'UDP' else 'OTHER' end as summary_name,
         case protocol when 0 then 'HOPOPT' when 1 then 'ICMP' when 6 then 'TCP' when 17 then 'UDP'
                       else 'OTHER' end as traffic_name,
         case protocol when 1 then 'ICMP' when 6 then 'TCP' when 17 then 'UDP'
                       else concat('Protocol ', cast(protocol as varchar)) end as log_name
       from flows""",
)
def _(flows, spark, sf_dir):
    return flows.select(
        "flow_id", "protocol",
        text.protocol_name_summary().alias("summary_name"),
        text.protocol_name_traffic().alias("traffic_name"),
        text.protocol_name_log().alias("log_name"),
    )


@query(
    "parse_timestamp",
    """
    select flow_id, shown, coalesce(
        try_strptime(shown, '%d/%m/%Y %I:%M:%S %p'), try_strptime(shown, '%m/%d/%Y %H:%M'),
        try_cast(shown as timestamp)) as parsed
    from (select flow_id, case syn
            when 1 then 'not a time'
            when 2 then strftime(ts, '%Y-%m-%d %H:%M:%S')
            when 3 then strftime(ts, '%m/%d/%Y 17:%M')
            when 4 then strftime(ts, '%d/%m/%Y 01:05:09 PM')
            else timestamp_raw end as shown from flows)
    """,
)
def _(flows, spark, sf_dir):
    shown = (
        F.when(F.col("syn") == 1, "not a time")
        .when(F.col("syn") == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("syn") == 3, F.date_format("ts", "MM/dd/yyyy '17':mm"))
        .when(F.col("syn") == 4, F.date_format("ts", "dd/MM/yyyy '01:05:09 PM'"))
        .otherwise(F.col("timestamp_raw"))
    )
    rows = flows.select("flow_id", shown.alias("shown"))
    return rows.withColumn("parsed", text.parse_flow_timestamp("shown"))


@query(
    "time_text",
    """select flow_id, case when syn = 1 then 'not a time' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as shown
       from flows""",
)
def _(flows, spark, sf_dir):
    raw = F.when(F.col("syn") == 1, "not a time").otherwise(F.col("timestamp_raw"))
    return flows.select("flow_id", text.time_text(raw).alias("shown"))


@query(
    "protocol_text_summary",
    """select flow_id, case when protocol in (1, 6, 17) then
           case protocol when 1 then 'ICMP' when 6 then 'TCP' else 'UDP' end else 'OTHER' end as bucket
       from flows""",
)
def _(flows, spark, sf_dir):
    names = F.when(F.col("protocol") == 6, "tcp").when(F.col("protocol") == 17, "Udp").otherwise("igmp")
    shown = F.when(F.col("syn") % 2 == 0, F.concat(F.lit(" "), F.col("protocol").cast("string")))
    by_name = F.when(F.col("protocol") == 1, "icmp").otherwise(names)
    return flows.select("flow_id", text.protocol_text_summary(F.coalesce(shown, by_name)).alias("bucket"))


@query("is_attack", f"select flow_id, {ATTACK} as is_attack from flows")
def _(flows, spark, sf_dir):
    return flows.select("flow_id", text.is_attack().alias("is_attack"))


_OLDEST = "order by ts asc nulls last, flow_id asc"
_NEWEST = "order by ts desc nulls last, flow_id asc"


@query(
    "attack_rows",
    f"select flow_id, src_ip, ts, label from flows where {ATTACK} {_OLDEST} limit 100",
)
def _(flows, spark, sf_dir):
    return anomaly.attack_rows(flows).select("flow_id", "src_ip", "ts", "label")


@query(
    "potential_scans",
    f"select flow_id, src_ip, ts, syn, rst from flows where syn > 5 or rst > 5 {_OLDEST} limit 50",
)
def _(flows, spark, sf_dir):
    return anomaly.potential_scans(flows).select("flow_id", "src_ip", "ts", "syn", "rst")


@query("class_subset", "select flow_id, src_ip, protocol, label from flows where label = 'DoS'")
def _(flows, spark, sf_dir):
    return clean.class_subset(flows, "DoS").select("flow_id", "src_ip", "protocol", "label")


@query(
    "class_subset_head",
    f"select flow_id, src_ip, protocol, label from flows where label = 'DoS' {_OLDEST} limit 5",
)
def _(flows, spark, sf_dir):
    return clean.class_subset(flows, "DoS", head=5).select("flow_id", "src_ip", "protocol", "label")


@query(
    "labelled_union",
    """select flow_id, protocol, rst, 'DoS' as label from flows where protocol = 6
       union all select flow_id, protocol, rst, 'DoS' from flows where protocol = 17
       union all select flow_id, protocol, null, 'BENIGN' from flows where protocol not in (6, 17)""",
)
def _(flows, spark, sf_dir):
    rows = flows.select("flow_id", "protocol", "rst")
    floods = rows.where("protocol = 6").unionByName(rows.where("protocol = 17"))
    benign = rows.where("protocol not in (6, 17)").drop("rst")
    return captures.label_capture(floods, "DoS").unionByName(
        captures.label_capture(benign, "BENIGN"), allowMissingColumns=True
    )


# --- summary -----------------------------------------------------------------------------------


@query(
    "network_summary_server",
    f"""select count(distinct concat(src_ip, ':', src_port, '-', dst_ip, ':', dst_port)) as total_connections,
          round(sum({BYTES}), 2) as total_bytes, round(sum({PACKETS}), 2) as total_packets,
          count(*) filter (where {ATTACK}) as attack_count from flows""",
)
def _(flows, spark, sf_dir):
    return rounded(summary.network_summary_server(flows), 2, "total_bytes", "total_packets")


@query(
    "network_summary_client",
    f"""select count(*) as total_connections, round(sum({BYTES}), 2) as total_bytes,
          round(sum({PACKETS}), 2) as total_packets from flows""",
)
def _(flows, spark, sf_dir):
    return rounded(summary.network_summary_client(flows), 2, "total_bytes", "total_packets")


@query(
    "empty_defaults",
    f"""select 'network_summary' as view, count(*) as flows, coalesce(round(sum({BYTES}), 2), 0) as bytes,
          0::bigint as named_attacks from empty_day
        union all
        select 'recent_rates', 0, coalesce(avg({BYTES}), 0), 0 from empty_day
        union all
        select 'attacks_by_type', count(*), 0, 0 from empty_day""",
    f"empty_day as (select * from flows where flow_date = date '{NO_DAY}')",
)
def _(flows, spark, sf_dir):
    day = flows_for_date(flows, NO_DAY)
    network = summary.network_summary_server(day).select(
        F.lit("network_summary").alias("view"), F.col("total_connections").alias("flows"),
        F.col("total_bytes").alias("bytes"), F.col("attack_count").alias("named_attacks"),
    )
    rates = traffic.recent_rates(day).select(
        F.lit("recent_rates").alias("view"), F.lit(0).cast("bigint").alias("flows"),
        F.col("byte_rate").alias("bytes"), F.lit(0).cast("bigint").alias("named_attacks"),
    )
    types = anomaly.attacks_by_type(day).agg(
        F.lit("attacks_by_type").alias("view"), F.count(F.lit(1)).alias("flows"),
        F.lit(0.0).alias("bytes"), F.coalesce(F.sum("attacks"), F.lit(0)).alias("named_attacks"),
    )
    return network.unionByName(rates).unionByName(types)


@query("protocol_counts", "select protocol, count(*) as flows from flows group by protocol")
def _(flows, spark, sf_dir):
    return summary.protocol_counts(flows)


_DISTRIBUTIONS = """
named as (
  select n.protocol_name, count(p) as flows
  from (values ('TCP'), ('UDP'), ('ICMP'), ('OTHER')) n(protocol_name)
  left join (select case protocol when 6 then 'TCP' when 17 then 'UDP' when 1 then 'ICMP'
                    else 'OTHER' end as p from flows) f on f.p = n.protocol_name
  group by n.protocol_name
), labelled as (
  select n.label, count(f.label) as flows from (values ('BENIGN'), ('DoS')) n(label)
  left join flows f on f.label = n.label group by n.label
)"""


@query("protocol_distribution", "select protocol_name, flows from named", _DISTRIBUTIONS)
def _(flows, spark, sf_dir):
    return summary.protocol_distribution(flows)


@query("label_counts", "select label, flows from labelled", _DISTRIBUTIONS)
def _(flows, spark, sf_dir):
    return summary.label_counts(flows)


@query("attack_total", "select count(*) as attacks from flows where label = 'DoS'")
def _(flows, spark, sf_dir):
    return summary.attack_total(flows)


@query(
    "distribution_share",
    """select 'protocol' as distribution, protocol_name as name, flows, round(share * 100, 6) as percent
       from (select *, flows / sum(flows) over () as share from named) where share > 0
       union all
       select 'label', label, flows, round(share * 100, 6)
       from (select *, flows / sum(flows) over () as share from labelled) where share > 0.02""",
    _DISTRIBUTIONS,
)
def _(flows, spark, sf_dir):
    return rounded(summary.distribution_share(flows), 6, "percent")


# --- hosts -------------------------------------------------------------------------------------

ROLES = f"""
roles as (
  select src_ip as ip, 0 as role, * from flows union all select dst_ip, 1, * from flows
), traffic_by_host as (
  select ip,
    round(sum(case role when 0 then {num('total_length_fwd')} else 0 end), 2) as sent_bytes,
    round(sum(case role when 1 then {num('total_length_bwd')} else 0 end), 2) as received_bytes,
    sum(case role when 0 then cast(total_fwd_packet as double) else 0 end) as sent_packets,
    sum(case role when 1 then cast(total_bwd_packets as double) else 0 end) as received_packets,
    count(*) filter (where role = 0) as outbound_connections,
    count(*) filter (where role = 1) as inbound_connections
  from roles group by ip
)"""


@query("host_traffic", "select * from traffic_by_host", ROLES)
def _(flows, spark, sf_dir):
    return rounded(hosts.host_traffic(flows), 2, "sent_bytes", "received_bytes")


@query("host_by_ip", f"select * from traffic_by_host where ip = '{HOST}'", ROLES)
def _(flows, spark, sf_dir):
    return rounded(hosts.host_by_ip(flows, HOST), 2, "sent_bytes", "received_bytes")


@query("hosts_sorted", "select * from traffic_by_host order by sent_bytes desc, ip", ROLES)
def _(flows, spark, sf_dir):
    table = rounded(hosts.host_traffic(flows), 2, "sent_bytes", "received_bytes")
    return hosts.hosts_sorted(table, "sent_bytes", "desc")


@query(
    "host_flags_both",
    "select ip, "
    + ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in hosts.SERVER_FLAGS)
    + " from roles group by ip",
    ROLES,
)
def _(flows, spark, sf_dir):
    return hosts.host_flags_both(flows)


_SOURCE_FLAGS = ", ".join(
    f"cast(sum(case role when 0 then {c} else 0 end) as bigint) as {c}" for c in hosts.CLIENT_FLAGS
)


@query("host_flags_source", f"select ip, {_SOURCE_FLAGS} from roles group by ip", ROLES)
def _(flows, spark, sf_dir):
    return hosts.host_flags_source(flows)


@query(
    "host_flags_long",
    " union all ".join(
        f"select ip, '{c.upper()}' as flag, {c} as flag_count from by_host" for c in hosts.CLIENT_FLAGS
    ),
    ROLES + f", by_host as (select ip, {_SOURCE_FLAGS} from roles group by ip)",
)
def _(flows, spark, sf_dir):
    return hosts.host_flags_long(flows)


_LAST_SEEN = """, last_seen as (
  select ip, active_mean, idle_mean from roles
  qualify row_number() over (partition by ip order by ts desc, flow_id desc) = 1
)"""


@query("host_last_activity", "select * from last_seen", ROLES + _LAST_SEEN)
def _(flows, spark, sf_dir):
    return hosts.host_last_activity(flows)


@query(
    "host_profile",
    "select t.*, "
    + ", ".join(f"f.{c}" for c in hosts.SERVER_FLAGS)
    + ", active_mean, idle_mean from traffic_by_host t join flags_by_host f using (ip) "
    "join last_seen using (ip)",
    ROLES
    + _LAST_SEEN
    + ", flags_by_host as (select ip, "
    + ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in hosts.SERVER_FLAGS)
    + " from roles group by ip)",
)
def _(flows, spark, sf_dir):
    return rounded(hosts.host_profile(flows), 2, "sent_bytes", "received_bytes")


@query(
    "host_activity_ema",
    """select src_ip as ip, round(sum(active_mean * pow(2.0, -r)), 6) as active_mean,
         round(sum(idle_mean * pow(2.0, -r)), 6) as idle_mean
       from (select *, row_number() over (partition by src_ip order by ts desc, flow_id desc) as r
             from flows) group by src_ip""",
)
def _(flows, spark, sf_dir):
    return rounded(hosts.host_activity_ema(flows), 6, "active_mean", "idle_mean")


@query(
    "host_top_destinations",
    """select src_ip as ip, dst_ip as destination, connections, rank from (
         select *, row_number() over (partition by src_ip order by connections desc, ts, flow_id) as rank
         from (select src_ip, dst_ip, count(*) as connections,
                 min(struct_pack(a := ts, b := flow_id)) as f, min(struct_pack(a := ts, b := flow_id)).a as ts,
                 min(struct_pack(a := ts, b := flow_id)).b as flow_id
               from flows group by src_ip, dst_ip)) where rank <= 5""",
)
def _(flows, spark, sf_dir):
    return hosts.host_top_destinations(flows).withColumn("rank", F.col("rank").cast("bigint"))


# --- traffic -----------------------------------------------------------------------------------

TREND = f"""
trend as (
  select ts, round(sum({BYTES}), 2) as bytes, round(sum({PACKETS}), 2) as packets
  from flows group by ts
)"""


@query("traffic_trend", "select * from trend", TREND)
def _(flows, spark, sf_dir):
    return rounded(traffic.traffic_trend(flows), 2, "bytes", "packets")


@query(
    "trend_top_flow",
    f"""select ts, flow_id as top_flow_id, bytes as top_bytes from (select ts, flow_id, {BYTES} as bytes from flows)
        qualify row_number() over (partition by ts order by bytes desc, flow_id desc) = 1""",
)
def _(flows, spark, sf_dir):
    return traffic.trend_top_flow(flows)


@query(
    "traffic_spikes",
    """select ts, packets, cast(floor((packets - mean) / mean * 100 + 0.5) as bigint) as percent_above_mean
       from trend, (select avg(packets) as mean, stddev_pop(packets) as deviation, count(*) as points from trend)
       where points >= 2 and packets > mean + 2 * deviation""",
    TREND,
)
def _(flows, spark, sf_dir):
    return traffic.traffic_spikes(flows)


@query(
    "recent_rates",
    f"""select avg({PACKETS}) as packet_rate, round(avg({BYTES}), 4) as byte_rate
        from (select * from flows {_NEWEST} limit 100)""",
)
def _(flows, spark, sf_dir):
    return rounded(traffic.recent_rates(flows), 4, "byte_rate")


@query("recent_flows", f"select flow_id, ts, src_ip, label from flows {_NEWEST} limit 100")
def _(flows, spark, sf_dir):
    return traffic.recent_flows(flows).select("flow_id", "ts", "src_ip", "label")


@query(
    "top_flows_by_bytes",
    f"select flow_id, flow_bytes_s, ts from flows order by {BYTES} desc, ts, flow_id limit 10",
)
def _(flows, spark, sf_dir):
    return traffic.top_flows_by_bytes(flows).select("flow_id", "flow_bytes_s", "ts")


@query(
    "top_flows_by_packets",
    f"""select flow_id, concat(src_ip, ':', src_port) as source, concat(dst_ip, ':', dst_port) as destination,
          case protocol when 0 then 'HOPOPT' when 1 then 'ICMP' when 6 then 'TCP' when 17 then 'UDP'
               else 'OTHER' end as protocol,
          {BYTES} as bytes_per_sec, {PACKETS} as packets_per_sec, flow_duration as duration, ts
        from flows order by {PACKETS} desc, flows.ts, flow_id limit 10""",
)
def _(flows, spark, sf_dir):
    return traffic.top_flows_by_packets(flows)


@query(
    "duration_profile",
    f"""select row_number() over (order by duration, flow_id) - 1 as flow_index, * from (
          select flow_duration as duration, {BYTES} as bytes, {PACKETS} as packets, flow_id
          from flows order by flow_duration, flow_id limit 100)""",
)
def _(flows, spark, sf_dir):
    return traffic.duration_profile(flows).withColumn("flow_index", F.col("flow_index").cast("bigint"))


@query(
    "last_points",
    f"""select * from (select ts, flow_id, {BYTES} as bytes, {PACKETS} as packets from flows
        order by ts desc, flow_id desc limit 100) order by ts, flow_id""",
)
def _(flows, spark, sf_dir):
    return traffic.last_points(flows)


# --- anomalies ---------------------------------------------------------------------------------


@query(
    "attacks_by_type",
    """select n.attack_type, count(f.label) as attacks
       from (values ('DDOS'), ('DOS'), ('PORT SCAN'), ('BRUTE FORCE')) n(attack_type)
       left join flows f on f.label = n.attack_type group by n.attack_type""",
)
def _(flows, spark, sf_dir):
    return anomaly.attacks_by_type(flows)


@query(
    "attacks_by_type_normalized",
    """select n.attack_type, count(f.label) as attacks
       from (values ('DDOS'), ('DOS'), ('PORT SCAN'), ('BRUTE FORCE')) n(attack_type)
       left join flows f on upper(f.label) = n.attack_type group by n.attack_type""",
)
def _(flows, spark, sf_dir):
    return anomaly.attacks_by_type(flows, normalize=True)


@query(
    "suspicious_ips",
    f"select src_ip as ip, count(*) as attacks from flows where {ATTACK} group by src_ip",
)
def _(flows, spark, sf_dir):
    return anomaly.suspicious_ips(flows)


@query(
    "attack_stats",
    """select attack_type, flows, case when attack_type = 'BENIGN' then 'low' when flows = 0 then 'high'
         when flows > 100 then 'high' when flows > 10 then 'medium' else 'low' end as severity
       from (select n.attack_type, count(f.label) as flows from (values ('BENIGN'), ('DoS')) n(attack_type)
             left join (select coalesce(nullif(label, ''), 'BENIGN') as label from flows) f
               on f.label = n.attack_type group by n.attack_type)""",
)
def _(flows, spark, sf_dir):
    return anomaly.attack_stats(flows)


RELATED = """
related as (
  select attack_type, ip, min(seen) as seen from (
    select coalesce(label, 'BENIGN') as attack_type, src_ip as ip, struct_pack(a := ts, b := flow_id, c := 0) as seen
    from flows
    union all
    select coalesce(label, 'BENIGN'), dst_ip, struct_pack(a := ts, b := flow_id, c := 1) from flows)
  group by attack_type, ip
)"""


@query("attack_related_ips", "select attack_type, ip from related", RELATED)
def _(flows, spark, sf_dir):
    return anomaly.attack_related_ips(flows)


@query(
    "related_ips_preview",
    """select attack_type, position, ip, more from (
         select attack_type, ip, row_number() over (partition by attack_type order by seen) as position,
           greatest(count(*) over (partition by attack_type) - 50, 0) as more from related)
       where position <= 50""",
    RELATED,
)
def _(flows, spark, sf_dir):
    return anomaly.related_ips_preview(flows).withColumn("position", F.col("position").cast("bigint"))


@query("affected_ip_count", "select count(distinct ip) as affected_ips from related", RELATED)
def _(flows, spark, sf_dir):
    return anomaly.affected_ip_count(flows)


@query(
    "suspicious_patterns",
    """
    select ip, 'SYN Scan' as pattern, 'high' as severity, syn as syn_count, ack as ack_count,
           round(syn / nullif(ack, 0), 2) as ratio, cast(null as bigint) as rst_count,
           cast(null as double) as packets_per_sec
    from totals where syn > 20 and syn > ack * 3
    union all
    select ip, 'RST Flood', case when rst > 100 then 'high' else 'medium' end, null, null, null, rst, null
    from totals where rst > 30
    union all
    select ip, 'High Flow Rate', case when rate > 10000 then 'high' else 'medium' end,
           null, null, null, null, round(rate, 2)
    from totals where rate > 1000
    """,
    f"""totals as (select src_ip as ip, cast(sum(syn) as bigint) as syn, cast(sum(ack) as bigint) as ack,
          cast(sum(rst) as bigint) as rst, sum({PACKETS}) as rate from flows group by src_ip)""",
)
def _(flows, spark, sf_dir):
    return anomaly.suspicious_patterns(flows)


# --- connection log ----------------------------------------------------------------------------

LOG = f"log as (select * from flows {_NEWEST} limit 1000)"
_LOG_COLUMNS = "flow_id, src_ip, dst_ip, protocol, ts, label"


@query("recent_log", f"select {_LOG_COLUMNS} from log", LOG)
def _(flows, spark, sf_dir):
    return logs.recent_log(flows).select(*_LOG_COLUMNS.split(", "))


def _any_sql(value: str) -> str:
    return (
        f"(contains(src_ip, '{value}') or contains(dst_ip, '{value}') "
        f"or contains(cast(protocol as varchar), '{value}') or contains(coalesce(label, ''), '{value}'))"
    )


@query("log_filter_any", f"select {_LOG_COLUMNS} from log where {_any_sql('DoS')}", LOG)
def _(flows, spark, sf_dir):
    return logs.log_filter_any(logs.recent_log(flows), "DoS").select(*_LOG_COLUMNS.split(", "))


@query(
    "log_filter_field",
    f"select {_LOG_COLUMNS} from flows where contains(lower(label), 'dos')",
)
def _(flows, spark, sf_dir):
    return logs.log_filter_field(flows, "label", "dOs").select(*_LOG_COLUMNS.split(", "))


@query(
    "log_filter_protocol",
    f"""select {_LOG_COLUMNS} from flows where contains(lower(case protocol when 1 then 'ICMP' when 6 then 'TCP'
          when 17 then 'UDP' else concat('Protocol ', cast(protocol as varchar)) end), 'protocol')""",
)
def _(flows, spark, sf_dir):
    return logs.log_filter_field(flows, "protocol", "protocol").select(*_LOG_COLUMNS.split(", "))


@query(
    "log_page_server",
    f"""select {_LOG_COLUMNS}, position, total, 2 as page, 50 as page_limit from (
          select *, row_number() over ({_NEWEST}) as position, count(*) over () as total
          from log where {_any_sql('17')}) where position > 50 and position <= 100""",
    LOG,
)
def _(flows, spark, sf_dir):
    page = logs.log_page_server(flows, page=2, limit=50, text="17")
    return page.withColumn("position", F.col("position").cast("bigint")).select(
        *_LOG_COLUMNS.split(", "), "position", "total", "page", "page_limit"
    )


@query(
    "log_sorted",
    f"""select {_LOG_COLUMNS}, cast(row_number() over (order by lower(coalesce(label, '')) asc, ts, flow_id) as bigint)
          as position from (select * from flows {_NEWEST} limit 1000)""",
)
def _(flows, spark, sf_dir):
    from pyspark.sql import Window

    log = logs.recent_log(flows)
    order = logs.log_order(log, "label", "asc")
    numbered = log.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return logs.log_sorted(numbered, "label", "asc").select(*_LOG_COLUMNS.split(", "), "position")


@query(
    "connection_log_page",
    f"""select flow_id, concat(src_ip, ':', src_port) as source, concat(dst_ip, ':', dst_port) as destination,
          case protocol when 1 then 'ICMP' when 6 then 'TCP' when 17 then 'UDP'
               else concat('Protocol ', cast(protocol as varchar)) end as protocol,
          flow_duration as duration, cast(floor({BYTES} + 0.5) as bigint) as bytes_per_sec,
          cast(floor({PACKETS} + 0.5) as bigint) as packets_per_sec, ts, label, {ATTACK} as is_attack,
          (select count(*) from flows where contains(lower(dst_ip), '10.1.0.7')) as total,
          (select cast(ceil(count(*) / 15) as bigint) from flows
           where contains(lower(dst_ip), '10.1.0.7')) as total_pages
        from flows where contains(lower(dst_ip), '10.1.0.7')
        order by flow_duration desc nulls last, ts, flow_id limit 15 offset 30""",
)
def _(flows, spark, sf_dir):
    page = logs.log_page_client(
        flows, page=3, size=15, sort_field="flow_duration", direction="desc",
        filter_field="dst_ip", text="10.1.0.7",
    )
    return logs.log_display(page)


# --- profiling ---------------------------------------------------------------------------------


@query(
    "value_counts",
    " union all ".join(
        f"select '{c}' as column_name, cast({c} as varchar) as value, count(*) as n from {t} "
        f"where {c} is not null group by {c}"
        for c, t in [("label", "flows"), ("protocol", "flows"), ("src_ip", "flows")]
    )
    + " union all select 'label of protocol 0', label, count(*) from flows "
    "where protocol = 0 and label is not null group by label",
)
def _(flows, spark, sf_dir):
    def counted(df, column, shown):
        return profile.value_counts(df, column).select(
            F.lit(shown).alias("column_name"), F.col(column).cast("string").alias("value"), "n"
        )

    parts = [counted(flows, c, c) for c in ("label", "protocol", "src_ip")]
    parts.append(counted(flows.where("protocol = 0"), "label", "label of protocol 0"))
    return metrics.union_all(parts)


_PROFILED = ["flow_id", "src_ip", "protocol", "flow_bytes_s", "flow_packets_s", "label"]


@query(
    "null_profile",
    " union all ".join(
        f"select '{c}' as column_name, count(*) - count({c}) as missing from flows" for c in _PROFILED
    )
    + " union all select '*', "
    + " + ".join(f"count(*) - count({c})" for c in _PROFILED)
    + " from flows",
)
def _(flows, spark, sf_dir):
    return profile.null_profile(flows, _PROFILED)


@query(
    "inf_profile",
    "select * from ("
    + " union all ".join(
        f"select '{c}' as column_name, count(*) filter (where abs({c}) = 'Infinity'::double) as infinite from flows"
        for c in _NUMERIC
    )
    + ") where infinite > 0",
)
def _(flows, spark, sf_dir):
    return profile.inf_profile(flows)


@query(
    "inf_counts",
    " union all ".join(
        f"select '{c}' as column_name, count(*) filter (where abs({c}) = 'Infinity'::double) as infinite from flows"
        for c in RATE_COLUMNS
    ),
)
def _(flows, spark, sf_dir):
    return profile.inf_counts(flows)


@query(
    "describe_rates",
    " union all ".join(
        f"""select '{c}' as column_name, count({c}) as n, round(avg({c}), 4) as mean,
              round(stddev_samp({c}), 4) as std, min({c}) as min, round(quantile_cont({c}, 0.25), 4) as q1,
              round(quantile_cont({c}, 0.5), 4) as median, round(quantile_cont({c}, 0.75), 4) as q3,
              max({c}) as max from finite_flows"""
        for c in RATE_COLUMNS
    ),
    FINITE_FLOWS,
)
def _(flows, spark, sf_dir):
    return rounded(
        profile.describe_rates(clean.drop_non_finite(flows)), 4, "mean", "std", "q1", "median", "q3"
    )


@query(
    "rate_quartiles",
    " union all ".join(
        f"""select '{c}' as column_name, {p}::double as probability,
              round(quantile_cont({c}, {p}), 4) as value from finite_flows"""
        for c in RATE_COLUMNS
        for p in (0.25, 0.5, 0.75)
    ),
    FINITE_FLOWS,
)
def _(flows, spark, sf_dir):
    return rounded(profile.rate_quartiles(clean.drop_non_finite(flows)), 4, "value")


@query(
    "feature_min_max",
    " union all ".join(
        f"select '{c}' as column_name, min({c})::double as min_value, max({c})::double as max_value from finite_flows"
        for c in MODEL_FEATURES
    ),
    FINITE_FLOWS,
)
def _(flows, spark, sf_dir):
    return profile.feature_min_max(clean.drop_non_finite(flows), MODEL_FEATURES)


@query(
    "dataset_shape",
    """select 'all flows' as step, count(*) as n_rows, 29 as n_columns from flows
       union all select 'without gaps', count(*), 29 from finite_flows
       union all select 'features', count(*), 10 from finite_flows""",
    FINITE_FLOWS,
)
def _(flows, spark, sf_dir):
    whole = clean.drop_non_finite(flows)
    return metrics.union_all(
        [
            profile.dataset_shape(flows, "all flows"),
            profile.dataset_shape(whole, "without gaps"),
            profile.dataset_shape(clean.select_model_features(whole), "features"),
        ]
    )


# --- sampling, scaling, models -----------------------------------------------------------------

BALANCED = """
ranked as (
  select *, row_number() over (partition by label order by md5(concat('42:', flow_id)), flow_id) as r,
    count(*) over (partition by label) as class_rows
  from finite_flows
), balanced as (
  select * from ranked where r <= (select min(class_rows) from ranked)
)"""


@query("undersample", "select flow_id, label from balanced", FINITE_FLOWS + "," + BALANCED)
def _(flows, spark, sf_dir):
    usable = clean.drop_non_finite(flows).select("flow_id", "label")
    return sampling.undersample_to_min(usable, classes=["BENIGN", "DoS"])


SPLIT = """
split_flows as (
  select *, case when r <= class_rows // 5 then 'test' else 'train' end as split from ranked
)"""


@query(
    "split_stratified",
    "select flow_id, label, split from split_flows",
    FINITE_FLOWS + "," + BALANCED + "," + SPLIT,
)
def _(flows, spark, sf_dir):
    usable = clean.drop_non_finite(flows).select("flow_id", "label")
    return sampling.split_stratified(usable)


@query(
    "balanced_split",
    """select flow_id, label, case when r <= (select min(class_rows) from ranked) // 5 then 'test'
         else 'train' end as split from balanced""",
    FINITE_FLOWS + "," + BALANCED,
)
def _(flows, spark, sf_dir):
    usable = clean.drop_non_finite(flows).select("flow_id", "label")
    return sampling.balanced_split(usable, classes=["BENIGN", "DoS"])


_INTEGER = sampling.INTEGER_FEATURES


def _noise_sql(feature: str) -> str:
    scale = 0.05 if feature == "flow_packets_s" else 10.0
    digest = f"md5(concat('42:1:{feature}:', flow_id))"
    unit = f"(cast(concat('0x', substr({digest}, 1, 8)) as bigint) / 4294967296.0::double)"
    value = f"{feature}::double * (1.0::double + ({-scale}::double + {2 * scale}::double * {unit}))"
    if feature != "flow_packets_s":
        value = f"abs({value})"
    if feature in _INTEGER:
        value = f"round_even({value}, 0)"
    return f"{value} as {feature}"


@query(
    "augment_dos",
    "select flow_id, "
    + ", ".join(f"{c}::double as {c}" for c in MODEL_FEATURES)
    + ", label from finite_flows where label = 'BENIGN' union all select flow_id, "
    + ", ".join(_noise_sql(c) for c in MODEL_FEATURES)
    + ", label from finite_flows where label = 'DoS'",
    FINITE_FLOWS,
)
def _(flows, spark, sf_dir):
    return sampling.augment_dos(clean.drop_non_finite(flows)).drop("copy")


@query(
    "standard_scale",
    "select flow_id, split, "
    + ", ".join(f"round(({c} - m_{c}) / d_{c}, 6) as {c}" for c in MODEL_FEATURES)
    + " from split_flows, (select "
    + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as d_{c}" for c in MODEL_FEATURES)
    + " from split_flows where split = 'train')",
    FINITE_FLOWS + "," + BALANCED + "," + SPLIT,
)
def _(flows, spark, sf_dir):
    usable = clean.select_model_features(clean.drop_non_finite(flows), keep=["flow_id", "label"])
    split = sampling.split_stratified(usable, classes=["BENIGN", "DoS"]).persist(StorageLevel.MEMORY_AND_DISK)
    scaled = scaling.standard_scale(split, MODEL_FEATURES)
    return rounded(scaled.drop("label"), 6, *MODEL_FEATURES)


def _nb_score(i: str) -> str:
    parts = [f"ln({i}_n / n)"]
    for c in MODEL_FEATURES:
        parts.append(f"- 0.5 * ln(2 * pi() * ({i}_v_{c} + eps))")
        parts.append(f"- ({c} - {i}_m_{c}) * ({c} - {i}_m_{c}) / (2 * ({i}_v_{c} + eps))")
    return " ".join(parts)


_NB_STATS = ", ".join(
    f"count(*) filter (where label = '{name}') as {i}_n, "
    + ", ".join(
        f"avg({c}) filter (where label = '{name}') as {i}_m_{c}, "
        f"var_pop({c}) filter (where label = '{name}') as {i}_v_{c}"
        for c in MODEL_FEATURES
    )
    for i, name in [("a", "BENIGN"), ("b", "DoS")]
)


@query(
    "gaussian_nb",
    f"""select flow_id, label, case when {_nb_score('a')} >= {_nb_score('b')} then 'BENIGN' else 'DoS' end
          as prediction from scaled, nb where split = 'test'""",
    FINITE_FLOWS + "," + BALANCED + "," + SPLIT
    + ", scaled as (select flow_id, label, split, "
    + ", ".join(f"({c} - m_{c}) / case when d_{c} = 0 then 1 else d_{c} end as {c}" for c in MODEL_FEATURES)
    + " from split_flows, (select "
    + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as d_{c}" for c in MODEL_FEATURES)
    + " from split_flows where split = 'train'))"
    + f", nb as (select {_NB_STATS}, count(*) as n, 1e-9 * greatest("
    + ", ".join(f"var_pop({c})" for c in MODEL_FEATURES)
    + ") as eps from scaled where split = 'train')",
)
def _(flows, spark, sf_dir):
    usable = clean.select_model_features(clean.drop_non_finite(flows), keep=["flow_id", "label"])
    split = sampling.split_stratified(usable, classes=["BENIGN", "DoS"]).persist(StorageLevel.MEMORY_AND_DISK)
    return bayes.gaussian_nb(scaling.standard_scale(split, MODEL_FEATURES), MODEL_FEATURES, ["BENIGN", "DoS"])


_REQUIRED = ["flow_bytes_s", "flow_packets_s"]
_LINEAR = f"{scoring.LINEAR_BIAS} + " + " + ".join(
    f"({w}) * {c}" for c, w in scoring.LINEAR_WEIGHTS.items()
)
SCORED = f"""
scored as (
  select flow_id, label as true_label, case when {_LINEAR} > 0 then 'DoS' else 'BENIGN' end as label
  from flows where protocol <> 0 and flow_bytes_s < 'Infinity'::double
), predicted as (
  select true_label as label, label as prediction from scored where true_label is not null
), classes as (
  select class, sum(support) as support, sum(predicted) as predicted, sum(hits) as hits from (
    select label as class, count(*) as support, 0 as predicted,
           count(*) filter (where label = prediction) as hits from predicted group by label
    union all
    select prediction, 0, count(*), 0 from predicted group by prediction) group by class
), ratios as (
  select *, coalesce(hits / nullif(predicted, 0), 0) as precision, coalesce(hits / nullif(support, 0), 0) as recall
  from classes
), quality as (
  select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from ratios
)"""


def _predicted(flows: DataFrame) -> DataFrame:
    """(label, prediction) of the fixed linear scorer on scorable, labelled flows."""
    ready = scoring.scorable(flows, _REQUIRED).where(F.col("label").isNotNull())
    return ready.select("label", scoring.linear_label().alias("prediction"))


@query("score_linear", "select flow_id, label from scored", SCORED)
def _(flows, spark, sf_dir):
    return scoring.score_linear(flows, _REQUIRED)


@query(
    "classification_metrics",
    """select round(sum(hits) / sum(support), 6) as accuracy, round(avg(precision), 6) as precision,
         round(avg(recall), 6) as recall, round(avg(f1), 6) as f1 from quality""",
    SCORED,
)
def _(flows, spark, sf_dir):
    return rounded(
        metrics.classification_metrics(_predicted(flows)), 6, "accuracy", "precision", "recall", "f1"
    )


@query(
    "classification_report",
    """
    select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
           cast(support as bigint) as support from quality
    union all
    select 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6),
           round(sum(hits) / sum(support), 6), cast(sum(support) as bigint) from quality
    union all
    select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
           cast(sum(support) as bigint) from quality
    union all
    select 'weighted avg', round(sum(precision * support) / sum(support), 6),
           round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
           cast(sum(support) as bigint) from quality
    """,
    SCORED,
)
def _(flows, spark, sf_dir):
    return rounded(
        metrics.classification_report(_predicted(flows)), 6, "precision", "recall", "f1"
    )


@query(
    "confusion_matrix",
    """select a.c as label, b.c as prediction, count(p.label) as n
       from (values ('BENIGN'), ('DoS')) a(c) cross join (values ('BENIGN'), ('DoS')) b(c)
       left join predicted p on p.label = a.c and p.prediction = b.c group by a.c, b.c""",
    SCORED,
)
def _(flows, spark, sf_dir):
    return metrics.confusion_matrix(_predicted(flows), ["BENIGN", "DoS"])


# --- trained models ----------------------------------------------------------------------------


def _training_set(flows: DataFrame) -> DataFrame:
    """Balanced and split rows of the two scored classes, stored once for all passes."""
    return training.stored_training_rows(flows.sparkSession, flows, ["BENIGN", "DoS"])


def _trained(flows: DataFrame, name: str) -> DataFrame:
    rows = _training_set(flows)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    model = classifiers.fit_model(train, name)
    predicted = classifiers.predict(model, test, ["label_code"])
    quality = metrics.classification_metrics(predicted, "label_code")
    return quality.select(F.lit(name).alias("model"), "*")


@query("train_lr")
def _(flows, spark, sf_dir):
    return _trained(flows, "Logistic Regression")


@query("train_dt")
def _(flows, spark, sf_dir):
    return _trained(flows, "Decision Tree")


@query("train_rf")
def _(flows, spark, sf_dir):
    return _trained(flows, "Random Forest")


@query("train_svm_rff")
def _(flows, spark, sf_dir):
    return _trained(flows, "SVM (random Fourier features)")


@query("train_gbt")
def _(flows, spark, sf_dir):
    return _trained(flows, "Gradient Boosting")


@query("train_gbt_binned")
def _(flows, spark, sf_dir):
    return _trained(flows, "Gradient Boosting (binned)")


@query("train_nb")
def _(flows, spark, sf_dir):
    return _trained(flows, "Naive Bayes")


_USABLE = """
usable as (
  select label, count(*) as n from flows
  where flow_bytes_s < 'Infinity'::double and label in ('BENIGN', 'DoS') group by label
)"""


def _properties(predicted: DataFrame, name: str) -> DataFrame:
    """How many rows were predicted, and whether more are right than the largest class has."""
    right = F.count_if(F.col("label_code") == F.col("prediction"))
    largest = F.greatest(F.count_if(F.col("label_code") == 0), F.count_if(F.col("label_code") == 1))
    return predicted.agg(F.count(F.lit(1)).alias("n_rows"), (right > largest).alias("above_majority")).select(
        F.lit(name).alias("model"), "*"
    )


_PROPERTY_SQL = "select '{}' as model, 2 * (min(n) // 5) as n_rows, true as above_majority from usable"
_OWN_TREE = "Decision Tree (10 rows to split)"


@query(
    "trained_properties",
    " union all ".join(_PROPERTY_SQL.format(n) for n in ("Logistic Regression", "Decision Tree", "Naive Bayes", _OWN_TREE)),
    _USABLE,
)
def _(flows, spark, sf_dir):
    rows = _training_set(flows)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    found = [
        _properties(classifiers.predict(classifiers.fit_model(train, name), test, ["label_code"]), name)
        for name in ("Logistic Regression", "Decision Tree", "Naive Bayes")
    ]
    tree = boosting.fit_tree(train, MODEL_FEATURES, "label_code")
    return metrics.union_all([*found, _properties(tree.predict(test, "label_code"), _OWN_TREE)])


@query("train_second_order", _PROPERTY_SQL.format("Gradient Boosting (second order)"), _USABLE)
def _(flows, spark, sf_dir):
    rows = _training_set(flows)
    model = boosting.fit_boosted(rows.where("split = 'train'"), MODEL_FEATURES, "label_code")
    predicted = model.predict(rows.where("split = 'test'"), "label_code")
    return _properties(predicted, "Gradient Boosting (second order)")


_FOUR = ["BENIGN", "DDoS", "DoS", "PortScan"]


@query(
    "train_four_classes",
    f"""
    select class, case when class in ('accuracy', 'macro avg', 'weighted avg') then 4 * test else test end as support
    from (select min(n) // 5 as test from usable),
      (values ('0'), ('1'), ('2'), ('3'), ('accuracy'), ('macro avg'), ('weighted avg')) v(class)
    """,
    CATEGORISED + f""", usable as (
      select class_label, count(*) as n from categorised
      where flow_bytes_s < 'Infinity'::double and class_label in ({", ".join(f"'{c}'" for c in _FOUR)}) group by class_label
    )""",
)
def _(flows, spark, sf_dir):
    """Rare classes go, the others are balanced, split, scaled, fitted by softmax trees and reported."""
    rare = ["Brute Force", "Web Attack", "Bot", "Infiltration", "Vulnerability Exploit"]
    kept = clean.exclude_classes(clean.drop_unknown(_categorised(flows)), rare)
    path = shared_dir(spark, "training")
    rows = training.stored_training_rows(spark, kept, _FOUR, label="class_label")
    scaling.standard_scale(rows, MODEL_FEATURES).write.parquet(path)
    rows = training.in_tasks(spark.read.parquet(path))
    model = boosting.fit_boosted(rows.where("split = 'train'"), MODEL_FEATURES, "label_code", n_classes=4, rounds=30)
    predicted = model.predict(rows.where("split = 'test'"), "label_code")
    return metrics.classification_report(predicted, "label_code").select("class", "support")


@query("knn_classify")
def _(flows, spark, sf_dir):
    rows = scaling.standard_scale(_training_set(flows), MODEL_FEATURES)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    predicted = neighbours.knn_classify(train, test, MODEL_FEATURES, "label_code")
    return test.select("flow_id", "label_code").join(predicted, "flow_id")


def _compared(flows: DataFrame) -> DataFrame:
    """All models of the comparison, each saved."""
    rows = _training_set(flows)
    return classifiers.compare_models(
        rows.where("split = 'train'"), rows.where("split = 'test'"),
        save_dir=shared_dir(flows.sparkSession, "models"),
    )


@query("compare_models")
def _(flows, spark, sf_dir):
    return _compared(flows)


@query("best_model")
def _(flows, spark, sf_dir):
    return metrics.best_model(_compared(flows))


@query("score_flows")
def _(flows, spark, sf_dir):
    """The flows are made once: what training and scoring need of them is one stored table."""
    flows = training.stored_flows(spark, flows.select("flow_id", "protocol", *MODEL_FEATURES, "label"))
    rows = training.stored_training_rows(spark, flows, ["BENIGN", "DoS"], from_table=True)
    fitted = classifiers.fit_model(rows.where("split = 'train'"), "Logistic Regression")
    path = shared_dir(spark, "model")
    save_model(fitted, path)
    return scoring.score_flows(flows, load_model(path), required=_REQUIRED).select("flow_id", "label")


RAW_CAPTURE = CATEGORISED + """,
complete as (
  select flow_id, attack_label as label, class_label, cast(total_fwd_packet as bigint) as flow_duration,
    flow_bytes_s from categorised
  where class_label <> 'Unknown' and flow_bytes_s < 'Infinity'::double and syn <> 5
)"""


@query("clean_training", "select * from complete", RAW_CAPTURE)
def _(flows, spark, sf_dir):
    detailed = _categorised(flows).withColumn("label", F.col("attack_label"))
    return training.clean_training(_raw_capture(detailed)).select(
        "flow_id", "label", "class_label", "flow_duration", "flow_bytes_s"
    )


def _raw_capture(flows: DataFrame) -> DataFrame:
    """The flows as a raw public capture: text, leading blanks in the header, a doubled column.

    Columns the flows do not have are filled with text that counts as a number; an empty packet
    count marks incomplete rows.
    """
    known = {short_name(c): c for c in CANONICAL_COLUMNS}
    values = {known[c]: F.col(c).cast("string") for c in flows.columns if c in known}
    values["Flow Duration"] = F.concat(F.col("total_fwd_packet").cast("string"), F.lit(".7"))
    values["Total Bwd packets"] = F.when(F.col("syn") == 5, "").otherwise(F.col("syn").cast("string"))
    filler = F.col("syn").cast("string")
    columns = [values.get(c, filler).alias(f" {c}") for c in CANONICAL_COLUMNS]
    doubled = CANONICAL_COLUMNS.index("Fwd Header Length") + 20
    columns.insert(doubled, filler.alias(f" {DUPLICATE_HEADER}"))
    return flows.select(*columns)


def _snapshot_contents(flows: DataFrame, spark: SparkSession) -> DataFrame:
    """The contents of all views of one snapshot, stored, so that the snapshot can be closed."""
    path = shared_dir(spark, "views")
    with DaySnapshot(flows) as snapshot:
        snapshot.contents().write.parquet(path)
    return spark.read.parquet(path)


@query("all_views", views_sql("flows", by_day=False))
def _(flows, spark, sf_dir):
    return _snapshot_contents(flows, spark)


@query(
    "empty_views",
    views_sql("empty_day", by_day=False),
    f"empty_day as (select * from flows where flow_date = date '{NO_DAY}')",
)
def _(flows, spark, sf_dir):
    return _snapshot_contents(flows_for_date(flows, NO_DAY), spark)


# --- streams -----------------------------------------------------------------------------------

_NOW = {"availableNow": True}
_STREAMED = [c for c in CANONICAL_COLUMNS if short_name(c) in (
    "flow_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "timestamp_raw",
    "total_length_fwd", "total_length_bwd", "active_mean", "idle_mean", "label", *MODEL_FEATURES,
)]


# Captures are written and scored in so many parts, those read to their end are removed.
_CAPTURE_PARTS = 4


def _write_captures(flows: DataFrame, folder: str) -> None:
    """The flows as capture files with canonical header names."""
    named = flows.select(*[F.col(short_name(c)).alias(c) for c in _STREAMED])
    with shuffles_removed(flows.sparkSession):
        named.write.option("header", "true").csv(folder)


def _run_scoring(flows: DataFrame, spark: SparkSession, scorer):
    """Score the capture files of the flows to the end; the folder of the job's tables.

    Captures come in parts, a run of the job follows each and takes it up where the last one ended.
    Old captures go, as they do where captures are rotated, so no disk holds the text of all flows.
    """
    base = shared_dir(spark, "scoring")
    part = F.pmod(F.xxhash64("flow_id"), F.lit(_CAPTURE_PARTS))
    for i in range(_CAPTURE_PARTS):
        _write_captures(flows.where(part == i), f"{base}/captures")
        _score_captures(spark, base, scorer)
        delete_path(spark, f"{base}/captures")
    return base


def _score_captures(spark: SparkSession, base: str, scorer) -> None:
    job = score_job.start_scoring(
        spark, f"{base}/captures", f"{base}/analysed", f"{base}/quarantine", f"{base}/checkpoint",
        scorer, _STREAMED, _NOW, by_day=False, metrics=f"{base}/metrics",
    )
    job.awaitTermination()


@query(
    "stream_tail",
    "select flow_id, src_ip, cast(src_port as integer) as src_port, protocol, ts, flow_bytes_s, syn, label from flows",
)
def _(flows, spark, sf_dir):
    base = _run_scoring(flows, spark, lambda rows: rows)
    return spark.read.parquet(f"{base}/analysed").select(
        "flow_id", "src_ip", "src_port", "protocol", "ts", "flow_bytes_s", "syn", "label"
    )


@query("stream_score", "select s.flow_id, s.label from scored s where true_label is not null", SCORED)
def _(flows, spark, sf_dir):
    base = _run_scoring(flows, spark, score_job.linear_scorer)
    return spark.read.parquet(f"{base}/analysed").select("flow_id", "label")


@query(
    "stream_metrics",
    """select count(*) + count(*) filter (where protocol in (2, 17)) as rows_in,
         count(*) filter (where protocol in (2, 17)) as malformed,
         count(*) filter (where protocol = 0) as protocol_zero from flows""",
)
def _(flows, spark, sf_dir):
    base = _run_bad_captures(flows, spark)
    names = ["rows_in", "malformed", "protocol_zero"]
    return score_job.batch_metrics(spark, f"{base}/metrics").agg(*[F.sum(n).alias(n) for n in names])


def _run_bad_captures(flows: DataFrame, spark: SparkSession) -> str:
    """Two batches: the flows, and then files whose lines are malformed.

    Flows of protocol 2 come again without their last field, under the full header; those of
    protocol 17 come again under a header that lacks a column.
    """
    base = _run_scoring(flows, spark, score_job.linear_scorer)
    named = flows.select(*[F.col(short_name(c)).alias(c) for c in _STREAMED])
    short = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in _STREAMED[:-1]])
    whole = named.where("Protocol = 2").select(short.alias(",".join(_STREAMED)))
    whole.write.mode("append").option("header", "true").option("sep", "\u0001").csv(f"{base}/captures")
    other = named.where("Protocol = 17").drop(_STREAMED[-1])
    other.write.mode("append").option("header", "true").csv(f"{base}/captures")
    _score_captures(spark, base, score_job.linear_scorer)
    return base


@query(
    "stream_quarantine",
    """select split_part(flow_id, '-', 1) as order_key, count(*) as bad_lines from flows
       where protocol in (2, 17) group by 1""",
)
def _(flows, spark, sf_dir):
    base = _run_bad_captures(flows, spark)
    key = F.split_part(F.regexp_replace("line", '"', ""), F.lit("-"), F.lit(1)).alias("order_key")
    return spark.read.parquet(f"{base}/quarantine").groupBy(key).agg(F.count(F.lit(1)).alias("bad_lines"))


@query(
    "stream_bounded",
    """select count(*) as flows, count(distinct flow_id) as distinct_flows, true as several_batches,
         true as within_limit from flows""",
)
def _(flows, spark, sf_dir):
    """Captures in batches of a fifth of their bytes, by a job that goes on until nothing is left."""
    base = shared_dir(spark, "bounded")
    _write_captures(flows, f"{base}/captures")
    limit = max(1 << 16, folder_bytes(spark, f"{base}/captures") // 5)
    job = score_job.start_scoring(
        spark, f"{base}/captures", f"{base}/analysed", f"{base}/quarantine", f"{base}/checkpoint",
        lambda rows: rows, _STREAMED, {"processingTime": "0 seconds"}, by_day=False, max_bytes_per_trigger=limit,
    )
    try:
        job.processAllAvailable()
        taken = [b for p in job.recentProgress if (b := _bytes_taken(json.loads(p.json)["sources"][0]))]
    finally:
        job.stop()
    # A line longer than the limit would be a batch of its own; these have a few hundred bytes.
    within = F.lit(max(taken, default=0) <= limit).alias("within_limit")
    rows = spark.read.parquet(f"{base}/analysed")
    return rows.agg(
        F.count(F.lit(1)).alias("flows"), F.count_distinct("flow_id").alias("distinct_flows"),
        (F.count_distinct("batch_id") >= 5).alias("several_batches"),
    ).select("*", within)


def _bytes_taken(source: dict) -> int:
    """Bytes of all files between a batch's two offsets; the first batch has no start."""

    def offset(shown) -> dict:
        if isinstance(shown, str):
            return json.loads(shown) if shown.startswith("{") else {}
        return shown or {}

    start, end = offset(source["startOffset"]), offset(source["endOffset"])
    return sum(v[0] - start.get(k, [0])[0] for k, v in end.items())


_RECREATED = "flow_id, src_ip, protocol, flow_bytes_s, syn, label"


@query(
    "stream_recreated",
    f"""select {_RECREATED} from flows
        union all
        select {_RECREATED} from flows where psh % 4 = 0
        qualify row_number() over (partition by syn % 4 order by flow_id) = 1""",
)
def _(flows, spark, sf_dir):
    """Four captures are replaced by longer ones of the same names, headers and first lines.

    The flows of a capture are written anew behind its first one, which therefore comes twice.
    """
    base = shared_dir(spark, "recreated")
    capture, first = F.col("syn") % 4, F.row_number().over(Window.partitionBy(F.col("syn") % 4).orderBy("flow_id")) == 1
    old = flows.where("psh % 4 = 0").withColumn("place", F.lit(1))
    heads = old.withColumn("first", first).where("first").drop("first").withColumn("place", F.lit(0))
    longer = heads.unionByName(flows.where("psh % 4 <> 0").withColumn("place", F.lit(1)))
    half = F.coalesce(capture.isin(0, 1), F.lit(False))
    # All captures, then two and the others anew; those that were read to their end twice are removed.
    for part, rows in enumerate((old, longer.where(half), longer.where(~half))):
        folder, written = f"{base}/new-{part}", []
        named = rows.withColumn("capture", capture).repartition("capture").sortWithinPartitions("capture", "place", "flow_id")
        columns = [F.col(short_name(c)).alias(c) for c in _STREAMED]
        with shuffles_removed(spark):
            named.select(*columns, "capture").write.partitionBy("capture").option("header", "true").csv(folder)
        for name in child_names(spark, folder):
            for file in child_names(spark, f"{folder}/{name}"):
                if file.endswith(".csv"):
                    written.append(f"{base}/captures/{name}.csv")
                    move_path(spark, f"{folder}/{name}/{file}", written[-1])
        _score_captures(spark, base, lambda rows: rows)
        for path in written if part else []:
            delete_path(spark, path)
    return spark.read.parquet(f"{base}/analysed").select(*[c.strip() for c in _RECREATED.split(",")])


def _refresh_in_parts(flows: DataFrame, spark: SparkSession) -> tuple[str, list[int]]:
    """Flows arrive in three appends, by line number; a run follows each, and one without new flows.

    The folder of the views, and the newest version before each run.
    """
    base, seen = shared_dir(spark, "refresh"), []
    columns = [c for c in VIEW_COLUMNS if c in flows.columns]
    rows = flows.select("flow_date", *columns)
    for part in range(4):
        if part < 3:
            with shuffles_removed(spark):
                write_analysed(rows.where(F.col("syn") % 3 == part), f"{base}/store", part, by_day=False)
        schema = spark.read.parquet(f"{base}/store").schema
        newest = refresh.current_versions(spark, f"{base}/views").agg(F.max("version")).first()[0]
        seen.append(-1 if newest is None else newest)
        refresh.start_refresh(
            spark, f"{base}/store", schema, f"{base}/views", f"{base}/checkpoint", trigger=_NOW
        ).awaitTermination()
    return f"{base}/views", seen


@query("stream_refresh", digest_sql("flows"))
def _(flows, spark, sf_dir):
    views, _ = _refresh_in_parts(flows, spark)
    rows = long_form({name: refresh.read_days(spark, views, name) for name in DAY_VIEWS}, "flow_date")
    return digest(rows, "flow_date")


@query(
    "stream_notify",
    """select flow_date, cast(max(syn % 3) as bigint) as version, bool_or(syn % 3 = 2) as newer_than_second,
         false as newer_than_third from flows group by flow_date""",
)
def _(flows, spark, sf_dir):
    views, seen = _refresh_in_parts(flows, spark)
    newer = [
        refresh.changed_days(spark, views, version).select("flow_date", F.lit(True).alias(name))
        for version, name in ((seen[2], "newer_than_second"), (seen[3], "newer_than_third"))
    ]
    days = refresh.changed_days(spark, views)
    for days_then in newer:
        days = days.join(days_then, "flow_date", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("newer_than_second", "newer_than_third")]
    return days.select("flow_date", "version", *flags)


def _run_updates(view: DataFrame, spark: SparkSession, key: str) -> DataFrame:
    base = shared_dir(spark, "live")
    live.start_updates(view, f"{base}/updates", f"{base}/checkpoint", _NOW).awaitTermination()
    return live.current_state(live.read_updates(spark, f"{base}/updates", view), key)


@query("stream_trend", "select * from trend", TREND)
def _(flows, spark, sf_dir):
    base = shared_dir(spark, "live")
    live.start_trend(flow_stream(spark, sf_dir), f"{base}/sums", f"{base}/checkpoint", _NOW).awaitTermination()
    return rounded(live.read_trend(spark, f"{base}/sums"), 2, "bytes", "packets")


@query("stream_patterns")
def _(flows, spark, sf_dir):
    totals = _run_updates(live.live_pattern_totals(flow_stream(spark, sf_dir)), spark, "ip")
    return anomaly.patterns_from_totals(totals)


ORACLES["stream_patterns"] = ORACLES["suspicious_patterns"]
