"""Protocol names, labels, endpoints and timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Protocol numbers by display context.
SUMMARY_PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP"}
TRAFFIC_PROTOCOLS = {0: "HOPOPT", 1: "ICMP", 6: "TCP", 17: "UDP"}
LOG_PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP"}

# Attack label to category.
ATTACK_CATEGORIES = {
    "BENIGN": "BENIGN",
    "DoS Hulk": "DoS",
    "DoS GoldenEye": "DoS",
    "DoS slowloris": "DoS",
    "DoS Slowhttptest": "DoS",
    "DDoS": "DDoS",
    "PortScan": "PortScan",
    "FTP-Patator": "Brute Force",
    "SSH-Patator": "Brute Force",
    "Web Attack \x96 Brute Force": "Web Attack",
    "Web Attack \x96 XSS": "Web Attack",
    "Web Attack \x96 Sql Injection": "Web Attack",
    "Bot": "Bot",
    "Infiltration": "Infiltration",
    "Heartbleed": "Vulnerability Exploit",
}
UNKNOWN_CATEGORY = "Unknown"

BENIGN = "BENIGN"
DOS = "DoS"
SCORED_LABELS = [BENIGN, DOS]


def _named(protocol: Column | str, names: dict[int, str], otherwise: Column) -> Column:
    col = F.col(protocol) if isinstance(protocol, str) else protocol
    expr = F
    for number, name in names.items():
        expr = expr.when(col == number, F.lit(name))
    return expr.otherwise(otherwise)


def protocol_name_summary(protocol: Column | str = "protocol") -> Column:
    return _named(protocol, SUMMARY_PROTOCOLS, F.lit("OTHER"))


def protocol_name_traffic(protocol: Column | str = "protocol") -> Column:
    return _named(protocol, TRAFFIC_PROTOCOLS, F.lit("OTHER"))


def protocol_name_log(protocol: Column | str = "protocol") -> Column:
    col = F.col(protocol) if isinstance(protocol, str) else protocol
    return _named(col, LOG_PROTOCOLS, F.concat(F.lit("Protocol "), col.cast("string")))


def protocol_text_summary(protocol: Column | str) -> Column:
    """Summary bucket of a protocol that arrives as text: a number, or a name in any case."""
    col = F.col(protocol) if isinstance(protocol, str) else protocol
    number = F.trim(col).try_cast("double")
    upper = F.upper(col)
    by_name = F.when(upper.isin("TCP", "UDP", "ICMP"), upper).otherwise(F.lit("OTHER"))
    return F.when(number.isNotNull(), protocol_name_summary(number)).otherwise(by_name)


def attack_category(label: Column | str = "label") -> Column:
    """Category of a detailed attack label, ``Unknown`` when it is not listed.

    One lookup that names the label once: a branch for each category would repeat it, and whatever
    it is made of, in every filter on the category.
    """
    col = F.col(label) if isinstance(label, str) else label
    known = F.create_map(*[F.lit(text) for pair in ATTACK_CATEGORIES.items() for text in pair])
    return F.coalesce(F.try_element_at(known, col), F.lit(UNKNOWN_CATEGORY))


def is_attack(label: Column | str = "label") -> Column:
    """Anything but BENIGN is an attack, a missing label included."""
    col = F.col(label) if isinstance(label, str) else label
    return ~col.eqNullSafe(F.lit(BENIGN))


def label_or_benign(label: Column | str = "label") -> Column:
    """A missing or empty label is read as BENIGN."""
    col = F.col(label) if isinstance(label, str) else label
    return F.when(col.isNull() | (col == ""), F.lit(BENIGN)).otherwise(col)


def has_text(value: Column | str) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    return col.isNotNull() & (col != "")


def endpoint(ip: Column | str, port: Column | str) -> Column:
    """``ip:port``; a missing part is left empty."""
    ip_col = F.col(ip) if isinstance(ip, str) else ip
    port_col = F.col(port) if isinstance(port, str) else port
    return F.concat_ws(
        ":", F.coalesce(ip_col, F.lit("")), F.coalesce(port_col.cast("string"), F.lit(""))
    )


def parse_flow_timestamp(text: Column | str = "timestamp_raw") -> Column:
    """Day-first 12-hour text to ``TIMESTAMP_NTZ``; other common forms as fallback, junk to null.

    The second form keeps a 24-hour value that carries a redundant AM/PM mark; the others are the
    month-first and ISO forms of a default date parser.
    """
    col = F.trim(F.col(text) if isinstance(text, str) else text)
    unmarked = F.regexp_replace(col, r"(?i)\s*[ap]m$", "")
    return F.coalesce(
        F.try_to_timestamp(col, F.lit("d/M/yyyy h:mm:ss a")),
        F.when(unmarked != col, F.try_to_timestamp(unmarked, F.lit("d/M/yyyy H:mm:ss"))),
        F.try_to_timestamp(col, F.lit("M/d/yyyy H:mm[:ss]")),
        F.try_to_timestamp(col),
    ).cast("timestamp_ntz")


def time_text(text: Column | str = "timestamp_raw", pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Display form of a timestamp, the original text when it cannot be parsed."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.date_format(parse_flow_timestamp(col), pattern), col)
