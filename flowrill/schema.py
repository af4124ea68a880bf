"""The flow schema: canonical capture header, types and the short column names of the operators."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# The canonical capture header, in file order.
CANONICAL_COLUMNS = [
    "Flow ID", "Src IP", "Src Port", "Dst IP", "Dst Port", "Protocol", "Timestamp",
    "Flow Duration", "Total Fwd Packet", "Total Bwd packets",
    "Total Length of Fwd Packet", "Total Length of Bwd Packet",
    "Fwd Packet Length Max", "Fwd Packet Length Min",
    "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min",
    "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s",
    "Packet Length Min", "Packet Length Max", "Packet Length Mean",
    "Packet Length Std", "Packet Length Variance",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count",
    "ACK Flag Count", "URG Flag Count", "CWR Flag Count", "ECE Flag Count",
    "Down/Up Ratio", "Average Packet Size", "Fwd Segment Size Avg", "Bwd Segment Size Avg",
    "Fwd Bytes/Bulk Avg", "Fwd Packet/Bulk Avg", "Fwd Bulk Rate Avg",
    "Bwd Bytes/Bulk Avg", "Bwd Packet/Bulk Avg", "Bwd Bulk Rate Avg",
    "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "FWD Init Win Bytes", "Bwd Init Win Bytes", "Fwd Act Data Pkts", "Fwd Seg Size Min",
    "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min", "Label",
]

# Fixed value: the duplicate header column of the public captures.
DUPLICATE_HEADER = "Fwd Header Length.1"

STRING_COLUMNS = {"Flow ID", "Src IP", "Dst IP", "Timestamp", "Label"}
INT_COLUMNS = {"Src Port", "Dst Port", "Protocol"}
BIGINT_COLUMNS = {
    "Flow Duration", "Total Fwd Packet", "Total Bwd packets",
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Length", "Bwd Header Length",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count",
    "ACK Flag Count", "URG Flag Count", "CWR Flag Count", "ECE Flag Count",
    "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "FWD Init Win Bytes", "Bwd Init Win Bytes", "Fwd Act Data Pkts", "Fwd Seg Size Min",
}

# Short names of the columns the operators read; every other column gets its snake-case form.
_SHORT = {
    "Timestamp": "timestamp_raw",
    "Total Length of Fwd Packet": "total_length_fwd",
    "Total Length of Bwd Packet": "total_length_bwd",
    "FIN Flag Count": "fin",
    "SYN Flag Count": "syn",
    "RST Flag Count": "rst",
    "PSH Flag Count": "psh",
    "ACK Flag Count": "ack",
    "URG Flag Count": "urg",
    "CWR Flag Count": "cwr",
    "ECE Flag Count": "ece",
}

# The model's features, in the order the model expects.
MODEL_FEATURES = [
    "flow_duration", "total_fwd_packet", "fwd_packet_length_mean",
    "flow_bytes_s", "flow_packets_s", "flow_iat_mean", "fin", "syn", "rst", "ack",
]

# Identifier and label columns that are never features.
IDENTIFIER_COLUMNS = [
    "flow_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol",
    "timestamp_raw", "label", "class_label",
]

RATE_COLUMNS = ["flow_bytes_s", "flow_packets_s"]


def short_name(column: str) -> str:
    """Operator-side name of a canonical column, e.g. ``Flow Bytes/s`` -> ``flow_bytes_s``."""
    column = column.strip()
    if column in _SHORT:
        return _SHORT[column]
    return re.sub(r"[^a-z0-9]+", "_", column.lower()).strip("_")


def column_type(column: str) -> T.DataType:
    """Spark type of a canonical column."""
    if column in STRING_COLUMNS:
        return T.StringType()
    if column in INT_COLUMNS:
        return T.IntegerType()
    if column in BIGINT_COLUMNS:
        return T.LongType()
    return T.DoubleType()


def text_schema(columns: list[str] | None = None) -> T.StructType:
    """Every column as text: the safe way to read a capture before typing it."""
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in (columns or CANONICAL_COLUMNS)]
    )


def typed_schema() -> T.StructType:
    """Schema of a typed flow table under its short names."""
    return T.StructType(
        [T.StructField(short_name(c), column_type(c)) for c in CANONICAL_COLUMNS]
        + [T.StructField("ts", T.TimestampNTZType()), T.StructField("flow_date", T.DateType())]
    )
