from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowrill.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", 8,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.codegen.cache.maxEntries": "500"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="module", autouse=True)
def _own_caches(spark):
    """What a module's fixtures cached goes at its end."""
    yield
    spark.catalog.clearCache()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


_DEFAULTS = {
    "flow_id": "f", "src_ip": "1.1.1.1", "src_port": 1000, "dst_ip": "2.2.2.2", "dst_port": 80,
    "protocol": 6, "ts": "2024-01-15T10:00:00", "flow_duration": 10.0, "total_fwd_packet": 1,
    "total_bwd_packets": 1, "total_length_fwd": 100.0, "total_length_bwd": 50.0,
    "fwd_packet_length_mean": 10.0, "flow_bytes_s": 10.0, "flow_packets_s": 1.0,
    "flow_iat_mean": 1.0, "fin": 0, "syn": 0, "rst": 0, "psh": 0, "ack": 0, "urg": 0, "cwr": 0,
    "ece": 0, "active_mean": 0.0, "idle_mean": 0.0, "label": "BENIGN",
}
_SCHEMA = (
    "flow_id string, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, "
    "ts string, flow_duration double, total_fwd_packet bigint, total_bwd_packets bigint, "
    "total_length_fwd double, total_length_bwd double, fwd_packet_length_mean double, "
    "flow_bytes_s double, flow_packets_s double, flow_iat_mean double, fin bigint, syn bigint, "
    "rst bigint, psh bigint, ack bigint, urg bigint, cwr bigint, ece bigint, active_mean double, "
    "idle_mean double, label string"
)


@pytest.fixture(scope="session")
def make_flows(spark):
    """Flow table from partial rows; what a row leaves out gets a default, ids count up."""

    def build(*rows):
        filled = []
        for i, row in enumerate(rows):
            full = {**_DEFAULTS, "flow_id": f"f{i:04d}", **row}
            filled.append(tuple(full[c] for c in _DEFAULTS))
        df = spark.createDataFrame(filled, _SCHEMA)
        return df.withColumn("ts", df.ts.cast("timestamp_ntz"))

    return build
