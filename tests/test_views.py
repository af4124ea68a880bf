"""Views of a snapshot, of days, and of days that grow batch by batch hold the same rows."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowrill.plans.catalog import NO_DAY, QUERIES
from flowrill.plans.day_states import DAY_VIEWS, STATES, day_view, merged, state_of
from flowrill.plans.views import VIEW_ITEMS, VIEWS, DaySnapshot, long_form
from flowrill.sources.day_store import flows_for_date
from flowrill.sources.driver_tables import flows_from_tables
from flowrill.streaming import refresh


def shown(df):
    return Counter(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())


@pytest.fixture(scope="module")
def quarters(spark, sf_dir):
    """The flows with three whole quarters as their days."""
    flows = flows_from_tables(spark, sf_dir)
    day = F.date_trunc("quarter", F.col("ts")).cast("date")
    some = flows.withColumn("flow_date", day).where("flow_date >= '1996-01-01' and flow_date < '1996-10-01'")
    return some.cache()


def test_all_views_returns_contents(spark, sf_dir):
    rows = QUERIES["all_views"](spark, sf_dir).collect()
    assert {r.view for r in rows} == set(VIEWS) == set(DAY_VIEWS) == set(VIEW_ITEMS)
    with DaySnapshot(flows_from_tables(spark, sf_dir)) as snapshot:
        counts = {r.view: r.n_rows for r in snapshot.row_counts().collect()}
    assert Counter(r.view for r in rows) == {v: n * len(VIEW_ITEMS[v][1]) for v, n in counts.items()}


def test_empty_views_are_the_views_defaults(spark, sf_dir):
    rows = QUERIES["empty_views"](spark, sf_dir).collect()
    with DaySnapshot(flows_for_date(flows_from_tables(spark, sf_dir), NO_DAY)) as snapshot:
        assert shown(snapshot.contents()) == Counter(str(list(r)) for r in rows)
    assert {(r.view, r.item) for r in rows if r.value == 0} >= {("network_summary", ""), ("attack_stats", "DoS|high")}
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_merged_states_give_the_views_of_each_day(quarters):
    parts = [quarters.where(f"syn % 3 = {i}") for i in range(3)]
    states = {}
    for name in STATES:
        one, two, three = (state_of(p, name) for p in parts)
        states[name] = merged(merged(three.unionByName(one), name).unionByName(two), name).cache()
    for day in ("1996-01-01", "1996-07-01"):
        snapshot = DaySnapshot(quarters.where(F.col("flow_date") == day))
        for name in VIEWS:
            view = day_view(states, name).where(F.col("flow_date") == day).drop("flow_date")
            assert view.columns == snapshot.view(name).columns
            assert shown(view) == shown(snapshot.view(name)), name
        snapshot.close()


def test_refresh_merges_batches_repeats_and_new_checkpoints(spark, quarters, tmp_path):
    out = str(tmp_path / "views")
    names = ["network_summary", "machine_details", "recent_rates"]

    def check(flows):
        for name in names:
            view = refresh.read_days(spark, out, name)
            whole = {n: state_of(flows, n) for n in STATES}
            assert shown(view) == shown(day_view(whole, name).select(view.columns))

    def versions():
        return {r.flow_date: r.version for r in refresh.current_versions(spark, out).collect()}

    old, new = quarters.where("flow_date < '1996-07-01'"), quarters.where("flow_date >= '1996-04-01'")
    late = old.unionByName(new)  # the second quarter comes twice
    refresh.publish(spark, old, out, 0, "one", names)
    assert versions() == {dt.date(1996, 1, 1): 0, dt.date(1996, 4, 1): 0}
    for _ in range(2):  # a repeated batch is announced already
        refresh.publish(spark, new, out, 1, "one", names)
    assert versions() == {dt.date(1996, 1, 1): 0, dt.date(1996, 4, 1): 1, dt.date(1996, 7, 1): 1}
    check(late)
    assert refresh.changed_days(spark, out, 0).count() == 2 and refresh.changed_days(spark, out, 1).count() == 0
    refresh.publish(spark, quarters, out, 0, "two", names)  # a new checkpoint reads everything again
    assert set(versions().values()) == {2}
    check(quarters)
    refresh.publish(spark, old.limit(0), out, 1, "two", names)
    assert refresh.changed_days(spark, out, 2).count() == 0
    for _ in range(2):
        refresh.publish(spark, old, out, 2, "two", names)
        refresh.publish(spark, old, out, 3, "two", names)
    kept = {p.name for p in (tmp_path / "views" / "network_summary").iterdir()}
    assert kept == {"version=2", "version=4", "version=5"}  # the newest of each day, and the last two
    check(quarters.unionByName(old).unionByName(old))


def test_whole_manifests_replace_their_parts(spark, quarters, tmp_path, monkeypatch):
    monkeypatch.setattr(refresh, "FULL_MANIFEST_EVERY", 2)
    out, names = str(tmp_path / "v"), ["network_summary"]
    days = ["1996-01-01", "1996-04-01", "1996-07-01", "1996-04-01"]
    for i, day in enumerate(days):
        refresh.publish(spark, quarters.where(F.col("flow_date") == day), out, i, "g", names)
    assert {str(r.flow_date): r.version for r in refresh.current_versions(spark, out).collect()} == {
        "1996-01-01": 0, "1996-04-01": 3, "1996-07-01": 2,
    }
    assert {p.name for p in (tmp_path / "v" / "_manifest").iterdir()} == {"part=3"}


def test_long_form_keeps_missing_numbers(make_flows):
    rows = long_form({"suspicious_patterns": VIEWS["suspicious_patterns"](make_flows({"rst": 40}))}).collect()
    assert {(r.metric, r.value) for r in rows} == {
        ("syn_count", None), ("ack_count", None), ("ratio", None), ("rst_count", 40.0), ("packets_per_sec", None),
    }
