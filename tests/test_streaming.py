"""Tail source, exactly-once scoring, restart, re-created files, refresh and live views."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from flowrill.plans import catalog
from flowrill.plans.day_states import STATES, merged, state_rows
from flowrill.schema import CANONICAL_COLUMNS, short_name
from flowrill.session import path_exists, shuffles_removed
from flowrill.sources.day_store import write_analysed
from flowrill.sources.tail import FORGOTTEN, CaptureTailReader, tail_captures
from flowrill.streaming import live, refresh, score_job
from flowrill.streaming.ingest import parse_lines, typed_lines

HEADER = ",".join(CANONICAL_COLUMNS)
NOW = {"availableNow": True}


def row(number: int, protocol: int = 6, rate: str = "5000", day: str = "15/01/2024", **changed) -> str:
    values = {c: "1" for c in CANONICAL_COLUMNS}
    values.update({
        "Flow ID": f"flow-{number}", "Src IP": f"10.0.0.{number % 3}", "Dst IP": "10.1.0.1",
        "Protocol": str(protocol), "Timestamp": f"{day} 10:00:{number % 60:02d} AM",
        "Flow Packets/s": rate, "Label": "No Label",
    })
    values.update(changed)
    return ",".join(values[c] for c in CANONICAL_COLUMNS)


class Job:
    def __init__(self, spark, tmp_path):
        self.spark, self.base = spark, tmp_path
        self.folder = tmp_path / "daily"
        self.folder.mkdir()

    def file(self, name="2024-01-15_Flow.csv"):
        return self.folder / name

    def append(self, text, name="2024-01-15_Flow.csv"):
        with open(self.file(name), "a") as out:
            out.write(text)

    def run(self, scorer=score_job.linear_scorer, **options):
        query = score_job.start_scoring(
            self.spark, str(self.folder), str(self.base / "analysed"), str(self.base / "bad"),
            str(self.base / "checkpoint"), scorer, trigger=NOW,
            metrics=str(self.base / "metrics"), **options,
        )
        query.awaitTermination()
        return query

    def scored(self):
        return self.spark.read.parquet(str(self.base / "analysed"))

    def ids(self):
        return sorted(r["flow_id"] for r in self.scored().select("flow_id").collect())


@pytest.fixture
def job(spark, tmp_path):
    return Job(spark, tmp_path)


def test_three_appends_equal_one_batch(spark, job):
    job.append(HEADER + "\n" + "".join(row(i) + "\n" for i in range(5)))
    job.run()
    job.append("".join(row(i, protocol=0 if i == 6 else 6) + "\n" for i in range(5, 10)))
    job.append(row(99)[:40])  # half-written: waits
    job.run()
    assert job.ids() == sorted(f"flow-{i}" for i in range(10) if i != 6)
    job.append(row(99)[40:] + "\n" + row(10) + "\n")
    job.run()
    whole = parse_lines(
        spark.read.text(str(job.file())).where(F.col("value") != HEADER)
        .select(F.lit("f").alias("source_file"), F.lit(0).alias("position"),
                F.lit(True).alias("header_ok"), F.col("value").alias("line"))
    )
    batch = score_job.linear_scorer(typed_lines(whole)).select("flow_id", "label").collect()
    stream = job.scored().select("flow_id", "label").collect()
    assert sorted(map(tuple, stream)) == sorted(map(tuple, batch))
    assert len(stream) == 11


def test_nothing_new_changes_nothing(job):
    job.append(HEADER + "\n" + row(1) + "\n")
    job.run()
    job.run()
    assert job.ids() == ["flow-1"]


def test_bad_lines_are_kept_apart_and_do_not_stop_the_job(spark, job):
    job.append(HEADER + "\n" + row(1) + "\nshort,line\n" + row(2) + ",extra\n" + row(3, rate="Infinity") + "\n")
    job.append(row(4, rate="abc") + "\n" + row(5) + "\n")
    job.run()
    assert job.ids() == ["flow-1", "flow-5"]
    bad = spark.read.parquet(str(job.base / "bad"))
    assert {r["line"][:10] for r in bad.collect()} == {"short,line", row(2)[:10]}
    (metrics,) = score_job.batch_metrics(spark, str(job.base / "metrics")).collect()
    assert (metrics.rows_in, metrics.malformed, metrics.protocol_zero) == (6, 2, 0)


def test_executors_hold_no_batch_and_its_table_is_deleted(spark, job):
    job.append(HEADER + "\n" + row(1) + "\nshort,line\n" + row(2, protocol=0) + "\n")
    held = spark.sparkContext._jsc.getPersistentRDDs
    before, during = set(held()), []

    def scorer(flows):
        during.append(set(held()) - before)
        return score_job.linear_scorer(flows)

    job.run(scorer)
    assert during == [set()]
    assert job.ids() == ["flow-1"]
    assert [r["line"] for r in spark.read.parquet(str(job.base / "bad")).collect()] == ["short,line"]
    assert not list((job.base / "checkpoint" / "parsed").glob("[!.]*"))


def test_metrics_keep_every_batch(spark, job):
    assert score_job.batch_metrics(spark, str(job.base / "metrics")).count() == 0
    for i in range(4):
        job.append((HEADER + "\n" if not i else "") + row(i, protocol=0) + "\n")
        job.run()
    rows = score_job.batch_metrics(spark, str(job.base / "metrics")).collect()
    assert sorted((r.batch_id, r.rows_in, r.protocol_zero) for r in rows) == [(i, 1, 1) for i in range(4)]


def test_recreated_and_shrunk_files_start_over(job):
    job.append(HEADER + "\n" + "".join(row(i) + "\n" for i in range(4)))
    job.run()
    job.file().write_text(HEADER + "\n" + row(50) + "\n")  # shrunk
    job.run()
    job.file().write_text(HEADER + "\n" + "".join(row(60 + i) + "\n" for i in range(6)))  # longer, new
    job.run()
    assert job.ids() == sorted([f"flow-{i}" for i in range(4)] + ["flow-50"] + [f"flow-{60 + i}" for i in range(6)])


def test_unexpected_header_goes_to_quarantine(spark, job):
    job.append("a,b\n1,2\n", "2024-01-16_Flow.csv")
    job.append(HEADER + "\n" + row(1) + "\n")
    job.run()
    assert job.ids() == ["flow-1"]
    assert spark.read.parquet(str(job.base / "bad")).count() == 1


@pytest.mark.parametrize("range_bytes", [1, 7, 100, 1000, 10**9])
def test_byte_ranges_give_every_line_once(tmp_path, range_bytes):
    lines = [f"line-{i}-" + "x" * (i % 13) for i in range(200)]
    (tmp_path / "a.csv").write_text("h1,h2\n" + "\n".join(lines) + "\nhalf")
    reader = CaptureTailReader({"path": str(tmp_path), "rangebytes": str(range_bytes)})
    end = reader.latestOffset()
    found = []
    for part in reader.partitions({}, end):
        for batch in reader.read(part):
            found += batch.column("line").to_pylist()
    assert found == lines
    with open(tmp_path / "a.csv", "a") as out:
        out.write("-done\nnext\n")
    newer = reader.latestOffset()
    more = []
    for part in reader.partitions(end, newer):
        for batch in reader.read(part):
            more += batch.column("line").to_pylist()
    assert more == ["half-done", "next"]


def test_old_days_leave_the_offset(tmp_path):
    for day in ("2024-01-01", "2024-01-15"):
        (tmp_path / f"{day}_Flow.csv").write_text("h\n1\n")
    reader = CaptureTailReader({"path": str(tmp_path), "maxagedays": "3", "today": "2024-01-16"})
    assert set(reader.latestOffset()) == {"2024-01-15_Flow.csv", FORGOTTEN}


def test_unread_rows_are_not_forgotten(tmp_path):
    def reader(today):
        return CaptureTailReader({"path": str(tmp_path), "maxagedays": "3", "today": today})

    old = tmp_path / "2024-01-15_Flow.csv"
    old.write_text("h\n1\n")
    start = reader("2024-01-16").latestOffset()
    end = reader("2024-01-30").latestOffset()
    assert reader("2024-01-30").partitions(start, end) == []
    old.write_text("h\n1\n2\n")  # grew while the job was down
    with pytest.raises(ValueError, match="2024-01-15"):
        reader("2024-01-30").partitions(start, end)
    old.write_text("h\n1\n")
    (tmp_path / "2024-01-20_Flow.csv").write_text("h\n1\n")  # came and went while it was down
    with pytest.raises(ValueError, match="2024-01-20"):
        reader("2024-01-30").partitions(start, end)


@pytest.mark.parametrize("parts", [0, 1, 4])
def test_streams_of_tables(spark, sf_dir, tmp_path, parts):
    """A table as one file or as a folder, each file a batch of its own: no row is late."""
    from flowrill.operators import anomaly, traffic
    from flowrill.sources.driver_tables import flow_stream, flows_from_tables

    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    spark.read.parquet(f"{sf_dir}/orders.parquet").write.parquet(str(tmp_path / "orders.parquet"))
    if parts:
        table.repartition(parts).write.parquet(str(tmp_path / "lineitem.parquet"))
        folder = str(tmp_path)
    else:
        folder = sf_dir
    for view, key, batch in (
        (live.live_trend, "ts", traffic.traffic_trend),
        (live.live_pattern_totals, "ip", lambda f: live.live_pattern_totals(f)),
    ):
        updates = view(flow_stream(spark, folder))
        out = str(tmp_path / f"out-{key}")
        assert live.read_updates(spark, out, updates).count() == 0
        live.start_updates(updates, out, str(tmp_path / f"cp-{key}"), NOW).awaitTermination()
        got = live.current_state(live.read_updates(spark, out, updates), key)
        rounded = lambda df: sorted(str([round(v, 4) if isinstance(v, float) else v for v in r]) for r in df.collect())
        assert rounded(got) == rounded(batch(flows_from_tables(spark, folder)))


def test_dropped_rows_are_counted(spark, make_flows, tmp_path):
    listener = live.DroppedRows()
    spark.streams.addListener(listener)
    try:
        schema = make_flows({}).schema
        folder, out = str(tmp_path / "in"), str(tmp_path / "out")
        for day in ("2024-01-15", "2024-01-20", "2024-01-10"):
            make_flows({"ts": f"{day}T10:00:00"}).write.mode("append").parquet(folder)
            stream = live.live_trend(spark.readStream.schema(schema).parquet(folder), late="1 hour")
            live.start_updates(stream, out, str(tmp_path / "cp"), NOW).awaitTermination()
        for _ in range(100):
            if sum(listener.rows.values()) == 1:
                break
            time.sleep(0.1)
        assert list(listener.rows.values()) == [1]
    finally:
        spark.streams.removeListener(listener)


def test_long_running_trigger(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    path = folder / "2024-01-15_Flow.csv"
    path.write_text("h\n1\n")
    query = (
        tail_captures(spark, str(folder)).writeStream
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(processingTime="1 second")
        .format("parquet").option("path", str(tmp_path / "out")).start()
    )
    try:
        query.processAllAvailable()
        with open(path, "a") as out:
            out.write("2\n3\n")
        query.processAllAvailable()
    finally:
        query.stop()
    lines = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["line"] for r in lines.collect()) == ["1", "2", "3"]


def test_days_of_a_store_are_pruned(spark, make_flows, tmp_path):
    from flowrill.sources.day_store import flows_for_date

    path = str(tmp_path / "store")
    write_analysed(make_flows({"ts": "2024-01-15T10:00:00"}, {"ts": "2024-01-16T10:00:00"}), path)
    day = flows_for_date(spark.read.parquet(path), "2024-01-15")
    plan = day._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "flow_date" in filters and day.count() == 1


def test_repeated_batch_is_written_once(spark, make_flows, tmp_path):
    flows = make_flows({}, {"ts": "2024-01-16T00:00:00"})
    for _ in range(2):
        write_analysed(flows, str(tmp_path / "s"), 7)
    write_analysed(flows.limit(1), str(tmp_path / "s"), 8)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3


def test_refresh_follows_new_batches_only(spark, make_flows, tmp_path):
    store, views = str(tmp_path / "store"), str(tmp_path / "views")
    day = dt.date(2024, 1, 15)
    write_analysed(make_flows({}, {"label": "DoS"}), store, 0)
    schema = spark.read.parquet(store).schema

    def run():
        refresh.start_refresh(
            spark, store, schema, views, str(tmp_path / "cp"), ["network_summary", "attack_stats"], NOW
        ).awaitTermination()

    run()
    first = refresh.latest_version(spark, views, day)
    run()  # nothing new: no new version
    assert refresh.latest_version(spark, views, day) == first
    write_analysed(make_flows({"flow_id": "n1"}), store, 1)
    run()
    assert refresh.latest_version(spark, views, day)[0] > first[0]
    summary = refresh.read_view(spark, views, day, "network_summary").collect()[0]
    assert summary["attack_count"] == 1
    stats = refresh.read_view(spark, views, day, "attack_stats").collect()
    assert {r["attack_type"]: r["flows"] for r in stats} == {"BENIGN": 2, "DoS": 1}


def test_a_batch_is_merged_in_one_exchange_and_old_states_go(spark, make_flows, tmp_path):
    views, days = str(tmp_path / "views"), ["2024-01-15T10:00:00", "2024-01-16T10:00:00"]
    for batch, ts in enumerate([days, days, days[:1]]):
        refresh.publish(spark, make_flows(*[{"ts": t, "flow_id": f"{batch}-{t}"} for t in ts]), views, batch, "g")
        kept = {n: set(refresh.child_names(spark, f"{views}/_state/{n}")) for n in STATES}
        # The second day's states are of the second version still.
        assert all(k == {f"version={v}" for v in {min(batch, 1), batch}} for k in kept.values())
        assert not refresh.child_names(spark, f"{views}/_batch")
    counts = {r["flow_date"].day: r["total_connections"] for r in refresh.read_days(spark, views, "network_summary").collect()}
    assert counts == {15: 1, 16: 1}
    for name in STATES:
        rows = state_rows(make_flows({}), name)
        plan = merged(rows.unionByName(rows), name)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


def test_live_updates_over_several_batches(spark, make_flows, tmp_path):
    source = str(tmp_path / "src")
    parts = [
        make_flows({"syn": 15}, {"syn": 3, "src_ip": "9.9.9.9"}),
        make_flows({"syn": 10, "flow_id": "later"}),
    ]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        live.start_updates(
            live.live_pattern_totals(stream), str(tmp_path / "out"), str(tmp_path / "cp"), NOW
        ).awaitTermination()
    state = live.current_state(spark.read.parquet(str(tmp_path / "out")), "ip")
    assert {r["ip"]: r["syn"] for r in state.collect()} == {"1.1.1.1": 25, "9.9.9.9": 3}


def read_all(reader, start, end):
    return [
        line for part in reader.partitions(start, end) for batch in reader.read(part) for line in batch.column("line").to_pylist()
    ]


def bounded(tmp_path, limit, **options):
    return CaptureTailReader({
        "path": str(tmp_path / "in"), "maxbytespertrigger": str(limit), "planlog": str(tmp_path / "log"),
        "rangebytes": "50", **options,
    })


@pytest.mark.parametrize("limit", [1, 20, 64, 10**6])
def test_a_trigger_takes_a_bounded_number_of_bytes(tmp_path, limit):
    (tmp_path / "in").mkdir()
    lines = {name: [f"{name}-{i}-" + "x" * (i % 30) for i in range(40)] for name in ("a", "b")}
    for name, own in lines.items():
        (tmp_path / "in" / f"{name}.csv").write_text("h\n" + "\n".join(own) + "\n")
    start, found, batches = {}, [], 0
    while True:
        reader = bounded(tmp_path, limit)  # every batch by a restarted job
        end = reader.latestOffset()
        assert reader.latestOffset() == end
        if end == start:
            break
        new = read_all(reader, start, end)
        assert sum(o[0] - start.get(n, [0])[0] for n, o in end.items()) <= max(limit, 36)  # the longest line
        found += new
        start, batches = end, batches + 1
    assert found == lines["a"] + lines["b"]
    assert batches == (1 if limit == 10**6 else batches) and (limit > 64 or batches > 20)
    assert len(list((tmp_path / "log").iterdir())) <= 2


def test_a_planned_batch_is_repeated_and_the_next_follows_it(tmp_path):
    (tmp_path / "in").mkdir()
    file = tmp_path / "in" / "a.csv"
    file.write_text("h\n" + "".join(f"row-{i}\n" for i in range(10)))
    one = bounded(tmp_path, 16).latestOffset()  # ended before the plan was written down
    assert bounded(tmp_path, 16).latestOffset() == one
    assert read_all(bounded(tmp_path, 16), {}, one) == read_all(bounded(tmp_path, 16), {}, one) == ["row-0", "row-1"]
    (tmp_path / "log" / "000000000007").write_text('{"a.c')  # an entry cut off
    reader = bounded(tmp_path, 16)
    two = reader.latestOffset()
    assert read_all(reader, one, two) == ["row-2", "row-3"]
    with pytest.raises(ValueError, match="plan_log"):
        CaptureTailReader({"path": str(tmp_path), "maxbytespertrigger": "5"})


@pytest.mark.parametrize("limit", [None, 10**6, 3000])
def test_a_longer_file_with_the_same_first_line_is_read_from_its_start(tmp_path, limit):
    (tmp_path / "in").mkdir()
    file = tmp_path / "in" / "a.csv"

    def reader():
        return bounded(tmp_path, limit) if limit else CaptureTailReader({"path": str(tmp_path / "in")})

    def follow(start):
        found = []
        while (end := reader().latestOffset()) != start:
            found += read_all(reader(), start, end)
            start = end
        return start, found

    first = ["same"] + [f"old-{i}" for i in range(5000)]
    second = ["same"] + [f"new-{i}" for i in range(9000)]
    file.write_text("h\n" + "\n".join(first) + "\n")
    start, found = follow({})
    assert found == first
    file.write_text("h\n" + "\n".join(second) + "\n")
    start, found = follow(start)
    assert found == second
    with open(file, "a") as out:
        out.write("more\n")
    assert follow(start)[1] == ["more"]


def test_scoring_in_bounded_batches_survives_restarts(spark, job):
    job.append(HEADER + "\n" + "".join(row(i) + "\n" for i in range(30)))
    limit = {"max_bytes_per_trigger": 1500, "plan_log": str(job.base / "checkpoint" / "planned")}
    for _ in range(20):  # availableNow plans one batch a run
        job.run(**limit)
    assert job.ids() == sorted(f"flow-{i}" for i in range(30))
    assert job.scored().select("batch_id").distinct().count() > 2


def test_trend_of_many_batches_has_no_state(spark, make_flows, tmp_path):
    from flowrill.operators.traffic import traffic_trend

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    flows = make_flows(*[{"ts": f"2024-01-{15 - i % 3}T10:00:0{i % 2}", "flow_bytes_s": 1.5 * i} for i in range(12)], {"ts": None})
    assert live.read_trend(spark, out).count() == 0
    for i in range(7):  # late days come again and again
        flows.where(f"pmod(hash(flow_id), 7) = {i}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(flows.schema).parquet(source)
        query = live.start_trend(stream, out, str(tmp_path / "cp"), NOW, fold_every=3)
        query.awaitTermination()
        assert all(not p["stateOperators"] for p in query.recentProgress)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(live.read_trend(spark, out)) == rows(traffic_trend(flows.where("ts is not null")))
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"all-5", "batch-6"}
    live.trend_sums(flows).write.parquet(f"{out}/batch-2")  # left by an attempt after the fold
    assert rows(live.read_trend(spark, out)) == rows(traffic_trend(flows.where("ts is not null")))
    live.fold_trend(spark, out)
    assert rows(live.read_trend(spark, out)) == rows(traffic_trend(flows.where("ts is not null")))


def test_captures_are_scored_in_parts_that_are_removed(spark, make_flows, monkeypatch):
    flows = make_flows(*[{}] * 40).withColumn("timestamp_raw", F.lit("15/01/2024 10:00:00 AM"))
    seen, score = [], catalog._score_captures

    def counted(session, base, scorer):
        seen.append(session.read.option("header", "true").csv(f"{base}/captures").count())
        score(session, base, scorer)

    monkeypatch.setattr(catalog, "_score_captures", counted)
    base = catalog._run_scoring(flows, spark, lambda rows: rows)
    assert sum(seen) == 40 and max(seen) < 40
    assert not path_exists(spark, f"{base}/captures")
    found = spark.read.parquet(f"{base}/analysed").select("flow_id").collect()
    assert sorted(r.flow_id for r in found) == [f"f{i:04d}" for i in range(40)]


def test_shuffle_files_go_within_only(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with pytest.raises(ZeroDivisionError), shuffles_removed(spark):
        assert spark.conf.get(key) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(key, None) == before
