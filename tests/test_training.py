"""Cleaning, profiling, sampling, scaling, metrics, models."""

from __future__ import annotations

import math
import random
import statistics
import threading

import pytest
from pyspark.sql import functions as F

from flowrill.operators import bayes, classifiers, clean, metrics, profile, sampling, scaling
from flowrill.operators.ranking import exact_quantiles
from flowrill.plans import scoring, training
from flowrill.schema import CANONICAL_COLUMNS, DUPLICATE_HEADER, MODEL_FEATURES, short_name, typed_schema
from flowrill.sources import captures
from flowrill.sources.models import load_model, save_model

INF, NAN = float("inf"), float("nan")


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- reading and cleaning ----------------------------------------------------------------------


def _line(**changed):
    values = {c: "1" for c in CANONICAL_COLUMNS}
    values.update({"Timestamp": "15/01/2024 10:00:00 AM", "Label": "BENIGN"})
    values.update(changed)
    return ",".join(values[c] for c in CANONICAL_COLUMNS)


def test_reader_skips_malformed_rows_whatever_is_selected(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(",".join(CANONICAL_COLUMNS) + "\n" + _line() + "\n1,2\n" + _line() + ",9\n" + _line() + "\n")
    df = captures.read_flows(spark, str(path))
    assert df.count() == 2 and df.select("Label").count() == 2
    assert captures.read_malformed(spark, str(path)).count() == 2
    assert clean.coerce_flows(df).schema.names[:4] == ["flow_id", "src_ip", "src_port", "dst_ip"]


def test_typed_schema_matches_the_coerced_capture(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(",".join(CANONICAL_COLUMNS) + "\n" + _line() + "\n")
    found = clean.coerce_flows(captures.read_flows(spark, str(path))).schema
    assert [(f.name, f.dataType) for f in found] == [(f.name, f.dataType) for f in typed_schema()]


def test_latin1_labels(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes("Flow ID, Label\n1,Web Attack \x96 XSS\n".encode("iso-8859-1"))
    df = captures.combine_captures(spark, str(tmp_path), encoding="ISO-8859-1")
    found = rows(clean.add_attack_category(df, "Label"))
    assert found[0]["class_label"] == "Web Attack"


def test_combining_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,z\n3,4\n")
    (tmp_path / "c.csv").write_text("x,y\n5,6\n")
    (tmp_path / "note.txt").write_text("no\n")
    found = rows(captures.combine_captures(spark, str(tmp_path)).orderBy("y"))
    assert found == [
        {"x": "1", "y": "2", "z": None}, {"x": None, "y": "3", "z": "4"}, {"x": "5", "y": "6", "z": None}
    ]


def test_repeated_header_names_are_numbered(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id, x ,x,"y\nz",x\n1,2,3,4,5\n')
    (tmp_path / "b.csv").write_text("id,x,x.1\n6,7,8\n")
    assert captures.unique_names(["a", "b", "a", "a"]) == ("a", "b", "a.1", "a.2")
    columns = captures._header(*captures._list_csv(str(tmp_path))[:1], str(tmp_path / "a.csv"), "utf-8")
    assert columns == ("id", "x", "x.1", "y\nz", "x.2")
    (tmp_path / "a.csv").write_text("id, x ,x,y\n1,2,3,4\n")
    got = captures.combine_captures(spark, str(tmp_path))
    assert sorted(map(str, got.select("id", "x", "`x.1`", "y").collect())) == sorted(
        map(str, spark.createDataFrame([("1", "2", "3", "4"), ("6", "7", "8", None)], "id string, x string, `x.1` string, y string").collect())
    )


def test_classes_do_not_shuffle_the_flows(spark, make_flows):
    """Unnamed classes are looked up, and then the rows stay where they are."""
    flows = make_flows(*[{"label": "DoS" if i % 3 else "BENIGN"} for i in range(30)])
    for df in (sampling.split_stratified(flows), clean.encode_label(flows), sampling.undersample_to_min(flows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
    assert {r.label: r.label_code for r in clean.encode_label(flows).collect()} == {"BENIGN": 0, "DoS": 1}


def test_coercion_of_dirty_numbers(spark):
    df = spark.createDataFrame(
        [("5.7", "Infinity"), ("3.0", "NaN"), ("", "abc"), (" 8 ", "1e3"), ("NaN", ""), ("9e30", "-2")],
        ["Flow Duration", "Flow Bytes/s"],
    )
    found = rows(clean.coerce_flows(df))
    assert [r["flow_duration"] for r in found] == [5, 3, None, 8, None, None]
    numbers = [r["flow_bytes_s"] for r in found]
    assert numbers[0] == INF and math.isnan(numbers[1]) and numbers[2:] == [None, 1000.0, None, -2.0]


def test_dropping_rows_with_gaps(make_flows):
    flows = make_flows(
        {}, {"flow_bytes_s": INF}, {"flow_packets_s": NAN}, {"idle_mean": -INF}, {"label": None}, {"src_ip": None}
    )
    assert [r["flow_id"] for r in rows(clean.drop_non_finite(flows))] == ["f0000"]
    assert len(rows(clean.drop_non_finite_rates(flows))) == 4
    assert len(rows(clean.non_finite_to_null(flows).where("flow_bytes_s is null"))) == 1


def test_protocol_zero_needs_the_column(make_flows):
    flows = make_flows({"protocol": 0}, {"protocol": None}, {})
    assert clean.drop_protocol_zero(flows).count() == 2
    assert clean.drop_protocol_zero(flows.drop("protocol")).count() == 3


def test_raw_capture_to_training_rows(spark):
    header = [f" {c}" for c in CANONICAL_COLUMNS]
    header.insert(60, f" {DUPLICATE_HEADER}")
    lines = [
        _line(Label="DoS Hulk"), _line(Label="Nothing"), _line(Label="Bot", **{"Flow Bytes/s": "Infinity"}),
        _line(Label="DDoS", **{"Idle Min": ""}),
    ]
    data = []
    for line in lines:
        cells = line.split(",")
        cells.insert(60, "1")
        data.append(tuple(cells))
    raw = spark.createDataFrame(data, header)
    cleaned = training.clean_training(raw)
    assert [r["class_label"] for r in rows(cleaned)] == ["DoS"]
    with pytest.raises(ValueError):
        clean.rename_canonical(raw)
    features = clean.drop_identifiers(cleaned).columns
    assert "flow_duration" in features and not {"src_ip", "label", "protocol"} & set(features)


def test_a_filter_on_the_category_computes_the_label_once(spark):
    labels = ["DoS Hulk", "Other", None, "", "Bot"]
    text = spark.createDataFrame([(x,) for x in labels], "t string").select(F.reverse(F.reverse("t")).alias("label"))
    named = clean.add_attack_category(text)
    assert [r["class_label"] for r in named.collect()] == ["DoS", "Unknown", "Unknown", "Unknown", "Bot"]
    plan = clean.drop_unknown(named).select("class_label")._jdf.queryExecution().optimizedPlan()
    condition = next(line for line in plan.toString().splitlines() if "Filter" in line)
    assert condition.count("reverse(reverse(") == 1


def test_label_codes_and_back(make_flows):
    flows = make_flows({"label": "PortScan"}, {"label": "BENIGN"}, {"label": "DoS"}, {"label": None})
    found = {r["label"]: r["label_code"] for r in rows(clean.encode_label(flows))}
    assert found == {"BENIGN": 0, "DoS": 1, "PortScan": 2}
    known = {r["label"]: r["label_code"] for r in rows(clean.encode_label(flows, classes=["DoS", "BENIGN"]))}
    assert known == {"BENIGN": 0, "DoS": 1, "PortScan": None}
    decoded = clean.decode_label(clean.encode_label(flows), "label_code", "back")
    assert {r["label"]: r["back"] for r in rows(decoded)} == {"BENIGN": "BENIGN", "DoS": "DoS", "PortScan": "-1"}


# --- profiling ---------------------------------------------------------------------------------


def _interpolated(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low = math.floor(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 4001])
def test_exact_quantiles_small(spark, size):
    rng = random.Random(size)
    values = [rng.choice([rng.gauss(0, 1e6), 7.0]) for _ in range(size)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = {r["probability"]: r["value"] for r in rows(exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0]))}
    for p, value in found.items():
        assert math.isclose(value, _interpolated(values, p), rel_tol=1e-12, abs_tol=1e-9)


def test_exact_quantiles_beyond_the_sketch_size_with_a_hot_value(spark):
    n = 600_000
    df = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 7919 % 1000003).cast("double")).alias("x")
    )
    values = [5.0 if i % 3 == 0 else float(i * 7919 % 1000003) for i in range(n)]
    found = {r["probability"]: r["value"] for r in rows(exact_quantiles(df, ["x"], [0.25, 0.5, 0.75]))}
    for p, value in found.items():
        assert math.isclose(value, _interpolated(values, p), rel_tol=1e-12)


def test_profiles(make_flows):
    flows = make_flows({"flow_bytes_s": INF}, {"flow_bytes_s": NAN}, {"flow_bytes_s": None, "label": None})
    missing = {r["column_name"]: r["missing"] for r in rows(profile.null_profile(flows, ["flow_bytes_s", "label"]))}
    assert missing == {"flow_bytes_s": 2, "label": 1, "*": 3}
    assert rows(profile.inf_profile(flows)) == [{"column_name": "flow_bytes_s", "infinite": 1}]
    shape = rows(profile.dataset_shape(flows, "raw"))[0]
    assert (shape["n_rows"], shape["n_columns"]) == (3, len(flows.columns))
    assert [r["label"] for r in rows(profile.value_counts(flows, "label"))] == ["BENIGN"]


# --- sampling and scaling ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """One class holds nearly all rows."""
    return spark.range(20_000, numPartitions=8).select(
        F.concat(F.lit("k"), F.col("id")).alias("flow_id"),
        F.when(F.col("id") % 97 == 0, "DoS").when(F.col("id") == 5, None).otherwise("BENIGN").alias("label"),
        (F.col("id") % 13).cast("double").alias("x"),
    )


@pytest.mark.parametrize("classes", [None, ["BENIGN", "DoS"]])
@pytest.mark.parametrize("digits", [1, 4])
def test_undersampling_is_exact_and_repeatable(skewed, classes, digits):
    first = sampling.undersample_to_min(skewed, classes=classes, hex_digits=digits)
    counts = {r["label"]: r["count"] for r in rows(first.groupBy("label").count())}
    assert counts == {"BENIGN": 207, "DoS": 207}
    again = sampling.undersample_to_min(skewed.repartition(3), classes=classes, hex_digits=2)
    assert {r["flow_id"] for r in rows(first)} == {r["flow_id"] for r in rows(again)}


@pytest.mark.parametrize("classes", [None, ["BENIGN", "DoS"]])
def test_split_is_a_stratified_partition(skewed, classes):
    split = sampling.split_stratified(skewed, classes=classes)
    counts = {(r["label"], r["split"]): r["count"] for r in rows(split.groupBy("label", "split").count())}
    assert counts == {("BENIGN", "test"): 3958, ("BENIGN", "train"): 15834, ("DoS", "test"): 41, ("DoS", "train"): 166}
    assert split.select("flow_id").distinct().count() == 19_999


def test_tiny_class_has_no_test_rows(make_flows):
    flows = make_flows({"label": "DoS"}, *[{}] * 10)
    split = sampling.balanced_split(flows, classes=["BENIGN", "DoS"])
    assert [r["split"] for r in rows(split)] == ["train", "train"]


def test_augmentation(make_flows):
    flows = make_flows(
        {}, {"label": "DoS", "flow_packets_s": 100.0, "flow_duration": 7.0, "syn": 3}, {"label": None}
    )
    found = rows(sampling.augment_dos(flows, factor=3))
    assert sorted(r["label"] for r in found) == ["BENIGN", "DoS", "DoS", "DoS"]
    for r in found:
        if r["label"] == "DoS":
            assert 95.0 <= r["flow_packets_s"] <= 105.0 and r["flow_packets_s"] != 100.0
            assert r["flow_duration"] == round(r["flow_duration"]) and 0 <= r["flow_duration"] <= 77
    assert len({r["flow_packets_s"] for r in found}) == 4
    assert found == rows(sampling.augment_dos(flows, factor=3))


def test_scaling_is_fitted_on_the_training_rows(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, "train"), (2.0, 5.0, "train"), (6.0, 5.0, "train"), (10.0, 5.0, "test")], "a double, b double, split string"
    )
    found = rows(scaling.standard_scale(df, ["a", "b"]))
    mean, deviation = 3.0, statistics.pstdev([1, 2, 6])
    assert [r["a"] for r in found] == pytest.approx([(v - mean) / deviation for v in (1, 2, 6, 10)])
    assert {r["b"] for r in found} == {0.0}


# --- metrics -----------------------------------------------------------------------------------


def test_published_confusion_matrix(spark):
    cells = [(0, 0, 3934), (0, 1, 20), (1, 0, 21), (1, 1, 3965)]
    df = spark.createDataFrame([(a, b) for a, b, n in cells for _ in range(n)], "label int, prediction int")
    matrix = {(r["label"], r["prediction"]): r["n"] for r in rows(metrics.confusion_matrix(df, [0, 1]))}
    assert matrix == {(a, b): n for a, b, n in cells} and sum(matrix.values()) == df.count()
    quality = rows(metrics.classification_metrics(df))[0]
    assert {k: round(v, 4) for k, v in quality.items()} == {
        "accuracy": 0.9948, "precision": 0.9948, "recall": 0.9948, "f1": 0.9948
    }
    report = {r["class"]: r for r in rows(metrics.classification_report(df))}
    assert (report["0"]["support"], report["1"]["support"]) == (3954, 3986)
    assert (round(report["0"]["precision"], 4), round(report["0"]["recall"], 4)) == (0.9947, 0.9949)
    assert (round(report["1"]["precision"], 4), round(report["1"]["recall"], 4)) == (0.9950, 0.9947)


def test_undefined_ratios_are_zero(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b")], "label string, prediction string")
    assert rows(metrics.classification_metrics(df))[0] == {"accuracy": 0.0, "precision": 0.0, "recall": 0.0, "f1": 0.0}


# --- models ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    """Two separable classes plus a third, with the model's features."""
    noise = F.pmod(F.hash("id"), F.lit(1000)) / 1000.0
    name = F.when(F.col("id") % 3 == 0, "BENIGN").when(F.col("id") % 3 == 1, "DoS").otherwise("PortScan")
    shift = F.when(F.col("id") % 3 == 1, 5.0).when(F.col("id") % 3 == 2, -5.0).otherwise(0.0)
    df = spark.range(600, numPartitions=4).select(
        F.concat(F.lit("k"), F.col("id")).alias("flow_id"), name.alias("label"),
        *[(noise * (i + 1) + shift).alias(c) for i, c in enumerate(MODEL_FEATURES)],
    )
    return df.cache()


@pytest.fixture(scope="module")
def two_class(labelled):
    return training.training_rows(labelled, ["BENIGN", "DoS"]).cache()


@pytest.mark.parametrize("name", [n for n in classifiers.ESTIMATORS if "binned" not in n])
def test_every_model_separates_two_classes(two_class, name, monkeypatch):
    train, test = two_class.where("split = 'train'"), two_class.where("split = 'test'")
    if "Boosting" in name or "SVM" in name:  # few rounds are enough here
        build = classifiers.ESTIMATORS[name]
        monkeypatch.setitem(classifiers.ESTIMATORS, name, lambda n: build(n).setMaxIter(3))
    model = classifiers.fit_model(train, name)
    quality = rows(metrics.classification_metrics(classifiers.predict(model, test, ["label_code"]), "label_code"))[0]
    assert quality["accuracy"] > 0.95


def test_more_classes_and_saved_models(spark, labelled, tmp_path, monkeypatch):
    monkeypatch.setitem(
        classifiers.ESTIMATORS, "Gradient Boosting", lambda n: classifiers.gradient_boosting(n).setMaxIter(2)
    )
    data = training.training_rows(labelled, ["BENIGN", "DoS", "PortScan"])
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    table = classifiers.compare_models(
        train, test, ["Naive Bayes", "Gradient Boosting"], multiclass=True, save_dir=str(tmp_path)
    )
    assert all(r["accuracy"] > 0.9 for r in rows(table))
    assert rows(metrics.best_model(table))[0]["accuracy"] == max(r["accuracy"] for r in rows(table))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["gradient_boosting", "naive_bayes"]
    again = load_model(str(tmp_path / "gradient_boosting"))
    assert classifiers.predict(again, test, ["flow_id"]).count() == test.count()


def test_models_are_fitted_side_by_side_and_stay_in_order(two_class, monkeypatch):
    train, test = two_class.where("split = 'train'"), two_class.where("split = 'test'")
    fit, both = classifiers.fit_model, threading.Barrier(2, timeout=60)

    def meeting(*args):
        both.wait()  # fails unless the other fit has begun too
        return fit(*args)

    monkeypatch.setattr(classifiers, "fit_model", meeting)
    names = ["Naive Bayes", "Decision Tree"]
    assert [r["model"] for r in rows(classifiers.compare_models(train, test, names))] == names


def test_scaler_inside_the_pipeline_uses_the_population_deviation(two_class):
    train = two_class.where("split = 'train'")
    model = classifiers.fit_model(train, "Logistic Regression")
    scaled = model.transform(train).select("features").collect()
    column = [r["features"][0] for r in scaled]
    assert statistics.fmean(column) == pytest.approx(0, abs=1e-9)
    assert statistics.pstdev(column) == pytest.approx(1, abs=1e-9)


def test_scoring_keeps_all_columns_and_replaces_the_label(two_class, make_flows, tmp_path):
    fitted = classifiers.fit_model(two_class.where("split = 'train'"), "Logistic Regression")
    save_model(fitted, str(tmp_path / "m"))
    model = load_model(str(tmp_path / "m"))
    flows = make_flows({}, {"protocol": 0}, {"flow_bytes_s": INF}, {"label": "DoS"})
    scored = scoring.score_flows(flows, model)
    assert sorted(scored.columns) == sorted(flows.columns)
    assert [r["flow_id"] for r in rows(scored.orderBy("flow_id"))] == ["f0000", "f0003"]
    assert {r["label"] for r in rows(scored)} <= {"BENIGN", "DoS"}
    without = scoring.score_flows(flows.drop("rst"), model)
    assert without.count() == 2 and "rst" not in without.columns


def test_gaussian_bayes_matches_the_built_in(two_class):
    data = two_class.withColumn("label", F.when(F.col("label_code") == 0, "BENIGN").otherwise("DoS"))
    ours = {r["flow_id"]: r["prediction"] for r in rows(bayes.gaussian_nb(data, MODEL_FEATURES, ["BENIGN", "DoS"]))}
    model = classifiers.fit_model(data.where("split = 'train'"), "Naive Bayes")
    built_in = classifiers.predict(model, data.where("split = 'test'"), ["flow_id"])
    names = {0: "BENIGN", 1: "DoS"}
    assert ours == {r["flow_id"]: names[r["prediction"]] for r in rows(built_in)}


def test_short_names_are_unique():
    assert len({short_name(c) for c in CANONICAL_COLUMNS}) == len(CANONICAL_COLUMNS) == 84


def test_training_rows_are_stored_in_few_partitions(spark, make_flows):
    flows = make_flows(*[{"label": "DoS" if i % 3 else "BENIGN", "flow_duration": float(i)} for i in range(60)])
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    many = training.stored_training_rows(spark, flows.repartition(40), ["BENIGN", "DoS"])
    assert many.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before
    wanted = training.training_rows(flows, ["BENIGN", "DoS"])
    assert many.columns == wanted.columns
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, wanted.collect()))


def test_tasks_of_a_fit_grow_with_the_rows_only(spark, tmp_path):
    spark.range(100).repartition(30).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.option("maxPartitionBytes", "1").parquet(str(tmp_path / "rows"))
    cores = spark.sparkContext.defaultParallelism
    assert training.in_tasks(rows).rdd.getNumPartitions() <= cores
    assert training.in_tasks(rows, 5).rdd.getNumPartitions() <= max(cores, 20)
    assert training.in_tasks(rows, 5).count() == 100


def test_score_flows_makes_the_flows_once(spark, make_flows, monkeypatch):
    from flowrill.plans import catalog

    made = spark.sparkContext.accumulator(0)
    changed = [{"label": "DoS" if i % 3 else "BENIGN", "flow_duration": float(i)} for i in range(60)]
    flows = make_flows(*changed, {"protocol": 0}, {"flow_bytes_s": INF})

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    counted = flows.mapInArrow(count, flows.schema)
    monkeypatch.setattr(catalog, "flows_from_tables", lambda *_: counted)
    scored = rows(catalog.QUERIES["score_flows"](spark, ""))
    assert sorted(r["flow_id"] for r in scored) == [f"f{i:04d}" for i in range(60)]
    assert made.value == 62
