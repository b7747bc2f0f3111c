"""Maintenance joins, readers, writers, model operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.functions import physics
from fleetpulse.operators import cmms, history, models, prep, validate
from fleetpulse.schema import (
    COLUMN_ALIASES,
    EPOCH_HISTORY,
    HISTORY,
    TABLES,
    canonical,
    create_tables,
    external,
)
from fleetpulse.session import cut_lineage, work_path
from fleetpulse.sources import readers, sinks, views

DIM = "id bigint, code string, description string"


def test_lookup_hit_and_miss(spark):
    dim = spark.createDataFrame([(123, "3", "High"), (5, "4", "3"), (9, "x", None)], DIM)
    assert cmms.lookup_id(dim, "3") == 5
    assert cmms.lookup_id(dim, "High") == 123
    assert cmms.lookup_id(dim, "none") is None
    assert cmms.lookup_id(dim.limit(0), "3") is None
    df = spark.createDataFrame([("High",), ("4",), ("zzz",), (None,)], "k string")
    got = {r["k"]: r["i"] for r in cmms.resolve(df, dim, "k", "i").collect()}
    assert got == {"High": 123, "4": 5, "zzz": None, None: None}


def alert(spark):
    return spark.createDataFrame([(1, 2, "2024-12-20 10:00:00", 0.9)],
                                 "machine_id long, udi long, predicted_failure_date string, risk_score double")


def test_one_alert_makes_one_work_order(spark):
    dim = spark.createDataFrame([(1, "3", "p"), (2, "Damage", "d"), (3, "site", "s"), (4, "t", "Tester")], DIM)
    orders = cmms.work_orders(alert(spark), dim, dim, dim, dim, "3", "Damage", "site", "Tester").collect()
    assert len(orders) == 1
    assert json.loads(orders[0]["process_notes"]) == {
        "PredictedFailureDate": "2024-12-20 10:00:00",
        "RiskScore": 0.9,
    }
    assert orders[0]["short_descr"] == "Anomaly Detected" and orders[0]["closure_date"] is None
    assert cmms.work_orders(alert(spark), dim, dim, dim, dim, "3", "Damage", "nowhere", "Tester").isEmpty()


def test_no_cross_join_in_work_orders(spark):
    dim = spark.createDataFrame([(1, "3", "p")], DIM)
    df = cmms.work_orders(alert(spark), dim, dim, dim, dim, "3", "3", F.col("machine_id").cast("string"), "p")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_first_open_activity(spark):
    df = spark.createDataFrame(
        [(1, 10, "closed"), (1, 11, "running"), (1, 12, "open"), (2, 13, "done")], "w int, a int, status string"
    )
    rows = cmms.first_open_activity(df, ["w"], "a").collect()
    assert [tuple(r) for r in rows] == [(1, 11, "running")]


def test_left_join_keeps_records_without_asset(spark):
    columns = "Id long, Code string, Description string, CI long, ProcessType string, OpeningDate timestamp, "
    records = spark.createDataFrame(
        [(1, "a", "d", 5, "p", None, None, None, "A"), (2, "a", "d", 6, "p", None, None, None, "A"),
         (3, "a", "d", 5, "p", None, None, None, "N")],
        columns + "ClosureDate timestamp, Notes string, Status string",
    )
    assets = spark.createDataFrame([(5, "c", "x")], "Id long, Code string, Description string")
    rows = cmms.maintenance(records, assets).orderBy("maintenance_id").collect()
    assert [(r["maintenance_id"], r["asset_code"]) for r in rows] == [(1, "c"), (2, None)]


def readings(spark):
    rows = [(i, "L", 300.0 + i, 310.0, 1500.0, 40.0, 100.0) for i in range(20)]
    names = "udi bigint, type string, air_temp_k double, process_temp_k double, rotational_speed_rpm double, "
    df = spark.createDataFrame(rows, names + "torque_nm double, tool_wear_min double")
    labelled = views.labelled(df)
    return labelled.withColumn("product_id", physics.product_id(F.col("type"), F.col("udi")))


def test_csv_round_trip(spark, tmp_path):
    columns = list(COLUMN_ALIASES.values())
    df = readings(spark).select(*columns)
    path = str(tmp_path / "csv")
    sinks.write_csv(external(df), path)
    back = readers.read_readings_csv(spark, path)
    assert back.columns == columns and back.exceptAll(df.select(*back.columns)).isEmpty()
    assert canonical(external(df)).columns == columns
    matrix = readers.read_matrix_csv(spark, path, external(df).columns)
    assert dict(matrix.dtypes)["Torque [Nm]"] == "float"


def test_tables(spark):
    names = create_tables(spark)
    assert set(names) == set(TABLES) and create_tables(spark) == names
    assert len(spark.table("processed_data").columns) == 62
    df = readings(spark).select("udi", "type")
    sinks.replace_table(df, "some_readings")
    sinks.append_table(df, "some_readings")
    assert readers.read_table(spark, "some_readings").count() == 40
    assert readers.read_query(spark, "select * from some_readings where udi = 1").count() == 2
    sinks.replace_table(df, "some_readings")
    assert readers.read_table(spark, "some_readings").count() == 20


def test_histories(spark, tmp_path):
    folder = tmp_path / "epochs"
    folder.mkdir()
    record = {"accuracy": [0.5, 0.6], "loss": [0.7, 0.6], "val_accuracy": [0.5, 0.7], "val_loss": [0.4, 0.3],
              "learning_rate": [1e-4, 1e-4]}
    for fold in (1, 2):
        (folder / f"fold_{fold}.json").write_text(json.dumps(record))
    rows = readers.read_epoch_history(spark, str(folder))
    assert rows.count() == 4 and set(EPOCH_HISTORY.fieldNames()) < set(rows.columns)
    assert [r["epoch"] for r in history.best_epoch(rows, ["file"]).collect()] == [2, 2]

    files = tmp_path / "folds"
    files.mkdir()
    for fold in (1, 2):
        (files / f"LOF_fold_{fold}_contamination_0.01.csv").write_text("f1_score\n0.5\n")
    schema = HISTORY["f1_score"]
    from pyspark.sql import types as T

    got = readers.read_fold_histories(spark, str(files), T.StructType([schema])).orderBy("fold").collect()
    assert [(r["model"], r["fold"], r["contamination"], r["f1_score"]) for r in got] == [
        ("LOF", 1, 0.01, 0.5),
        ("LOF", 2, 0.01, 0.5),
    ]


def test_sequence_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "windows")
    df = spark.createDataFrame([([[1.0, 2.0]], 1)], "features array<array<double>>, label int")
    sinks.write_parquet(df, path)
    assert readers.read_sequences(spark, path).first()["features"] == [[1.0, 2.0]]


def test_work_folder_is_the_named_one(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert work_path(spark, "x").startswith(named)
    assert cut_lineage(spark.range(3)).count() == 3


def test_integration_reports_lost_rows(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "i int, x double")
    b = spark.createDataFrame([(3,)], "i int")
    whole = validate.integrate(a, b)
    assert physics.drop_incomplete(whole).count() == 1
    got = {r["source"]: (r["n_kept"], r["n_dropped"]) for r in validate.dropped_by_source(whole).collect()}
    assert got == {"real": (1, 1), "synthetic": (0, 1)}


def learnable(spark, n=400):
    return spark.range(n).select(
        "id",
        (F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0).alias("a"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100.0).alias("b"),
    ).withColumn("y", (F.col("a") > 0.6).cast("int"))


def test_importance_and_selection(spark):
    df = learnable(spark)
    kept, table = models.select_by_importance(df, ["a", "b"], "y", cut=0.2, trees=5)
    assert kept == ["a"] and table.first()["feature"] == "a"
    fitted = models.random_forest(df, ["a", "b"], "y", 5, 4)
    ranked = models.permutation_importance(fitted, df, ["a", "b"], "y", "id").collect()
    assert ranked[0]["feature"] == "a" and ranked[0]["importance"] > 0.3 > abs(ranked[1]["importance"])


def test_search_picks_the_best_setting(spark):
    df = prep.stratified_folds(learnable(spark, 200), "y", "id", 2)
    settings = models.random_settings(2, trees=(2, 4))
    assert settings == models.random_settings(2, trees=(2, 4))
    results = models.random_search(df, ["a", "b"], "y", [{**s, "depth": 3} for s in settings], folds=2)
    best = models.best_setting(results).first()
    assert results.count() == 2 and best["mean_f1"] == results.agg(F.max("mean_f1")).first()[0]


def test_a_stopped_search_goes_on_from_its_table(spark, tmp_path, monkeypatch):
    df = prep.stratified_folds(learnable(spark, 120), "y", "id", 2)
    settings = [{**s, "trees": 4, "depth": 2} for s in models.random_settings(4, trees=(4, 4))]
    path, calls, search = str(tmp_path / "trials"), [], models.random_search

    def stops_after(n):
        def run(rows, features, label, chosen, *rest):
            if len(calls) == n:
                raise RuntimeError("stopped")
            calls.append((chosen[0]["trial"], chosen[0]["trees"]))
            return search(rows, features, label, chosen, *rest)

        return run

    monkeypatch.setattr(models, "random_search", stops_after(3))
    with pytest.raises(RuntimeError, match="stopped"):
        models.halving_search(df, ["a", "b"], "y", settings, path, folds=2, factor=2, rungs=2)
    assert calls == [(0, 2), (1, 2), (2, 2)]
    monkeypatch.setattr(models, "random_search", stops_after(-1))
    found = models.halving_search(df, ["a", "b"], "y", settings, path, folds=2, factor=2, rungs=2).collect()
    assert calls[3] == (3, 2) and len(calls) == 6 and all(trees == 4 for _, trees in calls[4:])
    assert sorted(r["trial"] for r in found) == [0, 1, 2, 3] and sorted(r["rung"] for r in found) == [0, 0, 1, 1]
    # a finished search fits nothing, and gives the same
    again = models.halving_search(df, ["a", "b"], "y", settings, path, folds=2, factor=2, rungs=2).collect()
    assert len(calls) == 6 and sorted(again) == sorted(found)


def test_adaptive_rounds_are_bounded(spark):
    df = learnable(spark, 60).withColumn("fold", (F.col("id") % 2).cast("int"))
    seen = []

    def fit(train, config):
        seen.append(dict(config))
        return lambda part, name: part.withColumn(name, F.lit(0.5))

    out, config = models.adaptive_cross_validate(df, "fold", 2, "y", fit, {"rate": 0.1, "size": 8}, max_rounds=2)
    assert out.count() == 4 and len(seen) == 4
    assert config["rate"] == pytest.approx(0.025) and config["size"] == 72

    def good(train, config):
        return lambda part, name: part.withColumn(name, F.col("a"))

    out, config = models.adaptive_cross_validate(df, "fold", 2, "y", good, {"rate": 0.1}, max_rounds=2)
    assert out.count() == 2 and config == {"rate": 0.1}


def test_scale_and_reduce(spark):
    df = learnable(spark, 100)
    train, validation = prep.scale_and_reduce(df.filter("id < 80"), df.filter("id >= 80"), ["a", "b"], 20)
    assert train.count() == 80 and validation.first()["components"].size == 2


def test_extraction_skips_empty_results(spark, tmp_path):
    assets = views.assets(spark, "/root/testdata/sf0.001")
    records = views.corrective(spark, "/root/testdata/sf0.001")
    got = cmms.extract(assets, records, records, str(tmp_path))
    assert set(got) == {"assets", "corrective_maintenance", "preventive_maintenance"}
    got = cmms.extract(assets, records.limit(0), records, str(tmp_path / "b"))
    assert set(got) == {"assets", "preventive_maintenance"}


def test_report_text(spark, tmp_path):
    path = str(tmp_path / "report")
    sinks.write_report(spark.createDataFrame([("ks", 0.5), ("chi2", None)], "test string, value double"), path)
    assert [r["value"] for r in spark.read.text(path).collect()] == ["chi2 | ", "ks | 0.5"]
    sinks.write_json(spark.createDataFrame([(1, 0.5)], "fold int, f1 double"), path)
    assert spark.read.json(path).first()["f1"] == 0.5


def test_small_expressions(spark):
    df = spark.createDataFrame([(-1, -2.0, "L"), (0, 2.0, "H")], "label int, x double, type string")
    rows = df.withColumn("tool_wear_min", F.lit(1.0)).transform(physics.worn).select(
        physics.cluster_anomaly(F.col("label")).alias("a"), physics.clip_low(F.col("x")).alias("c"), "tool_wear_min"
    )
    assert [tuple(r) for r in rows.collect()] == [(1, 0.0, 3.0), (0, 2.0, 6.0)]
    shuffled = prep.shuffled(df, "label").orderBy("shuffle_key")
    assert shuffled.count() == 2


@pytest.mark.parametrize("kind, one, other", [
    ("logistic", {"rate": 0.3}, {"rate": 0.0003}),
    ("perceptron", {"size": 2}, {"size": 6}),
    ("boosted", {"size": 4}, {"size": 32}),
])
def test_a_retry_changes_the_fit(spark, kind, one, other):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        v = rng.normal(size=4)
        rows.append((i, [v.tolist()], int(v[0] * v[1] + v[2] + rng.normal() > 0)))
    df = spark.createDataFrame(rows, "id int, sequence array<array<double>>, y int")
    scores = []
    for settings in (one, other):
        model = models.sequence_model(df, "y", kind, width=4, rounds=10, **settings)
        scores.append([r.s for r in models.sequence_score(model, df, "s", width=4).orderBy("id").collect()])
    assert not np.allclose(scores[0], scores[1], atol=1e-4)


def test_time_steps_see_whole_windows_and_mark_the_best(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        v = rng.normal(size=6)
        rows.append((i % 2, int(v[3] > v[0]), *v.tolist()))
    names = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame(rows, "fold int, y int, " + ", ".join(f"{n} double" for n in names))
    out = models.select_time_steps(df, names, "y", "fold", 2).collect()
    assert [r.steps for r in out if r.best] == [max(out, key=lambda r: (r.mean_f1, -r.steps)).steps]
    assert {r.steps for r in out} == {2, 3} and all(r.mean_f1 > 0.8 for r in out)
