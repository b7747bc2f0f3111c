"""Streaming equals batch, bad records are set aside, repeated batches do not double rows."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetpulse.functions import physics
from fleetpulse.operators import cmms, ensemble, models, windows
from fleetpulse.schema import COLUMN_ALIASES, SENSORS, SEQUENCE_FEATURES, TABULAR_FEATURES
from fleetpulse.plans import streams
from fleetpulse.sources import readers, sinks, views
from fleetpulse.streaming import scoring

SHORT = {v: k for k, v in COLUMN_ALIASES.items()}


def data(n=240, seed=4):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "udi": np.arange(n),
            "machine_id": np.where(np.arange(n) % 3 == 0, 1, rng.integers(2, 7, n)),
            "event_time": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(n) // 2, unit="min"),
            "type": rng.choice(list("HLM"), n),
            "air_temp_k": rng.normal(300, 2, n),
            "process_temp_k": rng.normal(309, 2, n),
            "rotational_speed_rpm": rng.normal(1450, 120, n),
            "torque_nm": rng.normal(40, 12, n).clip(0),
            "tool_wear_min": rng.integers(0, 250, n).astype(float),
        }
    )


def lines(rows):
    out = []
    for r in rows.to_dict("records"):
        r["event_time"] = r["event_time"].strftime("%Y-%m-%dT%H:%M:%SZ")
        out.append(json.dumps({SHORT.get(k, k): v for k, v in r.items()}))
    return out


def write(folder, name, texts):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(texts) + "\n")
    os.utime(os.path.join(folder, name), (1_700_000_000 + int(name[1:2]), 1_700_000_000 + int(name[1:2])))


def run(spark, tmp_path, source, scorers=None, **options):
    scorers = scorers or {"rule": scoring.expression_scorer("rule", lambda: F.col("failure_risk").cast("double"))}
    out = str(tmp_path / "out")
    raw = readers.stream_json_files(spark, source, files_per_batch=1)
    scoring.run(raw, scorers, out, str(tmp_path / "check"), **options).awaitTermination()
    return out


@pytest.mark.parametrize("scope", ["machine", "global"])
def test_stream_windows_equal_batch_windows(spark, tmp_path, scope):
    rows, source = data(), str(tmp_path / "in")
    texts = lines(rows)
    for i in range(4):
        write(source, f"m{i}.json", texts[i * 60 : (i + 1) * 60])
    stream = scoring.with_sequences(readers.stream_json_files(spark, source, 1), scope=scope)
    out = str(tmp_path / "windows")
    (
        stream.select("udi", "sequence")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    got = spark.read.schema("udi bigint, sequence array<array<double>>").parquet(out)
    by = ["machine_id"] if scope == "machine" else []
    batch = physics.engineer(spark.createDataFrame(rows))
    expected = windows.sequences(batch, SEQUENCE_FEATURES, by, ["event_time", "udi"], complete_only=False)
    joined = got.join(expected.select("udi", F.col("sequence").alias("e")), "udi")
    assert joined.count() == 240 == got.count()
    assert joined.filter("not (sequence <=> e)").isEmpty()


def test_bad_records_do_not_touch_the_buffer(spark, tmp_path):
    texts, source = lines(data(12).assign(machine_id=1)), str(tmp_path / "in")
    texts[2] = texts[2].replace('"Type": "', '"Type": "X')
    texts[3] = "garbage"
    write(source, "m0.json", texts)
    scorers = {"recent": scoring.window_mean("failure_risk", "recent")}
    out = run(spark, tmp_path, source, scorers)
    scored = spark.read.parquet(f"{out}/scored").orderBy("udi").collect()
    assert [r["udi"] for r in scored] == [0, 1, 4, 5, 6, 7, 8, 9, 10, 11]
    # Readings 0, 1, 4, 5, 6 fill the buffer; before that nothing votes.
    assert [r["recent"] is None for r in scored] == [True] * 4 + [False] * 6
    assert all(r["final_score"] is None and r["final_prediction"] == 0 for r in scored[:4])
    bad = spark.read.parquet(f"{out}/quarantine").collect()
    assert sorted(r["reason"].split(":")[0] for r in bad) == ["missing or invalid", "unknown type"]


def test_nan_reading_gives_windows_without_a_vote(spark, tmp_path):
    rows = data(12).assign(machine_id=1)
    rows.loc[2, "torque_nm"] = float("nan")
    source = str(tmp_path / "in")
    write(source, "m0.json", lines(rows))
    out = run(spark, tmp_path, source, {"recent": scoring.window_mean("failure_risk", "recent")})
    scored = spark.read.parquet(f"{out}/scored").orderBy("udi").collect()
    assert len(scored) == 12 and scored[2]["pwf_condition"] == 0
    assert [r["recent"] is None for r in scored] == [True] * 7 + [False] * 5


def test_state_survives_a_restart_and_nothing_is_doubled(spark, tmp_path):
    texts, source = lines(data(20).assign(machine_id=1)), str(tmp_path / "in")
    scorers = {"recent": scoring.window_mean("failure_risk", "recent")}
    write(source, "m0.json", texts[:3])
    out = run(spark, tmp_path, source, scorers)
    assert spark.read.parquet(f"{out}/scored").filter("recent is not null").isEmpty()
    write(source, "m1.json", texts[3:])
    run(spark, tmp_path, source, scorers)
    scored = spark.read.parquet(f"{out}/scored")
    assert scored.count() == 20 and scored.filter("recent is null").count() == 4
    # A batch that is run again replaces its folder.
    commits = str(tmp_path / "check" / "commits")
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(os.path.join(commits, name))
    run(spark, tmp_path, source, scorers)
    assert spark.read.parquet(f"{out}/scored").count() == 20


def test_alerts_become_work_orders(spark, tmp_path):
    source = str(tmp_path / "in")
    write(source, "m0.json", lines(data()))
    out = run(spark, tmp_path, source)
    scored = spark.read.parquet(f"{out}/scored")
    risky = scored.filter("final_score >= 0.6").count()
    assert scored.count() == 240 and risky >= 1
    dim = spark.createDataFrame([(123, "3", "high"), (7, "Damage", "d"), (8, "S1", "Hall"), (9, "E", "Tester")],
                                "id bigint, code string, description string")
    orders = str(tmp_path / "orders")
    scoring.run_work_orders(
        scoring.alert_stream(spark, out),
        lambda batch: cmms.work_orders(batch, dim, dim, dim, dim, "3", "Damage", "Hall", "Tester"),
        orders,
        str(tmp_path / "orders-check"),
    ).awaitTermination()
    made = spark.read.parquet(orders)
    assert made.count() == risky
    row = made.first()
    assert (row["priority"], row["type"], row["site"]["id"], row["requester"]["id"]) == (123, 7, 8, 9)
    assert json.loads(row["process_notes"])["RiskScore"] == 1.0


def test_repeated_messages_can_be_dropped(spark, tmp_path):
    texts, source = lines(data(30)), str(tmp_path / "in")
    write(source, "m0.json", texts + texts[:10])
    out = run(spark, tmp_path, source, dedupe="1 hour")
    assert spark.read.parquet(f"{out}/scored").count() == 30


def test_fitted_models_score_the_stream(spark, tmp_path):
    rows = data(300, seed=8)
    batch = views.labelled(spark.createDataFrame(rows)).cache()
    forest = models.random_forest(batch, TABULAR_FEATURES, "machine_failure", 5, 4)
    sequences = windows.sequences(batch, SEQUENCE_FEATURES, ["machine_id"], ["event_time", "udi"])
    recent = models.sequence_model(sequences, "machine_failure")
    path = str(tmp_path / "registry")
    models.save_registry({"forest": (forest, TABULAR_FEATURES)}, path, spark)
    loaded, features = models.load_registry(spark, path)["forest"]
    assert models.check_features(loaded, features)["matches"]
    assert not models.check_features(loaded, features[:-1])["matches"]
    source = str(tmp_path / "in")
    spoiled = rows.copy()
    spoiled.loc[5, "torque_nm"] = float("nan")
    write(source, "m0.json", lines(spoiled))
    out = run(
        spark,
        tmp_path,
        source,
        {
            "forest": scoring.tabular_scorer(loaded, "forest"),
            "recent": scoring.sequence_scorer(recent, "recent"),
        },
    )
    got = spark.read.parquet(f"{out}/scored")
    assert got.count() == 300
    assert got.filter("udi = 5 and forest is null and torque_nm is null").count() == 1
    expected = models.score(forest, batch, "p").select("udi", (F.col("p") > 0.5).cast("double").alias("e"))
    assert got.filter("udi <> 5").join(expected, "udi").filter("forest <> e").isEmpty()
    assert got.filter("recent is not null").count() > 200
    assert got.filter("final_score is null and (forest is not null or recent is not null)").isEmpty()


def test_dashboard_counts_stream(spark, tmp_path):
    scored = spark.createDataFrame(data(60)).withColumn("final_score", F.col("tool_wear_min") / 250)
    path = str(tmp_path / "scored")
    scored.write.parquet(path)
    stream = scoring.machine_counts(spark.readStream.schema(scored.schema).parquet(path), width="30 minutes")
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(
        availableNow=True
    ).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("n_readings")).first()[0] == 60


def test_alert_rows(spark):
    df = spark.createDataFrame([(1, 2, "2024-12-20 10:00:00", 0.6), (1, 3, "2024-12-20 10:00:00", 0.59)],
                               "machine_id long, udi long, t string, final_score double")
    rows = ensemble.alerts(df.withColumn("timestamp", F.to_timestamp("t"))).collect()
    assert [tuple(r) for r in rows] == [(1, 2, "2024-12-20 10:00:00", 0.6)]


def test_messages_have_one_value_column(spark):
    out = sinks.as_messages(spark.createDataFrame([(1, None)], "a int, b string")).first()["value"]
    assert json.loads(out) == {"a": 1, "b": None}


@pytest.mark.parametrize("files", [1, 8, 32])
def test_stream_sequences_do_not_depend_on_files(spark, tmp_path, files):
    folder = "/root/testdata/sf0.001"
    source = streams.messages(spark, folder, spoil=False, files=files)
    rows = scoring.with_sequences(readers.stream_json_files(spark, source, files_per_batch=files))
    running = (
        rows.filter("sequence is not null").select("udi", "sequence").writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    assert len([p for p in running.recentProgress if p["numInputRows"]]) >= 3
    got = {r.udi: r.sequence for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    table = views.labelled_readings(spark, folder)
    want = {r.udi: r.sequence for r in windows.sequences(table, SEQUENCE_FEATURES, ["machine_id"], ["event_time", "udi"]).collect()}
    assert set(got) == {u for u, s in want.items() if s is not None and len(s) == 5}
    assert all(np.allclose(np.array(got[u], float), np.array(want[u], float)) for u in got)


def _message(udi, machine=None, product=None, torque=40.0):
    body = {"UDI": udi, "Product ID": product, "Type": "L", "Air temperature [K]": 300.0, "Process temperature [K]": 310.0,
            "Rotational speed [rpm]": 1500, "Torque [Nm]": torque, "Tool wear [min]": 5, "machine_id": machine,
            "event_time": f"2024-01-01T00:00:{udi % 60:02d}.000000Z"}
    return json.dumps({k: v for k, v in body.items() if v is not None})


def _stream(spark, tmp_path, lines, **options):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines) + "\n")
    raw = readers.stream_json_files(spark, str(tmp_path / "in"))
    return raw, options


def test_messages_without_machine_have_their_own_buffer(spark, tmp_path):
    lines = [_message(i, machine=0) for i in range(4)] + [_message(10 + i, product="P1") for i in range(4)] + [_message(30, machine=0)]
    raw, _ = _stream(spark, tmp_path, lines)
    running = (
        scoring.with_sequences(raw).filter("sequence is not null").select("udi").writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    assert [r.udi for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [30]


def test_dedupe_keeps_rejected_messages(spark, tmp_path):
    lines = [_message(1, machine=1)] * 3 + ["not json %d" % i for i in range(5)]
    raw, _ = _stream(spark, tmp_path, lines)
    scoring.run(raw, {"rule": scoring.expression_scorer("rule", lambda: F.lit(0.9))}, str(tmp_path / "out"), str(tmp_path / "state"),
                dedupe="1 hour").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/quarantine")).count() == 5
    assert spark.read.parquet(str(tmp_path / "out/scored")).count() == 1


def test_a_repeated_batch_delivers_no_alert_twice(spark, tmp_path):
    alerts = spark.createDataFrame([(1, 5, "t1", 0.9), (None, 6, "t1", 0.8)], "machine_id long, udi long, predicted_failure_date string, risk_score double")
    path = str(tmp_path / "alerts/batch=0")
    scoring.deliver(alerts.limit(1), path)
    scoring.deliver(alerts.withColumn("predicted_failure_date", F.lit("later")), path)
    scoring.deliver(alerts, path)
    orders = str(tmp_path / "orders")
    scoring.run_work_orders(scoring.alert_stream(spark, str(tmp_path)), lambda b: b, orders, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.udi for r in spark.read.parquet(orders).collect()) == [5, 6]
