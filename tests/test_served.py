"""Snapshots, the model registry, replayed streams, released state and paired matrices."""

import json
import time

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import models, prep, registry
from fleetpulse.plans import served
from fleetpulse.schema import SENSORS, TABULAR_FEATURES
from fleetpulse.sources import readers, snapshots
from fleetpulse.streaming import scoring
from tests.test_streaming import SHORT, data, lines, write


def test_readers_keep_their_version(spark, tmp_path):
    root = str(tmp_path / "tables")
    one, two = spark.range(3), spark.range(5)
    assert snapshots.replace_tables({"a": one, "b": one}, root) == 1
    pinned = snapshots.read_table(spark, root, "a")
    with pytest.raises(Exception, match="went away"):
        snapshots.replace_tables({"a": two, "b": two.select(F.raise_error(F.lit("went away")))}, root)
    assert snapshots.versions(spark, root) == [1] and snapshots.names(spark, root) == ["v-0000000001"]
    assert snapshots.replace_tables({"a": two, "b": two}, root) == 2
    assert pinned.count() == 3 and snapshots.read_table(spark, root, "a").count() == 5
    with pytest.raises(FileExistsError):
        snapshots.rename(spark, snapshots.location(root, 1), snapshots.location(root, 2))
    assert snapshots.expire(spark, root, 1) == [1] and snapshots.latest(spark, root) == 2
    with pytest.raises(FileNotFoundError):
        snapshots.latest(spark, str(tmp_path / "nothing"))


def training(spark):
    rows = spark.createDataFrame(data(300))
    return scoring.with_features(rows).withColumn("failure_risk", F.greatest("twf_condition", "hdf_condition", "pwf_condition", "osf_condition"))


def test_registry_keeps_scaler_and_selection(spark, tmp_path):
    rows = training(spark).withColumn("y", F.col("failure_risk"))
    scaler = prep.fit_standard(rows, TABULAR_FEATURES)
    kept = ("power", "tool_torque_product", "temp_diff")
    forest = models.random_forest(scaler.transform(rows), kept, "y", trees=5, depth=4)
    artefact = registry.Artefact(forest, tuple(TABULAR_FEATURES), scaler=scaler, selected=kept)
    root = str(tmp_path / "models")
    assert registry.publish(spark, root, {"forest": artefact}) == 1
    back = registry.load(spark, root)["forest"]
    assert (back.features, back.selected, back.scaler) == (artefact.features, kept, scaler)
    direct = models.score(forest, scaler.transform(rows), "p").select("udi", (F.col("p") > 0.5).cast("double").alias("v"))
    gaps = rows.withColumn("power", F.when(F.col("udi") != 7, F.col("power")))
    out = registry.scorer(back, "vote")(gaps)
    assert out.columns == [*gaps.columns, "vote"]
    want = {r["udi"]: r["v"] for r in direct.collect()}
    for r in out.collect():
        assert r["vote"] == (None if r["udi"] == 7 else want[r["udi"]])
    # the row itself is not scaled
    assert out.agg(F.max("air_temp_k")).first()[0] > 290
    with pytest.raises(ValueError):
        registry.publish(spark, root, {"forest": registry.Artefact(forest, tuple(TABULAR_FEATURES))})
    assert snapshots.versions(spark, root) == [1]
    current = registry.Current(root)
    first, version = current(spark)
    assert version == 1 and current(spark)[0] is first
    registry.publish(spark, root, {"forest": artefact, "twin": artefact})
    second, version = current(spark)
    assert version == 2 and sorted(second) == ["forest", "twin"]


def test_interrupted_batches_are_not_doubled(spark, tmp_path):
    rows = data(90)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    texts = lines(rows)
    for i in range(3):
        part = texts[30 * i : 30 * i + 30]
        write(source, f"m{i}.json", part + part[:11])
    rule = {"rule": scoring.expression_scorer("rule", lambda: F.col("failure_risk").cast("double"))}

    def start(watch):
        raw = readers.stream_json_files(spark, source, files_per_batch=1)
        return scoring.run(raw, rule, out, str(tmp_path / "check"), dedupe="1 hour", watch=watch)

    points = {("scored", 0), ("scored", 1), ("alerts", 1), ("quarantine", 2), ("commits", 2)}
    assert served.replayed(spark, start, points) == len(points)
    stored = scoring.committed(spark, out, "scored")
    assert sorted(r["udi"] for r in stored.select("udi").collect()) == list(range(90))
    alerts = scoring.decode_alerts(spark.read.option("recursiveFileLookup", "true").schema("value string").text(f"{out}/alerts"))
    assert alerts.count() == alerts.distinct().count() == stored.filter("final_score >= 0.6").count() > 0


def test_unfinished_batches_are_not_read(spark, tmp_path):
    out = str(tmp_path / "out")
    for batch in (0, 1):
        spark.range(batch * 10, batch * 10 + 4).write.parquet(f"{out}/scored/batch={batch}")
    snapshots.create(spark, f"{out}/commits/0")
    assert sorted(r["id"] for r in scoring.committed(spark, out, "scored").collect()) == [0, 1, 2, 3]


def test_state_of_a_silent_machine_is_released(spark, tmp_path):
    rows = data(40)
    rows["machine_id"] = 5
    texts = lines(rows)
    source = str(tmp_path / "in")
    write(source, "m0.json", texts[:4])
    raw = readers.stream_json_files(spark, source, files_per_batch=1)
    found = scoring.with_sequences(raw, silence=1500).select("udi", F.col("sequence").isNotNull().alias("full"))
    running = (
        found.writeStream.format("memory").queryName("released").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    )
    try:
        for _ in range(120):
            time.sleep(0.5)
            if spark.table("released").count() == 4:
                break
        for _ in range(120):
            time.sleep(0.5)
            last = running.lastProgress
            if last and json.loads(last.json)["stateOperators"][0]["numRowsTotal"] == 0:
                break
        write(source, "m1.json", texts[4:10])
        for _ in range(120):
            time.sleep(0.5)
            if spark.table("released").count() == 10:
                break
    finally:
        running.stop()
    # with the four vectors kept, the fifth message would have a full window
    got = {r["udi"]: r["full"] for r in spark.table("released").collect()}
    assert got == {i: i >= 8 for i in range(10)}


def test_matrices_are_paired_by_place(spark, tmp_path):
    x, y = str(tmp_path / "a" / "X_train"), str(tmp_path / "a" / "y_train")
    spark.range(0, 100, 1, 7).select((F.col("id") * 2).alias("v")).write.parquet(x)
    spark.range(0, 90, 1, 3).select((F.col("id") % 3).alias("label")).write.parquet(y)
    got = sorted((r["v"], r["label"]) for r in readers.read_paired(spark, x).collect())
    assert got == [(2 * i, i % 3) for i in range(90)]
    assert readers.labels_path("/m/X_test_3") == "/m/y_test_3"
    with pytest.raises(ValueError):
        readers.read_paired(spark, x, x)
    assert len(SENSORS) == 5 and SHORT


def test_matrices_are_not_broadcast(spark, tmp_path):
    x = str(tmp_path / "X_big")
    spark.range(2000).selectExpr("id as v").repartition(3).write.parquet(x)
    spark.range(2000).selectExpr("0 as label").repartition(2).write.parquet(readers.labels_path(x))
    plan = readers.read_paired(spark, x)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    # rows are paired by a merge; of file names and rows, the names are the side that is broadcast
    assert len(joins) == 3 and "SortMergeJoin [place" in joins[0]
    assert all("BroadcastHashJoin" in line and "BuildRight" in line for line in joins[1:])


def test_slices_of_time_are_bounded(spark):
    rows = spark.range(1000).selectExpr("id", "case when id % 10 = 0 then null when id % 4 = 1 then 500 else cast(id as double) end as at")
    slices = [[r["at"] for r in part.collect()] for part in served.time_slices(rows, "at", 100)]
    assert len(slices) > 5 and sum(map(len, slices)) == 1000
    assert max(len(s) for s in slices) < 400
    assert sum(None in s for s in slices) == 1 and None in slices[-1]
    known = [[v for v in s if v is not None] for s in slices]
    assert all(max(a) < min(b) for a, b in zip(known, known[1:]))
    assert len(served.time_slices(rows, "at")) == 1


def test_replay_with_many_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(served, "ROWS_PER_SLICE", 60)
    monkeypatch.setattr(served, "slice_files", lambda spark: 1)
    n = 300
    events = spark.range(n).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id * 2 as int), 0, 0) as ts",
        "id % 4 as user_id", "'view' as event_type", "cast(id % 50 as double) as value", "'{\"k\": 7}' as props",
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    batches = []
    monkeypatch.setattr(served.scoring, "committed", lambda s, o, name, f=scoring.committed: batches.append(f(s, o, name)) or batches[-1])
    got = served.stream_replayed(spark, str(tmp_path)).collect()
    # a message in three that are spoiled is set aside; none of the others is lost or doubled
    assert sorted(r["udi"] for r in got) == [i for i in range(n) if i % 101 and i % 103 and i % 107]
    assert {r["n_stored"] for r in got} == {1}
    assert batches[0].select("batch").distinct().count() > 3
