"""Neighbour search and the detectors built on it, against brute force."""

import numpy as np
import pandas as pd
import pytest

from fleetpulse.operators import anomaly, graphs, neighbors


def points(n=400, d=3, seed=1, copies=60):
    """Clusters, scattered points and one vector that owns a large share of the rows."""
    rng = np.random.default_rng(seed)
    x = np.concatenate(
        [rng.normal(0, 0.3, (n // 2, d)), rng.normal(3, 0.5, (n // 3, d)), rng.uniform(-8, 8, (n // 6, d))]
    )
    x = np.concatenate([x, np.tile(x[5], (copies, 1))])
    return pd.DataFrame({"id": np.arange(len(x)), **{f"x{j}": x[:, j] for j in range(d)}})


def distances(a, b):
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


@pytest.mark.parametrize("rows_per_cell,chunk", [(1000, 8000), (20, 8000), (30, 7)])
def test_knn_matches_brute_force(spark, rows_per_cell, chunk):
    data = points()
    cols = ["x0", "x1", "x2"]
    x = data[cols].to_numpy()
    df = spark.createDataFrame(data)
    cells = neighbors.build_cells(neighbors.distinct_vectors(df, cols, "id"), rows_per_cell)
    got = neighbors.knn(cells, 6, rows_per_chunk=chunk).collect()
    d = distances(x, x)
    np.fill_diagonal(d, np.inf)
    for r in got:
        flat = [n["distance"] for n in r["neighbors"] for _ in range(n["n"])]
        assert np.allclose(flat, np.sort(d[r["vid"]])[:6], atol=1e-12)
    assert len(got) == len(np.unique(x, axis=0))


def test_knn_of_new_rows(spark):
    data, other = points(), points(120, seed=7, copies=5)
    cols = ["x0", "x1", "x2"]
    cells = neighbors.build_cells(neighbors.distinct_vectors(spark.createDataFrame(data), cols, "id"), 25)
    queries = neighbors.distinct_vectors(spark.createDataFrame(other), cols, "id").drop("m")
    d = distances(other[cols].to_numpy(), data[cols].to_numpy())
    for r in neighbors.knn(cells, 4, queries, rows_per_chunk=11).collect():
        flat = [n["distance"] for n in r["neighbors"] for _ in range(n["n"])]
        assert np.allclose(flat, np.sort(d[r["vid"]])[:4], atol=1e-12)


def test_knn_with_too_few_rows(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 5.0)], "id long, x double")
    cells = neighbors.build_cells(neighbors.distinct_vectors(df, ["x"], "id"))
    got = {r["vid"]: [n["distance"] for n in r["neighbors"]] for r in neighbors.knn(cells, 9).collect()}
    assert got == {0: [1.0, 5.0], 1: [1.0, 4.0], 2: [4.0, 5.0]}


def test_count_within(spark):
    data = points()
    cols = ["x0", "x1", "x2"]
    cells = neighbors.build_cells(
        neighbors.distinct_vectors(spark.createDataFrame(data), cols, "id"), 20
    )
    d = distances(data[cols].to_numpy(), data[cols].to_numpy())
    for r in neighbors.count_within(cells, 0.5, rows_per_chunk=9).collect():
        assert r["n"] == (d[r["vid"]] <= 0.5).sum()


def brute_noise(x, eps, min_points):
    d = distances(x, x) <= eps
    core = d.sum(axis=1) >= min_points
    return (~core & ~(d & core[None, :]).any(axis=1)).astype(int)


@pytest.mark.parametrize("eps,min_points", [(0.5, 5), (0.2, 4), (20.0, 5), (1e-6, 5)])
def test_density_noise(spark, eps, min_points):
    data = points()
    cols = ["x0", "x1", "x2"]
    got = anomaly.density_noise(spark.createDataFrame(data), cols, "id", eps, min_points).toPandas()
    expected = brute_noise(data[cols].to_numpy(), eps, min_points)
    assert got.sort_values("id")["noise"].tolist() == expected.tolist()


def brute_labels(x, eps, min_points):
    d = distances(x, x) <= eps
    core = d.sum(axis=1) >= min_points
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        near = np.where(d & core[None, :], label[None, :], len(x)).min(axis=1)
        if (near[core] == label[core]).all():
            return np.where(near == len(x), -1, near)
        label[core] = near[core]


@pytest.mark.parametrize("eps,min_points,cell", [(0.5, 5, 256), (0.2, 4, 16), (20.0, 5, 32), (1e-6, 5, 256), (1e-9, 500, 256)])
def test_dbscan_labels(spark, eps, min_points, cell, monkeypatch):
    monkeypatch.setattr(neighbors.build_cells, "__defaults__", (cell, 64))
    data = points()
    cols = ["x0", "x1", "x2"]
    got = anomaly.dbscan_labels(spark.createDataFrame(data), cols, "id", eps, min_points).toPandas()
    assert got.sort_values("id")["cluster"].tolist() == brute_labels(data[cols].to_numpy(), eps, min_points).tolist()


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000 - i, 999 - i) for i in range(0, 90)] + [(5000, 5000), (7, 7)]
    star = [(2000, 2000 + i) for i in range(1, 200)]
    links = spark.createDataFrame(chain + star, "src long, dst long")
    got = {r["node"]: r["label"] for r in graphs.components(links).collect()}
    want = {i: 0 for i in range(301)} | {i: 910 for i in range(910, 1001)} | {2000 + i: 2000 for i in range(200)}
    assert got == want


def test_many_top_cells_give_exact_neighbours(spark):
    data = points(600, copies=0)
    cols = ["x0", "x1", "x2"]
    x = data[cols].to_numpy()
    cells = neighbors.build_cells(neighbors.distinct_vectors(spark.createDataFrame(data), cols, "id"), 8, 40)
    assert cells.tree.depth == 4
    d = distances(x, x)
    np.fill_diagonal(d, np.inf)
    for r in neighbors.knn(cells, 7).collect():
        assert np.allclose([n["distance"] for n in r["neighbors"]], np.sort(d[r["vid"]])[:7], atol=1e-12)


def brute_lof(train, test, k):
    d = distances(train, train)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    kdist = dist[:, -1]
    lrd = 1 / (np.maximum(dist, kdist[near]).mean(axis=1) + 1e-10)
    own = lrd[near].mean(axis=1) / lrd
    e = distances(test, train)
    near_t = np.argsort(e, axis=1, kind="stable")[:, :k]
    lrd_t = 1 / (np.maximum(np.take_along_axis(e, near_t, 1), kdist[near_t]).mean(axis=1) + 1e-10)
    return own, lrd[near_t].mean(axis=1) / lrd_t


def test_local_outlier_factor(spark):
    train, test = points(300, copies=0), points(60, seed=9, copies=0)
    cols = ["x0", "x1", "x2"]
    own, new = brute_lof(train[cols].to_numpy(), test[cols].to_numpy(), 8)
    model = anomaly.local_outlier_factor(spark.createDataFrame(train), cols, "id", 0.05, 8)
    assert np.isclose(model.offset, np.percentile(own, 95))
    got = model.score(spark.createDataFrame(test), "id").toPandas().sort_values("id")["lof"]
    assert np.allclose(got + model.offset, new, rtol=1e-9)


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (500, 2)), [[9.0, 9.0], [-10.0, 8.0]]])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(502), "a": x[:, 0], "b": x[:, 1]}))
    model = anomaly.isolation_forest(df, ["a", "b"], "id", 0.01, trees=50)
    got = model.score(df).toPandas().sort_values("isolation_forest", ascending=False)
    assert set(got["id"].head(2)) == {500, 501}
    assert (got["isolation_forest"] > 0).sum() in (5, 6)
    again = anomaly.isolation_forest(df.repartition(7), ["a", "b"], "id", 0.01, trees=50)
    assert again.offset == model.offset


def test_trees_split_values_next_to_each_other():
    rows = np.array([[1.0], [np.nextafter(1.0, 2.0)], [np.nextafter(1.0, 2.0)]])
    for seed in range(20):
        nodes = anomaly._grow_tree(rows, seed, 8)
        assert [n[0] for n in nodes] == [0, 1, 2]
        assert nodes[0][3] == 1.0


def test_one_class_svm_finds_outliers(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (500, 2)), [[9.0, 9.0], [-10.0, 8.0]]])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(502), "a": x[:, 0], "b": x[:, 1]}))
    got = anomaly.one_class_svm(df, ["a", "b"], 0.05, rounds=5).score(df).toPandas()
    assert abs((got["ocsvm"] > 0).mean() - 0.05) < 0.01
    assert (got.set_index("id")["ocsvm"].loc[[500, 501]] > 0).all()


def test_smote_rows_lie_between_minority_neighbours(spark):
    data = points(120, d=2, copies=3)
    data["y"] = (data["id"] % 6 == 0).astype(int)
    df = spark.createDataFrame(data)
    out = anomaly.smote(df, ["x0", "x1"], "y", "id", k=3).toPandas()
    counts = out["y"].value_counts()
    assert counts[0] == counts[1]
    few = data[data["y"] == 1][["x0", "x1"]].to_numpy()
    d = distances(few, few)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :3]
    for p in out[out["synthetic"] == 1][["x0", "x1"]].to_numpy():
        gaps = []
        for i, row in enumerate(near):
            for j in row:
                a, b = few[i], few[j]
                t = 0.0 if np.allclose(a, b) else np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
                gaps.append(np.abs(a + t * (b - a) - p).max())
        assert min(gaps) < 1e-9


def test_search_moves_no_rows_between_tasks(spark):
    cols = ["x0", "x1", "x2"]
    cells = neighbors.build_cells(neighbors.distinct_vectors(spark.createDataFrame(points()), cols, "id"), 16, 64)
    for found in (neighbors.knn(cells, 5), neighbors.count_within(cells, 0.5), neighbors.count_within(cells, 0.5, enough=3)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
        # the task numbers they start from are no measure of their size
        joined = cells.refs.join(found.filter("vid > 3").select("vid"), "vid", "left")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in joined and "Broadcast" not in joined


def test_counting_ends_when_there_are_enough(spark):
    data, cols = points(), ["x0", "x1", "x2"]
    cells = neighbors.build_cells(neighbors.distinct_vectors(spark.createDataFrame(data), cols, "id"), 16, 64)
    whole = {r["vid"]: r["n"] for r in neighbors.count_within(cells, 0.5).collect()}
    some = {r["vid"]: r["n"] for r in neighbors.count_within(cells, 0.5, enough=5).collect()}
    assert {v: n >= 5 for v, n in whole.items()} == {v: n >= 5 for v, n in some.items()}
    assert all(some[v] == n for v, n in whole.items() if n < 5) and sum(some.values()) < sum(whole.values())


def test_a_dense_place_gives_few_links(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.uniform(0, 1, (800, 2)), rng.uniform(50, 51, (200, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(1000), "a": x[:, 0], "b": x[:, 1]}))
    cells = neighbors.build_cells(neighbors.distinct_vectors(df, ["a", "b"], "id"), 16, 64)
    rooted, links = neighbors.roots_within(cells, 0.5)
    assert rooted.blocks.count() > 60 and links.distinct().count() <= 120
    assert neighbors.marked_rows(rooted).select("m").distinct().count() <= 32
    got = {(r["node"], r["label"]) for r in graphs.components(links).collect()}
    assert {label for _, label in got} <= {0, 800}
