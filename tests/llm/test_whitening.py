"""Whitening against whole-number sums in plain Python and numpy's covariance."""

import math
import os
import random

import numpy as np
import pytest

from fleetpulse.llm import whitening

FOLDER = "/root/testdata/sf0.001"


def expected(vectors):
    """n, deviations, whitened, explained from Python's whole numbers."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    dev = [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]
    centred = np.array([[(n * r[i] - s[i]) / n for i in range(d)] for r in x])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    return n, dev, centred @ vectors / np.sqrt(values), values / np.trace(cov)


def compare(rows, ids, vectors):
    n, dev, white, explained = expected(vectors)
    k = white.shape[1]
    got = {}
    for r in rows:
        got[(r["vec_id"], r["component"])] = r
    assert len(rows) == len(got) == n * k
    for j in range(k):
        column = np.array([got[(i, j + 1)]["whitened"] for i in ids])
        assert min(np.abs(column - white[:, j]).max(), np.abs(column + white[:, j]).max()) < 1e-6
        assert abs(got[(ids[0], j + 1)]["explained"] / explained[j] - 1) < 1e-9
    assert [got[(i, 1)]["deviation"] for i in ids] == dev
    assert {r["n"] for r in rows} == {n}
    (error,) = {r["identity_error"] for r in rows}
    assert error < 1e-8


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
def test_query_equals_plain_python(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    vectors = [[float(c) for c in r["embedding"]] for r in rows]
    compare(whitening.op12_whitening(spark, FOLDER).collect(), [r["vec_id"] for r in rows], vectors)


def test_rows_that_take_no_part(spark):
    rng = random.Random(2)
    good = [[rng.gauss(0, 1), rng.gauss(5, 3), -2.5 * rng.random()] for _ in range(70)]
    good[7] = good[3]
    rows = [(i, v, "x") for i, v in enumerate(good)]
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, float("inf"), 0.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    rows += [(1000 + i, v, "x") for i, v in enumerate(bad)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string").repartition(5)
    compare(whitening.whiten(table).collect(), list(range(70)), good)
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.where("embedding IS NULL")).count() == 0


def test_repeated_and_null_keys_come_back(spark):
    rows = [(None, [0.0, 1.0]), (None, [0.0, 1.0]), (4, [1.0, 0.0]), (4, [2.0, 5.0])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"] or -1, r["component"]) for r in out) == [(-1, 1), (-1, 1), (-1, 2), (-1, 2), (4, 1), (4, 1), (4, 2), (4, 2)]


def test_constant_dimensions_and_one_row(spark):
    rows = [(i, [3.0, float(i), float(2 * i)]) for i in range(6)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["component"], r["whitened"] is None) for r in out} == {(1, False), (2, True), (3, True)}
    assert abs(sum(r["explained"] for r in out if r["vec_id"] == 0) - 1) < 1e-12
    (one,) = whitening.whiten(spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<double>")).collect()
    assert (one["n"], one["deviation"], one["whitened"], one["explained"], one["identity_error"]) == (1, 0, None, 0.0, None)


def test_wide_ranges_stay_exact(spark):
    rng = random.Random(4)
    vectors = [[rng.uniform(-1e15, 1e15), rng.uniform(-1, 1), rng.uniform(0, 1e6)] for _ in range(300)]
    rows = whitening.clean(
        spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(7), "vec_id", "embedding"
    )
    model = whitening.fit(rows)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    assert [s + model.n * int(a) for s, a in zip(model.sums, model.low)] == [sum(r[i] for r in x) for i in range(3)]
    n, s = model.n, [sum(r[i] for r in x) for i in range(3)]
    trace = sum(n * sum(r[i] ** 2 for r in x) - s[i] ** 2 for i in range(3)) / n**2
    assert math.isclose(model.trace, trace, rel_tol=1e-15)
    # too wide for a long
    assert all(r["deviation"] is None for r in whitening.transform(rows, model, "vec_id").collect())


def test_plane_counts_equal_products():
    rng = np.random.default_rng(1)
    x = rng.integers(-40, 90, (333, 5)) * np.array([1, 1, 0, 1000, 7])
    low = x.min(axis=0)
    bits = np.array([int(v).bit_length() for v in x.max(axis=0) - low])
    products = whitening.weighted(whitening.counts(whitening.planes(x, low, bits)), bits)
    y = np.hstack([x - low, np.ones((333, 1), np.int64)])
    assert products == (y.T @ y).tolist()
