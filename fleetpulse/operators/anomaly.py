"""Unsupervised detectors: isolation forest, local outlier factor, density noise, one-class SVM.

A detector is fitted on training rows and adds a score that is larger for more
unusual rows. The score is shifted by the training quantile that belongs to the
contamination, so 0 is the natural cut; ``cut=0.5`` keeps the stricter cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetpulse.operators.graphs import components
from fleetpulse.operators.neighbors import (
    Cells,
    build_cells,
    count_within,
    distinct_vectors,
    knn,
    least_within,
    marked_rows,
    marks_within,
    roots_within,
    vector,
)
from fleetpulse.operators.ordering import add_ordinal, quantiles
from fleetpulse.session import written

# Contamination levels the detectors are run with.
CONTAMINATION_LEVELS = (0.005, 0.01, 0.02)


def _upper_quantile(df: DataFrame, score: str, contamination: float) -> float:
    """Score that ``contamination`` of the training rows lie above (exact, interpolated).

    The quantile takes several passes, so the scores are computed and stored once.
    """
    scores = written(df.select(score), "scores")
    row = quantiles(scores, [score], {"q": 1.0 - contamination}).first()
    return float(row["q"]) if row else 0.0


def flagged(score: Column, cut: float = 0.0) -> Column:
    return F.coalesce(score > cut, F.lit(False)).cast("int")


# Isolation forest


def _mean_path(n: float) -> float:
    """Average depth of an unsuccessful search in a binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def subsamples(
    df: DataFrame, key: str, trees: int, rows: int, seed: int, total: int | None = None
) -> DataFrame:
    """``(tree, ...)``: up to ``rows`` rows per tree, picked by hash.

    A bounded pool is kept by one hash per row, then shared out to the trees, so
    the cost per input row does not depend on the number of trees.
    """
    total = df.count() if total is None else total
    wanted = 2 * rows * trees
    share = min(1.0, wanted / max(total, 1))
    pool = df.filter(
        F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) <= int(share * (1 << 40))
    )
    copies = min(trees, max(1, -(-wanted // max(min(total, wanted), 1))))
    turn = F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(trees))
    shared = pool.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn(
        "tree", F.pmod(turn + F.col("__i"), F.lit(trees)).cast("int")
    )
    pick = Window.partitionBy("tree").orderBy(F.xxhash64(F.col(key), F.col("tree"), F.lit(seed + 2)), key)
    return (
        shared.withColumn("__rank", F.row_number().over(pick))
        .filter(F.col("__rank") <= rows)
        .drop("__i", "__rank")
    )


def _grow_tree(rows: np.ndarray, seed: int, limit: int) -> list[tuple]:
    """Random splits of one subsample: (node, depth, feature, cut, left, right, path length at a leaf)."""
    rng = np.random.default_rng(seed)
    nodes: list[list] = []
    stack = [(np.arange(len(rows)), 0, -1, 0)]
    while stack:
        index, depth, parent, side = stack.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][4 + side] = at
        part = rows[index]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(index) <= 1 or len(usable) == 0:
            nodes.append([at, depth, -1, 0.0, -1, -1, depth + _mean_path(len(index))])
            continue
        feature = int(rng.choice(usable))
        # A draw between values that are next to each other may round up to the higher one, which must stay right of the cut.
        cut = min(float(rng.uniform(low[feature], high[feature])), float(np.nextafter(high[feature], -np.inf)))
        left = part[:, feature] <= cut
        nodes.append([at, depth, feature, cut, -1, -1, 0.0])
        stack.append((index[left], depth + 1, at, 0))
        stack.append((index[~left], depth + 1, at, 1))
    return [tuple(n) for n in nodes]


def _packed(nodes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Arrays of one tree for scoring: feature, cut, children, path length, number of levels."""
    leaf = nodes["feature"].to_numpy() < 0
    own = nodes["node"].to_numpy(dtype="int64")
    children = np.where(leaf[:, None], own[:, None], nodes[["left", "right"]].to_numpy(dtype="int64"))
    feature = np.where(leaf, 0, nodes["feature"].to_numpy(dtype="int64"))
    cut = np.where(leaf, np.inf, nodes["cut"].to_numpy())
    return feature, cut, children.ravel(), nodes["length"].to_numpy(), int(nodes["depth"].max())


@dataclass(frozen=True)
class IsolationForest:
    """Fitted trees (at most trees x 511 nodes) and the score offset."""

    features: tuple[str, ...]
    trees: tuple[tuple, ...]
    rows: int
    offset: float = 0.0

    def raw(self) -> Column:
        trees, scale = self.trees, _mean_path(self.rows) or 1.0

        @F.pandas_udf("double")
        def unusual(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                n = len(batch)
                x = np.stack(batch.to_numpy()) if n else np.zeros((0, len(self.features)))
                columns, row = np.ascontiguousarray(x.T).ravel(), np.arange(n)
                depth = np.zeros(n)
                for feature, cut, children, length, levels in trees:
                    node = np.zeros(n, dtype="int64")
                    # Leaves lead to themselves, so all rows take the same number of steps.
                    for _ in range(levels):
                        right = columns[feature[node] * n + row] > cut[node]
                        node = children[2 * node + right]
                    depth += length[node]
                yield pd.Series(np.exp2(-depth / (len(trees) * scale)))

        return unusual(vector(self.features))

    def score(self, df: DataFrame, name: str = "isolation_forest") -> DataFrame:
        return df.withColumn(name, self.raw() - F.lit(self.offset))


def isolation_forest(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    contamination: float = 0.01,
    trees: int = 100,
    seed: int = 42,
    rows: int = 256,
) -> IsolationForest:
    """Fit an isolation forest: each tree is one small group, grown in parallel."""
    count = df.count()
    sample = subsamples(df.select(key, *features), key, trees, rows, seed, count)
    limit = math.ceil(math.log2(max(rows, 2)))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        ordered = part.sort_values(key)[list(features)].to_numpy(dtype="float64")
        grown = _grow_tree(ordered, seed * 1_000_003 + tree, limit)
        out = pd.DataFrame(grown, columns=["node", "depth", "feature", "cut", "left", "right", "length"])
        out.insert(0, "tree", tree)
        return out

    schema = "tree int, node int, depth int, feature int, cut double, left int, right int, length double"
    nodes = sample.groupBy("tree").applyInPandas(grow, schema).toPandas().sort_values(["tree", "node"])
    grown = tuple(_packed(part) for _, part in nodes.groupby("tree"))
    total = min(rows, count)
    bare = IsolationForest(tuple(features), grown, total)
    offset = _upper_quantile(bare.score(df, "__s"), "__s", contamination)
    return IsolationForest(tuple(features), grown, total, offset)


# Local outlier factor


@dataclass(frozen=True)
class LocalOutlierFactor:
    """Reference cells, the density of each reference and the score offset."""

    features: tuple[str, ...]
    cells: Cells
    density: DataFrame
    k: int
    offset: float

    def score(self, df: DataFrame, key: str, name: str = "lof") -> DataFrame:
        """Score new rows against the training rows; equal rows are scored once."""
        keyed = df.withColumn("__vec", vector(self.features))
        vectors = written(distinct_vectors(df, self.features, key).drop("m"), "lof-queries")
        near = knn(self.cells, self.k, vectors)
        factor = _outlier_factor(near, self.density)
        scored = vectors.join(factor, "vid").select(
            F.col("vec").alias("__vec"), (F.col("factor") - F.lit(self.offset)).alias(name)
        )
        return keyed.join(scored, "__vec", "left").drop("__vec")


def _local_density(near: DataFrame, kdist: DataFrame) -> DataFrame:
    """Reachability density from neighbour lists and the references' k-distances."""
    flat = near.select("vid", F.explode("neighbors").alias("x")).select("vid", "x.*")
    reach = F.greatest(F.col("kdist"), F.col("distance")) * F.col("n")
    return (
        flat.join(kdist.withColumnRenamed("vid", "neighbor"), "neighbor")
        .groupBy("vid")
        .agg((F.sum(reach) / F.sum("n")).alias("mean_reach"))
        .select("vid", (1.0 / (F.col("mean_reach") + 1e-10)).alias("lrd"))
    )


def _outlier_factor(near: DataFrame, density: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Mean density of the neighbours over the row's own density."""
    kdist = density.select("vid", "kdist")
    own = _local_density(near, kdist) if own is None else own
    flat = near.select("vid", F.explode("neighbors").alias("x")).select("vid", "x.neighbor", "x.n")
    lrd = density.select(F.col("vid").alias("neighbor"), F.col("lrd").alias("neighbor_lrd"))
    around = (
        flat.join(lrd, "neighbor")
        .groupBy("vid")
        .agg((F.sum(F.col("neighbor_lrd") * F.col("n")) / F.sum("n")).alias("around"))
    )
    return around.join(own.select("vid", "lrd"), "vid").select(
        "vid", (F.col("around") / F.col("lrd")).alias("factor")
    )


def local_outlier_factors(
    df: DataFrame, features: Sequence[str], key: str, k: int = 20
) -> tuple[Cells, DataFrame, DataFrame]:
    """Cells, ``(vid, kdist, lrd)`` and ``(vid, factor)`` of the training vectors."""
    cells = build_cells(distinct_vectors(df, features, key))
    near = written(knn(cells, k), "lof-near")
    kdist = near.select("vid", F.element_at("neighbors", -1)["distance"].alias("kdist"))
    density = written(kdist.join(_local_density(near, kdist), "vid"), "lof-density")
    return cells, density, _outlier_factor(near, density, density)


def local_outlier_factor(
    df: DataFrame, features: Sequence[str], key: str, contamination: float = 0.01, k: int = 20
) -> LocalOutlierFactor:
    """Fit the local outlier factor on training rows, for scoring new rows."""
    cells, density, factor = local_outlier_factors(df, features, key, k)
    copies = cells.refs.select("vid", "m").join(factor, "vid")
    # Every copy of a vector counts in the quantile.
    spread = copies.select(F.explode(F.array_repeat("factor", F.col("m").cast("int"))).alias("factor"))
    offset = _upper_quantile(spread, "factor", contamination)
    return LocalOutlierFactor(tuple(features), cells, density, k, offset)


# Density clusters


def _boxes(features: Sequence[str], eps: float) -> Column:
    """Number of a vector's grid box of diagonal ``eps``: two vectors of a box are never further apart."""
    # A shade below eps, so rounding does not matter.
    side = eps / math.sqrt(len(features)) * (1 - 1e-9)
    return F.transform("vec", lambda v: F.floor(v / F.lit(side)))


def core_vectors(df: DataFrame, features: Sequence[str], key: str, eps: float, min_points: int) -> DataFrame:
    """``(vid, vec, m, core)`` of the different vectors: core ones have ``min_points`` rows within ``eps``.

    Rows in a grid box that holds enough rows are core without any distance being computed.
    """
    boxed = distinct_vectors(df, features, key).withColumn("box", _boxes(features, eps))
    full = boxed.groupBy("box").agg(F.sum("m").alias("__in_box")).filter(F.col("__in_box") >= min_points)
    marked = written(
        boxed.join(full, "box", "left").select("vid", "vec", "m", F.col("__in_box").isNotNull().alias("dense")),
        "density-vectors",
    )
    around = count_within(build_cells(marked, stored=True), eps, marked.filter(~F.col("dense")), enough=min_points)
    core = F.col("dense") | (F.coalesce("n", F.lit(0)) >= min_points)
    return written(marked.join(around, "vid", "left").select("vid", "vec", "m", core.alias("core")), "density-core")


def _labelled(df: DataFrame, features: Sequence[str], labels: DataFrame, name: str, otherwise: int) -> DataFrame:
    found = labels.select("vec", F.col("label").alias(name))
    return (
        df.withColumn("vec", vector(features))
        .join(found, "vec", "left")
        .withColumn(name, F.coalesce(F.col(name), F.lit(otherwise)))
        .drop("vec")
    )


def density_noise(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    eps: float = 0.5,
    min_points: int = 5,
    name: str = "noise",
) -> DataFrame:
    """Add 1 for rows that density clustering leaves out of every cluster, else 0.

    A row is noise when fewer than ``min_points`` rows lie within ``eps`` and none
    of those is a core row. Cluster numbers are not needed for that.
    """
    judged = core_vectors(df, features, key, eps, min_points)
    rest = judged.filter(~F.col("core"))
    core = judged.filter("core")
    if core.isEmpty():
        noise = rest
    else:
        noise = rest.join(least_within(build_cells(core, stored=True), eps, rest), "vid", "left_anti")
    return _labelled(df, features, noise.select("vec", F.lit(1).alias("label")), name, 0)


def dbscan_labels(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    eps: float = 0.5,
    min_points: int = 5,
    name: str = "cluster",
) -> DataFrame:
    """Add the density cluster of each row: the smallest key of its core rows, -1 for noise.

    Core rows within ``eps`` of each other share a cluster; a row within ``eps`` of core rows of
    several clusters goes to the smallest. Core rows of a top cell are joined first, top cells that
    meet link the roots of such parts, and components of roots are found by contraction rounds, so
    no step holds all pairs of a dense place.
    """
    judged = core_vectors(df, features, key, eps, min_points)
    core = judged.filter("core")
    if core.isEmpty():
        return df.withColumn(name, F.lit(-1).cast("bigint"))
    rooted, links = roots_within(build_cells(core, stored=True), eps)
    # Rows with gaps have no distances; they share the cluster of their box only.
    gaps = core.filter(F.exists("vec", lambda v: v.isNull() | F.isnan(v))).withColumn("box", _boxes(features, eps))
    heads = gaps.groupBy("box").agg(F.min("vid").alias("dst"))
    inside = gaps.join(heads, "box").select(F.col("vid").alias("src"), "dst")
    parts = components(inside.unionByName(links)).select(F.col("node").alias("m"), "label")
    final = F.coalesce("label", "m").alias("label")
    labels = marked_rows(rooted).join(parts, "m", "left").select("vec", final)
    rest = judged.filter(~F.col("core"))
    met = marks_within(rooted, eps, rest).join(parts.withColumnRenamed("m", "mark"), "mark", "left")
    least = met.groupBy("vid").agg(F.min(F.coalesce("label", "mark")).alias("label"))
    border = rest.join(least, "vid").select("vec", "label")
    return _labelled(df, features, labels.unionByName(border), name, -1)


# One-class support vectors


@dataclass(frozen=True)
class OneClassSvm:
    """Linear one-class boundary over fixed random Fourier features of an RBF kernel."""

    features: tuple[str, ...]
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    offset: float

    def raw(self, vec: Column) -> Column:
        directions, phases, weights = self.directions, self.phases, self.weights

        @F.pandas_udf("double")
        def inner(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype="float64")
            return pd.Series(_fourier(np.stack(batch.to_numpy()), directions, phases) @ weights)

        return F.lit(self.offset) - inner(vec)

    def score(self, df: DataFrame, name: str = "ocsvm") -> DataFrame:
        return df.withColumn(name, self.raw(vector(self.features)))


def _fourier(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phases)) * np.cos(x @ directions + phases)


def one_class_svm(
    df: DataFrame,
    features: Sequence[str],
    nu: float = 0.01,
    dimensions: int = 128,
    rounds: int = 15,
    gamma: float | None = None,
    seed: int = 42,
) -> OneClassSvm:
    """Fit a one-class SVM with an RBF kernel, approximated by random features.

    Every round finds the margin and sums sub-gradients per partition; only
    vectors of ``dimensions`` values reach the driver. The offset is the exact
    ``nu`` quantile of the training scores.
    """
    d = len(features)
    # Read many times, so the vectors are stored once.
    rows = written(df.select(vector(features).alias("vec")), "svm-vectors")
    if gamma is None:
        # 1 / (features * variance of all matrix cells).
        cells = rows.select(F.explode("vec").alias("v")).agg(F.var_pop("v").alias("var")).first()
        gamma = 1.0 / (d * (cells["var"] or 1.0))
    rng = np.random.default_rng(seed)
    directions = rng.normal(scale=math.sqrt(2.0 * gamma), size=(d, dimensions))
    phases = rng.uniform(0.0, 2.0 * math.pi, size=dimensions)

    def mean_features(weights: np.ndarray | None, rho: float) -> np.ndarray:
        """Mean feature vector of all rows (start) or of the rows at or below the margin."""

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, hits = np.zeros(dimensions), 0
            for batch in batches:
                if not len(batch):
                    continue
                z = _fourier(np.stack(batch["vec"].to_numpy()), directions, phases)
                hit = np.ones(len(z), dtype=bool) if weights is None else z @ weights <= rho
                total += z[hit].sum(axis=0)
                hits += int(hit.sum())
            yield pd.DataFrame({"i": np.arange(dimensions), "s": total, "hits": hits})

        out = (
            rows.mapInPandas(part, "i int, s double, hits bigint")
            .groupBy("i")
            .agg(F.sum("s").alias("s"), F.sum("hits").alias("hits"))
            .orderBy("i")
            .collect()
        )
        return np.array([r["s"] for r in out]) / max(out[0]["hits"], 1)

    # All rows inside the margin would give the mean feature vector, a good start.
    weights = mean_features(None, 0.0)
    for step in range(1, rounds + 1):
        # For given weights the best margin is the nu quantile of the projections.
        bare = OneClassSvm(tuple(features), directions, phases, weights, 0.0)
        margin = rows.agg(F.approx_percentile(-bare.raw(F.col("vec")), nu, 10_000).alias("q"))
        rho = margin.first()["q"]
        rate = 1.0 / (step + 1.0)
        weights = (1.0 - rate) * weights + rate * mean_features(weights, rho)
    bare = OneClassSvm(tuple(features), directions, phases, weights, 0.0)
    offset = _upper_quantile(rows.select(bare.raw(F.col("vec")).alias("__s")), "__s", nu)
    return OneClassSvm(tuple(features), directions, phases, weights, -offset)


# Synthetic minority rows


def drawn(number: Column, tag: str, seed: int, sides: Column | int) -> Column:
    """A repeatable draw from 0 to ``sides - 1`` for each number: the first 32 bits of an MD5, which every SQL engine has."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), number.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(sides) if isinstance(sides, int) else sides)


def smote(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    minority: int = 1,
    k: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Rows of both classes plus interpolated minority rows up to the majority's size.

    Returns ``features`` as doubles, ``label`` and ``synthetic`` (0/1). Each new
    row lies between a minority row and one of its ``k`` nearest minority rows.
    """
    doubles = [F.col(c).cast("double").alias(c) for c in features]
    originals = df.select(*doubles, F.col(label), F.lit(0).alias("synthetic"))
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    few = counts.get(minority, 0)
    missing = max(counts.values(), default=0) - few
    if few < 2 or missing <= 0:
        return originals
    small = df.filter(F.col(label) == minority).select(
        F.col(key).cast("bigint").alias("key"), vector(features).alias("vec")
    )
    cells = build_cells(distinct_vectors(df.filter(F.col(label) == minority), features, key))
    near = written(knn(cells, k), "smote-near")
    # One entry per neighbour: copies of a vector are repeated.
    edges = F.flatten(
        F.transform("neighbors", lambda x: F.array_repeat(x["neighbor"], x["n"].cast("int")))
    )
    lists = cells.refs.select("vid", "vec").join(near.select("vid", edges.alias("edges")), "vid")
    numbered = add_ordinal(small, "key", name="place")
    draws = df.sparkSession.range(missing).select(
        drawn(F.col("id"), "place", seed, few).alias("place"),
        drawn(F.col("id"), "turn", seed, 1 << 20).alias("turn"),
        (drawn(F.col("id"), "step", seed, 1 << 30) / F.lit(float(1 << 30))).alias("u"),
    )
    based = numbered.join(draws, "place").join(lists, "vec")
    chosen = F.element_at("edges", (F.col("turn") % F.size("edges") + 1).cast("int"))
    other = cells.refs.select(F.col("vid").alias("neighbor"), F.col("vec").alias("other"))
    mixed = (
        based.select("vec", "u", chosen.alias("neighbor"))
        .join(other, "neighbor")
        .select(F.zip_with("vec", "other", lambda a, b: (b - a)).alias("gap"), "vec", "u")
        .select(F.zip_with("vec", "gap", lambda a, g: a + F.col("u") * g).alias("vec"))
    )
    made = mixed.select(
        *[F.col("vec")[i].alias(c) for i, c in enumerate(features)],
        F.lit(minority).cast(df.schema[label].dataType).alias(label),
        F.lit(1).alias("synthetic"),
    )
    return originals.unionByName(made)
