"""Approximate nearest neighbours over learned partitions.

On a bounded sample the neighbour graph is cut into balanced parts, and a small
network learns which part a vector belongs to. Every vector is filed under its
most probable part; a query goes to several most probable parts and is reranked
against all of their vectors by exact cosine. How many parts are asked is set on
the sample so that nearly all true neighbours are in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.llm.common import attach, table
from fleetpulse.session import written

#: Vectors that the graph and the classifier are fitted on; bounds the driver's work.
SAMPLE = 4096
#: Vectors a part should hold, as far as PARTS_MOST and the sample allow.
PART_ROWS = 256
PARTS_MOST = 256
GRAPH_NEIGHBOURS = 10
HIDDEN = 128
#: Share of the true neighbours in the sample that the parts asked must hold.
COVER = 0.98
QUERY_EVERY = 50
NEAREST = 5
BLOCK_ROWS = 4096
#: Cosines that agree to so many decimals are ties.
TIE_DIGITS = 12


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest other rows by cosine of unit rows."""
    k = min(k, len(x) - 1)
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    return np.argpartition(-score, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(x), 0), int)


def balanced_parts(near: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Cut the neighbour graph into ``parts`` (a power of two) of equal size by recursive bisection.

    A bisection starts from the second eigenvector of the random walk and is
    improved by swapping the rows that gain most from changing sides.
    """
    n = len(near)
    graph = np.zeros((n, n), np.float32)
    graph[np.arange(n)[:, None], near] = 1
    graph = np.maximum(graph, graph.T)
    rng = np.random.default_rng(seed)
    label = np.zeros(n, int)
    level = 1
    while level < parts:
        for p in range(level):
            rows = np.flatnonzero(label == p)
            if len(rows) < 2:
                continue
            sub = graph[np.ix_(rows, rows)]
            degree = np.maximum(sub.sum(axis=1), 1e-6)
            root = np.sqrt(degree)
            v = rng.standard_normal(len(rows)).astype(np.float32)
            for _ in range(60):
                v = v - root * (v @ root) / (root @ root)
                v = 0.5 * (v + (sub @ (v / root)) / root)
                v /= max(np.linalg.norm(v), 1e-12)
            side = np.zeros(len(rows), bool)
            side[np.argsort(v / root, kind="stable")[len(rows) // 2 :]] = True
            for _ in range(20):
                to_true = sub @ side.astype(np.float32)
                gain = np.where(side, degree - 2 * to_true, 2 * to_true - degree)
                a = np.flatnonzero(side)[np.argsort(-gain[side], kind="stable")]
                b = np.flatnonzero(~side)[np.argsort(-gain[~side], kind="stable")]
                m = min(len(a), len(b), max(1, len(rows) // 20))
                good = gain[a[:m]] + gain[b[:m]] > 2 * sub[a[:m], b[:m]]
                m = int(np.argmin(good)) if not good.all() else m
                if not m:
                    break
                before = sub[np.ix_(side, ~side)].sum()
                side[a[:m]], side[b[:m]] = False, True
                if sub[np.ix_(side, ~side)].sum() >= before:
                    side[a[:m]], side[b[:m]] = True, False
                    break
            label[rows[side]] += level
        level *= 2
    return label


@dataclass
class Router:
    """Two-layer network from unit vectors to log-probabilities of parts; ``probes`` parts are asked."""

    layers: list[np.ndarray]
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def fit(sample: np.ndarray, rows: int, seed: int = 7) -> Router:
    """Learn parts for a table of ``rows`` vectors from a sample of it."""
    x = unit(sample.astype(np.float64)).astype(np.float32)
    parts = 1
    while parts * PART_ROWS < rows and parts < PARTS_MOST and parts * 32 < len(x):
        parts *= 2
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    layers = [
        rng.standard_normal((d, HIDDEN)).astype(np.float32) * np.float32(np.sqrt(2 / d) * 4),
        np.zeros(HIDDEN, np.float32),
        rng.standard_normal((HIDDEN, parts)).astype(np.float32) * np.float32(np.sqrt(1 / HIDDEN)),
        np.zeros(parts, np.float32),
    ]
    if parts == 1:
        return Router(layers, 1)
    near = neighbours(x, GRAPH_NEIGHBOURS)
    label = balanced_parts(near, parts, seed)
    # a row's target: its own part and those of its neighbours
    target = np.zeros((len(x), parts), np.float32)
    target[np.arange(len(x)), label] += near.shape[1]
    for c in range(near.shape[1]):
        target[np.arange(len(x)), label[near[:, c]]] += 1
    target /= target.sum(axis=1, keepdims=True)
    mean = [np.zeros_like(w) for w in layers]
    square = [np.zeros_like(w) for w in layers]
    for step in range(1, 401):
        w1, b1, w2, b2 = layers
        rows_now = rng.integers(0, len(x), min(1024, len(x)))
        xb = x[rows_now]
        hidden = np.maximum(xb @ w1 + b1, 0)
        raw = hidden @ w2 + b2
        p = np.exp(raw - raw.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target[rows_now]) / len(xb)
        back = (g @ w2.T) * (hidden > 0)
        for i, grad in enumerate([xb.T @ back, back.sum(axis=0), hidden.T @ g, g.sum(axis=0)]):
            mean[i] = 0.9 * mean[i] + 0.1 * grad
            square[i] = 0.999 * square[i] + 0.001 * grad**2
            layers[i] = layers[i] - 0.01 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    router = Router([w.astype(np.float32) for w in layers], parts)
    order = router.parts(x, parts)
    filed = order[:, 0]
    wanted = filed[neighbours(x, NEAREST)]
    place = np.argmax(order[:, None, :] == wanted[:, :, None], axis=2)
    for probes in range(1, parts + 1):
        if (place < probes).mean() >= COVER:
            break
    router.probes = probes
    return router


def clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v double array) of rows that take part: no null id, vector or component, finite, not zero, of the usual length."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(
        "id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
        " AND exists(v, x -> x <> 0)"
    )
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def collapse(rows: DataFrame, kept: int) -> DataFrame:
    """Equal vectors as one row: v, vid (smallest id), ids (the ``kept`` smallest, sorted), n rows, asked (has a query).

    Batches combine their equal vectors first, so a vector on a third of the rows
    arrives as a few partial rows.
    """

    def combine(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found: dict[bytes, list] = {}
            for i, v in zip(part["id"], part["v"]):
                held = found.setdefault(v.tobytes(), [v, []])
                held[1].append(i)
            made = [(v, sorted(set(ids))[:kept], len(ids), any(i % QUERY_EVERY == 0 for i in ids)) for v, ids in found.values()]
            yield pd.DataFrame(made, columns=["v", "ids", "n", "asked"])

    part = rows.mapInPandas(combine, "v array<double>, ids array<long>, n long, asked boolean")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, kept)
    whole = part.groupBy("v").agg(ids.alias("ids"), F.sum("n").alias("n"), F.bool_or("asked").alias("asked"))
    return whole.withColumn("vid", F.col("ids")[0])


def stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def build_index(vectors: DataFrame, key: str, vector: str, kept: int) -> tuple[DataFrame, Router | None]:
    """Every vector filed under its part: (vid, v, ids, n, asked, part), stored; and the router."""
    distinct = written(collapse(clean(vectors, key, vector), kept), "ann-vectors")
    rows = distinct.count()
    if not rows:
        return distinct.withColumn("part", F.lit(0)), None
    order = F.xxhash64(F.lit("neighbour sample"), "vid")
    sample = distinct.select(order.alias("o"), "vid", "v").orderBy("o", "vid").limit(SAMPLE).collect()
    router = fit(np.array([r["v"] for r in sample]), rows)

    @F.pandas_udf("int")
    def part_of(v: pd.Series) -> pd.Series:
        return pd.Series(router.parts(unit(stack(v)).astype(np.float32), 1)[:, 0])

    return written(distinct.withColumn("part", part_of("v")), "ann-index"), router


def best(query: np.ndarray, base: np.ndarray, ids: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query row the n nearest rows of ``base``: places, cosines, and the cosines that rank them.

    Cosines that agree to TIE_DIGITS decimals are ties and go to the smaller id:
    the last digits depend on the length of a vector, not on its direction. Every
    row that could be among the n is ranked by its own cosine, however many tie.
    """
    n = min(n, len(base))
    rough = unit(query) @ unit(base).T
    least = -np.partition(-rough, n - 1, axis=1)[:, n - 1]
    lengths = np.sqrt((base * base).sum(axis=1))
    out = []
    for q, row, edge in zip(query, rough, least):
        near = np.flatnonzero(row >= edge - 2 * 10.0**-TIE_DIGITS)
        score = (q * base[near]).sum(axis=1) / (np.sqrt((q * q).sum()) * lengths[near])
        tie = np.round(score, TIE_DIGITS)
        first = np.lexsort((ids[near], -tie))[:n]
        out.append((near[first], score[first], tie[first]))
    return out


def search(index: DataFrame, router: Router, nearest: int = NEAREST) -> DataFrame:
    """For each vector that is asked for: vid and ``found``, its nearest (score, id), nearest first, itself included."""
    probes = router.probes
    sizes = {r["part"]: (r["n"], r["q"]) for r in index.groupBy("part").agg(F.count("*").alias("n"), F.count_if("asked").alias("q")).collect()}

    @F.pandas_udf("array<int>")
    def routes(v: pd.Series) -> pd.Series:
        return pd.Series(list(router.parts(unit(stack(v)).astype(np.float32), probes).astype(np.int32)))

    # at most PARTS_MOST parts: how many blocks each is cut into
    blocks = F.create_map(*[F.lit(x) for p, (n, _) in sizes.items() for x in (p, -(-n // BLOCK_ROWS))])
    base = index.withColumn("block", F.pmod(F.xxhash64("vid"), blocks[F.col("part")]).cast("int"))
    asked = max(1, -(-sum(q for _, q in sizes.values()) * probes // (len(sizes) * BLOCK_ROWS)))
    queries = (
        index.where("asked")
        .select("vid", "v", F.explode(routes("v")).alias("part"))
        .withColumn("lot", F.pmod(F.xxhash64(F.lit(1), "vid"), F.lit(asked)).cast("int"))
        .withColumn("n_blocks", F.coalesce(blocks[F.col("part")], F.lit(0)))
        .where("n_blocks > 0")
        .withColumn("block", F.expr("explode(sequence(0, n_blocks - 1))"))
    )
    lots = base.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            base_v, ids = stack(right["v"]), right["ids"].to_numpy()
            firsts = np.array([i[0] for i in ids], np.int64)
            for start in range(0, len(left), 512):
                some = left.iloc[start : start + 512]
                found = best(stack(some["v"]), base_v, firsts, nearest + 1)
                for vid, (places, scores, ties) in zip(some["vid"], found):
                    out += [(vid, firsts[j], t, s, ids[j]) for j, s, t in zip(places, scores, ties)]
        return pd.DataFrame(out, columns=["vid", "first", "tie", "score", "ids"])

    by = ["part", "block", "lot"]
    met = queries.select("vid", "v", *by).groupBy(*by).cogroup(lots.select("v", "ids", *by).groupBy(*by))
    found = met.applyInPandas(meet, "vid long, first long, tie double, score double, ids array<long>")
    rank = F.row_number().over(W.partitionBy("vid").orderBy(F.desc("tie"), "first"))
    top = found.withColumn("r", rank).where(F.col("r") <= nearest + 1)
    single = F.transform("ids", lambda i: F.struct((-F.col("tie")).alias("order"), i.alias("id"), (-F.col("score")).alias("neg")))
    return top.groupBy("vid").agg(F.array_sort(F.flatten(F.collect_list(single))).alias("found"))


def nearest_neighbours(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row whose id is divisible by QUERY_EVERY.

    Candidates are all rows but those with the query's own id; equal scores go to
    the smaller id (cosines that agree to TIE_DIGITS decimals are equal), rows that repeat an id count once. Rows without an id, and
    vectors that are null, zero, of another length than most, or hold nulls or
    values that are not finite take no part. Fewer candidates give fewer rows.
    """
    index, router = build_index(vectors, key, vector, nearest + 1)
    spark = vectors.sparkSession
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    facts = written(search(index, router, nearest).join(index.select("vid", "n", F.col("v").alias("fv")), "vid").drop("fv"), "ann-found")
    queries = clean(vectors, key, vector).where(F.col("id") % QUERY_EVERY == 0)
    # equal vectors share one search: a query row finds it by the smallest id of its vector
    named = queries.join(index.where("asked").select("v", "vid", F.col("n").alias("same")), "v").select("id", "vid").distinct()
    rows = attach(named, facts, "vid", "n", ["id"])
    own = F.expr(f"slice(filter(found, f -> f.id <> id), 1, {nearest})")
    return rows.select(F.col("id").alias("query_id"), F.posexplode(own).alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.neg")).alias("score")
    )


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every 50th embedding; nulls, ties, repeats, lengths and empty tables as ``nearest_neighbours`` says."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
