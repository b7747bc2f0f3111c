"""Embedding whitening with exact second moments.

Entries become whole numbers. Less the smallest of its dimension, each is a few
bits; the bits of one value across many rows are packed into words, a bit plane.
The number of rows in which two planes both have a bit is the popcount of their
AND, and cross-products are sums of these counts weighted by powers of two. Being
whole numbers they add up exactly in any order, are centred as whole numbers, and
only the covariance is rounded, before its eigenvectors are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm.common import table
from fleetpulse.session import written

SCALE = 64.0
SHIFT = 1_000_000
#: Whole numbers are cut off here before the shift, so that they fit a long.
FARTHEST = float(1 << 62)
COMPONENTS = 32
#: Rows packed at a time.
PACK_ROWS = 8192
#: Partial sums travel in limbs of so many bits; more than 8 million of them can be added in a long.
LIMB_BITS = 40
LONGEST = (1 << 63) - 1


def clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v double array) of rows whose vector and entries are neither null, infinite nor NaN."""
    rows = vectors.select(F.col(key).alias(key), F.col(vector).cast("array<double>").alias("v"))
    return rows.where("v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")


def whole(v: np.ndarray) -> np.ndarray:
    """floor(64 * entry) + 1000000 as longs."""
    return np.clip(np.floor(v * SCALE), -FARTHEST, FARTHEST).astype(np.int64) + SHIFT


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("v")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def ranges(rows: DataFrame) -> tuple[int, list[int], list[int]]:
    """Usual length of the vectors (ties: the shorter), and smallest and largest whole number of each of its dimensions."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy()
            flat = whole(batch.column("v").flatten().to_numpy(zero_copy_only=False))
            at = np.cumsum(lengths) - lengths
            for d in np.unique(lengths).tolist():
                places = at[lengths == d][:, None] + np.arange(d)
                x = flat[places]
                low, high = x.min(axis=0), x.max(axis=0)
                if d in found:
                    n, l, h = found[d]
                    found[d] = [n + len(x), np.minimum(l, low), np.maximum(h, high)]
                else:
                    found[d] = [len(x), low, high]
        yield pa.RecordBatch.from_pydict(
            {
                "d": pa.array(list(found), pa.int32()),
                "n": pa.array([f[0] for f in found.values()], pa.int64()),
                "low": pa.array([f[1].tolist() for f in found.values()], pa.list_(pa.int64())),
                "high": pa.array([f[2].tolist() for f in found.values()], pa.list_(pa.int64())),
            }
        )

    partial = rows.select("v").mapInArrow(part, "d int, n long, low array<long>, high array<long>")
    partial = written(partial, "whitening-ranges")
    usual = partial.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").first()
    if usual is None:
        return 0, [], []
    cells = partial.where(F.col("d") == usual["d"]).select(F.posexplode(F.arrays_zip("low", "high")).alias("i", "c"))
    found = cells.groupBy("i").agg(F.min("c.low").alias("low"), F.max("c.high").alias("high")).orderBy("i").collect()
    return usual["d"], [r["low"] for r in found], [r["high"] for r in found]


def planes(x: np.ndarray, low: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bit planes of ``x - low``, one row of 64-bit words a plane: for each bit the dimensions that have it, then one full plane."""
    n, d = x.shape
    shifted = (x - low).T.astype(np.uint64)
    words = -(-n // 64)
    out = np.zeros((int(bits.sum()) + 1, words * 8), np.uint8)
    at = 0
    for b in range(int(bits.max(initial=0))):
        has = np.flatnonzero(bits > b)
        flags = ((shifted[has] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(flags, axis=1, bitorder="little")
        out[at : at + len(has), : packed.shape[1]] = packed
        at += len(has)
    full = np.packbits(np.ones(n, np.uint8), bitorder="little")
    out[at, : len(full)] = full
    return out.view(np.uint64)


def counts(packed: np.ndarray) -> np.ndarray:
    """Rows in which planes p and q both have a bit, for p <= q."""
    out = np.zeros((len(packed), len(packed)), np.int64)
    for p in range(len(packed)):
        out[p, p:] = np.bitwise_count(packed[p] & packed[p:]).sum(axis=1, dtype=np.int64)
    return out


def weighted(total: np.ndarray, bits: np.ndarray) -> list[list[int]]:
    """Cross-products of all dimensions and of a last one that is always 1, from plane counts, as exact whole numbers."""
    both = total + np.triu(total, 1).T
    d, most = len(bits), int(bits.max(initial=0))
    # the planes of each bit and the dimensions they belong to; the full plane counts as bit 0 of dimension d
    groups, at = [], 0
    for b in range(most):
        has = np.flatnonzero(bits > b)
        groups.append((1 << b, np.arange(at, at + len(has)), has))
        at += len(has)
    groups.append((1, np.array([at]), np.array([d])))
    out = np.zeros((d + 1, d + 1), object)
    for scale, rows, i in groups:
        for other, columns, j in groups:
            out[np.ix_(i, j)] += both[np.ix_(rows, columns)].astype(object) * (scale * other)
    return [[int(c) for c in r] for r in out]


@dataclass
class Whitening:
    """Fitted on ``n`` vectors of ``size`` entries: exact sums, and eigenvalues and -vectors by falling eigenvalue."""

    n: int
    size: int
    low: np.ndarray
    high: np.ndarray
    sums: list[int]  # of entries less the smallest of their dimension
    values: np.ndarray
    vectors: np.ndarray  # a column each
    trace: float
    usable: np.ndarray  # components whose eigenvalue is not zero to double precision

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist() if self.trace > 0 else [0.0] * len(self.values)

    def components(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of whole numbers ``x``; NaN in components that are not usable."""
        centred = (x - self.low).astype(np.float64) - np.array([s / self.n for s in self.sums])
        scale = np.sqrt(np.where(self.usable, self.values, 1.0))
        return np.where(self.usable, (centred @ self.vectors) / scale, np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)**2, exact; None where a long can't hold it."""
        widest = self.n * int((self.high - self.low).max(initial=0))
        if widest * widest * max(self.size, 1) <= LONGEST:
            gap = self.n * (x - self.low) - np.array(self.sums, np.int64)
            return (gap * gap).sum(axis=1).tolist()
        low, sums = [int(v) for v in self.low], self.sums
        made = (sum((self.n * (int(v) - a) - s) ** 2 for v, a, s in zip(row, low, sums)) for row in x)
        return [m if m <= LONGEST else None for m in made]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learn from all rows of ``clean`` that have the usual length; None without rows.

    The driver gets one number for each pair of dimensions, whatever the number of rows.
    """
    size, low, high = ranges(rows)
    if not size:
        return None
    lows, highs = np.array(low, np.int64), np.array(high, np.int64)
    bits = np.array([(b - a).bit_length() for a, b in zip(low, high)])
    limbs = -(-(2 * int(bits.max(initial=0)) + LIMB_BITS) // LIMB_BITS)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((int(bits.sum()) + 1,) * 2, np.int64)
        for batch in batches:
            x = whole(matrix(batch))
            for at in range(0, len(x), PACK_ROWS):
                total += counts(planes(x[at : at + PACK_ROWS], lows, bits))
        if not total[-1, -1]:
            return
        products = weighted(total, bits)
        mask = (1 << LIMB_BITS) - 1
        made = [(i, k, [(v >> (LIMB_BITS * k)) & mask for v in row[i:]]) for i, row in enumerate(products) for k in range(limbs)]
        yield pa.RecordBatch.from_pydict(
            {
                "i": pa.array([m[0] for m in made], pa.int32()),
                "k": pa.array([m[1] for m in made], pa.int32()),
                "parts": pa.array([m[2] for m in made], pa.list_(pa.int64())),
            }
        )

    used = rows.where(F.size("v") == size).select("v")
    partial = used.mapInArrow(scatter, "i int, k int, parts array<long>")
    cells = partial.select("i", "k", F.posexplode("parts").alias("j", "part")).groupBy("i", "k", "j").agg(F.sum("part").alias("part"))
    products = [[0] * (size + 1) for _ in range(size + 1)]
    for r in cells.collect():
        products[r["i"]][r["i"] + r["j"]] += r["part"] << (LIMB_BITS * r["k"])
    n = products[size][size]
    sums = [products[i][size] for i in range(size)]
    cov = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            cov[i, j] = cov[j, i] = (n * products[i][j] - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    usable = values > max(float(values[0]), 0.0) * size * 1e-15
    return Whitening(n, size, lows, highs, sums, np.maximum(values, 0.0), vectors, float(np.trace(cov)), usable)


def transform(rows: DataFrame, model: Whitening, key: str) -> DataFrame:
    """key, deviation, whitened (array) of every row of ``clean`` that has the usual length."""
    used = rows.where(F.size("v") == model.size)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(matrix(batch))
            if not len(x):
                continue
            z = model.components(x)
            flat = pa.array(z.ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(model.deviation(x), pa.int64()), lists], [key, "deviation", "whitened"]
            )

    kind = rows.schema[key].dataType.simpleString()
    return used.mapInArrow(apply, f"`{key}` {kind}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened rows less the identity; None without usable components."""
    used = rows.where(F.size("v") == model.size).select("v")
    k = int(model.usable.sum())

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row and column hold sums
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            x = whole(matrix(batch))
            if len(x):
                z = np.hstack([model.components(x)[:, model.usable], np.ones((len(x), 1))])
                total += z.T @ z
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(np.arange(k + 1), pa.int32()), "parts": pa.array(total.tolist(), pa.list_(pa.float64()))}
        )

    cells = used.mapInArrow(part, "i int, parts array<double>").select("i", F.posexplode("parts").alias("j", "part"))
    total = np.zeros((k + 1, k + 1))
    for r in cells.groupBy("i", "j").agg(F.sum("part").alias("part")).collect():
        total[r["i"], r["j"]] = r["part"]
    if not k:
        return None
    mean = total[:k, k] / model.n
    return float(np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for every usable vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds a null, infinite or NaN entry take
    no part, nor do vectors of another length than most (ties: the shorter length
    stays). Components are as many as dimensions, ``components`` at most. A
    component whose eigenvalue is zero (constant or dependent dimensions, one row)
    has a null ``whitened``. ``deviation`` is null where a long can't hold it.
    Repeated rows and keys, and null keys, count and come back each; other columns
    are not read. An empty table gives an empty result.
    """
    rows = clean(vectors, key, vector)
    model = fit(rows, components)
    kind = rows.schema[key].dataType.simpleString()
    if model is None:
        schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model)
    made = transform(rows, model, key).select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(e) for e in model.explained])
    return made.select(
        key,
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all embeddings; nulls, lengths, constant dimensions and repeats as ``whiten`` says."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
