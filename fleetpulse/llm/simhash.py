"""SimHash near-deduplication with pivot distance tables.

A text's fingerprint is the bitwise majority of the hashes of its word shingles.
Fingerprints link within a Hamming radius r, and linked texts form components.

Search. Equal fingerprints are one node. Pairs are brought together by blocks: if
64 bits are cut into r + k blocks, two fingerprints within r agree in k of them, so
a table for each choice of k blocks loses no pair; k is the smallest number for
which random fingerprints would fill groups with GROUP_ROWS rows at most. Within a
group the distances of every fingerprint to the reference fingerprints are tabled
first; a pair whose coordinates differ by more than r anywhere is discarded (by
the triangle inequality its distance is larger than r), and what survives is verified by its real distance.
Groups emit a spanning forest of their links, not all pairs. Groups that near
copies have made large are cut into tiles, so that every pair meets in a tile.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.llm.common import attach, components, null_last, released, small, table
from fleetpulse.session import free_finished, written

WORDS = 4
RADIUS = 4
SEED = 42
GROUP_ROWS = 64
#: Larger groups are cut into tiles of two chunks of this many rows.
CHUNK_ROWS = 2048
#: Reference fingerprints of the pivot table: fixed, from a 64-bit mixing sequence.
PIVOTS = 16
#: Radius of the first, forest-shaped round of the verified search.
FOREST_RADIUS = 6
#: At a wide radius groups may be larger, as every choice of blocks costs a copy of the rows.
WIDE_GROUP_ROWS = 1024
#: Pairs of each two groups that the first wide search gives, and the factor by which later ones give more.
WIDE_PAIRS = 8
WIDE_FACTOR = 8
PIECE = 1 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Odd multiples of the golden ratio in 64 bits: about half of their bits differ pairwise."""
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        return x * np.uint64(0xBF58476D1CE4E5B9)


def pieces(text: str) -> Iterator[list[bytes]]:
    """Words of the whole text, letters A-Z in lower case; long texts in several lists."""
    data = text.encode("utf-8").translate(LOWER)
    if len(data) <= PIECE:
        yield data.split()
        return
    start = 0
    while start < len(data):
        end = start + PIECE
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[start:end].split()
        start = end


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included; a text of fewer words is one shingle, one without words none."""
    from xxhash import xxh64_intdigest

    carried: list[bytes] = []
    made = False
    for part in pieces(text or ""):
        own = carried + part
        if len(own) >= words:
            joined = b" ".join(own)
            ends = list(itertools.accumulate([len(w) + 1 for w in own]))
            starts = [0, *ends[:-1]]
            spans = zip(starts, ends[words - 1 :])
            made = True
            yield np.fromiter((xxh64_intdigest(joined[a : b - 1], SEED) for a, b in spans), np.uint64, len(own) - words + 1)
            carried = own[len(own) - words + 1 :] if words > 1 else []
        else:
            carried = own
    if not made and carried:
        yield np.array([xxh64_intdigest(b" ".join(carried), SEED)], np.uint64)


def majorities(texts: list[str | None], words: int) -> np.ndarray:
    """Fingerprints of texts: a bit is 1 if more than half of the shingle hashes have it."""
    total = np.zeros((len(texts), 64), np.int64)
    count = np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owner: list[int] = []

    def flush() -> None:
        if held:
            h = np.concatenate(held)
            starts = np.cumsum([0, *map(len, held[:-1])])
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(total, owner, np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
            held.clear()
            owner.clear()

    waiting = 0
    for i, text in enumerate(texts):
        for h in shingle_hashes(text, words):
            count[i] += len(h)
            held.append(h)
            owner.append(i)
            waiting += len(h)
            if waiting > 1 << 17:
                flush()
                waiting = 0
    flush()
    ones = (2 * total > count[:, None]).astype(np.uint8)
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``th`` (a hash of the text) and ``fp`` (the 64 bits as a long) of every row.

    A null, empty or blank text has fingerprint 0.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fp = majorities(list(part["text"]), words).view(np.int64)
            yield pd.DataFrame({"key": part["key"].array, "th": part["th"], "fp": fp})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), text_tag(text).alias("th"), F.col(text).alias("text"))
    return rows.mapInPandas(released(run), f"key {kind}, th long, fp long").withColumnRenamed("key", key)


def text_tag(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def block_masks(rows: int, radius: int, group_rows: int = GROUP_ROWS, most: int = 6) -> list[int]:
    """Masks over 64 bits, one for each choice of k of (radius + k) blocks."""
    k = 1
    while rows / 2 ** (64 * k / (radius + k)) > group_rows and k < most:
        k += 1
    edges = [round(64 * i / (radius + k)) for i in range(radius + k + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in itertools.combinations(blocks, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near(a: np.ndarray, pa: np.ndarray, b: np.ndarray, pb: np.ndarray, radius: int) -> np.ndarray:
    """Indexes of aligned pairs within the radius: by the pivot table first, then by distance."""
    left = np.arange(len(a))
    for c in range(pa.shape[1]):
        left = left[np.abs(pa[left, c] - pb[left, c]) <= radius]
    return left[np.bitwise_count(a[left] ^ b[left]) <= radius]


def grouped(fps: DataFrame, masks: list[int], extra: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Rows (fp, extra) once for each block table, tagged with their group; large groups in tiles."""
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])
    dealt = fps.select("fp", *extra, F.explode(keys).alias("g")).select("fp", *extra, "g.t", "g.k")
    large = written(dealt.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > 2 * CHUNK_ROWS), "simhash-large")
    sized = small(large, large.count() * 64)
    chunks = F.ceil(F.col("n") / CHUNK_ROWS).cast("int")
    tiles = F.expr(
        "CASE WHEN n IS NULL THEN array(struct(0 AS i, 0 AS j)) ELSE transform(sequence(0, chunks - 1), "
        "x -> struct(least(x, c) AS i, greatest(x, c) AS j)) END"
    )
    tiled = (
        dealt.join(sized, ["t", "k"], "left")
        .withColumn("chunks", chunks)
        .withColumn("c", F.pmod(F.xxhash64("fp", *extra), F.col("chunks")).cast("int"))
        .withColumn("g", F.explode(tiles))
        .select("fp", *extra, "t", "k", "g.i", "g.j")
    )
    by = ["t", "k", "i", "j"]
    return tiled.repartition(*by).sortWithinPartitions(*by, "fp"), by


def runs(parts: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted batches as frames of whole groups, with the start of each group."""
    held: list[pd.DataFrame] = []

    def cut(frame: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(frame), bool)
        change[:1] = True
        for c in by:
            v = frame[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for part in parts:
        held.append(part)
        frame = pd.concat(held, ignore_index=True) if len(held) > 1 else part.reset_index(drop=True)
        starts = cut(frame)
        if len(starts) > 1:
            yield frame.iloc[: starts[-1]], starts[:-1]
            held = [frame.iloc[starts[-1] :].reset_index(drop=True)]
        else:
            held = [frame]
    if held and sum(map(len, held)):
        frame = pd.concat(held, ignore_index=True)
        yield frame, cut(frame)


def forest(x: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links of one group, as index pairs; a node is expanded once, against nodes not yet reached."""
    out, open_ = [], np.arange(len(x))
    while len(open_) > 1:
        queue, open_ = [int(open_[0])], open_[1:]
        while queue and len(open_):
            i = queue.pop()
            n = len(open_)
            hit = near(np.broadcast_to(x[i], n), np.broadcast_to(table[i], (n, table.shape[1])), x[open_], table[open_], radius)
            found = open_[hit]
            out += [(i, int(j)) for j in found]
            queue += found.tolist()
            open_ = np.delete(open_, hit)
    return out


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (src, dst) that connect distinct fingerprints ``fp`` exactly as all pairs within ``radius`` would."""
    rows, by = grouped(fps, block_masks(fps.count(), radius))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs = pivots()
        for frame, starts in runs(parts, by):
            x = frame["fp"].to_numpy().view(np.uint64)
            tabled = np.bitwise_count(x[:, None] ^ refs[None, :]).astype(np.int8)
            sizes = np.diff(np.append(starts, len(x)))
            group = np.repeat(np.arange(len(starts)), sizes)
            little = np.repeat(sizes <= GROUP_ROWS, sizes)
            src, dst = [], []
            # small groups all at once: every row against the row s places on
            for s in range(1, int(min(GROUP_ROWS, sizes.max()))):
                i = np.flatnonzero(little[:-s] & (group[:-s] == group[s:]))
                hit = i[near(x[i], tabled[i], x[i + s], tabled[i + s], radius)]
                src.append(x[hit])
                dst.append(x[hit + s])
            for g in np.flatnonzero(sizes > GROUP_ROWS):
                a = starts[g]
                pairs = forest(x[a : a + sizes[g]], tabled[a : a + sizes[g]], radius)
                if pairs:
                    at = np.array(pairs) + a
                    src.append(x[at[:, 0]])
                    dst.append(x[at[:, 1]])
            if src and sum(map(len, src)):
                made = pd.DataFrame({"src": np.concatenate(src).view(np.int64), "dst": np.concatenate(dst).view(np.int64)})
                yield made.drop_duplicates()

    return rows.mapInPandas(released(run), "src long, dst long")


def label_nodes(marked: DataFrame, edges: DataFrame, key: str, node: str = "fp") -> DataFrame:
    """Facts (node, n, head) from rows (key, th, fp) and edges between nodes; head: value and th of the first row."""
    nodes = marked.groupBy(node).agg(F.count("*").alias("n"), F.min(F.struct(*null_last(key), "th")).alias("least"))
    joined = written(components(edges, "simhash-stars"), "simhash-labels").withColumnRenamed("node", node)
    labelled = written(nodes.join(joined, node, "left").withColumn("label", F.coalesce("label", node)), "simhash-nodes")
    heads = labelled.groupBy("label").agg(F.count("*").alias("nodes"), F.min("least").alias("head"))
    heads = written(heads, "simhash-heads")
    return written(
        attach(labelled, heads, "label", "nodes", [node]).select(node, "n", "head"), "simhash-facts"
    )


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id of every row.

    The component is named by the smallest key in it, null only if all its keys
    are null. Equal texts and repeated rows are in one component. Texts without
    words have fingerprint 0 and link like any other.
    """
    marked = written(fingerprints(docs, words, key, text), "simhash-marked")
    fps = written(marked.select("fp").distinct(), "simhash-distinct")
    edges = written(links(fps, radius), "simhash-edges")
    facts = label_nodes(marked, edges, key)
    return attach(marked, facts, "fp", "n", [key]).select(
        key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("head.value").alias("component_id")
    )


def wide_pairs(labelled: DataFrame, radius: int, most: int) -> DataFrame:
    """Pairs (la, lb, d, a, b) of texts (fp, th, label) within a wide radius that have different labels: the ``most`` closest of each two labels.

    Random fingerprints are 32 bits apart on average, so at a wide radius the
    distances to references hardly discard anything; whole blocks of a group are
    compared at once, by the first reference and then by distance.
    """
    rows, by = grouped(labelled, block_masks(labelled.count(), radius, WIDE_GROUP_ROWS, 2), ("label", "th"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref = pivots(1)[0]
        for frame, starts in runs(parts, by):
            x, label, th = frame["fp"].to_numpy().view(np.uint64), frame["label"].to_numpy(), frame["th"].to_numpy()
            tabled = np.bitwise_count(x ^ ref).astype(np.int8)
            found = []
            for a, b in zip(starts, np.append(starts[1:], len(x))):
                for at in range(a, b, 256):
                    rest, own = slice(at, b), slice(at, min(at + 256, b))
                    close = np.abs(tabled[own, None] - tabled[None, rest]) <= radius
                    close &= np.bitwise_count(x[own, None] ^ x[None, rest]) <= radius
                    close &= label[own, None] != label[None, rest]
                    i, j = np.nonzero(close)
                    if len(i):
                        found.append(np.stack([i + at, j + at]))
            if found:
                i, j = np.concatenate(found, axis=1)
                flip = label[i] > label[j]
                i, j = np.where(flip, j, i), np.where(flip, i, j)
                made = pd.DataFrame({"la": label[i], "lb": label[j], "d": np.bitwise_count(x[i] ^ x[j]).astype(np.int32)})
                made["a"], made["b"] = np.minimum(th[i], th[j]), np.maximum(th[i], th[j])
                yield made.sort_values(["la", "lb", "d", "a", "b"]).drop_duplicates().groupby(["la", "lb"]).head(most)

    pairs = rows.mapInPandas(released(run), "la long, lb long, d int, a long, b long").distinct()
    nth = F.row_number().over(W.partitionBy("la", "lb").orderBy("d", "a", "b"))
    return pairs.withColumn("nth", nth).where(F.col("nth") <= most)


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(th, shingles): the different shingle hashes of the text of each wanted (key, th)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sets = [np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(t, words)])).view(np.int64) for t in part["text"]]
            yield pd.DataFrame({"th": part["th"], "shingles": sets})

    rows = docs.select(F.col(key).alias("key"), text_tag(text).alias("th"), F.col(text).alias("text"))
    sized = small(wanted.withColumnRenamed(key, "key"), wanted.count() * 64)
    chosen = rows.alias("x").join(sized.alias("y"), F.expr("x.key <=> y.key AND x.th = y.th")).select("x.th", "x.text")
    return chosen.mapInPandas(released(run), "th long, shingles array<long>").dropDuplicates(["th"])


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float, key: str, text: str) -> DataFrame:
    """Those of the pairs (src, dst) of texts that have the Jaccard similarity, by their shingle sets. Stored.

    ``nodes`` (th, least) names the row that stands for a text.
    """
    ends = pairs.select(F.col("src").alias("th")).unionByName(pairs.select(F.col("dst").alias("th"))).distinct()
    wanted = written(nodes.join(ends, "th").select(F.col("least.value").alias(key), "th"), "near-wanted")
    sets = written(shingle_sets(docs, wanted, words, key, text), "near-shingles")
    degree = written(pairs.groupBy("src").agg(F.count("*").alias("n")), "near-degrees")
    left = sets.select(F.col("th").alias("src"), F.col("shingles").alias("sa")).join(degree, "src")
    right = sets.select(F.col("th").alias("dst"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    compared = attach(pairs, written(left, "near-left"), "src", "n", ["dst"]).join(right, "dst")
    alike = compared.where(both >= similarity * (F.size("sa") + F.size("sb") - both))
    return written(alike.select("src", "dst"), "near-verified")


def first_links(nodes: DataFrame) -> DataFrame:
    """Pairs (src, dst) of texts (fp, th), src < dst, stored: a star for each fingerprint, and a forest of close fingerprints."""
    prints = written(nodes.groupBy("fp").agg(F.min("th").alias("one"), F.count("*").alias("n")), "near-prints")
    stars = attach(nodes.select("fp", "th"), prints, "fp", "n", ["th"]).where("th <> one").select(F.col("one").alias("src"), F.col("th").alias("dst"))
    close = written(links(prints.select("fp"), FOREST_RADIUS), "near-forest")
    a, b = (prints.select(F.col("fp").alias(name), F.col("one").alias(f"{name}_one")) for name in ("src", "dst"))
    ends = F.least("src_one", "dst_one").alias("src"), F.greatest("src_one", "dst_one").alias("dst")
    return written(stars.unionByName(close.join(a, "src").join(b, "dst").select(*ends)), "near-first")


def labelled_texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with the label of their component, stored."""
    labels = components(edges, "near-stars").withColumnRenamed("node", "th")
    return written(nodes.join(labels, "th", "left").select("fp", "th", F.coalesce("label", "th").alias("label")), "near-labels")


def near_links(nodes: DataFrame, docs: DataFrame, words: int, similarity: float, key: str, text: str) -> DataFrame:
    """Verified links (src, dst) that connect the texts (fp, th, least) as all similar pairs within the radius would.

    The wide search is repeated, with more pairs for each two groups, among the groups that are still apart and
    had more pairs than the last search gave. Pairs that were tried are not verified again.
    """
    tried = first_links(nodes)
    edges = verified(tried, nodes, docs, words, similarity, key, text)
    active, most = labelled_texts(nodes, edges), WIDE_PAIRS
    while True:
        free_finished(docs.sparkSession)
        found = written(wide_pairs(active, int(64 * (1 - similarity)), most), "near-pairs")
        pairs = found.select(F.col("a").alias("src"), F.col("b").alias("dst")).join(tried, ["src", "dst"], "left_anti")
        pairs = written(pairs, "near-untried")
        edges = edges.unionByName(verified(pairs, nodes, docs, words, similarity, key, text))
        # two labels with all their pairs listed are settled
        unsettled = found.where(F.col("nth") == most)
        unsettled = unsettled.select(F.col("la").alias("label")).unionByName(unsettled.select(F.col("lb").alias("label"))).distinct()
        unsettled = written(unsettled, "near-unsettled")
        if unsettled.isEmpty():
            free_finished(docs.sparkSession)
            return edges
        tried = written(tried.unionByName(pairs), "near-tried")
        labels = labelled_texts(nodes, edges)
        active = written(active.join(unsettled, "label", "left_semi").select("th").join(labels, "th").select("fp", "th", "label"), "near-active")
        most *= WIDE_FACTOR


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near copies, all columns kept: of each group the row with the smallest key stays (null keys last).

    Two texts are near copies if their fingerprints agree in ``similarity`` of their
    bits and their shingle sets have that Jaccard similarity. Texts with equal
    fingerprints are linked by stars and close fingerprints by a spanning forest
    first; then the pairs of every two groups that are still apart are looked at,
    the closest first, up to the full radius, until none is left. All links are verified.
    Rows equal in key and text are one document and stay or go together.
    """
    marked = written(fingerprints(docs, words, key, text), "near-marked")
    nodes = written(marked.groupBy("fp", "th").agg(F.min(F.struct(*null_last(key), "th")).alias("least")), "near-nodes")
    edges = near_links(nodes, docs, words, similarity, key, text)
    facts = label_nodes(marked, edges, key, "th")
    leaving = attach(marked, facts, "th", "n", [key]).where(f"NOT (`{key}` <=> head.value AND th = head.th)")
    leaving = leaving.select(F.col(key).alias("_key"), F.col("th").alias("_th")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(key).alias("_id"), text_tag(text).alias("_tag"))
    kept = rows.join(leaving, F.expr("_id <=> _key AND _tag = _th"), "left_anti")
    return kept.select("whole.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
