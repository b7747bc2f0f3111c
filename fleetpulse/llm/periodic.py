"""Periodic runs of words: stretches that repeat a shorter stretch several times over.

Suffixes of a text are put in order, with the length that neighbours in the
order have in common (LCP). Neighbours are united by decreasing LCP, as Kruskal's
method unites the ends of edges; each class keeps its positions in order. Two
positions of a class that become neighbours at a distance within their LCP start
a repetition, and every run shows up in this way at its first position. Texts
are handled in blocks, so that the ordering works on large arrays.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm.common import BLANKS, table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LEAST_LENGTH = 6
LEAST_EXPONENT = 4
#: Words of texts that are put in order together; a longer text is a block of its own.
BLOCK_WORDS = 1 << 17


def numbered(texts: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers, different for different words and for different texts, and where each text starts."""
    numbers: list[int] = []
    starts, first = [], 0
    for words in texts:
        starts.append(len(numbers))
        ids: dict[str, int] = {}
        numbers += [ids.setdefault(w, len(ids) + first) for w in words]
        first += len(ids)
    return np.array(numbers, np.int64), np.array([*starts, len(numbers)], np.int64)


def suffix_order(numbers: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in the order of their suffixes, by prefix doubling, and the classes of each round.

    Round k tells stretches of 2**k words apart: its array holds a class for every
    position and -1 for the end. Only classes of several positions are refined.
    """
    n = len(numbers)
    order = np.argsort(numbers, kind="stable")
    rounds, open_, width = [], np.arange(n), 0
    keys = numbers[order]
    current = np.full(n + 1, -1, np.int64)
    while len(open_):
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(open_)))
        current = current.copy()
        current[order[open_]] = np.repeat(open_[heads], sizes)
        rounds.append(current)
        width = 2 * width or 1
        open_ = open_[np.repeat(sizes > 1, sizes)]
        at = order[open_]
        keys = current[at] * (n + 1) + current[np.minimum(at + width, n)] + 1
        by = np.argsort(keys, kind="stable")
        order[open_], keys = at[by], keys[by]
    return order, rounds


def common_words(rounds: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` have in common at their start."""
    total = np.zeros(len(a), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        total += (rounds[k][a + total] == rounds[k][b + total]).astype(np.int64) << k
    return total


def united(order: np.ndarray, edges: np.ndarray, lcp: np.ndarray, times: int) -> list[tuple[int, int, int]]:
    """(position, distance, LCP) of positions that become neighbours in a class, ``times`` distances within the LCP.

    ``edges``: places in the order whose suffix is joined with the next, by falling ``lcp``.
    """
    parent: dict[int, int] = {}
    held: dict[int, list[int]] = {}
    found = []

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    left, right = order[edges].tolist(), order[edges + 1].tolist()
    for a, b, common in zip(left, right, lcp.tolist()):
        a, b = root(a), root(b)
        big, small = held.pop(a, None) or [a], held.pop(b, None) or [b]
        if len(big) < len(small):
            a, b, big, small = b, a, small, big
        parent[b] = a
        held[a] = big
        last, reach = -1, common // times
        for x in small:
            i = bisect_left(big, x)
            # positions that were in one class before have met already
            if i and big[i - 1] != last and x - big[i - 1] <= reach:
                found.append((big[i - 1], x - big[i - 1], common))
            if i < len(big) and big[i] - x <= reach:
                found.append((x, big[i] - x, common))
            big.insert(i, x)
            last = x
    return found


def runs_of(numbers: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period.

    A run of period q and length n has LCP n - q between its first position and
    the one q further on, and no position between them is in their class: it would
    give the run a smaller period. So each run is found at its start, and its end
    is known from the LCP. ``least_exponent`` is a whole number of at least 2.
    """
    none = np.zeros((0, 3), np.int64)
    if len(numbers) < least_length:
        return none
    times = least_exponent - 1
    order, rounds = suffix_order(numbers)
    least = -(-least_length * times // least_exponent)
    level = min(least.bit_length() - 1, len(rounds) - 1)
    edges = np.flatnonzero(rounds[level][order[1:]] == rounds[level][order[:-1]])
    lcp = common_words(rounds, order[edges], order[edges + 1])
    edges, lcp = edges[lcp >= least], lcp[lcp >= least]
    by = np.argsort(-lcp, kind="stable")
    seeds = united(order, edges[by], lcp[by], times)
    if not seeds:
        return none
    start, period, common = np.array(seeds, np.int64).T
    end = start + period + common
    good = end - start >= least_length
    start, period, end = start[good], period[good], end[good]
    # the first of the seeds that share end and period
    by = np.lexsort((start, period, end))
    start, period, end = start[by], period[by], end[by]
    first = np.concatenate([[True], (end[1:] != end[:-1]) | (period[1:] != period[:-1])])[: len(end)]
    start, period, end = start[first], period[first], end[first]
    # positions that were neighbours for a while only may miss the start of their stretch
    whole = (start == 0) | (numbers[start - 1] != numbers[start - 1 + period])
    start, period, end = start[whole], period[whole], end[whole]
    # of periods of one stretch the smallest; the others are its multiples
    by = np.lexsort((period, end, start))
    start, period, end = start[by], period[by], end[by]
    first = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[: len(end)]
    made = np.stack([start, end - start, period], axis=1)[first]
    return made[np.lexsort((made[:, 2], made[:, 0]))]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length over period, compared as whole numbers; ties go to the smaller start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def blocks(texts: Sequence[str | None]) -> Iterator[list[list[str]]]:
    """Words of texts, in blocks of about BLOCK_WORDS words."""
    held, size = [], 0
    for text in texts:
        words = WORDS.findall(text or "")
        if held and size + len(words) > BLOCK_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def collapsed(texts: list[list[str]], least_length: int, least_exponent: int) -> Iterator[tuple[list[tuple], str]]:
    """For each text its runs, and the text without the words of a run after its first period."""
    numbers, starts = numbered(texts)
    runs = runs_of(numbers, least_length, least_exponent)
    change = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(change) > 0
    bounds = np.searchsorted(runs[:, 0], starts)
    for i, words in enumerate(texts):
        mine = runs[bounds[i] : bounds[i + 1]]
        if len(mine):
            gone = dropped[starts[i] : starts[i + 1]].tolist()
            words = [w for w, g in zip(words, gone) if not g]
        at = int(starts[i])
        yield [(s - at, n, p) for s, n, p in mine.tolist()], " ".join(words)


def find_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_exponent: int = LEAST_EXPONENT,
) -> DataFrame:
    """One row per row of ``docs``: key, runs, strongest, collapsed.

    ``runs`` are (start, length, period) in words from 0, by start, then period; a
    run is at least ``least_length`` words and ``least_exponent`` periods long and
    cannot be extended. ``strongest`` has the greatest length over period (ties:
    smaller start, then period; null without a run). ``collapsed`` is the text's
    words, joined by a space, without those of a run after its first period.
    A null text counts as empty: no runs, collapsed to an empty text. A text of any
    length is one row and handled whole. Repeated rows are handled each; other columns are not
    read. An empty table gives an empty result.
    """

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            at = 0
            for block in blocks(part["text"].tolist()):
                made = list(collapsed(block, least_length, least_exponent))
                keys = part["key"].iloc[at : at + len(block)]
                at += len(block)
                yield pd.DataFrame(
                    {
                        "key": keys.to_numpy(),
                        "runs": [m[0] for m in made],
                        "strongest": [strongest(m[0]) for m in made],
                        "collapsed": [m[1] for m in made],
                    }
                )

    kind = docs.schema[key].dataType.simpleString()
    run = "struct<start: bigint, length: bigint, period: bigint>"
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = slim.mapInPandas(find, f"key {kind}, runs array<{run}>, strongest {run}, collapsed string")
    return found.withColumnRenamed("key", key)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with a periodic tail in documents whose crc32 of the id ends in 0.

    Let h be the crc32 of the decimal id, g = floor(h / 10), n the number of words. Each word i from a = g % n on becomes
    word a + (i - a) % p of the original text, p = 1 + floor((n - a) / (3 + g % 8)).
    A row without an id or without words stays as it is.
    """
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    spaces = F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, " " * len(BLANKS))
    words = F.filter(F.split(spaces, " +"), lambda w: w != "")
    base = docs.select(F.col(key).alias(key), F.col(text).alias(text), crc.alias("h"))
    chosen = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    some = base.withColumns({"w": F.when(chosen, words), "g": F.floor(F.col("h") / 10)}).withColumn("n", F.coalesce(F.size("w"), F.lit(0)))
    some = some.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    some = some.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    tail = F.transform(
        "w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))
    )
    return some.select(key, F.when(F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col(text)).alias(text))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, some with a planted periodic tail, and digests of runs and collapsed text.

    Null texts and texts without words have no runs, and digests of empty texts.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_runs(planted(docs))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000L * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
