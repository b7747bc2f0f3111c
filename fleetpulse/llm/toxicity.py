"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the document carries a label. The
sentence model is logistic over the stems of the sentence's words; a document
is toxic if any of its sentences is, so its score is the noisy-or of theirs, and
the gradient of the document's loss says which sentences of a toxic document to
blame. The sentences blamed are then reported with their place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.llm.common import table
from fleetpulse.llm.langid import held_out
from fleetpulse.session import written

#: Labelled documents learned from, half of each label as far as there are as many, and characters
#: of the longest of them. Both bound the fit on the driver.
TRAIN_DOCS = 4000
BAG_CHARS = 1 << 15
#: Hash buckets for words and stems, and lengths of the stems.
BUCKETS = 1 << 18
STEMS = (3, 4, 5, 6)
#: A stem that fewer documents have is not learned: it would only be blamed for what it happens to stand beside.
LEAST_DOCS = 3
STEPS = 150
RATE = 0.1
DECAY = 3e-4
#: A sentence from this score on is reported.
OFFENDING = 0.5
PREDICTED = 0.7
#: Words whose value a task remembers.
REMEMBERED = 200_000

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def stems(word: str) -> list[int]:
    """Buckets of the word and of its beginnings."""
    cut = [word[:k] for k in STEMS if k < len(word)]
    return [zlib.crc32(s.encode("utf-8", "replace")) % BUCKETS for s in (word + "$", *cut)]


def sentences(text: str | None) -> dict[str, tuple[int, int]]:
    """The different sentences of a text, in lower case, with start and length of the first of each.

    A sentence without letters says nothing and is left out.
    """
    found: dict[str, tuple[int, int]] = {}
    for m in SENTENCE.finditer(text or ""):
        found.setdefault(m.group().strip().lower(), m.span())
    return {s: (at, end - at) for s, (at, end) in found.items() if WORD.search(s)}


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    learned: bool = True


class Values(dict):
    """Value of each word under a model, worked out when first asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self.weights = model.weights

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = float(self.weights[stems(word)].sum())
        return value


@dataclass
class Bags:
    """Bags flattened: words of sentences, sentences of documents, stems of words, all by place."""

    sizes: np.ndarray  # sentences of each document
    firsts: np.ndarray  # first sentence of each document
    words: np.ndarray  # word numbers, sentence after sentence
    starts: np.ndarray  # first place of each sentence in words
    sentence: np.ndarray  # sentence of each place
    stems: np.ndarray  # buckets, word after word
    stem_starts: np.ndarray  # first place of each word in stems
    stem_word: np.ndarray  # word of each place in stems

    @classmethod
    def of(cls, bags: Sequence[Sequence[str]]) -> Bags:
        ids: dict[str, int] = {}
        words, lengths = [], []
        for bag in bags:
            for sentence in bag:
                found = dict.fromkeys(WORD.findall(sentence))
                words += [ids.setdefault(w, len(ids)) for w in found]
                lengths.append(len(found))
        flat = [stems(w) for w in ids]
        per_word = np.array([len(f) for f in flat], np.int64)
        sizes, per_sentence = np.array([len(b) for b in bags], np.int64), np.array(lengths, np.int64)
        return cls(
            sizes,
            np.cumsum(sizes) - sizes,
            np.array(words, np.int32),
            np.cumsum(per_sentence) - per_sentence,
            np.repeat(np.arange(len(lengths), dtype=np.int32), per_sentence),
            np.array([s for f in flat for s in f], np.int32),
            np.cumsum(per_word) - per_word,
            np.repeat(np.arange(len(flat), dtype=np.int32), per_word),
        )

    def documents_of_stems(self) -> np.ndarray:
        """For every bucket the number of documents that have it."""
        out = np.zeros(BUCKETS, np.int64)
        ends = np.append(self.starts, len(self.words))
        word_ends = np.append(self.stem_starts, len(self.stems))
        for first, size in zip(self.firsts, self.sizes):
            words = np.unique(self.words[ends[first] : ends[first + size]])
            out[np.unique(np.concatenate([self.stems[word_ends[w] : word_ends[w + 1]] for w in words]))] += 1
        return out


def train(bags: Sequence[Sequence[str]], labels: Sequence[int]) -> Model:
    """Fit on bags of sentences, both labels weighing the same; nothing is learned unless both occur."""
    kept = [i for i, bag in enumerate(bags) if bag]
    y = np.array([int(labels[i]) for i in kept])
    if not (y == 1).any() or not (y == 0).any():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, False)
    flat = Bags.of([bags[i] for i in kept])
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    used, place = np.unique(flat.stems, return_inverse=True)
    common = flat.documents_of_stems()[used] >= LEAST_DOCS
    # one step size for each stem and the bias, from running means of the slope and its square
    theta = np.append(np.zeros(len(used)), -5.0)
    mean, square = np.zeros(len(theta)), np.zeros(len(theta))
    for step in range(1, STEPS + 1):
        value = np.add.reduceat(theta[place], flat.stem_starts)
        z = np.clip(np.add.reduceat(value[flat.words], flat.starts) + theta[-1], -30, 30)
        # chance that no sentence of a document is toxic
        none = np.exp(np.add.reduceat(-np.logaddexp(0, z), flat.firsts))
        # slope of -log P for label 1 and of -log(1 - P) for label 0 with regard to each z
        pull = np.where(y == 1, -none / np.maximum(1 - none, 1e-12), 1.0) * weight
        slope = np.repeat(pull, flat.sizes) / (1 + np.exp(-z))
        by_word = np.bincount(flat.words, slope[flat.sentence], len(value))
        by_stem = np.bincount(place, by_word[flat.stem_word], len(used)) + DECAY * theta[:-1]
        grad = np.append(by_stem * common, slope.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta = theta - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = theta[:-1]
    return Model(weights, float(theta[-1]))


def judge(text: str | None, model: Model, values: Values) -> tuple[float, list[tuple[int, int, float]]]:
    """Noisy-or over the different sentences of a text, and start, length, score of the offending ones."""
    if not model.learned:
        return 0.0, []
    found, none = [], 1.0
    for sentence, (start, length) in sentences(text).items():
        z = model.bias + sum(map(values.__getitem__, set(WORD.findall(sentence))))
        p = 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))
        none *= 1 - p
        if p >= OFFENDING:
            found.append((start, length, float(p)))
    return float(1 - none), found


def sample(labels: DataFrame, key: str = "doc_id", label: str = "toxic", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(key, label, order) of labelled keys to learn from, somewhat more than ``train_docs``: half of each label, as far as there are as many.

    A key labelled both ways is toxic; null keys and labels other than 0 and 1 are
    left out. A hash of the key settles which are taken.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    known = usable.groupBy(key).agg(F.max(label).alias(label))
    counts = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}
    few = min(counts.get(1, 0), train_docs // 2)
    each = {1: max(few, train_docs - counts.get(0, 0)), 0: train_docs - few}
    order = F.xxhash64(F.lit("toxic sample"), key)
    share = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(0.0)
    for found, n in counts.items():
        wanted = F.when(F.col(label) == found, F.lit(min(1.0, (1.25 * each[found] + 50) / n))).otherwise(wanted)
    most = F.when(F.col(label) == 1, F.lit(each[1])).otherwise(F.lit(each[0]))
    return known.withColumns({"order": order, "most": most}).where(share < wanted)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from at most ``train_docs`` labelled documents.

    The keys are drawn from the labels alone and sent to the documents, so no text
    is moved but those learned from. Of different texts under one key one is taken
    by its hash. Texts of over BAG_CHARS characters, null and empty ones teach
    nothing. Sentences are found on the executors.
    """
    # about 1.25 * train_docs rows of a key and three numbers
    drawn = F.broadcast(written(sample(labels, key, label, train_docs), "toxic-sample"))
    known = docs.select(key, text).join(drawn, key).where(F.length(text).between(1, BAG_CHARS))
    one = known.groupBy(key, label, "order", "most").agg(F.min_by(text, F.xxhash64(text)).alias("text"))
    first = F.row_number().over(W.partitionBy(label).orderBy("order", key))
    chosen = one.withColumn("nth", first).where("nth <= most").select(F.col(label).alias("label"), "nth", "text")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            bags = [list(sentences(t)) for t in part["text"]]
            yield pd.DataFrame({"label": part["label"], "nth": part["nth"], "bag": bags})

    made = chosen.mapInPandas(cut, "label int, nth int, bag array<string>").collect()
    made.sort(key=lambda r: (r["nth"], r["label"]))
    return train([r["bag"] for r in made], [r["label"] for r in made])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, score (0 to 1), offending (start, length, score of sentences).

    Places count characters from 0. Null and empty texts, and texts without
    letters, have no sentence and score 0, as does every text if nothing was learned. Whole
    texts are read, however long; of equal sentences of a text the first counts,
    so a text's score does not rise with repeats. Repeated rows are scored each;
    other columns are not read. An empty table gives an empty result.
    """

    @F.pandas_udf("score double, offending array<struct<start: int, length: int, score: double>>")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        values = Values(model)
        for texts in parts:
            found = [judge(t, model, values) for t in texts]
            spans = [[{"start": a, "length": n, "score": p} for a, n, p in f[1]] for f in found]
            yield pd.DataFrame({"score": [f[0] for f in found], "offending": spans})

    return docs.select(F.col(key).alias(key), judged(F.col(text)).alias("j")).select(key, "j.score", "j.offending")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of documents that are not held out.

    Null and empty texts score 0; ids that are null or repeat are scored row by row; see ``score``.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= PREDICTED).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )
