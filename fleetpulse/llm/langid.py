"""Language identification with a string kernel.

The kernel of two texts is, blended over n-grams of 1 to 3 letters, the number of
different n-grams present in both, divided by the geometric mean of the numbers in
each. Landmark texts give Nyström features of it, and one-versus-rest ridge
regression on these gives a score for each language. Since the kernel is a sum of
products over n-grams, landmarks and weights fold into one matrix, and a batch of
texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fleetpulse.llm.common import release_memory, released, table, worker_cache

#: Rows learned from, over all languages, and landmarks among them. These bound the fit on the driver.
TRAIN_ROWS = 4000
LANDMARKS = 256
RIDGE = 1e-3
#: Hash buckets for n-grams of 1, 2 and 3 letters.
BUCKETS = (1 << 10, 1 << 13, 1 << 15)
STARTS = (0, BUCKETS[0], BUCKETS[0] + BUCKETS[1])
WIDTH = sum(BUCKETS)
UNKNOWN = "und"
PIECE = 1 << 18


def letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 if it is no letter."""
    kept = worker_cache("langid")
    if "letters" not in kept:
        folded = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                folded[i] = ord(c.lower()[0])
        kept["letters"] = folded
    return kept["letters"]


def presence(text: str | None, out: np.ndarray) -> bool:
    """Mark the n-grams of the whole text in ``out`` (WIDTH flags); whether it has letters.

    Runs of anything but letters count as one gap. Long texts pass in pieces.
    """
    out[:] = 0
    if not text:
        return False
    fold, found, tail = letters(), False, np.zeros(1, np.uint32)
    for start in range(0, len(text), PIECE):
        codes = fold[np.frombuffer(text[start : start + PIECE].encode("utf-32-le", "replace"), "<u4")]
        if not codes.any():
            codes = codes[:1]
        else:
            found = True
        s = np.concatenate([tail, codes])
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
        if start + PIECE >= len(text) and s[-1]:
            s = np.append(s, np.uint32(0))
        tail = s[-2:]
        out[(s[s > 0] * np.uint32(2654435761)) >> np.uint32(22)] = 1
        if len(s) > 1:
            two = (s[:-1] * np.uint32(2654435761)) ^ (s[1:] * np.uint32(2246822519))
            out[STARTS[1] + (two * np.uint32(3266489917) >> np.uint32(19))] = 1
        if len(s) > 2:
            three = two[:-1] * np.uint32(668265263) ^ (s[2:] * np.uint32(374761393))
            out[STARTS[2] + (three * np.uint32(2654435761) >> np.uint32(17))] = 1
    return found


def scaled(flags: np.ndarray) -> np.ndarray:
    """Presence rows divided so that the dot product of two rows is their kernel."""
    out = flags.astype(np.float32)
    for start, n in zip(STARTS, BUCKETS):
        part = out[:, start : start + n]
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1) * len(BUCKETS))
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # WIDTH x languages
    bias: np.ndarray

    def scores(self, flags: np.ndarray) -> np.ndarray:
        return scaled(flags) @ self.weights + self.bias


def train(packed: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström features over evenly chosen landmarks, then one-versus-rest kernel ridge regression.

    ``packed`` has the presence flags of a text in each row, eight to a byte; they
    are unpacked for a block of texts at a time.
    """
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((WIDTH, 0), np.float32), np.zeros(0, np.float32))
    marks, seen = [], dict.fromkeys(languages, 0)
    each = max(1, landmarks // len(languages))
    for i, label in enumerate(labels):
        if seen[label] < each:
            seen[label] += 1
            marks.append(i)

    def rows(chosen) -> np.ndarray:
        return scaled(np.unpackbits(packed[chosen], axis=1, count=WIDTH))

    z = rows(marks)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    kept = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, kept] / np.sqrt(values[kept])
    blocks = [rows(slice(at, at + 256)) @ z.T for at in range(0, len(packed), 256)]
    features = np.concatenate(blocks).astype(np.float64) @ root
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = np.array([1.0 / labels.count(c) for c in languages])[[languages.index(c) for c in labels]]
    weight /= weight.sum()
    mean, level = weight @ features, weight @ target
    centred = features - mean
    normal = (centred * weight[:, None]).T @ centred + ridge * np.eye(centred.shape[1])
    beta = np.linalg.solve(normal, (centred * weight[:, None]).T @ (target - level))
    return Model(languages, (z.T @ (root @ beta)).astype(np.float32), (level - mean @ beta).astype(np.float32))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", order: str = "order", train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most ``train_rows`` rows, equally many a language, those first by ``order`` (a hash, long).

    Rows without a language or letters teach nothing. Presence flags are made on
    the executors from whole texts; the driver gets the packed flags only.
    """
    known = rows.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(order).alias("order"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(train_rows).collect()}
    if not counts:
        return train(np.zeros((0, 0), np.uint8), [])
    each = max(1, train_rows // len(counts))
    # a little more than needed by a threshold on the hash, then exactly that many
    share = F.pmod(F.col("order"), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(0.0)
    for language, n in counts.items():
        wanted = F.when(F.col("lang") == language, F.lit(min(1.0, (1.3 * each + 50) / n))).otherwise(wanted)
    first = F.row_number().over(W.partitionBy("lang").orderBy("order", "text"))
    chosen = known.where(share < wanted).withColumn("nth", first).where(F.col("nth") <= each)

    def flags(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = np.zeros(WIDTH, np.uint8)
        for part in parts:
            made = [np.packbits(one).tobytes() if presence(t, one) else None for t in part["text"]]
            yield pd.DataFrame({"lang": part["lang"], "nth": part["nth"], "flags": made}).dropna()

    made = chosen.mapInPandas(released(flags), "lang string, nth int, flags binary").collect()
    made.sort(key=lambda r: (r["nth"], r["lang"]))
    packed = np.frombuffer(b"".join(bytes(r["flags"]) for r in made), np.uint8).reshape(len(made), -1 if made else 0)
    labels = [r["lang"] for r in made]
    del made
    model = train(packed, labels)
    del packed
    # the driver lives on: what the fit took must not stay with it
    release_memory()
    return model


def predictions(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(whole, p): each row of ``docs`` as a struct, and its ``lang`` and ``score``; no column of ``docs`` can clash."""

    @F.pandas_udf("lang string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            names, scores = [], []
            for start in range(0, len(texts), 64):
                block = texts.iloc[start : start + 64]
                flags = np.zeros((len(block), WIDTH), np.uint8)
                found = [presence(t, row) for t, row in zip(block, flags)]
                if not model.languages:
                    names += [UNKNOWN] * len(block)
                    scores += [0.0] * len(block)
                    continue
                raw = model.scores(flags).astype(np.float64) * 4
                soft = np.exp(raw - raw.max(axis=1, keepdims=True))
                soft /= soft.sum(axis=1, keepdims=True)
                best = soft.argmax(axis=1)
                names += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, found)]
                scores += [float(s[b]) if ok else 0.0 for s, b, ok in zip(soft, best, found)]
            yield pd.DataFrame({"lang": names, "score": scores})
        release_memory()

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    return docs.select(whole, predict(F.col(f"`{text}`")).alias("p"))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, softmax over languages).

    A null text, one without letters, and any text if nothing was learned are
    ``und`` with score 0. The whole text is read, however long; repeated rows get
    the same result. All columns pass through, except that columns named
    ``lang_pred`` and ``score`` are replaced.
    """
    taken = [F.col(f"whole.`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return predictions(docs, model, text).select(*taken, F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def held_out(key: Column) -> Column:
    """Documents that are not learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn_documents(docs: DataFrame) -> Model:
    rows = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    return fit(rows.withColumn("order", F.xxhash64(F.lit("language sample"), "doc_id")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out; null and letterless texts are ``und``."""
    docs = table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(marked, learn_documents(docs)).select("doc_id", "held_out", "lang_pred", "score")
