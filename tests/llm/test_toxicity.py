"""Toxicity: gradient and score against plain formulas, planted sentences, held-out documents."""

import math
import os
import random

import numpy as np
import pytest

from fleetpulse.llm import toxicity

FOLDER = "/root/testdata/sf0.1"
WORDS = [a + b + c for a in "bdfg" for b in "aeiou" for c in ("lin", "mor", "tas", "vek")]


def sentence(rng, bad=None):
    words = [rng.choice(WORDS) for _ in range(rng.randint(4, 12))]
    if bad:
        words.insert(rng.randrange(len(words)), bad)
    return " ".join(words).capitalize() + "."


def corpus(n, seed):
    """(id, text, toxic, place of the toxic sentence)."""
    rng, out = random.Random(seed), []
    for i in range(n):
        toxic = int(i % 4 == 0)
        lines = [sentence(rng) for _ in range(rng.randint(3, 12))]
        at = rng.randrange(len(lines))
        if toxic:
            lines[at] = sentence(rng, rng.choice(["zukk", "zukker", "qobbel"]))
        out.append((i, " ".join(lines), toxic, lines[at] if toxic else None))
    return out


def model_of(rows):
    return toxicity.train([list(toxicity.sentences(r[1])) for r in rows], [r[2] for r in rows])


def test_offending_sentences_are_found():
    model = model_of(corpus(600, 1))
    values = toxicity.Values(model)
    hits = wrong = 0
    for _, text, toxic, line in corpus(300, 2):
        score, spans = toxicity.judge(text, model, values)
        assert (score >= toxicity.PREDICTED) == bool(toxic)
        found = [text[a : a + n].strip() for a, n, _ in spans]
        hits += found == [line.rstrip(".")] if toxic else 0
        wrong += bool(found) and not toxic
    assert hits >= 70 and wrong == 0


def test_score_is_noisy_or_over_different_sentences():
    model = model_of(corpus(400, 3))
    values = toxicity.Values(model)
    text = "Zukk balin dalin. Fe mor.\nZukk balin dalin! 123. galin zukker tas"
    none = 1.0
    for words in ("zukk balin dalin", "fe mor", "galin zukker tas"):
        z = model.bias + sum(float(model.weights[toxicity.stems(w)].sum()) for w in set(words.split()))
        none *= 1 - 1 / (1 + math.exp(-z))
    assert math.isclose(toxicity.judge(text, model, values)[0], 1 - none, rel_tol=1e-9)


def test_documents_of_stems():
    flat = toxicity.Bags.of([["alpha beta", "alpha"], ["beta gamma"], ["alphabet"]])
    n = flat.documents_of_stems()
    at = lambda s: n[toxicity.zlib.crc32(s.encode()) % toxicity.BUCKETS]
    assert (at("alpha$"), at("alpha"), at("beta$"), at("alp"), at("gamma$"), at("nothing")) == (1, 1, 2, 2, 1, 0)


def test_nothing_learned_without_both_labels():
    for rows in ([], [(0, "some words here", 1, None)], [(0, "some words here", 0, None), (1, None, 1, None)]):
        model = model_of(rows)
        assert toxicity.judge("some words here", model, toxicity.Values(model)) == (0.0, [])


def test_edges(spark):
    rows = corpus(400, 5)
    docs = spark.createDataFrame([(r[0], r[1], "x") for r in rows], "doc_id long, text string, score string")
    marks = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    doubled = docs.unionByName(docs.where("doc_id < 50")).unionByName(docs.limit(0))
    drawn = toxicity.sample(marks)
    assert drawn.count() == 400 and drawn.where("doc_id = 0").first()["toxic"] == 1
    few = toxicity.sample(marks, train_docs=40).groupBy("toxic").count().collect()
    assert all(20 <= r["count"] <= 110 for r in few)
    model = toxicity.fit(doubled, marks)
    assert model.learned
    same = toxicity.fit(docs.repartition(5), marks)
    assert (same.weights == model.weights).all() and same.bias == model.bias
    odd = [(1, None), (2, ""), (3, " .!?\n 123"), (None, "Balin zukk fe."), (5, "zukk " * 50_000), (6, "Balin dalin. " * 20_000), (6, "Balin dalin.")]
    out = toxicity.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert got[1] == got[2] == [0.0]
    assert got[3][0] == 0.0
    assert got[None][0] > 0.7 and got[5][0] > 0.7
    assert got[6][0] == got[6][1] < 0.1
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs.limit(0), marks).learned is False
    assert toxicity.fit(docs, marks.limit(0)).learned is False


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
def test_held_out_documents(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.op13_toxicity(spark, FOLDER)
    assert got.count() == 10_000
    pairs = got.where("held_out").join(labels, "doc_id").select("toxic", "score", "predicted").collect()
    toxic = np.array([r["score"] for r in pairs if r["toxic"] == 1])
    clean = np.array([r["score"] for r in pairs if r["toxic"] == 0])
    assert np.mean([(toxic > c).mean() + 0.5 * (toxic == c).mean() for c in clean]) > 0.93
    assert (clean >= toxicity.PREDICTED).mean() < 0.005
    assert (toxic >= toxicity.PREDICTED).mean() > 0.7
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in pairs)
