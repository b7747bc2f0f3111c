"""Runs against a direct search over all periods and starts, and the query against plain Python."""

import hashlib
import os
import random
import zlib

import pytest

from fleetpulse.llm import periodic

FOLDER = "/root/testdata/sf0.001"


def direct(words, least_length=6, least_exponent=4):
    """All runs by trying every period at every place."""
    out, n = [], len(words)
    for q in range(1, n // least_exponent + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            if end > start and length >= max(least_length, least_exponent * q):
                part = words[start : start + length]
                if all(any(part[k] != part[k + r] for k in range(length - r)) for r in range(1, q)):
                    out.append((start, length, q))
            start = max(end, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = set()
    for start, length, q in runs:
        gone.update(range(start + q, start + length))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_equal_direct_search():
    rng = random.Random(5)
    for _ in range(1500):
        texts = []
        for _ in range(rng.randint(1, 3)):
            words = [str(rng.randrange(rng.choice([1, 2, 3]))) for _ in range(rng.randint(0, 50))]
            if words and rng.random() < 0.6:
                a, q = rng.randrange(len(words)), rng.randint(1, 6)
                words = [w if i < a else words[min(a + (i - a) % q, len(words) - 1)] for i, w in enumerate(words)]
            texts.append(words)
        exponent, length = rng.choice([2, 3, 4]), rng.choice([2, 4, 6, 8])
        for (runs, rest), words in zip(periodic.collapsed(texts, length, exponent), texts):
            assert runs == direct(words, length, exponent)
            assert rest == collapse(words, runs)


def test_long_and_repetitive_texts():
    for words, run in ((["a"] * 120_000, (0, 120_000, 1)), (["a", "b", "c"] * 40_000, (0, 120_000, 3))):
        ((runs, rest),) = list(periodic.collapsed([words], 6, 4))
        assert runs == [run]
        assert rest == " ".join(words[: run[2]])


def test_strongest_breaks_ties():
    assert periodic.strongest([]) is None
    assert periodic.strongest([(0, 8, 2), (3, 6, 1), (20, 12, 2), (40, 18, 3)]) == (3, 6, 1)
    assert periodic.strongest([(5, 8, 2), (5, 16, 4), (9, 12, 3)]) == (5, 8, 2)


def test_blocks_hold_whole_texts(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK_WORDS", 4)
    texts = ["a b c", None, "", "d e", "f g h i j k", " \t\n", "l"]
    assert [len(b) for b in periodic.blocks(texts)] == [3, 1, 1, 2]
    assert [w for b in periodic.blocks(texts) for w in b] == [["a", "b", "c"], [], [], ["d", "e"], list("fghijk"), [], ["l"]]


def test_edges(spark):
    rows = [
        (1, None, "x"),
        (2, "", "x"),
        (3, " \n ", "x"),
        (4, "no no no no no no", "x"),
        (4, "no no no no no no", "x"),
        (None, "a b a b a b a b end", "x"),
        (5, "spam x " * 6, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["strongest"], r["collapsed"]) for r in periodic.find_runs(docs).collect()]
    assert len(out) == 7
    by = {}
    for doc, runs, best, rest in out:
        by.setdefault(doc, []).append((runs, None if best is None else tuple(best), rest))
    assert by[1] == by[2] == by[3] == [([], None, "")]
    assert by[4] == [([(0, 6, 1)], (0, 6, 1), "no")] * 2
    assert by[None] == [([(0, 8, 2)], (0, 8, 2), "a b end")]
    assert by[5] == [([(0, 6, 1)], (0, 6, 1), "spam x")]
    assert periodic.find_runs(docs.limit(0)).count() == 0


def expected(doc_id, text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = direct(words)
    best = periodic.strongest(runs)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    facts = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *facts, digest(lines), digest(collapse(words, runs)))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
def test_query_equals_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"] for r in docs if len((r["text"] or "").split()) < 1500}
    want = sorted(expected(r["doc_id"], r["text"]) for r in docs if r["doc_id"] in short)
    columns = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got = sorted(tuple(r[c] for c in columns) for r in periodic.op11_periodic_runs(spark, FOLDER).collect() if r["doc_id"] in short)
    assert len(want) > 150 and any(w[1] for w in want)
    assert got == want
