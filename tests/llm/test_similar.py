import itertools
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fleetpulse.llm import ann, common, passages, simhash
from fleetpulse.llm.common import components
from fleetpulse.session import written

FOLDER = "/root/testdata/sf0.01"
ASCII = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))


def shingles(text, n):
    w = words(text)
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])


def fingerprint(text, n=4):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_random_graphs(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(900, 900 + i) for i in range(80)]
    want = Sets({x for p in pairs for x in p})
    for a, b in pairs:
        want.join(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "src long, dst long"), "t").collect()}
    assert all(got.get(x, x) == want.find(x) for x in want.up)


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, " \t"), (-4, "One two"), (-5, "one TWO"), (-6, "É é É é"), (None, "one two")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {(r.doc_id): r for r in simhash.near_duplicates(docs).collect()}
    prints = np.array([fingerprint(t) for _, t in rows], np.uint64)
    want = Sets(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 4) + i + 1:
            want.join(i, int(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[want.find(i)] = min(least.get(want.find(i), key), key)
    for i, (key, _) in enumerate(rows):
        assert got[key].fingerprint == f"{int(prints[i]):016x}" and got[key].component_id == least[want.find(i)]


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(random.Random(3).choice(["alpha", "be", "C", "Gamma\t"]) for _ in range(500))
    whole = simhash.majorities([text, None, "a b"], 4)
    for piece in (1, 16, 100):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert (simhash.majorities([text, None, "a b"], 4) == whole).all()
    assert int(whole[0]) == fingerprint(text) and whole[1] == 0 and int(whole[2]) == fingerprint("a b")


@pytest.mark.parametrize("radius", [1, 4, 6])
def test_links_connect_like_all_pairs_in_dense_groups(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "CHUNK_ROWS", 40)
    rnd = random.Random(radius)
    base = [rnd.getrandbits(64) for _ in range(3)]
    values = {b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(6))) & ((1 << 64) - 1) for b in base for _ in range(150)}
    values |= {rnd.getrandbits(64) for _ in range(300)}
    values = sorted(v & ((1 << 64) - 1) for v in values)
    fps = written(spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long"), "t")
    got, want = Sets(values), Sets(values)
    for r in simhash.links(fps, radius).collect():
        a, b = r.src % (1 << 64), r.dst % (1 << 64)
        assert (a ^ b).bit_count() <= radius
        got.join(a, b)
    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= radius:
            want.join(a, b)
    assert [got.find(v) for v in values] == [want.find(v) for v in values]


def near_copies(rnd, n):
    vocabulary = [f"w{i}" for i in range(2000)]
    rows, groups = [], []
    for g in range(n):
        w = [rnd.choice(vocabulary) for _ in range(200)]
        members = []
        for c in range(3 if g % 4 == 0 else 1):
            v = list(w)
            for _ in range(c):
                v[rnd.randrange(200)] = rnd.choice(vocabulary)
            members.append((len(rows), " ".join(v), g))
            rows.append(members[-1])
        groups.append(members)
    return rows, groups


def test_one_of_each_near_copy_stays(spark):
    rows, groups = near_copies(random.Random(4), 60)
    rows += [(5000, None, -1), (5001, "", -2), (None, "only one without a key", -3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    kept = simhash.deduplicate(docs)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == ["doc_id", "text", "fp"]
    assert ids == {g[0][0] for g in groups} | {5000, None}


def test_a_repeated_line_makes_no_near_copies(spark):
    rnd = random.Random(5)
    line = "one two three four five " * 200
    rows = [(i, line + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(300)), i) for i in range(12)]
    rows += [(100 + i, rows[i][1] + " end", i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    assert len({fingerprint(t, 5) for _, t, _ in rows}) < 4
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == list(range(12))


@pytest.mark.parametrize("first", [1, 8])
def test_groups_whose_closest_pair_fails_are_linked(spark, monkeypatch, first):
    monkeypatch.setattr(simhash, "WIDE_PAIRS", first, raising=False)
    changed = {1: [("a", 0)], 2: [], 3: [("b", 10), ("b", 20)], 4: [("b", 10)]}
    prints = {1: 0, 2: 0b11111 << 10, 3: 0b11111, 4: 0b11111 | 0b111 << 10}
    texts = {}
    for i, parts in changed.items():
        w = [f"c{n}" for n in range(100)]
        for name, at in parts:
            w[at : at + 10] = [f"{name}{n}" for n in range(at, at + 10)]
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")

    def fingerprints(docs, words, key, text):
        fps = spark.createDataFrame(list(prints.items()), "doc_id long, fp long")
        return docs.select("doc_id", simhash.text_tag(text).alias("th")).join(fps, "doc_id")

    monkeypatch.setattr(simhash, "fingerprints", fingerprints)
    assert [r.doc_id for r in simhash.deduplicate(docs, words=1).collect()] == [1]


def brute_passages(texts, n=51):
    seen, sets, hit = {}, Sets(texts), set()
    for i, t in texts.items():
        w = words(t)
        for j in range(len(w) - n + 1):
            seen.setdefault(tuple(w[j : j + n]), set()).add(i)
    for group in seen.values():
        if len(group) > 1:
            hit |= group
            for b in group:
                sets.join(min(group), b)
    return sets, hit


@pytest.mark.parametrize("group_rows", [4, 64])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, group_rows):
    monkeypatch.setattr(passages, "GROUP_ROWS", group_rows)
    rnd = random.Random(group_rows)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    hot, line = draw(51), draw(15)
    texts = {}
    for i in range(120):
        w = draw(rnd.randrange(0, 250))
        if i % 3 == 0:
            at = rnd.randrange(len(w) + 1)
            w[at:at] = hot
        elif i % 3 == 1:
            w += line + draw(30)
        texts[i] = " ".join(w)
    shared = draw(60)
    texts[200], texts[201] = " ".join(draw(20) + shared), " ".join(shared + draw(70))
    texts[202] = texts[201]
    texts[203] = " ".join(draw(45))
    texts[204] = texts[203]  # equal, but too short for a passage
    rows = [(i, t) for i, t in texts.items()] + [(300, None), (301, ""), (None, texts[200])]
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, hit = brute_passages(texts)
    for i in texts:
        assert got[i].class_id == sets.find(i), i
        assert (got[i].n_links > 0 or got[i].copies > 1) == (i in hit)
    assert got[None].class_id == 200 and got[300].class_id == 300 and got[301].spans == []
    assert [tuple(s) for s in got[200].spans] == [(20, 79)] and got[201].repeated_words == 60


def test_similar_passage_with_an_edit(spark):
    rnd = random.Random(9)
    w = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    v = list(w)
    v[60:61] = ["other", "words"]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(v)), (3, "nothing alike " * 60)], "doc_id long, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    assert got[2].class_id == 1 and got[3].class_id == 3 and got[1].repeated_words > 100


@pytest.mark.parametrize("more", [3, 4])
def test_similar_passage_with_words_put_in(spark, more):
    rnd = random.Random(more)
    draw = lambda n: [f"w{rnd.randrange(100_000)}" for _ in range(n)]
    rows = []
    for i in range(8):
        same = draw(60)
        rows.append((2 * i, " ".join(draw(30) + same + draw(30))))
        rows.append((2 * i + 1, " ".join(draw(40) + same[:30] + draw(more) + same[30:] + draw(20))))
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].class_id == i - i % 2 for i in range(16))
    assert all(got[i].repeated_words >= 60 for i in range(16))


@pytest.mark.parametrize("hot_rows", [100, 4096])
def test_batches_do_not_part_passages_around_a_hot_line(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(passages, "HOT_ROWS", hot_rows, raising=False)
    rnd = random.Random(12)
    draw = lambda n: [f"w{rnd.randrange(100_000)}" for _ in range(n)]
    line = draw(40)
    own = [draw(12) for _ in range(16)]
    first = [draw(20) + own[i] + line + draw(20) if i < 16 else draw(20) + line + draw(20) for i in range(120)]
    texts = {i: " ".join(w) for i, w in enumerate(first + [draw(30) + p + line + draw(9) for p in own])}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 120)
    try:
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
        got = {r.doc_id: r.class_id for r in passages.repeated_passages(docs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sets, _ = brute_passages(texts)
    assert got == {i: sets.find(i) for i in texts}


@pytest.mark.parametrize("chunk_rows", [12, 4096])
def test_similar_copies_of_a_hot_passage(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(passages, "CHUNK_ROWS", chunk_rows, raising=False)
    rnd = random.Random(chunk_rows)
    draw = lambda n: [f"w{rnd.randrange(1_000_000)}" for _ in range(n)]
    hot, line, rows = draw(60), draw(20), []
    for i in range(100):
        rows.append((i, " ".join(draw(20) + hot[:29] + draw(1) + hot[30:] + draw(25))))
        rows.append((1000 + i, " ".join(draw(40) + line + draw(40))))
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].class_id == 0 and got[i].repeated_words >= 59 and got[i].n_links > 0 for i in range(100))
    assert all(got[1000 + i].class_id == 1000 + i and not got[1000 + i].spans for i in range(100))


@pytest.mark.parametrize("group_rows, chunk_rows", [(4, 4096), (1000, 4096), (4, 12)])
def test_all_links_of_a_hot_passage_are_counted(spark, monkeypatch, group_rows, chunk_rows):
    monkeypatch.setattr(passages, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(passages, "CHUNK_ROWS", chunk_rows)
    rnd = random.Random(31)
    draw = lambda n: [f"w{rnd.randrange(1_000_000)}" for _ in range(n)]
    hot, first, near = draw(60), draw(140), draw(130)
    texts = {i: draw(10 + i % 7) + hot + draw(12) for i in range(80)}
    # equal windows from the start of texts, and copies with a word of their own in the middle
    texts |= {100 + i: first + draw(20 + i) for i in range(70)}
    texts |= {200 + i: draw(5) + near[:64] + draw(1) + near[65:] + draw(5) for i in range(70)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    assert all(got[i].class_id == i // 100 * 100 for i in texts)
    assert {got[i].n_links for i in range(80)} == {79} and {got[100 + i].n_links for i in range(70)} == {69}
    assert {got[200 + i].n_links for i in range(70)} == {69}
    assert all(s.first <= 10 + i % 7 and s.last >= 69 + i % 7 for i in range(80) for s in got[i].spans)


def test_pairs_are_verified_as_by_comparing_all_marks():
    rnd = np.random.default_rng(5)
    width = 2 * passages.REACH + 1
    rows = np.tile(rnd.integers(1, 60_000, (6, width)).astype(np.uint16), (10, 1))
    for i, row in enumerate(rows):
        hit = rnd.random(width) < i / 300
        row[hit] = rnd.integers(1, 9, hit.sum())
        rows[i] = np.roll(row, rnd.integers(-6, 7))
        rows[i, : rnd.integers(0, 50)] = 0
    y, x = np.triu_indices(len(rows), 1)
    good, places = passages.similar(rows[x], rows[y])
    want = set(zip(x[good], y[good], map(tuple, places[good])))
    assert 0 < len(want) < len(x)
    mixed = rnd.permutation(len(x))
    for order in (np.arange(len(x)), mixed):  # by tables and by search
        made = passages.Marks(rows).verified(x[order], y[order])
        assert set(zip(made[0], made[1], map(tuple, made[2]))) == want


@pytest.mark.parametrize("least", [1, 7, 47])
def test_compact_windows_equal_those_of_the_definition(least):
    rnd = np.random.default_rng(least)
    for n in [*range(9), 60, 150]:
        for values in (rnd.integers(0, 4, n), rnd.integers(0, 1 << 63, n).astype(np.uint64)):
            want = []
            for c in range(n):
                if 0 < c < n - 1 and values[c - 1] == values[c] == values[c + 1]:
                    continue
                inner = [0 < i < n - 1 and values[i - 1] == values[i] == values[i + 1] for i in range(c)]
                before = [i for i in range(c) if values[i] <= values[c] and not inner[i]]
                after = [i for i in range(c + 1, n) if values[i] < values[c]]
                low, high = before[-1] + 1 if before else 0, after[0] - 1 if after else n - 1
                if high - low + 1 >= least:
                    want.append((low, c, high))
            assert passages.compact_windows(values, least) == want


def test_marks_scattered_over_a_window_are_not_similar():
    rnd = np.random.default_rng(6)
    width = 2 * passages.REACH + 1
    a, b = rnd.permutation(60_000)[: 2 * width].reshape(2, 1, width).astype(np.uint16) + 1
    at = np.linspace(0, width - 1, 45).astype(int)
    b[0, at] = a[0, passages.REACH - 22 : passages.REACH + 23]
    assert not passages.similar(a, b)[0][0]
    assert passages.similar(a, a)[0][0] and passages.overlapping(a, a)[1].tolist() == [[0, width - 1] * 2]


def test_sparse_marks_are_left_out_without_losing_a_similar_pair():
    rnd = np.random.default_rng(3)
    width = 2 * passages.REACH + 1
    a = rnd.integers(1, 60_000, (600, width)).astype(np.uint16)
    b = a.copy()
    for i in range(len(a)):
        hit = rnd.random(width) < i / len(a) * 0.5
        b[i, hit] = rnd.integers(1, 60_000, hit.sum())
        b[i] = np.roll(b[i], rnd.integers(-9, 10))
        b[i, : rnd.integers(0, 60)] = 0
        b[i, width - rnd.integers(1, 60) :] = 0
        if i % 3 == 0:
            a[i], b[i] = a[i] % 9 + 1, np.where(b[i] == 0, 0, b[i] % 9 + 1)
    good = passages.similar(a, b)[0]
    has = np.stack([np.isin(x, y[y != 0]) & (x != 0) for x, y in zip(a, b)])
    kept = passages.dense(has)
    assert good.any() and not good.all() and not (good & ~kept).any()
    assert not kept.all()


def test_windows_of_one_kind_link_like_each_window():
    rnd = np.random.default_rng(8)
    width = 2 * passages.REACH + 1
    kinds = rnd.integers(1, 60_000, (4, width)).astype(np.uint16)
    kinds[1] = kinds[0]
    kinds[1, [10, 100]] = 1
    which = rnd.integers(0, 4, 90)
    frame = pd.DataFrame({"tid": np.arange(90) // 3, "c": 200 * np.arange(90), "around": [kinds[k].tobytes() for k in which]})
    made = pd.concat(passages.forest_links(frame, kinds[which]))
    sets = Sets(range(30))
    for x, y in zip(made["a"], made["b"]):
        sets.join(x, y)
    same, alike = Sets(range(30)), passages.similar(kinds.repeat(4, axis=0), np.tile(kinds, (4, 1)))[0].reshape(4, 4)
    for i in range(90):
        for j in range(i):
            if i // 3 != j // 3 and alike[which[i], which[j]]:
                same.join(i // 3, j // 3)
    assert [sets.find(i) for i in range(30)] == [same.find(i) for i in range(30)]
    # every window is in a row, with its own place
    ends = np.concatenate([made[["a", "a_to"]], made[["b", "b_to"]]])
    assert set(map(tuple, ends)) == set(zip(frame["tid"], frame["c"] + passages.SPAN - 1))


def test_compact_windows_of_one_repeated_word_are_few():
    assert passages.compact_windows(np.zeros(80_000, np.int64)) == [(0, 0, 79_999), (1, 79_999, 79_999)]
    values = np.array([5, 1, 1, 1, 1, 7, 9, 1, 8])
    assert sorted(passages.compact_windows(values, 2)) == [(0, 1, 8), (2, 4, 8), (5, 5, 6), (5, 7, 8)]


def test_compact_windows_cover_every_subsequence_once():
    rnd = np.random.default_rng(1)
    values = rnd.permutation(40)
    found = passages.compact_windows(values, 5)
    for i in range(40):
        for j in range(i + 4, 40):
            c = i + int(values[i : j + 1].argmin())
            assert sum(1 for a, m, b in found if a <= i and j <= b and m == c) == 1


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_neighbours_have_recall(spark, folder):
    got = ann.op9_nearest_neighbours(spark, folder).toPandas()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(table.embedding).astype(np.float64), table.vec_id.to_numpy()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q, part in got.groupby("query_id"):
        score = u @ u[np.searchsorted(ids, q)]
        score[ids == q] = -9
        best = ids[np.lexsort((ids, -score))[:5]]
        hits += len(set(best) & set(part.vec_id))
        total += 5
        assert list(part.sort_values("rank")["rank"]) == [1, 2, 3, 4, 5]
        assert np.allclose(part.score, score[np.searchsorted(ids, part.vec_id)], atol=1e-12)
    assert total == 5 * len(table[table.vec_id % 50 == 0]) and hits / total >= 0.9


def test_odd_vectors_and_ties(spark):
    rows = [
        (0, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.5, 0.5]), (100, None), (150, [0.0, 0.0]),
        (200, [float("nan"), 1.0]), (250, [None, 1.0]), (None, [1.0, 0.0]), (300, [1.0, 2.0, 3.0]), (50, [1.0, 0.0]),
    ]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50)}
    assert by == {0: [7, 50, 4, 3], 50: [0, 7, 4, 3]} and {r.query_id for r in got} == {0, 50}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(10_000_001, "12 34 !!", "en", "src1", 8), (10_000_002, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    extra = ["copies", "n_tokens", "domain", "score", "lang_pred", "_p", "epoch"]
    docs = docs.withColumns({c: F.lit("clash") for c in extra})
    columns = docs.columns
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, FOLDER), f"test-{name}")
        sizes.append(docs.count())
        assert i == 4 or docs.columns == columns
        assert i == 4 or docs.select(*extra).distinct().collect() == [("clash",) * len(extra)]
    assert sizes[1] == sizes[0] - 2 and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[5] == sizes[4]
    assert docs.where("size(ids) <> n_tokens").count() == 0


def brute_nearest(rows, n=5):
    """Nearest by cosine over all rows, ties (to 12 decimals) by id."""
    out = []
    for i, v in rows:
        if i % 50:
            continue
        ranked = sorted((-round(float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), 12), j) for j, w in rows if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(ranked[:n])]
    return out


@pytest.mark.parametrize("kind", ["axes", "scaled", "mixed"])
def test_neighbour_ties_go_to_the_smaller_id(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "axes":
        rows = [(i, np.eye(50)[i]) for i in range(50)]
    elif kind == "scaled":
        base = rng.normal(size=6)
        rows = [(i, base * (1 + i * 0.37)) for i in range(120)]
    else:
        signs = rng.choice([-1.0, 1.0], (160, 5))
        rows = [(i, signs[i]) for i in range(160)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.nearest_neighbours(table).collect())
    assert got == sorted((a, b, c, round(d, 9)) for a, b, c, d in brute_nearest(rows))


def test_rounds_of_components_leave_no_shuffle_files(spark, monkeypatch):
    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    def left(chain):
        spark._jvm.System.gc()
        time.sleep(2)
        before, most = files(), []
        monkeypatch.setattr(common, "written", lambda df, name: (written(df, name), time.sleep(0.3), most.append(files()))[0])
        got = {r.node: r.label for r in components(chain, "test-rounds").collect()}
        assert got == {i: 0 for i in range(200)}
        return max(most) - before

    chain = written(spark.range(199).selectExpr("id AS src", "id + 1 AS dst"), "test-chain")
    freed = left(chain)
    monkeypatch.setattr(common, "free_finished", lambda session: None, raising=False)
    assert freed < left(chain)


def test_texts_are_read_in_pieces_and_blanks_do_not_matter(monkeypatch):
    rng = random.Random(3)
    parts = [rng.choice(["Aa", "bb", "ccc", "é" * 9, "x" * 200]) for _ in range(300)]
    want = passages.sequence(" ".join(parts))
    assert len(want) == 296 and len(set(want.tolist())) == len({tuple(p.lower() for p in parts[i : i + 5]) for i in range(296)})
    assert passages.sequence("\t\n".join(parts).upper().replace("É", "é") + "\r").tolist() == want.tolist()
    monkeypatch.setattr(passages, "PIECE", 7)
    assert passages.sequence(" ".join(parts)).tolist() == want.tolist()
    assert len(passages.sequence(None)) == len(passages.sequence(" a b\nc d ")) == 0


def test_places_of_several_sequences_at_once():
    rng = np.random.default_rng(5)
    sizes, least = [1, 30, 4, 5, 12, 3, 40], 5
    values, parted = rng.integers(0, 20, sum(sizes)), np.repeat(np.arange(len(sizes)), sizes)
    got = np.split(passages.least_somewhere(values, least, parted), np.cumsum(sizes)[:-1])
    for own, part in zip(got, np.split(values, np.cumsum(sizes)[:-1])):
        want = [any(part[s : s + least].min() == v for s in range(max(0, i - least + 1), min(i, len(part) - least) + 1)) for i, v in enumerate(part)]
        assert own.tolist() == want


def test_links_are_counted_without_a_row_for_each_word_of_a_set(spark):
    # 300 texts with one signature each, all of 40 sets of 30 words
    sets = spark.range(40).selectExpr(
        "id AS s", "transform(sequence(0L, 29L), w -> struct(w + id % 3 AS word, shiftleft(1L, cast(id AS int)) AS bits)) AS words"
    )
    linked = spark.range(300 * 40).selectExpr("cast(id / 40 AS long) AS nid", "id % 40 AS s").where("s < 20 + nid % 7")
    got = passages.link_counts(linked, sets).collect()
    want = {n: len({(w + s % 3, s) for s in range(20 + n % 7) for w in range(30)}) - 1 for n in range(300)}
    assert {r.nid: r.n_links for r in got} == want
    calls, explode = [], passages.F.explode
    passages.F.explode = lambda c: calls.append(str(c)) or explode(c)
    try:
        passages.link_counts(linked, sets)
    finally:
        passages.F.explode = explode
    assert not any("words" in c for c in calls)


@pytest.mark.parametrize("text", ["w " * 50, "w " * 50 + "w", "\n" + "w\t" * 50 + "w ", "w", "", " " * 99, "é " * 80, ("w" * 300 + " \r\n") * 51])
def test_long_texts_are_told_by_their_words(spark, text):
    frame = spark.createDataFrame([(text,)], "text string")
    assert frame.select(F.col("text").rlike(passages.LONG)).first()[0] == (len(words(text)) >= passages.MIN_WORDS)
