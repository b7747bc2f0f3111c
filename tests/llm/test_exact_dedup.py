import hashlib

import pytest

from fleetpulse.llm import exact_dedup
from fleetpulse.llm.exact_dedup import deduplicate, mark_duplicates, possibly_repeated, repeat_filter, text_hash

SCHEMA = "doc_id long, text string, kept string, sha long"


def brute(rows):
    groups = {}
    for i, (key, text, *_) in enumerate(rows):
        plain = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(plain, []).append((-len(text or ""), key is None, key or 0, i))
    out = {}
    for plain, members in groups.items():
        best = min(members)
        for m in members:
            out[m[3]] = (rows[best[3]][0], len(members), m[3] == best[3], hashlib.sha256(plain.encode()).hexdigest())
    return out


ROWS = [
    (1, "a b c", "x", 1),
    (2, "abc", "x", 2),
    (3, "a  b\tc\n", None, 3),
    (4, None, "y", 4),
    (5, "", "y", 5),
    (6, " \x0b\x0c\r", "y", 6),
    (None, "abc", "z", 7),
    (8, "a\u00a0bc", "z", 8),
    (9, "ü" * 30000, "z", 9),
    (10, "ü " * 30000, "z", 10),
    (11, "same", "p", 11),
    (11, "same", "p", 11),
    (12, "alone", "q", 12),
    (None, "nobody", "q", 13),
]


def test_marks_equal_brute_force(spark):
    rows = ROWS + [(100 + i, f"copy {i % 7}", "c", i) for i in range(300)] + [(1000 + i, f"single {i}", "s", i) for i in range(300)]
    got = mark_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted(((rows[i][0], *v) for i, v in brute(rows).items()), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_rows_kept_with_all_columns(spark):
    kept = deduplicate(spark.createDataFrame(ROWS, SCHEMA))
    assert kept.columns == ["doc_id", "text", "kept", "sha"]
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([ROWS[i] for i in (2, 5, 7, 9, 10, 12, 13)], key=str)


@pytest.mark.parametrize("function", [mark_duplicates, deduplicate])
def test_empty_table(spark, function):
    assert function(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    texts = [(f"t{i}",) for i in range(4000)] + [(f"t{i}",) for i in range(0, 4000, 40)]
    hashes = spark.createDataFrame(texts, "text string").select(text_hash("text").alias("sha"))
    repeats, blocks = repeat_filter(hashes, "test")
    flagged = possibly_repeated(hashes, repeats, blocks).where("maybe").count()
    assert 200 <= flagged <= 300


def test_hot_group_is_salted(spark):
    rows = [(i, "hot", "c", i) for i in range(2000)] + [(5000 + i, f"d{i}", "c", i) for i in range(1000)]
    marked = mark_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert marked.where("group_size = 2000 AND keep_id = 0").count() == 2000
    assert marked.where("kept").count() == 1001


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.op1_exact_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
