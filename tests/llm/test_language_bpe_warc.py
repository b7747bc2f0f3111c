import io
import random
import struct
import weakref
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.llm import bpe, langid, warc

FOLDER = "/root/testdata/sf0.01"


def test_kernel_is_the_shared_ngram_count():
    texts = ["Ab cab", "cab!", "xyz", "Ünï cödé " * 3]
    flags = np.zeros((4, langid.WIDTH), np.uint8)
    for t, row in zip(texts, flags):
        assert langid.presence(t, row)
    kernel = langid.scaled(flags) @ langid.scaled(flags).T
    assert np.allclose(np.diag(kernel), 1, atol=1e-5)
    assert kernel[0, 1] > 0.3 > kernel[0, 2]


def test_long_texts_pass_in_pieces(monkeypatch):
    text = "".join(random.Random(1).choice("abcdef ,") for _ in range(5000))
    whole, parts = np.zeros(langid.WIDTH, np.uint8), np.zeros(langid.WIDTH, np.uint8)
    langid.presence(text, whole)
    for piece in (1, 2, 7, 100):
        monkeypatch.setattr(langid, "PIECE", piece)
        langid.presence(text, parts)
        assert (whole == parts).all()


def test_held_out_accuracy_and_rules(spark):
    out = langid.op4_language_id(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id")
    r = out.where("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()
    assert r.n > 250 and r.a > 0.98
    assert out.where("score < 0 OR score > 1").count() == 0
    for row in out.limit(50).collect():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat sat", "en"), (2, "der hund lief", "de"), (4, "the mat", "en"), (9, "die katze", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.withColumn("order", F.xxhash64("doc_id")))
    assert model.languages == ["de", "en"]
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (2, "12 !? \u0000", 3.0), (3, "cat", 4.0)], "doc_id long, text string, score double")
    got = langid.identify(odd, model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en"] and got[0].score == 0.0
    clash = odd.withColumns({"_p": F.lit("p"), "whole": F.lit("w"), "p": F.lit(1), "lang_pred": F.lit("mine")})
    rows = langid.identify(clash.unionByName(clash), model).collect()
    assert len(rows) == 8 and {(r._p, r.whole, r.p) for r in rows} == {("p", "w", 1)} and rows[3].lang_pred == "en"
    nothing = langid.fit(docs.limit(0).withColumn("order", F.xxhash64("doc_id")))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def ids(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def test_encoding_equals_the_library(tokenizer):
    own = bpe.codec(bpe.vocabulary_path())
    rnd = random.Random(5)
    odd = ["abc", "aaa", "<|endoftext|>", "<|startoftext|>x", "'s 'll", "ΑΣ Σ", "İé", "😀👍", "\x1c\x85 ", "1234", "!!??", "漢字ß", "é", "the in"]
    texts = ["", "a" * 3000, "=" * 2000, "<|endoftext|"]
    for _ in range(1500):
        parts = [rnd.choice([rnd.choice(odd), chr(rnd.randrange(32, 0x500)), "a" * rnd.randrange(9), " "]) for _ in range(rnd.randrange(12))]
        texts.append("".join(parts))
    for t in texts:
        want = tokenizer.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert ids(got) == want, t
        assert own.decode(got) == tokenizer.decode(want, skip_special_tokens=False)


def test_query_columns_against_the_library(spark, tokenizer):
    import hashlib

    texts = ["Hello, the World", None, "", "the the " * 30_000, "x" * 500, "Hello, the World", "\u0558 \u088fa é\u0344", "<|endoftext|>a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(
        spark.read.parquet(f"{FOLDER}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    )
    rows = {r.doc_id: r for r in bpe.digests(docs, bpe.vocabulary_path()).collect()}
    for r in docs.collect():
        e = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert rows[r.doc_id].n_tokens == len(e)
        assert rows[r.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest()
        text = tokenizer.decode(e, skip_special_tokens=False).encode()
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256(text).hexdigest()


def test_automaton_accepts_only_bpe_paths():
    vocab = {s: i for i, s in enumerate(["a", "b", "a.", "b.", "aa", "ab", "aab", "ab.", "aaa"])}
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("a", "b."), ("aa", "a")]
    symbols = [chr(i) if 97 <= i < 99 else chr(0x100 + i) for i in range(256)]
    own = bpe.Automaton(vocab, merges, ".", symbols)

    def merged(word):
        parts = [*word[:-1], word[-1] + "."]
        for a, b in merges:
            i = 0
            while i < len(parts) - 1:
                if parts[i] == a and parts[i + 1] == b:
                    parts[i : i + 2] = [a + b]
                i += 1
        return parts

    import itertools

    for n in range(1, 9):
        for word in itertools.product("ab", repeat=n):
            assert [own.labels[i] for i in own.encode("".join(word).encode())] == merged(word)


def test_encode_decode_frames(spark, tokenizer):
    docs = spark.createDataFrame([(1, "Hello World", "k"), (None, None, "k"), (3, "", "k")], "doc_id long, text string, n_tokens string")
    both = bpe.decode(bpe.encode(docs, bpe.vocabulary_path()), bpe.vocabulary_path()).collect()
    assert both[0].ids == tokenizer.encode("Hello World", add_special_tokens=False).ids
    assert both[0].decoded == "hello</w> world</w>" and both[1].ids == [] and both[2].decoded == ""
    assert bpe.digests(docs, bpe.vocabulary_path()).where("n_tokens = 0").count() == 2


def test_reader_follows_pieces_and_checks(monkeypatch):
    import hashlib

    bodies = [b"", b"x" * 200_000, "é\r\n\r\n".encode() * 10]
    data = b"".join(warc.record(i, f"http://a/{i}\n", b, hashlib.sha1(b).hexdigest(), None, False) for i, b in enumerate(bodies))
    for piece in (1 << 16, 997, 13):
        monkeypatch.setattr(warc, "PIECE", piece)
        got = list(warc.read_records(io.BytesIO(data)))
        assert [r["payload"] for r in got] == bodies and [r["payload_bytes"] for r in got] == [len(b) for b in bodies]
    with pytest.raises(warc.ArchiveError):
        list(warc.read_records(io.BytesIO(data[:-20])))
    wrong = warc.record(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), None, False)
    with pytest.raises(warc.ArchiveError):
        list(warc.read_records(io.BytesIO(wrong)))


def test_pages_with_ties_and_nulls(spark):
    big = "p" * 1500
    rows = [(1, "u", big), (2, None, big), (2, "v", big), (None, "w", None), (5, "x", ""), (6, "y", "small"), (7, "z", "small"), (None, "q", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = warc.read_archives(warc.write_archives(warc.share_payloads(pages))).collect()
    assert len(back) == len(rows)
    stored = [r for r in back if r.payload_bytes == 1500 and r.record_type == "response"]
    assert len(stored) == 1 and stored[0].page_id == 2 and bytes(stored[0].payload) == big.encode()
    revisits = [r for r in back if r.record_type == "revisit"]
    assert sorted((r.page_id is None, r.page_id or 0, r.refers_to) for r in revisits) == [(False, 1, 2), (False, 2, 2), (True, 0, 2)]
    assert {r.url for r in back} == {r[1] for r in rows}


def test_a_worker_keeps_the_tables_of_one_operator_only():
    first = bpe.codec(bpe.vocabulary_path())
    assert bpe.codec(bpe.vocabulary_path()) is first
    gone = weakref.ref(first)
    del first
    folded = langid.letters()
    assert gone() is None and langid.letters() is folded


def test_the_driver_gives_back_what_the_fit_took(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(langid, "release_memory", lambda: calls.append(1))
    rows = [("the cat sat on the mat", "en", 1), ("der hund lief weg", "de", 2)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string, order long"))
    assert model.languages == ["de", "en"] and calls
