"""Exact deduplication: two-pass Bloom filtering, built-in functions only.

Pass one writes the hash of every text and sets, in a blocked Bloom filter, the
bits that two or more rows hit. Pass two tests every row: a row of which some
bit was hit once only has no copy and passes straight through; only the rest is
shuffled, grouped by the full hash, and judged exactly. A false positive of the
filter costs a shuffled row, never a wrong result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm.common import BLANKS, attach, null_last, small, table
from fleetpulse.session import written

BLOCK_BITS = 4096
HASHES = 3
#: Bits a row: about one unique row in 200 is then sent to the exact test in vain.
BITS_PER_ROW = 16


def text_hash(text: Column | str) -> Column:
    """SHA-256 of the text without white space; a null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, ""), 256)


def _places(blocks: int) -> tuple[Column, Column]:
    """Block of a hash and its bits within the block."""
    h = F.xxhash64(F.lit(1), F.col("sha"))
    bits = [F.shiftrightunsigned(h, 12 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(HASHES)]
    return F.pmod(F.xxhash64("sha"), F.lit(blocks)), F.array(*bits)


def repeat_filter(hashes: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of bits hit by two rows or more: (block, words), and the number of blocks.

    Bits are counted with map-side combining, so one hash on a third of the rows
    costs a few partial rows. The filter has BITS_PER_ROW bits for every row.
    """
    blocks = max(1, math.ceil(hashes.count() * BITS_PER_ROW / BLOCK_BITS))
    block, bits = _places(blocks)
    hit = hashes.select(block.alias("block"), F.explode(F.array_distinct(bits)).alias("bit")).groupBy("block", "bit").count()
    words = (
        hit.where("count > 1")
        .groupBy("block", F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits"))
        .groupBy("block")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("at"))
        .select("block", F.expr(f"transform(sequence(0, {BLOCK_BITS // 64 - 1}), w -> coalesce(at[w], 0L))").alias("words"))
    )
    return written(words, name), blocks


def possibly_repeated(rows: DataFrame, repeats: DataFrame, blocks: int) -> DataFrame:
    """``rows`` (with ``sha``) and a boolean ``maybe``: all bits of the hash were hit twice.

    The filter is sent to all executors within the broadcast bound; beyond it the
    rows meet their block in a shuffled join.
    """
    block, bits = _places(blocks)
    sized = small(repeats, blocks * (BLOCK_BITS // 8 + 96))
    tested = F.expr("coalesce(forall(bits, b -> getbit(words[shiftright(b, 6)], b & 63) = 1), false)")
    return (
        rows.withColumns({"block": block, "bits": bits}).join(sized, "block", "left").withColumn("maybe", tested).drop("block", "bits", "words")
    )


def _hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        F.col(key).alias("key"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"),
        text_hash(text).alias("sha"),
        F.monotonically_increasing_id().alias("row"),
    )


def _facts(repeated: DataFrame) -> DataFrame:
    """Per hash its rows and the row that stays; equal rows are combined first."""
    alike = repeated.groupBy("sha", "n", "key").agg(F.count("*").alias("ties"), F.min("row").alias("row"))
    best = F.min(F.struct((-F.col("n")).alias("short"), *null_last("key"), "row", "ties"))
    return alike.groupBy("sha").agg(F.sum("ties").alias("size"), best.alias("best"))


def mark_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal without white space (null: empty). The longest original text
    stays, then the smallest key; null keys come last. Of rows that agree in text
    length and key as well, one stays. An empty table gives an empty result;
    other columns are not read.
    """
    slim = written(_hashed(docs, key, text), "exact-hashes")
    repeats, blocks = repeat_filter(slim.select("sha"), "exact-filter")
    tested = written(possibly_repeated(slim, repeats, blocks), "exact-tested")
    facts = written(_facts(tested.where("maybe")), "exact-groups")
    judged = attach(tested.where("maybe"), facts, "sha", "size", ["row"])
    single = tested.where("NOT maybe")
    return judged.select(
        F.col("key").alias(key),
        F.col("best.value").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    ).unionByName(
        single.select(
            F.col("key").alias(key),
            F.col("key").alias("keep_id"),
            F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without repeated texts, all columns kept; the rules of ``mark_duplicates``.

    Rows without a possible copy are not shuffled. Rows that agree in text, text
    length and key but not in other columns are copies too: any one of them stays.
    """
    slim = written(_hashed(docs, key, text).drop("row"), "exact-hashes")
    repeats, blocks = repeat_filter(slim.select("sha"), "exact-filter")
    maybe = possibly_repeated(slim, repeats, blocks).where("maybe").withColumn("row", F.lit(0).cast("long"))
    facts = written(_facts(maybe), "exact-groups")
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"),
        F.col(key).alias("key"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"),
        text_hash(text).alias("sha"),
    )
    tested = possibly_repeated(whole, repeats, blocks)
    winners = attach(tested.where("maybe"), facts, "sha", "size", ["key", "n"]).where("-n = best.short AND key <=> best.value")
    kept = winners.where("best.ties = 1").select("whole").unionByName(tested.where("NOT maybe").select("whole"))
    if not facts.where("best.ties > 1").isEmpty():
        kept = kept.unionByName(winners.where("best.ties > 1").groupBy("sha").agg(F.first("whole").alias("whole")).select("whole"))
    return kept.select("whole.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays for it."""
    return mark_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents
), r AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
