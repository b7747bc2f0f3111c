"""From documents to token ids: each stage is one operator over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import bpe, exact_dedup, langid, mixing, simhash
from fleetpulse.session import written

#: Texts whose best language has a smaller share of the scores are rejected; four equal shares are 0.25 each.
LEAST_SCORE = 0.3
#: Rows in an Arrow batch: a Python worker holds the texts of one batch at a time.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters or below LEAST_SCORE go, a missing ``lang`` is filled in."""
    small_batches(spark)
    known = langid.predictions(docs, langid.learn_documents(docs))
    kept = known.where((F.col("p.lang") != langid.UNKNOWN) & (F.col("p.score") >= LEAST_SCORE))
    lang = F.coalesce("whole.lang", "p.lang").alias("lang")
    return kept.select(*[lang if c == "lang" else F.col(f"whole.`{c}`") for c in docs.columns])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside."""
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: shingles of five words, similarity 0.8."""
    small_batches(spark)
    return simhash.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the budget of their source uses them, a row for each epoch; the last one of a prefix is kept whole."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    tree = mixing.with_tree(docs.select(row, "doc_id", "text", "lang", "source")).drop("text")
    chosen = mixing.mix(tree).where("copies > 0")
    epochs = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return chosen.select("row", epochs.alias("epoch")).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    small_batches(spark)
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.vocabulary_path()).drop("text")
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: Learned languages, fingerprints and BPE are beyond SQL; tests of the operators hold them against brute force, that of the stages counts rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
