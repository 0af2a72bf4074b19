"""A training-data pipeline: language, exact and near copies, secrets, packing."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldsheet.llm import exact, jaccard, language, packing, secrets
from fieldsheet.llm.common import digest
from fieldsheet.plans.scratch import materialize

NEAR = jaccard.Threshold(words=5, percent=80)
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, as ``op6_language_id`` judges it.

    Only texts that it calls ``und`` go: those without a letter, and every text where no document is
    labelled. No score is asked for: short texts of a known language score as low as noise does.
    """
    profiles = language.learn(docs)
    rows = docs.select(F.struct("*").alias("row"), language.guess(F.col("text"), profiles).alias("guess"))
    return rows.filter(F.col("guess.lang_pred") != language.UNKNOWN).select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest doc_id, and one row of it."""
    judged = exact.deduplicate(docs, exact.create_index(spark)).filter("kept")
    kept = judged.select(F.struct("doc_id").alias("id"), F.unhex("text_sha256").alias("sha"))
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("id"), digest(F.col("text")).alias("sha"))
    return rows.join(kept.hint("merge"), ["id", "sha"], "left_semi").dropDuplicates(["id", "sha"]).select("row.*")


def _row_keys(docs: DataFrame) -> tuple[DataFrame, int]:
    """(id, sha, key) with a number of its own for every id and text of ``docs``, and the seed of these numbers."""
    pairs = materialize(docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("id"), digest(F.col("text")).alias("sha")).distinct(), "pairs")
    seed = 0
    while True:  # again only if two pairs share a hash
        keys = pairs.withColumn("key", _row_key(F.col("id"), F.col("sha"), seed))
        if keys.groupBy("key").count().filter("count > 1").isEmpty():
            return keys, seed
        seed += 1


def _row_key(id, sha, seed):
    return F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), id, sha), F.lit(1))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8 or more): the one with the smallest doc_id.

    Rows are judged by id and text, so texts that share a doc_id (or have none) are documents of their
    own; of equal ids the text with the smallest digest stays. Rows equal in both are one. Documents
    without words have no copies and stay.
    """
    keys, seed = _row_keys(docs)
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("id"), digest(F.col("text")).alias("sha"))
    found = jaccard.jaccard_components(docs.select(_row_key(F.struct(F.col("doc_id").cast("long").alias("doc_id")), digest(F.col("text")), seed).alias("doc_id"), "text"), NEAR)
    found = found.select(F.col("doc_id").alias("key"), "component_id").distinct()
    kept = keys.join(found, "key").groupBy("component_id").agg(F.min(F.struct("id", "sha")).alias("m")).select("m.id", "m.sha")
    return rows.join(kept.hint("merge"), ["id", "sha"], "left_semi").dropDuplicates(["id", "sha"]).select("row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whose text no secret is found."""
    found = secrets.scan(docs, "doc_id", secrets.new_ledger(spark)).filter(F.size("spans") > 0).select("blob").distinct()
    rows = docs.select(F.struct("*").alias("row"), digest(F.col("text")).alias("blob"))
    return rows.join(found.hint("merge"), "blob", "left_anti").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the words of every document go in training sequences."""
    return packing.pack(docs, packing.word_count(F.col("text")))


STAGES = [("language", known_language), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("secrets", without_secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what each returns is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
