"""Uploaded files: kinds, source mode, fingerprints, and datasets that cannot be used."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.topk import first_per_key

# File suffixes by kind.
TABULAR = ["csv", "tsv", "txt", "xlsx", "xls", "xlsm", "xlsb", "ods"]
TREE = ["newick", "nwk", "nex", "nexus", "tre", "tree"]


def list_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Files below a path; the content is read only on request."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files if content else files.drop("content")


def classify_files(files: DataFrame) -> DataFrame:
    """Add ``file_type`` from the suffix: tree, tabular, pdf or unknown."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = (F.when(suffix.isin(TREE), "tree").when(suffix.isin(TABULAR), "tabular")
            .when(suffix == "pdf", "pdf").otherwise("unknown"))
    return files.withColumn("file_type", kind)


def _kinds(files: DataFrame) -> DataFrame:
    kinds = classify_files(files.select("dataset_id", "path"))
    return kinds.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_files"), *[F.bool_or(F.col("file_type") == k).alias(k) for k in ("tabular", "pdf", "tree")])


def source_mode(files: DataFrame) -> DataFrame:
    """(dataset_id, source_mode): hybrid, pdf_only or tabular_only."""
    return _kinds(files).select("dataset_id", F.when(F.col("tabular") & F.col("pdf"), "hybrid")
                                .when(F.col("pdf"), "pdf_only").otherwise("tabular_only").alias("source_mode"))


def has_tree(files: DataFrame) -> DataFrame:
    return _kinds(files).select("dataset_id", F.col("tree").alias("has_tree"))


def reject_datasets(datasets: DataFrame, files: DataFrame, tables: DataFrame) -> DataFrame:
    """Datasets with the reason they cannot be used, null if they can."""
    loaded = tables.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_tables"))
    joined = datasets.join(_kinds(files), "dataset_id", "left").join(loaded, "dataset_id", "left")
    reason = (F.when(F.col("n_files").isNull(), "no files")
              .when(~F.col("tabular") & ~F.col("pdf"), "no tabular or pdf file")
              .when(~F.col("pdf") & F.col("n_tables").isNull(), "no table could be loaded"))
    return joined.select(*datasets.columns, reason.alias("reason"))


def fingerprint_files(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``sha256`` of the content and the ``cached_id`` of an equal content seen before.

    ``cache`` is (sha256, cached_id, created_at); the oldest entry of a hash is used.
    """
    known = first_per_key(cache, ["sha256"], ["created_at", "cached_id"]).select("sha256", "cached_id")
    hashed = files.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).drop("content")
    return hashed.join(known, "sha256", "left")


def unique_contents(files: DataFrame) -> DataFrame:
    """One file per distinct content: the first uploaded."""
    hashed = files.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).drop("content")
    return first_per_key(hashed, ["sha256"], ["uploaded_at", "file_id"])


def backfill_files(datasets: DataFrame) -> DataFrame:
    """One file row per dataset that kept its only file in the dataset itself."""
    return (datasets.filter(F.coalesce("file_path", F.lit("")) != "")
            .select("dataset_id", F.col("file_path").alias("path"), F.col("created_at").alias("uploaded_at")))


def first_file_per_dataset(files: DataFrame) -> DataFrame:
    """The reverse: the first file of every dataset."""
    return first_per_key(files.select("dataset_id", "uploaded_at", "file_id", "path"), ["dataset_id"],
                         ["uploaded_at", "file_id"]).select("dataset_id", F.col("path").alias("file_path"))
