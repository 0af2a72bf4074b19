"""Exact deduplication against a persistent index of digests."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.scratch import materialize
from .common import digest, join_unique

BUCKETS = 64


def create_index(spark: SparkSession, table: str | None = None, buckets: int = BUCKETS, location: str | None = None) -> str:
    """An index table (or the one that is there), bucketed and sorted by digest; returns its name.

    A row is a text that was seen: its digest, the document that stays for it, and how many rows of
    the batch that brought it had it. Give ``location`` to open an index of an earlier session.
    """
    table = table or f"digest_index_{uuid.uuid4().hex}"
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id BIGINT, keep_row BIGINT, group_size BIGINT) USING parquet "
              f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS{place}")
    return table


def deduplicate(batch: DataFrame, index: str, buckets: int = BUCKETS) -> DataFrame:
    """Add a batch of documents (doc_id, text) to ``index`` and say of each row whether it stays.

    Texts are equal when their bytes are; null counts as empty. Of equal texts in a batch the row
    with the largest doc_id stays (null is the smallest; of rows that repeat a doc_id and a text any
    one), unless an earlier batch had the text: then none stays and ``keep_id`` is the earlier one.
    The batch is reduced to one row per digest, anti-joined with the index by sort-merge, and the
    rest is appended. Returns doc_id, keep_id, group_size (of the batch that brought the text),
    kept, text_sha256. An empty batch gives no rows; columns other than doc_id and text are not read.
    """
    spark = batch.sparkSession
    rows = materialize(batch.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"),
                                    F.monotonically_increasing_id().alias("row")), "digests")
    groups = (rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("m"), F.count(F.lit(1)).alias("n"))
              .select("digest", F.col("m.doc_id").alias("keep_id"), F.col("m.row").alias("keep_row"), F.col("n").alias("group_size")))
    groups = materialize(groups, "groups")
    fresh = groups.join(spark.table(index).select("digest").hint("merge"), "digest", "left_anti")
    fresh = materialize(fresh, "fresh")
    (fresh.repartition(buckets, "digest").sortWithinPartitions("digest")
     .select("digest", "keep_id", "keep_row", "group_size").write.insertInto(index))
    is_new = fresh.select("digest", F.lit(True).alias("is_new"))
    known = (spark.table(index).join(groups.select("digest", F.col("group_size").alias("rows")), "digest")
             .join(is_new, "digest", "left"))
    joined = join_unique(rows, known, "digest", "rows")
    return joined.select("doc_id", "keep_id", "group_size",
                         (F.coalesce("is_new", F.lit(False)) & (F.col("row") == F.col("keep_row"))).alias("kept"),
                         F.lower(F.hex("digest")).alias("text_sha256"), F.col("row").alias("batch_row"))
