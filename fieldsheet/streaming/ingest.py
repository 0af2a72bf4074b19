"""New files in a folder become rows once."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None, **options) -> DataFrame:
    """Stream of the rows of new files, with the file and its arrival time."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).withColumns({"source_file": F.col("_metadata.file_path"), "arrived_at": F.col("_metadata.file_modification_time")})


def stream_ingest_files(spark: SparkSession, path: str, schema, target: str, checkpoint: str, fmt: str = "parquet",
                        files_per_batch: int | None = None, **options):
    """Append all files that have arrived since the last run to the table at ``target``; each file once.

    The checkpoint remembers the files seen, and the file sink commits a batch only as a whole, so a
    repeated or interrupted run adds nothing twice.
    """
    rows = file_stream(spark, path, schema, fmt, files_per_batch, **options)
    query = (rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(target)
