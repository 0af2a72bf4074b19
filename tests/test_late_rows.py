"""Rows behind the watermark are counted apart: stream and late rows together are the batch."""

import time

from pyspark.sql import functions as F

from fieldsheet.operators import rules
from fieldsheet.streaming import ingest, validate

SCHEMA = "dataset_id long, table_id long, row_id long, decimalLatitude string, seen_at timestamp"
DAYS = ["2024-01-01", "2024-01-10", "2024-01-11", "2024-01-01", "2024-01-10 12:00:00", None]  # the fourth comes ten days late, the last has no time


def _arrive(spark, source, days, start=0):
    for i, day in enumerate(days, start):
        df = spark.createDataFrame([(1, 1, i, "95")], "dataset_id long, table_id long, row_id long, decimalLatitude string")
        df.withColumn("seen_at", F.lit(day).cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)  # files are taken in the order of their times


def _rows(df):
    return sorted(((r.day and r.day.strftime("%m-%d"), r.rule, r.bad_rows, r.late_rows) for r in df.collect()), key=repr)


def test_stream_and_late_rows_are_the_batch(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    _arrive(spark, source, DAYS)

    def run():
        stream = ingest.file_stream(spark, source, SCHEMA, files_per_batch=1)
        return _rows(validate.validate_with_late(stream, "seen_at", "1 day", target, check))

    first = run()
    assert first == sorted([("01-01", "decimalLatitude", 1, 1), ("01-10", "decimalLatitude", 2, 0), ("01-11", "decimalLatitude", 1, 0), (None, "decimalLatitude", 0, 1)], key=repr)
    assert run() == first  # nothing new has arrived
    _arrive(spark, source, ["2024-01-02", "2024-02-01"], len(DAYS))
    again = run()
    assert ("01-02", "decimalLatitude", 0, 1) in again and ("02-01", "decimalLatitude", 1, 0) in again
    batch = spark.read.schema(SCHEMA).parquet(source)
    assert sum(r[2] + r[3] for r in again) == rules.row_flags(batch, rules.row_rules(batch.columns)).count()
