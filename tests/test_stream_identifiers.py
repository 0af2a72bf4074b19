"""Identifiers that repeat in arriving files: the stream counts what a batch run over the same files flags."""

import time

from pyspark.sql import functions as F

from fieldsheet.operators import rules
from fieldsheet.streaming import ingest, validate

SCHEMA = "dataset_id long, table_id long, row_id long, occurrenceID string, catalogNumber string, decimalLatitude string, seen_at timestamp"


def _arrive(spark, source, *files):
    for rows in files:
        df = spark.createDataFrame([(*r[:6], None) for r in rows], SCHEMA).drop("seen_at")
        days = spark.createDataFrame([(r[2], r[6]) for r in rows], "row_id long, day string")
        df.join(days, "row_id").select(*df.columns, F.col("day").cast("timestamp").alias("seen_at")).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)  # files are taken in the order of their times


def _batch(spark, source):
    occ = spark.read.schema(SCHEMA).parquet(source)
    flags = rules.row_flags(occ, rules.row_rules(occ.columns)).unionByName(rules.duplicate_catalog_number(occ)).unionByName(rules.duplicate_occurrence_id(occ))
    joined = flags.join(occ.select("row_id", F.date_trunc("day", "seen_at").alias("day")), "row_id")
    return _rows(joined.groupBy("day", "rule").agg(F.count(F.lit(1)).alias("bad_rows")))


def _rows(df):
    return {(r.day and r.day.strftime("%m-%d"), r.rule): r.bad_rows for r in df.collect()}


def test_stream_with_repeated_identifiers_is_the_batch(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def run():
        stream = ingest.file_stream(spark, source, SCHEMA, files_per_batch=1)
        return _rows(validate.run_validation(stream, "seen_at", "36500 days", target, check))

    _arrive(spark, source, [(1, 1, 1, "a", "x", "95", "2024-01-01"), (1, 1, 2, " ", None, "5", "2024-01-01"), (1, 1, 3, "c", "y", "5", "2024-01-02")],
            [(1, 1, 4, " A ", "X", "5", "2024-01-05"), (1, 1, 5, None, None, "5", "2024-01-05"), (1, 2, 6, "a", "x", "x", "2024-01-05")])
    first = run()
    assert first == _batch(spark, source) == {("01-01", "decimalLatitude"): 1, ("01-05", "decimalLatitude"): 1, ("01-01", "occurrenceID"): 1, ("01-05", "occurrenceID"): 1,
                                              ("01-01", "catalogNumber"): 1, ("01-05", "catalogNumber"): 1}
    assert run() == first  # nothing new has arrived
    _arrive(spark, source, [(1, 1, 7, "C", "q", "5", "2023-12-01"), (None, 1, 8, "n", "n", "5", "2024-02-01"), (None, 1, 9, "n", "n", "5", "2024-02-01")])
    again = run()  # a record of an earlier run shares its identifier now
    assert again == _batch(spark, source) and again[("01-02", "occurrenceID")] == again[("12-01", "occurrenceID")] == 1 and again[("02-01", "catalogNumber")] == 2


def test_rows_without_time_and_tables_of_other_kinds(spark, tmp_path):
    source = str(tmp_path / "in")
    _arrive(spark, source, [(1, 1, 1, "a", "x", "5", None), (1, 1, 2, "a", "y", "5", "2024-01-02")])
    plain = ingest.file_stream(spark, source, SCHEMA)
    assert _rows(validate.run_validation(plain, "seen_at", "1 day", str(tmp_path / "o1"), str(tmp_path / "c1"))) == {(None, "occurrenceID"): 1, ("01-02", "occurrenceID"): 1}
    measured = plain.withColumn("measurementID", F.col("row_id").cast("string"))
    assert _rows(validate.run_validation(measured, "seen_at", "1 day", str(tmp_path / "o2"), str(tmp_path / "c2"))) == {}
    other = plain.drop("occurrenceID", "catalogNumber")
    assert _rows(validate.run_validation(other, "seen_at", "1 day", str(tmp_path / "o3"), str(tmp_path / "c3"))) == {}


def test_registered_query_counts_repeated_identifiers(spark):
    from fieldsheet.queries import load
    got = load().QUERIES["stream_validate"](spark, "/root/testdata/sf0.001")
    assert {r["rule"] for r in got.select("rule").distinct().collect()} >= {"catalogNumber", "occurrenceID", "eventDate"}
