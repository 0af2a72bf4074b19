"""Records of delimited text, against the parser of the standard library."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from fieldsheet.sources import delimited, records


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of a few bytes, so that quoted fields cross several."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "24")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _parsed(text, delimiter):
    """Rows as the standard library reads them, without blank lines."""
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    return [r for r in rows if not (len(r) == 0 or len(r) == 1 and not r[0].strip() and "\n" not in r[0])]


def _cells(df):
    rows = {}
    for r in df.collect():
        rows.setdefault(r["row_id"], {})[r["col_id"]] = r["value"]
    return [[row[i] for i in range(len(row))] for _, row in sorted(rows.items())]


def test_any_text_by_any_cut(spark):
    rng = random.Random(4)
    texts = {}
    while len(texts) < 120:
        text = "".join(rng.choice(['"', '""', ",", "\n", "\n", "a", "b c", '"x', 'y"', ',"', '",', "\r\n"]) for _ in range(rng.randint(1, 40)))
        try:
            want = _parsed(text, ",")
        except csv.Error:
            continue
        if want and '"' in text and _closed(text):
            texts[len(texts)] = (text, want)
    for chunk in (1, 3, 65536):
        lines = spark.createDataFrame([(str(i), k // chunk, k, x) for i, (t, _) in texts.items() for k, x in enumerate(t.split("\n"))], "file string, split long, seq long, line string")
        cut = records.cut_records(lines.withColumn("delimiter", F.lit(",")))
        got = {}
        for r in cut.select("file", "record_no", records.record_fields(F.col("record"), F.lit(",")).alias("f")).collect():
            got.setdefault(int(r["file"]), {})[r["record_no"]] = list(r["f"])
        for i, (text, want) in texts.items():
            have = [got.get(i, {})[k] for k in sorted(got.get(i, {}))]
            assert [[v.replace("\r\n", "\n") for v in r] for r in have] == [[v.replace("\r\n", "\n") for v in r] for r in want], text


def _closed(text):
    """Whether the text ends outside quotes: a last line added to it is a record of its own."""
    return _parsed(text + "\nEND,END", ",")[-1] == ["END", "END"]


def test_line_breaks_across_splits_of_a_file(spark, tmp_path, small_splits):
    rng = random.Random(6)
    rows = [["id", "the\nname", "v"]] + [[str(i), "\n".join("x" * rng.randint(0, 30) for _ in range(rng.randint(1, 6))) + '"q"', rng.choice(["", "NA", "y;z"])] for i in range(60)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows(rows)
    (tmp_path / "t.csv").write_text("﻿" + out.getvalue())
    t = records.read_delimited(spark, str(tmp_path / "t.csv"), null_policy="keep")
    assert records.file_lines(spark, str(tmp_path / "t.csv")).select("split").distinct().count() > 20 and t.columns[:3] == ["id", "the\nname", "v"]
    assert [list(r) for r in t.orderBy("row_id").select(*[f"`{c}`" for c in t.columns[:3]]).collect()] == rows[1:]
    assert _cells(records.read_tables(spark, str(tmp_path / "t.csv"), "keep")) == rows


def test_a_surplus_field_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n2,b,surplus\n3\n")
    with pytest.raises(Exception, match="more fields than the header"):
        records.read_delimited(spark, str(tmp_path / "a.csv")).collect()
    assert records.read_delimited(spark, str(tmp_path / "a.csv"), delimiter=";").count() == 3
    (tmp_path / "b.csv").write_text("a,b\n1\n")
    assert [tuple(r)[:2] for r in records.read_delimited(spark, str(tmp_path / "b.csv")).collect()] == [("1", None)]


def test_a_surplus_field_rejects_the_delimiter(spark):
    texts = [("f", "a,b;c\n1,2;3\n4,5,6;7\n"), ("g", 'a\tb\n"1\n\t2"\t3\n'), ("h", "one\ntwo\n"), ("i", 'a,b\n"never closed,2\n'), ("j", ""), ("k", None)]
    lines = records.content_lines(spark.createDataFrame(texts, "file string, content string"))
    assert sorted((r["file"], r["delimiter"]) for r in records.choose_delimiter_by_records(lines).collect()) == [("f", ";"), ("g", "\t"), ("h", None), ("i", None), ("j", None)]
    with pytest.raises(Exception, match="never closed"):
        records.table_cells(lines, records.choose_delimiter_by_records(lines)).collect()


def test_another_header_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n")
    (tmp_path / "b.csv").write_text("a,c\n1,x\n")
    with pytest.raises(Exception, match="another header"):
        delimited.read_delimited(spark, str(tmp_path)).collect()
