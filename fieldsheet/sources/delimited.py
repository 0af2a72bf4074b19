"""Delimited text: reading whole texts, finding the delimiter, cutting records and fields.

A field may be quoted; quoted fields may hold delimiters, line breaks and doubled quotes.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import let, na_to_null, strip
from ..plans.skew import join_on_hot_keys
from ..plans.topk import first_per_key
from .delimiters import DELIMITERS, MARK, detect_delimiter
from .records import read_delimited, rebuild_tables  # noqa: F401  part of this module's interface


def _cut_outside_quotes(text: Column, pattern: str) -> Column:
    """The parts of ``text`` between matches of ``pattern`` that stand outside quotes.

    Every second piece between quotes is inside them; a last quote without a partner is an ordinary
    character. No pattern repeats a group, so a text may have any number of quoted fields.
    """
    def cut(pieces):
        def one(p, i):
            inside = (i % 2 == 1) & (i < F.size(pieces) - 1)
            return F.when(inside, p).otherwise(F.regexp_replace(p, pattern, MARK + "1"))
        return F.array_join(F.transform(pieces, one), '"')

    safe = F.replace(text, F.lit(MARK), F.lit(MARK + "0"))
    parts = F.split(let(F.split(safe, '"', -1), cut), MARK + "1", -1)
    return F.transform(parts, lambda p: F.replace(p, F.lit(MARK + "0"), F.lit(MARK)))


def records(text: Column) -> Column:
    """The records of a CSV text, blank lines left out."""
    return F.filter(_cut_outside_quotes(text, r"[\r\n]+"), lambda r: strip(r) != "")


def fields(record: Column, delimiter: str) -> Column:
    """The fields of one record, quotes removed."""
    def unquoted(f):
        inner = F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
        return F.when(f.startswith('"') & f.endswith('"') & (F.length(f) > 1), inner).otherwise(f)

    return F.transform(_cut_outside_quotes(record, "\\" + delimiter if delimiter == "|" else delimiter), unquoted)


def fields_by(record: Column, delimiter: Column) -> Column:
    """The fields with the delimiter taken from a column; null means a single field."""
    out = F.array(record)
    for d in DELIMITERS:
        out = F.when(delimiter == d, fields(record, d)).otherwise(out)
    return out


def text_lines(files: DataFrame, keys=("file",)) -> DataFrame:
    """(keys, line_no, line) of whole texts in a ``content`` column."""
    return files.select(*keys, F.posexplode(records(F.col("content").cast("string"))).alias("line_no", "line"))


def numbered_rows(df: DataFrame, path: Column, block: Column) -> DataFrame:
    """Add ``file`` and a dense ``row_id`` per file in reading order.

    A file split is read by one task from start to end, so order inside a split is known locally.
    Rows are numbered per split (a bounded piece of a file), and the number of rows of the earlier
    splits of the file is added; no file passes through a single task.
    """
    marked = df.select("*", path.alias("file"), block.alias("_block"), F.monotonically_increasing_id().alias("_seq"))
    local = marked.withColumn("_r", F.row_number().over(W.partitionBy("file", "_block").orderBy("_seq")))
    sizes = marked.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("file", "_block", before.alias("_before"))
    return (local.join(offsets, ["file", "_block"]).withColumn("row_id", F.col("_before") + F.col("_r") - 1)
            .drop("_block", "_seq", "_r", "_n", "_before"))


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """(file, line_no, line) of text files of any size."""
    lines = spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_p"),
                                          F.col("_metadata.file_block_start").alias("_b"))
    return numbered_rows(lines, F.col("_p"), F.col("_b")).select("file", F.col("row_id").alias("line_no"), "line")


def choose_delimiter(lines: DataFrame) -> DataFrame:
    """(file, delimiter): the first candidate that gives several columns and no row longer than the header.

    Null if none does: the file is a single column. All lines are checked.
    """
    filled = lines.filter(strip(F.col("line")) != "").select("file", "line_no", *[
        F.size(fields(F.col("line"), d)).alias(f"n{i}") for i, d in enumerate(DELIMITERS)])
    sizes = filled.groupBy("file").agg(*[x for i in range(len(DELIMITERS)) for x in (
        F.min_by(f"n{i}", "line_no").alias(f"h{i}"), F.max(f"n{i}").alias(f"m{i}"))])
    fits = sizes.select("file", F.explode(F.array(*[F.struct(
        F.lit(d).alias("delimiter"), ((F.col(f"h{i}") > 1) & (F.col(f"m{i}") <= F.col(f"h{i}"))).alias("fits"))
        for i, d in enumerate(DELIMITERS)])).alias("f")).select("file", "f.*")
    best = first_per_key(detect_delimiter(lines).join(fits, ["file", "delimiter"]).filter("fits"), ["file"], ["rank"])
    return sizes.select("file").join(best.select("file", "delimiter"), "file", "left")


def lines_to_cells(lines: DataFrame, delimiters: DataFrame, null_policy: str = "pandas") -> DataFrame:
    """(file, row_id, col_id, value) of delimited lines; row 0 is the header.

    With the ``pandas`` policy the usual missing-value tokens of data rows become null; ``keep``
    leaves every text as it is. ``delimiters`` has one small row per file.
    """
    filled = lines.filter(strip(F.col("line")) != "").select("file", "line_no", "line")
    per_file = filled.groupBy("file").agg(F.min("line_no").alias("_h")).join(delimiters, "file", "left")
    numbered = join_on_hot_keys(filled, per_file, ["file"], "inner", spread=["line_no"])
    cut = numbered.select("file", F.col("line_no").alias("row_id"), "_h", F.posexplode(
        fields_by(F.col("line"), F.col("delimiter"))).alias("col_id", "value"))
    if null_policy == "keep":
        return cut.drop("_h")
    value = F.when(F.col("row_id") == F.col("_h"), F.col("value")).otherwise(na_to_null(F.col("value")))
    return cut.select("file", "row_id", "col_id", value.alias("value"))


def csv_payloads_to_cells(payloads: DataFrame, files: DataFrame, title_length: int | None = None, description_length: int | None = None):
    """CSV texts as cells, a summary per table, and warnings. Titles and descriptions are cut only to given lengths.

    ``payloads``: dataset_id, payload_id, title, csv, description, source_file_id, note. Blank titles,
    blank texts and texts without data rows are skipped with a warning. Empty fields stay empty.
    """
    title, text = strip(F.coalesce("title", F.lit(""))), strip(F.coalesce("csv", F.lit("")))
    read = payloads.select("*", title.alias("_title"), records(text).alias("_records"))
    head = F.size(fields(F.get("_records", F.lit(0)), ","))
    longest = F.array_max(F.transform("_records", lambda r: F.size(fields(r, ","))))
    # fixed values: the texts of warnings
    problem = (F.when(F.col("_title") == "", "title is required.").when(text == "", "csv content is empty.")
               .when(longest > head, "failed to parse CSV.").when(F.size("_records") < 2, "parsed CSV has no rows."))
    read = read.withColumn("_problem", problem)
    skipped = read.filter("_problem IS NOT NULL").select(
        "dataset_id", "payload_id", F.concat(F.lit("skipped: "), "_problem").alias("warning"))
    good = read.filter("_problem IS NULL")

    own = files.select("dataset_id", F.col("file_id").alias("source_file_id"), F.col("path").alias("_path"))
    linked = good.join(own, ["dataset_id", "source_file_id"], "left")
    strangers = linked.filter("source_file_id IS NOT NULL AND _path IS NULL").select(
        "dataset_id", "payload_id", F.concat(F.lit("source_file_id="), F.col("source_file_id").cast("string"),
                                             F.lit(" does not belong to this dataset and was ignored.")).alias("warning"))
    source = F.concat(F.lit("source_file_id="), F.col("source_file_id").cast("string"), F.lit(" ("), "_path", F.lit(")"))
    bits = F.concat_ws(" | ", F.nullif(strip(F.col("note")), F.lit("")), F.when(F.col("_path").isNotNull(), source))
    described = F.btrim(F.concat_ws(" | ", strip(F.coalesce("description", F.lit(""))), F.nullif(bits, F.lit(""))), F.lit(" |"))

    def cut(c, most):
        return F.col(c) if most is None and isinstance(c, str) else c if most is None else F.left(c, F.lit(most))

    summary = linked.select(
        "dataset_id", F.col("payload_id").alias("table_id"), cut("_title", title_length).alias("title"),
        cut(described, description_length).alias("description"), (F.size("_records") - 1).cast("bigint").alias("row_count"),
        head.cast("bigint").alias("column_count"))
    cells = (good.select("dataset_id", F.col("payload_id").alias("table_id"), F.posexplode("_records").alias("row_id", "_r"))
             .select("dataset_id", "table_id", "row_id", F.posexplode(fields(F.col("_r"), ",")).alias("col_id", "value")))
    return cells, summary, skipped.unionByName(strangers)
