"""Records of delimited text of any size, with line breaks in quoted fields.

Whether a line starts inside a quoted field depends on all text before it. Every line, and every
split of a file, is a function from that state to the state behind it: it fixes the state, keeps it or
turns it around. Lines are put together within their split, splits by a scan over one small row a
split, and then every split cuts its own records; no task reads a whole file.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import na_to_null, strip
from ..plans.topk import first_per_key
from .delimiters import DELIMITERS, MARK, detect_delimiter

CHUNK = 65536  # lines of a text value that count as one split
NONE = "\x1f"  # stands for the delimiter of a file of a single column


def file_lines(spark: SparkSession, paths) -> DataFrame:
    """(file, split, seq, line) of text files; a line ends at a line feed, whether or not in quotes."""
    rows = spark.read.option("lineSep", "\n").text(paths)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                       F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


def content_lines(files: DataFrame) -> DataFrame:
    """(file, split, seq, line) of texts held as values (file, content); long ones are dealt out by chunks of lines."""
    rows = files.select("file", F.posexplode(F.split(F.col("content").cast("string"), "\n", -1)).alias("seq", "line"))
    return rows.select("file", F.floor(F.col("seq") / CHUNK).cast("long").alias("split"), F.col("seq").cast("long").alias("seq"), "line")


def _ends_inside(line: Column, delimiter: Column, inside: int) -> Column:
    """1 if a quoted field is open behind the line, which starts inside a quoted field or at a record's start.

    A quote opens a field only at its start; inside, a doubled quote is a character; elsewhere a quote is a
    character. States: 0 nothing read, 1 inside, 2 in a plain field, 3 just closed.
    """
    def step(state, piece):  # the piece before a quote, and the quote
        opens = piece.endswith(delimiter) | ((state == 0) & (piece == ""))
        return F.when(state == 1, 3).when((state == 3) & (piece == ""), 1).when(opens, 1).otherwise(2)

    pieces = F.split(line, '"', -1)
    end = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.lit(inside), step)
    return F.when(F.contains(line, F.lit('"')), (end == 1).cast("int")).otherwise(inside)


def _states(rows: DataFrame, keys, order: str) -> DataFrame:
    """Add ``_at``, the state before each row of a group entered outside, and ``_fixed``: whether the entry does not matter.

    ``_out`` and ``_in`` are the states behind a row that is entered outside and inside.
    """
    group = W.partitionBy(*keys).orderBy(order)
    before, upto = group.rowsBetween(W.unboundedPreceding, -1), group.rowsBetween(W.unboundedPreceding, 0)
    turns = ((F.col("_out") == 1) & (F.col("_in") == 0)).cast("long")
    rows = rows.withColumn("_turns", F.sum(turns).over(upto))
    fixes = F.when(F.col("_out") == F.col("_in"), F.struct(F.col("_out").alias("to"), F.col("_turns").alias("turns")))
    rows = rows.withColumns({"_last": F.last(fixes, True).over(before), "_turned": F.coalesce(F.lag("_turns").over(group), F.lit(0))})
    at = F.when(F.col("_last").isNull(), F.col("_turned")).otherwise(F.col("_last.to") + F.col("_turned") - F.col("_last.turns")) % 2
    return rows.withColumns({"_at": at.cast("int"), "_fixed": F.col("_last").isNotNull()}).drop("_turns", "_last", "_turned")


def cut_records(lines: DataFrame, keys=("file",), refuse: bool = True) -> DataFrame:
    """(keys, delimiter, record_no, record) of lines (keys, split, seq, line, delimiter).

    Lines between records that hold one blank field, quoted or not, are left out; records are numbered from 0. Line breaks in quoted fields
    stay. A text whose last quote is never closed is refused when it is read; with ``refuse`` off it
    gives no records, so that a delimiter can be tried.
    """
    keys = list(keys)
    bare = F.regexp_replace("line", r'^"([^"]*)"(\s*)$', "$1$2")
    blank = (strip(bare) == "") & ~F.contains("line", "delimiter")
    rows = lines.withColumns({"_out": _ends_inside(F.col("line"), F.col("delimiter"), 0), "_in": _ends_inside(F.col("line"), F.col("delimiter"), 1)})
    rows = _states(rows, [*keys, "split"], "seq").withColumn("_blank", blank)
    other = F.when(F.col("_fixed"), F.col("_at")).otherwise(1 - F.col("_at"))  # if the split is entered inside
    starts = [((at == 0) & ~F.col("_blank")).cast("long") for at in (F.col("_at"), other)]
    behind = [F.when(at == 0, F.col("_out")).otherwise(F.col("_in")) for at in (F.col("_at"), other)]
    upto = W.partitionBy(*keys, "split").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"_n0": F.sum(starts[0]).over(upto), "_n1": F.sum(starts[1]).over(upto)})
    splits = rows.groupBy(*keys, "split").agg(F.max_by(behind[0], "seq").alias("_out"), F.max_by(behind[1], "seq").alias("_in"), F.max("_n0").alias("_m0"), F.max("_n1").alias("_m1"))
    text = W.partitionBy(*keys).orderBy("split")
    splits = _states(splits, keys, "split").withColumn("_m", F.when(F.col("_at") == 0, F.col("_m0")).otherwise(F.col("_m1")))
    splits = splits.select(*keys, "split", F.col("_at").alias("_entry"),
                           F.coalesce(F.sum("_m").over(text.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                           F.last(F.when(F.col("_at") == 0, F.col("_out")).otherwise(F.col("_in"))).over(text.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_open"))
    placed = rows.drop("_out", "_in").join(splits, [*keys, "split"])
    unclosed = F.col("_open") == 1
    if refuse:
        placed = placed.filter(F.when(unclosed, F.raise_error(F.concat(F.lit("a quote is never closed: "), F.col(keys[0]).cast("string"))).cast("boolean")).otherwise(True))
    else:
        placed = placed.filter(~unclosed)
    inside = F.when((F.col("_entry") == 1) & ~F.col("_fixed"), 1 - F.col("_at")).otherwise(F.col("_at"))
    number = F.col("_before") + F.when(F.col("_entry") == 0, F.col("_n0")).otherwise(F.col("_n1")) - 1
    kept = placed.withColumns({"_inside": inside, "record_no": number}).filter((F.col("_inside") == 1) | ~F.col("_blank"))
    parts = F.sort_array(F.collect_list(F.struct("split", "seq", "line")))  # the lines of one record
    record = F.array_join(F.transform(parts, lambda p: p["line"]), "\n")
    out = kept.groupBy(*dict.fromkeys([*keys, "delimiter"]), "record_no").agg(record.alias("record"))
    plain = F.when(F.col("record_no") == 0, F.ltrim("record", F.lit("﻿"))).otherwise(F.col("record"))
    return out.withColumn("record", F.regexp_replace(plain, r"\r\z", ""))


def record_fields(record: Column, delimiter: Column) -> Column:
    """The fields of a record: quotes around a field go, doubled quotes inside it become one, other quotes stay.

    Where every second quote opens a field, the pieces between quotes say what is inside; else the
    record is read quote by quote.
    """
    safe = F.replace(record, F.lit(MARK), F.lit(MARK + "0"))
    cut = F.lit(MARK + "1")
    pieces = F.split(safe, '"', -1)

    def by_pieces(p):
        last = F.size(p) - 1
        opens = F.transform(p, lambda x, i: (i % 2 == 1) | (i == last) | x.endswith(delimiter) | (x == ""))
        even = (F.size(p) % 2 == 1) & F.forall(opens, lambda ok: ok)

        def plain(x, i):
            doubled = (i >= 3) & (F.get(p, i - 1) == "")
            return F.when(i % 2 == 0, F.replace(x, delimiter, cut)).when(doubled, F.concat(F.lit('"'), x)).otherwise(x)

        def step(acc, x):
            state = acc["state"]
            text = F.concat(acc["text"], F.when(state == 1, x).otherwise(F.replace(x, delimiter, cut)))
            doubled = (state == 3) & (x == "")
            opened = x.endswith(delimiter) | ((state == 0) & (x == ""))
            return F.struct(F.when(state == 1, 3).when(doubled | opened, 1).otherwise(2).alias("state"),
                            F.concat(text, F.when((state == 1) | (opened & ~doubled), F.lit("")).otherwise(F.lit('"'))).alias("text"))

        slow = F.aggregate(F.slice(p, 1, last), F.struct(F.lit(0).alias("state"), F.lit("").alias("text")), step)
        rest = F.element_at(p, -1)
        ended = F.concat(slow["text"], F.when(slow["state"] == 1, rest).otherwise(F.replace(rest, delimiter, cut)))
        return F.when(F.size(p) == 1, F.replace(safe, delimiter, cut)).when(even, F.array_join(F.transform(p, plain), "")).otherwise(ended)

    joined = F.transform(F.array(pieces), by_pieces)[0]
    return F.transform(F.split(joined, MARK + "1", -1), lambda x: F.replace(x, F.lit(MARK + "0"), F.lit(MARK)))


def choose_delimiter_by_records(lines: DataFrame) -> DataFrame:
    """(file, delimiter): the best ranked delimiter that gives several columns and no record with more fields than the header.

    Null if there is none: the file is a single column. Every record of every file is checked under every delimiter.
    """
    tried = lines.withColumn("delimiter", F.explode(F.array(*[F.lit(d) for d in DELIMITERS])))
    sizes = cut_records(tried, ("file", "delimiter"), refuse=False).select("file", "delimiter", "record_no", F.size(record_fields(F.col("record"), F.col("delimiter"))).alias("n"))
    fits = sizes.groupBy("file", "delimiter").agg(F.min_by("n", "record_no").alias("head"), F.max("n").alias("most")).filter((F.col("head") > 1) & (F.col("most") <= F.col("head")))
    ranks = detect_delimiter(lines.select("file", F.col("seq").alias("line_no"), "line"))
    best = first_per_key(ranks.join(fits, ["file", "delimiter"]), ["file"], ["rank"]).select("file", "delimiter")
    return lines.select("file").distinct().join(best, "file", "left")


def table_cells(lines: DataFrame, delimiters: DataFrame, null_policy: str = "pandas") -> DataFrame:
    """(file, row_id, col_id, value) of files with their delimiter each; row 0 is the header.

    Records shorter than the header get nulls for the fields they lack. With the ``pandas`` policy
    the usual missing-value tokens of data rows become null; ``keep`` leaves every text as it is.
    """
    named = lines.join(delimiters, "file").withColumn("delimiter", F.coalesce("delimiter", F.lit(NONE)))
    rows = cut_records(named).select("file", "record_no", record_fields(F.col("record"), F.col("delimiter")).alias("f"))
    cells = rows.select("file", F.col("record_no").alias("row_id"), F.posexplode("f").alias("col_id", "value"))
    if null_policy == "keep":
        return cells
    return cells.withColumn("value", F.when(F.col("row_id") == 0, F.col("value")).otherwise(na_to_null(F.col("value"))))


def read_tables(spark: SparkSession, paths, null_policy: str = "pandas") -> DataFrame:
    """Cells of delimited files of any size, each with the delimiter that fits it."""
    lines = file_lines(spark, paths)
    return table_cells(lines, choose_delimiter_by_records(lines), null_policy)


def read_records(spark: SparkSession, paths, delimiter: str = ",") -> DataFrame:
    """(file, record_no, record) of delimited files of any size."""
    return cut_records(file_lines(spark, paths).withColumn("delimiter", F.lit(delimiter))).drop("delimiter")


def read_delimited(spark: SparkSession, paths, delimiter: str = ",", null_policy: str = "pandas") -> DataFrame:
    """Files of one header as an all-string table with ``file`` and ``row_id`` (from 0 in each file).

    A file with another header, a row with more fields than the header, or a quote that is never
    closed is refused when the rows are read; shorter rows end in nulls. ``pandas`` maps the usual
    missing-value tokens to null; ``keep`` leaves empty texts empty. Only the header of the first file is read at once.
    """
    first = spark.read.text(paths).inputFiles()[0]
    quoted = spark.read.option("sep", delimiter).option("escape", '"').option("multiLine", True).option("maxColumns", 1 << 20).option("enforceSchema", False)
    names = quoted.option("header", True).csv(first).columns
    head = [v or "" for v in quoted.option("header", False).csv(first).first()]
    f = F.col("f")
    rows = cut_records(file_lines(spark, paths).withColumn("delimiter", F.lit(delimiter))).select("file", "record_no", record_fields(F.col("record"), F.col("delimiter")).alias("f"))
    problem = (F.when((F.col("record_no") == 0) & (f != F.array(*[F.lit(h) for h in head])), "another header in ")
               .when(F.size(f) > len(names), F.concat(F.lit("more fields than the header in record "), F.col("record_no").cast("string"), F.lit(" of "))))
    data = rows.filter(F.when(problem.isNotNull(), F.raise_error(F.concat(problem, "file")).cast("boolean")).otherwise(F.col("record_no") > 0))
    fill = na_to_null if null_policy == "pandas" else lambda c: c
    return data.select(*[fill(F.get(f, F.lit(i))).alias(n) for i, n in enumerate(names)], "file", (F.col("record_no") - 1).alias("row_id"))


def rebuild_tables(files: DataFrame) -> DataFrame:
    """Cells of all tables derived again from the source texts of every dataset.

    ``files``: dataset_id, file_id, uploaded_at, content. Tables are numbered per dataset in upload
    order. Long texts are cut by several tasks. Writing the result with ``mode("overwrite")`` replaces earlier derived tables.
    """
    lines = content_lines(files.select(F.col("file_id").alias("file"), "content"))
    cells = table_cells(lines, choose_delimiter_by_records(lines)).withColumnRenamed("file", "file_id")
    enough = cells.groupBy("file_id").agg(F.countDistinct("row_id").alias("_n")).filter("_n > 2").drop("_n")
    kept = files.select("dataset_id", "file_id", "uploaded_at").join(enough, "file_id")
    order = W.partitionBy("dataset_id").orderBy("uploaded_at", "file_id")  # one small row per file
    numbered = kept.withColumn("table_no", F.row_number().over(order).cast("bigint")).drop("uploaded_at")
    return cells.join(numbered, "file_id").select("dataset_id", "table_no", "file_id", "row_id", "col_id", "value")
