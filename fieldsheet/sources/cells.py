"""Sheet grids as cells: (file, sheet, row_id, col_id, value, is_formula)."""

from pyspark.sql import DataFrame, functions as F

from ..plans.intervals import points_in_intervals

SHEET = ["file", "sheet"]


def cells_to_table(cells: DataFrame, header: list[str]) -> DataFrame:
    """Wide table of sheets with a known header; row 0 is the header row."""
    data = cells.filter("row_id > 0").groupBy(*SHEET, "row_id")
    return data.agg(*[F.max(F.when(F.col("col_id") == i, F.col("value"))).alias(name) for i, name in enumerate(header)])


def cells_to_records(cells: DataFrame) -> DataFrame:
    """(file, sheet, row_id, record): one map per data row, named by row 0. For sheets of any header."""
    names = cells.filter("row_id = 0").select(*SHEET, "col_id", F.col("value").alias("name"))
    named = cells.filter("row_id > 0").join(names, [*SHEET, "col_id"])
    return named.groupBy(*SHEET, "row_id").agg(F.map_from_entries(
        F.transform(F.sort_array(F.collect_list(F.struct("col_id", "name", "value"))),
                    lambda e: F.struct(e["name"], e["value"]))).alias("record"))


def table_to_cells(t: DataFrame, keys, columns) -> DataFrame:
    """Data cells (keys, col_id, name, value) of a wide table."""
    pairs = F.array(*[F.struct(F.lit(i).alias("col_id"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value"))
                      for i, c in enumerate(columns)])
    return t.select(*keys, F.explode(pairs).alias("c")).select(*keys, "c.*")


def blank_formula_cells(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", F.when(F.col("is_formula"), F.lit("")).otherwise(F.col("value")))


def fill_merged_ranges(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every cell of a merged range (file, sheet, r0, r1, c0, c1) gets the marked top-left value.

    Files and sheets without a name are files and sheets like any other.
    """
    own = F.struct(*SHEET).alias("_sheet")
    corner = cells.select(own, F.col("row_id").alias("r0"), F.col("col_id").alias("c0"), F.col("value").alias("_corner"))
    marked = ranges.select("*", own).join(corner, ["_sheet", "r0", "c0"], "left").drop("_sheet").withColumn("_end", F.col("r1") + 1)
    covered = (points_in_intervals(marked, cells.select(*SHEET, "row_id", "col_id"), SHEET, "r0", "_end", "row_id")
               .filter("col_id BETWEEN c0 AND c1")
               .select(own, "row_id", "col_id", F.concat(F.coalesce("_corner", F.lit("")), F.lit(" [UNMERGED CELL]")).alias("_fill")))
    filled = cells.select("*", own).join(covered, ["_sheet", "row_id", "col_id"], "left").withColumn("value", F.coalesce("_fill", "value"))
    return filled.select(cells.columns)


def sheet_sizes(cells: DataFrame) -> DataFrame:
    """(file, sheet, n_rows): data rows below the header row."""
    rows = cells.groupBy(*SHEET, "row_id").agg(F.lit(1).alias("_one"))
    return rows.groupBy(*SHEET).agg((F.count(F.lit(1)) - 1).alias("n_rows"))


def filter_small_tables(sizes: DataFrame, least: int = 2):
    """(kept, errors): sheets with enough rows; files with none have an error."""
    per_file = sizes.groupBy("file").agg(F.count(F.lit(1)).alias("n_sheets"),
                                         F.count_if(F.col("n_rows") >= least).alias("n_kept"))
    kept = sizes.filter(F.col("n_rows") >= least)
    errors = per_file.filter("n_kept = 0").select("file", F.when(
        F.col("n_sheets") == 1, f"the table has fewer than {least} rows").otherwise(
        f"no sheet has at least {least} rows").alias("error"))
    return kept, errors
