"""Reshaping: crosstabs, header rows, sub-headers, blocks of data in a sheet, links as JSON."""

from pyspark.sql import DataFrame, functions as F

from ..functions.text import clean_text, normalize_string
from ..plans.intervals import points_in_intervals
from ..plans.scans import carry_last
from ..plans.scratch import materialize

SHEET = ["file", "sheet"]


def unpivot_crosstab(t: DataFrame, ids, columns, name: str = "site", value: str = "value") -> DataFrame:
    """One row per filled cell of a matrix."""
    long = t.unpivot(list(ids), list(columns), name, value)
    return long.filter(clean_text(F.col(value).cast("string")).isNotNull())


def fill_down(t: DataFrame, columns, keys=("dataset_id", "table_id"), order: str = "row_id", block: int = 65536) -> DataFrame:
    """Blank cells take the nearest value above them; works block-wise, so a long table uses many tasks."""
    return carry_last(t, list(keys), order, {c: clean_text(F.col(c)) for c in columns}, block).select(t.columns)


def merge_header_rows(cells: DataFrame, n: int, sep: str = " ") -> DataFrame:
    """(file, sheet, col_id, name): the texts of the first ``n`` rows of a column put together."""
    top = cells.filter(F.col("row_id") < n).select(*SHEET, "col_id", "row_id", clean_text(F.col("value")).alias("v"))
    return top.groupBy(*SHEET, "col_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("row_id", "v")))), lambda e: e["v"]), sep).alias("name"))


def _runs(filled: DataFrame, place: str) -> DataFrame:
    """Parts cut at empty lines: ``part`` becomes (part, first place of the run of filled places the cell is in).

    A filled place starts a run if the place before it is empty; the start is carried down block-wise.
    Both joins grow with the cells, while files of cells are small for their rows: neither side is ever broadcast.
    """
    places = filled.select("part", F.col(place).cast("long").alias("_p")).distinct()
    before = places.select("part", (F.col("_p") + 1).alias("_p"), F.lit(True).alias("_prev"))
    marked = places.join(before.hint("merge"), ["part", "_p"], "left")
    run = carry_last(marked, ["part"], "_p", {"_run": F.when(F.col("_prev").isNull(), F.col("_p"))}).select("part", F.col("_p").alias(place), "_run")
    return filled.join(run.hint("merge"), ["part", place])


def data_islands(cells: DataFrame) -> DataFrame:
    """(file, sheet, r0, r1, c0, c1): blocks of filled cells that no empty row or column of their own cuts.

    Sheets are cut at empty rows, the pieces at columns that are empty in them, these again at rows
    that are empty in them, and so on until nothing changes, so blocks side by side are cut each by
    its own empty rows. A piece is named by its first row and column, which no other piece of the sheet shares.
    Files and sheets without a name are cut like any other. Every round is written once.
    """
    filled = cells.filter(clean_text(F.col("value")).isNotNull()).select(
        F.struct(*SHEET).alias("sheet"), F.col("row_id").cast("long").alias("row_id"), F.col("col_id").cast("long").alias("col_id"))
    filled = filled.withColumn("part", F.struct("sheet", F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("c")))
    parts = 0
    while True:
        rows = _runs(filled, "row_id").withColumn("part", F.struct("sheet", F.col("_run").alias("r"), F.col("part.c").alias("c"))).drop("_run")
        cut = _runs(rows, "col_id").withColumn("part", F.struct("sheet", F.col("part.r").alias("r"), F.col("_run").alias("c"))).drop("_run")
        filled = materialize(cut.select("sheet", "row_id", "col_id", "part"), "islands")
        now = filled.select(F.count_distinct("part")).first()[0]
        if now == parts:
            break
        parts = now
    bounds = filled.groupBy("part").agg(F.min("row_id").alias("r0"), F.max("row_id").alias("r1"), F.min("col_id").alias("c0"), F.max("col_id").alias("c1"))
    kinds = dict(cells.dtypes)
    return bounds.select("part.sheet.file", "part.sheet.sheet", *[F.col(c).cast(kinds[k]).alias(c) for c, k in
                                                                  (("r0", "row_id"), ("r1", "row_id"), ("c0", "col_id"), ("c1", "col_id"))])


def island_cells(cells: DataFrame, islands: DataFrame) -> DataFrame:
    """Cells with the block they lie in."""
    open_end = islands.withColumn("_end", F.col("r1") + 1)
    return (points_in_intervals(open_end, cells, SHEET, "r0", "_end", "row_id")
            .filter("col_id BETWEEN c0 AND c1").drop("_end"))


def merge_islands(cells: DataFrame, islands: DataFrame) -> DataFrame:
    """Blocks of identical headers stacked: (header, file, sheet, r0, row_id, pos, value), header rows left out.

    ``header`` is the text of a block's first row; rows order by (file, sheet, r0, row_id).
    """
    placed = island_cells(cells, islands).withColumn("pos", F.col("col_id") - F.col("c0")).withColumn("_block", F.struct(*SHEET, "r0", "c0"))
    heads = (placed.filter("row_id = r0").groupBy("_block")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("value", F.lit("")).alias("v")))),
                                           lambda e: e["v"]), "|").alias("header")))
    return placed.filter("row_id > r0").join(heads.hint("merge"), "_block").select("header", *SHEET, "r0", "row_id", "pos", "value")


def normalize_strings(t: DataFrame, columns, case: str | None = None) -> DataFrame:
    return t.withColumns({c: normalize_string(F.col(c), case) for c in columns})


def tip_links_to_json(records: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Put links (key, tip, file) into the ``phylogenies`` list of ``dynamicProperties``.

    Links already listed come first, other properties are kept, and text that is no JSON object is
    replaced.
    """
    link = "array<struct<phyloTreeTipLabel:string,phyloTreeFileName:string>>"
    new = links.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(
        F.col("tip").alias("phyloTreeTipLabel"), F.col("file").alias("phyloTreeFileName")))).alias("_new"))
    joined = records.join(new, key, "left")
    old = F.coalesce(F.from_json("dynamicProperties", f"phylogenies {link}")["phylogenies"], F.array().cast(link))
    props = F.coalesce(F.from_json("dynamicProperties", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    listed = F.parse_json(F.to_json(F.array_distinct(F.concat(old, "_new"))))
    merged = F.map_concat(F.map_filter(props, lambda k, v: k != "phylogenies"), F.create_map(F.lit("phylogenies"), listed))
    return joined.withColumn("dynamicProperties", F.when(F.col("_new").isNull(), F.col("dynamicProperties"))
                             .otherwise(F.to_json(merged))).select(records.columns)
