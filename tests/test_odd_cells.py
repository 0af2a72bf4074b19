"""Cells of sheets without a name, blocks side by side, equal rows, rows seen through agents, steps."""

import pytest

from fieldsheet.operators import log, reshape
from fieldsheet.sources import cells

CELL = "file string, sheet string, row_id long, col_id int, value string"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _grid(picture, file="f", sheet=None):
    return [(file, sheet, r, c, v if v != "." else None) for r, line in enumerate(picture) for c, v in enumerate(line)]


def test_blocks_of_a_sheet_without_name(spark):
    df = spark.createDataFrame(_grid(["ab", "cd", "..", "ef"]) + _grid(["x"], None, None), CELL)
    assert _rows(reshape.data_islands(df)) == sorted([("f", None, 0, 1, 0, 1), ("f", None, 3, 3, 0, 1), (None, None, 0, 0, 0, 0)], key=repr)


def test_empty_row_inside_a_strip(spark):
    df = spark.createDataFrame(_grid(["aa.bb", "aa.bb", "...bb", "aa.bb"]), CELL)
    assert _rows(reshape.data_islands(df)) == [("f", None, 0, 1, 0, 1), ("f", None, 0, 3, 3, 4), ("f", None, 3, 3, 0, 1)]


def test_cuts_within_cuts(spark):
    df = spark.createDataFrame(_grid(["aaa.c", "....c", "b.b.c", "b...c", "b.b.c"]), CELL)
    assert _rows(reshape.data_islands(df)) == [("f", None, 0, 0, 0, 2), ("f", None, 0, 4, 4, 4), ("f", None, 2, 2, 2, 2), ("f", None, 2, 4, 0, 0), ("f", None, 4, 4, 2, 2)]
    assert reshape.data_islands(df.limit(0)).collect() == []


def test_blocks_of_unnamed_sheets_are_stacked(spark):
    df = spark.createDataFrame(_grid(["hk", "12", "..", "hk", "34"]), CELL)
    got = reshape.merge_islands(df, reshape.data_islands(df)).select("header", "row_id", "pos", "value")
    assert _rows(got) == [("h|k", 1, 0, "1"), ("h|k", 1, 1, "2"), ("h|k", 4, 0, "3"), ("h|k", 4, 1, "4")]


def test_merged_range_of_a_sheet_without_name(spark):
    df = spark.createDataFrame(_grid(["ab", "cd"]), CELL)
    ranges = spark.createDataFrame([("f", None, 0, 1, 0, 0)], "file string, sheet string, r0 long, r1 long, c0 int, c1 int")
    got = {(r["row_id"], r["col_id"]): r["value"] for r in cells.fill_merged_ranges(df, ranges).collect()}
    assert got == {(0, 0): "a [UNMERGED CELL]", (1, 0): "a [UNMERGED CELL]", (0, 1): "b", (1, 1): "d"}


def test_equal_rows_are_surplus(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 1, "x"), (1, 1, "x"), (None, 1, "y"), (None, 1, "y"), (2, 1, "b"), (2, 1, "a")], "k int, o int, v string")
    kept, surplus = log.dedupe_keep_first(df, "k", ["o"])
    assert _rows(kept) == [(1, 1, "x"), (2, 1, "a"), (None, 1, "y")] and _rows(surplus) == [(1, 1, "x"), (1, 1, "x"), (2, 1, "b"), (None, 1, "y")]


def test_rows_seen_through_their_agent(spark):
    datasets = spark.createDataFrame([(1, 7), (2, 8)], "dataset_id long, user_id long")
    agents = spark.createDataFrame([(10, 1), (20, 2), (30, None)], "agent_id long, dataset_id long")
    said = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, None)], "message_id long, agent_id long")
    assert _rows(log.visible_rows(said, datasets, 7, False, agents)) == [(10, 1)] and log.visible_rows(said, datasets, 7, True).count() == 4
    with pytest.raises(ValueError):
        log.visible_rows(said, datasets, 7, False)


def test_untouched_tasks_are_counted(spark):
    tasks = spark.createDataFrame([("a", "t", 1), ("b", "t", 2), ("c", "t", 3)], "name string, text string, order int")
    new = spark.createDataFrame([("b", "n", 0), ("d", "n", 1), (" ", "n", 2)], "name string, text string, position int")
    assert log.upsert_tasks(tasks, new)[1].collect()[0][0] == 2


def test_next_step_by_kind(spark):
    tasks = spark.createDataFrame([("start", 1), ("tree", 2), ("paper", 2), ("end", 3)], "name string, order int")
    datasets = spark.createDataFrame([(i, None) for i in range(5)], "dataset_id long, rejected_at timestamp")
    modes = spark.createDataFrame([(1, "hybrid", True), (2, "pdf_only", False), (3, "tabular_only", False)], "dataset_id long, source_mode string, has_tree boolean")
    agents = spark.sql("SELECT * FROM VALUES (1L, 10L, 'start'), (2L, 11L, 'start'), (3L, 12L, 'start'), (4L, 13L, 'end') AS t(dataset_id, agent_id, task)").selectExpr("*", "timestamp'2024-01-01' AS created_at", "timestamp'2024-01-02' AS completed_at")
    got = {r["dataset_id"]: r["task"] for r in log.next_step(datasets, agents, tasks, modes, "tree", "paper").collect()}
    assert got == {0: "start", 1: "tree", 2: "paper", 3: "end", 4: None}
