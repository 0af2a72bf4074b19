"""Plans and shapes that keep driver and task memory bounded when tables grow."""

from pyspark.sql import functions as F

from fieldsheet.operators import coverage, log, reshape
from fieldsheet.plans import ranks, scans
from fieldsheet.plans.intervals import points_in_intervals
from fieldsheet.plans.scratch import materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _cells(spark, rows=400):
    made = spark.range(rows).select(F.lit("f").alias("file"), F.lit("s").alias("sheet"), (F.col("id") * 2).alias("row_id"), F.lit(0).alias("col_id"), F.lit("x").alias("value"))
    return materialize(made, "cells")


def test_cells_of_small_files_are_not_broadcast(spark):
    filled = _cells(spark).withColumn("part", F.struct("file", F.lit(0).cast("long").alias("r")))
    assert "BroadcastExchange" not in plan(reshape._runs(filled, "row_id"))
    carried = scans.carry_last(filled, ["file"], "row_id", {"value": F.col("value")}, 10)
    assert "BroadcastExchange" not in plan(carried) and carried.count() == 400
    assert "BroadcastExchange" not in plan(ranks.numbered(filled, ["file"], ["row_id"]))


def test_blocks_of_cells_are_not_broadcast(spark):
    cells = _cells(spark)
    islands = materialize(cells.select("file", "sheet", F.col("row_id").alias("r0"), F.col("row_id").alias("r1"), F.col("col_id").alias("c0"), F.col("col_id").alias("c1")), "islands")
    placed = points_in_intervals(islands.withColumn("_end", F.col("r1") + 1), cells, ["file", "sheet"], "r0", "_end", "row_id")
    assert "BroadcastExchange" not in plan(placed) and placed.count() == 400
    assert "BroadcastExchange" not in plan(reshape.merge_islands(cells, islands))


def test_arrivals_are_not_repeated_for_every_agent(spark, monkeypatch):
    said = spark.range(40).selectExpr("id AS message_id", "id % 20 AS agent_id", "1L AS dataset_id", "timestamp_micros(1000000 * (1000 + 500 * (id div 20))) AS created_at", "'user' AS role")
    files = spark.range(200).selectExpr("1L AS dataset_id", "id AS file_id", "concat('f', id) AS path", "timestamp_micros(1000000 * (id * 6)) AS at")
    rows = []
    real = log.carry_next
    monkeypatch.setattr(log, "carry_next", lambda df, *a, **k: (rows.append(df.count()), real(df, *a, **k))[1])
    notes = log.new_since_last_message(said, files, files.limit(0).selectExpr("dataset_id", "file_id AS table_id", "at")).collect()
    assert {r["note"] for r in notes} == {"[NOTE: User uploaded file(s): " + ", ".join(f"f{i}" for i in part) + "]" for part in (range(167), range(167, 200))}
    assert len(notes) == 40 and sum(rows) < 400  # 200 arrivals, 40 messages, two spans for 20 agents, two ends


def test_arrivals_of_agents_with_several_datasets(spark):
    said = spark.createDataFrame([(1, 7, 1, 10, "user"), (2, 7, 2, 20, "user"), (3, 8, 2, 15, "system"), (4, 8, 2, 30, "user"), (5, None, 1, 40, "user")],
                                 "message_id long, agent_id long, dataset_id long, s int, role string").selectExpr("* EXCEPT (s)", "timestamp_seconds(s) AS created_at")
    files = spark.createDataFrame([(1, 1, "a", 12), (2, 2, "b", 11), (1, 3, "c", 20), (2, 4, "d", 15), (2, 5, "e", 16), (3, 6, "x", 1), (1, 7, None, 5)],
                                  "dataset_id long, file_id long, path string, s int").selectExpr("* EXCEPT (s)", "timestamp_seconds(s) AS at")
    got = log.new_since_last_message(said, files, files.limit(0).selectExpr("dataset_id", "file_id AS table_id", "at"))
    assert {r["message_id"]: r["note"] for r in got.collect()} == {1: "[NOTE: ]", 2: "[NOTE: User uploaded file(s): b, a, d, e, c]", 4: "[NOTE: User uploaded file(s): e]", 5: "[NOTE: User uploaded file(s): a, c]"}


def test_arriving_rows_in_many_files_give_the_same_counts(spark, monkeypatch):
    from fieldsheet.queries import archive_queries, load
    late = load().QUERIES["stream_late_rows"]
    few = sorted(map(tuple, late(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(archive_queries, "ROWS_A_FILE", 100)
    many = late(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, many.collect())) == few


def _records(spark):
    ids = "dataset_id long, table_id long, row_id long, "
    occ = spark.createDataFrame([(1, 1, 5, " Norway", "2007-03", "60", "10"), (1, 1, 4, "norway ", "x", "61", "200"), (1, 1, None, "NORWAY", None, "59", "11"),
                                 (1, 2, 1, "Sweden", "2011", " ", "12"), (2, 3, 1, " ", "", "1", "1"), (3, 4, 1, None, None, None, None)],
                                ids + "country string, eventDate string, decimalLatitude string, decimalLongitude string")
    visits = spark.createDataFrame([(1, 0, 9, "2003", "2", " ", "\t"), (1, 0, 9, "2003", "13", "1", "net"), (4, 9, 1, "2001", None, "7", "Net"), (4, 9, 1, "2001", "2", "30", "net")],
                                   ids + "year string, month string, day string, method string")
    return [occ, visits]


def test_rows_of_coverage_meet_in_a_hash_aggregate(spark):
    """A sorting aggregate holds and spills every value of every row; only distinct texts may reach one."""
    for topics in (["dataset", "dates", "box", *coverage.TOPICS], ["taxon", "place"], ["dates"]):
        lines = [line for line in plan(coverage._gather(_records(spark), topics)).splitlines() if "Aggregate(" in line]
        assert lines and "HashAggregate(" in lines[-1] and "ObjectHashAggregate(" not in lines[-1] and "min(r#" in lines[-1]
        assert "trim" not in plan(coverage._gather(_records(spark), ["place"])).split("HashAggregate(")[-1]


def test_tables_of_coverage_are_not_written_first(spark, monkeypatch):
    from fieldsheet.plans import scratch
    from fieldsheet.queries import coverage_queries, load
    written = []
    for module in (coverage_queries, coverage):
        monkeypatch.setattr(module, "materialize", lambda df, name: (written.append(name), scratch.materialize(df, name))[1])
    load().QUERIES["coverage_metadata"](spark, "/root/testdata/sf0.001")
    assert written == ["coverage"]


def test_coverage_of_odd_rows(spark):
    got = {r["dataset_id"]: r for r in coverage.coverage_metadata(_records(spark)).collect()}
    assert {k: r["temporal_scope"] for k, r in got.items()} == {1: "2003-02-01/2011-12-31", 2: None, 3: None, 4: "2001-01-01/2001-12-31"}
    assert got[1]["geographic_scope"] == "Countries: NORWAY, Sweden; Coordinate bounds: lat 59.0000 to 60.0000, lon 10.0000 to 11.0000"  # a row without an id comes first
    assert got[2]["geographic_scope"] == "Coordinate bounds: lat 1.0000 to 1.0000, lon 1.0000 to 1.0000"
    assert got[1]["methodology"] == "net" and got[4]["methodology"] == "Net" and got[3]["west"] is None
