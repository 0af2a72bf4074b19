"""Notes about arrivals: texts are listed once per window and never shuffled per message."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldsheet.operators import log


def _at(col):
    return F.expr(f"timestamp_micros(1704067200000000 + {col} * 60000000L)")


def _log(spark, said, files, tables):
    messages = spark.createDataFrame(said, "message_id long, agent_id long, dataset_id long, m int, role string").withColumn("created_at", _at("m")).drop("m")
    files = spark.createDataFrame(files, "dataset_id long, file_id long, path string, m int").withColumn("at", _at("m")).drop("m")
    return messages, files, spark.createDataFrame(tables, "dataset_id long, table_id long, m int").withColumn("at", _at("m")).drop("m")


def _expected(said, files, tables):
    """By hand: each agent's messages in order, each taking what came since the one before it."""
    groups, notes = {}, {}
    for _, agent, dataset, _, _ in said:
        groups.setdefault(agent, set()).add(dataset)
    for agent, datasets in groups.items():
        before = -10**9
        for minute in sorted({s[3] for s in said if s[1] == agent and s[0] is not None}):
            message_id, role = min((s[0], s[4]) for s in said if s[1] == agent and s[3] == minute and s[0] is not None)
            f = [(f[3], f[1], f[2]) for f in files if f[0] in datasets and before < f[3] <= minute]
            t = [(t[2], t[1], str(t[1])) for t in tables if t[0] in datasets and before < t[2] <= minute]
            if role == "user" and f + t:
                notes.setdefault(message_id, []).append((sorted(f), sorted(t)))
            before = minute
    return {k: _note(*v[0]) for k, v in notes.items() if len(v) == 1}, {k: v for k, v in notes.items() if len(v) > 1}


def _note(files, tables):
    texts = ["User uploaded file(s): " + ", ".join(x[2] for x in files)] * bool(files) + ["New table ids: [" + ", ".join(x[2] for x in tables) + "]"] * bool(tables)
    return "[NOTE: " + "; ".join(texts) + "]"


@pytest.mark.parametrize("step", [1, 100, 16384])
def test_notes_of_windows_of_any_size(spark, monkeypatch, step):
    monkeypatch.setattr(log, "STEP", step)
    monkeypatch.setattr(log, "SHARED", 1)
    draw = random.Random(step)
    said = [(draw.choice([i, i, i, i, i, None, 900 + i % 2]), i % 7, i % 7 % 3 + draw.choice([0, 0, 0, 1]), draw.randrange(6000), draw.choice(["user", "user", "system"])) for i in range(120)]
    files = [(draw.randrange(4), i, f"f{i}", draw.randrange(-100, 6500)) for i in range(300)]
    tables = [(draw.randrange(4), i, draw.randrange(6500)) for i in range(200)]
    got = {r["message_id"]: r["note"] for r in log.new_since_last_message(*_log(spark, said, files, tables)).collect()}
    single, several = _expected(said, files, tables)
    assert {k: v for k, v in got.items() if k not in several} == single and set(got) == {*single, *several}
    for k, runs in several.items():  # a message id that repeats has all of its arrivals in one note
        words = sorted(re.findall(r"f?\d+", got[k]))
        assert words == sorted(x[2] for run in runs for part in run for x in part)


def test_texts_are_not_shuffled_for_every_message(spark):
    said = [(i, i, 1, 700 + i, "user") for i in range(50)]
    files = [(1, i, f"f{i}" * 20, i) for i in range(600)]
    notes = log.new_since_last_message(*_log(spark, said, files, []))
    tops = notes._jdf.queryExecution().executedPlan().toString().split("Union")[-1].splitlines()
    assert [line for line in tops if "Join" in line or "Exchange" in line][0].find("SortMergeJoin") > 0
    assert len({r["note"] for r in notes.collect()}) == 1 and notes.count() == 50
