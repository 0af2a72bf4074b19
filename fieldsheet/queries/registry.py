"""Registration of queries, and views over the test tables written in SQL both engines read."""

import re

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "pages", "conversations", "labels"]
QUERIES, ORACLES = {}, {}


def _names(text):
    return set(re.findall(r"[a-z_]+", text))


def needed(text: str) -> list[str]:
    """Views a text uses, in order of definition."""
    found, todo = set(), [text]
    while todo:
        words = _names(todo.pop())
        for name in words & VIEWS.keys() - found:
            found.add(name)
            todo.append(VIEWS[name])
    return [v for v in VIEWS if v in found]


def oracle(sql: str) -> str:
    """The SQL with the views it uses in front."""
    views = ",\n".join(f"{v} AS (\n{VIEWS[v]}\n)" for v in needed(sql))
    body = sql.strip()
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


class Data:
    """Test tables and views of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        views = needed(text)
        used = set().union(_names(text), *[_names(VIEWS[v]) for v in views]) & set(TABLES)
        for name in used:
            self.table(name).createOrReplaceTempView(name)
        with_text = ",\n".join(f"{v} AS (\n{VIEWS[v]}\n)" for v in views)
        if with_text and text.lstrip().upper().startswith("WITH "):
            return self.spark.sql(f"WITH {with_text},\n{text.lstrip()[5:]}")
        return self.spark.sql(f"WITH {with_text}\n{text}" if with_text else text)

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")


def query(name: str, sql: str | None = None):
    """Register ``fn(data)`` under ``name``, with the SQL that must give the same rows."""
    def register(fn):
        def run(spark, folder):
            return fn(Data(spark, folder))
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return register
