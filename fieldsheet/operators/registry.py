"""The table registry (dataset_id, table_id, title, updated_at, …): replacing, deleting, exporting."""

from pyspark.sql import DataFrame, functions as F

from ..plans.topk import last_per_key


def latest_table_by_title(registry: DataFrame) -> DataFrame:
    return last_per_key(registry, ["dataset_id", "title"], ["updated_at", "table_id"]).select(registry.columns)


def upsert_table(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Registry in which each new table replaces the newest one of the same dataset and title.

    A replaced table keeps its id; others keep the id they come with. ``action`` tells which happened.
    """
    latest = latest_table_by_title(registry).select("dataset_id", "title", F.col("table_id").alias("_old"))
    marked = new.join(latest, ["dataset_id", "title"], "left")
    written = marked.withColumn("action", F.when(F.col("_old").isNull(), "created").otherwise("replaced")).withColumn(
        "table_id", F.coalesce("_old", "table_id")).select(*registry.columns, "action")
    untouched = registry.join(written.filter("action = 'replaced'").select("dataset_id", "table_id"),
                              ["dataset_id", "table_id"], "left_anti").select(*registry.columns)
    return untouched.withColumn("action", F.lit("kept")).unionByName(written)


def delete_tables_except(registry: DataFrame, keep: DataFrame):
    """(kept, deleted) for the datasets named in ``keep`` (dataset_id, table_id)."""
    touched = registry.join(keep.select("dataset_id").distinct(), "dataset_id", "left_semi")
    ids = keep.select("dataset_id", "table_id").distinct()
    deleted = touched.join(ids, ["dataset_id", "table_id"], "left_anti")
    kept = registry.join(deleted.select("table_id").distinct(), "table_id", "left_anti")
    return kept, deleted.select("dataset_id", "table_id")


def records_json(t: DataFrame, keys=("row_id",)) -> DataFrame:
    """(keys, json): each row as a JSON record; infinite and undefined numbers become null."""
    def finite(c, kind):
        bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
        return F.when(~bad, c) if kind in ("double", "float") else c

    taken, names = {}, []
    for c in t.columns:
        taken[c] = taken.get(c, 0) + 1
        names.append(c if taken[c] == 1 else f"{c} ({taken[c]})")
    u = t.toDF(*names)
    record = F.struct(*[finite(F.col(f"`{c}`"), kind).alias(c) for c, kind in u.dtypes])
    return u.select(*keys, F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def transform_table(t: DataFrame, fn, schema: str | None = None, keys=None) -> DataFrame:
    """The table after user code.

    ``fn`` takes and returns a DataFrame; with a ``schema`` it is pandas code, run batch by batch or,
    with ``keys``, once per group of rows (a group must then fit in one task).
    """
    if schema is None:
        return t.transform(fn)
    if keys:
        return t.groupBy(*keys).applyInPandas(fn, schema)
    return t.mapInPandas(lambda batches: (fn(b) for b in batches), schema)
