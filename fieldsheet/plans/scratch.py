"""Where intermediate tables go: the shared folder the session names."""

import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; where that is unset, a folder in the session's warehouse.

    A warehouse on one machine's disk will not do for a cluster, so there the setting has to be given.
    """
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
        if on_one_machine(named) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all machines of the cluster see")
        spark.conf.set(SETTING, named)
    return named


def on_one_machine(path: str) -> bool:
    """Whether a path without a setting of its own lies on a machine's own disk."""
    return path.startswith(("file:", "/")) or "://" not in path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str):
    """The rows written to the shared folder and read back: later stages do not repeat the work.

    A written table survives the loss of executors and has no lineage.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
