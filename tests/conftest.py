import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fieldsheet.session import configure  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = configure(SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
                        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
                        .config("spark.sql.codegen.wholeStage", "false")  # many small plans: compiling costs more than it saves
                        .config("spark.sql.shuffle.partitions", "4")).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def values(spark):
    """The values of a column builder over one-column input."""
    def run(texts, build):
        from pyspark.sql import functions as F
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
        return [r[0] for r in df.select(build(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]
    return run
