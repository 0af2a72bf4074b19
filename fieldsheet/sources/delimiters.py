"""Delimiters of delimited text: the candidates and their order per file."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import strip
from ..plans.topk import top_k

# Candidate delimiters in order of preference.
DELIMITERS = ["\t", ",", ";", "|"]
MARK = "\x1e"  # doubled up where a text holds it: MARK 0 is the character itself, MARK 1 a cut


def detect_delimiter(lines: DataFrame, sample: int | None = None) -> DataFrame:
    """(file, delimiter, rank): delimiters to try per file, best first.

    Of all non-blank lines (the first ``sample`` if given) those holding a delimiter are counted (at least two): the smaller
    the spread of its number per line, the more lines and the higher the average, the better.
    Delimiters without enough lines follow in their fixed order.
    """
    filled = lines.filter(strip(F.col("line")) != "").select("file", "line_no", "line")
    if sample is not None:
        filled = top_k(filled, ["file"], ["line_no"], sample, "_r")
    marks = filled.select("file", F.explode(F.array(*[F.struct(
        F.lit(d).alias("delimiter"), F.lit(i).alias("i"),
        (F.length("line") - F.length(F.replace("line", F.lit(d), F.lit("")))).alias("n")) for i, d in enumerate(DELIMITERS)])).alias("m"))
    used = F.when(F.col("m.n") > 0, F.col("m.n"))
    stats = marks.groupBy("file", "m.delimiter", "m.i").agg(
        F.count(used).alias("lines"), (F.max(used) - F.min(used)).alias("spread"), F.avg(used).alias("average"))
    enough = F.col("lines") >= 2
    order = F.struct((~enough).alias("late"), F.when(enough, F.col("spread")).alias("spread"),
                     F.when(enough, -F.col("lines")).alias("lines"), F.when(enough, -F.col("average")).alias("average"),
                     F.when(enough, F.ascii("delimiter")).otherwise(F.col("i")).alias("tie"))
    ranked = stats.withColumn("rank", F.row_number().over(W.partitionBy("file").orderBy(order)).cast("bigint"))  # four rows per file
    return ranked.select("file", "delimiter", "rank")
