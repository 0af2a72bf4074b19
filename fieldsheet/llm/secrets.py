"""Secret scans over a ledger of blobs: every text is scanned once per rule version."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.scratch import fresh_path, materialize
from .common import digest, join_unique

RULE_VERSION = "base-1"
# The base kinds in order, their pattern, and the group and least length that a match must have.
RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}+", 0, 16),
]
LEDGER = "rule_version string, blob binary, spans array<struct<start:long,kind:int,end:long>>"


def _pieces(text: Column, pattern: str, group: int, kind: int) -> Column:
    """Per match in order: code points before it since the last match, its length, and its group's length."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    each = F.transform(hits, lambda h, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).cast("long").alias("gap"), F.length(h).cast("long").alias("size"),
        (F.length(F.regexp_extract(h, pattern, group)) if group else F.length(h)).alias("value")))
    return F.when(text.rlike(pattern), each).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:bigint,size:bigint,value:int>>"))


def find_spans(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Spans (start, kind, end in code points, end exclusive) per row of ``blobs`` (blob, text).

    Matches are the leftmost ones that do not overlap, per kind; those whose group is too short are
    dropped after matching. A match starts where the gaps and matches before it end, so places are
    running sums over the matches of one text and kind. Rows that repeat a blob count once.
    """
    found = blobs.select("blob", F.concat(*[_pieces(F.col("text"), p, g, k) for k, (_, p, g, _) in enumerate(rules)]).alias("m"))
    rows = found.select("blob", F.explode("m").alias("m")).select("blob", "m.*").dropDuplicates(["blob", "kind", "i"])
    through = W.partitionBy("blob", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(through))
    least = F.element_at(F.array(*[F.lit(n) for *_, n in rules]), F.col("kind") + 1)
    good = rows.filter(F.col("value") >= least)
    return good.groupBy("blob").agg(F.sort_array(F.collect_list(
        F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end"))).alias("spans"))


def scan(versions: DataFrame, path: str, ledger: str, rules=RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings of every path of ``versions`` (column ``path`` and ``text``), scanning only what the ledger lacks.

    A blob is a text by its SHA-256 (null counts as empty). Of every blob that the ledger (a
    folder) does not hold under ``rule_version``, one version is read and scanned, and the pair is
    appended with its spans, found or not. Findings are joined back to all rows of ``versions``:
    repeated rows each get them. Returns path, blob and spans (never null). Give a new
    ``rule_version`` whenever the rules change.
    """
    spark = versions.sparkSession
    rows = materialize(versions.select(F.col(path).alias("path"), digest(F.col("text")).alias("blob")), "blobs")
    blobs = materialize(rows.groupBy("blob").agg(F.min(F.struct("path")).alias("one"), F.count(F.lit(1)).alias("copies")), "blob-counts")
    table = spark.createDataFrame([], LEDGER)
    table.write.mode("append").parquet(ledger)  # the folder exists from now on
    known = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rule_version") == rule_version)
    unseen = blobs.join(known.select("blob"), "blob", "left_anti").select("blob", "one")
    texts = versions.select(digest(F.col("text")).alias("blob"), F.struct(F.col(path).alias("path")).alias("one"),
                            F.coalesce("text", F.lit("")).alias("text"))
    # one version per unseen blob; a join key with the path keeps the rows of a common blob apart
    read = (texts.join(unseen.select(F.col("blob").alias("b"), F.col("one").alias("o")).hint("merge"),
                       (F.col("blob") == F.col("b")) & F.col("one").eqNullSafe(F.col("o")), "left_semi"))
    spans = find_spans(read.select("blob", "text"), rules)
    new = unseen.select("blob").join(spans, "blob", "left").select(
        F.lit(rule_version).alias("rule_version"), "blob",
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"))
    new.write.mode("append").parquet(ledger)
    findings = spark.read.schema(LEDGER).parquet(ledger).filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0))
    hits = findings.join(blobs, "blob").select("blob", "spans", "copies")
    joined = join_unique(rows, hits, "blob", "copies")
    return joined.select("path", "blob", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"))


def report(found: DataFrame, rules=RULES) -> DataFrame:
    """Counts per kind and the spans as text (``kind:start:end``, comma-joined) of :func:`scan`."""
    names = F.array(*[F.lit(n) for n, *_ in rules])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{n}") for k, (n, *_) in enumerate(rules)]
    return found.select("path", *counts, F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def new_ledger(spark) -> str:
    """A folder for a ledger in the shared folder of the session."""
    return fresh_path(spark, "ledger")
