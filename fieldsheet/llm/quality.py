"""Quality rules whose thresholds come from quantile sketches per language and source."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.scratch import materialize
from .common import join_unique

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"
WINDOW = 5
LEAST_ROWS = 100  # a group with fewer rows takes the thresholds of its language, a language with fewer those of all rows
REACH = 3  # a fence lies this many quartile distances outside the quartiles
# Per measure (thousandths): the least quartile distance that counts, and whether values below the lower fence fail too.
MEASURES = {"word_length": (1500, True), "symbols": (100, False), "dup_lines": (125, False)}
BITS = 5  # leading bits a bucket keeps: quantiles are right to one part in 16


def measure(docs: DataFrame) -> DataFrame:
    """Counts of every whole text (null: none), in one pass and without a shuffle, written to the shared folder.

    Returns doc_id, lang, source, n_words, word_chars (code points in words), n_symbols, n_dup_lines
    (lines with a word, equal to an earlier line of the text), n_repeat_words (words in windows of five
    words that occur twice or more in the text), n_lines (lines with a word) and base_failed. Windows
    of one text are compared by 64-bit hashes. Texts of fewer than five words have no window.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"),
                       F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))
    rows = rows.select(
        "doc_id", "lang", "source", F.size("w").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"),
        F.when(F.col("t").rlike(SYMBOL), F.regexp_count("t", F.lit(SYMBOL))).otherwise(0).alias("n_symbols"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("w") >= WINDOW, hashes).alias("h"))
    placed = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn("h", F.when(F.size("h") > F.size(F.array_distinct("h")), placed))
    again = F.filter("h", lambda e, i: F.get("h", i + 1)["x"].eqNullSafe(e["x"]) | (F.when(i > 0, F.get("h", i - 1)["x"]).eqNullSafe(e["x"])))
    rows = rows.withColumn("h", F.sort_array(F.transform(again, lambda e: e["i"])))
    covered = F.aggregate(F.transform("h", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("h", i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    rows = rows.select("doc_id", "lang", "source", *[F.col(c).cast("long") for c in counts])
    # written, as a filter on these counts would otherwise move below them and repeat the work
    return materialize(rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))), "measured")


def _share(count: str, of: str) -> Column:
    return F.expr(f"{count} * 1000 div greatest({of}, 1)")


def measures() -> dict[str, Column]:
    """What the thresholds judge, as whole thousandths of the counts of :func:`measure`; repeated words have a base rule of their own."""
    return {"word_length": _share("word_chars", "n_words"), "symbols": _share("n_symbols", "n_words"),
            "dup_lines": _share("n_dup_lines", "n_lines")}


def bucket(value: Column) -> Column:
    """The bucket of a whole number from 0: numbers with the same leading bits and length share one."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return (shift * (1 << BITS - 1) + F.call_function("shiftright", value, shift)).cast("int")


def bucket_top(index: Column) -> Column:
    """The largest number of a bucket."""
    half = 1 << BITS - 1
    shift = F.greatest(F.floor(index / half) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (index - shift * half + 1).cast("long"), shift) - 1


def sketch(measured: DataFrame) -> DataFrame:
    """Bucket counts (lang, source, measure, bucket, n) of the rows that pass the base rules.

    This is the whole sketch: it holds some hundred rows a group whatever the number of documents.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), bucket(v).alias("bucket")) for name, v in measures().items()]))
    return measured.filter(~F.col("base_failed")).select("lang", "source", each.alias("m")).groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    """One sketch of all rows that went into several; any grouping of the parts gives the same."""
    union = sketches[0]
    for other in sketches[1:]:
        union = union.unionByName(other)
    return union.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))


def _fences(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: how many rows it has, and a struct of the lower and upper fence of every measure.

    A quantile is the top of the bucket in which the running count reaches its share.
    """
    group = W.partitionBy(*keys, "measure")  # at most some hundred buckets
    runs = counts.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "rows": F.sum("n").over(group)})
    each = runs.groupBy(*keys, "measure", "rows").agg(
        *[bucket_top(F.min(F.when(4 * F.col("upto") >= quarters * F.col("rows"), F.col("bucket")))).alias(f"q{quarters}") for quarters in (1, 3)])
    least = F.element_at(F.create_map(*[F.lit(x) for name, (width, _) in MEASURES.items() for x in (name, width)]), F.col("measure"))
    width = REACH * F.greatest(F.col("q3") - F.col("q1"), least.cast("long"))
    each = each.withColumns({"low": F.col("q1") - width, "high": F.col("q3") + width})
    fences = [F.max(F.when(F.col("measure") == name, F.struct("low", "high"))).alias(name) for name in MEASURES]
    return each.groupBy(*keys).agg(F.max("rows").alias("rows"), *fences).select(*keys, "rows", F.struct(*MEASURES).alias("fences"))


def thresholds(counts: DataFrame) -> DataFrame:
    """Per language and source of a sketch: ``fences`` (per measure its low and high) and the ``level`` they come from.

    Groups of fewer than ``LEAST_ROWS`` rows take the fences of their language, languages as small
    those of all rows; if there are as few of them, fences are null and nothing is judged. Null
    languages and sources are values like any other.
    """
    counts = materialize(counts, "sketch")
    by_language = materialize(counts.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")), "language-sketch")
    whole = _fences(by_language.groupBy("measure", "bucket").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1)), ["one"]).first()  # one row
    of_all = F.lit(None).cast("struct<" + ",".join(f"{m}:struct<low:bigint,high:bigint>" for m in MEASURES) + ">")
    if whole is not None and whole["rows"] >= LEAST_ROWS:
        of_all = F.struct(*[F.struct(F.lit(whole["fences"][m]["low"]).cast("long").alias("low"), F.lit(whole["fences"][m]["high"]).cast("long").alias("high")).alias(m) for m in MEASURES])
    groups = _fences(counts, ["lang", "source"]).withColumn("key", F.struct("lang"))
    sizes = counts.groupBy("lang").agg(F.count_distinct(F.struct("source")).alias("copies"))
    languages = _fences(by_language, ["lang"])
    languages = (languages.join(sizes.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")))
                 .select(F.struct("lang").alias("key"), F.col("rows").alias("lang_rows"), F.col("fences").alias("lang_fences"), "copies"))
    joined = join_unique(materialize(groups, "fences"), materialize(languages, "language-fences"), "key", "copies")
    own, wide = F.col("rows") >= LEAST_ROWS, F.col("lang_rows") >= LEAST_ROWS
    return joined.select("lang", "source", F.when(own, "source").when(wide, "language").otherwise("all").alias("level"),
                         F.when(own, F.col("fences")).when(wide, F.col("lang_fences")).otherwise(of_all).alias("fences"))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows of :func:`measure` with ``level``, ``reasons`` (measures outside their fences) and ``kept``.

    ``kept`` is false for rows that failed the base rules or have a reason. Thresholds are joined by
    language and source, balanced where one group holds much of all rows; a group without any is not judged.
    """
    rows = measured.withColumn("key", F.struct("lang", "source"))
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    named = limits.select(F.struct("lang", "source").alias("key"), "level", "fences").join(copies, "key")
    joined = join_unique(rows, materialize(named, "thresholds"), "key", "copies").drop("key")
    fails = []
    for name, value in measures().items():
        outside = value > F.col("fences")[name]["high"]
        if MEASURES[name][1]:
            outside = outside | (value < F.col("fences")[name]["low"])
        fails.append(F.when(outside, F.lit(name)))
    reasons = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*fails)))
    return joined.withColumn("reasons", reasons).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)).drop("fences")


def filter_documents(docs: DataFrame) -> DataFrame:
    """Judge all documents (doc_id, text, lang, source) by thresholds learned from themselves.

    Returns the columns of :func:`measure`, ``level``, ``reasons`` and ``kept``, one row per row of
    ``docs`` (repeated ids and null ids too). Other columns are not read. An empty table gives no rows.
    """
    measured = measure(docs)
    return judge(measured, thresholds(sketch(measured)))
