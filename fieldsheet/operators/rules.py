"""Row rules, reports and checks of identifiers and links.

Row rules return ``(dataset_id, table_id, rule, row_id)``. ``row_flags`` evaluates all row-local
rules in one scan of the table.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates
from ..functions.text import clean_text, coerce_numeric, fold_key
from ..plans.scratch import materialize
from ..plans.skew import join_on_hot_keys, rows_of_repeated_keys
from ..plans.topk import joined_ranked, top_k

# Allowed basisOfRecord values.
BASIS_OF_RECORD = ["MaterialEntity", "PreservedSpecimen", "FossilSpecimen", "LivingSpecimen", "MaterialSample", "Event",
                   "HumanObservation", "MachineObservation", "Taxon", "Occurrence", "MaterialCitation"]
REQUIRED_COLUMNS = ["scientificName", "basisOfRecord", "occurrenceID"]

IDS = ["dataset_id", "table_id"]


def _outside(c: Column, low, high) -> Column:
    n = coerce_numeric(c)
    return n.isNull() | (n < low) | (n > high)


def _not_allowed(c: Column, allowed) -> Column:
    return ~F.coalesce(c.isin(list(allowed)), F.lit(False))


def _not_whole(c: Column) -> Column:
    n = coerce_numeric(c)
    return n.isNull() | (n <= 0) | (n % 1 != 0)


def row_rules(columns, allowed=BASIS_OF_RECORD, today: Column | None = None) -> list[tuple[str, Column]]:
    """Row-local rules that apply to a table with these columns.

    The date rules read ``_event``, the parsed eventDate that ``with_event`` adds.
    """
    today = F.current_date() if today is None else today
    rules = [
        ("basisOfRecord", "basisOfRecord", lambda c: _not_allowed(c, allowed)),
        ("decimalLatitude", "decimalLatitude", lambda c: _outside(c, -90, 90)),
        ("decimalLongitude", "decimalLongitude", lambda c: _outside(c, -180, 180)),
        ("individualCount", "individualCount", _not_whole),
        ("eventDate", "eventDate", lambda c: ~F.col("_event.ok")),
        ("eventDateFuture", "eventDate", lambda c: F.coalesce(F.col("_event.end") > today, F.lit(False))),
    ]
    return [(name, test(F.col(col))) for name, col, test in rules if col in columns]


def with_event(t: DataFrame) -> DataFrame:
    """The table with eventDate parsed once, for all rules that need it."""
    return t.withColumn("_event", dates.event_date(F.col("eventDate"))) if "eventDate" in t.columns else t


def row_flags(t: DataFrame, rules: list[tuple[str, Column]], *keep) -> DataFrame:
    """One row per broken rule, all rules in one pass."""
    hits = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    return with_event(t).select(*IDS, F.explode(hits).alias("rule"), "row_id", *keep)


def register_rules(rules, extra) -> list[tuple[str, Column]]:
    """Add targeted checks; a later rule of the same name replaces the earlier one."""
    return list({**dict(rules), **dict(extra)}.items())


def _one(t, name, bad):
    return t.filter(bad).select(*IDS, F.lit(name).alias("rule"), "row_id")


def bad_basis_of_record(t: DataFrame, allowed=BASIS_OF_RECORD) -> DataFrame:
    return _one(t, "basisOfRecord", _not_allowed(F.col("basisOfRecord"), allowed))


def bad_latitude(t: DataFrame) -> DataFrame:
    return _one(t, "decimalLatitude", _outside(F.col("decimalLatitude"), -90, 90))


def bad_longitude(t: DataFrame) -> DataFrame:
    return _one(t, "decimalLongitude", _outside(F.col("decimalLongitude"), -180, 180))


def bad_individual_count(t: DataFrame) -> DataFrame:
    return _one(t, "individualCount", _not_whole(F.col("individualCount")))


def bad_event_date(t: DataFrame) -> DataFrame:
    return _one(t, "eventDate", ~dates.event_date(F.col("eventDate"))["ok"])


def future_event_date(t: DataFrame, today: Column | None = None) -> DataFrame:
    today = F.current_date() if today is None else today
    return _one(t, "eventDateFuture", dates.event_date(F.col("eventDate"))["end"] > today)


def duplicate_catalog_number(t: DataFrame, keep=()) -> DataFrame:
    """Every member of a group of equal catalogue numbers in one table; nulls equal each other."""
    slim = t.select(*IDS, "row_id", *keep, "catalogNumber")
    return rows_of_repeated_keys(slim, [*IDS, "catalogNumber"]).select(*IDS, F.lit("catalogNumber").alias("rule"), "row_id", *keep)


def duplicate_occurrence_id(t: DataFrame, columns: DataFrame | None = None, keep=()) -> DataFrame:
    """Rows sharing an occurrenceID ignoring case; blanks do not count.

    Tables with a column ``id``, ``ID`` or ``measurementID`` are not occurrence cores and are left
    out. Without a column catalogue the header of ``t`` decides.
    """
    rule = F.lit("occurrenceID").alias("rule")
    slim = t.select(*IDS, "row_id", *keep, fold_key(F.col("occurrenceID")).alias("_key")).filter(F.col("_key").isNotNull())
    if columns is not None:
        other = columns.filter(F.col("name").isin("id", "ID", "measurementID")).select("table_id").distinct()
        slim = slim.join(other, "table_id", "left_anti")
    elif {"id", "ID", "measurementID"} & set(t.columns):
        slim = slim.limit(0)
    return rows_of_repeated_keys(slim, [*IDS, "_key"]).select(*IDS, rule, "row_id", *keep)


def id_collision_examples(t: DataFrame, id_col: str, keys: int = 5, spellings: int = 3) -> DataFrame:
    """Per table the first colliding identifiers with a few of their distinct spellings."""
    text = clean_text(F.col(id_col).cast("string"))
    spelled = (t.select(*IDS, text.alias("spelling"), fold_key(F.col(id_col)).alias("id_key"))
               .filter(F.col("id_key").isNotNull())
               .groupBy(*IDS, "id_key", "spelling").agg(F.count(F.lit(1)).alias("n")))
    groups = spelled.groupBy(*IDS, "id_key").agg(F.sum("n").alias("n")).filter("n > 1").drop("n")
    first = top_k(groups, IDS, ["id_key"], keys, "key_rank")
    shown = top_k(spelled.drop("n").join(first, [*IDS, "id_key"]), [*IDS, "id_key"], ["spelling"], spellings)
    return joined_ranked(shown, [*IDS, "key_rank", "id_key"], "rank", F.col("spelling"), " / ", "example")


def count_and_first(flags: DataFrame, keys, id_col: str, most: int) -> DataFrame:
    """(keys, n, ids): rows per key and the smallest ids.

    Counts are combined before the shuffle, and the ids are limited below it, so a key that holds most
    of the rows sends ``most`` ids per input partition, whatever its ids look like. Null keys are
    keys like any other. The flags are worked out and written once, in their few columns.
    """
    safe = [f"_k{i}" for i in range(len(keys))]
    tagged = materialize(flags.select(*[F.struct(F.col(k)).alias(s) for k, s in zip(keys, safe)], F.col(id_col).alias("_id")), "flags")
    counts = tagged.groupBy(*safe).agg(F.count(F.lit(1)).alias("n"))
    first = top_k(tagged, safe, ["_id"], most).groupBy(*safe).agg(F.sort_array(F.collect_list("_id")).alias("ids"))
    return counts.join(first, safe).select(*[F.col(s)[k].alias(k) for k, s in zip(keys, safe)], "n", "ids")


def validation_report(flags: DataFrame, checked: DataFrame | None = None, examples: int = 30) -> DataFrame:
    """Per rule the number of bad rows and the first row ids.

    ``checked`` (dataset_id, table_id, rule) adds the rules without bad rows as compliant.
    """
    report = count_and_first(flags, [*IDS, "rule"], "row_id", examples).select(
        *IDS, "rule", F.col("n").alias("bad_rows"), F.col("ids").alias("row_ids"))
    if checked is not None:
        found = report.select(*[F.col(c).alias(f"_{c}") for c in (*IDS, "rule")], "bad_rows", "row_ids")
        same = F.lit(True)
        for c in (*IDS, "rule"):
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        report = checked.join(found, same, "left")
    return report.select(*IDS, "rule", F.coalesce("bad_rows", F.lit(0)).alias("bad_rows"), "row_ids",
                         F.when(F.col("bad_rows") > 0, F.lit("failed")).otherwise(F.lit("compliant")).alias("status"))


def rules_checked(tables: DataFrame, rules) -> DataFrame:
    """Every rule for every table: the second input of ``validation_report``."""
    return tables.select(*IDS).distinct().withColumn("rule", F.explode(F.array(*[F.lit(r) for r in rules])))


def broken_links(ext: DataFrame, core: DataFrame, ext_id: str, core_id: str) -> DataFrame:
    """Extension rows whose linking id is not in the core; a missing id is a broken link."""
    known = core.select(F.col(core_id).alias(ext_id)).filter(F.col(ext_id).isNotNull()).distinct()
    return join_on_hot_keys(ext, known, [ext_id], "left_anti")


def completeness(t: DataFrame, terms) -> DataFrame:
    """Share of filled values per publication-critical term, long form (table, term, filled, share).

    ``location`` is a locality or both coordinates; ``abundance`` is an occurrenceStatus, an
    individualCount, or a quantity with its type. Both appear only if such columns exist.
    """
    have = set(t.columns)

    def filled(c):
        return clean_text(F.col(c).cast("string")).isNotNull() if c in have else F.lit(False)

    checks = {term: filled(term) for term in terms}
    checks["location"] = filled("locality") | (filled("decimalLatitude") & filled("decimalLongitude"))
    checks["abundance"] = (filled("occurrenceStatus") | filled("individualCount")
                           | (filled("organismQuantity") & filled("organismQuantityType")))
    sums = t.groupBy(*IDS).agg(F.count(F.lit(1)).alias("total"),
                               *[F.count_if(test).alias(f"n_{name}") for name, test in checks.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.col(f"n_{n}").alias("filled")) for n in checks]))
    return sums.select(*IDS, "total", pairs.alias("p")).select(
        *IDS, "p.term", "p.filled", "total", (F.col("p.filled") / F.col("total")).alias("share"))


def controlled_values(t: DataFrame, col: str, vocab: DataFrame) -> DataFrame:
    """Values of a controlled column outside its list ``vocab(value)``, with their number of rows."""
    used = (t.select(*IDS, clean_text(F.col(col)).alias("value")).filter(F.col("value").isNotNull())
            .groupBy(*IDS, "value").agg(F.count(F.lit(1)).alias("n_rows")))
    return used.join(vocab.select("value").distinct(), "value", "left_anti").select(*IDS, "value", "n_rows")
