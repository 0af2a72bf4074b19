"""Column names: repair, mapping to vocabulary terms, schema assessment.

``columns`` is a catalogue (table_id, pos, name). ``schema_terms`` has one row per schema term:
(schema_order, schema_key, title, kind, row_type, id_column, pos, term).
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import strip
from ..plans.topk import first_per_key


def unique_column_names(columns: DataFrame) -> DataFrame:
    """Add ``new_name``: missing names become ``NaN (k)``, later duplicates ``name (2)``, ``name (3)``."""
    nth = F.row_number().over(W.partitionBy("table_id", "name").orderBy("pos"))
    numbered = F.concat(F.coalesce("name", F.lit("NaN")), F.lit(" ("), nth.cast("string"), F.lit(")"))
    return columns.withColumn("new_name", F.when(F.col("name").isNull() | (nth > 1), numbered).otherwise(F.col("name")))


def apply_column_names(t: DataFrame, names) -> DataFrame:
    return t.toDF(*names)


def integer_headers(columns: DataFrame) -> DataFrame:
    """Tables whose headers are all whole numbers."""
    whole = F.coalesce(F.col("name").rlike("^[0-9]+$"), F.lit(False))
    return columns.groupBy("table_id").agg(F.bool_and(whole).alias("_all")).filter("_all").select("table_id")


def map_to_dwc_terms(columns: DataFrame, terms: DataFrame) -> DataFrame:
    """Add the canonical ``term`` of every header (case-insensitive) or null, and ``matched``."""
    canon = terms.select(F.lower("term").alias("_key"), F.col("term"))
    out = columns.withColumn("_key", F.lower(strip(F.col("name")))).join(canon, "_key", "left").drop("_key")
    return out.withColumn("matched", F.col("term").isNotNull())


def rename_to_terms(t: DataFrame, terms) -> DataFrame:
    """Rename the columns of one table to the spelling of ``terms`` (a list of names)."""
    spelling = {x.lower(): x for x in terms}
    return t.withColumnsRenamed({c: spelling[c.strip().lower()] for c in t.columns if c.strip().lower() in spelling})


def quantity_pairing(columns: DataFrame) -> DataFrame:
    """Tables with an organismQuantity but no organismQuantityType, or the reverse."""
    seen = columns.groupBy("table_id").agg(F.bool_or(F.col("name") == "organismQuantity").alias("q"),
                                           F.bool_or(F.col("name") == "organismQuantityType").alias("ty"))
    missing = F.when(F.col("q") & ~F.coalesce("ty", F.lit(False)), "organismQuantityType").when(
        F.col("ty") & ~F.coalesce("q", F.lit(False)), "organismQuantity")
    return seen.select("table_id", missing.alias("missing")).filter("missing IS NOT NULL")


def missing_required_columns(columns: DataFrame, required) -> DataFrame:
    """(table_id, term) for every required column a table lacks."""
    names = columns.groupBy("table_id").agg(
        F.collect_set(F.when(F.col("name").isin(list(required)), F.col("name"))).alias("have"))
    wanted = F.array(*[F.lit(r) for r in required])
    return names.select("table_id", F.explode(F.array_except(wanted, "have")).alias("term"))


def suitability(columns: DataFrame) -> DataFrame:
    """``occurrence`` needs what, when and where columns; ``checklist`` needs scientificName."""
    n = F.lower(strip(F.col("name")))
    seen = columns.groupBy("table_id").agg(
        F.bool_or(F.coalesce(n == "scientificname", F.lit(False))).alias("name"),
        F.bool_or(F.coalesce(n.isin("scientificname", "vernacularname", "genus"), F.lit(False))).alias("what"),
        F.bool_or(F.coalesce(n.isin("eventdate", "year", "verbatimeventdate"), F.lit(False))).alias("when"),
        F.bool_or(F.coalesce(n.isin("locality", "country", "decimallatitude", "verbatimlocality"), F.lit(False))).alias("where"))
    return seen.select("table_id", F.when(F.col("what") & F.col("when") & F.col("where"), "occurrence")
                       .when(F.col("name"), "checklist").otherwise("unsuitable").alias("suitability"))


def _checked_names(columns: DataFrame) -> DataFrame:
    """Distinct non-identifier headers per table, first spelling kept."""
    name = strip(F.col("name"))
    named = columns.select("table_id", "pos", name.alias("name"), F.lower(name).alias("key"))
    named = named.filter((F.col("key") != "") & ~F.col("key").endswith("id"))
    return first_per_key(named, ["table_id", "key"], ["pos"]).select("table_id", "key", "name")


def column_overlap(columns: DataFrame, schema_terms: DataFrame) -> DataFrame:
    """Per table and schema: shared and foreign header counts, and whether the header is a subset.

    Only schemas sharing a header are joined, so the result has no row for a pair without overlap.
    """
    names = _checked_names(columns)
    size = names.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_names"))
    terms = schema_terms.select("schema_order", "schema_key", "title", F.lower("term").alias("key")).distinct()
    shared = (names.join(terms, "key").groupBy("table_id", "schema_order", "schema_key", "title")
              .agg(F.count(F.lit(1)).alias("shared")))
    return shared.join(size, "table_id").select(
        "table_id", "schema_order", "schema_key", "title", "shared", (F.col("n_names") - F.col("shared")).alias("foreign"),
        (F.col("n_names") == F.col("shared")).alias("is_subset"))


def assess_schema(columns: DataFrame, schema_terms: DataFrame) -> DataFrame:
    """(table_id, status, schema, invalid): the best fitting schema of every table.

    ``skipped`` if only identifier columns exist; ``match`` with the first schema holding all names;
    else the schema with fewest invalid and most shared names (``partial``), or ``no_match``.
    Invalid names are listed in order.
    """
    names = _checked_names(columns)
    best = (column_overlap(columns, schema_terms).groupBy("table_id")
            .agg(F.min_by(F.struct("schema_order", "schema_key", "foreign"),
                          F.struct("foreign", -F.col("shared"), "schema_order")).alias("b"))
            .select("table_id", "b.*"))
    terms = schema_terms.select("schema_order", F.lower("term").alias("key"), F.lit(True).alias("allowed")).distinct()
    listed = (names.join(best, "table_id", "left").join(terms, ["schema_order", "key"], "left")
              .groupBy("table_id").agg(
                  F.first("schema_key").alias("schema"), F.first("foreign").alias("foreign"),
                  F.sort_array(F.collect_list(F.when(F.col("allowed").isNull(), F.col("name")))).alias("invalid")))
    tables = columns.select("table_id").distinct()
    status = (F.when(F.col("invalid").isNull(), "skipped").when(F.col("schema").isNull(), "no_match")
              .when(F.col("foreign") == 0, "match").otherwise("partial"))
    return tables.join(listed, "table_id", "left").select("table_id", status.alias("status"), "schema", "invalid")


def select_mapped(t: DataFrame, terms, keep=()) -> DataFrame:
    """Only the columns of a schema (a list of terms), plus the identifier columns in ``keep``."""
    allowed = {x.lower() for x in terms} | {k.lower() for k in keep}
    return t.select(*[c for c in t.columns if c.lower() in allowed])


def ensure_identifier(t: DataFrame, name: str, key=("dataset_id", "table_id", "row_id")) -> tuple[DataFrame, str]:
    """The table with an identifier column and that column's name.

    An existing column (ignoring case) or ``id`` is used; else identifiers are minted from the row
    key, so a retried task mints the same ones.
    """
    by_lower = {c.lower(): c for c in t.columns}
    for wanted in (name.lower(), "id"):
        if wanted in by_lower:
            return t, by_lower[wanted]
    return t.withColumn(name, minted_id(*key)), name


def minted_id(*key) -> Column:
    h = F.sha2(F.to_json(F.struct(*key)), 256)
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut])


def rename_columns(t: DataFrame, mapping: dict) -> DataFrame:
    return t.withColumnsRenamed(mapping)


def add_constant_columns(t: DataFrame, values: dict) -> DataFrame:
    return t.withColumns({c: F.lit(v) for c, v in values.items()})


def drop_columns(t: DataFrame, *names) -> DataFrame:
    """Drop columns, refusing names the table does not have."""
    unknown = [n for n in names if n not in t.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return t.drop(*names)


def coerce_numeric_columns(t: DataFrame, cols) -> DataFrame:
    from ..functions.text import coerce_numeric
    return t.withColumns({c: coerce_numeric(F.col(c)) for c in cols})
