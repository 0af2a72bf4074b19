"""Cleaning and reading single text values."""

from pyspark.sql import Column, functions as F

# Texts that stand for "nothing given".
PLACEHOLDERS = ["unknown", "not known", "not provided", "n/a", "na", "none", "null", "tbd", "pending"]

# Texts pandas reads as missing by default.
PANDAS_NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Kingdom names recognised by rank inference.
KINGDOMS = ["animalia", "plantae", "fungi", "bacteria", "archaea", "protista", "chromista"]

# Named entities of HTML text.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&#34;", '"'), ("&nbsp;", " "), ("&amp;", "&")]

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
BLANKS = " \t\n\r\f\v\u00a0"
SPACE = r"[\s ]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def clean_text(c: Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(strip(c), F.lit(""))


def is_placeholder(c: Column) -> Column:
    t = clean_text(c)
    return t.isNull() | F.lower(t).isin(PLACEHOLDERS)


def na_to_null(c: Column) -> Column:
    """The default missing-value tokens of a CSV upload become null."""
    return F.when(~c.isin(PANDAS_NA), c)


def coerce_numeric(c: Column) -> Column:
    """Number or null. The pattern keeps out texts such as ``1d`` that a cast would accept."""
    c = c.cast("string")
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def coerce_float(c: Column) -> Column:
    """Number or null; blanks and words such as ``nan``, ``none`` and ``nat`` are null."""
    return coerce_numeric(strip(c.cast("string")))


def coerce_int(c: Column) -> Column:
    """Whole part of a number, or null."""
    return coerce_float(c).try_cast("bigint")


def normalize_doi(c: Column) -> Column:
    t = strip(c)
    for prefix in ("https://doi.org/", "http://doi.org/", "doi:"):
        t = F.replace(t, F.lit(prefix), F.lit(""))
    return clean_text(t)


def lookup_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def strip_examples(c: Column) -> Column:
    marker = " Examples:"
    return F.when(c.contains(marker), strip(F.substring_index(c, marker, 1))).otherwise(c)


def unescape_html(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def collapse_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def clean_definition(c: Column) -> Column:
    """Vocabulary text without markup; the example marker is spelled out."""
    t = strip_tags(unescape_html(F.coalesce(c, F.lit(""))))
    return collapse_blanks(F.replace(t, F.lit("Egs -"), F.lit("Examples:")))


def snapshot_value(c: Column) -> Column:
    """Long text cut to 67 characters and an ellipsis."""
    return F.when(F.length(c) > 70, F.concat(F.left(c, F.lit(67)), F.lit("..."))).otherwise(c)


def normalize_string(c: Column, case: str | None = None) -> Column:
    """Trim, collapse blanks and optionally fix the case (``title`` or ``sentence``)."""
    t = clean_text(collapse_blanks(c))
    if case == "title":
        t = F.initcap(t)
    elif case == "sentence":
        t = F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substr(t, F.lit(2))))
    return t


def fold_key(c: Column) -> Column:
    """Identifier compared without case; blank becomes null."""
    return F.replace(F.lower(clean_text(c.cast("string"))), F.lit("ß"), F.lit("ss"))


def infer_rank(name: Column, index: Column, total: Column) -> Column:
    n = F.lower(name)
    return (F.when(n.isin(KINGDOMS), "kingdom")
            .when(n.rlike("(aceae|idae)$"), "family")
            .when(n.rlike("ales$"), "order")
            .when(n.rlike("(mycota|phyta)$"), "phylum")
            .when(n.rlike("(opsida|phyceae)$"), "class")
            .when((total == 1) | (index > 0), "taxon")
            .otherwise("higherTaxon"))


def keywords_from_scope(c: Column, most: int | None = None) -> Column:
    """Array of (pos, rank, name) from a plain comma list; stops at the first prose-like part."""
    def prose(p):
        return p.rlike(r"[.;:()]") | (F.size(F.split(p, SPACE)) > 3) | (F.length(p) > 80)

    def kept(parts):
        stops = F.transform(parts, lambda p, i: F.when(prose(p), i))
        stop = F.coalesce(F.array_min(stops), F.size(parts))
        return F.slice(parts, F.lit(1), stop if most is None else F.least(stop, F.lit(most)))

    def ranked(names):
        return F.transform(names, lambda p, i: F.struct(
            i.alias("pos"), infer_rank(p, i, F.size(names)).alias("rank"), p.alias("name")))

    parts = F.filter(F.transform(F.split(c, ","), strip), lambda p: p != "")
    return let(let(parts, kept), ranked)
