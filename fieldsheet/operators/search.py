"""Lists, filters, search and lookups."""

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import lookup_key, strip_examples
from ..plans.ranks import slice_of
from ..plans.topk import first_per_key, top_k
from .log import visible_rows

SHALLOW = 10000  # rows in front of and on a page up to which the first rows of all partitions are merged

# Fields that may be filtered by equality.
FILTER_FIELDS = {"datasets": ["created_at", "orcid"], "tables": ["dataset_id", "title"], "messages": ["agent_id", "created_at"],
                 "agents": ["created_at", "completed_at", "dataset_id", "task"], "files": ["dataset_id"], "tasks": None}


def list_datasets(datasets: DataFrame, user_id, is_superuser: bool = False) -> DataFrame:
    return visible_rows(datasets, datasets, user_id, is_superuser).orderBy(F.desc("created_at"), F.desc("dataset_id"))


def list_tables(tables: DataFrame, dataset_id=None) -> DataFrame:
    t = tables if dataset_id is None else tables.filter(F.col("dataset_id") == F.lit(dataset_id))
    return t.orderBy(F.desc("updated_at"), F.desc("table_id"))


def list_files(files: DataFrame, dataset_id=None) -> DataFrame:
    t = files if dataset_id is None else files.filter(F.col("dataset_id") == F.lit(dataset_id))
    return t.orderBy(F.desc("uploaded_at"), F.desc("file_id"))


def filter_equal(t: DataFrame, kind: str, **equals) -> DataFrame:
    """Rows with equal values on the declared fields of ``kind``."""
    allowed = FILTER_FIELDS[kind]
    for field, value in equals.items():
        if allowed is not None and field not in allowed:
            raise ValueError(f"{kind} cannot be filtered by {field}")
        t = t.filter(F.col(field) == F.lit(value))
    return t


def search_text(t: DataFrame, q: str, cols) -> DataFrame:
    """Rows whose fields contain every word of the query, ignoring case."""
    for word in q.split():
        t = t.filter(F.greatest(*[F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(word.lower())), F.lit(False))
                                  for c in cols], F.lit(False)))
    return t


def page_table(t: DataFrame, sort: str, page: int, size: int, descending: bool = False, shallow: int = SHALLOW) -> DataFrame:
    """One page of a sorted table, as shown to a reader; ``row_id`` breaks ties.

    Pages that end within the first ``shallow`` rows take the first rows of every partition. For later
    ones the table is sorted once into files by range, and only the part that holds the page is read.
    """
    order = [F.desc(sort) if descending else F.asc(sort), F.asc("row_id")]
    if (page + 1) * size <= shallow:
        return t.orderBy(*order).offset(page * size).limit(size)
    return slice_of(t, order, page * size, size)


def term_lookup(vocab: DataFrame, requested: DataFrame, examples: bool = True) -> DataFrame:
    """(requested, section, term, definition): requested terms by normalised name, first section wins; null if missing."""
    keyed = vocab.withColumn("_key", lookup_key(F.col("term")))
    first = first_per_key(keyed, ["_key"], ["section_order", "term_order"])
    wanted = requested.withColumn("_key", lookup_key(F.col("requested"))).filter("_key <> ''")
    text = F.col("definition") if examples else strip_examples(F.col("definition"))
    return wanted.join(first, "_key", "left").select("requested", "section", "term", text.alias("definition"))


def section_overview(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("section").agg(F.min("section_order").alias("section_order"), F.count(F.lit(1)).alias("n_terms"))


def section_terms(vocab: DataFrame, section: str, limit: int | None = None) -> DataFrame:
    """Terms of one section in order; with a limit, ``more`` tells how many are not shown."""
    own = vocab.filter(lookup_key(F.col("section")) == re.sub("[^a-z0-9]+", "", section.lower()))
    if limit is None:
        return own.select("section", "term_order", "term", "definition", F.lit(0).cast("bigint").alias("more"))
    total = own.groupBy("section").agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).cast("bigint").alias("more"))
    shown = top_k(own, ["section"], ["term_order"], limit)
    return shown.join(total, "section").select("section", "term_order", "term", "definition", "more")


def age_bucket(at: Column, now: Column) -> Column:
    """Today, Yesterday, N days ago or the date, by started days between two times."""
    days = F.ceil(F.abs(F.unix_micros(now) - F.unix_micros(at)) / F.lit(86400 * 1000000))
    return (F.when(days <= 1, "Today").when(days == 2, "Yesterday")
            .when(days <= 7, F.concat((days - 1).cast("string"), F.lit(" days ago"))).otherwise(F.date_format(at, "yyyy-MM-dd")))


def extension_name(c: Column) -> Column:
    """Lower case, without ``.xml`` and a date suffix."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\.xml$", ""), r"_\d{4}-\d{2}-\d{2}$", "")


def find_extension(names: DataFrame, extensions: DataFrame) -> DataFrame:
    """(name, key): the extension (key, file) a name means, null if none."""
    by_name = extensions.select(F.explode(F.array(F.col("key"), extension_name(F.col("file")))).alias("_n"), "key").distinct()
    return names.withColumn("_n", extension_name(F.col("name"))).join(first_per_key(by_name, ["_n"], ["key"]), "_n", "left").select("name", "key")


