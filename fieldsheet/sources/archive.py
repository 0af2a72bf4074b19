"""Darwin Core archives: descriptors, checks and writing."""

from html import escape

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import fold_key
from .vocab import DWC, SCHEMAS, uri_of


def archive_meta(columns: DataFrame, assigned: DataFrame, schema_terms: DataFrame) -> DataFrame:
    """(table_id, schema_key, row_type, index, term, uri, is_id): the archive columns of every table.

    ``assigned`` is (table_id, schema_key). Only headers of the schema and its identifier stay, in
    their order; ``is_id`` marks the identifier column. Columns meet by table and are grouped there, so a task holds some tables only.
    """
    own = ["schema_key", "row_type", "id_column"]
    terms = schema_terms.select(*own, F.lower("term").alias("_k"), "term", "uri")
    ids = schema_terms.filter("id_column IS NOT NULL").select(*own, F.lower("id_column").alias("_k"), F.col("id_column").alias("term")).distinct()
    # an identifier that is no term of its schema is a Darwin Core term
    ids = ids.join(terms.select("schema_key", "_k"), ["schema_key", "_k"], "left_anti").withColumn("uri", F.concat(F.lit(DWC), "term"))
    allowed = terms.unionByName(ids).distinct()
    named = columns.withColumn("_k", F.lower(F.trim("name"))).join(assigned.hint("merge"), "table_id")
    kept = named.join(allowed, ["schema_key", "_k"])
    first = kept.groupBy("table_id", "schema_key", "row_type", "id_column", "term", "uri").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(W.partitionBy("table_id").orderBy("pos")) - 1  # the columns of one header
    return first.select("table_id", "schema_key", "row_type", place.cast("bigint").alias("index"), "term", "uri",
                        F.coalesce(F.col("term") == F.col("id_column"), F.lit(False)).alias("is_id"))


def check_archive_plan(plan: DataFrame, registry: DataFrame, schemas: DataFrame) -> DataFrame:
    """(dataset_id, table_id, error) of archive plans.

    ``plan`` is (dataset_id, core_table_id, core_type, extensions) with a map from table id to type;
    ``schemas`` is (schema_key, kind).
    """
    core = plan.select("dataset_id", F.col("core_table_id").alias("table_id"), F.col("core_type").alias("schema_key"))
    ext = plan.select("dataset_id", "core_table_id", F.explode("extensions").alias("table_id", "schema_key"))
    own = registry.select("dataset_id", "table_id").distinct()
    kinds = schemas.select("schema_key", "kind").distinct()

    def foreign(t, what):
        return t.join(own, ["dataset_id", "table_id"], "left_anti").select(
            "dataset_id", "table_id", F.lit(f"{what} table does not belong to the dataset").alias("error"))

    def unknown(t, kind):
        return t.join(kinds.filter(F.col("kind") == kind), "schema_key", "left_anti").select(
            "dataset_id", "table_id", F.lit(f"unknown {kind} type").alias("error"))

    both = ext.filter("table_id = core_table_id").select("dataset_id", "table_id", F.lit("core table is also an extension").alias("error"))
    return foreign(core, "core").unionByName(foreign(ext, "extension")).unionByName(both).unionByName(
        unknown(core, "core")).unionByName(unknown(ext, "extension"))


def colliding_ids(t: DataFrame, id_col: str, keys: int = 5) -> DataFrame:
    """The first identifiers that occur more than once ignoring case."""
    counts = t.select(fold_key(F.col(id_col)).alias("id_key")).filter("id_key IS NOT NULL").groupBy("id_key").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("n > 1").orderBy("id_key").limit(keys)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark, path: str, text: str):
    _, p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def _copy(spark, source: str, folder: str):
    jvm, src, src_fs = _fs(spark, source)
    _, dst, dst_fs = _fs(spark, f"{folder}/{src.getName()}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(src_fs, src, dst_fs, dst, False, spark._jsc.hadoopConfiguration())


def _write_table(t: DataFrame, folder: str, name: str) -> list[str]:
    """The table as tab separated part files; returns their names relative to the archive.

    Tabs and line breaks inside a value, which the format cannot hold, become one blank; other blanks stay.
    """
    flat = [F.regexp_replace(F.col(f"`{c}`").cast("string"), r"[\t\r\n]+", " ").alias(c) for c in t.columns]
    t.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option(
        "emptyValue", "").option("nullValue", "").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/{name}")
    _, p, fs = _fs(t.sparkSession, f"{folder}/{name}")
    return sorted(f"{name}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))


def _descriptor(tag: str, id_tag: str, row_type: str, files, terms, id_index: int) -> str:
    places = "".join(f"      <location>{escape(f)}</location>\n" for f in files)
    fields = "".join(f'    <field index="{i}" term="{escape(u)}"/>\n' for i, u in enumerate(terms) if u)
    return (f'  <{tag} encoding="UTF-8" fieldsTerminatedBy="\\t" linesTerminatedBy="\\n" fieldsEnclosedBy="" ignoreHeaderLines="1" '
            f'rowType="{escape(row_type)}">\n    <files>\n{places}    </files>\n    <{id_tag} index="{id_index}"/>\n{fields}  </{tag}>\n')


def write_archive(core: DataFrame, core_type: str, extensions: dict[str, DataFrame], eml: str, path: str, extra=(),
                  core_id: str | None = None) -> str:
    """Write an archive folder: data files, ``meta.xml``, ``eml.xml`` and extra files. Returns the path.

    Only columns of each schema are written, the linking identifier first. Identifiers of the core
    must be unique ignoring case. Data files are written in parallel and every part is listed in
    ``meta.xml``. The folder may be on any Hadoop file system.
    """
    spark = core.sparkSession
    schemas = {s[0]: s for s in SCHEMAS}
    _, _, _, row_type, id_column, terms = schemas[core_type]
    by_lower = {c.lower(): c for c in core.columns}
    link = core_id or by_lower.get((id_column or "id").lower()) or by_lower["id"]
    clash = [r["id_key"] for r in colliding_ids(core, link).collect()]
    if clash:
        raise ValueError(f"{link} must be unique ignoring case; repeated: {', '.join(clash)}")

    def mapped(kind, t, allowed, id_name):
        spelled = {a.lower(): a for a in allowed}
        own = [(c, spelled[c.lower()]) for c in t.columns if c.lower() in spelled and c != id_name]
        as_term = [uri_of(kind, spelled[id_name.lower()])] if id_name.lower() in spelled else [None]
        return t.select(id_name, *[F.col(c).alias(n) for c, n in own]), as_term + [uri_of(kind, n) for _, n in own]

    data, uris = mapped(core_type, core, terms, link)
    meta = [_descriptor("core", "id", row_type, _write_table(data, path, core_type), uris, 0)]
    for kind, t in extensions.items():
        _, _, _, ext_row, _, ext_terms = schemas[kind]
        id_name = next(c for c in t.columns if c.lower() == link.lower())
        ext_data, ext_uris = mapped(kind, t, ext_terms, id_name)
        meta.append(_descriptor("extension", "coreid", ext_row, _write_table(ext_data, path, kind), ext_uris, 0))
    _put(spark, f"{path}/meta.xml", '<archive xmlns="http://rs.tdwg.org/dwc/text/" metadata="eml.xml">\n' + "".join(meta) + "</archive>\n")
    _put(spark, f"{path}/eml.xml", eml)
    for source in extra:
        _copy(spark, source, path)
    return path


