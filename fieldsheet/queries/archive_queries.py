"""Archives, EML, streams."""

from pyspark.sql import functions as F

from ..operators import eml, mapping
from ..plans.scratch import fresh_path, materialize
from ..sources import archive, vocab
from ..streaming import ingest, validate
from .mapping_queries import SCHEMAS
from .registry import query
from .rule_queries import BAD, fixed_day

ASSIGNED = "SELECT p_partkey AS table_id, CASE p_partkey % 6 WHEN 3 THEN 'event' WHEN 4 THEN 'taxon' WHEN 5 THEN 'measurement_or_fact' ELSE 'occurrence' END AS schema_key FROM part"
ID_ROWS = ", ".join(f"('{s[0]}', '{s[3]}', " + (f"'{s[4]}'" if s[4] else "NULL") + ")" for s in vocab.SCHEMAS)
ROWS_A_FILE = 500_000
DC = ", ".join(f"'{t}'" for t in vocab.DUBLIN_CORE_TERMS)


@query("archive_meta", f"""WITH {SCHEMAS}, ids AS (SELECT * FROM (VALUES {ID_ROWS}) AS i(schema_key, row_type, id_column)),
 allowed AS (SELECT schema_key, term FROM schema_rows UNION SELECT schema_key, id_column FROM ids WHERE id_column IS NOT NULL),
 k AS (SELECT table_id, schema_key, row_type, term, coalesce(term = id_column, FALSE) AS is_id, min(pos) AS pos FROM columns_of JOIN ({ASSIGNED}) USING (table_id) JOIN allowed USING (schema_key) JOIN ids USING (schema_key) WHERE lower(trim(name)) = lower(term) GROUP BY ALL)
SELECT table_id, schema_key, row_type, row_number() OVER (PARTITION BY table_id ORDER BY pos) - 1 AS "index", term, CASE WHEN term IN ({DC}) THEN 'http://purl.org/dc/terms/' ELSE 'http://rs.tdwg.org/dwc/terms/' END || term AS uri, is_id FROM k""")
def _(d):
    return archive.archive_meta(d.view("columns_of"), d.sql(ASSIGNED), vocab.schema_terms(d.spark))


PLAN = """SELECT user_id AS dataset_id, event_id AS core, CASE WHEN event_id % 8 = 0 THEN event_id ELSE event_id + 1 END AS ext, CASE event_type WHEN 'click' THEN 'occurrence' WHEN 'view' THEN 'event' WHEN 'error' THEN 'nonsense' ELSE 'taxon' END AS core_type,
 CASE WHEN event_id % 3 = 0 THEN 'measurement_or_fact' WHEN event_id % 3 = 1 THEN 'releve' ELSE 'occurrence' END AS ext_type FROM events"""


@query("check_archive_plan", f"""WITH p AS ({PLAN}) SELECT p.dataset_id, ext AS table_id, 'extension table does not belong to the dataset' AS error FROM p LEFT JOIN registry_log r ON r.dataset_id = p.dataset_id AND r.table_id = ext WHERE r.table_id IS NULL
UNION ALL SELECT dataset_id, ext, 'core table is also an extension' FROM p WHERE ext = core UNION ALL SELECT dataset_id, core, 'unknown core type' FROM p WHERE core_type = 'nonsense' UNION ALL SELECT dataset_id, ext, 'unknown extension type' FROM p WHERE ext_type = 'occurrence'""")
def _(d):
    plan = d.sql(PLAN).select("dataset_id", F.col("core").alias("core_table_id"), "core_type", F.create_map("ext", "ext_type").alias("extensions"))
    return archive.check_archive_plan(plan, d.view("registry_log"), vocab.schema_terms(d.spark))


@query("write_archive", """SELECT 'core' AS part, 'r-' || CAST(row_id AS STRING) AS id, scientificName AS value FROM occ
UNION ALL SELECT 'extension', 'r-' || CAST(l_orderkey AS STRING), measurementType FROM mof""")
def _(d):
    """The whole archive written, then its data files read back as a consumer would."""
    core = d.view("occ").withColumn("occurrenceID", F.concat(F.lit("r-"), F.col("row_id").cast("string"))).select(
        "occurrenceID", "basisOfRecord", "scientificName", "eventDate", "country", "tip_key")
    ext = d.view("mof").select(F.concat(F.lit("r-"), F.col("l_orderkey").cast("string")).alias("occurrenceID"),
                               "measurementType", "measurementValue", "measurementUnit")
    path = archive.write_archive(core, "occurrence", {"measurement_or_fact": ext}, "<eml/>", fresh_path(d.spark, "archive"))

    def back(kind, part, value):
        t = d.spark.read.option("header", True).option("sep", "\t").csv(f"{path}/{kind}")
        return t.select(F.lit(part).alias("part"), F.col("occurrenceID").alias("id"), F.col(value).alias("value"))

    return back("occurrence", "core", "scientificName").unionByName(back("measurement_or_fact", "extension", "measurementType"))


def _meta(d):
    users = "CASE WHEN c_custkey % 3 = 0 THEN array(named_struct('first_name', c_mktsegment, 'last_name', c_name, 'email', 'a@example.org', 'orcid', ' 0000 '), named_struct('first_name', '', 'last_name', 'Second', 'email', '', 'orcid', '')) END"
    return d.sql(f"""SELECT c_custkey AS dataset_id, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN concat('About <', c_mktsegment, '> & more') END AS description,
      CASE c_custkey % 4 WHEN 0 THEN '17 - 22 October 2025' WHEN 1 THEN '2019-02' END AS temporal_scope, CASE c_custkey % 3 WHEN 0 THEN 'lat 10 S to 20 N, lon 5 W to 7 E' WHEN 1 THEN 'Norway' END AS geographic_scope,
      CASE WHEN c_custkey % 7 = 0 THEN 'Plantae, Fabaceae' END AS taxonomic_scope, CASE WHEN c_custkey % 5 = 0 THEN 'My project' END AS project_title, CASE WHEN c_custkey % 6 = 0 THEN 'doi:10.1/x' END AS manuscript_doi,
      CASE WHEN c_custkey % 8 = 0 THEN 'Cite me' END AS dataset_citation, CASE WHEN c_custkey % 9 = 0 THEN 'c@example.org' END AS contact_email, {users} AS users FROM customer""")


def _owners(d):
    return d.sql("SELECT c_custkey AS dataset_id, c_mktsegment AS first_name, '' AS last_name, concat(c_mktsegment, '@example.org') AS email, '0000-1' AS orcid FROM customer WHERE c_mktsegment <> 'MACHINERY'")


@query("eml_documents")
def _(d):
    return eml.eml_documents(_meta(d), _owners(d), F.lit("2024-05-01").cast("date"), F.lit("2024-05-01 00:00:00").cast("timestamp"))


def _person_rows(kind, given, sur, email, orcid, where, pos="0", role=None):
    """SQL rows of one person; parts that are null are left out."""
    parts = [("individualName/givenName", given), ("individualName/surName", sur), ("electronicMailAddress", email),
             ("userId/_directory", f"CASE WHEN {orcid} IS NOT NULL THEN 'https://orcid.org/' END"), ("userId/_VALUE", orcid), ("role", f"'{role}'" if role else "NULL")]
    return [f"SELECT k, 'dataset/{kind}[{pos}]/{path}', {value} FROM c WHERE {where}" for path, value in parts]


def _eml_rows():
    one = [("_packageId", "'dataset-' || CAST(k AS STRING) || '/v1'"), ("dataset/alternateIdentifier", "CASE WHEN k % 6 = 0 THEN 'https://doi.org/10.1/x' END"),
           ("dataset/title/_xml:lang", "'eng'"), ("dataset/title/_VALUE", "c_name"), ("dataset/pubDate", "'2024-05-01'"), ("dataset/language", "'eng'"),
           ("dataset/abstract/para", "CASE WHEN k % 2 = 0 THEN 'About <' || c_mktsegment || '> & more' END"),
           ("dataset/intellectualRights/para/ulink/_url", "'http://creativecommons.org/licenses/by/4.0/legalcode'"),
           ("dataset/intellectualRights/para/ulink/citetitle", "'Creative Commons Attribution (CC-BY) 4.0 License'")]
    place = "dataset/coverage/geographicCoverage/"
    one += [(place + path, f"CASE WHEN k % 3 = 0 THEN '{value}' END") for path, value in (
        ("geographicDescription", "lat 10 S to 20 N, lon 5 W to 7 E"), ("boundingCoordinates/westBoundingCoordinate", "-5"), ("boundingCoordinates/eastBoundingCoordinate", "7"),
        ("boundingCoordinates/northBoundingCoordinate", "20"), ("boundingCoordinates/southBoundingCoordinate", "-10"))]
    time = "dataset/coverage/temporalCoverage/"
    one += [(time + "singleDateTime/calendarDate", "CASE WHEN k % 4 = 1 THEN '2019-02-01' END"), (time + "rangeOfDates/beginDate/calendarDate", "CASE WHEN k % 4 = 0 THEN '2025-10-17' END"),
            (time + "rangeOfDates/endDate/calendarDate", "CASE WHEN k % 4 = 0 THEN '2025-10-22' END")]
    taxa = "dataset/coverage/taxonomicCoverage/"
    one += [(taxa + path, f"CASE WHEN k % 7 = 0 THEN '{value}' END") for path, value in (
        ("generalTaxonomicCoverage", "Plantae, Fabaceae"), ("taxonomicClassification[0]/taxonRankName", "kingdom"), ("taxonomicClassification[0]/taxonRankValue", "Plantae"),
        ("taxonomicClassification[1]/taxonRankName", "family"), ("taxonomicClassification[1]/taxonRankValue", "Fabaceae"))]
    more = "additionalMetadata/metadata/gbif/"
    one += [("dataset/project/title", "CASE WHEN k % 5 = 0 THEN 'My project' END")]
    one += [(more + path, f"CASE WHEN k % 8 = 0 THEN '{value}' END") for path, value in (("dateStamp", "2024-05-01T00:00:00Z"), ("hierarchyLevel", "dataset"), ("citation", "Cite me"))]
    there = [("alternateIdentifier", "k % 6 = 0"), *[(c, "TRUE") for c in ("title", "creator", "metadataProvider", "pubDate", "language")], ("abstract", "k % 2 = 0"), ("intellectualRights", "TRUE"),
             ("coverage", "(k % 3 = 0 OR k % 4 < 2 OR k % 7 = 0)"), ("contact", "TRUE"), ("project", "k % 5 = 0")]
    one.append(("children", "concat_ws(',', " + ", ".join(f"CASE WHEN {when} THEN '{c}' END" for c, when in there) + ")"))
    rows = [f"SELECT k, '{path}', {value} FROM c" for path, value in one]
    owner = ("first_name", "last_name", "email", "orcid")
    rows += _person_rows("creator", "c_mktsegment", "c_name", "'a@example.org'", "'0000'", "k % 3 = 0") + _person_rows("creator", "NULL", "'Second'", "NULL", "NULL", "k % 3 = 0", "1")
    rows += _person_rows("creator", *owner, "k % 3 <> 0") + _person_rows("metadataProvider", *owner, "TRUE")
    rows += _person_rows("contact", "first_name", "last_name", "CASE WHEN k % 9 = 0 THEN 'c@example.org' ELSE email END", "orcid", "TRUE")
    rows += _person_rows("project/personnel", "c_mktsegment", "c_name", "NULL", "'0000'", "k % 15 = 0", role="metadataProvider")
    rows += _person_rows("project/personnel", "NULL", "'Second'", "NULL", "NULL", "k % 15 = 0", "1", "metadataProvider")
    return " UNION ALL ".join(rows)


# the parts of the documents that follow from a row, read back from the XML text
@query("eml_content", """SELECT c_custkey AS dataset_id, c_name AS title, CASE WHEN c_custkey % 6 = 0 THEN 'https://doi.org/10.1/x' ELSE '' END AS doi,
 CASE c_custkey % 4 WHEN 0 THEN '2025-10-17' ELSE '' END AS begins, CASE c_custkey % 3 WHEN 0 THEN '-10' ELSE '' END AS south, c_custkey % 5 = 0 AS has_project, c_custkey % 8 = 0 AS has_citation,
 CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS n_creators, c_custkey % 7 = 0 AS has_taxa FROM customer""")
def _(d):
    doc = eml.eml_documents(_meta(d), _owners(d), F.lit("2024-05-01").cast("date"), F.lit("2024-05-01 00:00:00").cast("timestamp"))

    def first(pattern):
        return F.regexp_extract("eml", pattern, 1)

    return doc.select("dataset_id", first('<title xml:lang="eng">([^<]*)</title>').alias("title"), first("<alternateIdentifier>([^<]*)<").alias("doi"),
                      first(r"<beginDate>\s*<calendarDate>([^<]*)<").alias("begins"), first("<southBoundingCoordinate>([^<]*)<").alias("south"),
                      F.contains("eml", F.lit("<project>")).alias("has_project"), F.contains("eml", F.lit("<citation>Cite me</citation>")).alias("has_citation"),
                      F.size(F.regexp_extract_all("eml", F.lit("(<creator>)"), F.lit(1))).alias("n_creators"),
                      F.contains("eml", F.lit("<taxonRankName>family</taxonRankName>")).alias("has_taxa"))


OWNER = "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Test' ELSE c_mktsegment END AS first_name, 'User' AS last_name, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment || '@example.org' END AS email, CASE WHEN c_mktsegment = 'MACHINERY' THEN '0000-0002-1825-0097' ELSE '0000-1' END AS orcid"


@query("eml_fields", f"WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment, {OWNER} FROM customer), f(dataset_id, path, value) AS ({_eml_rows()}) SELECT * FROM f WHERE value IS NOT NULL")
def _(d):
    """Every text of every document, and the order of its elements, read back from the XML."""
    return eml.eml_fields(eml.eml_documents(_meta(d), _owners(d), F.lit("2024-05-01").cast("date"), F.lit("2024-05-01 00:00:00").cast("timestamp")))


@query("eml_people", f"""WITH o AS (SELECT c_custkey, {OWNER} FROM customer), u AS (SELECT c_custkey, 0 AS pos, c_mktsegment AS first_name, c_name AS last_name, 'a@example.org' AS email, '0000' AS orcid FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 1, NULL, 'Second', NULL, NULL FROM customer WHERE c_custkey % 3 = 0)
SELECT c_custkey AS dataset_id, 'creator' AS kind, pos, first_name, last_name, email, orcid FROM u UNION ALL SELECT c_custkey, 'creator', 0, first_name, last_name, email, orcid FROM o WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 'metadataProvider', 0, first_name, last_name, email, orcid FROM o UNION ALL SELECT c_custkey, 'contact', 0, first_name, last_name, CASE WHEN c_custkey % 9 = 0 THEN 'c@example.org' ELSE email END, orcid FROM o
UNION ALL SELECT c_custkey, 'personnel', pos, first_name, last_name, NULL, orcid FROM u WHERE c_custkey % 5 = 0""")
def _(d):
    return eml.eml_people(_meta(d), _owners(d))


def _files(rows, least):
    """Number of files to write a table of arriving rows to, so that no task of a writer or reader grows with it."""
    return max(least, rows.count() // ROWS_A_FILE)


@query("stream_ingest_files", "SELECT event_id, user_id, event_type, value FROM events")
def _(d):
    """Events written as files, which a stream then takes in, a few files per batch."""
    source, target, check = (fresh_path(d.spark, n) for n in ("incoming", "ingested", "checkpoint"))
    events = d.table("events")
    n = _files(events, 6)
    events.repartition(n, "event_id").write.parquet(source)
    rows = ingest.stream_ingest_files(d.spark, source, events.schema, target, check, files_per_batch=-(-n // 3))
    return rows.select("event_id", "user_id", "event_type", "value")


CHECKED = "SELECT strftime(make_timestamp(y, m, d, 0, 0, 0.0), '%Y-%m-%d') AS day, rule, count(*) AS bad_rows FROM (" + " UNION ALL ".join(
    f"SELECT y, m, d, '{r}' AS rule FROM occ WHERE {bad}" for r, bad in BAD.items()) + """
 UNION ALL SELECT y, m, d, 'catalogNumber' FROM occ QUALIFY count(*) OVER (PARTITION BY dataset_id, table_id, catalogNumber) > 1
 UNION ALL SELECT y, m, d, 'occurrenceID' FROM occ WHERE trim(occurrenceID) <> '' QUALIFY count(*) OVER (PARTITION BY dataset_id, table_id, lower(trim(occurrenceID))) > 1) GROUP BY ALL"""


@query("stream_validate", CHECKED)
def _(d):
    """Occurrence records as a stream of files; the counts equal those of a batch run."""
    source, target, check = (fresh_path(d.spark, n) for n in ("records", "counts", "checkpoint"))
    occ = d.view("occ").withColumn("seen_at", F.make_timestamp("y", "m", "d", F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")))
    n = _files(d.table("orders"), 4)  # a record is an order
    occ.repartition(n, "row_id").write.parquet(source)
    stream = ingest.file_stream(d.spark, source, occ.schema, files_per_batch=-(-n // 2))
    counts = validate.run_validation(stream, "seen_at", "36500 days", target, check, fixed_day())
    return counts.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# a batch leaves out what lay behind the watermark that the batch before it ran with: two files back
ARRIVING = "SELECT *, CAST(row_id % 4 AS INT) AS part FROM occ"
LATE = ("WITH f AS (SELECT part, make_timestamp(y, m, d, 0, 0, 0.0) AS day, rule FROM (" + " UNION ALL ".join(
    f"SELECT CAST(row_id % 4 AS INT) AS part, y, m, d, '{r}' AS rule FROM occ WHERE {bad}" for r, bad in BAD.items()) + ")),"
    " seen AS (SELECT p.part, max(f.day) - INTERVAL 2000 DAY AS closed FROM (SELECT DISTINCT part FROM f) p JOIN f ON f.part < p.part - 1 GROUP BY p.part),"
    " judged AS (SELECT f.*, coalesce(day + INTERVAL 1 DAY <= closed, FALSE) AS late FROM f LEFT JOIN seen USING (part))"
    " SELECT strftime(day, '%Y-%m-%d') AS day, rule, count(*) FILTER (NOT late) AS bad_rows, count(*) FILTER (late) AS late_rows FROM judged GROUP BY ALL")


@query("stream_late_rows", LATE)
def _(d):
    """Four batches that arrive one after the other, each of as many files; from the third on the oldest days are closed."""
    source, target, check = (fresh_path(d.spark, n) for n in ("arriving", "late", "checkpoint"))
    occ = d.sql(ARRIVING).withColumn("seen_at", F.make_timestamp("y", "m", "d", F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")))
    occ = materialize(occ, "records")  # read once for every batch
    n = _files(d.table("orders"), 4) // 4
    for part in range(4):
        occ.filter(F.col("part") == part).repartition(n, "row_id").write.mode("append").parquet(source)
    stream = ingest.file_stream(d.spark, source, occ.schema, files_per_batch=n)
    rows = validate.validate_with_late(stream, "seen_at", "2000 days", target, check, fixed_day())
    return rows.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("stream_unique", "SELECT DISTINCT user_id FROM events")
def _(d):
    source, target, check = (fresh_path(d.spark, n) for n in ("visits", "first-visits", "checkpoint"))
    events = d.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    n = _files(events, 4)
    events.repartition(n, "event_id").write.parquet(source)
    stream = ingest.file_stream(d.spark, source, events.schema, files_per_batch=-(-n // 2))
    first = validate.stream_unique(stream, "user_id", "ts", "400 days")
    first.select("user_id").writeStream.format("parquet").option("path", target).option("checkpointLocation", check).trigger(
        availableNow=True).start().awaitTermination()
    return d.spark.read.schema("user_id bigint").parquet(target)
