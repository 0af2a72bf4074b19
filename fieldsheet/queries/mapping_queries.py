"""Column names, vocabulary terms, schemas."""

from pyspark.sql import functions as F

from ..operators import mapping, rules
from ..plans.scratch import fresh_path
from ..sources import vocab
from .registry import query

TERM_ROWS = ", ".join(f"('{t}')" for terms in vocab.CLASSES.values() for t in terms)
TERMS = f"terms AS (SELECT * FROM (VALUES {TERM_ROWS}) AS x(term))"
SCHEMA_ROWS = ", ".join(f"({i}, '{s[0]}', '{t}')" for i, s in enumerate(vocab.SCHEMAS) for t in s[5])
SCHEMAS = f"schema_rows AS (SELECT * FROM (VALUES {SCHEMA_ROWS}) AS x(schema_order, schema_key, term))"
CHECKED = """named AS (SELECT table_id, lower(trim(name)) AS key, arg_min(trim(name), pos) AS name FROM columns_of
  WHERE trim(name) <> '' AND lower(trim(name)) NOT LIKE '%id' GROUP BY 1, 2),
 sizes AS (SELECT table_id, count(*) AS n FROM named GROUP BY 1),
 overlap AS (SELECT table_id, schema_order, schema_key, count(*) AS shared, n - count(*) AS foreign_names
  FROM named JOIN schema_rows ON key = lower(term) JOIN sizes USING (table_id) GROUP BY table_id, schema_order, schema_key, n)"""


@query("unique_column_names", """
SELECT table_id, pos, name, CASE WHEN name IS NULL THEN 'NaN (' || CAST(k AS STRING) || ')' WHEN k > 1 THEN name || ' (' || CAST(k AS STRING) || ')' ELSE name END AS new_name
FROM (SELECT *, row_number() OVER (PARTITION BY table_id, name ORDER BY pos) AS k FROM columns_of)""")
def _(d):
    return mapping.unique_column_names(d.view("columns_of"))


@query("integer_headers", "SELECT table_id FROM columns_of GROUP BY 1 HAVING count(*) = count(*) FILTER (regexp_full_match(name, '[0-9]+'))")
def _(d):
    return mapping.integer_headers(d.view("columns_of"))


@query("map_to_dwc_terms", f"""WITH {TERMS} SELECT table_id, pos, name, term, term IS NOT NULL AS matched
FROM columns_of LEFT JOIN terms ON lower(trim(name)) = lower(term)""")
def _(d):
    return mapping.map_to_dwc_terms(d.view("columns_of"), vocab.dwc_terms(d.spark))


@query("column_overlap", f"""WITH {SCHEMAS}, {CHECKED} SELECT table_id, schema_key, shared, foreign_names AS "foreign", foreign_names = 0 AS is_subset FROM overlap""")
def _(d):
    return mapping.column_overlap(d.view("columns_of"), vocab.schema_terms(d.spark)).drop("schema_order", "title")


@query("assess_schema", f"""WITH {SCHEMAS}, {CHECKED},
 best AS (SELECT * FROM overlap QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY foreign_names, shared DESC, schema_order) = 1),
 bad AS (SELECT table_id, string_agg(named.name, '|' ORDER BY named.name) AS invalid FROM named LEFT JOIN best USING (table_id)
  LEFT JOIN schema_rows s ON s.schema_order = best.schema_order AND lower(s.term) = named.key WHERE s.term IS NULL GROUP BY 1)
SELECT t.table_id, CASE WHEN n IS NULL THEN 'skipped' WHEN schema_key IS NULL THEN 'no_match' WHEN foreign_names = 0 THEN 'match' ELSE 'partial' END AS status, schema_key AS "schema", coalesce(invalid, '') AS invalid
FROM (SELECT DISTINCT table_id FROM columns_of) t LEFT JOIN sizes USING (table_id) LEFT JOIN best USING (table_id) LEFT JOIN bad USING (table_id)""")
def _(d):
    return mapping.assess_schema(d.view("columns_of"), vocab.schema_terms(d.spark)).withColumn(
        "invalid", F.coalesce(F.array_join("invalid", "|"), F.lit("")))


@query("quantity_pairing", """SELECT table_id, CASE WHEN q THEN 'organismQuantityType' ELSE 'organismQuantity' END AS missing FROM
 (SELECT table_id, coalesce(bool_or(name = 'organismQuantity'), FALSE) AS q, coalesce(bool_or(name = 'organismQuantityType'), FALSE) AS t FROM columns_of GROUP BY 1) WHERE q <> t""")
def _(d):
    return mapping.quantity_pairing(d.view("columns_of"))


@query("missing_required_columns", """SELECT t.table_id, r.term FROM (SELECT DISTINCT table_id FROM columns_of) t, (VALUES ('scientificName'), ('basisOfRecord'), ('occurrenceID')) AS r(term)
WHERE NOT EXISTS (SELECT 1 FROM columns_of c WHERE c.table_id = t.table_id AND c.name = r.term)""")
def _(d):
    return mapping.missing_required_columns(d.view("columns_of"), rules.REQUIRED_COLUMNS)


@query("suitability", """WITH s AS (SELECT table_id, coalesce(bool_or(n = 'scientificname'), FALSE) AS sci, coalesce(bool_or(n IN ('scientificname', 'vernacularname', 'genus')), FALSE) AS a,
  coalesce(bool_or(n IN ('eventdate', 'year', 'verbatimeventdate')), FALSE) AS b, coalesce(bool_or(n IN ('locality', 'country', 'decimallatitude', 'verbatimlocality')), FALSE) AS c
  FROM (SELECT table_id, lower(trim(name)) AS n FROM columns_of) GROUP BY 1)
SELECT table_id, CASE WHEN a AND b AND c THEN 'occurrence' WHEN sci THEN 'checklist' ELSE 'unsuitable' END AS suitability FROM s""")
def _(d):
    return mapping.suitability(d.view("columns_of"))


@query("select_mapped", "SELECT row_id, basisOfRecord, scientificName, eventDate, country FROM occ")
def _(d):
    t = d.view("occ").select("row_id", "basisOfRecord", "scientificName", "eventDate", "country", "tip_key", "y")
    return mapping.select_mapped(t, vocab.terms_of("occurrence"), keep=["row_id"])


@query("ensure_identifier", """WITH h AS (SELECT row_id, sha256('{"dataset_id":' || CAST(dataset_id AS STRING) || ',"table_id":' || CAST(table_id AS STRING) || ',"row_id":' || CAST(row_id AS STRING) || '}') AS h FROM occ)
SELECT row_id, substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) || '-' || substr(h,21,12) AS eventID FROM h""")
def _(d):
    t, name = mapping.ensure_identifier(d.view("occ").select("dataset_id", "table_id", "row_id", "country"), "eventID")
    return t.select("row_id", name)


@query("rename_columns", "SELECT l_orderkey AS eventID, l_linenumber AS fieldNumber, l_returnflag AS measurementType FROM lineitem")
def _(d):
    t = mapping.rename_columns(d.table("lineitem"), {"l_orderkey": "eventID", "l_linenumber": "fieldNumber", "l_returnflag": "measurementType"})
    return t.select("eventID", "fieldNumber", "measurementType")


@query("add_constant_columns", "SELECT p_partkey, p_name, 'PreservedSpecimen' AS basisOfRecord, 'WGS84' AS geodeticDatum FROM part")
def _(d):
    return mapping.add_constant_columns(d.table("part").select("p_partkey", "p_name"),
                                        {"basisOfRecord": "PreservedSpecimen", "geodeticDatum": "WGS84"})


@query("drop_columns", "SELECT c_custkey, c_name FROM customer")
def _(d):
    return mapping.drop_columns(d.table("customer"), "c_nationkey", "c_acctbal", "c_mktsegment")


@query("rename_to_terms", "SELECT row_id, country AS country, recordedBy AS recordedBy FROM occ")
def _(d):
    t = d.view("occ").select("row_id", F.col("country").alias("COUNTRY"), F.col("recordedBy").alias(" RecordedBy "))
    return mapping.rename_to_terms(t, vocab.terms_of("occurrence"))


@query("load_schema_terms", """SELECT 'http://example.org/rows/' || CAST(p_partkey // 1000 AS STRING) AS row_type, p_partkey % 1000 AS pos, p_type || CAST(p_partkey AS STRING) AS name, 'http://example.org/terms/' || p_type AS uri
FROM part WHERE p_size % 10 <> 0""")
def _(d):
    prop = F.concat(F.lit('<property name="'), F.col("p_type"), F.col("p_partkey").cast("string"), F.lit('" qualName="'),
                    F.when(F.col("p_size") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("http://example.org/terms/"), F.col("p_type"))), F.lit('"/>'))
    spec = d.table("part").select(F.floor(F.col("p_partkey") / 1000).cast("string").alias("k"), (F.col("p_partkey") % 1000).alias("i"), prop.alias("p"))
    docs = spec.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "p"))).alias("l")).select(F.concat(
        F.lit('<extension rowType="http://example.org/rows/'), F.col("k"), F.lit('">'), F.array_join(F.col("l.p"), ""), F.lit("</extension>")).alias("value"), "k")
    path = fresh_path(d.spark, "schema-files")
    docs.write.partitionBy("k").text(path)  # one document per file
    return vocab.load_schema_terms(d.spark, path).withColumn("pos", F.col("pos").cast("bigint"))


CLEAN = r"""trim(regexp_replace(replace(regexp_replace({x}, '<[^>]+>', '', 'g'), 'Egs -', 'Examples:'), '[\s\x{{00a0}}]+', ' ', 'g'))"""
UNESC = "replace(replace(replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&#34;', '\"'), '&nbsp;', ' '), '&amp;', '&')"


@query("load_vocabulary", "SELECT url AS section, 'term' || CAST(page_id AS STRING) AS term, " + CLEAN.format(x=UNESC.format(x="html || ' Egs - a / b'"))
       + " AS definition FROM pages WHERE page_id % 7 <> 0")
def _(d):
    raw = d.sql("SELECT concat(' ', url) AS section, CASE WHEN page_id % 7 = 0 THEN ' ' ELSE concat('term', CAST(page_id AS STRING), ' ') END AS term, concat(html, ' Egs - a / b') AS definition FROM pages")
    return vocab.load_vocabulary(raw)


TITLE = r"regexp_extract(html, '<title>(.*?)</title>', 1)"
TERM_PAGE = r"""concat('intro\n## Section one\n<table class="table">\n<tbody>\n<tr class="table-primary"><th colspan="2"><a href="x">Term', CAST(page_id AS STRING), '</a> Class</th></tr>\n<tr><td>Definition</td><td>', regexp_extract(html, '<title>(.*?)</title>', 1), '</td></tr>\n<tr><td>Examples</td><td><code>', url, '</code> or <code> b </code></td></tr>\n</tbody></table>\n## Cite Darwin Core\n<table class="table"><tbody><tr class="table-primary"><th colspan="2">No</th></tr></tbody></table>\n## Section two\n<table class="table"><tbody><tr class="table-secondary"><th colspan="2">other</th></tr><tr><td>Examples</td><td><b>plain</b></td></tr></tbody></table>\n', html)"""


@query("extract_term_tables", f"""SELECT page_id, 'Section one' AS section, 'Term' || CAST(page_id AS STRING) AS term, {UNESC.format(x="trim(regexp_replace(" + TITLE + ", '<[^>]+>', '', 'g'))")} AS definition, {UNESC.format(x="url")} || '|b' AS examples FROM pages
UNION ALL SELECT page_id, 'Section two', 'other', '', 'plain' FROM pages""")
def _(d):
    pages = d.sql("SELECT page_id, " + TERM_PAGE + " AS content FROM pages")
    return vocab.extract_term_tables(pages).withColumn("examples", F.array_join("examples", "|"))


TERM_LINES = r"""concat('# Guide\n\n## Section one\n\nterm', CAST(doc_id AS STRING), '\n\nIdentifier  http://x\nDefinition ', replace(text, '\n', ' '), '\nExamples\n* `', source, '`\n- `b` and `c`\nsecondTerm\nIdentifier y\nExamples `', lang, '`\n')"""


@query("extract_term_lines", r"""SELECT doc_id AS page_id, 'Section one' AS section, 'term' || CAST(doc_id AS STRING) AS term, trim(replace(text, chr(10), ' '), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS definition, source || '|b|c' AS examples FROM documents
UNION ALL SELECT doc_id, 'Section one', 'secondTerm', '', lang FROM documents""")
def _(d):
    pages = d.sql("SELECT doc_id AS page_id, " + TERM_LINES + " AS content FROM documents")
    return vocab.extract_term_lines(pages).withColumn("examples", F.array_join("examples", "|"))
