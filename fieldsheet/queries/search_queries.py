"""Lists, filters and lookups."""

from pyspark.sql import functions as F

from ..operators import search
from .registry import query


@query("list_datasets", "SELECT dataset_id, user_id, title FROM datasets_of WHERE user_id = 3")
def _(d):
    return search.list_datasets(d.view("datasets_of"), 3).select("dataset_id", "user_id", "title")


@query("list_tables", "SELECT * FROM registry_log WHERE dataset_id = 17")
def _(d):
    return search.list_tables(d.view("registry_log"), 17)


@query("list_files", "SELECT file_id, dataset_id, path, uploaded_at FROM files_of")
def _(d):
    return search.list_files(d.view("files_of")).drop("content")


@query("filter_equal", "SELECT * FROM registry_log WHERE dataset_id = 17 AND title = 'click'")
def _(d):
    return search.filter_equal(d.view("registry_log"), "tables", dataset_id=17, title="click")


@query("search_text", "SELECT doc_id, source FROM documents WHERE (lower(text) LIKE '%the%' OR lower(source) LIKE '%the%') AND (lower(text) LIKE '%src1%' OR lower(source) LIKE '%src1%')")
def _(d):
    return search.search_text(d.table("documents"), "The src1", ["text", "source"]).select("doc_id", "source")


@query("page_table", "SELECT row_id, recordedBy, country FROM occ ORDER BY recordedBy DESC, row_id LIMIT 50 OFFSET 100")
def _(d):
    return search.page_table(d.view("occ").select("row_id", "recordedBy", "country"), "recordedBy", 2, 50, True)


ASKED = "SELECT concat(' term ', lang, '-', CAST(doc_id % 120 AS STRING)) AS requested FROM documents UNION ALL SELECT '??' FROM region"


@query("page_table_deep", "SELECT row_id, recordedBy, country FROM occ ORDER BY recordedBy, row_id LIMIT 40 OFFSET (SELECT 40 * CAST(floor(count(*) / 80) AS BIGINT) FROM occ)")
def _(d):
    """The page in the middle of the table: sorted files, of which only those of the page are read."""
    occ = d.view("occ").select("row_id", "recordedBy", "country")
    return search.page_table(occ, "recordedBy", occ.count() // 80, 40, shallow=100)


@query("term_lookup", f"""WITH v AS (SELECT regexp_replace(lower(term), '[^a-z0-9]+', '', 'g') AS k, section, term, definition FROM vocab_of QUALIFY row_number() OVER (PARTITION BY k ORDER BY section_order, term_order) = 1),
 a AS (SELECT requested, regexp_replace(lower(requested), '[^a-z0-9]+', '', 'g') AS k FROM ({ASKED}))
SELECT requested, section, term, trim(split_part(definition, ' Examples:', 1), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS definition FROM a LEFT JOIN v USING (k) WHERE k <> ''""")
def _(d):
    return search.term_lookup(d.view("vocab_of"), d.sql(ASKED), examples=False)


@query("section_overview", "SELECT section, min(section_order) AS section_order, count(*) AS n_terms FROM vocab_of GROUP BY 1")
def _(d):
    return search.section_overview(d.view("vocab_of"))


@query("section_terms", "SELECT section, term_order, term, definition, greatest(count(*) OVER () - 10, 0) AS more FROM vocab_of WHERE section = 'src3' ORDER BY term_order LIMIT 10")
def _(d):
    return search.section_terms(d.view("vocab_of"), "SRC-3", 10)


@query("age_bucket", """WITH t AS (SELECT event_id, ts, CAST(ceil(abs(epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts)) / 86400000000.0) AS BIGINT) AS n FROM events)
SELECT event_id, CASE WHEN n <= 1 THEN 'Today' WHEN n = 2 THEN 'Yesterday' WHEN n <= 7 THEN CAST(n - 1 AS STRING) || ' days ago' ELSE strftime(ts, '%Y-%m-%d') END AS age FROM t""")
def _(d):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return d.table("events").select("event_id", search.age_bucket(F.col("ts").cast("timestamp"), now).alias("age"))


EXTENSIONS = "SELECT lower(c_name) AS key, concat('Ext_', CAST(c_custkey AS STRING), '_2022-02-02.xml') AS file FROM customer"
WANTED = "SELECT CASE o_orderkey % 4 WHEN 0 THEN concat('EXT_', CAST(o_custkey AS STRING)) WHEN 1 THEN concat(' ext_', CAST(o_custkey AS STRING), '.XML ') WHEN 2 THEN concat('Customer#', lpad(CAST(o_custkey AS STRING), 9, '0')) ELSE o_orderpriority END AS name, o_orderkey FROM orders"


@query("find_extension", f"SELECT name, CASE WHEN o_orderkey % 4 < 3 THEN lower(c_name) END AS key FROM ({WANTED}) JOIN orders USING (o_orderkey) LEFT JOIN customer ON c_custkey = o_custkey")
def _(d):
    return search.find_extension(d.sql(WANTED), d.sql(EXTENSIONS))
