"""Files, delimiters, payloads, cells, the table registry."""

from pyspark.sql import functions as F

from ..operators import registry as tables
from ..plans.scratch import fresh_path
from ..sources import cells, delimited, files, records
from .registry import query

KIND = """(SELECT file_id, dataset_id, path, uploaded_at, content, CASE WHEN s IN ('newick','nwk','nex','nexus','tre','tree') THEN 'tree' WHEN s IN ('csv','tsv','txt','xlsx','xls','xlsm','xlsb','ods') THEN 'tabular' WHEN s = 'pdf' THEN 'pdf' ELSE 'unknown' END AS file_type
 FROM (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS s FROM files_of))"""
MODE = f"(SELECT dataset_id, bool_or(file_type = 'tabular') AS tab, bool_or(file_type = 'pdf') AS pdf, bool_or(file_type = 'tree') AS tree FROM {KIND} GROUP BY 1)"


@query("classify_files", f"SELECT file_id, path, file_type FROM {KIND}")
def _(d):
    return files.classify_files(d.view("files_of")).select("file_id", "path", "file_type")


@query("source_mode", f"SELECT dataset_id, CASE WHEN tab AND pdf THEN 'hybrid' WHEN pdf THEN 'pdf_only' ELSE 'tabular_only' END AS source_mode FROM {MODE}")
def _(d):
    return files.source_mode(d.view("files_of"))


@query("has_tree", f"SELECT dataset_id, tree AS has_tree FROM {MODE}")
def _(d):
    return files.has_tree(d.view("files_of"))


LOADED = "SELECT DISTINCT doc_id AS dataset_id FROM labels WHERE quality = 1"


@query("reject_datasets", f"""SELECT c_custkey AS dataset_id, c_name, CASE WHEN m.dataset_id IS NULL THEN 'no files' WHEN NOT tab AND NOT pdf THEN 'no tabular or pdf file' WHEN NOT pdf AND l.dataset_id IS NULL THEN 'no table could be loaded' END AS reason
FROM customer LEFT JOIN {MODE} m ON m.dataset_id = c_custkey LEFT JOIN ({LOADED}) l ON l.dataset_id = c_custkey""")
def _(d):
    sets = d.table("customer").select(F.col("c_custkey").alias("dataset_id"), "c_name")
    return files.reject_datasets(sets, d.view("files_of"), d.sql(LOADED))


CACHE = "SELECT {h} AS sha256, concat('remote-', CAST(doc_id AS STRING)) AS cached_id, uploaded_at AS created_at FROM files_of JOIN labels ON doc_id = file_id WHERE toxic = 0"


@query("fingerprint_files", f"""WITH cache AS ({CACHE.format(h='sha256(content)')}), first AS (SELECT sha256, arg_min(cached_id, struct_pack(a := created_at, b := cached_id)) AS cached_id FROM cache GROUP BY 1)
SELECT file_id, sha256(content) AS sha256, cached_id FROM files_of LEFT JOIN first ON first.sha256 = sha256(content)""")
def _(d):
    cache = d.sql(CACHE.format(h="sha2(content, 256)"))
    return files.fingerprint_files(d.view("files_of"), cache).select("file_id", "sha256", "cached_id")


@query("unique_contents", "SELECT sha256(content) AS sha256, arg_min(file_id, struct_pack(a := uploaded_at, b := file_id)) AS file_id FROM files_of GROUP BY 1")
def _(d):
    return files.unique_contents(d.view("files_of")).select("sha256", "file_id")


OLD = "SELECT c_custkey AS dataset_id, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('old/', c_name) END AS file_path, TIMESTAMP '2023-01-01 00:00:00' + INTERVAL 1 MINUTE * CAST(c_custkey AS INT) AS created_at FROM customer"


@query("backfill_files", f"SELECT dataset_id, file_path AS path, created_at AS uploaded_at FROM ({OLD}) WHERE file_path <> ''")
def _(d):
    return files.backfill_files(d.sql(OLD))


@query("first_file_per_dataset", "SELECT dataset_id, arg_min(path, struct_pack(a := uploaded_at, b := file_id)) AS file_path FROM files_of GROUP BY 1")
def _(d):
    return files.first_file_per_dataset(d.view("files_of"))


DELIMS = """marks AS (SELECT file, delimiter, i, (length(line) - length(replace(line, delimiter, ''))) AS n FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS rn FROM lines_of WHERE trim(line) <> '') CROSS JOIN (VALUES (chr(9), 0), (',', 1), (';', 2), ('|', 3)) AS x(delimiter, i) WHERE rn <= 50),
 stats AS (SELECT file, delimiter, i, count(*) FILTER (n > 0) AS k, max(n) FILTER (n > 0) - min(n) FILTER (n > 0) AS spread, avg(n) FILTER (n > 0) AS average FROM marks GROUP BY ALL),
 ranked AS (SELECT file, delimiter, row_number() OVER (PARTITION BY file ORDER BY CASE WHEN k >= 2 THEN 0 ELSE 1 END, CASE WHEN k >= 2 THEN spread ELSE 0 END, CASE WHEN k >= 2 THEN -k ELSE 0 END, CASE WHEN k >= 2 THEN -average ELSE 0 END, CASE WHEN k >= 2 THEN ascii(delimiter) ELSE i END) AS rank FROM stats)"""
BARE = """bare AS (SELECT file, line_no, regexp_replace(line, '"[^"]*"', '', 'g') AS line FROM lines_of WHERE trim(line) <> ''),
 sized AS (SELECT file, delimiter, arg_min(length(line) - length(replace(line, delimiter, '')) + 1, line_no) AS h, max(length(line) - length(replace(line, delimiter, '')) + 1) AS m FROM bare CROSS JOIN (VALUES (chr(9)), (','), (';'), ('|')) AS x(delimiter) GROUP BY ALL),
 chosen AS (SELECT f.file, arg_min(delimiter, rank) AS delimiter FROM (SELECT DISTINCT file FROM lines_of) f LEFT JOIN (SELECT * FROM ranked JOIN sized USING (file, delimiter) WHERE h > 1 AND m <= h) USING (file) GROUP BY 1)"""


@query("detect_delimiter", f"WITH {DELIMS} SELECT * FROM ranked")
def _(d):
    return delimited.detect_delimiter(d.view("lines_of"))


@query("choose_delimiter", f"WITH {DELIMS}, {BARE} SELECT * FROM chosen")
def _(d):
    return delimited.choose_delimiter(d.view("lines_of"))


@query("read_delimited", """SELECT CAST(c_custkey AS STRING) AS "key", CASE WHEN c_custkey % 9 = 8 THEN 'a, "b"' ELSE c_name END AS "name", CASE c_custkey % 7 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE c_mktsegment END AS segment, c_custkey // 500 AS file_no, row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) - 1 AS row_id FROM customer""")
def _(d):
    """Customers written as CSV files of 500 rows, then read back."""
    name = F.when(F.col("c_custkey") % 9 == 8, F.lit('"a, ""b"""')).otherwise(F.col("c_name"))
    segment = F.when(F.col("c_custkey") % 7 == 3, "NA").when(F.col("c_custkey") % 7 == 4, "").otherwise(F.col("c_mktsegment"))
    part = F.floor(F.col("c_custkey") / 500)
    lines = d.table("customer").select(part.alias("part"), F.col("c_custkey").alias("k"),
                                       F.concat_ws(",", F.col("c_custkey").cast("string"), name, segment).alias("value"))
    heads = lines.groupBy("part").agg(F.lit(-1).cast("bigint").alias("k"), F.lit("key,name,segment").alias("value"))
    path = fresh_path(d.spark, "csv")
    lines.unionByName(heads).repartition("part").sortWithinPartitions("part", "k").drop("k").write.partitionBy("part").text(path)
    t = delimited.read_delimited(d.spark, f"{path}/*")
    return t.select("key", "name", "segment", F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint").alias("file_no"), "row_id")


@query("read_tables", """WITH c AS (SELECT CAST(floor(c_custkey / 500) AS BIGINT) AS file_no, row_number() OVER (PARTITION BY floor(c_custkey / 500) ORDER BY c_custkey) AS row_id, * FROM customer)
SELECT file_no, 0 AS row_id, col_id, name AS value FROM (SELECT DISTINCT file_no FROM c) CROSS JOIN (VALUES (0, 'key'), (1, 'the' || chr(10) || 'name'), (2, 'segment')) AS h(col_id, name)
UNION ALL SELECT file_no, row_id, 0, CAST(c_custkey AS STRING) FROM c
UNION ALL SELECT file_no, row_id, 1, CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(10) || chr(10) || 'x,y;z|"q"' WHEN c_custkey % 3 = 1 THEN '5" ' || c_name ELSE c_name END FROM c
UNION ALL SELECT file_no, row_id, 2, CASE WHEN c_custkey % 7 <> 3 THEN c_mktsegment END FROM c""")
def _(d):
    """Customers written as files with four delimiters, with line breaks, delimiters and quotes in fields, and read back."""
    part = F.floor(F.col("c_custkey") / 500).cast("bigint")
    sep = F.element_at(F.array(*[F.lit(s) for s in delimited.DELIMITERS]), (part % 4 + 1).cast("int"))
    name = (F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('"'), F.col("c_name"), F.lit('\n\nx,y;z|""q"""')))
            .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit('5" '), F.col("c_name"))).otherwise(F.col("c_name")))
    segment = F.when(F.col("c_custkey") % 7 == 3, "NA").otherwise(F.col("c_mktsegment"))
    rows = d.table("customer").select(part.alias("part"), F.col("c_custkey").alias("k"), F.concat(F.col("c_custkey").cast("string"), sep, name, sep, segment, F.lit("\r")).alias("value"), sep.alias("sep"))
    heads = rows.groupBy("part", "sep").agg(F.lit(-1).cast("bigint").alias("k")).select("part", "k", F.concat(F.lit("key"), "sep", F.lit('"the\nname"'), "sep", F.lit("segment")).alias("value"), "sep")
    path = fresh_path(d.spark, "tables")
    rows.unionByName(heads).repartition("part").sortWithinPartitions("part", "k").select("part", "value").write.partitionBy("part").text(path)
    t = records.read_tables(d.spark, f"{path}/*")
    return t.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint").alias("file_no"), "row_id", "col_id", "value")


@query("lines_to_cells", rf"""WITH {DELIMS}, {BARE},
 u AS (SELECT file, line_no, string_split(replace(replace(line, '"a' || s || ' b"', 'QQ'), s, chr(1)), chr(1)) AS f, s FROM (SELECT l.*, coalesce(delimiter, chr(2)) AS s FROM lines_of l JOIN chosen USING (file))),
 c AS (SELECT file, line_no AS row_id, s, unnest(f) AS v, generate_subscripts(f, 1) - 1 AS col_id FROM u)
SELECT file, row_id, CAST(col_id AS INTEGER) AS col_id, CASE WHEN row_id > 0 AND v IN ('NA', '') THEN NULL ELSE replace(v, 'QQ', 'a' || s || ' b') END AS value FROM c""")
def _(d):
    lines = d.view("lines_of")
    return delimited.lines_to_cells(lines, delimited.choose_delimiter(lines))


@query("rebuild_tables", f"""WITH t AS (SELECT file_id, dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY uploaded_at, file_id) AS table_no FROM files_of),
 p AS (SELECT dataset_id, table_no, file_id, 0 AS row_id, 0 AS col_id, 'name' AS value FROM t UNION ALL SELECT dataset_id, table_no, file_id, 0, 1, 'place' FROM t
  UNION ALL SELECT dataset_id, table_no, file_id, 1, 0, 'x' || CAST(file_id AS STRING) FROM t UNION ALL SELECT dataset_id, table_no, file_id, 1, 1, NULL FROM t
  UNION ALL SELECT dataset_id, table_no, file_id, 2, 0, 'a;' || chr(10) || 'b' FROM t UNION ALL SELECT dataset_id, table_no, file_id, 2, 1, source FROM t JOIN documents ON doc_id = file_id) SELECT * FROM p""")
def _(d):
    src = d.sql("SELECT f.file_id, dataset_id, uploaded_at, concat('name;place\\n', 'x', CAST(file_id AS STRING), ';NA\\n\\n\"a;\\nb\";', source, '\\n') AS content FROM files_of f JOIN documents ON doc_id = file_id")
    return delimited.rebuild_tables(src)


PAYLOADS = """SELECT doc_id AS payload_id, CAST(floor(doc_id / 3) AS BIGINT) AS dataset_id, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE concat(' Table ', source) END AS title, CASE doc_id % 10 WHEN 1 THEN NULL WHEN 2 THEN 'a,b' WHEN 3 THEN {nl3} ELSE {nl} END AS csv,
 CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS description, CASE WHEN doc_id % 6 = 0 THEN doc_id + 3 WHEN doc_id % 6 < 3 THEN doc_id END AS source_file_id, CASE WHEN doc_id % 5 = 0 THEN 'page 3' END AS note, source, doc_id FROM documents"""
NL = "concat('a,b,c', {n}, CAST(doc_id AS STRING), ',\"x, ', source, '\",', {n}, 'p,,NA', {n})"
SPARK_PAYLOADS = PAYLOADS.format(nl=NL.format(n="'\\n'"), nl3="'a,b\\n1,2,3'")
DUCK_PAYLOADS = PAYLOADS.format(nl=NL.format(n="chr(10)"), nl3="'a,b' || chr(10) || '1,2,3'")


@query("csv_payload_summary", f"""WITH p AS ({DUCK_PAYLOADS})
SELECT p.dataset_id, payload_id AS table_id, trim(title) AS title, trim(concat_ws(' | ', coalesce(description, ''), nullif(concat_ws(' | ', note, CASE WHEN f.file_id IS NOT NULL THEN 'source_file_id=' || CAST(source_file_id AS STRING) || ' (' || path || ')' END), '')), ' |') AS description, CAST(2 AS BIGINT) AS row_count, CAST(3 AS BIGINT) AS column_count
FROM p LEFT JOIN files_of f ON f.file_id = p.source_file_id AND f.dataset_id = p.dataset_id WHERE payload_id % 10 > 3""")
def _(d):
    return delimited.csv_payloads_to_cells(d.sql(SPARK_PAYLOADS), d.view("files_of"))[1]


@query("csv_payload_warnings", f"""WITH p AS ({DUCK_PAYLOADS})
SELECT dataset_id, payload_id, 'skipped: ' || CASE payload_id % 10 WHEN 0 THEN 'title is required.' WHEN 1 THEN 'csv content is empty.' WHEN 2 THEN 'parsed CSV has no rows.' ELSE 'failed to parse CSV.' END AS warning FROM p WHERE payload_id % 10 < 4
UNION ALL SELECT dataset_id, payload_id, 'source_file_id=' || CAST(source_file_id AS STRING) || ' does not belong to this dataset and was ignored.' FROM p WHERE payload_id % 10 > 3 AND payload_id % 6 = 0""")
def _(d):
    return delimited.csv_payloads_to_cells(d.sql(SPARK_PAYLOADS), d.view("files_of"))[2]


@query("csv_payloads_to_cells", """WITH p AS (SELECT CAST(floor(doc_id / 3) AS BIGINT) AS dataset_id, doc_id AS table_id, source FROM documents WHERE doc_id % 10 > 3)
SELECT dataset_id, table_id, row_id, col_id, CASE WHEN row_id = 0 THEN chr(97 + col_id) WHEN row_id = 1 AND col_id = 0 THEN CAST(table_id AS STRING) WHEN row_id = 1 AND col_id = 1 THEN 'x, ' || source WHEN row_id = 2 AND col_id = 0 THEN 'p' WHEN row_id = 2 AND col_id = 2 THEN 'NA' ELSE '' END AS value
FROM p CROSS JOIN (VALUES (0), (1), (2)) AS r(row_id) CROSS JOIN (VALUES (0), (1), (2)) AS c(col_id)""")
def _(d):
    return delimited.csv_payloads_to_cells(d.sql(SPARK_PAYLOADS), d.view("files_of"))[0]


@query("cells_to_table", "SELECT file, sheet, row_id, max(CASE WHEN col_id = 0 THEN value END) AS a, max(CASE WHEN col_id = 1 THEN value END) AS b, max(CASE WHEN col_id = 2 THEN value END) AS c, max(CASE WHEN col_id = 3 THEN value END) AS dd, max(CASE WHEN col_id = 4 THEN value END) AS e FROM cells_of WHERE row_id > 0 GROUP BY ALL")
def _(d):
    return cells.cells_to_table(d.view("cells_of"), ["a", "b", "c", "dd", "e"])


@query("cells_to_records", """SELECT c.file, c.sheet, c.row_id, string_agg(h.value || '=' || coalesce(c.value, '?'), ',' ORDER BY c.col_id) AS record FROM cells_of c JOIN cells_of h ON c.file = h.file AND c.sheet = h.sheet AND c.col_id = h.col_id AND h.row_id = 0 WHERE c.row_id > 0 GROUP BY ALL""")
def _(d):
    out = cells.cells_to_records(d.view("cells_of"))
    return out.withColumn("record", F.array_join(F.transform(F.map_entries("record"), lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"], F.lit("?")))), ","))


@query("table_to_cells", "SELECT p_partkey, 0 AS col_id, 'p_name' AS name, p_name AS value FROM part UNION ALL SELECT p_partkey, 1, 'p_size', CAST(p_size AS STRING) FROM part")
def _(d):
    return cells.table_to_cells(d.table("part"), ["p_partkey"], ["p_name", "p_size"])


@query("blank_formula_cells", "SELECT file, sheet, row_id, col_id, CASE WHEN is_formula THEN '' ELSE value END AS value FROM cells_of")
def _(d):
    return cells.blank_formula_cells(d.view("cells_of")).drop("is_formula")


@query("fill_merged_ranges", """SELECT c.file, c.sheet, c.row_id, c.col_id, CASE WHEN r.r0 IS NULL THEN c.value ELSE coalesce(t.value, '') || ' [UNMERGED CELL]' END AS value
FROM cells_of c LEFT JOIN ranges_of r ON c.file = r.file AND c.sheet = r.sheet AND c.row_id BETWEEN r.r0 AND r.r1 AND c.col_id BETWEEN r.c0 AND r.c1
LEFT JOIN cells_of t ON t.file = r.file AND t.sheet = r.sheet AND t.row_id = r.r0 AND t.col_id = r.c0""")
def _(d):
    return cells.fill_merged_ranges(d.view("cells_of"), d.view("ranges_of")).drop("is_formula")


SIZES = "SELECT concat('w', CAST(l_suppkey AS STRING)) AS file, concat(l_returnflag, l_linestatus) AS sheet, l_orderkey % 4000 AS row_id FROM lineitem"
SIZED = f"sized AS (SELECT file, sheet, count(DISTINCT row_id) - 1 AS n_rows FROM ({SIZES}) GROUP BY ALL)"


@query("filter_small_tables", f"WITH {SIZED} SELECT * FROM sized WHERE n_rows >= 90")
def _(d):
    return cells.filter_small_tables(cells.sheet_sizes(d.sql(SIZES)), 90)[0]


@query("small_table_errors", f"WITH {SIZED} SELECT file, 'no sheet has at least 115 rows' AS error FROM sized GROUP BY 1 HAVING max(n_rows) < 115")
def _(d):
    return cells.filter_small_tables(cells.sheet_sizes(d.sql(SIZES)), 115)[1]


@query("latest_table_by_title", "SELECT * FROM registry_log QUALIFY row_number() OVER (PARTITION BY dataset_id, title ORDER BY updated_at DESC, table_id DESC) = 1")
def _(d):
    return tables.latest_table_by_title(d.view("registry_log"))


NEW = "SELECT o_orderkey + 100000000 AS table_id, o_custkey % 100 AS dataset_id, CASE WHEN o_orderkey % 2 = 0 THEN 'click' ELSE o_orderpriority END AS title, o_orderdate AS updated_at, o_orderkey AS n_rows FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 100, CASE WHEN o_orderkey % 2 = 0 THEN 'click' ELSE o_orderpriority END ORDER BY o_orderkey) = 1"


@query("upsert_table", f"""WITH latest AS (SELECT dataset_id, title, table_id AS old FROM registry_log QUALIFY row_number() OVER (PARTITION BY dataset_id, title ORDER BY updated_at DESC, table_id DESC) = 1),
 w AS (SELECT coalesce(old, table_id) AS table_id, n.dataset_id, n.title, updated_at, n_rows, CASE WHEN old IS NULL THEN 'created' ELSE 'replaced' END AS action FROM ({NEW}) n LEFT JOIN latest USING (dataset_id, title))
SELECT * FROM w UNION ALL SELECT *, 'kept' FROM registry_log WHERE table_id NOT IN (SELECT table_id FROM w)""")
def _(d):
    from pyspark.sql import Window as W
    new = d.sql(NEW.split(" QUALIFY")[0])
    new = new.withColumn("_r", F.row_number().over(W.partitionBy("dataset_id", "title").orderBy("table_id"))).filter("_r = 1").drop("_r")
    return tables.upsert_table(d.view("registry_log"), new)


KEEP = "SELECT user_id AS dataset_id, event_id AS table_id FROM events WHERE event_type = 'view'"


@query("delete_tables_except", "SELECT dataset_id, table_id FROM registry_log WHERE title <> 'view' AND dataset_id IN (SELECT user_id FROM events WHERE event_type = 'view')")
def _(d):
    return tables.delete_tables_except(d.view("registry_log"), d.sql(KEEP))[1]


@query("tables_kept", "SELECT table_id, dataset_id, title, updated_at, n_rows FROM registry_log WHERE title = 'view' OR dataset_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view')")
def _(d):
    return tables.delete_tables_except(d.view("registry_log"), d.sql(KEEP))[0]


@query("records_json", """SELECT c_custkey AS row_id, '{"row_id":' || CAST(c_custkey AS STRING) || ',"name":"' || c_name || '","name (2)":' || CASE WHEN c_nationkey > 20 THEN 'null' ELSE '"' || c_mktsegment || '"' END || ',"bad":null}' AS json FROM customer""")
def _(d):
    t = d.sql("SELECT c_custkey AS row_id, c_name AS name, CASE WHEN c_nationkey > 20 THEN NULL ELSE c_mktsegment END AS name, CASE WHEN c_custkey % 2 = 0 THEN double('NaN') ELSE double('Infinity') END AS bad FROM customer")
    return tables.records_json(t)


@query("transform_table", "SELECT row_id, upper(country) AS country, length(scientificName) AS n FROM occ")
def _(d):
    def code(pdf):
        return pdf.assign(country=pdf["country"].str.upper(), n=pdf["scientificName"].str.len())[["row_id", "country", "n"]]
    return tables.transform_table(d.view("occ").select("row_id", "country", "scientificName"), code, "row_id long, country string, n long")
