"""Tables of the domain derived from the test tables. Each text runs unchanged in Spark and DuckDB.

Faults are seeded by key, so every rule has something to find at any scale.
"""

VIEWS = {}

# occurrence records: nation = dataset, order status = table, order = row
VIEWS["occ"] = """
SELECT CAST(n_nationkey AS BIGINT) AS dataset_id,
 CAST(n_nationkey * 3 + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS BIGINT) AS table_id,
 o_orderkey AS row_id,
 CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'OCC-' || o_orderstatus WHEN o_orderkey % 83 = 0 THEN 'occ-' || o_orderstatus ELSE 'occ-' || CAST(o_orderkey AS STRING) END AS occurrenceID,
 CASE o_orderstatus WHEN 'F' THEN 'HumanObservation' WHEN 'O' THEN 'PreservedSpecimen' ELSE 'specimen' END AS basisOfRecord,
 upper(substr(p_name,1,1)) || substr(p_name,2) || CASE WHEN o_orderkey % 211 = 0 THEN 'e' ELSE '' END AS scientificName,
 CASE o_orderkey % 10 WHEN 0 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING),1,4) WHEN 1 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING),1,7)
  WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || '/' || CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 7 DAY AS DATE) AS STRING) WHEN 4 THEN 'not a date' WHEN 5 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS eventDate,
 CASE WHEN o_orderkey % 101 = 0 THEN 'n/a' ELSE CAST(o_custkey * 37 % 200 - 95 AS STRING) END AS decimalLatitude,
 CAST(o_custkey * 53 % 380 - 185 AS STRING) AS decimalLongitude,
 CASE WHEN o_orderkey % 103 = 0 THEN '2.5' ELSE CAST(o_orderkey % 12 - 1 AS STRING) END AS individualCount,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'CAT-' || CAST(CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS STRING) END AS catalogNumber,
 n_name AS country, r_name AS kingdom, p_brand AS family, c_name AS recordedBy, o_orderpriority AS samplingProtocol,
 CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, o_custkey AS tip_key
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON p_partkey = o_custkey
"""

# a second table layout of the same datasets: places and dates in parts, no country column
VIEWS["visits"] = """
SELECT CAST(s_nationkey AS BIGINT) AS dataset_id, CAST(1000 + s_nationkey AS BIGINT) AS table_id, l_orderkey * 10 + l_linenumber AS row_id,
 CAST(year(l_shipdate) AS STRING) AS "year", CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(month(l_shipdate) AS STRING) END AS "month",
 CASE WHEN l_linenumber >= 6 THEN ' ' ELSE CAST(day(l_shipdate) AS STRING) END AS "day",
 s_name AS locality, l_returnflag AS field_method
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
""".replace('"', '')

VIEWS["mof"] = """
SELECT 'occ-' || CAST(l_orderkey AS STRING) AS occurrenceID, l_orderkey, l_linenumber, l_returnflag AS measurementType,
 l_quantity AS measurementValue, 'cm' AS measurementUnit
FROM lineitem
"""

# one header per part: six layouts, and one column named after the part's type
VIEWS["headers"] = """
SELECT * FROM (VALUES
 (0,1,'occurrenceID'),(0,2,'basisofrecord'),(0,3,'ScientificName'),(0,4,'eventDate'),(0,5,'country'),(0,6,'organismQuantity'),
 (1,1,'site'),(1,2,'Small bolt'),(1,3,'Red ring'),(1,4,'Red ring'),(1,5,NULL),(1,6,NULL),
 (2,1,'0'),(2,2,'1'),(2,3,'2'),(2,4,'10'),
 (3,1,'eventID'),(3,2,'eventDate'),(3,3,' locality '),(3,4,'samplingProtocol'),(3,5,'habitat'),
 (4,1,'taxonID'),(4,2,'scientificName'),(4,3,'kingdom'),(4,4,'family'),(4,5,'taxonRank'),
 (5,1,'id'),(5,2,'measurementID'),(5,3,'occurrenceID')) AS h(variant, pos, name)
"""
VIEWS["columns_of"] = """
SELECT p_partkey AS table_id, CAST(pos AS BIGINT) AS pos, name FROM part JOIN headers ON CAST(p_partkey % 6 AS INT) = variant
UNION ALL
SELECT p_partkey, 20, p_type FROM part WHERE p_size > 40
"""

VIEWS["backbone"] = """
SELECT DISTINCT upper(substr(p_name,1,1)) || substr(p_name,2) AS scientificName, 'species' AS taxonRank FROM part
"""

VIEWS["registry_log"] = """
SELECT event_id AS table_id, user_id AS dataset_id, event_type AS title, ts AS updated_at, CAST(floor(value) AS BIGINT) AS n_rows FROM events
"""

# uploaded files: document = file, three documents = one dataset
VIEWS["files_of"] = """
SELECT doc_id AS file_id, CAST(floor(doc_id / 3) AS BIGINT) AS dataset_id,
 'uploads/v1.2/' || source || '/' || CAST(doc_id AS STRING) || CASE CAST(doc_id * 7 % 11 AS INT) WHEN 0 THEN '.csv' WHEN 1 THEN '.TSV' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.nwk' WHEN 4 THEN '.pdf'
  WHEN 5 THEN '.NEX' WHEN 6 THEN '.docx' WHEN 7 THEN '' WHEN 8 THEN '.ods' WHEN 9 THEN '.tar.gz' ELSE '.tre' END AS path,
 TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * CAST(doc_id * 7919 % 10007 AS INT) AS uploaded_at, text AS content
FROM documents
"""

# sheet cells: 400 parts = one file, brand digit = sheet; every 20th row is blank, prices are formulas
VIEWS["cells_of"] = """
SELECT 'f' || CAST(CAST(floor(p_partkey / 400) AS BIGINT) AS STRING) AS file, 's' || CAST(p_partkey % 2 AS STRING) AS sheet, CAST(floor(p_partkey % 400 / 2) AS BIGINT) AS row_id, col_id,
 CASE WHEN floor(p_partkey % 400 / 2) % 20 = 19 THEN CASE WHEN col_id = 0 THEN ' ' END WHEN floor(p_partkey % 400 / 2) % 20 = 0 THEN 'head' || CAST(col_id AS STRING)
  WHEN col_id = 0 THEN p_name WHEN col_id = 1 THEN p_brand WHEN col_id = 2 THEN NULL WHEN col_id = 3 THEN p_type ELSE CAST(p_size AS STRING) END AS value,
 col_id = 4 AND p_size > 25 AS is_formula
FROM part CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS c(col_id)
"""
VIEWS["ranges_of"] = """
SELECT 'f' || CAST(CAST(floor(s_suppkey / 20) AS BIGINT) AS STRING) AS file, 's' || CAST(s_suppkey % 2 AS STRING) AS sheet,
 CAST(floor(s_suppkey % 20 / 2) * 20 + 2 AS BIGINT) AS r0, CAST(floor(s_suppkey % 20 / 2) * 20 + 4 + s_suppkey % 3 AS BIGINT) AS r1, 0 AS c0, 1 AS c1 FROM supplier
"""

# delimited lines: 50 customers = one file; the delimiter goes with the file
VIEWS["seps"] = "SELECT * FROM (VALUES (0, '\t'), (1, ','), (2, ';'), (3, '|'), (4, ' ')) AS s(k, sep)"
VIEWS["lines_of"] = """
SELECT 'file' || CAST(CAST(floor(c_custkey / 50) AS BIGINT) AS STRING) AS file, c_custkey % 50 AS line_no, CAST(c_custkey % 50 AS STRING) || sep || CASE WHEN c_custkey % 9 = 8 THEN '"a' || sep || ' b"' ELSE c_name END || sep || CASE c_custkey % 7 WHEN 3 THEN 'NA' WHEN 4 THEN '' ELSE c_mktsegment END
  || CASE WHEN c_custkey % 13 = 0 AND c_custkey % 50 > 0 THEN ', x, y; z' ELSE '' END AS line
FROM customer JOIN seps ON CAST(floor(c_custkey / 50) % 5 AS INT) = k
"""

# trees: region and block of 500 customers = tree, nation = clade, customer = tip; odd regions are NEXUS files
# every tree is there for two datasets of its region, with the same labels
VIEWS["members"] = """
SELECT CAST(ds AS BIGINT) AS dataset_id, r_name || '-' || CAST(CAST(floor(c_custkey / 500) AS BIGINT) AS STRING) AS tree_id, CASE WHEN r_regionkey % 2 = 0 THEN 'newick' ELSE 'nexus' END AS format,
 r_name, n_nationkey, n_name, c_custkey, CAST(c_custkey % 5 + 1 AS INT) AS bl FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 JOIN (SELECT n_regionkey AS rk, min(n_nationkey) AS ds FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, max(n_nationkey) FROM nation GROUP BY 1) ON rk = r_regionkey
"""
VIEWS["tip_links"] = """
SELECT dataset_id, table_id, row_id, occurrenceID, catalogNumber, scientificName, decimalLatitude, decimalLongitude, tip_key,
 CASE WHEN row_id % 7 = 0 THEN NULL WHEN row_id % 31 = 0 THEN 'no json' WHEN row_id % 5 = 0 THEN '{"phylogenies":[{"phyloTreeTipLabel":"C' || CAST(tip_key AS STRING) || '","phyloTreeFileName":"t.nwk"},{"phyloTreeTipLabel":"C' || CAST(tip_key + 1 AS STRING) || '","phyloTreeFileName":"t.nwk"}]}'
  ELSE '{"phylogenies":[{"phyloTreeTipLabel":"C' || CAST(tip_key AS STRING) || '","phyloTreeFileName":"t.nwk"}]}' END AS dynamicProperties FROM occ
"""
# the same links as rows, without JSON
VIEWS["plain_links"] = """
SELECT dataset_id, table_id, row_id, occurrenceID, catalogNumber, scientificName, decimalLatitude, decimalLongitude, 0 AS pos, 'C' || CAST(tip_key AS STRING) AS tip FROM occ WHERE row_id % 7 <> 0 AND row_id % 31 <> 0
UNION ALL SELECT dataset_id, table_id, row_id, occurrenceID, catalogNumber, scientificName, decimalLatitude, decimalLongitude, 1, 'C' || CAST(tip_key + 1 AS STRING) FROM occ WHERE row_id % 7 <> 0 AND row_id % 31 <> 0 AND row_id % 5 = 0
"""

# application log: customer = dataset, order = agent, priority = task, conversation = agent with messages
VIEWS["datasets_of"] = """
SELECT c_custkey AS dataset_id, c_nationkey AS user_id, c_name AS title, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN '' ELSE c_mktsegment END AS description,
 TIMESTAMP '2023-01-01 00:00:00' + INTERVAL 1 HOUR * CAST(c_custkey * 7 % 5000 AS INT) AS created_at,
 CASE WHEN c_custkey % 11 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS published_at, CASE WHEN c_custkey % 13 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' END AS rejected_at FROM customer
"""
VIEWS["tasks_of"] = """
SELECT o_orderpriority AS name, CAST(substr(o_orderpriority, 1, 1) AS INT) AS "order", 'text' AS text FROM orders GROUP BY 1, 2
""".replace(' AS "order"', " AS task_order")
VIEWS["agents_of"] = """
SELECT o_orderkey AS agent_id, o_custkey AS dataset_id, o_orderpriority AS task, o_orderdate AS created_at, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL 1 DAY END AS completed_at FROM orders
"""
# messages as columns; assistant turns call a tool, the next user turn but one answers it
VIEWS["said"] = """
SELECT conv_id * 1000 + turn AS message_id, conv_id AS agent_id, CAST(conv_id % 50 AS BIGINT) AS dataset_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * CAST(conv_id * 7 + turn * 5 AS INT) AS created_at,
 CASE WHEN role = 'user' AND turn % 4 = 2 THEN 'tool' WHEN role = 'system' AND conv_id % 2 = 0 THEN 'critic' ELSE role END AS role,
 CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN '' ELSE text END AS content,
 CASE WHEN role = 'user' AND turn % 4 = 2 AND conv_id % 9 <> 0 THEN 'call-' || CAST(conv_id AS STRING) || '-' || CAST(turn - 1 AS STRING) END AS tool_call_id,
 CASE WHEN role = 'assistant' THEN 'call-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) END AS call_id,
 CASE WHEN role = 'assistant' THEN CASE WHEN turn % 4 = 1 THEN 'Python' ELSE 'SetEML' END END AS call_name
FROM conversations
"""
VIEWS["vocab_of"] = """
SELECT CAST(substr(source, 4) AS INT) AS section_order, source AS section, doc_id AS term_order, 'Term_' || lang || CAST(doc_id % 97 AS STRING) AS term, text || ' Examples: a / b' AS definition FROM documents
"""
