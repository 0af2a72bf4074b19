"""Metadata rows and people."""

from pyspark.sql import functions as F

from ..operators import metadata
from .registry import query





@query("merge_metadata_patch", f"""WITH p AS (SELECT l_suppkey * 7 AS dataset_id, max(CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE ' ' || l_returnflag || ' ' END) AS description FROM lineitem GROUP BY 1)
SELECT coalesce(d.dataset_id, p.dataset_id) AS dataset_id, title, coalesce(nullif(trim(p.description), ''), d.description) AS description FROM datasets_of d FULL JOIN p ON p.dataset_id = d.dataset_id""")
def _(d):
    patch = d.sql("SELECT l_suppkey * 7 AS dataset_id, max(CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE concat(' ', l_returnflag, ' ') END) AS description FROM lineitem GROUP BY 1")
    return metadata.merge_metadata_patch(d.view("datasets_of").select("dataset_id", "title", "description"), patch)


@query("latest_by_owner_upsert", """SELECT coalesce(u.email, i.email) AS email, coalesce(nullif(trim(i.first_name), ''), u.first_name) AS first_name, coalesce(nullif(trim(i.country), ''), u.country) AS country FROM (SELECT c_name || '@example.org' AS email, c_mktsegment AS first_name, '' AS country FROM customer) u
FULL JOIN (SELECT 'Customer#' || lpad(CAST(s_suppkey * 17 AS STRING), 9, '0') || '@example.org' AS email, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS first_name, 'N' || CAST(s_nationkey AS STRING) AS country FROM supplier) i ON i.email = u.email""")
def _(d):
    users = d.sql("SELECT concat(c_name, '@example.org') AS email, c_mktsegment AS first_name, '' AS country FROM customer")
    new = d.sql("SELECT concat('Customer#', lpad(CAST(s_suppkey * 17 AS STRING), 9, '0'), '@example.org') AS email, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS first_name, concat('N', CAST(s_nationkey AS STRING)) AS country FROM supplier")
    return metadata.latest_by_owner_upsert(users, new)


NOTES = "SELECT user_id AS dataset_id, event_id AS seq, CASE event_type WHEN 'view' THEN ' ' ELSE concat(event_type, ' ', CAST(event_id AS STRING), ' ') END AS note, event_id % 37 = 0 AS overwrite FROM events"


@query("append_notes", f"""WITH n AS (SELECT dataset_id, seq, trim(note) AS note, overwrite FROM ({NOTES}) WHERE trim(note) <> ''), s AS (SELECT dataset_id, max(seq) FILTER (overwrite) AS f FROM n GROUP BY 1)
SELECT dataset_id, string_agg(note, chr(10) || chr(10) ORDER BY seq) AS notes FROM n JOIN s USING (dataset_id) WHERE f IS NULL OR seq >= f GROUP BY 1""")
def _(d):
    return metadata.append_notes(d.sql(NOTES))


BASIC = "SELECT dataset_id, CASE WHEN dataset_id % 3 = 0 THEN 'New title' END AS title, CASE WHEN dataset_id % 5 = 0 THEN 'New text' ELSE '' END AS description, dataset_id % 7 <> 0 AS suitable FROM datasets_of"
SETS = "SELECT dataset_id, CASE WHEN dataset_id % 6 = 1 THEN NULL ELSE title END AS title, description, rejected_at FROM datasets_of"


@query("set_basic_metadata", f"""WITH j AS (SELECT m.*, p.title AS t, nullif(p.description, '') AS x, suitable, CASE WHEN coalesce(m.title, '') = '' AND p.title IS NULL THEN 'title is missing' WHEN coalesce(m.description, '') = '' AND coalesce(p.description, '') = '' THEN 'description is missing' END AS error FROM ({SETS}) m JOIN ({BASIC}) p USING (dataset_id))
SELECT dataset_id, CASE WHEN error IS NULL AND t IS NOT NULL THEN t ELSE title END AS title, CASE WHEN error IS NULL AND x IS NOT NULL THEN x ELSE description END AS description, CASE WHEN error IS NULL AND NOT suitable THEN TIMESTAMP '2024-03-01 00:00:00' ELSE rejected_at END AS rejected_at, error FROM j""")
def _(d):
    return metadata.set_basic_metadata(d.sql(SETS), d.sql(BASIC), F.lit("2024-03-01 00:00:00").cast("timestamp"))


@query("completion_guard", "SELECT agent_id, dataset_id, task FROM agents_of JOIN datasets_of USING (dataset_id) WHERE task = '1-URGENT' AND coalesce(description, '') = ''")
def _(d):
    return metadata.completion_guard(d.view("agents_of"), d.view("tasks_of"), d.view("datasets_of"), "1-URGENT")


PROFILES = """SELECT c_name AS orcid, CASE WHEN c_custkey % 3 = 0 THEN concat('u', CAST(c_custkey AS STRING), '@example.org') ELSE '' END AS email,
 CASE c_custkey % 4 WHEN 0 THEN concat('{"person":{"name":{"given-names":{"value":"', c_mktsegment, '"},"family-name":{"value":"F"}},"employments":{"employment-summary":[{"employment-summary":{"organization":{"name":"', c_name, '","address":{"city":"C","country":"NO"}}}},{"organization":{"name":"older"}}]}}}')
  WHEN 1 THEN concat('{"person":{"name":{"given-names":null},"employments":{"employment-summary":[{"organization":{"name":"', c_name, '"}}]}}}')
  WHEN 2 THEN concat('{"activities-summary":{"employments":{"employment-summary":[{"organization":{"name":"', c_name, '","address":{"city":"D"}}}]}}}') ELSE 'broken' END AS profile, c_custkey, c_mktsegment FROM customer"""


@query("profile_from_json", f"""SELECT orcid, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS first_name, CASE WHEN c_custkey % 4 = 0 THEN 'F' END AS last_name, CASE WHEN c_custkey % 4 < 3 THEN orcid END AS institution, CASE c_custkey % 4 WHEN 0 THEN 'C' WHEN 2 THEN 'D' END AS department,
 CASE WHEN c_custkey % 4 = 0 THEN 'NO' END AS country, CASE WHEN email = '' THEN orcid || '@orcid.org' ELSE email END AS email FROM ({PROFILES})""")
def _(d):
    return metadata.profile_from_json(d.sql(PROFILES))


PEOPLE = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE ' ' END AS f, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS l, CASE WHEN c_custkey % 5 = 0 THEN concat('u', CAST(c_custkey AS STRING), '@orcid.org') WHEN c_custkey % 5 = 1 THEN 'user' END AS u, CASE WHEN c_custkey % 7 = 0 THEN 'x@example.org' ELSE 'y@orcid.org' END AS e FROM customer"


@query("person_label", f"""SELECT c_custkey, coalesce(nullif(trim(concat_ws(' ', nullif(trim(f), ''), nullif(l, ''))), ''), CASE WHEN u NOT LIKE '%@orcid.org' THEN u END, CASE WHEN e NOT LIKE '%@orcid.org' THEN e END, 'Unknown user') AS label FROM ({PEOPLE})""")
def _(d):
    return d.sql(PEOPLE).select("c_custkey", metadata.person_label(F.col("f"), F.col("l"), F.col("u"), F.col("e")).alias("label"))


FOUND = "SELECT l_orderkey AS dataset_id, l_linenumber AS table_no, l_discount * 10 AS confidence, l_orderkey % 2 = 0 AS is_new FROM lineitem"


@query("select_extracted_tables", f"SELECT * FROM ({FOUND}) WHERE confidence >= 0.65")
def _(d):
    return metadata.select_extracted_tables(d.sql(FOUND), 0.65)[0]


@query("extracted_table_status", f"SELECT dataset_id, count(*) FILTER (confidence >= 0.65) AS n_kept, CASE WHEN count(*) FILTER (confidence >= 0.65) = 0 AND bool_or(is_new) THEN 'rejected' ELSE 'accepted' END AS status FROM ({FOUND}) GROUP BY 1")
def _(d):
    return metadata.select_extracted_tables(d.sql(FOUND), 0.65)[1]


WORDS = """SELECT l_suppkey AS dataset_id, l_orderkey * 10 + l_linenumber AS pos, l_partkey, concat('{"', CASE l_linenumber % 4 WHEN 0 THEN 'scientificName' WHEN 1 THEN 'scientific_name' WHEN 2 THEN 'taxonRankValue' ELSE 'name' END, '":"', CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE concat(CASE WHEN l_linenumber % 2 = 0 THEN 'Genus' ELSE 'genus ' END, CAST(l_partkey % 20 AS STRING)) END, '"', CASE WHEN l_partkey % 3 = 0 THEN ',"rank":"Genus"' ELSE '' END, '}') AS keyword, l_linenumber FROM lineitem"""


@query("normalize_keywords", f"""WITH k AS (SELECT dataset_id, pos, CASE WHEN l_linenumber % 2 = 0 THEN 'Genus' ELSE 'genus ' END || CAST(l_partkey % 20 AS STRING) AS name, CASE WHEN l_partkey % 3 = 0 THEN 'Genus' END AS rank FROM ({WORDS}) WHERE l_partkey % 5 <> 0)
SELECT DISTINCT dataset_id, pos, coalesce(rank, 'taxon') AS rank, name, CAST(NULL AS VARCHAR) AS common_name FROM k QUALIFY dense_rank() OVER (PARTITION BY dataset_id, lower(name), lower(coalesce(rank, '')) ORDER BY pos) = 1 AND row_number() OVER (PARTITION BY dataset_id, lower(name), lower(coalesce(rank, '')), pos ORDER BY name) = 1""")
def _(d):
    # equal positions occur, since line numbers repeat; the name decides then
    return metadata.normalize_keywords(d.sql(WORDS).select("dataset_id", "pos", "keyword"))
