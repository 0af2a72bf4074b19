"""Trees and links; the SQL uses the hierarchy the trees were built from and never reads tree text."""

from pyspark.sql import functions as F

from ..operators import links, trees
from ..plans.scratch import materialize
from .registry import query

TREES = """WITH clade AS (SELECT dataset_id, tree_id, format, r_name, n_nationkey, n_name, concat('(', listagg(concat(CASE WHEN format = 'nexus' THEN 't' ELSE 'C' END, CAST(c_custkey AS STRING), ':', CAST(bl AS STRING), '[x]'), ',\\n ') WITHIN GROUP (ORDER BY c_custkey), ')', n_name, ':', CAST(n_nationkey + 1 AS STRING)) AS t,
   listagg(concat('t', CAST(c_custkey AS STRING), '  C', CAST(c_custkey AS STRING)), ',\\n') WITHIN GROUP (ORDER BY c_custkey) AS codes FROM members GROUP BY ALL),
 tree AS (SELECT dataset_id, tree_id, format, concat('(', listagg(t, ', ') WITHIN GROUP (ORDER BY n_nationkey), ')', max(r_name), ':oops;') AS t, listagg(codes, ',') WITHIN GROUP (ORDER BY n_nationkey) AS codes FROM clade GROUP BY ALL)
SELECT dataset_id, tree_id, format, CASE WHEN format = 'nexus' THEN concat('#NEXUS\\nBEGIN TREES;\\n Translate\\n', codes, ';\\nTREE one = [&R] ', t, '\\nTREE two = (A,B);\\nEND;\\n') ELSE t END AS content FROM tree"""
# node positions follow from the text: one token per bracket, comma, label and closing label
ORDERED = """ordered AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, tree_id ORDER BY n_nationkey, c_custkey) - 1 AS leaf, dense_rank() OVER (PARTITION BY dataset_id, tree_id ORDER BY n_nationkey) - 1 AS clade,
  row_number() OVER (PARTITION BY dataset_id, tree_id, n_nationkey ORDER BY c_custkey) - 1 AS k FROM members),
 tips AS (SELECT dataset_id, tree_id, format, r_name, n_nationkey, n_name, c_custkey, bl, leaf, clade, k, 2 + 3 * clade + 2 * leaf - clade + clade AS pos FROM ordered),
 clades AS (SELECT dataset_id, tree_id, r_name, n_nationkey, n_name, clade, min(pos) - 1 AS open, max(pos) + 1 AS "close", count(*) AS n, min(leaf) AS leaf, max(bl) AS longest FROM tips GROUP BY ALL),
 roots AS (SELECT dataset_id, tree_id, r_name, 0 AS open, max("close") + 2 AS "close", sum(n) AS n, max(longest + n_nationkey + 1) AS longest FROM clades GROUP BY ALL),
 nodes AS (SELECT dataset_id, tree_id, pos AS open, pos AS "close", CAST(2 AS BIGINT) AS depth, c.open AS parent, 'C' || CAST(c_custkey AS STRING) AS name, CAST(bl AS DOUBLE) AS branch_length, TRUE AS is_tip FROM tips t JOIN clades c USING (dataset_id, tree_id, n_nationkey)
  UNION ALL SELECT dataset_id, tree_id, open, "close", 1, 0, n_name, n_nationkey + 1, FALSE FROM clades UNION ALL SELECT dataset_id, tree_id, open, "close", 0, NULL, replace(r_name, ' ', ''), 0, FALSE FROM roots)"""
# a tip lies below its clade and below the root
ABOVE = """above AS (SELECT t.*, c.open AS node FROM tips t JOIN clades c USING (dataset_id, tree_id, n_nationkey) UNION ALL SELECT t.*, 0 FROM tips t)"""
COUNTS = "counts AS (SELECT dataset_id, tip, count(*) AS n_records, bool_or(TRY_CAST(decimalLatitude AS DOUBLE) IS NOT NULL AND TRY_CAST(decimalLongitude AS DOUBLE) IS NOT NULL) AS has_coordinates FROM plain_links GROUP BY 1, 2)"


def _trees(d):
    return d.sql(TREES)


def _nodes(d):
    """Nodes are read several times by most operators, so they are written once."""
    return materialize(trees.tree_nodes(_trees(d)), "nodes")


def _counts(d):
    return links.tip_counts(d.view("tip_links"))


@query("nexus_translate", "SELECT dataset_id, tree_id, 't' || CAST(c_custkey AS STRING) AS code, 'C' || CAST(c_custkey AS STRING) AS name FROM members WHERE format = 'nexus'")
def _(d):
    return trees.nexus_translate(_trees(d)).drop("pos")


@query("tip_labels", f"WITH {ORDERED} SELECT dataset_id, tree_id, leaf AS pos, 'C' || CAST(c_custkey AS STRING) AS label FROM tips")
def _(d):
    return trees.tip_labels(_trees(d))


@query("tree_nodes", f"WITH {ORDERED} SELECT * FROM nodes")
def _(d):
    return trees.tree_nodes(_trees(d))


@query("tip_counts", f"WITH {COUNTS} SELECT * FROM counts")
def _(d):
    return _counts(d)


@query("clade_counts", f"""WITH {ORDERED}, {COUNTS}, t AS (SELECT tips.dataset_id, tree_id, n_nationkey, pos, coalesce(n_records, 0) AS c FROM tips LEFT JOIN counts ON counts.dataset_id = tips.dataset_id AND tip = 'C' || CAST(c_custkey AS STRING))
SELECT dataset_id, tree_id, open, name, CAST(coalesce(tc.c, cc.c, rc.c) AS BIGINT) AS occurrence_count FROM nodes LEFT JOIN (SELECT dataset_id, tree_id, pos AS open, c FROM t) tc USING (dataset_id, tree_id, open)
LEFT JOIN (SELECT dataset_id, tree_id, cl.open, sum(c) AS c FROM t JOIN clades cl USING (dataset_id, tree_id, n_nationkey) GROUP BY ALL) cc USING (dataset_id, tree_id, open)
LEFT JOIN (SELECT dataset_id, tree_id, 0 AS open, sum(c) AS c FROM t GROUP BY ALL) rc USING (dataset_id, tree_id, open)""")
def _(d):
    return trees.clade_counts(_nodes(d), _counts(d)).select("dataset_id", "tree_id", "open", "name", "occurrence_count")


@query("clade_shape", f"""WITH {ORDERED}, s AS (SELECT dataset_id, tree_id, pos AS open, 1 AS n_tips, leaf AS first_leaf, 0.0 AS longest_path FROM tips UNION ALL SELECT dataset_id, tree_id, open, n, leaf, longest FROM clades UNION ALL SELECT dataset_id, tree_id, open, n, 0, longest FROM roots)
SELECT dataset_id, tree_id, open, row_number() OVER (PARTITION BY dataset_id, tree_id ORDER BY open) - 1 AS preorder, CAST(n_tips AS BIGINT) AS n_tips, first_leaf, CAST(longest_path AS DOUBLE) AS longest_path FROM s""")
def _(d):
    return trees.clade_shape(_nodes(d))


@query("clade_tips", f"""WITH {ORDERED}, {ABOVE} SELECT dataset_id, tree_id, node, pos, 'C' || CAST(c_custkey AS STRING) AS label FROM above""")
def _(d):
    nodes = _nodes(d)
    return trees.clade_tips(nodes, nodes.filter("NOT is_tip").select("dataset_id", "tree_id", F.col("open").alias("node")))


@query("link_status", f"""WITH {ORDERED}, {COUNTS} SELECT tips.dataset_id, tree_id, count(tip) AS linked_tips, count(*) AS total_tips, CAST(round(count(tip) * 100.0 / count(*)) AS BIGINT) AS percent, count(tip) > 0 AS has_links, coalesce(bool_or(has_coordinates), FALSE) AS has_coordinates
FROM tips LEFT JOIN counts ON counts.dataset_id = tips.dataset_id AND tip = 'C' || CAST(c_custkey AS STRING) GROUP BY 1, 2""")
def _(d):
    return trees.link_status(_nodes(d), _counts(d))


@query("search_tips", f"""WITH {ORDERED} SELECT dataset_id, tree_id, pos, 'C' || CAST(c_custkey AS STRING) AS label, row_number() OVER (PARTITION BY dataset_id, tree_id ORDER BY pos) AS rank FROM tips WHERE CAST(c_custkey AS STRING) LIKE '%7%' QUALIFY rank <= 10""")
def _(d):
    return trees.search_tips(_nodes(d), "7", 10)


@query("tree_summary", f"""WITH {ORDERED}, n AS (SELECT dataset_id, tree_id, count(*) AS k, string_agg(CASE WHEN leaf < 50 THEN 'C' || CAST(c_custkey AS STRING) END, ', ' ORDER BY leaf) AS labels FROM tips GROUP BY 1, 2)
SELECT dataset_id, tree_id, tree_id || '.txt' AS path, CASE WHEN tree_id LIKE 'ASIA%' THEN '[Error reading file: no access]' WHEN r_name IN ('AMERICA', 'EUROPE') THEN '#NEXUS' ELSE '(' END AS starts, CASE WHEN tree_id LIKE 'ASIA%' THEN '' ELSE labels END AS labels,
 CASE WHEN tree_id LIKE 'ASIA%' THEN 0 ELSE k END AS n_labels, CASE WHEN tree_id LIKE 'ASIA%' THEN FALSE ELSE k > 50 END AS truncated, CASE WHEN tree_id LIKE 'ASIA%' THEN 31 ELSE 0 END AS length FROM roots JOIN n USING (dataset_id, tree_id)""")
def _(d):
    files = _trees(d).withColumn("path", F.concat("tree_id", F.lit(".txt"))).withColumn(
        "error", F.when(F.col("tree_id").startswith("ASIA"), F.lit("no access")))
    out = trees.tree_summary(files)
    return out.withColumn("starts", F.when(F.col("preview").startswith("["), F.col("preview")).otherwise(
        F.regexp_extract("preview", r"^(#NEXUS|\()", 1))).withColumn("length", F.when(F.col("preview").startswith("["), F.length("preview")).otherwise(0)).drop("preview")


@query("records_for_tips", f"""WITH wanted AS (SELECT CAST(c_nationkey AS BIGINT) AS dataset_id, 'C' || CAST(c_custkey AS STRING) AS tip FROM customer WHERE c_mktsegment = 'MACHINERY'),
 f AS (SELECT * FROM plain_links JOIN wanted USING (dataset_id, tip) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY pos) = 1)
SELECT dataset_id, table_id, row_id, tip, occurrenceID, catalogNumber, scientificName, TRY_CAST(decimalLatitude AS DOUBLE) AS decimalLatitude, TRY_CAST(decimalLongitude AS DOUBLE) AS decimalLongitude FROM f""")
def _(d):
    wanted = d.sql("SELECT CAST(c_nationkey AS BIGINT) AS dataset_id, concat('C', CAST(c_custkey AS STRING)) AS tip FROM customer WHERE c_mktsegment = 'MACHINERY'")
    return links.records_for_tips(d.view("tip_links"), wanted)


POINTS = ABOVE + ", points AS (SELECT DISTINCT a.tree_id, a.node, l.dataset_id, l.table_id, l.row_id, TRY_CAST(decimalLatitude AS DOUBLE) AS lat, TRY_CAST(decimalLongitude AS DOUBLE) AS lon FROM above a JOIN plain_links l ON l.dataset_id = a.dataset_id AND l.tip = 'C' || CAST(c_custkey AS STRING) WHERE TRY_CAST(decimalLatitude AS DOUBLE) IS NOT NULL AND TRY_CAST(decimalLongitude AS DOUBLE) IS NOT NULL)"


def _clades(d):
    nodes = _nodes(d)
    return trees.clade_tips(nodes, nodes.filter("NOT is_tip").select("dataset_id", "tree_id", F.col("open").alias("node")))


@query("clade_map_points", f"WITH {ORDERED}, {POINTS} SELECT * FROM points")
def _(d):
    return links.clade_map_points(_clades(d), d.view("tip_links"))


@query("clade_bbox", f"WITH {ORDERED}, {POINTS} SELECT dataset_id, tree_id, node, min(lon) AS west, max(lon) AS east, max(lat) AS north, min(lat) AS south FROM points GROUP BY ALL")
def _(d):
    return links.clade_bbox(_clades(d), d.view("tip_links"))


@query("translate_tips", "SELECT dataset_id, tree_id, c_custkey AS pos, CASE WHEN format = 'nexus' THEN 'C' ELSE 't' END || CAST(c_custkey AS STRING) AS label FROM members")
def _(d):
    tips = d.sql("SELECT dataset_id, tree_id, c_custkey AS pos, concat('t', CAST(c_custkey AS STRING)) AS label FROM members")
    return links.translate_tips(tips, trees.nexus_translate(_trees(d)))


NAME_TIPS = "SELECT DISTINCT CAST(p_partkey % 25 AS BIGINT) AS dataset_id, concat(replace(upper(p_name), ' ', '_'), CASE WHEN p_size > 25 THEN '_01' WHEN p_size > 10 THEN '_P' ELSE '' END) AS label FROM part"


@query("match_tips_to_records", f"""SELECT label AS tip, dataset_id, table_id, row_id FROM ({NAME_TIPS}) JOIN occ USING (dataset_id) WHERE lower(replace(regexp_replace(label, '_(\\d+|[A-Z])$', ''), '_', ' ')) = lower(scientificName)""")
def _(d):
    return links.match_tips_to_records(d.sql(NAME_TIPS), d.view("occ"), links.tip_name_key(F.col("label")), F.lower("scientificName"))


@query("decode_tip_code", """SELECT c_custkey, lower(substr(c_mktsegment, 1, 3)) AS genus, lower(substr(c_mktsegment, 4, 3)) AS species, CAST(c_custkey AS STRING) AS number, substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2)) AS surname FROM customer""")
def _(d):
    t = d.table("customer").select("c_custkey", F.concat(F.left("c_mktsegment", F.lit(6)), F.col("c_custkey").cast("string"), F.lit("C")).alias("a"),
                                   F.concat(F.initcap("c_mktsegment"), F.lit("A"), F.col("c_custkey").cast("string")).alias("b"))
    return t.select("c_custkey", links.decode_tip_code(F.col("a")).alias("x"), links.decode_collector_code(F.col("b")).alias("y")).select(
        "c_custkey", "x.*", "y.surname")


# every label is a tip of its own dataset and of the next one
TIPS = """SELECT CAST(c_nationkey AS BIGINT) AS dataset_id, concat('C', CAST(c_custkey AS STRING)) AS label, c_custkey FROM customer WHERE c_custkey % 2 = 0
 UNION ALL SELECT CAST((c_nationkey + 1) % 25 AS BIGINT), concat('C', CAST(c_custkey AS STRING)), c_custkey FROM customer WHERE c_custkey % 2 = 0"""


def _record_links(d):
    return links.record_links(d.view("tip_links"))


@query("unmatched_tips", f"SELECT dataset_id, label, c_custkey FROM ({TIPS}) t WHERE NOT EXISTS (SELECT 1 FROM plain_links l WHERE l.dataset_id = t.dataset_id AND tip = label)")
def _(d):
    return links.unmatched_tips(d.sql(TIPS), _record_links(d))


@query("unmatched_records", "SELECT dataset_id, table_id, row_id FROM occ WHERE row_id NOT IN (SELECT row_id FROM plain_links)")
def _(d):
    return links.unmatched_records(d.view("tip_links"), _record_links(d)).select("dataset_id", "table_id", "row_id")


@query("match_stats", f"""WITH tips AS (SELECT dataset_id, label, EXISTS (SELECT 1 FROM plain_links l WHERE l.dataset_id = x.dataset_id AND tip = label) AS used FROM ({TIPS}) x),
 a AS (SELECT dataset_id, count(*) FILTER (used) AS matched_tips, count(*) FILTER (NOT used) AS unmatched_tips FROM tips GROUP BY 1),
 b AS (SELECT dataset_id, count(*) FILTER (row_id IN (SELECT row_id FROM plain_links)) AS matched_records, count(*) FILTER (row_id NOT IN (SELECT row_id FROM plain_links)) AS unmatched_records FROM occ GROUP BY 1)
SELECT dataset_id, coalesce(matched_records, 0) AS matched_records, coalesce(unmatched_records, 0) AS unmatched_records, coalesce(matched_tips, 0) AS matched_tips, coalesce(unmatched_tips, 0) AS unmatched_tips FROM a FULL JOIN b USING (dataset_id)""")
def _(d):
    return links.match_stats(d.sql(TIPS), d.view("tip_links"), _record_links(d))


@query("tip_set_diff", f"""SELECT dataset_id, 'tip' AS side, label FROM ({TIPS}) t WHERE NOT EXISTS (SELECT 1 FROM plain_links l WHERE l.dataset_id = t.dataset_id AND tip = label)
 UNION ALL SELECT DISTINCT dataset_id, 'link', tip FROM plain_links l WHERE NOT EXISTS (SELECT 1 FROM ({TIPS}) t WHERE l.dataset_id = t.dataset_id AND tip = label)""")
def _(d):
    return links.tip_set_diff(d.sql(TIPS), _record_links(d))


@query("join_lookup_table", "SELECT l_orderkey, l_linenumber, l_suppkey, s_name, s_nationkey FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey")
def _(d):
    lookup = d.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    return links.join_lookup_table(d.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), lookup, ["l_suppkey"])
