"""Reshaping of tables and sheets."""

from pyspark.sql import functions as F

from ..operators import reshape
from ..plans.scratch import materialize
from .registry import query

MATRIX = """SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN CAST(CAST(l_quantity AS INT) AS STRING) ELSE ' ' END AS site_a, CASE WHEN l_returnflag = 'N' THEN CAST(CAST(l_quantity AS INT) AS STRING) END AS site_n, l_linestatus AS site_s FROM lineitem"""


@query("unpivot_crosstab", f"""SELECT l_orderkey, l_linenumber, site, n FROM (SELECT l_orderkey, l_linenumber, 'site_a' AS site, site_a AS n FROM ({MATRIX}) UNION ALL SELECT l_orderkey, l_linenumber, 'site_n', site_n FROM ({MATRIX}) UNION ALL SELECT l_orderkey, l_linenumber, 'site_s', site_s FROM ({MATRIX})) WHERE trim(n) <> ''""")
def _(d):
    return reshape.unpivot_crosstab(d.sql(MATRIX), ["l_orderkey", "l_linenumber"], ["site_a", "site_n", "site_s"], "site", "n")


@query("fill_down", "SELECT dataset_id, table_id, row_id, last_value(catalogNumber IGNORE NULLS) OVER w AS catalogNumber, last_value(occurrenceID IGNORE NULLS) OVER w AS occurrenceID FROM occ WINDOW w AS (PARTITION BY dataset_id, table_id ORDER BY row_id)")
def _(d):
    t = d.view("occ").select("dataset_id", "table_id", "row_id", "catalogNumber", "occurrenceID")
    return reshape.fill_down(t, ["catalogNumber", "occurrenceID"], block=1000)


@query("merge_header_rows", "SELECT file, sheet, col_id, coalesce(string_agg(nullif(trim(value), ''), ' ' ORDER BY row_id), '') AS name FROM cells_of WHERE row_id < 3 GROUP BY ALL")
def _(d):
    return reshape.merge_header_rows(d.view("cells_of"), 3)


ISLANDS = """filled AS (SELECT file, sheet, row_id, col_id FROM cells_of WHERE trim(value) <> ''),
 bands AS (SELECT file, sheet, row_id, row_id - dense_rank() OVER (PARTITION BY file, sheet ORDER BY row_id) AS band FROM (SELECT DISTINCT file, sheet, row_id FROM filled)),
 strips AS (SELECT file, sheet, band, col_id, col_id - dense_rank() OVER (PARTITION BY file, sheet, band ORDER BY col_id) AS strip FROM (SELECT DISTINCT file, sheet, band, col_id FROM filled JOIN bands USING (file, sheet, row_id))),
 islands AS (SELECT file, sheet, min(row_id) AS r0, max(row_id) AS r1, min(col_id) AS c0, max(col_id) AS c1 FROM filled JOIN bands USING (file, sheet, row_id) JOIN strips USING (file, sheet, band, col_id) GROUP BY file, sheet, band, strip)"""


@query("data_islands", f"WITH {ISLANDS} SELECT * FROM islands")
def _(d):
    return reshape.data_islands(d.view("cells_of"))


GRID = """SELECT 'f' || CAST(CAST(floor(p_partkey / 400) AS BIGINT) AS STRING) AS file, CASE WHEN p_partkey % 2 = 0 THEN 's' END AS sheet, CAST(floor(p_partkey % 400 / 2) AS BIGINT) AS row_id, col_id,
 CASE WHEN col_id < 2 AND floor(p_partkey % 400 / 2) % 5 = 4 THEN NULL WHEN col_id > 2 AND floor(p_partkey % 400 / 2) % 7 = 6 THEN ' ' WHEN col_id = 2 THEN '' ELSE p_name END AS value
FROM part CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS c(col_id)"""


@query("islands_side_by_side", f"""WITH filled AS (SELECT DISTINCT file, sheet, row_id, CAST(floor(col_id / 3) AS INT) AS strip FROM ({GRID}) WHERE trim(value) <> ''),
 runs AS (SELECT *, row_id - row_number() OVER (PARTITION BY file, sheet, strip ORDER BY row_id) AS run FROM filled)
SELECT file, sheet, min(row_id) AS r0, max(row_id) AS r1, strip * 3 AS c0, strip * 3 + 1 AS c1 FROM runs GROUP BY file, sheet, strip, run""")
def _(d):
    """Two strips of columns with empty rows of their own; every second sheet has no name."""
    return reshape.data_islands(d.sql(GRID))


@query("merge_islands", f"""WITH {ISLANDS}, placed AS (SELECT c.file, c.sheet, i.r0, i.c0, c.row_id, c.col_id - i.c0 AS pos, c.value FROM cells_of c JOIN islands i ON c.file = i.file AND c.sheet = i.sheet AND c.row_id BETWEEN r0 AND r1 AND c.col_id BETWEEN c0 AND c1),
 heads AS (SELECT file, sheet, r0, c0, string_agg(coalesce(value, ''), '|' ORDER BY pos) AS header FROM placed WHERE row_id = r0 GROUP BY ALL)
SELECT header, file, sheet, r0, row_id, pos, value FROM placed JOIN heads USING (file, sheet, r0, c0) WHERE row_id > r0""")
def _(d):
    cells = d.view("cells_of")
    islands = materialize(reshape.data_islands(cells), "islands")  # read several times
    return reshape.merge_islands(cells, islands)


PROPS = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '{"a":1}' WHEN 2 THEN '{"phylogenies":[{"phyloTreeTipLabel":"old","phyloTreeFileName":"t.nwk"}]}' ELSE 'junk' END AS dynamicProperties FROM orders"""


@query("tip_links_to_json", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 1 THEN '{"a":1,' ELSE '{' END || '"phylogenies":[' || CASE o_orderkey % 4 WHEN 2 THEN '{"phyloTreeFileName":"t.nwk","phyloTreeTipLabel":"old"},' ELSE '' END
 || '{"phyloTreeFileName":"trees.nwk","phyloTreeTipLabel":"C' || CAST(o_custkey AS STRING) || '"}]}' AS dynamicProperties FROM orders""")
def _(d):
    links = d.sql("SELECT o_orderkey AS id, concat('C', CAST(o_custkey AS STRING)) AS tip, 'trees.nwk' AS file FROM orders")
    return reshape.tip_links_to_json(d.sql(PROPS), links, "id")
