"""Coverage inference, profiles and snapshots."""

from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators import coverage, profile
from ..plans.scratch import materialize
from .registry import query

SPANS = """spans AS (
 SELECT dataset_id, TRY_CAST(CASE WHEN eventDate LIKE '%/%' THEN split_part(eventDate,'/',1) WHEN length(eventDate) = 4 THEN eventDate || '-01-01' WHEN length(eventDate) = 7 THEN eventDate || '-01' ELSE eventDate END AS DATE) AS a,
  CASE WHEN eventDate LIKE '%/%' THEN CAST(split_part(eventDate,'/',2) AS DATE) WHEN length(eventDate) = 4 THEN CAST(eventDate || '-12-31' AS DATE) WHEN length(eventDate) = 7 THEN last_day(CAST(eventDate || '-01' AS DATE)) ELSE TRY_CAST(eventDate AS DATE) END AS b FROM occ
 UNION ALL
 SELECT dataset_id, CASE WHEN month IS NULL THEN make_date(CAST(year AS BIGINT),1,1) WHEN trim(day) = '' THEN make_date(CAST(year AS BIGINT), CAST(month AS BIGINT), 1) ELSE make_date(CAST(year AS BIGINT), CAST(month AS BIGINT), CAST(day AS BIGINT)) END,
  CASE WHEN month IS NULL THEN make_date(CAST(year AS BIGINT),12,31) WHEN trim(day) = '' THEN last_day(make_date(CAST(year AS BIGINT), CAST(month AS BIGINT), 1)) ELSE make_date(CAST(year AS BIGINT), CAST(month AS BIGINT), CAST(day AS BIGINT)) END FROM visits),
 temporal AS (SELECT dataset_id, min(a) AS s, max(b) AS e FROM spans WHERE a IS NOT NULL GROUP BY 1),
 temporal_text AS (SELECT dataset_id, strftime(s, '%Y-%m-%d') AS s, strftime(e, '%Y-%m-%d') AS e, CASE WHEN s = e THEN strftime(s, '%Y-%m-%d') ELSE strftime(s, '%Y-%m-%d') || '/' || strftime(e, '%Y-%m-%d') END AS temporal_scope FROM temporal)"""
BOX = """box AS (SELECT dataset_id, min(lon) AS west, max(lon) AS east, max(lat) AS north, min(lat) AS south FROM
  (SELECT dataset_id, TRY_CAST(decimalLatitude AS DOUBLE) AS lat, TRY_CAST(decimalLongitude AS DOUBLE) AS lon FROM occ)
  WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 GROUP BY 1)"""


def first_seen(name, source, key, value):
    """Distinct values by first row, numbered."""
    return f"""{name} AS (SELECT {key}, v, row_number() OVER (PARTITION BY {key} ORDER BY o) AS rn FROM (
  SELECT {key}, arg_min({value}, o) AS v, min(o) AS o FROM {source} WHERE trim({value}) <> '' GROUP BY {key}, lower({value})))"""


def summary(source, key, show, name):
    return f"""SELECT {key}, string_agg(v, ', ' ORDER BY rn) FILTER (rn <= {show}) || CASE WHEN count(*) > {show} THEN ' (+' || CAST(count(*) - {show} AS STRING) || ' more)' ELSE '' END AS {name}, count(*) AS n FROM {source} GROUP BY {key}"""


ORD_OCC = "(SELECT *, table_id * 100000000000 + row_id AS o FROM occ)"
ORD_VISITS = "(SELECT *, table_id * 100000000000 + row_id AS o FROM visits)"
GEO = (BOX + ", " + first_seen("seen_country", ORD_OCC, "dataset_id", "country")
       + ", country_text AS (" + summary("seen_country", "dataset_id", 5, "t") + ")"
       + ", " + first_seen("seen_region", ORD_VISITS, "dataset_id", "locality")
       + ", region_text AS (" + summary("seen_region", "dataset_id", 5, "t") + ")"
       + """, geo AS (SELECT dataset_id, concat_ws('; ', coalesce('Countries: ' || c.t, 'Regions: ' || r.t), 'Coordinate bounds: lat ' || printf('%.4f', south) || ' to ' || printf('%.4f', north) || ', lon ' || printf('%.4f', west) || ' to ' || printf('%.4f', east)) AS geographic_scope
  FROM (SELECT dataset_id FROM occ UNION SELECT dataset_id FROM visits) LEFT JOIN country_text c USING (dataset_id) LEFT JOIN region_text r USING (dataset_id) LEFT JOIN box USING (dataset_id))""")
TAX = first_seen("seen_kingdom", ORD_OCC, "dataset_id", "kingdom") + """,
 tax AS (SELECT dataset_id, CASE WHEN n = 1 THEN 'Kingdom: ' || t ELSE 'Kingdoms: ' || t END AS taxonomic_scope FROM (""" + summary("seen_kingdom", "dataset_id", 5, "t") + "))"
METHOD_ROWS = "(SELECT dataset_id, table_id * 100000000000 + row_id AS o, samplingProtocol AS method FROM occ UNION ALL SELECT dataset_id, table_id * 100000000000 + row_id, field_method FROM visits)"
METHOD = first_seen("seen_method", METHOD_ROWS, "dataset_id", "method") + """,
 method AS (SELECT dataset_id, CASE WHEN n = 1 THEN t ELSE 'Sampling protocol(s): ' || t END AS methodology FROM (""" + summary("seen_method", "dataset_id", 4, "t") + "))"
KEYWORDS = """keyword_rows AS (SELECT dataset_id, 1 AS i, 'kingdom' AS field, kingdom AS v, table_id, row_id FROM occ UNION ALL SELECT dataset_id, 5, 'family', family, table_id, row_id FROM occ),
 keyword_first AS (SELECT dataset_id, i, field, arg_min(v, table_id * 100000000000 + row_id) AS v, min(struct_pack(t := table_id, i := i, r := row_id)) AS o FROM keyword_rows GROUP BY dataset_id, i, field, lower(v)),
 keywords AS (SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY o) AS rank, field, v AS text FROM keyword_first)"""


def _visits(d):
    return d.view("visits")


@query("temporal_coverage", "WITH " + SPANS + """ SELECT dataset_id, s AS "start", e AS "end", temporal_scope FROM temporal_text""")
def _(d):
    return coverage.temporal_coverage(d.view("occ").drop("y", "m", "d"), _visits(d)).withColumns(
        {c: F.date_format(c, "yyyy-MM-dd") for c in ("start", "end")})


@query("geographic_bounds", "WITH " + BOX + " SELECT * FROM box")
def _(d):
    return coverage.geographic_bounds(d.view("occ"), _visits(d))


@query("geographic_scope", "WITH " + GEO + " SELECT * FROM geo")
def _(d):
    return coverage.geographic_scope(d.view("occ"), _visits(d))


@query("taxonomic_scope", "WITH " + TAX + " SELECT * FROM tax")
def _(d):
    return coverage.taxonomic_scope(d.view("occ"), _visits(d))


@query("taxonomic_keywords", "WITH " + KEYWORDS + " SELECT dataset_id, rank, field, text FROM keywords")
def _(d):
    return coverage.taxonomic_keywords(d.view("occ"), _visits(d))


@query("methodology", "WITH " + METHOD + " SELECT * FROM method")
def _(d):
    return coverage.methodology(d.view("occ"), _visits(d))


@query("first_seen_distinct", "WITH " + first_seen("seen", "(SELECT *, table_id * 100000000000 + row_id AS o FROM occ)", "dataset_id", "recordedBy")
       + " SELECT dataset_id, rn AS rank, v AS text FROM seen")
def _(d):
    values = d.view("occ").select("dataset_id", clean_text(F.col("recordedBy")).alias("text"),
                                  F.struct("table_id", "row_id").alias("ord")).filter("text IS NOT NULL")
    return coverage.first_seen_distinct(values, ["dataset_id"])


@query("coverage_metadata", "WITH " + ", ".join([SPANS, GEO, TAX, METHOD, KEYWORDS]) + """,
 meta AS (SELECT CAST(n_nationkey AS BIGINT) AS dataset_id, CASE n_nationkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN ' ' WHEN 2 THEN 'Alps' END AS p_geo, CASE n_nationkey % 3 WHEN 0 THEN '2024-01-31' WHEN 1 THEN '1990/1995' END AS p_time, CASE n_nationkey % 2 WHEN 0 THEN 'TBD' ELSE 'old notes' END AS e_method FROM nation),
 k AS (SELECT dataset_id, string_agg(field || '=' || text, ',' ORDER BY rank) AS keywords FROM keywords GROUP BY 1)
SELECT dataset_id,
 CASE WHEN p_time IS NULL OR p_time = '2024-01-31' THEN temporal_scope ELSE p_time END AS temporal_scope,
 CASE WHEN p_geo = 'Alps' THEN p_geo ELSE geographic_scope END AS geographic_scope, taxonomic_scope,
 CASE WHEN e_method = 'TBD' THEN methodology ELSE e_method END AS methodology, west, east, north, south, keywords AS taxonomic_keywords,
 concat_ws(' ', CASE WHEN p_time IS NULL THEN 'Temporal scope inferred from table dates: ' || temporal_scope || '.' WHEN p_time = '2024-01-31' THEN 'Temporal scope adjusted from placeholder ''2024-01-31'' to data-derived range ''' || temporal_scope || '''.' END,
  CASE WHEN p_geo = 'Alps' THEN NULL WHEN p_geo = 'n/a' THEN 'Geographic scope adjusted from placeholder ''n/a'' to data-derived value ''' || geographic_scope || '''.' ELSE 'Geographic scope inferred from table data: ' || geographic_scope || '.' END,
  'Taxonomic scope inferred from table data: ' || taxonomic_scope || '.',
  CASE WHEN e_method = 'TBD' THEN 'Methodology adjusted from placeholder ''TBD'' to data-derived value ''' || methodology || '''.' END) AS notes
FROM (SELECT dataset_id FROM occ UNION SELECT dataset_id FROM visits) LEFT JOIN temporal_text USING (dataset_id) LEFT JOIN geo USING (dataset_id) LEFT JOIN tax USING (dataset_id) LEFT JOIN method USING (dataset_id) LEFT JOIN box USING (dataset_id) LEFT JOIN meta USING (dataset_id) LEFT JOIN k USING (dataset_id)""")
def _(d):
    meta = d.sql("""SELECT CAST(n_nationkey AS BIGINT) AS dataset_id, CASE n_nationkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN ' ' WHEN 2 THEN 'Alps' END AS provided_geographic_scope,
      CASE n_nationkey % 3 WHEN 0 THEN '2024-01-31' WHEN 1 THEN '1990/1995' END AS provided_temporal_scope, CASE n_nationkey % 2 WHEN 0 THEN 'TBD' ELSE 'old notes' END AS existing_methodology FROM nation""")
    out = coverage.coverage_metadata([d.view("occ").drop("y", "m", "d"), _visits(d)], meta, F.lit("2024-01-31").cast("date"))
    return out.withColumn("taxonomic_keywords", F.array_join(F.transform(
        "taxonomic_keywords", lambda k: F.concat(k["rank"], F.lit("="), k["scientificName"])), ","))


@query("resolve_scope", """
WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Unknown' WHEN 2 THEN '  ' ELSE o_orderpriority END AS p, CASE o_orderkey % 2 WHEN 0 THEN o_orderstatus END AS e, CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE 'F' END AS i FROM orders),
 c AS (SELECT id, nullif(trim(coalesce(p, e)), '') AS c, i FROM t)
SELECT id, CASE WHEN c IS NULL THEN i WHEN c = 'Unknown' AND i IS NOT NULL THEN i ELSE c END AS value,
 CASE WHEN c IS NULL AND i IS NOT NULL THEN 'Field inferred from table data: ' || i || '.' WHEN c = 'Unknown' AND i IS NOT NULL THEN 'Field adjusted from placeholder ''Unknown'' to data-derived value ''' || i || '''.' END AS note FROM c""")
def _(d):
    t = d.sql("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Unknown' WHEN 2 THEN '  ' ELSE o_orderpriority END AS p, CASE o_orderkey % 2 WHEN 0 THEN o_orderstatus END AS e, CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE 'F' END AS i FROM orders")
    return t.select("id", coverage.resolve_scope(F.col("p"), F.col("e"), F.col("i"), "Field").alias("r")).select("id", "r.*")


@query("union_tables", """SELECT dataset_id, table_id, row_id, country, locality FROM (
 SELECT dataset_id, table_id, row_id, country, NULL AS locality FROM occ UNION ALL SELECT dataset_id, table_id, row_id, NULL, locality FROM visits)""")
def _(d):
    ids = ["dataset_id", "table_id", "row_id"]
    return coverage.union_tables(d.view("occ").select(*ids, "country"), _visits(d).select(*ids, "locality"))


FREQ = """freq AS (SELECT dataset_id, table_id, "column", value, count(*) AS n FROM (
  SELECT dataset_id, table_id, 'basisOfRecord' AS "column", basisOfRecord AS value FROM occ UNION ALL SELECT dataset_id, table_id, 'catalogNumber', catalogNumber FROM occ
  UNION ALL SELECT dataset_id, table_id, 'scientificName', scientificName FROM occ UNION ALL SELECT dataset_id, table_id, 'eventDate', eventDate FROM occ
  UNION ALL SELECT dataset_id, table_id, 'individualCount', individualCount FROM occ) GROUP BY ALL)"""
PROFILED = ["dataset_id", "table_id", "row_id", "basisOfRecord", "catalogNumber", "scientificName", "eventDate", "individualCount"]


@query("merged_profiles", "WITH " + FREQ + """ SELECT dataset_id, table_id, "column", CAST(coalesce(sum(n) FILTER (value IS NULL), 0) AS BIGINT) AS nulls, CAST(sum(n) AS BIGINT) AS total, TRUE AS within_error FROM freq GROUP BY ALL""")
def _(d):
    """Profiles of three parts of the rows, stored and merged; the distinct values are within 10 % of the exact ones (six standard errors)."""
    occ = d.view("occ").select(PROFILED)
    parts = [materialize(profile.profile_sketch(occ.filter(F.pmod("row_id", F.lit(3)) == k)), "profile") for k in range(3)]
    merged = profile.profile_of(profile.merge_profiles(*parts))
    exact = profile.column_profile(occ).select("dataset_id", "table_id", "column", F.col("distinct_values").alias("exact"))
    close = F.abs(F.col("distinct_values") - F.col("exact")) * 10 <= F.col("exact")
    return merged.join(exact, ["dataset_id", "table_id", "column"]).select("dataset_id", "table_id", "column", "nulls", "total", close.alias("within_error"))


@query("column_profile", "WITH " + FREQ + """ SELECT dataset_id, table_id, "column", count(value) AS distinct_values, CAST(coalesce(sum(n) FILTER (value IS NULL), 0) AS BIGINT) AS nulls, CAST(sum(n) AS BIGINT) AS total FROM freq GROUP BY ALL""")
def _(d):
    return profile.column_profile(d.view("occ").select(PROFILED))


COUNTS = """ranked AS (SELECT *, count(*) OVER (PARTITION BY dataset_id, table_id, "column") AS n_distinct, row_number() OVER (PARTITION BY dataset_id, table_id, "column" ORDER BY n DESC, value) AS place FROM freq WHERE value IS NOT NULL),
 counted AS (SELECT dataset_id, table_id, "column", place, left(value, 50) AS shown, n, n_distinct FROM ranked WHERE n_distinct <= 10 OR place <= 5 OR (n_distinct > 7 AND place > n_distinct - 2))"""


@query("value_counts", "WITH " + FREQ + ", " + COUNTS + " SELECT * FROM counted")
def _(d):
    return profile.value_counts(d.view("occ").select(PROFILED))


@query("profile_text", "WITH " + FREQ + ", " + COUNTS + """,
 lines AS (SELECT dataset_id, table_id, row_number() OVER (PARTITION BY dataset_id, table_id ORDER BY n_distinct, "column") AS pos, "column" || ' | ' || CAST(n_distinct AS STRING) || ' distinct | ' || string_agg(shown || ': ' || CAST(n AS STRING), ', ' ORDER BY place) AS line FROM counted GROUP BY dataset_id, table_id, "column", n_distinct),
 used AS (SELECT *, sum(len(string_split(line, ' '))) OVER (PARTITION BY dataset_id, table_id ORDER BY pos) AS u FROM lines)
SELECT dataset_id, table_id, string_agg(line, chr(10) ORDER BY pos) AS profile, CAST(max(u) AS BIGINT) AS n_words FROM used WHERE u <= 60 GROUP BY ALL""")
def _(d):
    return profile.profile_text(profile.profile_lines(d.view("occ").select(PROFILED)), 60)


SHOWN = ["occurrenceID", "basisOfRecord", "scientificName", "eventDate", "decimalLatitude", "samplingProtocol", "y", "m", "d", "tip_key"]
SHOWN_SQL = " UNION ALL ".join(f"SELECT *, {i if i < 5 else i + 7} AS pos, '{c}' AS \"column\", CAST({c} AS STRING) AS value FROM s" for i, c in enumerate(SHOWN))


@query("snapshot", f"""
WITH r AS (SELECT *, count(*) OVER w AS k, row_number() OVER (PARTITION BY dataset_id, table_id ORDER BY row_id) AS a, row_number() OVER (PARTITION BY dataset_id, table_id ORDER BY row_id DESC) AS b FROM occ WINDOW w AS (PARTITION BY dataset_id, table_id)),
 s AS (SELECT * FROM r WHERE k <= 10 OR a <= 5 OR b <= 5)
SELECT dataset_id, table_id, row_id, pos, "column", value, '[' || CAST(k AS STRING) || ' rows x 17 columns]' AS size FROM ({SHOWN_SQL})""")
def _(d):
    return profile.snapshot(d.view("occ"))


@query("snapshot_cells", "SELECT doc_id, CASE WHEN length(text) > 70 THEN substr(text, 1, 67) || '...' ELSE text END AS text, source FROM documents")
def _(d):
    return profile.snapshot_cells(d.table("documents").select("doc_id", "text", "source"))
