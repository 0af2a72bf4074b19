"""Cleaning of single values, run over whole columns."""

from pyspark.sql import functions as F

from ..functions import coords, dates, text
from ..operators import mapping, reshape
from .registry import query

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


@query("coerce_numeric", "SELECT row_id, TRY_CAST(decimalLatitude AS DOUBLE) AS decimalLatitude, TRY_CAST(individualCount AS DOUBLE) AS individualCount FROM occ")
def _(d):
    return mapping.coerce_numeric_columns(d.view("occ"), ["decimalLatitude", "individualCount"]).select(
        "row_id", "decimalLatitude", "individualCount")


MESSY = """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN ' N/A ' WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN 'Unknown' WHEN 4 THEN ' nan' WHEN 5 THEN '1d' WHEN 6 THEN ' 12.75 ' WHEN 7 THEN '-3e2' ELSE text END AS v FROM documents"""


@query("clean_text", f"SELECT doc_id, nullif(trim(v, {WS}), '') AS cleaned, coalesce(lower(nullif(trim(v, {WS}), '')) IN ('unknown','not known','not provided','n/a','na','none','null','tbd','pending'), TRUE) AS placeholder FROM ({MESSY})")
def _(d):
    return d.sql(MESSY).select("doc_id", text.clean_text(F.col("v")).alias("cleaned"), text.is_placeholder(F.col("v")).alias("placeholder"))


@query("coerce_int", f"""SELECT doc_id, CAST(trunc(n) AS BIGINT) AS i, n AS f FROM (SELECT doc_id, CASE WHEN regexp_full_match(trim(v), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN TRY_CAST(trim(v) AS DOUBLE) END AS n FROM ({MESSY}))
WHERE n IS NULL OR n IS NOT NULL""")
def _(d):
    return d.sql(MESSY).select("doc_id", text.coerce_int(F.col("v")).alias("i"), text.coerce_float(F.col("v")).alias("f"))


DOIS = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('https://doi.org/10.1/', url) WHEN 1 THEN concat(' doi:10.2/', url, ' ') WHEN 2 THEN 'doi: ' ELSE url END AS v, html FROM pages"


@query("normalize_doi", f"SELECT page_id, nullif(trim(replace(replace(replace(trim(v), 'https://doi.org/', ''), 'http://doi.org/', ''), 'doi:', '')), '') AS doi FROM ({DOIS})")
def _(d):
    return d.sql(DOIS).select("page_id", text.normalize_doi(F.col("v")).alias("doi"))


@query("lookup_key", "SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS key FROM documents")
def _(d):
    return d.table("documents").select("doc_id", text.lookup_key(F.col("text")).alias("key"))


@query("strip_examples", f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN trim(html, {WS}) ELSE html END AS definition FROM pages")
def _(d):
    t = d.sql("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat(html, ' Examples: one / two Examples: x') ELSE html END AS v FROM pages")
    return t.select("page_id", text.strip_examples(F.col("v")).alias("definition"))


@query("normalize_event_date", """SELECT row_id, CASE WHEN eventDate LIKE '%/%' THEN split_part(eventDate,'/',1) WHEN length(eventDate) = 4 THEN eventDate || '-01-01' WHEN length(eventDate) = 7 THEN eventDate || '-01' WHEN eventDate <> 'not a date' THEN eventDate END AS event_start,
 CASE WHEN eventDate LIKE '%/%' THEN split_part(eventDate,'/',2) WHEN length(eventDate) = 4 THEN eventDate || '-12-31' WHEN length(eventDate) = 7 THEN strftime(last_day(CAST(eventDate || '-01' AS DATE)), '%Y-%m-%d') WHEN eventDate <> 'not a date' THEN eventDate END AS event_end,
 eventDate AS iso, CASE WHEN eventDate LIKE '%/%' THEN 'range' WHEN length(eventDate) = 4 THEN 'year' WHEN length(eventDate) = 7 THEN 'month' WHEN eventDate <> 'not a date' THEN 'day' END AS "precision", coalesce(eventDate <> 'not a date', FALSE) AS ok FROM occ""")
def _(d):
    t = d.view("occ").select("row_id", dates.event_date(F.col("eventDate")).alias("e"))
    return t.select("row_id", F.date_format("e.start", "yyyy-MM-dd").alias("event_start"), F.date_format("e.end", "yyyy-MM-dd").alias("event_end"),
                    "e.iso", "e.precision", "e.ok")


WORDED = """SELECT o_orderkey AS id, o_orderdate AS od, CASE o_orderkey % 6 WHEN 0 THEN concat(CAST(day(o_orderdate) AS STRING), ' ', {month}, ' ', CAST(year(o_orderdate) AS STRING))
 WHEN 1 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' to ', CAST(CAST(o_orderdate + INTERVAL 40 DAY AS DATE) AS STRING)) WHEN 2 THEN concat(CAST(CAST(o_orderdate + INTERVAL 40 DAY AS DATE) AS STRING), '/', CAST(CAST(o_orderdate AS DATE) AS STRING))
 WHEN 3 THEN concat(CAST(year(o_orderdate) AS STRING), ' - ', CAST(year(o_orderdate) + 1 AS STRING)) WHEN 4 THEN concat({month}, ' ', CAST(day(o_orderdate) AS STRING), ' ', CAST(year(o_orderdate) AS STRING)) ELSE concat('sometime in ', {month}) END AS v FROM orders"""
DUCK_WORDED = WORDED.format(month="monthname(o_orderdate)")
SPARK_WORDED = WORDED.format(month="date_format(o_orderdate, 'MMMM')")
DAY = "strftime(od, '%Y-%m-%d')"
DAY40 = "strftime(od + INTERVAL 40 DAY, '%Y-%m-%d')"


@query("date_bounds", f"""SELECT id, CASE id % 6 WHEN 0 THEN {DAY} WHEN 1 THEN {DAY} WHEN 2 THEN {DAY} WHEN 3 THEN CAST(year(od) AS STRING) || '-01-01' WHEN 4 THEN {DAY} END AS s,
 CASE id % 6 WHEN 0 THEN {DAY} WHEN 1 THEN {DAY40} WHEN 2 THEN {DAY40} WHEN 3 THEN CAST(year(od) + 1 AS STRING) || '-12-31' WHEN 4 THEN {DAY} END AS e FROM ({DUCK_WORDED})""")
def _(d):
    t = d.sql(SPARK_WORDED).select("id", dates.date_bounds(F.col("v")).alias("b"))
    return t.select("id", F.date_format("b.start", "yyyy-MM-dd").alias("s"), F.date_format("b.end", "yyyy-MM-dd").alias("e"))


@query("scope_dates", f"""SELECT id, CASE WHEN id % 6 IN (0, 4) THEN 'single' WHEN id % 6 < 4 THEN 'range' END AS kind, CASE id % 6 WHEN 0 THEN {DAY} WHEN 1 THEN {DAY} WHEN 2 THEN {DAY40} WHEN 3 THEN CAST(year(od) AS STRING) || '-01-01' WHEN 4 THEN {DAY} END AS s,
 CASE id % 6 WHEN 1 THEN {DAY40} WHEN 2 THEN {DAY} WHEN 3 THEN CAST(year(od) + 1 AS STRING) || '-12-31' END AS e FROM ({DUCK_WORDED})""")
def _(d):
    return d.sql(SPARK_WORDED).select("id", dates.scope_dates(F.col("v")).alias("x")).select(
        "id", "x.kind", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


PARTS = "SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS BIGINT) AS y, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 13 ELSE CAST(month(l_shipdate) AS BIGINT) END AS m, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN 31 ELSE CAST(day(l_shipdate) AS BIGINT) END AS dd FROM lineitem"


@query("ymd_bounds", f"""WITH p AS ({PARTS}), b AS (SELECT l_orderkey, l_linenumber, y, m, dd, CASE WHEN m IS NULL THEN make_date(y, 1, 1) WHEN m > 12 THEN NULL WHEN dd IS NULL THEN make_date(y, m, 1) ELSE TRY_CAST(printf('%04d-%02d-%02d', y, m, dd) AS DATE) END AS s FROM p)
SELECT l_orderkey, l_linenumber, strftime(s, '%Y-%m-%d') AS s, strftime(CASE WHEN m IS NULL THEN make_date(y, 12, 31) WHEN dd IS NULL THEN last_day(s) ELSE s END, '%Y-%m-%d') AS e FROM b WHERE s IS NOT NULL""")
def _(d):
    t = d.sql(PARTS).select("l_orderkey", "l_linenumber", dates.ymd_bounds(F.col("y"), F.col("m"), F.col("dd")).alias("b"))
    return t.filter("b IS NOT NULL").select("l_orderkey", "l_linenumber", F.date_format("b.start", "yyyy-MM-dd").alias("s"), F.date_format("b.end", "yyyy-MM-dd").alias("e"))


SPOKEN = """SELECT c_custkey AS id, CAST(c_custkey % 90 AS INT) AS a, CAST(c_custkey % 45 AS INT) AS b, CAST(c_custkey * 7 % 180 AS INT) AS x, CAST(c_custkey * 11 % 180 AS INT) AS y,
 CASE c_custkey % 3 WHEN 0 THEN concat('Range ', CAST(c_custkey % 90 AS INT), '.5 S to ', CAST(c_custkey % 45 AS INT), ' N latitude and from ', CAST(c_custkey * 7 % 180 AS INT), ' W to ', CAST(c_custkey * 11 % 180 AS INT), ' E longitude')
  WHEN 1 THEN concat('Lat ', CAST(c_custkey % 90 AS INT), '-', CAST(c_custkey % 45 AS INT), '; long: ', CAST(c_custkey * 7 % 180 AS INT), ' to ', CAST(c_custkey * 11 % 180 AS INT)) ELSE c_name END AS v FROM customer"""


@query("bounds_from_text", f"""WITH n AS (SELECT id, CASE id % 3 WHEN 0 THEN -(a + 0.5) ELSE a END AS p, b AS q, CASE id % 3 WHEN 0 THEN -x ELSE x END AS u, y AS w FROM ({SPOKEN}) WHERE id % 3 < 2)
SELECT id, CAST(least(u, w) AS DOUBLE) AS west, CAST(greatest(u, w) AS DOUBLE) AS east, CAST(greatest(p, q) AS DOUBLE) AS north, CAST(least(p, q) AS DOUBLE) AS south FROM n""")
def _(d):
    spread = d.sql(SPOKEN).repartition(4 * d.spark.sparkContext.defaultParallelism, "id")  # much work per byte: splits by size are too few
    return spread.select("id", coords.bounds_from_text(F.col("v")).alias("b")).filter("b IS NOT NULL").select("id", "b.*")


BOXES = "SELECT s_suppkey AS id, s_acctbal / 50 AS w, s_acctbal / 90 AS e, s_acctbal / 100 AS n, s_acctbal / 300 AS s, s_suppkey % 3 AS k FROM supplier"


@query("normalize_bounds", f"""SELECT id, least(w, e) AS west, greatest(w, e) AS east, greatest(n, s) AS north, least(n, s) AS south FROM ({BOXES}) WHERE w BETWEEN -180 AND 180 AND e BETWEEN -180 AND 180 AND n BETWEEN -90 AND 90 AND s BETWEEN -90 AND 90""")
def _(d):
    t = d.sql(BOXES)
    long = F.to_json(F.struct(*[F.col(a).alias(f"{b}BoundingCoordinate") for a, b in zip("wens", ("west", "east", "north", "south"))]))
    short = F.to_json(F.struct(*[F.col(a).cast("string").alias(b) for a, b in zip("wens", ("west", "east", "north", "south"))]))
    text_ = F.when(F.col("k") == 0, long).when(F.col("k") == 1, short).otherwise(F.to_json(F.array("w", "e", "n", "s")))
    return t.select("id", coords.bounds_from_json(text_).alias("b")).filter("b IS NOT NULL").select("id", "b.*")


@query("format_coordinate", """SELECT l_orderkey, l_linenumber, l_tax, CASE WHEN t = '-0' THEN '0' ELSE t END AS v FROM (SELECT *, rtrim(rtrim(printf('%.6f', (l_quantity - 25) * l_discount / 8), '0'), '.') AS t FROM lineitem)""")
def _(d):
    v = (F.col("l_quantity") - 25) * F.col("l_discount") / 8
    return d.table("lineitem").select("l_orderkey", "l_linenumber", "l_tax", coords.format_coordinate(v).alias("v"))


RANKED = """SELECT o_orderkey AS id, concat(o_orderpriority, CASE o_orderkey % 8 WHEN 0 THEN 'aceae' WHEN 1 THEN 'idae' WHEN 2 THEN 'ales' WHEN 3 THEN 'mycota' WHEN 4 THEN 'opsida' ELSE '' END) AS n, CAST(o_orderkey % 3 AS INT) AS i, CAST(o_orderkey % 4 + 1 AS INT) AS k, o_orderkey % 8 AS e FROM orders"""


@query("infer_rank", f"SELECT id, CASE WHEN e < 2 THEN 'family' WHEN e = 2 THEN 'order' WHEN e = 3 THEN 'phylum' WHEN e = 4 THEN 'class' WHEN k = 1 THEN 'taxon' WHEN i = 0 THEN 'higherTaxon' ELSE 'taxon' END AS rank FROM ({RANKED})")
def _(d):
    return d.sql(RANKED).select("id", text.infer_rank(F.col("n"), F.col("i"), F.col("k")).alias("rank"))


@query("keywords_from_scope", f"""WITH parts AS (SELECT doc_id, unnest(string_split(text, ',')) AS p, generate_subscripts(string_split(text, ','), 1) AS i FROM documents),
 t AS (SELECT doc_id, trim(p, {WS}) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM parts WHERE trim(p, {WS}) <> ''),
 f AS (SELECT *, max(CASE WHEN regexp_matches(p, '[.;:()]') OR len(regexp_split_to_array(p, '[\\s\\x{{00a0}}]+')) > 3 OR length(p) > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS bad FROM t),
 k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM f WHERE bad = 0)
SELECT doc_id, pos, p AS name, CASE WHEN regexp_matches(lower(p), '(aceae|idae)$') THEN 'family' WHEN lower(p) LIKE '%ales' THEN 'order' WHEN regexp_matches(lower(p), '(mycota|phyta)$') THEN 'phylum' WHEN regexp_matches(lower(p), '(opsida|phyceae)$') THEN 'class' WHEN n = 1 OR pos > 0 THEN 'taxon' ELSE 'higherTaxon' END AS rank FROM k""")
def _(d):
    t = d.table("documents").select("doc_id", F.explode(text.keywords_from_scope(F.col("text"))).alias("k"))
    return t.select("doc_id", F.col("k.pos").cast("bigint").alias("pos"), "k.name", "k.rank")


@query("normalize_strings", f"""SELECT doc_id, nullif(trim(regexp_replace(text, '[\\s\\x{{00a0}}]+', ' ', 'g')), '') AS text, source FROM documents""")
def _(d):
    return reshape.normalize_strings(d.table("documents"), ["text"]).select("doc_id", "text", "source")


# the inverse Krueger series written out: third flattening n, rectifying radius, three terms each way
UTM = """WITH p AS (SELECT s_suppkey, s_suppkey % 60 + 1 AS z, s_suppkey % 2 = 0 AS north, CAST(200000 + s_suppkey * 7919 % 600000 AS DOUBLE) AS e, CAST(s_suppkey * 104729 % 9000000 AS DOUBLE) AS n FROM supplier),
 c AS (SELECT *, 1 / (2 * 298.257223563 - 1) AS f FROM p),
 r AS (SELECT *, 0.9996 * 6378137.0 / (1 + f) * (1 + f * f / 4 + f * f * f * f / 64) AS a, f / 2 - 2 * f * f / 3 + 37 * f * f * f / 96 AS b1, f * f / 48 + f * f * f / 15 AS b2, 17 * f * f * f / 480 AS b3,
  2 * f - 2 * f * f / 3 - 2 * f * f * f AS d1, 7 * f * f / 3 - 8 * f * f * f / 5 AS d2, 56 * f * f * f / 15 AS d3 FROM c),
 x AS (SELECT *, CASE WHEN north THEN n ELSE n - 10000000.0 END / a AS u, (e - 500000.0) / a AS v FROM r),
 y AS (SELECT *, u - b1 * sin(2 * u) * cosh(2 * v) - b2 * sin(4 * u) * cosh(4 * v) - b3 * sin(6 * u) * cosh(6 * v) AS xi, v - b1 * cos(2 * u) * sinh(2 * v) - b2 * cos(4 * u) * sinh(4 * v) - b3 * cos(6 * u) * sinh(6 * v) AS eta FROM x),
 q AS (SELECT *, asin(sin(xi) / cosh(eta)) AS chi FROM y)
SELECT s_suppkey, round(degrees(chi + d1 * sin(2 * chi) + d2 * sin(4 * chi) + d3 * sin(6 * chi)), 7) AS lat, round(degrees(atan(sinh(eta) / cos(xi))) + z * 6 - 183, 7) AS lon FROM q"""


@query("utm_to_latlon", UTM)
def _(d):
    t = d.sql(UTM.split("),\n c AS")[0] + ") SELECT * FROM p")
    at = coords.utm_to_latlon(F.col("z").cast("int"), F.col("north"), F.col("e"), F.col("n"))
    return t.select("s_suppkey", at.alias("p")).select("s_suppkey", F.round("p.lat", 7).alias("lat"), F.round("p.lon", 7).alias("lon"))
