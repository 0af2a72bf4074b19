"""Row validation, links and names."""

from pyspark.sql import functions as F

from ..operators import names, rules
from ..plans.scratch import materialize
from .registry import query

def fixed_day():
    """The day the future-date rule is checked against."""
    return F.lit("1999-06-30").cast("date")


END = """CASE WHEN eventDate LIKE '%/%' THEN CAST(split_part(eventDate, '/', 2) AS DATE)
 WHEN length(eventDate) = 4 THEN make_date(CAST(eventDate AS BIGINT), 12, 31)
 WHEN length(eventDate) = 7 THEN last_day(CAST(eventDate || '-01' AS DATE))
 WHEN regexp_matches(eventDate, '^[0-9-]{10}$') THEN CAST(eventDate AS DATE) END"""
ALLOWED = ", ".join(f"'{x}'" for x in rules.BASIS_OF_RECORD)
BAD = {
    "basisOfRecord": f"(basisOfRecord IS NULL OR basisOfRecord NOT IN ({ALLOWED}))",
    "decimalLatitude": "coalesce(TRY_CAST(decimalLatitude AS DOUBLE) NOT BETWEEN -90 AND 90, TRUE)",
    "decimalLongitude": "coalesce(TRY_CAST(decimalLongitude AS DOUBLE) NOT BETWEEN -180 AND 180, TRUE)",
    "individualCount": "coalesce(TRY_CAST(individualCount AS DOUBLE) <= 0 OR TRY_CAST(individualCount AS DOUBLE) <> floor(TRY_CAST(individualCount AS DOUBLE)), TRUE)",
    "eventDate": f"({END}) IS NULL",
    "eventDateFuture": f"({END}) > DATE '1999-06-30'",
}


def _flags_sql(rule):
    return f"SELECT dataset_id, table_id, '{rule}' AS rule, row_id FROM occ WHERE {BAD[rule]}"


DUP_CATALOG = """SELECT dataset_id, table_id, 'catalogNumber' AS rule, row_id FROM occ
 QUALIFY count(*) OVER (PARTITION BY dataset_id, table_id, catalogNumber) > 1"""
DUP_ID = """SELECT dataset_id, table_id, 'occurrenceID' AS rule, row_id FROM occ WHERE trim(occurrenceID) <> ''
 QUALIFY count(*) OVER (PARTITION BY dataset_id, table_id, lower(trim(occurrenceID))) > 1"""


@query("bad_basis_of_record", _flags_sql("basisOfRecord"))
def _(d):
    return rules.bad_basis_of_record(d.view("occ"))


@query("bad_latitude", _flags_sql("decimalLatitude"))
def _(d):
    return rules.bad_latitude(d.view("occ"))


@query("bad_longitude", _flags_sql("decimalLongitude"))
def _(d):
    return rules.bad_longitude(d.view("occ"))


@query("bad_individual_count", _flags_sql("individualCount"))
def _(d):
    return rules.bad_individual_count(d.view("occ"))


@query("bad_event_date", _flags_sql("eventDate"))
def _(d):
    return rules.bad_event_date(d.view("occ"))


@query("future_event_date", _flags_sql("eventDateFuture"))
def _(d):
    return rules.future_event_date(d.view("occ"), fixed_day())


@query("duplicate_catalog_number", DUP_CATALOG)
def _(d):
    return rules.duplicate_catalog_number(d.view("occ"))


@query("duplicate_occurrence_id", DUP_ID)
def _(d):
    return rules.duplicate_occurrence_id(d.view("occ"))


@query("row_flags", " UNION ALL ".join(_flags_sql(r) for r in BAD))
def _(d):
    occ = d.view("occ")
    return rules.row_flags(occ, rules.row_rules(occ.columns, today=fixed_day()))


@query("register_rules", _flags_sql("basisOfRecord").replace(f"({ALLOWED})", "('HumanObservation', 'specimen')") + """
 UNION ALL SELECT dataset_id, table_id, 'countryMatchesName', row_id FROM occ WHERE length(country) > 8
 UNION ALL """ + _flags_sql("decimalLatitude"))
def _(d):
    occ = d.view("occ")
    base = [r for r in rules.row_rules(occ.columns) if r[0] in ("basisOfRecord", "decimalLatitude")]
    extra = [("countryMatchesName", F.length("country") > 8),
             ("basisOfRecord", F.col("basisOfRecord").isNull() | ~F.col("basisOfRecord").isin("HumanObservation", "specimen"))]
    return rules.row_flags(occ, rules.register_rules(base, extra))


@query("validation_report", f"""
WITH flags AS ({' UNION ALL '.join(_flags_sql(r) for r in BAD)} UNION ALL {DUP_CATALOG} UNION ALL {DUP_ID}),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, table_id, rule ORDER BY row_id) AS rn FROM flags),
 found AS (SELECT dataset_id, table_id, rule, count(*) AS bad_rows, string_agg(CASE WHEN rn <= 30 THEN CAST(row_id AS STRING) END, ',' ORDER BY row_id) AS row_ids FROM ranked GROUP BY ALL),
 checked AS (SELECT * FROM (SELECT DISTINCT dataset_id, table_id FROM occ), (SELECT unnest(['basisOfRecord','decimalLatitude','decimalLongitude','individualCount','eventDate','eventDateFuture','catalogNumber','occurrenceID']) AS rule))
SELECT dataset_id, table_id, rule, coalesce(bad_rows, 0) AS bad_rows, coalesce(row_ids, '') AS row_ids, CASE WHEN bad_rows > 0 THEN 'failed' ELSE 'compliant' END AS status
FROM checked LEFT JOIN found USING (dataset_id, table_id, rule)""")
def _(d):
    occ = materialize(d.view("occ"), "occ")  # a stored table, as the operators expect
    local = rules.row_rules(occ.columns, today=fixed_day())
    flags = (rules.row_flags(occ, local).unionByName(rules.duplicate_catalog_number(occ))
             .unionByName(rules.duplicate_occurrence_id(occ)))
    checked = rules.rules_checked(occ, [n for n, _ in local] + ["catalogNumber", "occurrenceID"])
    return rules.validation_report(flags, checked).withColumn(
        "row_ids", F.coalesce(F.array_join("row_ids", ","), F.lit("")))


@query("id_collision_examples", """
WITH s AS (SELECT DISTINCT dataset_id, table_id, lower(occurrenceID) AS id_key, occurrenceID AS spelling, count(*) OVER (PARTITION BY dataset_id, table_id, lower(occurrenceID)) AS n FROM occ WHERE occurrenceID IS NOT NULL),
 k AS (SELECT *, dense_rank() OVER (PARTITION BY dataset_id, table_id ORDER BY id_key) AS key_rank, row_number() OVER (PARTITION BY dataset_id, table_id, id_key ORDER BY spelling) AS r FROM s WHERE n > 1)
SELECT dataset_id, table_id, key_rank, id_key, string_agg(spelling, ' / ' ORDER BY spelling) AS example FROM k WHERE key_rank <= 5 AND r <= 3 GROUP BY ALL""")
def _(d):
    return rules.id_collision_examples(d.view("occ"), "occurrenceID")


@query("broken_links", """
SELECT occurrenceID, l_orderkey, l_linenumber, measurementType, measurementValue, measurementUnit FROM mof
WHERE NOT EXISTS (SELECT 1 FROM occ WHERE occ.occurrenceID = mof.occurrenceID)""")
def _(d):
    return rules.broken_links(d.view("mof"), d.view("occ"), "occurrenceID", "occurrenceID")


@query("completeness", """
WITH c AS (SELECT dataset_id, table_id, count(*) AS total, count(nullif(trim(occurrenceID), '')) AS a, count(nullif(trim(eventDate), '')) AS b,
 count(CASE WHEN decimalLatitude <> '' AND decimalLongitude <> '' THEN 1 END) AS l, count(nullif(individualCount, '')) AS q FROM occ GROUP BY ALL)
SELECT dataset_id, table_id, term, filled, total, filled / CAST(total AS DOUBLE) AS share FROM (
 SELECT dataset_id, table_id, total, 'occurrenceID' AS term, a AS filled FROM c UNION ALL SELECT dataset_id, table_id, total, 'eventDate', b FROM c
 UNION ALL SELECT dataset_id, table_id, total, 'recordNumber', 0 FROM c
 UNION ALL SELECT dataset_id, table_id, total, 'location', l FROM c UNION ALL SELECT dataset_id, table_id, total, 'abundance', q FROM c)""")
def _(d):
    return rules.completeness(d.view("occ"), ["occurrenceID", "eventDate", "recordNumber"])


@query("controlled_values", """
SELECT dataset_id, table_id, basisOfRecord AS value, count(*) AS n_rows FROM occ
WHERE basisOfRecord NOT IN (SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'HumanObservation' ELSE 'LivingSpecimen' END FROM orders) GROUP BY ALL""")
def _(d):
    vocab = d.sql("SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'HumanObservation' ELSE 'LivingSpecimen' END AS value FROM orders")
    return rules.controlled_values(d.view("occ"), "basisOfRecord", vocab)


NAMES = """WITH chosen AS (SELECT dataset_id, table_id, scientificName, count(*) AS n_rows FROM occ WHERE trim(scientificName) <> '' GROUP BY ALL)"""
MATCHES = """ distinct_names AS (SELECT DISTINCT scientificName AS name FROM occ),
 near AS (SELECT name, scientificName AS matched_name, levenshtein(lower(name), lower(scientificName)) AS e,
   (100 * (greatest(length(name), length(scientificName)) - levenshtein(lower(name), lower(scientificName)))) // greatest(length(name), length(scientificName)) AS confidence
  FROM distinct_names JOIN backbone ON TRUE),
 alike AS (SELECT * FROM near WHERE confidence >= 80),
 best AS (SELECT * FROM alike QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE WHEN name = matched_name THEN 0 ELSE 1 END, confidence DESC, matched_name) = 1),
 matches AS (SELECT n.name, CASE WHEN b.matched_name = n.name THEN 'EXACT' WHEN b.matched_name IS NULL THEN 'NONE' ELSE 'FUZZY' END AS match_type, b.matched_name, CAST(coalesce(b.confidence, 0) AS BIGINT) AS confidence
  FROM distinct_names n LEFT JOIN best b USING (name))"""


@query("names_to_check", NAMES + " SELECT * FROM chosen")
def _(d):
    return names.names_to_check(d.view("occ"))


@query("match_names", "WITH" + MATCHES + " SELECT * FROM matches")
def _(d):
    return names.match_names(d.view("occ"), d.view("backbone"))


# names changed in several places: alike to 50 % and more, or to less
CHANGED = "SELECT DISTINCT CASE CAST(row_id % 3 AS INT) WHEN 0 THEN translate(scientificName, 'aeo', 'uia') WHEN 1 THEN substr(scientificName, 3, 9) ELSE scientificName || ' var. nova' END AS scientificName FROM occ"
MODERATE = f"""WITH near AS (SELECT n.scientificName AS name, b.scientificName AS matched_name,
   (100 * (greatest(length(n.scientificName), length(b.scientificName)) - levenshtein(lower(n.scientificName), lower(b.scientificName)))) // greatest(length(n.scientificName), length(b.scientificName)) AS confidence
  FROM ({CHANGED}) n JOIN backbone b ON TRUE),
 best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE WHEN name = matched_name THEN 0 ELSE 1 END, confidence DESC, matched_name) = 1),
 matches AS (SELECT name, CASE WHEN name = matched_name THEN 'EXACT' WHEN confidence < 50 THEN 'NONE' ELSE 'FUZZY' END AS match_type, CASE WHEN confidence >= 50 THEN matched_name END AS matched_name, CAST(CASE WHEN confidence >= 50 THEN confidence ELSE 0 END AS BIGINT) AS confidence FROM best)"""


@query("match_names_moderate", MODERATE + " SELECT * FROM matches")
def _(d):
    """Every likeness from 50 % on counts as a match."""
    return names.match_names(d.sql(CHANGED), d.view("backbone"), least=50)


@query("unmatched_names", MODERATE + " SELECT name FROM matches WHERE match_type = 'NONE'")
def _(d):
    return names.match_names(d.sql(CHANGED), d.view("backbone"), least=50).filter("match_type = 'NONE'").select("name")


@query("apply_name_corrections", "WITH" + MATCHES + """
SELECT row_id, CASE WHEN match_type = 'FUZZY' AND confidence >= 85 THEN matched_name ELSE scientificName END AS scientificName
FROM occ LEFT JOIN matches ON name = scientificName""")
def _(d):
    occ = d.view("occ")
    return names.apply_name_corrections(occ.select("row_id", "scientificName"), names.match_names(occ, d.view("backbone")))


@query("correction_messages", NAMES + "," + MATCHES + """,
 found AS (SELECT dataset_id, table_id, name, matched_name, confidence, CASE WHEN match_type = 'FUZZY' AND confidence >= 85 THEN 'corrected' WHEN match_type = 'FUZZY' AND confidence >= 80 THEN 'typo' WHEN match_type = 'NONE' OR confidence < 50 THEN 'unmatched' END AS kind
  FROM chosen JOIN matches ON name = scientificName),
 nr AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY dataset_id, table_id, kind ORDER BY name) AS rn, CASE WHEN kind = 'typo' THEN 3 ELSE 5 END AS most FROM found WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY dataset_id, table_id, kind))
SELECT dataset_id, table_id, kind, n, string_agg(CASE kind WHEN 'corrected' THEN '''' || name || ''' → ''' || matched_name || '''' WHEN 'typo' THEN '''' || name || ''' (suggested: ''' || matched_name || ''', confidence: ' || CAST(confidence AS STRING) || '%)' ELSE '''' || name || '''' END, '; ' ORDER BY rn)
  || CASE WHEN n > max(most) THEN '; and ' || CAST(n - max(most) AS STRING) || ' more' ELSE '' END AS message
FROM nr WHERE rn <= most GROUP BY dataset_id, table_id, kind, n""")
def _(d):
    occ = d.view("occ")
    return names.correction_messages(names.names_to_check(occ), names.match_names(occ, d.view("backbone")))
