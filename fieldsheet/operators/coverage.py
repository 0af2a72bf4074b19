"""Coverage inference over all tables of a dataset.

Every operator takes one frame per table layout. A frame holds rows of many datasets and tables
with the same header, so which columns exist is known when the plan is built and only those are
read. Results have one row (or a bounded list) per dataset.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import coords, dates
from ..functions.text import clean_text, coerce_float, coerce_int, is_placeholder
from ..plans.ranks import numbered
from ..plans.scratch import materialize
from ..plans.topk import joined_ranked, top_k

# Ranks from high to low with their plural labels.
RANKS = {"kingdom": "Kingdoms", "phylum": "Phyla", "class": "Classes", "order": "Orders", "family": "Families",
         "genus": "Genera"}
# Columns that name regions and methods.
REGION_COLUMNS = ["stateprovince", "county", "municipality", "locality"]
METHOD_COLUMNS = ["samplingprotocol", "methodology", "method", "protocol", "eventtype"]


def _header(t: DataFrame) -> dict[str, str]:
    return {c.strip().lower(): c for c in t.columns}


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _stack(parts) -> DataFrame | None:
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _datasets(tables) -> DataFrame:
    return _stack(t.select("dataset_id") for t in tables).distinct()


def union_tables(*tables: DataFrame) -> DataFrame:
    """Tables stacked by column name; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _places(have):
    return ["country"] if "country" in have else REGION_COLUMNS


def _methods(have):
    return [c for c in METHOD_COLUMNS if c in have] or [c for c in have if "protocol" in c or "method" in c]


# which columns of a header tell of a topic, in the order in which their values count as first seen
TOPICS = {"place": _places, "taxon": lambda have: [*RANKS, "scientificname"], "method": _methods}


def _read(t: DataFrame, have, fields, dated: bool, boxed: bool) -> DataFrame:
    """The texts of ``fields`` under their numbers, the dates a row covers (``a`` to ``b``) and its coordinates if both are in range.

    Values are read in steps of their own, each computed once: year, month and day then stay in generated code.
    """
    ids = ["dataset_id", F.col("table_id").cast("long").alias("t"), F.col("row_id").cast("long").alias("r")]
    texts = [str(n) for n in range(len(fields))]
    spans = [dates.date_bounds(_q(have[c])) for c in have if "date" in c] if dated else []
    spans = {f"span{n}": s for n, s in enumerate(spans)}
    given = {p: coerce_int(_q(have[p])) if p in have else F.lit(None).cast("bigint") for p in ("year", "month", "day")} if dated and "year" in have else {}
    pair = {"lat": coerce_float(_q(have["decimallatitude"])), "lon": coerce_float(_q(have["decimallongitude"]))} if boxed else {}
    rows = t.select(*ids, *[_q(have[c]).cast("string").alias(n) for n, (_, c, _) in zip(texts, fields)],
                    *[v.alias(n) for n, v in {**spans, **given, **pair}.items()])
    starts, ends = [[F.col(n)[side] for n in spans] for side in ("start", "end")]
    if given:
        rows = rows.withColumn("first", dates.ymd_start(*map(F.col, given)))
        starts.append(F.col("first"))
        ends.append(dates.ymd_end(F.col("first"), F.col("month"), F.col("day")))
    near = coords.in_range(F.col("lat"), F.col("lon")) if boxed else None
    return rows.select("dataset_id", "t", "r", *[f"`{n}`" for n in texts],
                       (F.array_min(F.array(*starts)) if starts else F.lit(None).cast("date")).alias("a"),
                       (F.array_max(F.array(*ends)) if ends else F.lit(None).cast("date")).alias("b"),
                       *[(F.when(near, F.col(c)) if boxed else F.lit(None).cast("double")).alias(c) for c in ("lat", "lon")])


def _gather(tables, topics) -> DataFrame | None:
    """One row per dataset, topic, field and value (ignoring case) of all tables, from one scan of each.

    Text topics give ``text``, the spelling that came first, with ``ord``, its table, column and row. The
    topic ``dataset``, a row for every dataset, holds the earliest start ``a`` and latest end ``b`` of ``dates``
    and the coordinate bounds of ``box``, null where there are none.
    Rows meet in a hash aggregate by their text as it is stored; only distinct texts are cleaned, lower-cased and sorted.
    Null if no table has a column for any of the topics.
    """
    parts = []
    for t in tables:
        have = _header(t)
        fields = [(topic, c, i) for topic in topics if topic in TOPICS for i, c in enumerate(TOPICS[topic](have)) if c in have]
        dated = "dates" in topics and ("year" in have or any("date" in c for c in have))
        boxed = "box" in topics and {"decimallatitude", "decimallongitude"} <= have.keys()
        kinds = [*fields, ("dataset", None, 0)] if dated or boxed or "dataset" in topics else fields
        if not kinds:
            continue
        rows = _read(t, have, fields, dated, boxed).withColumn(str(len(fields)), F.lit(""))
        whole = F.col("n") == str(len(fields))
        values = rows.unpivot(["dataset_id", "t", "r", "a", "b", "lat", "lon"], [F.col(f"`{n}`") for n in range(len(kinds))], "n", "raw").filter("raw IS NOT NULL")
        values = values.withColumns({c: F.when(whole, F.col(c)) for c in ("a", "b", "lat", "lon")})
        seen = values.groupBy("dataset_id", "t", "n", "raw").agg(
            F.min("r").alias("r"), F.min(F.col("r").isNotNull()).alias("known"), F.min("a").alias("a"), F.max("b").alias("b"),
            F.min("lon").alias("west"), F.max("lon").alias("east"), F.max("lat").alias("north"), F.min("lat").alias("south"))
        kind = F.array(*[F.struct(F.lit(topic).alias("topic"), F.lit(c).cast("string").alias("field"), F.lit(i).alias("i")) for topic, c, i in kinds])
        seen = seen.withColumns({"c": kind[F.col("n").cast("int")], "text": clean_text(F.col("raw"))})
        first = F.struct("t", "c.i", F.when(F.col("known"), F.col("r")).alias("r"))  # a row without an id comes first
        parts.append(seen.select("dataset_id", "c.topic", "c.field", first.alias("ord"), "text", "a", "b", "west", "east", "north", "south"))
    if not parts:
        return None
    return _stack(parts).groupBy("dataset_id", "topic", "field", F.lower("text").alias("_k")).agg(
        F.min(F.struct("ord", "text")).alias("f"), F.min("a").alias("a"), F.max("b").alias("b"), F.min("west").alias("west"),
        F.max("east").alias("east"), F.max("north").alias("north"), F.min("south").alias("south")).filter(
        "f.text IS NOT NULL OR topic = 'dataset'").select(  # blank texts go last: a filter on them would be moved down to the rows
        "dataset_id", "topic", "field", "f.ord", "f.text", "a", "b", "west", "east", "north", "south")


def first_seen(values: DataFrame, keys) -> DataFrame:
    """Distinct ``text`` per key ignoring case, in the spelling and with the ``ord`` that came first."""
    seen = values.groupBy(*keys, F.lower("text").alias("_k")).agg(F.min(F.struct("ord", "text")).alias("f"))
    return seen.select(*keys, "f.ord", "f.text")


def first_seen_distinct(values: DataFrame, keys, most: int | None = None) -> DataFrame:
    """Distinct ``text`` per key ignoring case in first-seen ``ord``, first spelling, numbered; only the first ``most`` if given."""
    seen = first_seen(values, keys)
    if most is None:
        return numbered(seen, keys, ["ord"]).select(*keys, "rank", "text")
    return top_k(seen, keys, ["ord"], most).select(*keys, "rank", "text")


def summarize_values(seen: DataFrame, keys, label: Column, show: int, name: str) -> DataFrame:
    """``label: a, b (+k more)`` of all distinct values of ``first_seen``, with their number."""
    counts = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    listed = joined_ranked(top_k(seen, keys, ["ord"], show), keys, "rank", F.col("text"), ", ", "_l")
    more = F.when(F.col("_n") > show, F.concat(F.lit(" (+"), (F.col("_n") - show).cast("string"), F.lit(" more)"))).otherwise("")
    return listed.join(counts, keys).select(*keys, F.concat(label, F.lit(": "), "_l", more).alias(name), F.col("_n").alias("n_values"))


def _none(tables, columns) -> DataFrame:
    return _datasets(tables).select("dataset_id", *[F.lit(None).cast(k).alias(c) for c, k in columns.items()]).limit(0)


def _temporal(found: DataFrame) -> DataFrame:
    total = found.filter("a IS NOT NULL").select("dataset_id", F.col("a").alias("start"), F.col("b").alias("end"))
    iso = [F.date_format(c, "yyyy-MM-dd") for c in ("start", "end")]
    scope = F.when(F.col("start") == F.col("end"), iso[0]).otherwise(F.concat(iso[0], F.lit("/"), iso[1]))
    return total.withColumn("temporal_scope", scope)


def temporal_coverage(*tables: DataFrame) -> DataFrame:
    """Earliest start and latest end of all date columns and year/month/day of a dataset, with scope text."""
    found = _gather(tables, ["dates"])
    return _none(tables, {"start": "date", "end": "date", "temporal_scope": "string"}) if found is None else _temporal(found)


def _box(found: DataFrame) -> DataFrame:
    return found.filter("west IS NOT NULL").select("dataset_id", "west", "east", "north", "south")


def geographic_bounds(*tables: DataFrame) -> DataFrame:
    """West, east, north, south of the coordinate pairs that are numeric and in range."""
    found = _gather(tables, ["box"])
    return _none(tables, dict.fromkeys(("west", "east", "north", "south"), "double")) if found is None else _box(found)


def _geographic(found: DataFrame) -> DataFrame:
    box = F.format_string("Coordinate bounds: lat %.4f to %.4f, lon %.4f to %.4f", "south", "north", "west", "east")
    boxed = _box(found).select("dataset_id", box.alias("box"))
    kind = F.when(F.col("field") == "country", "Countries").otherwise("Regions")
    seen = first_seen(found.filter("topic = 'place'").withColumn("kind", kind), ["dataset_id", "kind"])
    texts = summarize_values(seen, ["dataset_id", "kind"], F.col("kind"), 5, "text")
    chosen = texts.groupBy("dataset_id").agg(F.min_by("text", "kind").alias("text"))  # Countries before Regions
    return chosen.join(boxed, "dataset_id", "full").select("dataset_id", F.concat_ws("; ", "text", "box").alias("geographic_scope"))


def geographic_scope(*tables: DataFrame) -> DataFrame:
    """Countries, else regions of tables without a country column; then the coordinate bounds."""
    found = _gather(tables, ["place", "box"])
    return _none(tables, {"geographic_scope": "string"}) if found is None else _geographic(found)


def _taxonomic(found: DataFrame) -> DataFrame:
    fields = [*RANKS, "scientificname"]
    labels = F.create_map(*[F.lit(x) for pair in {**RANKS, "scientificname": "Scientific names"}.items() for x in pair])
    order = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field"))
    seen = found.filter("topic = 'taxon'").select("dataset_id", "field", "ord", "text")
    best = seen.groupBy("dataset_id").agg(F.min_by("field", order).alias("field"))
    texts = summarize_values(seen.join(best, ["dataset_id", "field"]), ["dataset_id", "field"], labels[F.col("field")], 5, "text")
    one = F.concat(F.initcap("field"), F.lit(": "), F.element_at(F.split("text", ": ", 2), 2))
    return texts.select("dataset_id", F.when((F.col("n_values") == 1) & (F.col("field") != "scientificname"), one)
                        .otherwise(F.col("text")).alias("taxonomic_scope"))


def taxonomic_scope(*tables: DataFrame) -> DataFrame:
    """The highest rank with values, or the scientific names."""
    found = _gather(tables, ["taxon"])
    return _none(tables, {"taxonomic_scope": "string"}) if found is None else _taxonomic(found)


def _keywords(found: DataFrame, most: int | None) -> DataFrame:
    seen = found.filter((F.col("topic") == "taxon") & F.col("field").isin(list(RANKS))).select("dataset_id", "field", "ord", "text")
    if most is not None:
        return top_k(seen, ["dataset_id"], ["ord"], most).select("dataset_id", "rank", "field", "text")
    return numbered(seen, ["dataset_id"], ["ord"]).select("dataset_id", "rank", "field", "text")


def taxonomic_keywords(*tables: DataFrame, most: int | None = None) -> DataFrame:
    """(dataset_id, rank, field, text): distinct rank values in first-seen order; only the first ``most`` if given."""
    found = _gather(tables, ["taxon"])
    return _none(tables, {"rank": "bigint", "field": "string", "text": "string"}) if found is None else _keywords(found, most)


def _methodology(found: DataFrame) -> DataFrame:
    seen = first_seen(found.filter("topic = 'method'"), ["dataset_id"])
    texts = summarize_values(seen, ["dataset_id"], F.lit("Sampling protocol(s)"), 4, "text")
    first = seen.groupBy("dataset_id").agg(F.min_by("text", "ord").alias("single"))
    return texts.join(first, "dataset_id").select(
        "dataset_id", F.when(F.col("n_values") == 1, F.col("single")).otherwise(F.col("text")).alias("methodology"))


def methodology(*tables: DataFrame) -> DataFrame:
    """Distinct sampling methods: one as it is, more as a short list."""
    found = _gather(tables, ["method"])
    return _none(tables, {"methodology": "string"}) if found is None else _methodology(found)


def resolve_scope(provided: Column, existing: Column, inferred: Column, label: str, kind: str = "text",
                  today: Column | None = None) -> Column:
    """Struct (value, note): the given text, or the inferred one if nothing or a placeholder is given.

    For ``kind="dates"`` a range that covers only today counts as a placeholder too.
    """
    chosen = clean_text(F.coalesce(provided, existing))
    placeholder = is_placeholder(chosen)
    source, noun = ("table dates", "range") if kind == "dates" else ("table data", "value")
    if kind == "dates":
        today = F.current_date() if today is None else today
        span = dates.date_bounds(chosen)
        placeholder = placeholder | F.coalesce((span["start"] == today) & (span["end"] == today), F.lit(False))
    inferred = F.nullif(inferred, F.lit(""))
    swap = inferred.isNotNull() & placeholder & (chosen != inferred)

    def result(value, note):
        return F.struct(value.alias("value"), note.alias("note"))

    return (F.when(chosen.isNull() & inferred.isNotNull(),
                   result(inferred, F.concat(F.lit(f"{label} inferred from {source}: "), inferred, F.lit("."))))
            .when(swap, result(inferred, F.concat(F.lit(f"{label} adjusted from placeholder '"), chosen,
                                                  F.lit(f"' to data-derived {noun} '"), inferred, F.lit("'."))))
            .otherwise(result(chosen, F.lit(None).cast("string"))))


def gather_coverage(tables) -> DataFrame:
    """All distinct values and bounds that coverage is inferred from, written once: each table is scanned once.

    Every dataset has a row, also one without any of the columns.
    """
    return materialize(_gather(tables, ["dataset", "dates", "box", *TOPICS]), "coverage")


def coverage_metadata(tables, meta: DataFrame | None = None, today: Column | None = None) -> DataFrame:
    """One row per dataset with all inferred coverage, resolved against given metadata, and the notes.

    ``meta`` may hold ``dataset_id`` and provided_/existing_ columns of the four scopes.
    """
    tables = list(tables)
    found = gather_coverage(tables)
    base = found.select("dataset_id").distinct()
    for part in (_temporal(found), _geographic(found), _box(found), _taxonomic(found), _methodology(found)):
        base = base.join(part, "dataset_id", "left")
    keywords = _keywords(found, None).groupBy("dataset_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "field", "text"))),
                    lambda k: F.struct(k["field"].alias("rank"), k["text"].alias("scientificName"))).alias("taxonomic_keywords"))
    base = base.join(keywords, "dataset_id", "left")
    if meta is not None:
        base = base.join(meta, "dataset_id", "left")
    have = set(base.columns)

    def given(name):
        return F.col(name) if name in have else F.lit(None).cast("string")

    scopes = [("temporal_scope", "Temporal scope", "dates"), ("geographic_scope", "Geographic scope", "text"),
              ("taxonomic_scope", "Taxonomic scope", "text"), ("methodology", "Methodology", "text")]
    resolved = base.select("dataset_id", "west", "east", "north", "south", "taxonomic_keywords", *[
        resolve_scope(given(f"provided_{c}"), given(f"existing_{c}"), F.col(c), label, kind, today).alias(f"_{c}")
        for c, label, kind in scopes])
    return resolved.select(
        "dataset_id", *[F.col(f"_{c}.value").alias(c) for c, _, _ in scopes], "west", "east", "north", "south",
        "taxonomic_keywords", F.concat_ws(" ", *[F.col(f"_{c}.note") for c, _, _ in scopes]).alias("notes"))
