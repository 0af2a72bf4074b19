"""Links between records and tree tips, and lookups from other tables."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.coords import coordinate
from ..functions.text import clean_text
from ..plans.skew import join_on_hot_keys
from ..plans.topk import first_per_key

RECORD = ["dataset_id", "table_id", "row_id"]
PHYLOGENIES = "phylogenies array<struct<phyloTreeTipLabel:string,phyloTreeFileName:string>>"


def record_links(records: DataFrame, *keep) -> DataFrame:
    """(record key, kept columns, pos, tip): the tips named in ``dynamicProperties``; bad JSON gives none."""
    listed = F.from_json("dynamicProperties", PHYLOGENIES)["phylogenies"]
    return records.select(*RECORD, *keep, F.posexplode(listed).alias("pos", "_l")).select(
        *RECORD, *keep, "pos", F.col("_l.phyloTreeTipLabel").alias("tip")).filter("tip <> ''")


def tip_counts(records: DataFrame) -> DataFrame:
    """(dataset_id, tip, n_records, has_coordinates): how many links a tip has in its dataset and whether one has coordinates."""
    located = coordinate(F.col("decimalLatitude")).isNotNull() & coordinate(F.col("decimalLongitude")).isNotNull()
    links = record_links(records.withColumn("_located", located), "_located")
    return links.groupBy("dataset_id", "tip").agg(F.count(F.lit(1)).alias("n_records"), F.bool_or("_located").alias("has_coordinates"))


def records_for_tips(records: DataFrame, tips: DataFrame) -> DataFrame:
    """Records linked to one of ``tips(dataset_id, tip)`` of their dataset; the first matching link names the tip. Blanks become null."""
    shown = ["occurrenceID", "catalogNumber", "scientificName"]
    keep = [c for c in shown if c in records.columns]
    given = F.from_json("dynamicProperties", PHYLOGENIES)["phylogenies"]
    slim = records.select(*RECORD, *keep, "decimalLatitude", "decimalLongitude", "dynamicProperties").filter(F.size(given) > 0)
    links = join_on_hot_keys(record_links(slim), tips.select("dataset_id", "tip").distinct(), ["dataset_id", "tip"], "left_semi")
    first = first_per_key(links, RECORD, ["pos"]).drop("pos")

    def text(c):
        t = clean_text(F.col(c))
        return F.when(F.lower(t) != "nan", t).alias(c)

    return first.join(slim.drop("dynamicProperties"), RECORD).select(
        *RECORD, "tip", *[text(c) for c in keep], coordinate(F.col("decimalLatitude")).alias("decimalLatitude"),
        coordinate(F.col("decimalLongitude")).alias("decimalLongitude"))


def clade_map_points(clade: DataFrame, records: DataFrame) -> DataFrame:
    """(tree, node, record, coordinates) of the records of each clade; pairs without numbers are dropped.

    ``clade`` is the result of ``clade_tips``.
    """
    located = records.select(*RECORD, "dynamicProperties", coordinate(F.col("decimalLatitude")).alias("lat"),
                             coordinate(F.col("decimalLongitude")).alias("lon")).filter("lat IS NOT NULL AND lon IS NOT NULL")
    links = record_links(located, "lat", "lon").select(*RECORD, "lat", "lon", "tip")
    members = clade.select("dataset_id", "tree_id", "node", F.col("label").alias("tip")).distinct()
    return join_on_hot_keys(links, members, ["dataset_id", "tip"], "inner").select("tree_id", "node", *RECORD, "lat", "lon").distinct()


def clade_bbox(clade: DataFrame, records: DataFrame) -> DataFrame:
    """Bounding box per clade; records are reduced to one box per tip before the join."""
    located = records.select(*RECORD, "dynamicProperties", coordinate(F.col("decimalLatitude")).alias("lat"),
                             coordinate(F.col("decimalLongitude")).alias("lon")).filter("lat IS NOT NULL AND lon IS NOT NULL")
    per_tip = record_links(located, "lat", "lon").groupBy("dataset_id", "tip").agg(
        F.min("lon").alias("w"), F.max("lon").alias("e"), F.max("lat").alias("n"), F.min("lat").alias("s"))
    members = clade.select("dataset_id", "tree_id", "node", F.col("label").alias("tip"))
    return members.join(per_tip, ["dataset_id", "tip"]).groupBy("dataset_id", "tree_id", "node").agg(
        F.min("w").alias("west"), F.max("e").alias("east"), F.max("n").alias("north"), F.min("s").alias("south"))


def translate_tips(tips: DataFrame, translate: DataFrame) -> DataFrame:
    """Tips (dataset_id, tree_id, pos, label) with codes replaced by the names of (dataset_id, tree_id, code, name)."""
    tree = ["dataset_id", "tree_id"]
    names = first_per_key(translate.select(*tree, F.col("code").alias("label"), "name"), [*tree, "label"], ["name"])
    return tips.join(names, [*tree, "label"], "left").select(*tree, "pos", F.coalesce("name", "label").alias("label"))


def tip_name_key(label: Column) -> Column:
    """Label as a comparable name: a trailing ``_01`` or ``_P`` dropped, underscores as blanks, lower case."""
    return F.lower(F.trim(F.replace(F.regexp_replace(label, r"_(\d+|[A-Z])$", ""), F.lit("_"), F.lit(" "))))


def decode_tip_code(label: Column) -> Column:
    """Struct (genus, species, number) of a code such as ``MENALB912C``; blanks if it is none."""
    code = r"^([A-Za-z]{3})([A-Za-z]{3})(\d+)[A-Z]?$"
    return F.struct(*[F.lower(F.regexp_extract(label, code, i)).alias(n) for i, n in ((1, "genus"), (2, "species"), (3, "number"))])


def decode_collector_code(label: Column) -> Column:
    """Struct (surname, initial, number) of a code such as ``GuppyA513``."""
    code = r"^([A-Z][a-z]+)([A-Z])(\d+)$"
    return F.struct(*[F.regexp_extract(label, code, i).alias(n) for i, n in ((1, "surname"), (2, "initial"), (3, "number"))])


def match_tips_to_records(tips: DataFrame, records: DataFrame, tip_key: Column, record_key: Column) -> DataFrame:
    """(tip, record): tips (dataset_id, label) and records of one dataset whose keys are equal; blank keys match nothing."""
    left = tips.select("dataset_id", F.col("label").alias("tip"), tip_key.alias("_key")).filter("_key <> ''").distinct()
    right = records.select(*RECORD, record_key.alias("_key")).filter("_key <> ''")
    return join_on_hot_keys(right, left, ["dataset_id", "_key"], "inner").select("tip", *RECORD)


def _linked_labels(links: DataFrame) -> DataFrame:
    return links.select("dataset_id", F.col("tip").alias("label")).distinct()


def unmatched_tips(tips: DataFrame, links: DataFrame) -> DataFrame:
    """Tips (dataset_id, label) that no record of their dataset is linked to."""
    return tips.join(_linked_labels(links), ["dataset_id", "label"], "left_anti").select(tips.columns)


def unmatched_records(records: DataFrame, links: DataFrame) -> DataFrame:
    return records.join(links.select(*RECORD).distinct(), RECORD, "left_anti").select(records.columns)


def match_stats(tips: DataFrame, records: DataFrame, links: DataFrame) -> DataFrame:
    """Per dataset: matched and unmatched records, tips with and without a record."""
    linked = links.select(*RECORD).distinct().withColumn("_r", F.lit(1))
    used = _linked_labels(links).withColumn("_t", F.lit(1))
    zero = F.lit(0).cast("bigint")
    by_record = records.select(*RECORD).join(linked, RECORD, "left").groupBy("dataset_id").agg(
        F.count("_r").alias("a"), (F.count(F.lit(1)) - F.count("_r")).alias("b")).select("dataset_id", "a", "b", zero.alias("c"), zero.alias("d"))
    by_tip = tips.select("dataset_id", "label").distinct().join(used, ["dataset_id", "label"], "left").groupBy("dataset_id").agg(
        F.count("_t").alias("c"), (F.count(F.lit(1)) - F.count("_t")).alias("d")).select("dataset_id", zero.alias("a"), zero.alias("b"), "c", "d")
    return by_record.unionByName(by_tip).groupBy("dataset_id").agg(
        F.sum("a").alias("matched_records"), F.sum("b").alias("unmatched_records"), F.sum("c").alias("matched_tips"), F.sum("d").alias("unmatched_tips"))


def tip_set_diff(tips: DataFrame, links: DataFrame) -> DataFrame:
    """(dataset_id, side, label): labels that occur in a dataset only as a tip or only as a link."""
    key = ["dataset_id", "label"]
    a, b = tips.select(*key).distinct(), _linked_labels(links)
    return a.join(b, key, "left_anti").select("dataset_id", F.lit("tip").alias("side"), "label").unionByName(
        b.join(a, key, "left_anti").select("dataset_id", F.lit("link").alias("side"), "label"))


def join_lookup_table(records: DataFrame, lookup: DataFrame, on) -> DataFrame:
    """Records with the columns of a many-to-one lookup table.

    Raises if a key occurs twice in the lookup, since that would multiply records. A missing key
    gives nulls. Frequent keys are spread over tasks.
    """
    repeated = lookup.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*on).take(1)
    if repeated:
        raise ValueError(f"lookup key is not unique: {repeated[0].asDict()}")
    return join_on_hot_keys(records, lookup, list(on), "left")
