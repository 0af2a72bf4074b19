"""Scientific names: which to check, matching against a checklist table, applying corrections."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clean_text
from ..plans.scratch import materialize
from ..plans.skew import join_on_hot_keys
from ..plans.topk import first_per_key, joined_ranked, top_k

IDS = ["dataset_id", "table_id"]
ROUNDS = [80, 70, 60]  # likenesses tried before a lower least one


def names_to_check(t: DataFrame, all_up_to: int | None = None, rarest: int | None = None) -> DataFrame:
    """Per table all distinct names with their rows; with both limits only the ``rarest`` of tables with more than ``all_up_to``."""
    counts = (t.filter(clean_text(F.col("scientificName")).isNotNull())
              .groupBy(*IDS, "scientificName").agg(F.count(F.lit(1)).alias("n_rows")))
    if all_up_to is None or rarest is None:
        return counts
    distinct = counts.groupBy(*IDS).agg(F.count(F.lit(1)).alias("n_names"))
    ranked = top_k(counts, IDS, ["n_rows", "scientificName"], max(all_up_to, rarest))
    keep = (F.col("n_names") <= all_up_to) | (F.col("rank") <= rarest)
    return ranked.join(distinct, IDS).filter(keep).select(*IDS, "scientificName", "n_rows")


def _cut(size: Column, least: int):
    """Into how many pieces a checklist name of ``size`` characters is cut: one more than the edits a match may have, and one per character at most."""
    return F.least(F.floor((100 - least) * size / least).cast("int") + 1, size)


def _piece(size: Column, pieces: Column, i: Column):
    """Start (from 1) and length of piece ``i`` (from 1) of a name cut as evenly as possible, longer pieces last."""
    short, rest = F.floor(size / pieces).cast("int"), size % pieces
    before_long = pieces - rest
    return 1 + (i - 1) * short + F.greatest(i - 1 - before_long, F.lit(0)), short + (i > before_long).cast("int")


def _candidates(rest: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """(name, matched_name): every pair that may be alike to ``least`` percent, from an equi join of pieces.

    A checklist name is cut into one more piece than such a match may have edits, so one piece is whole
    in the other name, and near its place: pieces before it shift it by their edits at most, pieces
    after it by theirs. At 50 pieces are single characters, as many as edits; characters added between
    them leave one whole, at most one place farther off.
    """
    spare = 1 if least == 50 else 0
    i, m, size = F.col("i"), F.col("m"), F.col("size")
    start, width = _piece(m, F.col("k"), i)
    cut = (known.select("matched_name", F.lower("matched_name").alias("low")).withColumn("m", F.length("low")).filter("m > 0")
           .withColumn("k", _cut(m, least)).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k"))))
           .select("matched_name", F.xxhash64("m", "i", F.substr("low", start, width)).alias("_key")))
    low, high = F.ceil(size * least / 100).cast("int"), F.floor(size * 100 / F.lit(least)).cast("int")
    tried = (rest.select("name", F.lower("name").alias("low")).withColumn("size", F.length("low")).filter("size > 0")
             .withColumn("m", F.explode(F.sequence(F.greatest(low, F.lit(1)), high))).withColumn("k", _cut(m, least))
             .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k")))).withColumns({"start": start, "width": width}))
    longer_by = size - m
    first = F.greatest(F.col("start") - (i - 1) - spare, F.col("start") + longer_by - (F.col("k") - i) - spare, F.lit(1))
    last = F.least(F.col("start") + (i - 1) + spare, F.col("start") + longer_by + (F.col("k") - i) + spare, size - F.col("width") + 1)
    tried = (tried.withColumns({"first": first, "last": last}).filter("first <= last")
             .withColumn("at", F.explode(F.sequence("first", "last")))
             .select("name", F.xxhash64("m", "i", F.substr("low", F.col("at"), F.col("width"))).alias("_key")).distinct())
    return tried.join(cut, "_key").select("name", "matched_name").distinct()


def _most_alike(rest: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """(name, matched_name, confidence) of the names with a checklist name alike to ``least`` percent or more: the most alike."""
    edits = F.levenshtein(F.lower("name"), F.lower("matched_name"))
    longer = F.greatest(F.length(F.lower("name")), F.length(F.lower("matched_name")))
    scored = (_candidates(rest, known, least).select("name", "matched_name", longer.alias("_len"), edits.alias("edits"))
              .withColumn("confidence", F.expr("(100 * (_len - edits)) div _len")).filter(F.col("confidence") >= least))
    return first_per_key(scored, ["name"], [-F.col("confidence"), F.col("matched_name")]).select("name", "matched_name", "confidence")


def match_names(names: DataFrame, backbone: DataFrame, least: int = 80) -> DataFrame:
    """(name, match_type, matched_name, confidence) of distinct names against ``backbone(scientificName)``.

    EXACT by an equi join. The likeness of two names is 100 * (1 - edits / longer length), rounded
    down, without regard to case. The most alike checklist name of at least ``least`` (50 or more)
    is a FUZZY match; all others are NONE with 0. Below 80 % names are searched in rounds of falling
    likeness: a name that has a match in one round cannot find a better one in the next, so the many
    candidates of low likeness are formed only for names without any match above it. Each round is written.
    """
    if not 50 <= least <= 100:
        raise ValueError("least must be at least 50 and at most 100")
    wanted = names.select(F.col("scientificName").alias("name")).distinct()
    known = backbone.select(F.col("scientificName").alias("matched_name")).distinct()
    paired = wanted.join(known, wanted["name"] == known["matched_name"], "left")
    exact = paired.filter("matched_name IS NOT NULL")
    rest = paired.filter("matched_name IS NULL").select("name")
    levels = [x for x in ROUNDS if x > least]
    best, open_names = None, rest
    if levels:
        known, open_names = materialize(known, "checklist"), materialize(rest, "names")
        rest = open_names
    for level in [*levels, least]:
        found = _most_alike(open_names, known, level)
        if level > least:
            found = materialize(found, "matches")
            open_names = materialize(open_names.join(found.select("name").hint("merge"), "name", "left_anti"), "names")
        best = found if best is None else best.unionByName(found)
    fuzzy = rest.join(best, "name", "left").select(
        "name", F.when(F.col("matched_name").isNull(), "NONE").otherwise("FUZZY").alias("match_type"), "matched_name",
        F.coalesce("confidence", F.lit(0)).cast("bigint").alias("confidence"))
    return exact.select("name", F.lit("EXACT").alias("match_type"), "matched_name",
                        F.lit(100).cast("bigint").alias("confidence")).unionByName(fuzzy)


def apply_name_corrections(t: DataFrame, matches: DataFrame, at_least: int = 85) -> DataFrame:
    """Replace names by their confident fuzzy matches."""
    fixes = (matches.filter((F.col("match_type") == "FUZZY") & (F.col("confidence") >= at_least))
             .select(F.col("name").alias("scientificName"), F.col("matched_name").alias("_fix")))
    joined = join_on_hot_keys(t, fixes, ["scientificName"], "left")
    return joined.withColumn("scientificName", F.coalesce("_fix", "scientificName")).select(*t.columns)


def correction_messages(names: DataFrame, matches: DataFrame) -> DataFrame:
    """Per table one message per kind: first corrections, suspected typos and unmatched names, and how many more.

    Suspected typos of moderate confidence are listed whether or not there were corrections.
    """
    sure = F.col("match_type") == "FUZZY"
    kind = (F.when(sure & (F.col("confidence") >= 85), "corrected").when(sure & (F.col("confidence") >= 80), "typo")
            .when((F.col("match_type") == "NONE") | (F.col("confidence") < 50), "unmatched"))
    shown = F.when(F.col("kind") == "corrected", 5).when(F.col("kind") == "typo", 3).otherwise(5)
    found = (names.select(*IDS, F.col("scientificName").alias("name")).distinct().join(matches, "name")
             .withColumn("kind", kind).filter("kind IS NOT NULL"))
    counts = found.groupBy(*IDS, "kind").agg(F.count(F.lit(1)).alias("n"))
    text = (F.when(F.col("kind") == "corrected", F.concat(F.lit("'"), F.col("name"), F.lit("' → '"), F.col("matched_name"), F.lit("'")))
            .when(F.col("kind") == "typo", F.concat(F.lit("'"), F.col("name"), F.lit("' (suggested: '"), F.col("matched_name"),
                                                    F.lit("', confidence: "), F.col("confidence").cast("string"), F.lit("%)")))
            .otherwise(F.concat(F.lit("'"), F.col("name"), F.lit("'"))))
    first = top_k(found, [*IDS, "kind"], ["name"], 5).filter(F.col("rank") <= shown)
    listed = joined_ranked(first, [*IDS, "kind"], "rank", text, "; ", "listed")
    more = F.col("n") - shown
    return listed.join(counts, [*IDS, "kind"]).select(
        *IDS, "kind", "n", F.when(more > 0, F.concat(F.col("listed"), F.lit("; and "), more.cast("string"), F.lit(" more")))
        .otherwise(F.col("listed")).alias("message"))
