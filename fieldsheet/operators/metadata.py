"""Metadata rows: patches, notes, guards, people, profiles, keywords."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clean_text, let, strip
from ..plans.topk import first_per_key


def _given(old: DataFrame, new: DataFrame, key: str, columns) -> DataFrame:
    """Full outer join in which a given, non-blank value wins."""
    renamed = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns if c in new.columns])
    joined = old.join(renamed, key, "full")
    types = dict(old.dtypes)

    def value(c):
        if c not in new.columns:
            return F.col(c)
        given = F.col(f"_n_{c}")
        return F.coalesce(F.when(clean_text(given).isNotNull(), strip(given)) if types[c] == "string" else given, F.col(c)).alias(c)

    return joined.select(key, *[value(c) for c in columns])


def merge_metadata_patch(meta: DataFrame, patch: DataFrame) -> DataFrame:
    """Metadata with the optional fields of a patch applied; lists replace whole lists."""
    return _given(meta, patch, "dataset_id", [c for c in meta.columns if c != "dataset_id"])


def latest_by_owner_upsert(users: DataFrame, incoming: DataFrame) -> DataFrame:
    """Users updated by e-mail; only non-empty fields overwrite, unknown e-mails are added."""
    return _given(users, incoming, "email", [c for c in users.columns if c != "email"])


def append_notes(note_log: DataFrame) -> DataFrame:
    """(dataset_id, notes): notes since the last overwrite, put together with a blank line.

    ``note_log`` is (dataset_id, seq, note, overwrite); blank notes are ignored.
    """
    filled = note_log.withColumn("note", clean_text(F.col("note"))).filter("note IS NOT NULL")
    start = filled.groupBy("dataset_id").agg(F.max(F.when(F.col("overwrite"), F.col("seq"))).alias("_from"))
    kept = filled.join(start, "dataset_id").filter("_from IS NULL OR seq >= _from")
    return kept.groupBy("dataset_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "note"))), lambda e: e["note"]), "\n\n").alias("notes"))


def set_basic_metadata(meta: DataFrame, patch: DataFrame, now: Column | None = None) -> DataFrame:
    """Title and description set where given; an error where one is still missing; unsuitable data rejected now.

    ``patch`` is (dataset_id, title, description, suitable).
    """
    now = F.current_timestamp() if now is None else now
    p = patch.select("dataset_id", F.nullif("title", F.lit("")).alias("_t"), F.nullif("description", F.lit("")).alias("_d"), "suitable")
    j = meta.join(p, "dataset_id")
    title, text = F.nullif("title", F.lit("")), F.nullif("description", F.lit(""))
    error = F.when(title.isNull() & F.col("_t").isNull(), "title is missing").when(text.isNull() & F.col("_d").isNull(), "description is missing")
    j = j.withColumn("error", error)
    ok = F.col("error").isNull()
    return j.select(
        "dataset_id", F.when(ok & F.col("_t").isNotNull(), F.col("_t")).otherwise(F.col("title")).alias("title"),
        F.when(ok & F.col("_d").isNotNull(), F.col("_d")).otherwise(F.col("description")).alias("description"),
        F.when(ok & ~F.coalesce("suitable", F.lit(True)), now).otherwise(F.col("rejected_at")).alias("rejected_at"), "error")


def completion_guard(agents: DataFrame, tasks: DataFrame, meta: DataFrame, content_task: str) -> DataFrame:
    """Agents of the content step whose dataset has no title or description yet: they cannot be closed."""
    step = tasks.filter(F.col("name") == content_task).select(F.col("name").alias("task"))
    lacking = meta.filter((F.coalesce("title", F.lit("")) == "") | (F.coalesce("description", F.lit("")) == "")).select("dataset_id")
    return agents.join(step, "task", "left_semi").join(lacking, "dataset_id", "left_semi").select("agent_id", "dataset_id", "task")


def profile_from_json(profiles: DataFrame) -> DataFrame:
    """(orcid, first_name, last_name, institution, department, country, email) of profile texts.

    The newest employment is the first listed one, in one of three layouts. Without an e-mail a
    placeholder is made from the identifier.
    """
    def at(*paths):
        return F.coalesce(*[F.get_json_object("profile", p) for p in paths])

    jobs = ["$.person.employments['employment-summary'][0]['employment-summary'].organization",
            "$.person.employments['employment-summary'][0].organization",
            "$['activities-summary'].employments['employment-summary'][0].organization"]
    return profiles.select(
        "orcid", at("$.person.name['given-names'].value").alias("first_name"), at("$.person.name['family-name'].value").alias("last_name"),
        at(*[f"{j}.name" for j in jobs]).alias("institution"), at(*[f"{j}.address.city" for j in jobs]).alias("department"),
        at(*[f"{j}.address.country" for j in jobs]).alias("country"),
        F.coalesce(F.nullif("email", F.lit("")), F.concat("orcid", F.lit("@orcid.org"))).alias("email"))


def person_label(first: Column, last: Column, username: Column, email: Column, fallback: str = "Unknown user") -> Column:
    """A name to show; a placeholder e-mail does not count."""
    mail = F.when(~F.coalesce(email, F.lit("")).endswith("@orcid.org"), clean_text(email))
    user = F.when(~F.coalesce(username, F.lit("")).endswith("@orcid.org"), clean_text(username))
    full = clean_text(F.concat_ws(" ", clean_text(first), clean_text(last)))
    return F.coalesce(full, user, mail, F.lit(fallback))


def select_extracted_tables(candidates: DataFrame, threshold: float):
    """(kept, datasets): candidate tables sure enough, and whether a new dataset has none and is rejected."""
    kept = candidates.filter(F.col("confidence") >= threshold)
    counts = candidates.groupBy("dataset_id").agg(F.count_if(F.col("confidence") >= threshold).alias("n_kept"),
                                                  F.bool_or("is_new").alias("is_new"))
    return kept, counts.select("dataset_id", "n_kept", F.when((F.col("n_kept") == 0) & F.col("is_new"), "rejected").otherwise("accepted").alias("status"))


def normalize_keywords(keywords: DataFrame) -> DataFrame:
    """(dataset_id, pos, rank, name, common_name) without repeats, from keywords of several spellings.

    ``keywords`` is (dataset_id, pos, keyword) with the keyword as JSON. At equal positions the text
    decides. Rows are spread before they are grouped, so a task's groups do not grow with the files.
    """
    spellings = {"name": ["scientificName", "scientific_name", "taxonRankValue", "name"], "rank": ["rank", "taxonRankName"],
                 "common_name": ["commonName", "common_name"]}
    schema = ", ".join(f"`{n}` string" for names in spellings.values() for n in names)

    def cleaned(j):
        return F.struct(*[clean_text(F.coalesce(*[F.nullif(j[n], F.lit("")) for n in names])).alias(field)
                          for field, names in spellings.items()])

    read = keywords.repartition("dataset_id", "pos").select("dataset_id", "pos", let(F.from_json("keyword", schema), cleaned).alias("_j")).select("dataset_id", "pos", "_j.*")
    named = read.filter("name IS NOT NULL").withColumn("_k", F.struct(
        F.lower(F.coalesce("rank", F.lit(""))), F.lower("name"), F.lower(F.coalesce("common_name", F.lit("")))))
    first = first_per_key(named, ["dataset_id", "_k"], ["pos", "name", "rank", "common_name"])
    return first.select("dataset_id", "pos", F.coalesce("rank", F.lit("taxon")).alias("rank"), "name", "common_name")
