"""EML 2.2.0 documents, one per dataset row."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import coords, dates, text as tx

# Root element, licence and profile of the documents.
HEAD = ('<?xml version="1.0" encoding="UTF-8"?>\n<eml:eml xmlns:eml="https://eml.ecoinformatics.org/eml-2.2.0" '
        'xmlns:dc="http://purl.org/dc/terms/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" '
        'xsi:schemaLocation="https://eml.ecoinformatics.org/eml-2.2.0 https://rs.gbif.org/schema/eml-gbif-profile/1.3/eml.xsd" '
        'scope="system" system="http://gbif.org" xml:lang="eng"')
LICENCE = ('This work is licensed under a <ulink url="http://creativecommons.org/licenses/by/4.0/legalcode">'
           "<citetitle>Creative Commons Attribution (CC-BY) 4.0 License</citetitle></ulink>.")
DIRECTORY = "https://orcid.org/"
# The person of a dataset without an owner, and what stands for missing parts of an owner.
NOBODY = {"first_name": "Test", "last_name": "User", "orcid": "0000-0002-1825-0097"}
UNNAMED = {"first_name": "Test", "last_name": "User", "orcid": "0000-0000-0000-0000"}
MARK = "licence"
FORBIDDEN = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]"  # characters XML 1.0 cannot hold

USERS = "array<struct<first_name:string,last_name:string,email:string,orcid:string>>"
KEYWORDS = "array<struct<rank:string,scientificName:string,commonName:string>>"
OPTIONAL = {"temporal_scope": "string", "geographic_scope": "string", "geographic_bounds": "string", "taxonomic_scope": "string",
            "taxonomic_keywords": KEYWORDS, "methodology": "string", "manuscript_doi": "string", "project_title": "string",
            "dataset_citation": "string", "contact_email": "string", "users": USERS}


def _filled(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def _printable(c: Column) -> Column:
    return F.regexp_replace(c, FORBIDDEN, "")


def _printable_parts(name: str, fields) -> Column:
    return F.transform(name, lambda e: F.struct(*[_printable(e[f]).alias(f) for f in fields]))


def _complete(meta: DataFrame, owners: DataFrame) -> DataFrame:
    """Metadata with all optional columns and the owner as ``_owner``, defaults filled in."""
    m = meta.select("*", *[F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items() if c not in meta.columns])
    m = m.withColumns({c: _printable(F.col(c)) for c, kind in m.dtypes if kind == "string"})
    m = m.withColumns({"users": _printable_parts("users", ["first_name", "last_name", "email", "orcid"]),
                       "taxonomic_keywords": _printable_parts("taxonomic_keywords", ["rank", "scientificName", "commonName"])})

    def part(name):
        return F.coalesce(_filled(_printable(F.col(name))), F.lit(UNNAMED[name])).alias(name)

    o = owners.select("dataset_id", F.struct(part("first_name"), part("last_name"), _filled(_printable(F.col("email"))).alias("email"), part("orcid")).alias("_o"))
    default = F.struct(F.lit(NOBODY["first_name"]).alias("first_name"), F.lit(NOBODY["last_name"]).alias("last_name"),
                       F.lit(None).cast("string").alias("email"), F.lit(NOBODY["orcid"]).alias("orcid"))
    return m.join(o, "dataset_id", "left").withColumn("_owner", F.coalesce("_o", default)).drop("_o")


def eml_people(meta: DataFrame, owners: DataFrame) -> DataFrame:
    """(dataset_id, kind, pos, first_name, last_name, email, orcid): everyone a document names, in order.

    Creators are the listed users or else the owner; the owner provides the metadata and is the
    contact, under the contact e-mail if one is given; users are personnel if a project has a title.
    """
    m = _complete(meta, owners)
    owner = F.col("_owner")
    contact = owner.withField("email", F.coalesce(tx.clean_text(F.col("contact_email")), owner["email"]))
    users = F.when(F.size("users") > 0, F.col("users"))
    groups = {"creator": F.coalesce(users, F.array(owner)), "metadataProvider": F.array(owner), "contact": F.array(contact),
              "personnel": F.when(tx.clean_text(F.col("project_title")).isNotNull(), F.coalesce(users, F.array().cast(USERS)))}

    def entries(kind, group):
        return F.transform(F.coalesce(group, F.array().cast(USERS)), lambda p, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"), _filled(p["first_name"]).alias("first_name"),
            _filled(p["last_name"]).alias("last_name"), F.when(F.lit(kind != "personnel"), _filled(p["email"])).alias("email"),
            tx.clean_text(p["orcid"]).alias("orcid")))

    listed = F.flatten(F.array(*[entries(k, g) for k, g in groups.items()]))
    return m.select("dataset_id", F.explode(listed).alias("p")).select("dataset_id", "p.*")


def _person(p: Column, role: str | None = None) -> Column:
    name = F.when(p["first_name"].isNotNull() | p["last_name"].isNotNull(),
                  F.struct(p["first_name"].alias("givenName"), p["last_name"].alias("surName")))
    user_id = F.when(p["orcid"].isNotNull(), F.struct(F.lit(DIRECTORY).alias("_directory"), p["orcid"].alias("_VALUE")))
    return F.struct(name.alias("individualName"), p["email"].alias("electronicMailAddress"), user_id.alias("userId"),
                    F.lit(role).cast("string").alias("role"))


def eml_documents(meta: DataFrame, owners: DataFrame, today: Column | None = None, now: Column | None = None) -> DataFrame:
    """(dataset_id, eml). Elements without content are left out; a coverage block appears only when complete."""
    today = F.current_date() if today is None else today
    now = F.current_timestamp() if now is None else now
    people = eml_people(meta, owners).groupBy("dataset_id").agg(F.sort_array(F.collect_list(F.struct(
        "kind", "pos", "first_name", "last_name", "email", "orcid"))).alias("_people"))
    m = _complete(meta, owners).join(people, "dataset_id")

    def of(kind, role=None):
        own = F.transform(F.filter("_people", lambda p: p["kind"] == kind), lambda p: _person(p, role))
        return F.when(F.size(own) > 0, own)

    place = tx.clean_text(F.col("geographic_scope"))
    m = m.withColumn("_box", F.coalesce(coords.bounds_from_json(F.col("geographic_bounds")), coords.bounds_from_text(place)))
    m = m.withColumn("_when", dates.scope_dates(F.col("temporal_scope")))
    taxa = tx.clean_text(F.col("taxonomic_scope"))
    given = F.filter("taxonomic_keywords", lambda k: tx.clean_text(k["scientificName"]).isNotNull())
    inferred = F.transform(tx.keywords_from_scope(taxa), lambda k: F.struct(
        k["rank"].alias("rank"), k["name"].alias("scientificName"), F.lit(None).cast("string").alias("commonName")))
    m = m.withColumn("_keywords", F.when(F.size(given) > 0, given).otherwise(inferred))

    box, when = F.col("_box"), F.col("_when")
    geographic = F.when(place.isNotNull() & box.isNotNull(), F.struct(place.alias("geographicDescription"), F.struct(
        *[coords.format_coordinate(box[s]).alias(f"{s}BoundingCoordinate") for s in ("west", "east", "north", "south")]).alias("boundingCoordinates")))
    temporal = F.when(when.isNotNull(), F.struct(
        F.when(when["kind"] == "single", F.struct(when["start"].alias("calendarDate"))).alias("singleDateTime"),
        F.when(when["kind"] == "range", F.struct(F.struct(when["start"].alias("calendarDate")).alias("beginDate"),
                                                 F.struct(when["end"].alias("calendarDate")).alias("endDate"))).alias("rangeOfDates")))
    taxonomic = F.when(F.size("_keywords") > 0, F.struct(taxa.alias("generalTaxonomicCoverage"), F.transform("_keywords", lambda k: F.struct(
        F.coalesce(tx.clean_text(k["rank"]), F.lit("taxon")).alias("taxonRankName"), tx.clean_text(k["scientificName"]).alias("taxonRankValue"),
        tx.clean_text(k["commonName"]).alias("commonName"))).alias("taxonomicClassification")))
    m = m.withColumns({"_geo": geographic, "_time": temporal, "_tax": taxonomic})
    coverage = F.when(F.col("_geo").isNotNull() | F.col("_time").isNotNull() | F.col("_tax").isNotNull(), F.struct(
        F.col("_geo").alias("geographicCoverage"), F.col("_time").alias("temporalCoverage"), F.col("_tax").alias("taxonomicCoverage")))
    doi, method = tx.normalize_doi(F.col("manuscript_doi")), tx.clean_text(F.col("methodology"))
    title, text, project = tx.clean_text(F.col("title")), tx.clean_text(F.col("description")), tx.clean_text(F.col("project_title"))
    body = F.struct(
        F.concat(F.lit("https://doi.org/"), doi).alias("alternateIdentifier"), title.alias("title"), of("creator").alias("creator"),
        of("metadataProvider").alias("metadataProvider"), F.date_format(today, "yyyy-MM-dd").alias("pubDate"), F.lit("eng").alias("language"),
        F.when(text.isNotNull(), F.struct(text.alias("para"))).alias("abstract"),
        F.struct(F.lit(MARK).alias("para")).alias("intellectualRights"), coverage.alias("coverage"), of("contact").alias("contact"),
        F.when(method.isNotNull(), F.struct(F.struct(F.struct(method.alias("para")).alias("description")).alias("methodStep"))).alias("methods"),
        F.when(project.isNotNull(), F.struct(project.alias("title"), of("personnel", "metadataProvider").alias("personnel"))).alias("project"))
    citation = _filled(F.col("dataset_citation"))
    extra = F.when(citation.isNotNull(), F.to_xml(F.struct(F.struct(F.struct(
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("dateStamp"), F.lit("dataset").alias("hierarchyLevel"), citation.alias("citation"),
    ).alias("gbif")).alias("metadata")), {"rowTag": "additionalMetadata"}))
    built = m.select("dataset_id", title.isNotNull().alias("_titled"), F.to_xml(body, {"rowTag": "dataset"}).alias("_x"), extra.alias("_e"))
    first = F.substring_index("_x", "<title>", 1)
    rest = F.substr("_x", F.length(first) + len("<title>") + 1)
    xml = F.when(F.col("_titled"), F.concat(first, F.lit('<title xml:lang="eng">'), rest)).otherwise(F.col("_x"))
    # only this element can hold the mark: brackets in texts are escaped
    xml = F.regexp_replace(xml, rf"(<intellectualRights>\s*<para>){MARK}(</para>)", "$1" + LICENCE + "$2")
    package = F.concat(F.lit(HEAD), F.lit(' packageId="dataset-'), F.col("dataset_id").cast("string"), F.lit('/v1">\n'))
    return built.select("dataset_id", F.concat(package, xml, F.lit("\n"), F.coalesce(F.concat(F.col("_e"), F.lit("\n")), F.lit("")),
                                               F.lit("</eml:eml>\n")).alias("eml"))


PERSON = ("struct<individualName:struct<givenName:string,surName:string>,electronicMailAddress:string,"
          "userId:struct<_directory:string,_VALUE:string>,role:string>")
# What a document holds, as it is read back.
DOCUMENT = (
    "_packageId string, dataset struct<alternateIdentifier:string,title:struct<`_xml:lang`:string,_VALUE:string>,"
    f"creator:array<{PERSON}>,metadataProvider:array<{PERSON}>,pubDate:string,language:string,abstract:struct<para:string>,"
    "intellectualRights:struct<para:struct<ulink:struct<_url:string,citetitle:string>>>,"
    "coverage:struct<geographicCoverage:struct<geographicDescription:string,boundingCoordinates:struct<westBoundingCoordinate:string,eastBoundingCoordinate:string,"
    "northBoundingCoordinate:string,southBoundingCoordinate:string>>,temporalCoverage:struct<singleDateTime:struct<calendarDate:string>,"
    "rangeOfDates:struct<beginDate:struct<calendarDate:string>,endDate:struct<calendarDate:string>>>,"
    "taxonomicCoverage:struct<generalTaxonomicCoverage:string,taxonomicClassification:array<struct<taxonRankName:string,taxonRankValue:string,commonName:string>>>>,"
    f"contact:array<{PERSON}>,methods:struct<methodStep:struct<description:struct<para:string>>>,project:struct<title:string,personnel:array<{PERSON}>>>, "
    "additionalMetadata struct<metadata:struct<gbif:struct<dateStamp:string,hierarchyLevel:string,citation:string>>>")
# The order of a dataset's elements.
CHILDREN = ["alternateIdentifier", "title", "creator", "metadataProvider", "pubDate", "language", "abstract", "intellectualRights", "coverage", "contact", "methods", "project"]


def _leaves(value: Column, kind: T.DataType, path: Column) -> Column:
    """Array of (path, value) of the texts below a parsed value; elements of a list have their place in the path."""
    if isinstance(kind, T.StructType):
        parts = [_leaves(value[f.name], f.dataType, F.concat(path, F.lit("/" + f.name))) for f in kind.fields]
        return F.flatten(F.array(*parts))
    if isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda x, i: _leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(each), F.array().cast("array<struct<path:string,value:string>>"))
    one = F.array(F.struct(path.alias("path"), value.alias("value")))
    return F.when(value.isNotNull(), one).otherwise(F.array().cast("array<struct<path:string,value:string>>"))


def eml_fields(documents: DataFrame) -> DataFrame:
    """(dataset_id, path, value): every text and attribute of EML documents (dataset_id, eml), read back with the schema of what they may hold.

    The path ``children`` lists the elements of the dataset in the order in which they stand. A text that is no XML gives none of its fields.
    """
    parsed = documents.select("dataset_id", "eml", F.from_xml("eml", DOCUMENT, {"mode": "PERMISSIVE"}).alias("doc"))
    kind = parsed.schema["doc"].dataType
    body = F.substr("eml", F.instr("eml", F.lit("<dataset>")))
    places = F.array(*[F.struct(F.regexp_instr(body, F.lit(rf"\n    <{c}[ >]")).alias("at"), F.lit(c).alias("name")) for c in CHILDREN])
    order = F.array_join(F.transform(F.sort_array(F.filter(places, lambda p: p["at"] > 0)), lambda p: p["name"]), ",")
    fields = F.concat(_leaves(F.col("doc"), kind, F.lit("")), F.array(F.struct(F.lit("children").alias("path"), order.alias("value"))))
    return parsed.select("dataset_id", F.explode(fields).alias("f")).select("dataset_id", F.ltrim("f.path", F.lit("/")).alias("path"), "f.value")
