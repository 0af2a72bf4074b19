import random
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fieldsheet.operators import coverage, eml, links, log, mapping, names, registry, reshape, rules, trees
from fieldsheet.sources import archive, delimited, files, vocab


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_identifier_uniqueness(spark):
    def clashes(ids):
        t = spark.createDataFrame([(1, 1, i, v) for i, v in enumerate(ids)], "dataset_id long, table_id long, row_id long, occurrenceID string")
        return rows(rules.duplicate_occurrence_id(t), "row_id")
    assert clashes(["abc-1", "Abc-2", "ABC-3"]) == []
    assert clashes(["x-185À", "x-185à", "y"]) == [(0,), (1,)]
    assert clashes(["", None, " ", "x-1"]) == []


def test_extension_tables_are_no_occurrence_core(spark):
    t = spark.createDataFrame([(1, 1, 0, "a", "m"), (1, 1, 1, "a", "n")], "dataset_id long, table_id long, row_id long, occurrenceID string, measurementID string")
    assert rows(rules.duplicate_occurrence_id(t)) == []


def test_row_rules(spark):
    t = spark.createDataFrame([(1, 1, 0, "Event", "91", "2.5", "2020"), (1, 1, 1, None, "1d", "1", "x"), (1, 1, 2, "event", "-90", "0", "2999-01-01")],
                              "dataset_id long, table_id long, row_id long, basisOfRecord string, decimalLatitude string, individualCount string, eventDate string")
    got = rows(rules.row_flags(t, rules.row_rules(t.columns, today=F.lit("2024-01-01").cast("date"))), "rule", "row_id")
    assert got == [("basisOfRecord", 1), ("basisOfRecord", 2), ("decimalLatitude", 0), ("decimalLatitude", 1), ("eventDate", 1), ("eventDateFuture", 2),
                   ("individualCount", 0), ("individualCount", 2)]


def test_coverage_cases(spark):
    ids = "dataset_id long, table_id long, row_id long, "
    t = spark.createDataFrame([(1, 1, i, d) for i, d in enumerate(["2019-01-15", "2020-02", "2018", "2007-03-01/2008-05-11"])], ids + "eventDate string")
    assert coverage.temporal_coverage(t).first().temporal_scope == "2007-03-01/2020-02-29"
    ymd = spark.createDataFrame([(1, 1, 0, "2011", "", ""), (1, 1, 1, "2013", "6", "30"), (1, 1, 2, "2012", "2", "")], ids + "year string, Month string, day string")
    assert coverage.temporal_coverage(ymd).first().temporal_scope == "2011-01-01/2013-06-30"
    geo = spark.createDataFrame([(1, 1, 0, "Norway", "60", "10"), (1, 1, 1, "norway", "61.5", "x"), (1, 1, 2, "Sweden", "59", "12")], ids + "Country string, decimalLatitude string, decimalLongitude string")
    assert coverage.geographic_scope(geo).first().geographic_scope == "Countries: Norway, Sweden; Coordinate bounds: lat 59.0000 to 60.0000, lon 10.0000 to 12.0000"
    place = spark.createDataFrame([(1, 2, 0, "Oslo"), (1, 2, 1, "Bergen")], ids + "locality string")
    assert coverage.geographic_scope(place).first().geographic_scope == "Regions: Oslo, Bergen"
    tax = spark.createDataFrame([(1, 1, i, None, f"F{i}", f"s{i}") for i in range(7)], ids + "kingdom string, family string, scientificName string")
    assert coverage.taxonomic_scope(tax).first().taxonomic_scope == "Families: F0, F1, F2, F3, F4 (+2 more)"
    one = spark.createDataFrame([(1, 1, 0, "Plantae"), (1, 1, 1, "plantae ")], ids + "kingdom string")
    assert coverage.taxonomic_scope(one).first().taxonomic_scope == "Kingdom: Plantae"
    assert rows(coverage.taxonomic_keywords(one), "field", "text") == [("kingdom", "Plantae")]
    how = spark.createDataFrame([(1, 1, 0, "Camera trap"), (1, 1, 1, "Camera trap")], ids + "samplingProtocol string")
    assert coverage.methodology(how).first().methodology == "Camera trap"


def test_today_placeholder(spark):
    day = F.lit("2024-01-31").cast("date")
    r = spark.range(1).select(coverage.resolve_scope(F.lit("2024-01-31"), F.lit(None).cast("string"), F.lit("2001/2002"), "Temporal scope", "dates", day).alias("r")).first().r
    assert r.value == "2001/2002" and "placeholder" in r.note


SHAPES = {"a": "(A:0.1,B:0.2,(C:0.3,D:0.4):0.5);", "b": "((A:0.1,B:0.2)100:0.3,(C:1e-05,D:0.5)90:0.6[1]);", "c": "(Berneuxia_thibetica:0.1,\n Diapensia_himalaica:0.2)root;"}
NEXUS = "#NEXUS\nBEGIN TREES;\n  Translate\n   DBT01_clean Berneuxia_thibetica_01,\n   7 'Cyrilla racemiflora';\n TREE one = [&R] (DBT01_clean:0.1,7:0.2);\n TREE two = (x,y);\nEND;"


def _trees(spark):
    return spark.createDataFrame([(1, k, "newick", v) for k, v in SHAPES.items()]
                                 + [(d, "n", "nexus", NEXUS) for d in (1, 2)] + [(d, "m", "nexus", "#NEXUS\nBEGIN TREES;\n tree t = (P:1,(Q:2,R:3)in:4);\nEND;") for d in (1, 2)],
                                 "dataset_id long, tree_id string, format string, content string").filter("dataset_id = 1 OR tree_id = 'm'")


def test_tip_labels(spark):
    got = {}
    for r in trees.tip_labels(_trees(spark)).filter("dataset_id = 1").orderBy("tree_id", "pos").collect():
        got.setdefault(r.tree_id, []).append(r.label)
    assert got == {"a": list("ABCD"), "b": list("ABCD"), "c": ["Berneuxia_thibetica", "Diapensia_himalaica"],
                   "n": ["Berneuxia_thibetica_01", "Cyrilla racemiflora"], "m": list("PQR")}


def test_tree_nodes_and_shape(spark):
    nodes = trees.tree_nodes(_trees(spark)).cache()
    b = {r.name: r for r in nodes.filter("tree_id = 'b'").collect()}
    assert b["C"].branch_length == 1e-05 and b["100"].branch_length == 0.3 and b["90"].branch_length == 0.6
    assert b["A"].parent == b["100"].open and b["100"].parent == 0 and b["D"].depth == 2 and b[None].depth == 0
    assert {r.name for r in nodes.filter("tree_id = 'n' AND is_tip").collect()} == {"Berneuxia_thibetica_01", "Cyrilla racemiflora"}
    shape = {r.name: r for r in trees.clade_shape(nodes).join(nodes, ["dataset_id", "tree_id", "open"]).filter("tree_id = 'm' AND dataset_id = 1").collect()}
    assert (shape["in"].n_tips, shape["in"].longest_path, shape["P"].longest_path, shape[None].longest_path) == (2, 3.0, 0.0, 7.0)
    counts = spark.createDataFrame([(1, "Q", 4, True), (1, "P", 1, False), (2, "R", 7, False)], "dataset_id long, tip string, n_records long, has_coordinates boolean")
    sums = {r.name: r.occurrence_count for r in trees.clade_counts(nodes, counts).filter("tree_id = 'm' AND dataset_id = 1").collect()}
    assert {r.name: r.occurrence_count for r in trees.clade_counts(nodes, counts).filter("dataset_id = 2").collect()} == {"P": 0, "Q": 0, "R": 7, "in": 7, None: 7}
    assert sums == {"P": 1, "Q": 4, "R": 0, "in": 4, None: 5}
    status = trees.link_status(nodes, counts).filter("tree_id = 'm' AND dataset_id = 1").first()
    assert (status.linked_tips, status.total_tips, status.percent, status.has_coordinates) == (2, 3, 67, True)


def test_deep_tree(spark):
    n = 300
    text = "(" * n + "t0" + "".join(f",t{i}:1)n{i}:1" for i in range(1, n + 1)) + ";"
    nodes = trees.tree_nodes(spark.createDataFrame([(1, "d", "newick", text)], "dataset_id long, tree_id string, format string, content string"))
    shape = trees.clade_shape(nodes).join(nodes, ["dataset_id", "tree_id", "open"])
    got = {r.name: (r.n_tips, r.longest_path) for r in shape.filter("NOT is_tip").collect()}
    assert got[f"n{n}"] == (n + 1, n) and got["n1"] == (2, 1.0)


def test_quotes_in_trees(spark):
    long = "x" * 20000
    texts = [("q", "newick", "('Homo sapiens':1,'it''s [here], (now); x':2,\"a,b\":3,C[a comment, (with) marks;]:4,Two words:5," + long + ":6)'the root';(Z,Y);"),
             ("x", "nexus", "#NEXUS\n[TREE no = (A,B);]\nBEGIN TREES;\nTRANSLATE 1 'Smith, J sp', 2 Homo   sapiens, 'c d' 'Q''s';\nTREE t = [&R] (1:1,(2:2,'c d':3):1);\nEND;")]
    df = spark.createDataFrame([(1, *t) for t in texts], "dataset_id long, tree_id string, format string, content string")
    tips = [r.label for r in trees.tip_labels(df).filter("tree_id = 'q'").orderBy("pos").collect()]
    assert tips == ["Homo sapiens", "it's [here], (now); x", "a,b", "C", "Twowords", long]
    nodes = trees.tree_nodes(df).filter("tree_id = 'q'").collect()
    assert {r.name: r.branch_length for r in nodes if r.is_tip} == dict(zip(tips, range(1, 7))) and [r.name for r in nodes if not r.is_tip] == ["the root"]
    named = ["Smith, J sp", "Homo sapiens", "Q's"]
    assert [(r.code, r.name) for r in trees.nexus_translate(df).orderBy("pos").collect()] == list(zip(["1", "2", "c d"], named))
    assert [r.label for r in trees.tip_labels(df).filter("tree_id = 'x'").orderBy("pos").collect()] == named
    assert {r.name for r in trees.tree_nodes(df).filter("tree_id = 'x' AND is_tip").collect()} == set(named)


def test_tree_summary_preview(spark):
    files = spark.createDataFrame([(1, "x", "x.nwk", "newick", "(A:1,B:1)" + " " * 600 + ";", None)], "dataset_id long, tree_id string, path string, format string, content string, error string")
    r = trees.tree_summary(files).first()
    assert len(r.preview) == 503 and r.preview.endswith("...") and r.labels == "A, B" and not r.truncated


def test_match_names_equals_brute_force(spark):
    def edits(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]
    long = "Rhododendron ferrugineum alpinu"
    known = ["Parus major", "Parus minor", "Carex nigra", "Carex nigrans", "Poa annua", "Poa alpina", long, "Ab", "Abc", ""]
    asked = ["Parus major", "Parus majr", "Paruss majorr", "Carex nigr", "poa anua", "Xyz", "Poa alpinaaa", "Poa alpinaaaa", "Rhododendrn ferruginem alpnu", "xhododxndron ferrxgineum alpinx",
             "XRhododendronferrugineum  alpinux", "Rhododend ferrugineum alp", "ab", "abd", "P", "Parus major minor"]
    got = {r.name: (r.match_type, r.matched_name) for r in names.match_names(
        spark.createDataFrame([(a,) for a in asked], "scientificName string"), spark.createDataFrame([(k,) for k in known], "scientificName string")).collect()}
    for a in asked:
        near = [(edits(a.lower(), k.lower()), k) for k in known]
        near = [(e, k) for e, k in near if 100 * (max(len(a), len(k)) - e) // max(len(a), len(k)) >= 80]
        if a in known:
            assert got[a] == ("EXACT", a)
        elif not near:
            assert got[a] == ("NONE", None)
        else:
            best = min(near, key=lambda e: (-(100 * (max(len(a), len(e[1])) - e[0]) // max(len(a), len(e[1]))), e[1]))
            assert got[a] == ("FUZZY", best[1])


def test_match_names_down_to_fifty(spark):
    def edits(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]
    draw = random.Random(5)
    known = sorted({"".join(draw.choice("abcd") for _ in range(draw.randint(1, 9))) for _ in range(120)} | {"Abies"})
    asked = sorted({"".join(draw.choice("abcdxyz") for _ in range(draw.randint(1, 14))) for _ in range(250)} | {"Abeis", "xxab"})
    got = names.match_names(spark.createDataFrame([(a,) for a in asked], "scientificName string"),
                            spark.createDataFrame([(k,) for k in known], "scientificName string"), 50)
    found = {r.name: (r.match_type, r.matched_name, r.confidence) for r in got.collect()}
    for a in asked:
        score, best = min((-(100 * (max(len(a), len(k)) - edits(a.lower(), k.lower())) // max(len(a), len(k))), k) for k in known)
        want = ("EXACT", a, 100) if a in known else ("FUZZY", best, -score) if -score >= 50 else ("NONE", None, 0)
        assert found[a] == want, a
    assert found["Abeis"] == ("FUZZY", "Abies", 60)
    told = spark.createDataFrame([(1, 1, "Abeis"), (1, 1, "zzzzzzz")], "dataset_id int, table_id int, scientificName string")
    matches = spark.createDataFrame([("Abeis", *found["Abeis"]), ("zzzzzzz", "NONE", None, 0)], got.schema)
    assert [(r.kind, r.n, r.message) for r in names.correction_messages(told, matches).collect()] == [("unmatched", 1, "'zzzzzzz'")]


def _eml(spark, **extra):
    row = {"dataset_id": 1, "title": "Title <1>", "description": "Text & more", **extra}
    schema = "dataset_id long, " + ", ".join(f"{k} {eml.OPTIONAL.get(k, 'string')}" for k in row if k != "dataset_id")
    meta = spark.createDataFrame([tuple(row.values())], schema)
    owners = spark.createDataFrame([(1, "Ada", "L", "ada@example.org", "0000-1")], "dataset_id long, first_name string, last_name string, email string, orcid string")
    return ET.fromstring(eml.eml_documents(meta, owners, F.lit("2024-01-01").cast("date")).first().eml.split("?>", 1)[1])


def test_eml_minimal(spark):
    root = _eml(spark)
    d = root.find("dataset")
    assert [c.tag for c in d] == ["title", "creator", "metadataProvider", "pubDate", "language", "abstract", "intellectualRights", "contact"]
    assert d.find("title").text == "Title <1>" and d.find("title").get("{http://www.w3.org/XML/1998/namespace}lang") == "eng"
    assert d.find("intellectualRights/para/ulink/citetitle") is not None and d.find("creator/userId").get("directory") == "https://orcid.org/"
    assert root.find("additionalMetadata") is None


def test_eml_full(spark):
    root = _eml(spark, temporal_scope="17 - 22 October 2025", geographic_scope="lat 10 S to 20 N, lon 5 W to 7 E", taxonomic_scope="Plantae, Fabaceae",
                methodology="Nets", manuscript_doi="doi:10.1/x", project_title="Project", dataset_citation="Cite", contact_email="c@example.org",
                users=[("A", "B", "a@example.org", "1"), ("C", "D", "", "")])
    d = root.find("dataset")
    assert d[0].tag == "alternateIdentifier" and d[0].text == "https://doi.org/10.1/x"
    assert len(d.findall("creator")) == 2 and len(d.findall("project/personnel")) == 2 and d.find("project/personnel/electronicMailAddress") is None
    assert d.find("project/personnel/role").text == "metadataProvider" and d.find("contact/electronicMailAddress").text == "c@example.org"
    assert d.find("coverage/temporalCoverage/rangeOfDates/beginDate/calendarDate").text == "2025-10-17"
    assert d.find("coverage/geographicCoverage/boundingCoordinates/southBoundingCoordinate").text == "-10"
    assert [e.text for e in d.findall("coverage/taxonomicCoverage/taxonomicClassification/taxonRankName")] == ["kingdom", "family"]
    assert root.find("additionalMetadata/metadata/gbif/citation").text == "Cite"
    tags = [c.tag for c in d]
    assert tags.index("coverage") < tags.index("contact") < tags.index("methods") < tags.index("project")


def test_eml_incomplete_coverage_is_left_out(spark):
    d = _eml(spark, geographic_scope="Norway", temporal_scope="spring", taxonomic_scope="Birds of the far north. And more.").find("dataset")
    assert d.find("coverage") is None


def test_archive(spark, tmp_path):
    core = spark.createDataFrame([("a", "x\ty", "1"), ("b", None, "2")], "occurrenceID string, scientificName string, unknownColumn string")
    ext = spark.createDataFrame([("a", "length", "3")], "occurrenceID string, measurementType string, measurementValue string")
    (tmp_path / "tree.nwk").write_text("(a,b);")
    out = archive.write_archive(core, "occurrence", {"measurement_or_fact": ext}, "<eml/>", str(tmp_path / "dwca"), [str(tmp_path / "tree.nwk")])
    ns = {"d": "http://rs.tdwg.org/dwc/text/"}
    meta = ET.parse(f"{out}/meta.xml").getroot()
    assert [f.get("term").rsplit("/", 1)[1] for f in meta.findall("d:core/d:field", ns)] == ["occurrenceID", "scientificName"]
    assert meta.find("d:extension/d:coreid", ns).get("index") == "0"
    files_ = [e.text for e in meta.findall("d:core/d:files/d:location", ns)]
    assert files_ and all((Path(out) / f).exists() for f in files_) and (Path(out) / "tree.nwk").exists() and (Path(out) / "eml.xml").read_text() == "<eml/>"
    assert sorted("".join((Path(out) / f).read_text() for f in files_).splitlines())[:2] == ["a\tx y", "b\t"]
    with pytest.raises(ValueError, match="unique"):
        archive.write_archive(core.unionByName(core.withColumn("occurrenceID", F.upper("occurrenceID"))), "occurrence", {}, "", str(tmp_path / "bad"))


def test_csv_fields_and_records(values):
    text = 'a,"b ""q"", c",\n\n"multi\nline",,x\n5" pipe,y,z\n'
    got = values([text], lambda c: F.transform(delimited.records(c), lambda r: delimited.fields(r, ",")))[0]
    assert got == [["a", 'b "q", c', ""], ["multi\nline", "", "x"], ['5" pipe', "y", "z"]]
    assert values([",a,"], lambda c: delimited.fields(c, ",")) == [["", "a", ""]]
    assert values(["a|b"], lambda c: delimited.fields(c, "|")) == [["a", "b"]]


def test_read_lines_and_delimited(spark, tmp_path):
    p = tmp_path / "big.csv"
    p.write_text("id,name\n" + "".join(f"{i},n{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = delimited.read_lines(spark, str(p))
        assert lines.rdd.getNumPartitions() >= 1
        got = {r.line_no: r.line for r in lines.collect()}
        assert got[0] == "id,name" and got[5000] == "4999,n4999" and len(got) == 5001
        t = delimited.read_delimited(spark, str(p))
        assert all(r.id == str(r.row_id) for r in t.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_null_policies(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\nNA,\nnull,x\n")
    pandas_like = rows(delimited.read_delimited(spark, str(tmp_path / "t.csv")), F.coalesce("a", F.lit("-")), F.coalesce("b", F.lit("-")))
    kept = rows(delimited.read_delimited(spark, str(tmp_path / "t.csv"), null_policy="keep"), "a", "b")
    assert pandas_like == [("-", "-"), ("-", "x")] and kept == [("NA", ""), ("null", "x")]


def test_extension_files(spark, tmp_path):
    (tmp_path / "e.xml").write_text('<?xml version="1.0"?>\n<extension xmlns="http://x/" rowType="http://r/Identifier" dc:title="t" xmlns:dc="http://d/">\n'
                                    '  <property name="identifier" qualName="http://q/identifier"/>\n  <property name="bad"/>\n  <property name="title" qualName="http://q/title"/>\n</extension>')
    assert rows(vocab.load_schema_terms(spark, str(tmp_path / "e.xml")), "row_type", "name", "uri") == [
        ("http://r/Identifier", "identifier", "http://q/identifier"), ("http://r/Identifier", "title", "http://q/title")]


def test_schema_sizes():
    sizes = {s[0]: len(set(s[5])) for s in vocab.SCHEMAS}
    assert [sizes[k] for k in ("occurrence", "event", "taxon", "measurement_or_fact", "dna_derived_data", "identification", "identification_history")] == [198, 97, 52, 11, 123, 38, 50]
    assert [sizes[k] for k in ("identifier", "description", "distribution", "multimedia", "references", "resource_relation", "resource_relationship")] == [5, 11, 16, 15, 13, 7, 8]
    assert [sizes[k] for k in ("species_profile", "types_and_specimen", "vernacular_name", "releve", "chronometric_age")] == [15, 19, 14, 20, 18]
    assert sum(len(t) for t in vocab.CLASSES.values()) == 191


def test_lookup_fan_out_is_refused(spark):
    t = spark.createDataFrame([(1, "x")], "i int, k string")
    with pytest.raises(ValueError, match="not unique"):
        links.join_lookup_table(t, spark.createDataFrame([("x", 1), ("x", 2)], "k string, v int"), ["k"])


def test_message_contents(spark):
    msgs = ['{"role":"user","content":[{"text":"a"},"b",{"n":1}]}', '{"role":"user","content":{"text":"c"}}', '{"role":"user","content":null}', "junk", '{"role":"User ","content":"[x]"}']
    t = spark.createDataFrame([(i, 1, m) for i, m in enumerate(msgs)], "message_id long, agent_id long, openai_obj string")
    got = {r.message_id: (r.role, r.text) for r in log.message_items(t).collect()}
    assert got == {0: ("user", 'a\nb\n{"n":1}'), 1: ("user", "c"), 2: ("user", ""), 3: ("user", ""), 4: ("user", "[x]")}


def test_minted_identifiers_are_stable(spark):
    t = spark.createDataFrame([(1, 1, i) for i in range(50)], "dataset_id long, table_id long, row_id long")
    a, name = mapping.ensure_identifier(t, "occurrenceID")
    b, _ = mapping.ensure_identifier(t.repartition(3), "occurrenceID")
    assert rows(a) == rows(b) and a.select(name).distinct().count() == 50
    assert mapping.ensure_identifier(a.withColumnRenamed("occurrenceID", "OCCURRENCEID"), "occurrenceID")[1] == "OCCURRENCEID"


def test_user_code(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "i long, v string")
    assert rows(registry.transform_table(t, lambda d: d.filter("i = 1"))) == [(1, "a")]
    assert rows(registry.transform_table(t, lambda p: p.assign(v=p.v.str.upper()), "i long, v string")) == [(1, "A"), (2, "B")]


def test_fingerprints_cover_whole_content(spark):
    t = spark.createDataFrame([(1, "x" * 100000 + "a", 1), (2, "x" * 100000 + "b", 2)], "file_id long, content string, uploaded_at long")
    assert files.unique_contents(t).count() == 2


def test_fill_down_across_blocks(spark):
    t = spark.createDataFrame([(1, 1, i, "v" if i == 0 else None) for i in range(100)], "dataset_id long, table_id long, row_id long, v string")
    assert reshape.fill_down(t, ["v"], block=9).filter("v = 'v'").count() == 100


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, None), ("k", 1, None), ("k", 2, "b")], "g string, row_id long, v string")
    from fieldsheet.plans import scans
    got = scans.carry_last(df, ["g"], "row_id", {"v": F.col("v")})
    assert sorted(((r.g, r.row_id, r.v) for r in got.collect()), key=str) == sorted([(None, 1, "a"), (None, 2, "a"), ("k", 1, None), ("k", 2, "b")], key=str)
    assert scans.running_sum(df.withColumn("n", F.lit(1)), ["g"], "row_id", {"s": F.col("n")}).count() == 4
    assert scans.carry_next(df, ["g"], "row_id", "w", F.col("v")).count() == 4


def test_hot_keys_are_those_with_a_share(spark):
    from fieldsheet.plans import skew
    even = spark.range(1000).select((F.col("id") % 500).alias("k"))
    assert skew.hot_keys(even, ["k"], 100).count() == 0
    hot = even.unionByName(spark.range(300 * 20).select((10000 + F.col("id") % 300).alias("k")))
    assert skew.hot_keys(hot, ["k"]).count() == 300


def test_bad_characters_and_marks_in_eml(spark):
    rows_ = [(1, "bad \x01 title \ufffe", "licence"), (2, "@licence@ <intellectualRights><para>licence</para>", "text")]
    meta = spark.createDataFrame(rows_, "dataset_id long, title string, description string")
    owners = spark.createDataFrame([(1, "A\x02", "B", None, None)], "dataset_id long, first_name string, last_name string, email string, orcid string")
    for r in eml.eml_documents(meta, owners).collect():
        root = ET.fromstring(r.eml)
        texts = {e.tag: e.text for e in root.find("dataset")}
        assert texts["title"] == {1: "bad  title", 2: rows_[1][1]}[r.dataset_id].strip()
        assert len(root.findall(".//citetitle")) == 1
        assert root.find("dataset/abstract/para").text == rows_[r.dataset_id - 1][2]


def test_extension_uris_and_blanks(spark, tmp_path):
    uris = {(r.schema_key, r.term): r.uri for r in vocab.schema_terms(spark).collect()}
    assert uris["species_profile", "isMarine"] == "http://rs.gbif.org/terms/1.0/isMarine"
    assert uris["distribution", "threatStatus"] == "http://iucn.org/terms/threatStatus"
    assert uris["chronometric_age", "materialDated"] == "http://rs.tdwg.org/chrono/terms/materialDated"
    assert uris["occurrence", "basisOfRecord"] == "http://rs.tdwg.org/dwc/terms/basisOfRecord" and uris["occurrence", "license"] == "http://purl.org/dc/terms/license"
    core = spark.createDataFrame([("a", " lead")], "occurrenceID string, scientificName string")
    ext = spark.createDataFrame([("a", "true")], "occurrenceID string, isMarine string")
    out = archive.write_archive(core, "occurrence", {"species_profile": ext}, "<eml/>", str(tmp_path / "dwca"))
    ns = {"d": "http://rs.tdwg.org/dwc/text/"}
    meta = ET.parse(f"{out}/meta.xml").getroot()
    assert [(f.get("index"), f.get("term")) for f in meta.findall("d:extension/d:field", ns)] == [("1", "http://rs.gbif.org/terms/1.0/isMarine")]
    parts = [(Path(out) / e.text).read_text().splitlines()[1:] for e in meta.findall("d:core/d:files/d:location", ns)]
    assert [line for p in parts for line in p] == ["a\t lead"]


def test_bounds_in_prose(spark):
    from fieldsheet.functions import coords
    cases = {"lat 10 S to 20 N, lon 5 W to 7 E": (-5.0, 7.0, 20.0, -10.0), "Coordinate bounds: lat -1.5000 to 2.2500, lon 10.0000 to 11.5000": (10.0, 11.5, 2.25, -1.5),
             "between 10-20 N latitude; 30 - 40 W longitude": (-40.0, 30.0, 20.0, 10.0), "plateau 10 to 20, lon 5 to 6": None, "latitude 5; longitude 6": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", coords.bounds_from_text(F.col("t")).alias("b"))
    for r in df.collect():
        assert (r.b and (r.b.west, r.b.east, r.b.north, r.b.south)) == cases[r.t], r.t


def test_scopes_count_all_values(spark):
    t = spark.createDataFrame([(1, 1, i, f"Land {i:03d}", f"family{i}") for i in range(300)], "dataset_id long, table_id long, row_id long, country string, family string")
    assert coverage.geographic_scope(t).first().geographic_scope.endswith("(+295 more)")
    assert coverage.taxonomic_scope(t).first().taxonomic_scope.endswith("(+295 more)")
    assert coverage.taxonomic_keywords(t).count() == 300


def test_wide_and_multi_line_records(values):
    wide = ",".join(f'"a{i},\n""b"""' for i in range(3000))
    got = values([wide + "\nx,y", 'a,"open\nb,c', 'p\x1e"1,2"\x1eq,r\n\n"",'], delimited.records)
    assert [len(g) for g in got] == [2, 2, 2] and got[1] == ['a,"open', "b,c"]
    cut = values([got[0][0], got[2][0], '"",', 'a"b"c,"d""e"'], lambda c: delimited.fields(c, ","))
    assert cut[0] == [f'a{i},\n"b"' for i in range(3000)]
    assert cut[1:] == [['p\x1e"1,2"\x1eq', "r"], ["", ""], ['a"b"c', 'd"e']]


def test_delimiter_is_judged_by_all_lines(spark):
    lines = [("f", i, "a;b,c") for i in range(60)] + [("f", 60 + i, "a;b,c,d" if i % 2 else "a;b") for i in range(60)]
    df = spark.createDataFrame(lines, "file string, line_no long, line string")
    assert delimited.detect_delimiter(df).filter("rank = 1").first().delimiter == ";"
    assert delimited.choose_delimiter(df).first().delimiter == ";"
