"""EML documents read back: every text, places in lists, and the order of the elements."""

from pyspark.sql import functions as F

from fieldsheet.operators import eml


def _fields(spark, text):
    df = spark.createDataFrame([(1, text)], "dataset_id long, eml string")
    return {r["path"]: r["value"] for r in eml.eml_fields(df).collect()}


def test_a_document_as_it_is_written(spark):
    meta = spark.sql("SELECT 1L AS dataset_id, 'A & <b>' AS title, 'text' AS description, array(named_struct('first_name', 'X', 'last_name', 'Y', 'email', '', 'orcid', '1'), named_struct('first_name', '', 'last_name', 'Z', 'email', 'z@x', 'orcid', '')) AS users")
    owners = spark.sql("SELECT 2L AS dataset_id, 'a' AS first_name, 'b' AS last_name, 'c' AS email, 'd' AS orcid")
    out = eml.eml_documents(meta, owners, F.lit("2024-05-01").cast("date"), F.lit("2024-05-01 00:00:00").cast("timestamp"))
    got = {r["path"]: r["value"] for r in eml.eml_fields(out).collect()}
    assert got["dataset/title/_VALUE"] == "A & <b>" and got["dataset/creator[1]/electronicMailAddress"] == "z@x" and got["dataset/creator[0]/userId/_VALUE"] == "1"
    assert "dataset/creator[1]/individualName/givenName" not in got and got["dataset/contact[0]/individualName/givenName"] == eml.NOBODY["first_name"]
    assert got["children"] == "title,creator,metadataProvider,pubDate,language,abstract,intellectualRights,contact" and got["_packageId"] == "dataset-1/v1"


def test_elements_out_of_order_are_seen(spark):
    text = "<eml:eml xmlns:eml='x' packageId='p'>\n<dataset>\n    <pubDate>d</pubDate>\n    <title>t</title>\n</dataset>\n</eml:eml>"
    assert _fields(spark, text) == {"_packageId": "p", "dataset/title/_VALUE": "t", "dataset/pubDate": "d", "children": "pubDate,title"}


def test_a_text_that_is_no_document(spark):
    assert _fields(spark, "<eml:eml><dataset>") == {"children": ""} and _fields(spark, "nothing") == {"children": ""}
