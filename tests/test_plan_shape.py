"""Plans of core operators: no Python, no cartesian product, pruned scans."""

import pytest

from fieldsheet.operators import names, profile, rules
from fieldsheet.queries.registry import Data

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def data(spark):
    return Data(spark, FOLDER)


def test_no_python_and_no_product(data):
    occ = data.view("occ")
    for df in (rules.row_flags(occ, rules.row_rules(occ.columns)), rules.duplicate_catalog_number(occ), profile.column_profile(occ),
               names.match_names(occ, data.view("backbone"))):
        text = plan(df)
        assert "Python" not in text and "ArrowEval" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_scan_reads_only_needed_columns(data):
    text = plan(data.view("occ").select("row_id", "country"))
    assert "o_orderstatus" not in text and "o_totalprice" not in text


def test_ranking_is_limited_before_the_shuffle(data):
    assert "WindowGroupLimit" in plan(names.names_to_check(data.view("occ"), 50, 30))


def test_coverage_scans_each_table_once(data):
    from fieldsheet.operators import coverage
    from fieldsheet.plans.scratch import materialize
    tables = [materialize(data.view("occ").select("dataset_id", "table_id", "row_id", "eventDate", "country", "kingdom", "decimalLatitude", "decimalLongitude"), "o"),
              materialize(data.view("visits"), "v")]
    text = plan(coverage._gather(tables, ["dataset", "dates", "box", *coverage.TOPICS]))
    assert text.count("FileScan parquet") == 2 or text.count("Scan parquet") == 2
