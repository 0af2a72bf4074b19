from datetime import date

import pytest

from fieldsheet.functions import coords, dates, text


@pytest.mark.parametrize("value,start,end", [
    ("2019", "2019-01-01", "2019-12-31"), ("2020-02", "2020-02-01", "2020-02-29"), ("2019-02", "2019-02-01", "2019-02-28"),
    ("2007-03-01/2008-05-11", "2007-03-01", "2008-05-11"), ("2008/2007", "2007-12-31", "2008-01-01"), ("2010 to 2011", "2010-01-01", "2011-12-31"),
    ("11 March 2026", "2026-03-11", "2026-03-11"), ("March 11, 2026", "2026-03-11", "2026-03-11"), ("Sept 2020", "2020-09-01", "2020-09-01"),
    ("2020-02-30", None, None), ("nan", None, None), ("", None, None), (None, None, None), ("0000", None, None), ("later/2010", None, None),
    ("2001-02-03T04:05:06Z", "2001-02-03", "2001-02-03"), (" 2019-01-15 ", "2019-01-15", "2019-01-15")])
def test_date_bounds(values, value, start, end):
    got = values([value], dates.date_bounds)[0]
    assert (got and (got.start.isoformat(), got.end.isoformat())) == (start and (start, end))


@pytest.mark.parametrize("value,iso,precision,ok", [
    ("2020-02", "2020-02", "month", True), ("2007-11-13/15", "2007-11-13/2007-11-15", "range", True), ("2007-11-13/12-15", "2007-11-13/2007-12-15", "range", True),
    ("2007-11/12", "2007-11/2007-12", "range", True), ("3/4/2020", "2020-03-04", "day", True), ("13/4/2020", "2020-04-13", "day", True),
    ("2001-02-03 04:05", "2001-02-03T04:05", "time", True), ("not a date", "not a date", None, False), (None, None, None, False), ("2020-13-01", "2020-13-01", None, False)])
def test_event_date(values, value, iso, precision, ok):
    got = values([value], dates.event_date)[0]
    assert (got.iso, got.precision, got.ok) == (iso, precision, ok)


@pytest.mark.parametrize("value,want", [
    ("17 - 22 October 2025", ("range", "2025-10-17", "2025-10-22")), ("Seen 2010-01-02, then until 2011-03-04.", ("range", "2010-01-02", "2011-03-04")),
    ("2019", ("single", "2019-01-01", None)), ("2019-02 to 2019-04", ("range", "2019-02-01", "2019-04-30")), ("spring", None), ("", None)])
def test_scope_dates(values, value, want):
    got = values([value], dates.scope_dates)[0]
    assert (tuple(got) if got else None) == want


def test_year_month_day(spark):
    from pyspark.sql import functions as F
    rows = [("2011", None, None), ("2012", "2", ""), ("2013", "6", "30"), ("2013", "2", "30"), ("0", "1", "1"), ("x", "1", "1")]
    df = spark.createDataFrame(rows, "y string, m string, d string").select(
        dates.ymd_bounds(*[text.coerce_int(F.col(c)) for c in "ymd"]).alias("b"))
    got = [r.b and (r.b.start, r.b.end) for r in df.collect()]
    assert got == [(date(2011, 1, 1), date(2011, 12, 31)), (date(2012, 2, 1), date(2012, 2, 29)), (date(2013, 6, 30), date(2013, 6, 30)), None, None, None]


def test_bounds_from_text(values):
    a, b, c = values(["28.55056 S to 44.49629167 N latitude and from 112.71712 W to 70.80929 W longitude", "Lat 10-20; lon 0 to 5", "Norway"],
                     coords.bounds_from_text)
    assert tuple(a) == (-112.71712, -70.80929, 44.49629167, -28.55056)
    assert tuple(b) == (0.0, 5.0, 20.0, 10.0)
    assert c is None


def test_format_coordinate(values):
    got = values(["44.49629167", "-0.0000001", "100", "-28.55056", None], lambda c: coords.format_coordinate(c.cast("double")))
    assert got == ["44.496292", "0", "100", "-28.55056", None]


def test_bounds_from_json(values):
    got = values(['{"west":"10","east":5,"north":1,"south":2}', '[1,2,3,4]', '{"westBoundingCoordinate":1,"eastBoundingCoordinate":2,"northBoundingCoordinate":3,"southBoundingCoordinate":4}',
                  '{"west":200,"east":5,"north":1,"south":2}', "junk"], coords.bounds_from_json)
    assert [g and tuple(g) for g in got] == [(5.0, 10.0, 2.0, 1.0), (1.0, 2.0, 4.0, 3.0), (1.0, 2.0, 4.0, 3.0), None, None]


def test_utm(spark):
    from pyspark.sql import functions as F
    p = spark.range(1).select(coords.utm_to_latlon(F.lit(32), F.lit(True), F.lit(597423.0), F.lit(6643460.0)).alias("p")).first().p
    assert abs(p.lat - 59.91709) < 1e-4 and abs(p.lon - 10.74241) < 1e-4
    q = spark.range(1).select(coords.utm_to_latlon(F.lit(31), F.lit(True), F.lit(500000.0), F.lit(0.0)).alias("p")).first().p
    assert abs(q.lat) < 1e-9 and abs(q.lon - 3) < 1e-9


def test_text(values):
    assert values([" a ", " ", None, "x "], text.clean_text) == ["a", None, None, "x"]
    assert values(["N/A", "Unknown", " ", "Alps", None], text.is_placeholder) == [True, True, True, False, True]
    assert values(["1d", " 3.7 ", "inf", "nan", "-2e2", "1,5", ".5", "-"], text.coerce_float) == [None, 3.7, None, None, -200.0, None, 0.5, None]
    assert values(["3.9", "-3.9", "NaT", "1e3"], text.coerce_int) == [3, -3, None, 1000]
    assert values(["https://doi.org/10.1/x", "doi: 10.2/y ", "doi:", None], text.normalize_doi) == ["10.1/x", "10.2/y", None, None]
    assert values(["basis Of_Record"], text.lookup_key) == ["basisofrecord"]
    assert values(["A. Examples: b Examples: c", "A"], text.strip_examples) == ["A.", "A"]
    assert values(["<p>a &amp; b</p>\n Egs -  c"], text.clean_definition) == ["a & b Examples: c"]
    assert values(["x" * 70, "y" * 71], text.snapshot_value) == ["x" * 70, "y" * 67 + "..."]
    assert values([" Straße", "ABC", " "], text.fold_key) == ["strasse", "abc", None]
    assert values(["NA", "", "x", "None"], text.na_to_null) == [None, None, "x", None]


def test_keywords(values):
    got = values(["Plantae, Fabaceae, Rosales", "A, Birds of the far north, C", "Aves", "x. y", ", ".join("abcdefghijklmnop")], text.keywords_from_scope)
    assert [(k.rank, k.name) for k in got[0]] == [("kingdom", "Plantae"), ("family", "Fabaceae"), ("order", "Rosales")]
    assert [(k.rank, k.name) for k in got[1]] == [("taxon", "A")] and [k.rank for k in got[2]] == ["taxon"]
    assert got[3] == [] and len(got[4]) == 16 and got[4][0].rank == "higherTaxon"
