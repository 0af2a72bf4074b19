"""Names alike to 50 % and more, against Levenshtein over all pairs, and the number of pairs that are compared."""

import random

import pytest
from pyspark.sql import functions as F

from fieldsheet.operators import names


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(8)
    syllables = ["ab", "ies", "al", "ba", "qu", "er", "cus", "ro", "bur", "pi", "nus", "syl", "ves", "tris", "la", "rix"]
    known = sorted({"".join(rng.choice(syllables) for _ in range(rng.randint(2, 6))).capitalize() for _ in range(150)} | {"Abies", "X", "Yz"})
    found = set()
    for name in known:
        letters = list(name)
        for _ in range(rng.randint(0, max(1, int(len(name) * 0.7)))):
            at = rng.randrange(len(letters) + 1)
            if rng.random() < 0.5 and letters:
                letters[at % len(letters)] = rng.choice("abcxyz")
            elif rng.random() < 0.5:
                letters.insert(at, rng.choice("abcxyz"))
            elif len(letters) > 1:
                del letters[at % len(letters)]
        found.add("".join(letters))
    return sorted(found | {"Abeis", "", "Zzzzzzzzzz"}), known


def _best(name, known, least):
    if name in known:
        return name, "EXACT", name, 100
    scored = [(100 * (max(len(name), len(k)) - _edits(name.lower(), k.lower())) // max(len(name), len(k)), k) for k in known]
    top = min(((-c, k) for c, k in scored if c >= least), default=None)
    return (name, "NONE", None, 0) if top is None else (name, "FUZZY", top[1], -top[0])


@pytest.mark.parametrize("least", [50, 57, 70, 80])
def test_equals_all_pairs(spark, lists, least):
    given, known = lists
    df = spark.createDataFrame([(n,) for n in given], "scientificName string")
    got = names.match_names(df, spark.createDataFrame([(n,) for n in known], "scientificName string"), least=least)
    want = [_best(n, known, least) for n in given]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert least > 60 or any(w[0] == "Abeis" and w[1] == "FUZZY" and w[3] == 60 for w in want)


def test_moderate_names_are_not_unmatched(spark):
    df = spark.createDataFrame([(1, 1, "Abeis"), (1, 1, "Qqqqqq")], "dataset_id long, table_id long, scientificName string")
    matches = names.match_names(df, spark.createDataFrame([("Abies",)], "scientificName string"), least=50)
    assert [(r["kind"], r["n"], r["message"]) for r in names.correction_messages(names.names_to_check(df), matches).collect()] == [("unmatched", 1, "'Qqqqqq'")]


def test_few_pairs_are_compared(spark):
    """Of 1500 x 1500 pairs, those compared for a match of 80 % are a few per name."""
    rng = random.Random(1)
    known = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(8, 24))) for _ in range(1500)]
    given = [k[:3] + "x" + k[4:] + "s" for k in known]
    pairs = names._candidates(spark.createDataFrame([(n,) for n in given], "name string"), spark.createDataFrame([(n,) for n in known], "matched_name string"), 80)
    per_name = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n"), F.max("n")).first()
    assert per_name[0] < 15 and per_name[1] < 60
