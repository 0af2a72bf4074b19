"""Spelling variants against plain loops over the whole vocabulary."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldsheet.llm import spelling
from fieldsheet.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def _vocabulary(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 97 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= 5:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def _variants(words, near):
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out)


def _all_pairs(words):
    return {w: {x for x in words if _one_edit(w, x)} for w in words}


def _by_holes(words):
    """The same near words by the words with one symbol left out, for larger vocabularies."""
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1:]].add(w)
            rest = w[:i] + w[i + 1:]
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    return near


def _rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    words = _vocabulary(docs)
    assert len(words) > 500 and _rows(QUERIES["op12_spelling_variants"](spark, SMALL)) == _variants(words, _by_holes(words))


@pytest.mark.parametrize("group", [4096, 4])
def test_all_pairs(spark, monkeypatch, group):
    """Few letters, repeated letters, one shared beginning and end: every pair, whatever the size of a part."""
    monkeypatch.setattr(spelling, "GROUP", group)
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(300)}
    words |= {"same" + "".join(rng.choice("ab") for _ in range(5)) + "tail" for _ in range(30)} | {"a" * n for n in range(1, 30)} | {"x" * 3000 + c for c in ("", "y", "z", "yz")}
    words = {w: rng.randint(3, 60) for w in sorted(words)}
    df = spark.createDataFrame(list(words.items()), "word string, n int")
    assert _rows(spelling.group_variants(df)) == _variants(words, _all_pairs(words))
    pairs = sorted((r["word"], r["best"]) for r in spelling.near_words(df, pairs=True).collect())
    assert pairs == sorted((w, x) for w, near in _all_pairs(words).items() for x in near)


def test_odd_rows(spark):
    texts = [(1, "Hello hello HELLO hellu hellu hellu"), (None, "hello hallo hallo hallo"), (2, None), (3, ""), (1, "Hello hello HELLO hellu hellu hellu"), (4, "ab cde ×÷×÷× ×÷×÷× ×÷×÷×"), (5, "hello " * 3000)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], "doc_id long, text string, word string, n int, id string")
    words = _vocabulary(texts)
    assert _rows(spelling.group_variants(spelling.vocabulary(df))) == _variants(words, _all_pairs(words))
    assert _rows(spelling.group_variants(spelling.vocabulary(df.limit(0)))) == []


def test_acceptor_is_minimal():
    states, initial = spelling.acceptor(["cars", "cats", "tars", "tats"], [spelling.SHORT] * 4)
    assert len(states) == 5 and list(states[initial][1]) == ["c", "t"] and len(set(states[initial][1].values())) == 1


def test_a_long_chain_of_forms(spark):
    words = [("aaaaa" + "b" * i, 3 << i) for i in range(20)]
    got = spelling.group_variants(spark.createDataFrame(words, "word string, n int"))
    assert got.filter(F.col("root") != words[-1][0]).count() == 0
