"""Quality counts and learned thresholds against plain loops."""

import random
import re
from collections import Counter, defaultdict

import pytest

from fieldsheet.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines), n < 10 or 100 * len(covered) > 20 * n


def _top(value):
    shift = max(value.bit_length() - 5, 0)
    return (((value >> shift) + 1) << shift) - 1


def _measures(c):
    return {"word_length": 1000 * c[1] // c[0], "symbols": 1000 * c[2] // c[0], "dup_lines": 1000 * c[3] // c[5]}


def _fences(rows):
    if len(rows) < quality.LEAST_ROWS:
        return None
    out = {}
    for name, (width, _) in quality.MEASURES.items():
        tops = sorted(_top(r[name]) for r in rows)
        q1, q3 = (tops[-(-len(tops) * k // 4) - 1] for k in (1, 3))
        out[name] = (q1 - quality.REACH * max(q3 - q1, width), q3 + quality.REACH * max(q3 - q1, width))
    return out


def _brute(rows):
    counts = [(i, lang, source, _counts(t)) for i, t, lang, source in rows]
    groups = [defaultdict(list) for _ in range(3)]
    for _, lang, source, c in counts:
        if not c[-1]:
            for keys, key in zip(groups, ((lang, source), lang, 0)):
                keys[key].append(_measures(c))
    fences = [{k: _fences(v) for k, v in keys.items()} for keys in groups]
    out = []
    for i, lang, source, c in counts:
        reasons = []
        if not c[-1]:
            limits = fences[0].get((lang, source)) or fences[1].get(lang) or fences[2].get(0)
            for name, value in _measures(c).items() if limits else ():
                low, high = limits[name]
                if value > high or (quality.MEASURES[name][1] and value < low):
                    reasons.append(name)
        out.append((i, *c, reasons, not c[-1] and not reasons))
    return sorted(out, key=repr)


def _rows():
    rng = random.Random(9)
    def prose(n, letters="abcdefgh"):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))

    rows = []
    for i in range(700):
        lang, source = rng.choice([("en", "a"), ("en", "a"), ("en", "b"), ("de", "a"), ("de", None), (None, None), ("fr", "c")])
        text = prose(rng.randint(5, 80))
        if i % 11 == 0:
            text = text.replace(" ", "### ")
        if i % 13 == 0:
            text = "\n".join([prose(12)] * 2 + [prose(3)] * 3)
        if i % 17 == 0:
            text = prose(40, "abcdefgh" * 3 + "é\U0001f600") + "w" * 900
        rows.append((i, text, lang, source))
    rows += [(None, None, "en", "a"), (800, "", None, "a"), (801, " \t\n", "en", "b"), (802, prose(30000), "en", "a"), (803, "a b c d e " * 40, "en", "a"), (803, prose(20), "en", "a"), (803, prose(20), "xx", "yy"), (804, "a a a a a a " + prose(40), "en", "a")]
    return rows + rows[5:9]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [r + (None,) * 8 for r in _rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key string, kept string, h int, w string, t string, n_words string, level int, rows int")


def _result(df):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "reasons", "kept"]
    return sorted((tuple(r) for r in quality.filter_documents(df).select(*names).collect()), key=repr)


def test_equals_brute_force(docs):
    got = _result(docs)
    assert got == _brute(_rows()) and sum(r[-1] for r in got) > 400 and any("symbols" in r[-2] for r in got)


def test_few_rows_and_none(docs):
    assert _result(docs.limit(0)) == []
    few = _rows()[:40]
    assert _result(docs.limit(40)) == _brute(few)  # no group is large enough: nothing but the base rules


def test_sketches_merge(docs):
    rows = quality.measure(docs)
    parts = [quality.sketch(rows.filter(f"pmod(n_words, 3) = {k}")) for k in range(3)]
    assert sorted(map(repr, quality.merge(parts[2], quality.merge(parts[0], parts[1])).collect())) == sorted(map(repr, quality.merge(quality.sketch(rows)).collect()))


def test_buckets(spark):
    values = spark.range(0, 5000).select(quality.bucket_top(quality.bucket(quality.F.col("id"))).alias("top"), "id").collect()
    assert all(r["top"] == _top(r["id"]) and r["id"] <= r["top"] <= r["id"] * 17 // 16 + 1 for r in values)
