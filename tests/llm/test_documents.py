"""Operators on documents against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldsheet.llm import exact, jaccard, language, lines, packing, secrets, sharding, suffix
from fieldsheet.llm.hilbert import hilbert_index

PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew strong coffee in the old stone mill near the river"
WORDS = PASSAGE.split()


def _prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(n))


def _rows():
    base = _prose(1, 300)
    near = base.split()
    near[17] = "changed"
    twice = _prose(2, 60)
    return [
        (1, base), (2, " ".join(near)), (3, base), (4, base.upper()), (5, None), (6, ""), (7, "  \n\t"), (8, "one"), (9, "ONE"), (10, "one two"),
        (11, PASSAGE + "\n" + _prose(3, 40)), (12, _prose(4, 50) + "\n" + PASSAGE + "\n" + PASSAGE), (13, "x" * 5000), (14, "ab" * 700), (15, "x" * 101),
        (16, twice + "\n" + twice), (17, _prose(5, 20000)), (None, PASSAGE), (None, "nobody"), (20, "password = 'abcdefghijkl' é AKIA" + "Z" * 14 + " " + "0123456789abcdef0"),
        (21, "token = secret: \"abcdefghijklmnop\" 0123456789abcde"), (22, "é😀 API_KEY=" + "k" * 12 + "\nAKIAAKIA" + "9" * 12), (3, base), (24, "é" * 120 + "é" * 30),
        (25, "é" * 120 + "ü" * 30), (26, "Line of some length\r\nline of some length \n short\n\nLINE OF SOME LENGTH"), (27, "\tline of some length\x0b\nother line here"),
        (28, "other line here"), (29, "x" * 5000 + "y"), (30, "aaaaaaaaaaaaaaaa token:aaaaaaaaaaaa")]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The rows with columns whose names the operators use themselves."""
    clash = "key string, n int, digest string, kept string, row int, rank int, cluster long, blob string, path string, doc long, refs int, spans string, score string"
    return spark.createDataFrame([(i, t, "en", "s", 1, *[None] * 13) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + clash)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def _all(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact(spark, docs, rows, none):
    got = _all(exact.deduplicate(docs, exact.create_index(spark, buckets=4), 4).drop("batch_row"))
    want, groups = [], defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        stayed = False
        for i in ids:
            want.append((i, keep, len(ids), i == keep and not stayed, sha))
            stayed |= i == keep
    assert sorted(want, key=repr) == got
    assert _all(exact.deduplicate(none, exact.create_index(spark, buckets=2), 2)) == []


def test_exact_index_is_kept(spark):
    index = exact.create_index(spark, buckets=2)
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "a"), (4, "c"), (5, "c")], "doc_id long, text string")
    exact.deduplicate(first, index, 2)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact.deduplicate(second, index, 2).collect()}
    assert got == {3: (1, False), 4: (5, False), 5: (5, True)}
    assert spark.table(index).count() == 3
    described = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {index}").collect()}
    assert described["Bucket Columns"] == "[`digest`]" and described["Sort Columns"] == "[`digest`]"


def _sets(rows, words):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def _components(rows, words, percent):
    sets, n = _sets(rows, words), len(rows)
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    links = Counter()
    for a in range(n):
        for b in range(a):
            if rows[a][0] == rows[b][0]:
                up[find(a)] = find(b)
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    least = {}
    for k in range(n):
        key = -1 << 63 if rows[k][0] is None else rows[k][0]
        least[find(k)] = min(least.get(find(k), key), key)
    return sorted(((rows[k][0], len(sets[k]), None if least[find(k)] == -1 << 63 else least[find(k)], links[k]) for k in range(n)), key=repr)


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_jaccard(docs, rows, none, words, percent):
    assert _all(jaccard.jaccard_components(docs, jaccard.Threshold(words, percent))) == _components(rows, words, percent)
    assert _all(jaccard.jaccard_components(none, jaccard.Threshold(words, percent))) == []


def _family(count, length, edits, seed):
    """A template and copies of it with some words changed: many pairs lie near the threshold."""
    rng = np.random.default_rng(seed)
    base = _prose(seed, length).split()
    out = [" ".join(base)]
    for k in range(count):
        w = list(base)
        for at in rng.integers(0, length, rng.integers(0, edits + 1)):
            w[at] = f"w{rng.integers(1 << 30)}"
        out.append(" ".join(w[: length - rng.integers(0, 12)]))
    return out


@pytest.mark.parametrize("words, percent, edits", [(3, 90, 4), (5, 80, 5), (1, 50, 40)])
def test_jaccard_families(spark, monkeypatch, words, percent, edits):
    monkeypatch.setattr(jaccard, "TILE_SETS", 16)  # several tiles a cluster
    texts = [t for f in range(4) for t in _family(40, 60 + 40 * f, edits, 10 + f)] + [_prose(s, 1 + s % 9) for s in range(60)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _all(jaccard.jaccard_components(df, jaccard.Threshold(words, percent))) == _components(rows, words, percent)


def test_signatures_of_linked_sets_meet():
    rng, rule = np.random.default_rng(3), jaccard.Threshold(3, 80)
    bands = rule.bands(4000)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        gone = int(rng.integers(0, n // 9 + 1))
        y = np.r_[x[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 9 + 1)), dtype=np.uint64)]
        x, y = np.unique(x), np.unique(y)
        common = len(np.intersect1d(x, y))
        if rule.links(len(x), len(y), common):
            found = [dict(zip(*(v.tolist() for v in jaccard.signatures(s, rule, bands)))) for s in (x, y)]
            both = found[0].keys() & found[1].keys()
            # of the larger set's own band: as many shared as either counts on
            assert any(all(sum(f[k] == f[g] for g in both) >= f[k] // 2 for f in found) for k in both)


def _without_repeats(rows, length=100):
    """Rows that share an id are one document: of equal starts none comes first."""
    first = {}
    key = [-1 << 63 if i is None else i for i, _ in rows]
    for (_, t), k in zip(rows, key):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, (k, p)), (k, p))
    out = []
    for (i, t), k in zip(rows, key):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < (k, p):
                gone[p:p + length] = 1
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _digest4(df):
    return _all(df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)))


def test_suffix(docs, rows, none):
    assert _digest4(suffix.remove_repeats(docs)) == _without_repeats(rows)
    assert _digest4(suffix.remove_repeats(none)) == []


def test_suffix_of_many_distinct_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "MOST_BLOCKS", 5)  # keys with more leave the suffix order
    passage = _prose(8, 40)
    rows = [(k, _prose(100 + k, 12) + " " + passage[k % 7:] + " " + _prose(200 + k // 2, 12)) for k in range(40)]
    rows += [(100, "z" * 700), (101, "z" * 260), (102, "zy" * 200), (103, ("z" * 130 + "q") * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _digest4(suffix.remove_repeats(df)) == _without_repeats(rows)


def test_longest_previous_factor():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    at = np.arange(300)
    order, shared = suffix.suffix_order(text, at, 100)
    got = np.empty(300, int)
    got[order] = suffix.longest_previous(at[order], shared)
    raw = text.tobytes()
    for p in range(300):
        best = 0
        for q in range(p):
            n = 0
            while n < 100 and raw[p + n] == raw[q + n]:
                n += 1
            best = max(best, n)
        assert got[p] == best


BLANK = " \t\n\x0b\x0c\r"


def _lines(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    ids = [-1 << 63 if i is None else i for i, _ in rows]
    held = defaultdict(set)
    for i, (_, t) in zip(ids, rows):
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    out = []
    for i, (d, t) in zip(ids, rows):
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == i]
        out.append((d, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=repr)


def test_lines(spark, docs, rows, none):
    index = lines.LineIndex(spark, shards=3)
    index.insert(docs)
    assert _all(index.apply(docs)) == _lines(rows)
    empty = lines.LineIndex(spark, shards=2)
    empty.insert(none)
    assert _all(empty.apply(none)) == []


def test_lines_are_reversible(spark):
    first = [(k, f"line number {k % 5} of it\nonly in {k:10d}") for k in range(1, 30)]
    second = [(k, f"line number {k % 7} of it\nanother common line") for k in range(0, 60, 3) if k not in dict(first)]
    third = [(k, f"line number {k} of it\nanother common line") for k in range(100, 130)]
    df = {n: spark.createDataFrame(r, "doc_id long, text string") for n, r in (("1", first), ("2", second), ("3", third))}
    index = lines.LineIndex(spark, shards=2)
    index.insert(df["1"])
    before = _all(index.counts.select("key", "refs", "first_doc"))
    index.insert(df["2"])
    index.insert(df["3"])
    index.delete(df["1"].filter("doc_id <= 20").select("doc_id"))
    left = [r for r in first if r[0] > 20] + second + third
    whole = spark.createDataFrame(left, "doc_id long, text string")
    assert _all(index.apply(whole)) == _lines(left)
    index.delete(df["2"].select("doc_id"))
    index.delete(df["3"].select("doc_id"))
    index.insert(df["1"].filter("doc_id <= 20"))
    assert _all(index.counts.select("key", "refs", "first_doc")) == before
    keys = {s: [] for s in range(2)}
    for r in index.counts.collect():
        keys[r["shard"]].append(r["key"])
    for r in index.filters.collect():
        held = lines.CuckooFilter.load(r["blob"])
        assert held.contains(lines._hashes(keys[r["shard"]])).all()
        assert sum(t.held for t in held.tables) == len(keys[r["shard"]])


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 20000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    held = lines.CuckooFilter()
    for part in np.array_split(keys, 7):
        held.insert(part)
    held = lines.CuckooFilter.load(held.dump())
    assert held.contains(keys).all()
    others = rng.integers(0, 1 << 62, 20000, dtype=np.uint64)
    assert held.contains(others).mean() < 0.01
    held.delete(keys[:15000])
    assert held.contains(keys[15000:]).all()
    assert held.contains(keys[:15000]).mean() < 0.01
    with pytest.raises(ValueError):
        held.delete(others[~held.contains(others)][:1])


def test_language(spark, docs, none):
    english = [(k, "the house and the river were there with the people of this town", "en") for k in range(4)]
    german = [(k, "das haus und der fluss waren dort mit den leuten dieser stadt", "de") for k in range(4)]
    profiles = language.learn(spark.createDataFrame(english + german + [(9, None, "fr"), (9, "123", "xx"), (9, "text", None)], "doc_id long, text string, lang string"))
    assert profiles.names == ("de", "en")
    found = language.identify(docs.withColumn("lang_pred", F.lit("old")), profiles)
    assert found.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in found.collect())
    assert all(0 <= r["score"] <= 1 for r in found.collect())
    got = language.identify(spark.createDataFrame([("The river and the people",), ("Der Fluss und die Leute",), (None,), ("42 !",)], "text string"), profiles)
    assert [r["lang_pred"] for r in got.collect()] == ["en", "de", "und", "und"]
    assert _all(language.identify(none, profiles)) == []
    untaught = language.learn(none)
    assert [r["lang_pred"] for r in language.identify(docs.limit(1), untaught).collect()] == ["und"]


def test_language_vectors_are_bound_and_bundled():
    keys, counts = language.grams("Éa, bb bb")
    assert counts.sum() == len(" éa bb bb ") - 2
    a, b = (language.letter_vector(ord(c)) for c in "éa")
    edge = language.letter_vector(0)
    k = list(keys).index(ord("é") << 21 | ord("a"))
    assert (language.gram_vectors(keys)[k] == np.roll(edge, 2) * np.roll(a, 1) * b).all()
    one = language.Profiles(("x",), language.bundle(keys, counts)[None] / np.linalg.norm(language.bundle(keys, counts)))
    assert one.predict(["éA bb bb", ""])[0] == ("x", pytest.approx(1.0)) and one.predict([""]) == [("und", 0.0)]


def test_language_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taught = df.filter(~language.held_out(F.col("doc_id")))
    rest = language.identify(df.filter(language.held_out(F.col("doc_id"))), language.learn(taught))
    right = rest.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert [r[0] for r in df.limit(20).select(language.held_out(F.col("doc_id"))).collect()] == [
        zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in df.limit(20).select("doc_id").collect()]


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        at = hilbert_index(grid, bits)
        assert sorted(at) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_shards(docs, none):
    for n in (1, 3, 8, 50):
        got = sharding.shard(docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")))), n).collect()
        sizes = Counter(r["shard"] for r in got)
        assert len(got) == docs.count() and max(sizes.values()) - min(sizes.get(s, 0) for s in range(n)) <= 1
        for s in sizes:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert _all(sharding.shard(none, 8, ties=["doc_id"])) == []


def test_shards_prune(spark):
    rows = [(k, f"s{k * 7 % 10}", k * 37 % 1000) for k in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, source string, n_chars long"), 16, ["source", "n_chars"], ["doc_id"])
    spans = got.groupBy("shard").agg((F.max("n_chars") - F.min("n_chars")).alias("w"), F.countDistinct("source").alias("s")).collect()
    assert sum(r["w"] for r in spans) / 16 < 600 and sum(r["s"] for r in spans) / 16 < 6


def test_shards_prune_on_strings_that_start_alike(spark):
    rows = [(k, f"https://example.org/{k * 7 % 10}" if k % 50 else None, k * 37 % 1000) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long")
    for table in (df, df.withColumn("source", F.encode("source", "utf-8"))):
        got = sharding.shard(table, 16, ["source", "n_chars"], ["doc_id"])
        spans = got.groupBy("shard").agg((F.max("n_chars") - F.min("n_chars")).alias("w"), F.countDistinct("source").alias("s")).collect()
        assert sum(r["w"] for r in spans) / 16 < 600 and sum(r["s"] for r in spans) / 16 < 6
        cells = [r["n"] for r in sharding.curve_keys(table, ["source"]).groupBy("source").agg(F.countDistinct("_curve").alias("n")).collect()]
        assert cells == [1] * 11 and sharding.curve_keys(table, ["source"]).select("_curve").distinct().count() == 11


def test_packing(docs, none):
    got = packing.pack(docs, packing.word_count(F.col("text")), (16, 64, 256), 4, 8).collect()
    words = Counter()
    for r in docs.select("doc_id", packing.word_count(F.col("text")).alias("n")).collect():
        words[r["doc_id"]] += r["n"]
    placed, bins = Counter(), defaultdict(list)
    for r in got:
        placed[r["doc_id"]] += r["length"]
        if r["length"]:
            bins[r["bin"]].append(r)
        else:
            assert r["bin"] is None
    assert placed == words
    for held in bins.values():
        held.sort(key=lambda r: r["bin_start"])
        ends = [0] + [r["bin_start"] + r["length"] for r in held]
        assert [r["bin_start"] for r in held] == ends[:-1]  # no gaps, no overlap
        assert held[0]["bin_size"] == min(s for s in (16, 64, 256) if s >= ends[-1])
    assert _all(packing.pack(none, packing.word_count(F.col("text")))) == []


def test_best_fit_is_near_the_best(spark):
    def cheapest(lengths, sizes, overhead):
        best = [float("inf")]

        def place(k, bins):
            if k == len(lengths):
                best[0] = min(best[0], sum(min(s for s in sizes if s >= b) + overhead for b in bins))
                return
            for i, b in enumerate(bins):
                if b + lengths[k] <= sizes[-1]:
                    place(k + 1, bins[:i] + [b + lengths[k]] + bins[i + 1:])
            place(k + 1, bins + [lengths[k]])
        place(0, [])
        return best[0]
    rng, spent, least = np.random.default_rng(6), 0, 0
    for _ in range(40):
        lengths = rng.integers(1, 17, 7)
        _, _, final = packing.best_fit(lengths, (4, 8, 16), 1)
        spent += int(final.sum()) + len(final)
        least += cheapest(lengths.tolist(), (4, 8, 16), 1)
    assert least <= spent <= 1.1 * least


def _spans(text):
    text, out = text or "", []
    patterns = [(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("AKIA[A-Z0-9]+", 0, 18), ("[0-9a-f]+", 0, 16)]
    for k, (p, g, n) in enumerate(patterns):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text, re.ASCII) if len(m.group(g)) >= n]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secrets(spark, docs, rows, none):
    got = secrets.report(secrets.scan(docs, "doc_id", secrets.new_ledger(spark)))
    assert sorted(((r["path"], r["spans"]) for r in got.collect()), key=repr) == sorted(((i, _spans(t)) for i, t in rows), key=repr)
    for r in got.collect():
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [r["spans"].count(k + ":") for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()
    assert _all(secrets.scan(none, "doc_id", secrets.new_ledger(spark))) == []


def test_secrets_are_scanned_once(spark):
    ledger = secrets.new_ledger(spark)
    key = "0123456789abcdef"
    first = spark.createDataFrame([("a", key), ("b", "none"), ("a", "older " + key)], "path string, text string")
    assert len(secrets.scan(first, "path", ledger).collect()) == 3
    second = spark.createDataFrame([("c", key), ("d", "new " + key)], "path string, text string")
    got = {r["path"]: r["spans"][0]["start"] for r in secrets.scan(second, "path", ledger).collect()}
    assert got == {"c": 0, "d": 4}
    held = spark.read.schema(secrets.LEDGER).parquet(ledger)
    assert held.count() == 4 == held.select("blob").distinct().count()
    assert secrets.scan(first, "path", ledger, secrets.RULES[:1], "other").filter(F.size("spans") > 0).count() == 0
    assert held.sparkSession.read.schema(secrets.LEDGER).parquet(ledger).filter("rule_version = 'other'").count() == 3


def test_pipeline_stages(spark, docs, rows, none):
    taught = docs.withColumn("score", F.lit("x"))
    table, ids = taught, {}
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, None)
        table = spark.createDataFrame(table.collect(), table.schema)
        ids[name] = Counter(r["doc_id"] for r in table.collect())
        if name != "packing":
            assert table.schema == taught.schema
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    assert ids["language"] == Counter(i for i, t in rows if re.search(r"[^\W\d_]", t or "") and i in ids["language"])
    assert set(ids["exact_dedup"]) == set(ids["language"]) - {1} and ids["exact_dedup"][3] == 1
    kept = [(i, t) for i, t in rows if i in ids["exact_dedup"]]
    want = {i for i, _, c, _ in _components(kept, 5, 80) if i == c}
    assert set(ids["near_dedup"]) == want
    assert set(ids["secrets"]) == {i for i in want if not any(_spans(t) for t in texts[i])}
    assert set(ids["packing"]) == set(ids["secrets"])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, None).collect() == []


def test_pipeline_keeps_every_text_with_a_letter(spark):
    """Ids expected from the texts alone, short and odd ones among them."""
    short = [(-1, "Avec."), (-2, "A."), (-3, "Edrere."), (-4, "漢字"), (-5, "Lllldoado."), (-6, "é"), (-7, "42 !"), (-8, ""), (-9, None)]
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    table = held.unionByName(spark.createDataFrame([(i, t, None) for i, t in short], "doc_id long, text string, lang string"))
    want = sorted(r["doc_id"] for r in table.collect() if any(c.isalpha() for c in r["text"] or ""))
    assert {-1, -2, -3, -4, -5, -6} <= set(want) and not {-7, -8, -9} & set(want)
    assert sorted(r["doc_id"] for r in corpus_pipeline.known_language(spark, table, None).select("doc_id").collect()) == want
    assert corpus_pipeline.known_language(spark, table.withColumn("lang", F.lit(None).cast("string")), None).count() == 0


def test_near_copies_are_judged_by_row(spark):
    x, y, z = _prose(50, 80), _prose(51, 80), _prose(52, 80)
    rows = [(1, y), (2, x), (2, y + " more"), (3, z), (3, z + " more"), (None, _prose(53, 80)), (None, _prose(54, 80)), (None, _prose(53, 80) + " more"), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_copies(spark, df, None).collect()]
    first = {t: min((p for p in rows if p[0] == i and p[1] and p[1].startswith(t)), key=lambda p: hashlib.sha256(p[1].encode()).digest())
             for i, t in ((3, z), (None, _prose(53, 80)))}
    assert sorted(got, key=repr) == sorted([(1, y), (2, x), (None, _prose(54, 80)), (4, ""), (5, None), *first.values()], key=repr)
