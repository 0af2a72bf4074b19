"""Batches of lines: the filters are asked, miss nothing, and a repeated batch changes nothing."""

from fieldsheet.llm import lines
from fieldsheet.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _docs(spark, ids):
    return spark.createDataFrame([(k, f"shared line number {k % 40:05d}\nonly in document {k:07d}\nshort") for k in ids], "doc_id long, text string")


def test_filters_send_on_what_is_held_and_little_else(spark):
    index = lines.LineIndex(spark)
    index.insert(_docs(spark, range(0, 2000)))
    assert index.asked is None and index.shards == lines.LEAST_SHARDS
    held = {r["key"] for r in index.counts.select("key").collect()}
    index.insert(_docs(spark, range(2000, 4000)))
    asked = {r["key"]: r["known"] for r in index.asked.collect()}
    assert len(asked) == 2040 and sum(k in held for k in asked) == 40
    assert all(known for k, known in asked.items() if k in held)
    assert sum(known for known in asked.values()) < 60  # 40 and a few that share a fingerprint


def test_a_batch_inserted_again_changes_nothing(spark):
    index = lines.LineIndex(spark, shards=3)
    index.insert(_docs(spark, range(0, 50)))
    index.insert(_docs(spark, range(40, 90)))  # ten documents again, forty new ones
    once = _rows(index.counts), _rows(index.postings)
    index.insert(_docs(spark, range(0, 90)))
    assert (_rows(index.counts), _rows(index.postings)) == once
    whole = lines.LineIndex(spark, shards=3)
    whole.insert(_docs(spark, range(0, 90)))
    assert once == (_rows(whole.counts), _rows(whole.postings))
    sizes = {r["shard"]: sum(t.held for t in lines.CuckooFilter.load(r["blob"]).tables) for r in index.filters.collect()}
    assert sum(sizes.values()) == len(once[0])


def test_shards_follow_the_keys(spark, monkeypatch):
    monkeypatch.setattr(lines, "LEAST_SHARDS", 2)
    monkeypatch.setattr(lines, "SHARD_KEYS", 100)
    index = lines.LineIndex(spark)
    index.insert(_docs(spark, range(1000)))
    assert 9 <= index.shards <= 12


def test_the_query_asks_its_filters(spark, monkeypatch):
    asked = []
    insert = lines.LineIndex.insert

    def watched(self, docs):
        insert(self, docs)
        asked.append(self.asked)

    monkeypatch.setattr(lines.LineIndex, "insert", watched)
    QUERIES["op5_line_dedup"](spark, SMALL)
    assert asked[0] is None and all(a.filter("known").count() > 0 for a in asked[1:]) and len(asked) > 1
