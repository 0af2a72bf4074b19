"""Reversible line deduplication: sharded cuckoo filters in front of exact reference counts."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.scratch import fresh_path, materialize
from .common import id_back, id_key, join_unique
from .cuckoo import CuckooFilter

LEAST_SHARDS, SHARD_KEYS = 64, 1 << 18  # at least so many shards; and so many that the first batch brings this many keys to each
LEAST_POINTS = 10
BLANKS = b" \t\n\x0b\x0c\r"
COUNTS = "shard int, key binary, refs long, first_doc long"
POSTINGS = "shard int, key binary, doc long"


def line_key(line: bytes) -> bytes | None:
    """Digest of a line, stripped and with A-Z lower-cased; None if it is shorter than ten code points."""
    text = line.strip(BLANKS).lower()  # bytes.lower() touches A-Z only
    if len(text) < LEAST_POINTS or len(text) < 4 * LEAST_POINTS and len(text.decode()) < LEAST_POINTS:
        return None
    return hashlib.blake2b(text, digest_size=16).digest()


def _postings(batches):
    for batch in batches:
        docs, keys, ids = batch.column(0).to_pylist(), [], []
        for doc, text in zip(docs, batch.column(1)):
            found = {line_key(x) for x in (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")} - {None}
            keys += found
            ids += [doc] * len(found)
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc"])


def postings(docs: DataFrame) -> DataFrame:
    """Distinct (key, doc) of the lines of ``docs`` (doc_id, text)."""
    rows = docs.select(id_key(F.col("doc_id")).alias("doc"), F.encode(F.col("text"), "utf-8").alias("text"))
    return rows.mapInArrow(_postings, "key binary, doc long").distinct()


def _hashes(keys):
    return np.array([int.from_bytes(k[:8], "little") for k in keys], np.uint64)


class LineIndex:
    """Which lines are held by which documents, kept in a folder as numbered generations.

    ``counts`` are exact reference counts (how many documents hold a key, and the smallest of
    them), ``postings`` who holds it, ``filters`` one cuckoo filter per shard over the keys with a
    count. A batch asks the filters first: only keys that they may know are joined with the stored
    counts and postings. Every update writes a new generation, so a lost job leaves the old one whole.
    The first batch fixes the number of shards by its distinct keys, unless it is given; choose
    batches so that a shard's keys of one batch fit into a task.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int | None = None):
        self.spark, self.path, self.shards, self.generation = spark, path or fresh_path(spark, "lines"), shards, 0
        self.asked = None

    def _table(self, name, schema):
        if not self.generation:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self.generation}/{name}")

    @property
    def counts(self) -> DataFrame:
        return self._table("counts", COUNTS)

    @property
    def postings(self) -> DataFrame:
        return self._table("postings", POSTINGS)

    @property
    def filters(self) -> DataFrame:
        return self._table("filters", "shard int, blob binary")

    def _write(self, counts, filters, held):
        for name, df in (("counts", counts), ("filters", filters), ("postings", held)):
            df.write.parquet(f"{self.path}/{self.generation + 1}/{name}")
        self.generation += 1

    def insert(self, docs: DataFrame) -> None:
        """Add documents (doc_id, text); lines that a document is known to hold already are not counted again.

        So a batch may be inserted again after a failure. A document whose text has changed must be
        deleted first. ``asked`` then holds the batch's keys (shard, key, copies) and whether the filter of their
        shard may know them: false is certain, and such keys never meet the stored counts.
        """
        new = materialize(postings(docs), "postings")
        if self.shards is None:
            self.shards = max(LEAST_SHARDS, -(-new.agg(F.approx_count_distinct("key")).first()[0] // SHARD_KEYS))
        new = new.select(F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard"), "key", "doc")
        batch = materialize(new.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc").alias("first_doc")), "batch-counts")

        def ask(key, old, keys):
            held = CuckooFilter.load(old["blob"].iloc[0] if len(old) else None)
            return pd.DataFrame({"shard": keys["shard"], "key": keys["key"], "copies": keys["refs"], "known": held.contains(_hashes(keys["key"]))})

        if self.generation:
            keys = batch.select("shard", "key", "refs")
            self.asked = asked = materialize(self.filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(ask, "shard int, key binary, copies long, known boolean"), "asked")
            known = asked.filter("known").select("key", "copies", "known")
            # only the postings of keys that may be known are compared with those that are held
            marked = materialize(join_unique(new, known, "key", "copies").select("shard", "key", "doc", "known"), "marked")
            maybe = marked.filter("known").select("shard", "key", "doc")
            held = maybe.join(self.postings.select("key", "doc").hint("merge"), ["key", "doc"], "left_semi")
            fresh_again = materialize(maybe.join(held.select("key", "doc").hint("merge"), ["key", "doc"], "left_anti"), "new-postings")
            again = fresh_again.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("r"), F.min("doc").alias("f"))
            sure = asked.filter("not known").select("shard", "key")
            first = batch.join(sure.hint("merge"), ["shard", "key"], "left_semi")
            counts = (self.counts.join(again.hint("merge"), ["shard", "key"], "full")
                      .select("shard", "key", (F.coalesce("refs", F.lit(0)) + F.coalesce("r", F.lit(0))).alias("refs"), F.least("first_doc", "f").alias("first_doc"))
                      .unionByName(first.select("shard", "key", "refs", "first_doc")))
            fresh = sure.unionByName(again.select("shard", "key").join(self.counts.select("shard", "key").hint("merge"), ["shard", "key"], "left_anti"))
            added = marked.filter("known is null").select("shard", "key", "doc").unionByName(fresh_again)
        else:
            counts, fresh, added = batch, batch.select("shard", "key"), new

        def extend(key, old, keys):
            held = CuckooFilter.load(old["blob"].iloc[0]) if len(old) else CuckooFilter(len(keys))
            held.insert(_hashes(keys["key"]))
            return pd.DataFrame({"shard": [key[0]], "blob": [held.dump()]})

        filters = self.filters.groupBy("shard").cogroup(fresh.groupBy("shard")).applyInPandas(extend, "shard int, blob binary")
        self._write(counts, filters, self.postings.unionByName(added))

    def delete(self, doc_ids: DataFrame) -> None:
        """Take the documents of ``doc_ids`` (doc_id) out again, as if they had never been added."""
        gone = doc_ids.select(id_key(F.col("doc_id")).alias("doc")).distinct()
        left = materialize(self.postings.join(gone, "doc", "left_anti").select("shard", "key", "doc"), "postings")
        touched = materialize(self.postings.join(gone, "doc", "left_semi").select("shard", "key").distinct(), "touched")
        again = (left.join(touched, ["shard", "key"], "left_semi").groupBy("shard", "key")
                 .agg(F.count(F.lit(1)).alias("refs"), F.min("doc").alias("first_doc")))
        counts = materialize(self.counts.join(touched, ["shard", "key"], "left_anti").unionByName(again), "counts")
        dead = touched.join(again, ["shard", "key"], "left_anti")

        def shrink(key, old, keys):
            held = CuckooFilter.load(old["blob"].iloc[0] if len(old) else None)
            held.delete(_hashes(keys["key"]))
            return pd.DataFrame({"shard": [key[0]], "blob": [held.dump()]})

        filters = self.filters.groupBy("shard").cogroup(dead.groupBy("shard")).applyInPandas(shrink, "shard int, blob binary")
        self._write(counts, filters, left)

    def lost_lines(self) -> DataFrame:
        """(doc, key) of every line that goes: its key is held by more than one document, and not first by this one."""
        shared = materialize(self.counts.filter("refs > 1").select("key", "refs", "first_doc"), "shared")
        held = join_unique(self.postings.select("key", "doc"), shared, "key", "refs")
        return held.filter("first_doc <> doc").select("doc", "key")

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` (doc_id, text) without the lines that go: doc_id, text, n_lines (before), n_dropped.

        Lines are cut at ``\\n``; a null or empty text is one empty line. A line's key is the line
        without blanks at its ends and with A-Z lower-cased; only keys of ten code points or more
        count. Of a key held by several documents the smallest doc_id keeps all its lines (null is
        below all others), all others lose theirs. Rows that repeat a doc_id are one document. Other
        columns are not read; an empty table gives no rows.
        """
        lost = self.lost_lines().groupBy("doc").agg(F.collect_list("key").alias("lost"))  # at most a document's lines
        rows = docs.select(id_key(F.col("doc_id")).alias("doc"), F.encode(F.col("text"), "utf-8").alias("text")).join(lost, "doc", "left")

        def cut(batches):
            for batch in batches:
                texts, total, dropped = [], [], []
                for text, keys in zip(batch.column(1), batch.column(2)):
                    lines = (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")
                    keys = set(keys.as_py() or ())
                    kept = [x for x in lines if line_key(x) not in keys] if keys else lines
                    texts.append(b"\n".join(kept).decode())
                    total.append(len(lines))
                    dropped.append(len(lines) - len(kept))
                yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())],
                                      names=["doc", "text", "n_lines", "n_dropped"])

        out = rows.select("doc", "text", "lost").mapInArrow(cut, "doc long, text string, n_lines long, n_dropped long")
        return out.select(id_back(F.col("doc")).alias("doc_id"), "text", "n_lines", "n_dropped")
