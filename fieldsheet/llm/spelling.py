"""Spelling variants: words one edit apart, by composing acceptors of parts of the vocabulary with a one-edit transducer."""

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.scratch import materialize
from .common import join_unique

LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, SLIP = 5, 3, 97
GROUP = 4096  # words of one acceptor; larger groups are cut again, so no task holds an unbounded one


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all whole texts (doc_id, text): runs of letters, A-Z lower-cased, with slips of the pen put in.

    Where 97 divides the CRC-32 of ``<doc_id>:<run>`` (a null id is empty), the run loses the code
    point at that number modulo its length. Words have five code points or more and occur three times
    or more. Null and empty texts give nothing; other columns are not read.
    """
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(LETTERS + "{" + str(LEAST_LENGTH) + ",}"), F.lit(0))
    rows = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.encode(F.concat("id", "run"), "utf-8")).alias("h"))
    slipped = F.concat(F.expr("substring(run, 1, int(h % length(run)))"), F.expr("substring(run, int(h % length(run)) + 2)"))
    word = F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run"))
    return rows.select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def acceptor(words: list[str], marks: list[int]) -> tuple[list, int]:
    """The minimal acyclic acceptor of sorted distinct words: its states and the initial one.

    A state is (mark of the word that ends there or 0, arcs by symbol, all marks it can reach).
    States that accept the same remainders with the same marks are one.
    """
    register, states, path, last = {}, [], [[0, {}]], ""

    def close(depth):
        while len(path) > depth:
            mark, arcs = path.pop()
            key = (mark, tuple(arcs.items()))
            state = register.get(key)
            if state is None:
                reach = mark
                for target in arcs.values():
                    reach |= states[target][2]
                state = register[key] = len(states)
                states.append((mark, arcs, reach))
            if path:
                path[-1][1][last[len(path) - 1]] = state
        return state

    for word, mark in zip(words, marks):
        shared, most = 0, min(len(word), len(last))
        while shared < most and word[shared] == last[shared]:
            shared += 1
        if len(path) > shared + 1:
            close(shared + 1)
        path.extend([0, {}] for _ in range(len(word) - shared))
        path[-1][0], last = mark, word
    return states, close(0)


SHORT, LONG = 1, 2


def compose(states: list, initial: int, end_insert: bool):
    """Accepted pairs of acceptor, one-edit transducer and acceptor again: (short word, other word).

    The words marked ``SHORT`` are of one length, those marked ``LONG`` one longer. Yields the pairs
    of short words that differ in one symbol (one of both orders) and the pairs of a short and a long
    word that differ by one inserted symbol, at its last possible place; without ``end_insert`` not
    those whose symbol comes after the whole short word. Before the edit both acceptors are in one
    state, after it in a pair of states, whose common remainders are kept for reuse.
    """
    known = {}

    def common(p, q, of_p, of_q):
        """Words that lead from p to an end marked ``of_p`` and from q to one marked ``of_q``."""
        if not (states[p][2] & of_p and states[q][2] & of_q):
            return ()
        key = (p, q, of_q)
        found = known.get(key)
        if found is not None:
            return found
        run = []
        while True:  # along a chain without choices
            (mark_p, arcs_p, _), (mark_q, arcs_q, _) = states[p], states[q]
            ends = mark_p == of_p and mark_q == of_q
            shared = arcs_p.keys() & arcs_q.keys()
            if ends or len(shared) != 1:
                break
            symbol = shared.pop()
            run.append(symbol)
            p, q = arcs_p[symbol], arcs_q[symbol]
        found = [""] if ends else []
        for symbol in shared:
            found.extend(symbol + rest for rest in common(arcs_p[symbol], arcs_q[symbol], of_p, of_q))
        if run:
            head = "".join(run)
            found = [head + rest for rest in found]
        known[key] = found
        return found

    both = states[initial][2] == SHORT | LONG
    path, stack = [], [(initial, 0, "")]
    while stack:
        state, depth, symbol = stack.pop()
        del path[max(depth - 1, 0):]
        if depth:
            path.append(symbol)
        mark, arcs, _ = states[state]
        items = list(arcs.items())
        head = None
        for i, (a, p) in enumerate(items):
            if states[p][2] & SHORT:
                for b, q in items[i + 1:]:
                    for rest in common(p, q, SHORT, SHORT):
                        head = "".join(path) if head is None else head
                        yield head + a + rest, head + b + rest
            if both:
                for rest in common(state, p, SHORT, LONG):  # a before rest; were it the first of rest, it could come later
                    if rest[:1] != a and (rest or end_insert):
                        head = "".join(path) if head is None else head
                        yield head + rest, head + a + rest
            stack.append((p, depth + 1, a))


def _split(parts: DataFrame) -> DataFrame:
    """Every word with the two halves of what may differ: an edit lies in one of them, the other is shared.

    A part holds words of ``cls`` or ``cls + 1`` symbols, equal but for ``c`` or ``c + 1`` symbols from
    ``start``. ``open``: a symbol may be inserted at the end of what may differ; that case belongs to
    the back half where both halves would have it.
    """
    half = F.expr("(c + 1) div 2")
    back = F.struct((F.col("start") + half).alias("start"), (F.col("c") - half).alias("c"), F.col("open"))
    front = F.struct(F.col("start"), half.alias("c"), F.lit(False).alias("open"))
    rows = parts.select("word", "n", "cls", F.explode(F.array(back, front)).alias("p")).select(
        "word", "n", "cls", F.col("p.start").cast("int").alias("start"), F.col("p.c").cast("int").alias("c"), "p.open")
    shared = F.struct("cls", "start", "c", "open", F.expr("substring(word, 1, start)"), F.expr("substring(word, start + c + length(word) - cls + 1)"))
    return rows.withColumn("group", F.xxhash64(shared))


def _near(pairs: bool):
    """Task function over parts sorted by group; rows of (word, near words, best) or of single pairs."""
    def groups(batches):
        held = None
        for batch in batches:
            table = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            keys = table["group"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            last, ends = starts[-1], np.append(starts[1:], len(keys))
            held = table.slice(last)
            yield table, starts[:-1], ends[:-1]
        if held is not None:
            yield held, np.array([0]), np.array([len(held)])

    def run(batches):
        for table, starts, ends in groups(batches):
            many = ends - starts > 1
            out = {"word": [], "n_near": [], "best_n": [], "best": []}
            if many.any():
                take = np.concatenate([np.arange(a, b) for a, b in zip(starts[many], ends[many])])
                rows = table.take(take)
                words, counts, classes, froms, sizes, opens, keys = (rows[c].to_pylist() for c in ("word", "n", "cls", "start", "c", "open", "group"))
                at = 0
                while at < len(words):
                    to, parts = at, {}
                    while to < len(words) and keys[to] == keys[at]:
                        word, start, extra = words[to], froms[to], len(words[to]) - classes[to]
                        end = start + sizes[to] + extra
                        # words that only share the hash of their group are told apart here
                        parts.setdefault((classes[to], start, sizes[to], opens[to], word[:start], word[end:]), []).append((word[start:end], extra, counts[to], word))
                        to += 1
                    at = to
                    for (_, _, size, end_insert, _, _), part in parts.items():
                        if len(part) > 1:
                            one_part(sorted(part), size, end_insert, out)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    def one_part(part, size, end_insert, out):
        if sys.getrecursionlimit() < 4 * size + 2000:
            sys.setrecursionlimit(4 * size + 2000)
        states, initial = acceptor([p[0] for p in part], [LONG if p[1] else SHORT for p in part])
        near, of = {}, {p[0]: p for p in part}
        for x, y in compose(states, initial, end_insert):
            for me, other in ((of[x], of[y]), (of[y], of[x])):
                if pairs:
                    add(out, me[3], 1, other[2], other[3])
                    continue
                seen = near.get(me[3])
                if seen is None:
                    near[me[3]] = [1, other[2], other[3]]
                else:
                    seen[0] += 1
                    if (-other[2], other[3]) < (-seen[1], seen[2]):
                        seen[1], seen[2] = other[2], other[3]
        for word, found in near.items():
            add(out, word, *found)

    def add(out, *values):
        for column, value in zip(out.values(), values):
            column.append(value)

    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    return run


def _parts(words: DataFrame) -> DataFrame:
    """Words dealt to groups in which each pair of near words meets exactly once as a pair to report."""
    length = F.length("word")
    todo = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("cls")).filter("cls > 0").select(
        "word", "n", "cls", F.lit(0).alias("start"), F.col("cls").alias("c"), F.lit(True).alias("open"))
    done = None
    while True:
        parts = materialize(_split(todo), "parts")
        sizes = parts.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.max("c").alias("most")).filter((F.col("rows") > GROUP) & (F.col("most") > 1))  # one symbol: bounded by the alphabet
        large = materialize(sizes.drop("most"), "large")
        if large.isEmpty():
            return parts if done is None else done.unionByName(parts)
        marked = materialize(join_unique(parts, large, "group", "rows"), "marked")
        small = marked.filter("rows is null").drop("rows")
        done = small if done is None else done.unionByName(small)
        todo = marked.filter("rows is not null").drop("rows", "group")


def near_words(words: DataFrame, pairs: bool = False) -> DataFrame:
    """Near words of every word of ``words`` (distinct word, n): exactly one symbol inserted, deleted or replaced.

    The vocabulary is cut by the state that its acceptor, or that of the reversed words, is in after
    half of a word: a pair of near words shares one of the halves. Each part's minimal acceptor is
    composed with the one-edit transducer and itself, and its accepted pairs are counted in the task.
    Parts of more than ``GROUP`` words are halved again. Returns partial rows (word, n_near, best_n,
    best), at most one a word and part; with ``pairs`` one row a pair and direction.
    """
    parts = _parts(words.select("word", F.col("n").cast("long").alias("n")))
    dealt = parts.repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(_near(pairs), "word string, n_near long, best_n long, best string")


def group_variants(words: DataFrame) -> DataFrame:
    """Of each word of ``words`` (distinct word, n): its form, root, near words (n_near) and the form's n.

    A word's form is its near word with the largest n (ties: smallest by code points), if that is
    at least twice the word's own. The root is reached by following forms to the last; chains are
    halved in every round, so rounds grow with the logarithm of the longest chain. Words without a
    form are their own root. An empty vocabulary gives no rows.
    """
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    found = near_words(words).select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")).alias("best"))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<m:bigint,w:string>").alias("best"))
    rows = found.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    has_form = -F.col("best.m") >= 2 * F.col("n")
    rows = materialize(rows.select("word", "n", "n_near", F.when(has_form, F.col("best.w")).alias("form"), F.when(has_form, -F.col("best.m")).alias("form_n")), "forms")
    links = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        links = materialize(links.join(onward.hint("merge"), F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.filter("moved").isEmpty():
            break
        links = links.drop("moved")
    joined = rows.join(links.select("word", "root").hint("merge"), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
