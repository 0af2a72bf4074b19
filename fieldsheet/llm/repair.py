"""Repair of conversation structure: cheapest edits, and of these the audit that is least in its letters."""

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.scratch import materialize
from .common import digest as text_digest, join_unique, ranked

BLOCK = 4096  # rows of a conversation that one task solves at a time
NODES = 1 << 18
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5  # costs; keeping a row is free
FAR = 1 << 60
VISIBLE = r"[^\x20\x09-\x0D]"
# A row's code: its initial (o: any other), by class.
SOUND, CUT, GONE = "suao", "SUAO", "1234"
END, PAD = ord("$"), 0
LEGAL = ("su", "ua", "au")
# States: nothing yet, after s, after u, after a. What an inserted or re-roled row leads to, in each.
TURN = np.array([2, 2, 3, 2])


def damage(rows: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, text) with faults put in by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user. Null roles
    and texts, and null ids and turns in that key, count as one space. Other columns are left out.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(F.encode(key, "utf-8")) % 20).alias("h"))
    h = F.col("h")
    copies = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    text = F.when(h == 1, "").when(h == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies))).drop("col")


class Repair(NamedTuple):
    """``report``: a row per conversation; ``edits``: a row per edit, in order of (block, at)."""
    report: DataFrame
    edits: DataFrame


def _tables():
    """Per code: where keeping leads from each state (-1: not allowed), and the costs of keeping, re-roling and deleting."""
    after = {"s": [1, -1, -1, -1], "u": [2, 2, -1, 2], "a": [-1, -1, 3, -1], "o": [-1] * 4}
    keep = np.full((128, 4), -1)
    kept, reroled, deleted = (np.full(128, FAR) for _ in range(3))
    for sound, cut, gone in zip(SOUND, CUT, GONE):
        for code, more in ((sound, 0), (cut, TRUNCATED)):
            keep[ord(code)], kept[ord(code)], reroled[ord(code)] = after[sound], more, REROLE + more
        deleted[[ord(sound), ord(cut), ord(gone)]] = DELETE
    return keep, kept, reroled, deleted


def _ahead(cost, step):
    return np.minimum(cost + step, FAR)


def cost_to_go(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least cost from every (place, lane, state) to behind the last code, where ``ends`` (lane, state) is still to pay."""
    keep, kept, reroled, deleted = _tables()
    places, lanes = codes.shape
    costs = np.empty((places + 1, lanes, 4), np.int64)
    costs[places] = ends
    for t in range(places - 1, -1, -1):
        code, nxt = codes[t], costs[t + 1]
        here = _ahead(nxt, deleted[code][:, None])
        to = keep[code]
        here = np.minimum(here, np.where(to >= 0, _ahead(np.take_along_axis(nxt, np.maximum(to, 0), 1), kept[code][:, None]), FAR))
        here = np.minimum(here, _ahead(nxt[:, TURN], reroled[code][:, None]))
        end = code == END
        here[end] = FAR
        here[np.ix_(end, [0, 3])] = nxt[end, :1]
        u, a = here[:, 2].copy(), here[:, 3].copy()  # inserts stay at this place
        here[:, 2] = np.minimum(u, _ahead(a, INSERT))
        here[:, 3] = np.minimum(a, _ahead(u, INSERT))
        here[:, :2] = np.minimum(here[:, :2], _ahead(here[:, 2:3], INSERT))
        pad = code == PAD
        here[pad] = nxt[pad]
        costs[t] = here
    return costs


def least_paths(codes: np.ndarray, costs: np.ndarray):
    """Pointers of doubled length along the least path from every node, and the initial of each node's edit.

    A node is a (place, lane, state). Its arcs that keep the least cost are optimal; arcs that leave
    a node have different initials. Nodes are ranked by the first 1, 2, 4, ... initials of
    their audits: the rank for twice the length is that of the pair (own rank, rank of the node
    where the first half ends). In the end every node takes the optimal arc whose initial and
    target's rank are least, and pointers are doubled along these arcs.
    """
    keep, kept, reroled, deleted = _tables()
    places, lanes = codes.shape
    layer = lanes * 4
    n = (places + 1) * layer
    code = np.broadcast_to(codes[:, :, None], (places, lanes, 4))
    state = np.broadcast_to(np.arange(4), code.shape)
    base = np.arange(places * layer).reshape(code.shape) - state
    flat, here = costs.reshape(-1), costs[:places]
    to = keep[code, state]
    arcs = [  # initial, target, cost, allowed; in order of the initials
        (0, base + layer + np.where(code == END, 0, state), 0, (code == PAD) | ((code == END) & np.isin(state, [0, 3]))),
        (ord("D"), base + layer + state, deleted[code], deleted[code] < FAR),
        (ord("I"), base + TURN[state], INSERT, code != PAD),
        (ord("K"), base + layer + np.maximum(to, 0), kept[code], to >= 0),
        (ord("R"), base + layer + TURN[state], reroled[code], reroled[code] < FAR)]

    def choose(rank):
        letter, pointer = np.zeros(n, np.int64), np.arange(n)
        best = np.full(code.shape, n * 256 + 255)
        for initial, target, cost, allowed in arcs:
            optimal = allowed & (here < FAR) & (flat[target] + cost == here)
            key = initial * n + rank[target]
            better = optimal & (key < best)
            best[better] = key[better]
            letter[:places * layer][better.ravel()] = initial
            pointer[:places * layer][better.ravel()] = target[better]
        return letter, pointer

    rounds = int(np.ceil(np.log2(2 * places + 4))) + 1

    def doubled(pointer):
        out = [pointer]
        for _ in range(rounds):
            out.append(out[-1][out[-1]])
        return out

    letter, pointer = choose(np.zeros(n, np.int64))
    rank = np.unique(letter, return_inverse=True)[1]
    for step in doubled(pointer)[:-1]:
        rank = np.unique(rank * n + rank[step], return_inverse=True)[1]
    letter, pointer = choose(rank)
    return doubled(pointer), letter


def walk(pointers, start: np.ndarray) -> np.ndarray:
    """The nodes on the paths from ``start`` (one row each): a path's first 2^k nodes, and these carried 2^k on."""
    nodes = start[:, None]
    for pointer in pointers:
        nodes = np.concatenate([nodes, pointer[nodes]], axis=1)
    return nodes


def _lanes(batches):
    """Rows of the batches in groups of similar length and bounded size, with their codes as a matrix (place, lane)."""
    for batch in batches:
        rows = batch.to_pylist()
        rows.sort(key=lambda r: len(r["codes"]))
        while rows:
            most = max(1, NODES // (4 * len(rows[0]["codes"]) + 4))
            part = [r for r in rows[:most] if len(r["codes"]) <= 2 * len(rows[0]["codes"])]
            del rows[:len(part)]
            codes = np.zeros((max(len(r["codes"]) for r in part), len(part)), np.uint8)
            for i, r in enumerate(part):
                codes[:len(r["codes"]), i] = np.frombuffer(r["codes"].encode(), np.uint8)
            yield part, codes


def _transfers(batches):
    """Per block the least costs from each state before it to each state behind it."""
    for part, codes in _lanes(batches):
        to = np.stack([cost_to_go(codes, np.where(np.arange(4) == e, 0, FAR)[None].repeat(len(part), 0))[0] for e in range(4)], 2)
        yield pa.RecordBatch.from_pydict({"conv": [r["conv"] for r in part], "block": [r["block"] for r in part], "costs": to.reshape(len(part), 16).tolist()},
                                         schema=pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))]))


def _behind(batches):
    """Per block of a long conversation what is to pay behind it, from the blocks' costs in reverse."""
    for batch in batches:
        for row in batch.to_pylist():
            pay, out = [0, FAR, FAR, FAR], {"conv": [], "block": [], "ends": []}
            for b in reversed(row["parts"]):
                for name, value in zip(out, (row["conv"], b["block"], pay)):
                    out[name].append(value)
                pay = [min(min(b["costs"][4 * i + j] + pay[j] for j in range(4)), FAR) for i in range(4)]
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("ends", pa.list_(pa.int64()))]))


def _exits(batches):
    """Per block the state behind it on the least path from each state before it."""
    for part, codes in _lanes(batches):
        costs = cost_to_go(codes, np.array([r["ends"] for r in part], np.int64))
        pointers, _ = least_paths(codes, costs)
        last = pointers[-1][np.arange(len(part) * 4)].reshape(len(part), 4) % 4
        yield pa.RecordBatch.from_pydict({"conv": [r["conv"] for r in part], "block": [r["block"] for r in part], "exits": last.tolist()},
                                         schema=pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("exits", pa.list_(pa.int64()))]))


def _entries(batches):
    """Per block of a long conversation the state before it, from the blocks' exits in order."""
    for batch in batches:
        for row in batch.to_pylist():
            state, out = 0, {"conv": [], "block": [], "entry": []}
            for b in row["parts"]:
                for name, value in zip(out, (row["conv"], b["block"], state)):
                    out[name].append(value)
                state = b["exits"][state]
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("entry", pa.int64())]))


SOLVED = "conv long, block long, audit string, made string, row array<int>, cost long, illegal long, first string, last string"


def _solve(batches):
    """Per block its audit, the initial that each edit leaves (- for none), the row it edits (-1: none), and the block's own illegal neighbours."""
    schema = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("audit", pa.string()), ("made", pa.string()), ("row", pa.list_(pa.int32())),
                        ("cost", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string())])
    for part, codes in _lanes(batches):
        out = {name: [] for name in schema.names}
        costs = cost_to_go(codes, np.array([r["ends"] for r in part], np.int64))
        pointers, letter = least_paths(codes, costs)
        entry = np.array([r["entry"] for r in part])
        nodes = walk(pointers, np.arange(len(part)) * 4 + entry)
        marks, after = letter[nodes], pointers[0][nodes] % 4
        places = nodes // (4 * len(part))
        for i, r in enumerate(part):
            edits = np.flatnonzero(marks[i])
            audit = marks[i][edits].astype(np.uint8).tobytes().decode()
            made = "".join("-" if e == "D" else " sua"[s] for e, s in zip(audit, after[i][edits]))
            initials = r["codes"].rstrip("$").lower().translate(str.maketrans(GONE, SOUND))
            illegal = sum(initials[j:j + 2] not in LEGAL for j in range(len(initials) - 1))
            where = [-1 if e == "I" else int(p) for e, p in zip(audit, places[i][edits])]
            for name, value in zip(schema.names, (r["conv"], r["block"], audit, made, where, int(costs[0, i, entry[i]]), illegal, initials[:1], initials[-1:])):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def _gathered(blocks: DataFrame, value: str) -> DataFrame:
    """One row per long conversation with a small value of each of its blocks, in order."""
    return blocks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", value))).alias("parts"))


def repair(rows: DataFrame) -> Repair:
    """The cheapest edits that make each conversation's role initials ``(s?(ua)+)?``; of equal costs the least audit.

    ``rows`` has conv_id, turn, role and text; other columns are not read. Null roles and texts count as
    one space, null ids are one conversation. Rows are taken by turn (nulls first), then role, then
    text. A row is blank (no visible character), else duplicate (its role and text came before), else
    truncated (its last visible character is not one of ``.!?``). Keep costs 0, Rerole 1, Delete 2,
    Insert 5, and a truncated row that stays 5 more; blank and duplicate rows are deleted. The
    initial of a role is its first character; rows with no role have none that is legal.

    Conversations are cut into blocks, so that one of any length is shared by many tasks: a block's
    least costs between the states at its two ends are computed first, one small row a block is scanned
    per long conversation, and each block is then solved with its ends known.

    ``report``: conv (its number), conv_id, gaps, blank, duplicate, truncated, illegal and cost.
    ``edits``: conv, block, at, edit (K, R, D or I), role and text after it (before it, if deleted). An
    empty table gives no rows.
    """
    initial = F.substring("role", 1, 1)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = materialize(rows, "rows").withColumn("tie", F.monotonically_increasing_id())  # equal rows are spread too
    placed = materialize(ranked(rows, ["conv_id", "turn", "role", "text", "tie"], "place").drop("tie"), "placed")
    blank = ~F.col("text").rlike(VISIBLE)
    narrow = placed.select(
        "place", F.struct("conv_id").alias("id"), blank.alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), F.when(~blank, F.struct("conv_id", "role", text_digest(F.col("text")).alias("sha"))).alias("same"))
    first = narrow.filter("same is not null").groupBy("same").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    narrow = join_unique(narrow, materialize(first, "copies"), "same", "copies").drop("copies", "same")
    sizes = placed.groupBy(F.struct("conv_id").alias("id")).agg(
        F.min("place").alias("conv"), F.count(F.lit(1)).alias("n"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    sizes = materialize(sizes, "conversations")
    narrow = join_unique(narrow, sizes.select("id", "conv", "n"), "id", "n")
    duplicate = F.coalesce(F.col("place") != F.col("first"), F.lit(False))
    sound = F.instr(F.lit(SOUND), F.col("initial"))
    code = F.when(F.col("blank") | duplicate, F.substring(F.lit(GONE), sound, F.lit(1))).when(F.col("cut"), F.substring(F.lit(CUT), sound, F.lit(1))).otherwise(F.col("initial"))
    coded = materialize(narrow.select(
        "conv", "place", "n", ((F.col("place") - F.col("conv")) / BLOCK).cast("long").alias("block"), code.alias("code"), F.col("blank"),
        (~F.col("blank") & duplicate).alias("duplicate"), (~F.col("blank") & ~duplicate & F.col("cut")).alias("truncated")), "coded")
    counts = coded.groupBy("conv").agg(*[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), "")
    blocks = coded.groupBy("conv", "block", "n").agg(joined.alias("codes"))
    last = F.floor((F.col("n") - 1) / BLOCK)
    blocks = materialize(blocks.select("conv", "block", (last > 0).alias("long"), F.concat("codes", F.when(F.col("block") == last, "$").otherwise("")).alias("codes")), "blocks")
    solved = materialize(_solved(blocks), "solved")

    before = F.lag("last").over(W.partitionBy("conv").orderBy("block"))
    per = solved.select("conv", F.when(F.col("block") == 0, F.col("cost")).alias("cost"), "illegal", F.concat(before, F.col("first")).alias("seam"))
    per = per.groupBy("conv").agg(F.max("cost").alias("cost"), (F.sum("illegal") + F.count_if(F.col("seam").isNotNull() & ~F.col("seam").isin(*LEGAL))).alias("illegal"))
    report = sizes.select("conv", "id.conv_id", "gaps").join(counts, "conv").join(per, "conv")

    each = solved.select("conv", "block", F.posexplode(F.transform("row", lambda r, i: F.struct(r.alias("row"), F.substring(F.col("audit"), i + 1, F.lit(1)).alias("edit"), F.substring(F.col("made"), i + 1, F.lit(1)).alias("to")))).alias("at", "e"))
    each = each.select("conv", "block", "at", "e.edit", F.when(F.col("e.to") == "u", "user").when(F.col("e.to") == "a", "assistant").alias("new"),
                       F.when(F.col("e.row") >= 0, F.col("conv") + F.col("block") * BLOCK + F.col("e.row")).alias("place"))
    role = F.when(F.col("edit").isin("R", "I"), F.col("new")).otherwise(F.col("role"))
    inserted = each.filter("place is null").select("conv", "block", "at", "edit", F.col("new").alias("role"), F.lit("").alias("text"))
    edited = each.filter("place is not null").join(placed.select("place", "role", "text"), "place").select("conv", "block", "at", "edit", role.alias("role"), "text")
    return Repair(report, edited.unionByName(inserted))


def _solved(blocks: DataFrame) -> DataFrame:
    """Every block solved with its ends known (``SOLVED``); blocks of one-block conversations at once."""
    nothing, start = F.array(F.lit(0), *[F.lit(FAR)] * 3).cast("array<bigint>"), F.lit(0).cast("long")
    ready = blocks.filter("not long").select("conv", "block", "codes", nothing.alias("ends"), start.alias("entry"))
    long = blocks.filter("long").select("conv", "block", "codes")
    if not long.isEmpty():
        costs = _gathered(long.mapInArrow(_transfers, "conv long, block long, costs array<long>"), "costs")
        ends = costs.mapInArrow(_behind, "conv long, block long, ends array<long>")
        long = materialize(long.join(ends.hint("merge"), ["conv", "block"]), "ends")
        exits = _gathered(long.mapInArrow(_exits, "conv long, block long, exits array<long>"), "exits")
        entries = exits.mapInArrow(_entries, "conv long, block long, entry long")
        ready = ready.unionByName(long.join(entries.hint("merge"), ["conv", "block"]).select("conv", "block", "codes", "ends", "entry"))
    return ready.mapInArrow(_solve, SOLVED)


def _hashes(batches):
    """SHA-256 of each conversation's lines and its audit, from edits sorted by conversation, block and place: one hash state at a time."""
    schema = pa.schema([("conv", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    conv, state, audit, lines = None, None, [], 0
    for batch in batches:
        out = []
        for at, edit, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5))):
            if at != conv:
                if conv is not None:
                    out.append((conv, "".join(audit), state.hexdigest()))
                conv, state, audit, lines = at, hashlib.sha256(), [], 0
            audit.append(edit)
            if edit != "D":
                state.update((("\n" if lines else "") + role + ":" + text).encode())
                lines += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ([], [], []), schema)], schema=schema)
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((conv, "".join(audit), state.hexdigest()), schema)], schema=schema)


def digest(found: Repair, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: the report, the audit and the SHA-256 of the repaired rows.

    The hash of a conversation needs its rows in order, so one task streams them; it holds only the
    hash and the audit. Conversations without rows get zeros, an empty audit and the hash of nothing.
    """
    edits = found.edits.select("conv", "block", "at", "edit", "role", "text").repartition("conv").sortWithinPartitions("conv", "block", "at")
    hashes = edits.mapInArrow(_hashes, "conv long, audit string, repaired_sha256 string")
    rows = found.report.join(hashes, "conv").withColumn("id", F.struct("conv_id")).drop("conv", "conv_id")
    ids = conversations.select("conv_id").distinct().withColumn("id", F.struct("conv_id"))
    joined = ids.join(rows, "id", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
