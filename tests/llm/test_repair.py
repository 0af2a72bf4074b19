"""Conversation repair against plain loops: every cheapest edit list of small conversations, cut into blocks of any size."""

import hashlib
import random
import re
import zlib

import pytest

from fieldsheet.llm import repair

VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        row = (conv, turn, "user" if h == 4 else role, text)
        out += [] if h == 0 else [row, row] if h == 3 else [row]
    return out


def _cheapest(rows):
    """(cost, audit, repaired lines) by going through all prefixes with all least audits kept whole."""
    seen, kinds, counts = set(), [], [0, 0, 0]
    for _, _, role, text in rows:
        kind = None
        if not VISIBLE.search(text):
            kind = 0
        elif (role, text) in seen:
            kind = 1
        elif VISIBLE.findall(text)[-1] not in ".!?":
            kind = 2
        seen.add((role, text))
        kinds.append(kind)
        if kind is not None:
            counts[kind] += 1
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {}

    def offer(i, state, cost, audit, lines, todo):
        key = (i, state)
        if key not in best or (cost, audit) < best[key][:2]:
            best[key] = (cost, audit, lines)
            todo.append(key)

    # from the end: the least rest of an audit stays least whatever comes before it
    for i in range(len(rows), -1, -1):
        for state in ("", "s", "u", "a"):
            options = []
            if i == len(rows):
                if state in ("", "a"):
                    options.append((0, "", ()))
            else:
                _, _, role, text = rows[i]
                rest = best.get((i + 1, state))
                if rest:
                    options.append((rest[0] + 2, "D" + rest[1], rest[2]))
                if kinds[i] not in (0, 1):
                    more = 5 if kinds[i] == 2 else 0
                    for edit, cost, name in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                        rest = best.get((i + 1, after.get((state, name[:1]))))
                        if rest:
                            options.append((rest[0] + cost + more, edit + rest[1], (f"{name}:{text}",) + rest[2]))
            if options:
                best[i, state] = min(options)
        for _ in range(3):
            for state in ("", "s", "u", "a"):
                for name in ("user", "assistant"):
                    rest = best.get((i, after.get((state, name[:1]))))
                    if rest:
                        option = (rest[0] + 5, "I" + rest[1], (name + ":",) + rest[2])
                        best[i, state] = min(option, best.get((i, state), option))
    return best[0, ""], counts


def _brute(rows):
    damaged, out = _damage(rows), []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        (cost, audit, lines), counts = _cheapest(own)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def _rows():
    rng = random.Random(5)
    rows = []
    for conv in range(150):
        for turn in range(rng.choice([1, 2, 3, 5, 8, 13])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "superuser", "User"])
            text = rng.choice(["Yes.", "No", "Why?", "ok. ", "é!\n", " \t", "", None, f"text {conv} {turn}.", f"text {turn}", "😀."])
            rows.append((conv, turn, role, text))
    for turn in range(300):  # one long conversation
        rows.append((1000, turn, ["user", "assistant"][turn % 2] if rng.random() < 0.8 else "system", rng.choice([f"a {turn}.", f"b {turn}", "again!", ""])))
    rows += [(None, None, None, None), (None, 1, "user", "x."), (None, 1, "user", "x."), (None, 2, "assistant", "y."), (2000, None, "system", "s."), (2000, None, "user", "u.")]
    rows += [(3000, 10 ** 12, "user", "long " * 50000 + "."), (3000, 10 ** 12 + 5, "assistant", "fine.")]
    rows += [(c, 1, "user", "only.") for c in range(4000, 4040)]  # some lose their only row
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"
WIDE = SCHEMA + ", conv string, place string, codes int, n int, id string, same string, first int, block string, at string, edit int"


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame([r + (None,) * 10 for r in _rows()], WIDE)


def _result(df):
    rows = repair.digest(repair.repair(repair.damage(df)), df)
    return sorted((tuple(r) for r in rows.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


@pytest.mark.parametrize("block", [4096, 7])
def test_equals_brute_force(spark, conversations, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    assert _result(conversations) == _brute(_rows())


def test_empty_table(spark, conversations):
    assert _result(conversations.limit(0)) == []


def test_edits_give_the_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "user", "u."), (1, 3, "user", "v"), (1, 4, "assistant", "b.")], SCHEMA)
    edits = repair.repair(df).edits.orderBy("conv", "block", "at")
    assert [tuple(r)[3:] for r in edits.collect()] == [("R", "user", "s."), ("K", "assistant", "a."), ("K", "user", "u."), ("D", "user", "v"), ("K", "assistant", "b.")]  # 1 + 2
