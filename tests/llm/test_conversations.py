"""Conversation repair: cells against exhaustive search, whole results against plain Python."""
import binascii
import collections
import hashlib
import itertools
import random
import re

import pytest

from quarry.llm import common as C
from quarry.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, c string, blk int, audit string"


def cheapest(rows):
    """(cost, audit) by search over (rows used, state), no spans: rows are (initial, fault)."""
    best = {(0, 0): (0, "")}
    for i in range(len(rows) + 1):
        for _ in range(3):  # insertions in front of row i
            for st in range(4):
                if (i, st) in best:
                    for to in {0: [2], 1: [2], 2: [3], 3: [2]}[st]:
                        new = (best[i, st][0] + 5, best[i, st][1] + "I")
                        best[i, to] = min(best.get((i, to), new), new)
        if i == len(rows):
            break
        c, fault = rows[i]
        for st in range(4):
            if (i, st) not in best:
                continue
            cost, audit = best[i, st]
            opts = [(st, 2, "D")]
            if fault not in ("blank", "duplicate"):
                t = 5 if fault == "truncated" else 0
                opts += [(to, t, "K") for to in ([1] if c == "s" and st == 0 else [2] if c == "u" and st != 2 else [3] if c == "a" and st == 2 else [])]
                opts += [(3 if st == 2 else 2, t + 1, "R")]
            for to, more, e in opts:
                new = (cost + more, audit + e)
                best[i + 1, to] = min(best.get((i + 1, to), new), new)
    return min(best[len(rows), st] for st in (0, 3) if (len(rows), st) in best)


def plain(rows, damaged=True):
    """{conv_id: result} of (conv_id, turn, role, text) rows."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = binascii.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        if kind == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rs in convs.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rs:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rs if t is not None]
        ini = [r[:1] for _, r, _ in rs]
        cost, audit = cheapest(list(zip(ini, faults)))
        it, made = iter(rs), []
        for e in audit:
            if e == "I":
                made.append((None, ""))
                continue
            _, role, text = next(it)
            if e != "D":
                made.append((role if e == "K" else None, text))
        head = 1 if made and made[0][0] is not None and made[0][0][:1] == "s" else 0
        made = [(r if r is not None else ("user", "assistant")[(j - head) % 2], t) for j, (r, t) in enumerate(made)]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in made))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def damaged_rows(rng, convs, most):
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Hello.", "Yes!", "no end", "", " \t\n", None, "Ω?", "Same.", f"line {rng.random()}.", "a. \x0b"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3, -turn]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 2, None, None)] + [(7, 1, "user", "Again.")] * 3
    return rows


def test_cells_are_the_cheapest_repair():
    kinds = [(c, f) for c in "suax" for f in cv.FAULTS]
    rng = random.Random(2)
    for rows in itertools.chain(itertools.product(kinds, repeat=2), ([rng.choice(kinds) for _ in range(rng.randrange(12))] for _ in range(1500))):
        cells = cv.parse(list(rows))
        assert min(x for x in (cells[0], cells[3]) if x) == cheapest(list(rows))


def test_every_split_of_a_span_gives_the_same_cells():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.choice(cv.FAULTS)) for _ in range(9)]
        assert all(cv.combined(cv.parse(rows[:k]), cv.parse(rows[k:])) == cv.parse(rows) for k in range(10))


@pytest.mark.parametrize("block", [3, 512])
def test_report_equals_plain(spark, block, monkeypatch):
    C.prepare(spark)
    rng = random.Random(block)
    rows = damaged_rows(rng, 40, 9) + [(1000, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["x.", f"{t}.", f"{t}"])) for t in range(700)]
    rng.shuffle(rows)
    monkeypatch.setattr(cv, "BLOCK_ROWS", block)
    monkeypatch.setattr(cv, "FAN_BITS", 2)
    docs = spark.createDataFrame([r + ("x", 1, "y") for r in rows], SCHEMA).repartition(4)
    got = {r[0]: tuple(r)[1:] for r in cv.report(cv.damage(docs)).collect()}
    assert got == {k: v for k, v in plain(rows).items() if k in got} and len(got) > 35
    assert {r[0]: tuple(r)[1:] for r in cv.report(docs).collect()} == plain(rows, damaged=False)


def test_repaired_turns(spark):
    C.prepare(spark)
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 3, "assistant", ""), (1, 2, "assistant", "A."), (1, 4, "user", "B."),
            (2, 0, "assistant", "only"), (3, None, "user", "Q?"), (3, 1, "user", "W " * 30_000 + ".")]
    docs = spark.createDataFrame([r + ("x", 1, "y") for r in rows], SCHEMA)
    out = collections.defaultdict(list)
    for r in cv.repaired(docs).orderBy("conv_id", "position").collect():
        out[r.conv_id].append((r.role, r.text))
    assert out[1] == [("system", "S."), ("user", "Q?"), ("assistant", "A.")] and 2 not in out
    assert out[3] == [("user", "Q?"), ("assistant", rows[-1][3])]
    empty = spark.createDataFrame([], SCHEMA)
    assert cv.report(empty).count() == cv.repaired(empty).count() == 0
