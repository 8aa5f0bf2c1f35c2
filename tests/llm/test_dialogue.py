"""Conversation repair against a search through all edits, and over cut signatures, nulls and odd tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from gridlore.llm import dialogue as D

SPACE = "[^\x20\x09-\x0d]"


def outcome(edits, letters):
    """Cost and roles of the edits on the rows, or None if they don't fit."""
    rows, out, cost = iter(letters), "", 0
    for e in edits:
        if e == "I":
            out, cost = out + "?", cost + 2
            continue
        c = next(rows, None)
        if c is None or (c == "x" and e != "D"):
            return None
        cost += {"K": 0, "R": 2, "D": 3}[e] + (e != "D" and c.isupper())
        out += {"K": c.lower(), "R": "?", "D": ""}[e]
    if next(rows, None) is not None:
        return None
    start = out.startswith("s")
    due = ("s" if start else "") + "ua" * len(out)
    good = all(a in ("?", b) for a, b in zip(out, due)) and (len(out) - start) % 2 == 0 and out != "s"
    return (cost, edits) if good else None


def searched(letters):
    every = ("".join(e) for n in range(len(letters) + 3) for e in itertools.product("DIKR", repeat=n))
    return min(x for x in (outcome(e, letters) for e in every) if x)


def test_solve_by_search():
    rnd = random.Random(3)
    cases = ["", "s", "S", "x", "a", "o", "us", "uas", "ssu", "xx"] + ["".join(rnd.choice("suaoxSUAO") for _ in range(rnd.randint(2, 4))) for _ in range(25)]
    for letters in cases:
        assert D.combine([D.ways(f"^{letters}$")]) == searched(letters), letters


def test_pieces_of_a_signature():
    rnd = random.Random(4)
    for _ in range(300):
        letters = "".join(rnd.choice("suaoxSUAO") for _ in range(rnd.randint(1, 40)))
        whole = D.combine([D.ways(f"^{letters}$")])
        n = rnd.randint(1, 7)
        cut = [letters[i : i + n] for i in range(0, len(letters), n)]
        cut[0], cut[-1] = "^" + cut[0], cut[-1] + "$"
        assert D.combine([D.ways(c) for c in cut]) == whole
    assert D.combine([]) == (0, "")


def plain(rows, damage):
    """conv_id -> stats and repaired rows."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        convs[conv] += []
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        convs[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = [t for t, *_ in own if t is not None]
        faults, seen, letters = [], set(), ""
        for _, role, text in own:
            said = re.findall(SPACE, text)
            f = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text)), faults.append(f)
            i = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if f in ("blank", "duplicate") else i.upper() if f else i
        # the whole string at once, from the front, by states
        best = {D.NOTHING: (0, "")}
        for c in letters:
            nxt = {}
            for s, (cost, e) in best.items():
                for b, (x, more) in D._step(c, s).items():
                    nxt.setdefault(b, []).append((cost + x, e + more))
            best = {b: min(v) for b, v in nxt.items()}
        ends = {D.NOTHING: "", D.SYSTEM: "II", D.USER: "I", D.ROUND: ""}
        cost, audit = min((c + 2 * len(ends[s]), e + ends[s]) for s, (c, e) in best.items())
        lines, it, parity = [], iter(own), 0
        for e in audit:
            row = None if e == "I" else next(it)
            if e == "D":
                continue
            if e == "K":
                lines.append((e, row[1], row[2]))
                parity += row[1][:1] != "s"
            else:
                lines.append((e, "assistant" if parity % 2 else "user", "" if e == "I" else row[2]))
                parity += 1
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = ((gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), bad, cost, audit), lines)
    return out


def made(seed, n):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "what?  \n", "é.", None, "ok. (x)", "a\x1f"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "umpire"]
    rows = []
    for conv in [*range(n), None]:
        for t in range(rnd.choice([1, 2, 5, 9, 200 if conv == 3 else 12])):
            rows.append((conv, None if rnd.random() < 0.05 else t * rnd.choice([1, 1, 1, 2]), rnd.choice(roles[:3] if rnd.random() < 0.8 else roles), rnd.choice(texts)))
    rows += [(n, 0, "user", "x" * 300_000 + "."), (n, 1, "assistant", None), (n + 1, None, None, None)] + rows[:4]
    return rows


@pytest.mark.parametrize("damage", [True, False])
def test_repair(spark, damage):
    rows = made(5, 40)
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "conv_id long, turn long, role string, text string, found int, digest string").repartition(3)
    want = plain(rows, damage)
    got = D.digested(D.damaged(df) if damage else D.rowed(df)).collect()
    digest = lambda lines: hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in lines).encode()).hexdigest()
    assert {r["conv_id"]: (tuple(r[c] for c in D.STATS), r["repaired_sha256"]) for r in got} == {c: (s, digest(x)) for c, (s, x) in want.items()} and len(got) == len(want)
    if not damage:
        lines = defaultdict(list)
        for r in sorted(D.repaired(df).collect(), key=lambda r: r["place"]):
            lines[r["conv_id"]].append((r["edit"], r["role"], r["text"]))
        assert lines == {c: x for c, (_, x) in want.items() if x}
        assert any(re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in x)) is None for x in lines.values()) is False


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert D.digested(D.damaged(none)).collect() == [] and D.repaired(none).collect() == []
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = D.digested(D.damaged(spark.createDataFrame([(lost, 0, "user", "hi.")], none.schema))).collect()
    assert got[0][:-1] == (lost, 0, 0, 0, 0, 0, 0, "") and got[0]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
