"""Conversation repair against every edit, cell by cell."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

import llm.tables as tables
from pairloom.llm import conversation_repair as repair, queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        # Names that the operator uses itself.
        T.StructField("kind", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("audit", T.StringType()),
    ]
)
NEXT = {"-": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(classes):
    """The least (cost, audit) by trying every edit of every turn, state by state."""

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                to = NEXT[state]
                best[to] = min(best.get(to, (10**9, "")), (cost + 5, audit + "I"))
        return best

    best = {"-": (0, "")}
    for c in classes:
        found = {}
        for state, (cost, audit) in inserted(dict(best)).items():
            edits = [("D", state, 2)]
            if c != "x":
                extra, initial = (5, c.lower()) if c.isupper() else (0, c)
                if initial in "ua" and initial == NEXT[state] or (initial == "s" and state == "-"):
                    edits.append(("K", initial, extra))
                else:
                    edits.append(("R", NEXT[state], 1 + extra))
                if initial == "s" and state == "-":
                    edits.append(("R", "u", 1 + extra))
            for letter, to, price in edits:
                found[to] = min(found.get(to, (10**9, "")), (cost + price, audit + letter))
        best = found
    best = inserted(best)
    return min(best[s] for s in ("-", "a") if s in best)


def damaged(rows):
    found = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        found += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return found


def repaired_by_hand(conv, rows, key=lambda r: hashlib.sha256(r[3].encode()).digest()):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], key(r)))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    classes, faults, seen = "", [0, 0, 0], set()
    for _, _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 0 if not visible else 1 if (role, text) in seen else 2 if visible[-1] not in ".!?" else None
        seen.add((role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        classes += "x" if fault in (0, 1) else initial.upper() if fault == 2 else initial
        if fault is not None:
            faults[fault] += 1
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest(classes)
    out, state, queue = [], "-", list(rows)
    for letter in audit:
        row = None if letter == "I" else queue.pop(0)
        if letter == "D":
            continue
        state = row[2][0] if letter == "K" else NEXT[state]
        out.append((row[2] if letter == "K" else {"u": "user", "a": "assistant"}[state], row[3] if row else ""))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (conv, gaps, *faults, illegal, cost, audit, sha), out


def by_hand(rows):
    after = damaged(rows)
    return [repaired_by_hand(c, [r for r in after if r[0] == c])[0] for c in {r[0] for r in rows}]


def test_alignments_against_every_edit():
    for n in range(6):
        for classes in map("".join, itertools.product("suaUxo", repeat=n)):
            assert repair.repair_of(classes) == cheapest(classes), classes
    rng = random.Random(4)
    for _ in range(300):
        classes = "".join(rng.choices("suaSUAxo", [1, 6, 6, 1, 2, 2, 2, 1], k=rng.randrange(1, 60)))
        wanted = cheapest(classes)
        for block in (1, 2, 5, 16, 64):
            assert repair.repair_of(classes, block) == wanted, (classes, block)


def test_least_audit_among_equal_costs():
    # Deleting either user is as cheap; the first one has the lesser audit.
    assert repair.repair_of("uua") == (2, "DKK")
    assert repair.repair_of("uuua") == (1, "KRKK") and repair.repair_of("uA") == (4, "DD")
    assert repair.repair_of("") == (0, "") and repair.repair_of("s") == (2, "D") and repair.repair_of("sua") == (0, "KKK")


def awkward():
    rng = random.Random(7)
    texts = [None, "", " \n", "Fine.", "Fine.", "Cut off", "Ja!", " ", "x" * 50_000 + "?", "日本。", "no end \t\r\n", "End. \x0b"]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "User"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(100, None, "user", "a."), (100, None, "assistant", "b."), (100, 5, "user", "a."), (None, 1, "user", "x."), (None, None, None, None)]
    rows += [(101, 1, "user", "same.")] * 3 + [(101, 2, "assistant", "y."), (102, None, None, None), (103, 1 << 40, "user", "far.")]
    rows += [(104, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(150)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "d", "a") for r in rows], SCHEMA)


def test_repair_of_awkward_rows(spark):
    rows = awkward()
    found = repair.digest_repaired(repair.damage(frame(spark, rows))).collect()
    assert tables.bag(found) == tables.bag(by_hand(rows))
    assert repair.digest_repaired(repair.damage(frame(spark, []))).count() == 0


def test_repaired_turns(spark):
    rows = [(c, t, r or " ", " " if x is None else x) for c, t, r, x in awkward()]
    df = frame(spark, rows)
    found = repair.repaired(df, repair.audits(df)).collect()
    for conv in {r[0] for r in rows}:
        _, turns = repaired_by_hand(conv, [r for r in rows if r[0] == conv])
        assert [(r["role"], r["text"]) for r in sorted((r for r in found if r["conv_id"] == conv), key=lambda r: r["place"])] == turns


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_whole_conversations(spark, folder):
    rows = tables.some(folder, "conversations", "conv_id, turn, role, text")
    assert tables.bag(queries.op11_conversation_repair(spark, folder).collect()) == tables.bag(by_hand(rows))
