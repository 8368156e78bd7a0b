"""Repairing the structure of conversations by aligning their turns with the grammar ``(s?(ua)+)?``.

Faults: a turn is *blank* without a visible character, a *duplicate* if an earlier turn has its role and text, and
*truncated* if its last visible character ends no sentence; the first that holds counts. Edits: K keeps a turn
(0), R gives it the role user or assistant (1), D deletes it (2; blank and duplicate turns have to go), I inserts an empty
user or assistant turn (5); a truncated turn that stays costs 5 more. Wanted is the cheapest edit that gives legal
role initials, and of equally cheap ones the one with the least audit, the string of its letters.

Method: Wagner-Fischer target alignment. Turns are aligned with the grammar string of every feasible length, a matrix of
turns by target places each. Ukkonen's band leaves out the diagonals that cost more than the cheapest alignment so
far, and the lengths that do. Matrices hold what remains to be paid, so that tracing from the first cell on, letters in
ASCII order, gives the least audit of a target; the audits of equally cheap targets are compared.
Turns that have to go stand outside the matrix, and inserted turns stand before a turn that stays or at the very end, where
the least audit has them anyhow.

More than ``BLOCK`` turns are aligned block by block, from each state of the grammar (nothing yet, after s, u or a)
to each other one. What follows costs the same for all ways to a state, and no audit of a block begins another one, so the
cheapest way through the states with the least audit of each block is the whole conversation's.

Scale: the rows that are grouped and aligned are light, a digest for the text. First places of equal turns are
aggregated before they meet the turns, a row for a distinct turn, sorted next to it. A conversation is read in order
by one task that holds a letter a turn, as its audit does; texts pass by once more, behind their audit, straight into the
result. Memory is bounded by the audit, not by the texts; the hash of a conversation has to be taken in order anyway.

Defined cases: nulls in role or text are one space (so a null text is blank); a null conv_id is a conversation of its own;
null turns come first; turns of equal number go by role, then by the digest of the text; equal rows are duplicates of the
first of them; roles without an initial in s, u, a (an empty role too) have to change or go; an empty text is blank;
texts of any length pass row by row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import batch_of, schema_of
from pairloom.session import write_through

#: Turns that are aligned at once.
BLOCK = 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# White space, and the states of the grammar with what completes them.
_SPACE = " \t\n\x0b\x0c\r"
_STATES = "-sua"
_ENDING = {"-": "", "s": "II", "u": "I", "a": ""}
_ROLE = {"u": "user", "a": "assistant"}
#: Inserted turns that lead from any state to any other one after u or a.
_DETOUR = 2 * INSERT


# -------------------------------------------------------------------------------- one block


def follow(state: str) -> str:
    """The role that a turn may be given, or a new turn has, after ``state``."""
    return "a" if state == "u" else "u"


def _targets(state: str, length: int) -> list[str]:
    """The strings of this length that the grammar allows after ``state``."""
    first = follow(state)
    plain = (first + follow(first)) * (length // 2 + 1)
    found = [plain[:length]]
    if state == "-" and length:
        found.append("s" + ("ua" * length)[: length - 1])
    return found


def align(turns: str, target: str, limit: int) -> tuple[int, list[str]] | None:
    """The cheapest alignment of ``turns`` (initials; upper case: truncated) with ``target`` up to ``limit``: its cost,
    and for each turn the letters of the turns inserted before it and its own."""
    n, length = len(turns), len(target)
    # Cells on diagonal d = j - i cost d insertions (or -d deletions) before them and the rest to n - length after them.
    bound = lambda d: max(-DELETE * d, INSERT * d) + max(DELETE * (d - length + n), INSERT * (length - n - d))
    band = [d for d in range(-n, length + 1) if bound(d) <= limit]
    if not band:
        return None
    low, high = band[0], band[-1]
    never = limit + 1
    rest = [[never] * (length + 2) for _ in range(n + 1)]
    rest[n][length] = 0
    for i in range(n - 1, -1, -1):
        turn, here, below = turns[i], rest[i], rest[i + 1]
        extra, initial = (TRUNCATED, turn.lower()) if turn.isupper() else (0, turn)
        for j in range(min(length, i + high), max(0, i + low) - 1, -1):
            best = below[j] + DELETE
            if j < length:
                if initial == target[j]:
                    best = min(best, below[j + 1] + KEEP + extra)
                elif target[j] != "s":
                    best = min(best, below[j + 1] + REROLE + extra)
                if target[j] != "s":
                    best = min(best, here[j + 1] + INSERT)
            here[j] = min(best, never)
    if rest[0][0] > limit:
        return None
    letters, i, j, held = [], 0, 0, ""
    while i < n:
        left, turn = rest[i][j], turns[i]
        extra, initial = (TRUNCATED, turn.lower()) if turn.isupper() else (0, turn)
        if left == rest[i + 1][j] + DELETE:
            letters.append(held + "D")
            i, held = i + 1, ""
        elif j < length and target[j] != "s" and left == rest[i][j + 1] + INSERT:
            j, held = j + 1, held + "I"
        else:
            letters.append(held + ("K" if initial == target[j] else "R"))
            i, j, held = i + 1, j + 1, ""
    return rest[0][0], letters


def _spelt(block: str, letters: list[str]) -> str:
    """The audit of a block: ``x`` turns go, the others take their letters in order."""
    own = iter(letters)
    return "".join("D" if turn == "x" else next(own) for turn in block)


@lru_cache(maxsize=50_000)
def ways(block: str, state: str, closing: bool) -> dict[str, tuple[int, str]]:
    """(cost, audit) of the best way through a block from ``state`` to each state.

    A closing block ends the conversation: its costs and audits complete it, and only its best way is looked for.
    """
    turns = block.replace("x", "")
    n, gone = len(turns), DELETE * block.count("x")
    found: dict[str, tuple[int, str]] = {}
    # Deleting all turns is always possible.
    least = DELETE * n + (INSERT * len(_ENDING[state]) if closing else 0)
    for length in sorted(range(n + (least + _DETOUR) // INSERT + 1), key=lambda k: abs(k - n)):
        for target in _targets(state, length):
            to = target[-1:] or state
            ending = _ENDING[to] if closing else ""
            limit = least - INSERT * len(ending) if closing else least + _DETOUR
            if to in found:
                limit = min(limit, found[to][0] - gone - INSERT * len(ending))
            got = align(turns, target, limit) if limit >= 0 else None
            if got:
                cost = got[0] + INSERT * len(ending)
                way = (cost + gone, _spelt(block, got[1]) + ending)
                found[to] = min(way, found.get(to, way))
                least = min(least, cost)
    return found


def repair_of(classes: str, block: int = BLOCK) -> tuple[int, str]:
    """The least cost and audit of a conversation, given a letter for each of its turns: the initial (``o`` for a role
    outside the grammar), in upper case if truncated, or ``x`` if it has to go."""
    if len(classes) <= block:
        return min(ways(classes, "-", True).values()) if classes else (0, "")
    blocks = [classes[k : k + block] for k in range(0, len(classes), block)]
    rest = {state: INSERT * len(ending) for state, ending in _ENDING.items()}
    costs = [rest]
    for part in reversed(blocks):
        rest = {s: min(cost + rest[to] for to, (cost, _) in ways(part, s, False).items()) for s in _STATES}
        costs.append(rest)
    costs.reverse()
    state, audit = "-", []
    for k, part in enumerate(blocks):
        best = [(letters, to) for to, (cost, letters) in ways(part, state, False).items() if cost + costs[k + 1][to] == costs[k][state]]
        letters, state = min(best)
        audit.append(letters)
    return costs[0]["-"], "".join(audit) + _ENDING[state]


# ------------------------------------------------------------------------------------- jobs


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32(``conv_id:turn``) % 20; ``times`` says how often a row stands, 0 for a dropped one."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(as_text("text"), ".!?", "")).otherwise(as_text("text"))
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.when(kind == 4, "user").otherwise(as_text("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )


def _as_turns(rows: DataFrame) -> DataFrame:
    """Rows with nulls as spaces, a digest of the text and ``times`` (1 if the column is missing)."""
    times = F.col("times") if "times" in rows.columns else F.lit(1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"), times.cast("int").alias("times"),
    )


def _marks(text: Column) -> Column:
    """``b`` for a blank text, ``t`` for a truncated one, ``k`` else."""
    visible = F.rtrim(text, F.lit(_SPACE))
    ends = F.substring(visible, -1, 1).isin(".", "!", "?")
    return F.when(F.length(visible) == 0, "b").when(ends, "k").otherwise("t")


_AUDITS = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)
_LEGAL = {"su", "ua", "au"}


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, from light rows in order. ``kind`` 0 names the conversation, 1 is the first place
    of a turn's role and text, 2 a turn."""
    schema = schema_of(_AUDITS)
    conv, state, out = None, None, []

    def fresh() -> dict:
        return {"classes": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "initial": None, "new": None,
                "low": None, "last": None, "turns": 0}

    def finish() -> None:
        s = state
        cost, audit = repair_of("".join(s["classes"]))
        gaps = s["last"] - s["low"] + 1 - s["turns"] if s["turns"] else 0
        out.append((conv, gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], cost, audit))

    for batch in batches:
        for conv_id, turn, role, digest, kind, mark, times in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or conv_id != conv:
                if state is not None:
                    finish()
                conv, state = conv_id, fresh()
            s = state
            if kind == 1:
                s["new"] = (turn, role, digest)
            if kind < 2 or not times:
                continue
            if turn is not None and turn != s["last"]:
                s["low"] = turn if s["low"] is None else s["low"]
                s["last"] = turn
                s["turns"] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            for _ in range(times):
                if s["initial"] is not None and s["initial"] + initial not in _LEGAL:
                    s["illegal"] += 1
                s["initial"] = initial
                first = s["new"] == (turn, role, digest)
                s["new"] = None
                if mark == "b" or not first:
                    s["blank" if mark == "b" else "duplicate"] += 1
                    s["classes"].append("x")
                else:
                    s["truncated"] += mark == "t"
                    s["classes"].append(initial.upper() if mark == "t" else initial)
        if out:
            yield batch_of(out, schema)
            out = []
    if state is not None:
        finish()
    if out:
        yield batch_of(out, schema)


# Ascending order puts nulls first.
_ORDER = ["conv_id", "turn", "role", "digest", "kind"]


def audits(rows: DataFrame) -> DataFrame:
    """Faults, cost and audit of every conversation of ``rows`` (conv_id, turn, role, text and, if given, times)."""
    turns = _as_turns(rows)
    light = turns.select("conv_id", "turn", "role", "digest", F.lit(2).alias("kind"), _marks(F.col("text")).alias("mark"), "times")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("mark", "string"), ("times", "int"))]
    # Copies of a turn become one row before they are shuffled; null turns come first.
    firsts = (
        light.filter("times > 0").groupBy("conv_id", "role", "digest")
        .agg(F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("turn"))
        .select("conv_id", F.when(~F.col("unnumbered"), F.col("turn")).alias("turn"), "role", "digest", F.lit(1).alias("kind"), *none)
    )
    every = light.unionByName(firsts).repartition("conv_id").sortWithinPartitions(*_ORDER)
    return every.mapInArrow(_audits, _AUDITS)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("begin", conv_id, values of the audit row) and ("turn", letter, role, text), from rows behind their audit;
    ("batch",) after every batch."""
    audit, place, state = "", 0, "-"

    def inserted() -> Iterator[tuple]:
        nonlocal place, state
        while place < len(audit) and audit[place] == "I":
            state, place = follow(state), place + 1
            yield "turn", "I", _ROLE[state], ""

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for conv_id, role, kind, text, times, *values in zip(*columns):
            if kind == 0:
                yield from inserted()
                yield "begin", conv_id, values
                audit, place, state = values[-1], 0, "-"
                continue
            for _ in range(times):
                yield from inserted()
                letter, place = audit[place], place + 1
                if letter == "K":
                    state = role[:1]
                elif letter == "R":
                    state = follow(state)
                    role = _ROLE[state]
                yield "turn", letter, role, text
        yield ("batch",)
    yield from inserted()


def _behind_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Turns with texts, in order, behind the row of ``audits`` of their conversation."""
    names = [c.split()[0] for c in _AUDITS.split(", ")][1:]
    kinds = [c.split()[1] for c in _AUDITS.split(", ")][1:]
    turns = _as_turns(rows).filter("times > 0").select(
        "conv_id", "turn", "role", "digest", F.lit(1).alias("kind"), "text", "times",
        *[F.lit(None).cast(t).alias(c) for c, t in zip(names, kinds)],
    )
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"))]
    heads = found.select("conv_id", *nothing, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("times"), *names)
    both = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return both.select("conv_id", "role", "kind", "text", "times", *names)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations; deleted ones are gone."""
    columns = "conv_id long, place long, edit string, role string, text string"
    schema = schema_of(columns)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, out = None, 0, []
        for event, *rest in _edited(batches):
            if event == "begin":
                conv, place = rest[0], 0
            elif event == "turn" and rest[0] != "D":
                out.append((conv, place, *rest))
                place += 1
            elif event == "batch" and out:
                yield batch_of(out, schema)
                out = []
        if out:
            yield batch_of(out, schema)

    return _behind_audits(rows, found).mapInArrow(edit, columns)


def digest_repaired(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and ``repaired_sha256`` (of the repaired ``role:text``, joined by newlines) of every conversation."""
    found = write_through(audits(rows))
    columns = _AUDITS + ", repaired_sha256 string"
    schema = schema_of(columns)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sha, any_, out = None, None, False, []

        def finish() -> None:
            if head is not None:
                out.append((*head, sha.hexdigest()))

        for event, *rest in _edited(batches):
            if event == "begin":
                finish()
                head, sha, any_ = (rest[0], *rest[1]), hashlib.sha256(), False
            elif event == "turn" and rest[0] != "D":
                sha.update(f"{chr(10) if any_ else ''}{rest[1]}:{rest[2]}".encode())
                any_ = True
            elif event == "batch" and out:
                yield batch_of(out, schema)
                out = []
        finish()
        if out:
            yield batch_of(out, schema)

    return _behind_audits(rows, found).mapInArrow(digest, columns)
