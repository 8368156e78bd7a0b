"""Chat formatting as prefix trees: turns that conversations begin with in common are written once.

Every turn becomes ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line break. Control strings inside
roles and texts are escaped: ``<|``, or ``<`` and backslashes and ``|``, gets one backslash more, so that no text can hold
``<|``; in roles backslashes and line breaks are escaped too, so that a role ends at the first line break. Both are undone on reading.

Conversations in order of their turns' digests are the leaves of the prefix tree in depth-first order: what a conversation
has in common with the one before it stands there already, and only its further turns are written, as nodes of
(sequence, number, depth). A node has the position of its first character in its conversation, its place in
the sequence, and as attention intervals the places of all its ancestors; its own characters attend to those and to
what is before them in the node. Places and positions are counted in code points. A leaf row names each conversation.

Scale: conversations are sorted by digests alone, with lengths, by ranges. A sequence is cut where it exceeds
``SEQUENCE_CHARS`` and at the end of a range, between conversations; the next one begins with its first
conversation's turns anew, so a first turn that a third of all conversations share is written once a sequence, and
no task holds a tree. Texts are shuffled to their conversation's layout and, for reading, to their sequence; both ways they
pass row by row. Reading keeps hash states, one for each turn of the path where a later conversation
branches off. The order of conversations regards their first ``SHARED`` turns and then the digest of all: equal
conversations of any length are merged whole, others up to that many turns; beyond, every turn is written for its own.

Defined cases: null roles and texts are empty; a null conv_id is a conversation of its own; null turns come first; turns of
equal number go by role, then by the digest of the text, and equal rows are all kept; texts of any length are one
row; conversations without rows don't exist; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import batch_of, schema_of
from pairloom.session import write_through

#: Characters after which a sequence ends, and what a conversation counts in there beside its own turns.
SEQUENCE_CHARS, LEAF_CHARS = 4_000_000, 64
#: Turns by whose digests conversations are put in order.
SHARED = 256
START, END = "<|im_start|>", "<|im_end|>\n"
_DIGEST = 16


# ------------------------------------------------------------------------------------ template


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def read_turn(formatted: str) -> tuple[str, str]:
    """The role and text of a formatted turn."""
    inner = formatted[len(START) : -len(END)]
    if not (formatted.startswith(START) and formatted.endswith(END)) or "<|" in inner:
        raise ValueError("this is not one formatted turn")
    role, text = inner.split("\n", 1)
    return _unescape_role(role), unescape(text)


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"),
        F.unhex(F.sha2(text, 256)).alias("digest"), _escape_role(role).alias("own"), escape(text).alias("escaped"),
    )
    formatted = F.concat(F.lit(START), "own", F.lit("\n"), "escaped", F.lit(END))
    header = F.when(F.col("role") == "assistant", F.length("own") + len(START) + 1)
    return rows.select("conv_id", "turn", "role", "digest", formatted.alias("formatted"), header.alias("loss_from"))


# -------------------------------------------------------------------------------------- layout

_RECORDS = "conv_id long, turns int, key binary, whole binary, lengths array<long>, total long"
_LAYOUT = (
    "conv_id long, sequence long, number long, shared int, branches int, place long, froms array<long>, tos array<long>"
)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from light rows in order: digests and lengths of its first turns, the digest of all."""
    schema = schema_of(_RECORDS)
    now, out = None, []

    def finish() -> None:
        conv, n, key, whole, lengths, total = now
        out.append((conv, n, b"".join(key), whole.digest(), lengths, total))

    for batch in batches:
        for conv_id, role, digest, length in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now[0] != conv_id:
                if now is not None:
                    finish()
                now = [conv_id, 0, [], hashlib.blake2b(digest_size=_DIGEST), [], 0]
            turn = hashlib.blake2b(digest + role.encode(), digest_size=_DIGEST).digest()
            if now[1] < SHARED:
                now[2].append(turn)
                now[4].append(length)
            now[3].update(turn)
            now[1] += 1
            now[5] += length
        if out:
            yield batch_of(out, schema)
            out = []
    if now is not None:
        finish()
        yield batch_of(out, schema)


def _common(one: tuple, two: tuple) -> int:
    """Turns that two conversations begin with in common, as far as their records show."""
    if one[1] == two[1] and one[3] == two[3]:
        return one[1]
    a, b = one[2], two[2]
    n = min(len(a), len(b)) // _DIGEST
    return next((k for k in range(n) if a[k * _DIGEST : (k + 1) * _DIGEST] != b[k * _DIGEST : (k + 1) * _DIGEST]), n)


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for a, b in runs:
        if found and found[-1][1] == a:
            found[-1] = (found[-1][0], b)
        else:
            found.append((a, b))
    return found


def _laid_out(batches: Iterator[pa.RecordBatch], sequence_chars: int, part: int) -> Iterator[pa.RecordBatch]:
    """The place of every conversation in the depth-first order, from sorted records."""
    schema = schema_of(_LAYOUT)
    sequence, number, size = part << 32, 0, 0
    before, path, tail, waiting, out = None, [], None, None, []
    for batch in batches:
        for record in zip(*(c.to_pylist() for c in batch.columns)):
            conv_id, turns, _, _, lengths, total = record
            if number and size + LEAF_CHARS * number >= sequence_chars:
                sequence, number, size, before = sequence + 1, 0, 0, None
            shared = _common(before, record) if before else 0
            if waiting:
                # The next conversation tells after how many turns of this one others branch off.
                out.append((*waiting[:4], shared, *waiting[4:]))
            copy = bool(before) and shared == turns == before[1]
            if not copy:
                path, tail = path[:shared], None
            ancestors = _merged(path + [tail] if tail else path)
            waiting = (conv_id, sequence, number, shared, size, [a for a, _ in ancestors], [b for _, b in ancestors])
            if shared < turns:
                for length in lengths[shared:]:
                    path.append((size, size + length))
                    size += length
                rest = total - sum(lengths)
                if rest:
                    tail, size = (size, size + rest), size + rest
            before, number = record, number + 1
        if out:
            yield batch_of(out, schema)
            out = []
    if waiting:
        yield batch_of([(*waiting[:4], 0, *waiting[4:])], schema)


def layout(turns: DataFrame, sequence_chars: int) -> DataFrame:
    """Where every conversation of ``_turns`` branches off and what it attends to, without its texts."""
    light = turns.select("conv_id", "turn", "role", "digest", F.length("formatted").cast("long").alias("length"))
    ordered = light.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    records = write_through(ordered.select("conv_id", "role", "digest", "length").mapInArrow(_records, _RECORDS))

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _laid_out(batches, sequence_chars, TaskContext.get().partitionId())

    sorted_ = records.repartitionByRange("key", "whole", "conv_id").sortWithinPartitions("key", "whole", "conv_id")
    # Sequences are numbered by task, so they are written before they are used.
    return write_through(sorted_.mapInArrow(lay_out, _LAYOUT))


# ----------------------------------------------------------------------------------------- nodes

_NODES = (
    "sequence long, number long, depth int, conv_id long, leaf boolean, branches boolean, place long, position long, "
    "froms array<long>, tos array<long>, formatted string, loss_from int, loss_to int"
)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes and the leaf of every conversation, from its rows behind its layout."""
    schema = schema_of(_NODES)
    head, depth, place, position, out = None, 0, 0, 0, []

    def attended() -> tuple[list[int], list[int]]:
        _, _, _, _, first, froms, tos = head
        if place == first:
            return froms, tos
        if tos and tos[-1] == first:
            return froms, [*tos[:-1], place]
        return [*froms, first], [*tos, place]

    def leaf() -> None:
        if head is not None:
            out.append((*head[:2], depth, conv, True, False, place, position, *attended(), None, None, None))

    for batch in batches:
        for conv_id, formatted, loss_from, *laid in zip(*(c.to_pylist() for c in batch.columns)):
            if formatted is None:
                leaf()
                # sequence, number, shared, branches, place, froms, tos
                conv, head, depth, position, place = conv_id, tuple(laid), 0, 0, laid[4]
                continue
            sequence, number, shared, branches, *_ = head
            if depth >= shared:
                loss_to = None if loss_from is None else len(formatted) - len(END)
                out.append(
                    (sequence, number, depth, None, False, depth < branches, place, position, *attended(), formatted, loss_from, loss_to)
                )
                place += len(formatted)
            position += len(formatted)
            depth += 1
        if out:
            yield batch_of(out, schema)
            out = []
    leaf()
    if out:
        yield batch_of(out, schema)


def format_conversations(conversations: DataFrame, sequence_chars: int = SEQUENCE_CHARS) -> DataFrame:
    """The prefix trees of all conversations, one row a node or leaf.

    ``place`` and ``position`` of a node are its first character's in the sequence and in the conversation, ``froms`` and
    ``tos`` the intervals of the sequence that its ancestors fill, ``loss_from`` and ``loss_to`` the code points of
    ``formatted`` under the loss mask (an assistant's text), ``branches`` whether another conversation goes on from
    there. Rows of a sequence are in depth-first order by (number, depth); a leaf's intervals are its conversation.
    """
    turns = _turns(conversations)
    laid = layout(turns, sequence_chars)
    names = [c.split()[0] for c in _LAYOUT.split(", ")][1:]
    kinds = [c.split()[1] for c in _LAYOUT.split(", ")][1:]
    rows = turns.select("*", F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in zip(names, kinds)])
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("formatted", "string"), ("loss_from", "int"))]
    heads = laid.select("conv_id", *nothing, F.lit(0).alias("kind"), *names)
    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return both.select("conv_id", "formatted", "loss_from", *names).mapInArrow(_nodes, _NODES)


# --------------------------------------------------------------------------------------- reading

_READ = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


class _State:
    """What has been read of a conversation so far."""

    def __init__(self):
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def copy(self) -> "_State":
        other = _State()
        other.turns, other.chars, other.loss_chars = self.turns, self.chars, self.loss_chars
        other.all, other.loss = self.all.copy(), self.loss.copy()
        return other

    def add(self, formatted: str, loss_from: int | None, loss_to: int | None) -> None:
        role, text = read_turn(formatted)
        self.all.update(f"{role}\n{text}\n".encode())
        if loss_from is not None:
            learnt = unescape(formatted[loss_from:loss_to])
            self.loss.update(learnt.encode())
            self.loss_chars += len(learnt)
        self.turns += 1
        self.chars += len(formatted)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = schema_of(_READ)
    now, sequence_now, saved, state, out = None, None, [], _State(), []
    for batch in batches:
        for sequence, number, depth, conv_id, leaf, branches, position, froms, tos, formatted, *loss in zip(*(c.to_pylist() for c in batch.columns)):
            if sequence != sequence_now:
                sequence_now, saved = sequence, [_State()]
            if (sequence, number) != now:
                now = sequence, number
                # ``depth`` turns are there from earlier conversations.
                del saved[depth + 1 :]
                state = saved[depth].copy()
            if position != state.chars or sum(tos) - sum(froms) != position:
                raise ValueError(f"sequence {sequence}: a node does not attend to its ancestors")
            if leaf:
                out.append((conv_id, state.turns, state.all.hexdigest(), state.loss_chars, state.loss.hexdigest(), state.chars))
                continue
            state.add(formatted, *loss)
            if branches:
                saved.append(state.copy())
        if out:
            yield batch_of(out, schema)
            out = []


def digest_conversations(nodes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, read from its
    sequence along the nodes it attends to."""
    columns = "sequence number depth conv_id leaf branches position froms tos formatted loss_from loss_to".split()
    ordered = nodes.select(columns).repartition("sequence").sortWithinPartitions("sequence", "number", "depth", "leaf")
    return ordered.mapInArrow(_read, _READ)


def read_conversations(nodes: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, learnt): the turns of all conversations, read back."""
    columns = "conv_id long, place int, role string, text string, learnt boolean"
    schema = schema_of(columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[tuple[int, str, str, bool]] = []
        now = None
        for batch in batches:
            for sequence, depth, conv_id, leaf, formatted, loss_from in zip(*(c.to_pylist() for c in batch.columns)):
                if sequence != now:
                    now, path = sequence, []
                del path[depth:]
                if leaf:
                    if path:
                        yield batch_of([(conv_id, *turn) for turn in path], schema)
                else:
                    path.append((depth, *read_turn(formatted), loss_from is not None))

    ordered = nodes.select("sequence", "number", "depth", "conv_id", "leaf", "formatted", "loss_from")
    ordered = ordered.repartition("sequence").sortWithinPartitions("sequence", "number", "depth", "leaf")
    return ordered.select("sequence", "depth", "conv_id", "leaf", "formatted", "loss_from").mapInArrow(read, columns)
