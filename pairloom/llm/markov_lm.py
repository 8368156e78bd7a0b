"""A hidden Markov language model, learnt by Baum-Welch over all training texts.

A text is the sequence of its words and one end. Hidden states follow a Markov chain; a state emits a word class,
and a class its word: P(word | state) = P(class | state) P(word | class). The class is a hash of the word, so
states, chain and class emissions have a fixed size whatever the vocabulary (``STATES`` x ``CLASSES``), while
P(word | class) is counted for every distinct word of the corpus: (c + 1/2) / (C + (V + 1) / 2) with the count c of
the word and the tokens C and distinct words V of its class, where one more word stands for all that were never seen.

Training: every partition runs scaled forward and backward recursions over its training texts and adds up
expected counts; the sums over partitions make the next model (``ROUNDS`` times). Expected counts travel as integers,
so their sums do not depend on the order of addition. The texts of a block are recursed side by side, each from its
first word to its end, so every transition is counted. Scoring is exact too: one scaled forward recursion from the first word to the end of every whole text.

Scale: texts are read once, into blocks of about ``BLOCK_CHARS`` characters held as numbers, beside the training texts'
classes in the order of the recursions. The distinct words of a block meet those of all blocks in one shuffle by word,
and go back to their block as (place, count); so what is shuffled is the distinct words of blocks, not the tokens, and a
word that every text holds has one row a block. Blocks are never collected: the driver sees sums of fixed size.

Defined cases: a null text counts as empty, that is one end; rows with a null doc_id are scored, not learnt from, and
their held_out is null; repeated rows count and are scored row by row; with nothing to learn from, the model is
uniform and train_tokens is 0; a text longer than a block is a block of its own, so a task holds the longest text; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.llm.common import crc32_bucket
from pairloom.llm.spans import distinct, hashes, words
from pairloom.session import write_through

STATES, CLASSES, ROUNDS = 8, 1 << 14, 4
#: Characters of a block, and tokens that are recursed together.
BLOCK_CHARS, GROUP_TOKENS = 6_000_000, 500_000
#: Fixed point of expected counts.
_UNIT = 1 << 20


# ---------------------------------------------------------------------------------------- blocks

# Three kinds of rows: a block (doc_ids to classes), a group of its training texts (active, learnt), a word.
_ROWS = pa.schema(
    [
        ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())),
        ("tokens", pa.binary()), ("classes", pa.binary()), ("active", pa.binary()), ("learnt", pa.binary()),
        ("place", pa.int32()), ("word", pa.string()), ("count", pa.int64()), ("class", pa.int32()),
    ]
)
_BLOCK = (
    "block long, doc_ids array<long>, held array<boolean>, lengths array<long>, tokens binary, classes binary, active binary, "
    "learnt binary, place int, word string, count long, class int"
)


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ROWS]
    return pa.RecordBatch.from_arrays(arrays, schema=_ROWS)


def _number(block_texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Texts as places in the block's distinct words, place 0 being the end: lengths, tokens, and of each place the class
    and the word. White space is in no word, so a space stands for the end."""
    raw, first, last, counts = words(block_texts)
    codes, sample = distinct(raw, first, last)
    # Words and the gaps between them, as one array of strings.
    edges = np.column_stack([first, last]).astype("<i4").ravel()
    every = pa.Array.from_buffers(pa.string(), max(0, len(edges) - 1), [None, pa.py_buffer(edges), pa.py_buffer(raw)])
    names = pa.concat_arrays([pa.array([" "]), every.take(pa.array(2 * sample))])
    classes = np.append(CLASSES, hashes(raw, first[sample], last[sample]) % np.uint64(CLASSES)).astype("<u2")
    lengths = counts + 1
    tokens = np.zeros(int(lengths.sum()), "<i4")
    is_word = np.ones(len(tokens), bool)
    is_word[np.cumsum(lengths) - 1] = False
    tokens[is_word] = codes + 1
    return lengths, tokens, classes, names


def _block_rows(number: int, ids: list, texts: list[str], held: list) -> Iterator[pa.RecordBatch]:
    lengths, tokens, classes, names = _number(texts)
    learnt = np.array([h is False for h in held], bool)
    inside = np.repeat(learnt, lengths)
    counts = np.bincount(tokens[inside], minlength=len(classes))
    pack = zstandard.ZstdCompressor(level=1).compress
    yield _rows(
        block=pa.array([number]), doc_ids=pa.array([ids], pa.list_(pa.int64())), held=pa.array([held], pa.list_(pa.bool_())),
        lengths=pa.array([lengths.tolist()]), tokens=pa.array([pack(tokens.tobytes())]), classes=pa.array([classes.tobytes()]),
    )
    known = classes[tokens[inside]]
    for _, active, at in recursed(lengths[learnt]):
        yield _rows(block=pa.array([number]), active=pa.array([active.astype("<i4").tobytes()]), learnt=pa.array([known[at].tobytes()]))
    n = len(classes)
    yield _rows(
        block=pa.array(np.full(n, number)), place=pa.array(np.arange(n, dtype=np.int32)), word=names,
        count=pa.array(counts), **{"class": pa.array(classes.astype(np.int32))},
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = itertools.count(TaskContext.get().partitionId() << 32)
    ids, texts, held, size = [], [], [], 0
    for batch in batches:
        for doc_id, text, out in zip(*(c.to_pylist() for c in batch.columns)):
            ids.append(doc_id)
            texts.append(text or "")
            held.append(out)
            size += len(text or "") + 1
            if size >= BLOCK_CHARS:
                yield from _block_rows(next(numbers), ids, texts, held)
                ids, texts, held, size = [], [], [], 0
    if ids:
        yield from _block_rows(next(numbers), ids, texts, held)


def blocks(docs: DataFrame, modulus: int = 5, out: int = 1) -> DataFrame:
    """The texts as blocks of numbers; documents whose crc32 leaves ``out`` are held out of training.

    Block numbers are those of the tasks that make them, so blocks have to be written before they are used.
    """
    held = crc32_bucket(F.col("doc_id"), modulus) == out
    return docs.select(F.col("doc_id").cast("long"), "text", held.alias("held")).mapInArrow(_blocks, _BLOCK)


# ---------------------------------------------------------------------------------------- model


@dataclass
class Model:
    """``first``: states of a first word; ``share``: of any word; ``chain`` [from, to]; ``emit`` [class, state]."""

    first: np.ndarray
    share: np.ndarray
    chain: np.ndarray
    emit: np.ndarray

    @staticmethod
    def start(tokens: np.ndarray, seed: int = 11) -> "Model":
        """States that keep to themselves, around the classes' overall frequencies."""
        rng = np.random.default_rng(seed)
        even = np.full(STATES, 1 / STATES)
        chain = 0.9 * np.eye(STATES) + 0.1 / STATES
        emit = (tokens + 0.1)[:, None] * np.exp(0.5 * rng.standard_normal((CLASSES + 1, STATES)))
        return Model(even, even, chain, emit / emit.sum(axis=0))

    @staticmethod
    def of(counts: np.ndarray, tokens: np.ndarray) -> "Model":
        """The model of expected counts: class rows, then STATES rows of the chain, then the first words' row."""
        emit = counts[: CLASSES + 1] + 0.01 * ((tokens + 0.1) / (tokens + 0.1).sum())[:, None] * STATES
        chain = counts[CLASSES + 1 : -1] + 0.1
        first, share = counts[-1] + 0.1, counts[: CLASSES + 1].sum(axis=0) + 0.1
        normal = lambda x: x / x.sum(axis=-1, keepdims=True)
        return Model(normal(first), normal(share), normal(chain), emit / emit.sum(axis=0))


def recursed(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences in groups of about ``GROUP_TOKENS``, from the longest to the shortest: their numbers, how many of
    them have a token at each place, and where the tokens stand, first places first."""
    order = np.argsort(-lengths, kind="stable")
    starts, ends = np.cumsum(lengths) - lengths, np.cumsum(lengths[order])
    for part in np.split(order, np.flatnonzero(np.diff(ends // GROUP_TOKENS)) + 1):
        n = lengths[part]
        if not n.sum():
            continue
        active = len(n) - np.searchsorted(n[::-1], np.arange(n[0]), side="right")
        offsets = np.cumsum(active) - active
        time = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.empty(len(time), np.int64)
        at[offsets[time] + np.repeat(np.arange(len(n)), n)] = time + np.repeat(starts[part], n)
        yield part, active, at


def _forward(first: np.ndarray, chain: np.ndarray, emitted: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities of all places, and their scales."""
    alpha, scales = np.empty_like(emitted), np.empty(len(emitted), emitted.dtype)
    ones = np.ones(STATES, emitted.dtype)
    before, at = None, 0
    for n in active.tolist():
        now, scale, here = alpha[at : at + n], scales[at : at + n], emitted[at : at + n]
        if before is None:
            np.multiply(here, first, out=now)
        else:
            np.dot(before[:n], chain, out=now)
            now *= here
        np.dot(now, ones, out=scale)
        now /= scale[:, None]
        before, at = now, at + n
    return alpha, scales


def expected_of(model: Model, active: np.ndarray, classes: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """Expected counts of a group laid out by ``recursed``, as ``Model.of`` takes them; recursions are of the given ``kind``."""
    counts = np.zeros((CLASSES + 1 + STATES + 1, STATES))
    chain = model.chain.astype(kind)
    back = np.ascontiguousarray(chain.T)
    emitted = model.emit.astype(kind)[classes]
    alpha, scales = _forward(model.first.astype(kind), chain, emitted, active)
    emitted /= scales[:, None]
    moved, sizes = np.zeros((STATES, STATES)), active.tolist()
    at = len(classes) - sizes[-1]
    behind = emitted[at:]
    for n in sizes[-2::-1]:
        to, at, m = at, at - n, len(behind)
        now, here = alpha[at : at + m], emitted[at:to]
        moved += np.dot(now.T, behind)
        beta = np.dot(behind, back)
        now *= beta  # these are the expected states now; beta is 1 where a sequence ends
        here[:m] *= beta
        behind = here
    for k in range(STATES):
        counts[: CLASSES + 1, k] = np.bincount(classes, alpha[:, k], minlength=CLASSES + 1)
    counts[CLASSES + 1 : -1] = moved * chain
    counts[-1] = alpha[: sizes[0]].sum(axis=0)
    return counts


def expected(model: Model, lengths: np.ndarray, classes: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """Expected counts of some texts, one behind the other."""
    counts = np.zeros((CLASSES + 1 + STATES + 1, STATES))
    for _, active, at in recursed(lengths):
        counts += expected_of(model, active, classes[at], kind)
    return counts


def likelihoods(model: Model, lengths: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Log10 probability of each sequence of classes, by one scaled forward recursion."""
    total = np.zeros(len(lengths))
    for part, active, at in recursed(lengths):
        _, scales = _forward(model.first, model.chain, model.emit[classes[at]], active)
        rank = np.concatenate([np.arange(n) for n in active.tolist()])
        total[part] = np.bincount(rank, np.log10(scales), minlength=len(part))
    return total


# ---------------------------------------------------------------------------------------- jobs


def counted(written: DataFrame) -> DataFrame:
    """(block, place, c, kind): the training tokens of every word of every block, 0 for words that only held-out texts
    have. ``kind`` is the class in one row of each word that was learnt, and else null."""
    by_word = Window.partitionBy("word")
    pairs = written.filter("word IS NOT NULL").select("block", "place", "word", "count", "class")
    found = pairs.select(
        "block", "place", F.sum("count").over(by_word).alias("c"), "class", (F.col("block") == F.min("block").over(by_word)).alias("once")
    )
    return found.select("block", "place", "c", F.when(F.col("once") & (F.col("c") > 0), F.col("class")).alias("kind"))


def _round(written: DataFrame, model: Model) -> np.ndarray:
    """Expected counts over all training texts."""
    shared = written.sparkSession.sparkContext.broadcast(model)  # of fixed size
    names = [f"s{k}" for k in range(STATES)]
    schema = pa.schema([("row", pa.int32()), *((n, pa.int64()) for n in names)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES + 1 + STATES + 1, STATES))
        for batch in batches:
            for active, learnt in zip(*batch.columns):
                active, learnt = (np.frombuffer(x.as_buffer(), t) for x, t in ((active, "<i4"), (learnt, "<u2")))
                total += expected_of(shared.value, active, learnt, np.float32)
        rows = np.flatnonzero(total.any(axis=1))
        fixed = np.rint(total[rows] * _UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(c) for c in fixed.T)], schema=schema)

    found = written.filter("learnt IS NOT NULL").select("active", "learnt").mapInArrow(
        count, "row int, " + ", ".join(f"{n} long" for n in names)
    )
    # In two halves, whose sums no number of tasks can make overflow.
    halves = [F.sum(F.shiftright(n, 32)) for n in names] + [F.sum(F.col(n).bitwiseAND((1 << 32) - 1)) for n in names]
    counts = np.zeros((CLASSES + 1 + STATES + 1, STATES))
    # One row for each class and state.
    for row in found.groupBy("row").agg(*halves).collect():
        counts[row[0]] = np.array(row[1 : 1 + STATES], float) * 2.0**32 + np.array(row[1 + STATES :], float)
    return counts / _UNIT


@dataclass
class Trained:
    model: Model
    tokens: np.ndarray
    types: np.ndarray
    total: int
    distinct: int


def train(written: DataFrame, words_: DataFrame, rounds: int = ROUNDS) -> Trained:
    """Learn the model from the training texts of all blocks."""
    tokens, types = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    # One row for each class.
    for class_, n in written.filter("word IS NOT NULL").groupBy("class").agg(F.sum("count")).collect():
        tokens[class_] = n
    for class_, n in words_.filter("kind IS NOT NULL").groupBy("kind").count().collect():
        types[class_] = n
    model = Model.start(tokens)
    for _ in range(rounds):
        model = Model.of(_round(written, model), tokens)
    return Trained(model, tokens, types, int(tokens.sum()), int(types.sum()))


_SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score(written: DataFrame, words_: DataFrame, trained: Trained) -> DataFrame:
    """Both scores of every document."""
    shared = written.sparkSession.sparkContext.broadcast(trained)  # of fixed size
    names = [c.split()[0] for c in _SCORES.split(", ")]

    def scored(block: pa.Table, known: pa.Table) -> pa.Table:
        t: Trained = shared.value
        ids, held, lengths = (block[c].combine_chunks().flatten() for c in ("doc_ids", "held", "lengths"))
        lengths = lengths.to_numpy()
        classes = np.frombuffer(block["classes"][0].as_buffer(), "<u2")
        tokens = np.frombuffer(zstandard.ZstdDecompressor().decompress(block["tokens"][0].as_buffer()), "<i4")
        c = np.empty(len(classes))
        c[known["place"].to_numpy()] = known["c"].to_numpy()
        base = np.log10((c + 0.5) / (t.total + 0.5 * (t.distinct + 1)))
        inside = np.log10((c + 0.5) / (t.tokens[classes] + 0.5 * (t.types[classes] + 1)))
        starts = np.cumsum(lengths) - lengths
        add = lambda values: np.add.reduceat(values[tokens], starts)
        columns = [
            ids, held, pa.array(lengths), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(ids), t.total, np.int64)),
            pa.array(add(base)), pa.array(likelihoods(t.model, lengths, classes[tokens]) + add(inside)),
        ]
        return pa.table(columns, names)

    rows = written.filter("tokens IS NOT NULL").select("block", "doc_ids", "held", "lengths", "tokens", "classes")
    places = words_.select("block", "place", "c")
    return rows.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(scored, _SCORES)


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Train on the documents that are not held out and score all."""
    written = write_through(blocks(docs))
    words_ = write_through(counted(written))
    return score(written, words_, train(written, words_, rounds))
