"""Language identification with averaged subword embeddings.

A text is represented by the average embedding of its subwords: all windows of two to four characters of every
run of letters, with its two borders, in lower case, hashed to a fixed number of rows. A linear softmax on the average
gives the languages. Embeddings and softmax are trained together by stochastic gradient descent in numpy, on the driver,
with the labelled texts of a sample: at most ``SAMPLE`` of them, and no more than fit ``SAMPLE_CHARS`` characters, whole
texts each, dealt evenly to all languages, each cut into snippets that together are the whole text. A fifth of the sampled documents is kept apart to calibrate: a
temperature that makes the probabilities honest, and a least probability that all but ``REJECTED`` of them reach
(a conformal bound on the share of documents rejected). A prediction below that is marked as rejected.

Scale: prediction is one pass without a shuffle over whole texts; the model has a fixed size. Equal words of a step are
looked up once. Choosing the sample reads ids and languages only, then the sampled texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; where no row may be learnt
from (an empty table gives no rows), every text is ``und`` with score 0, but only those without a letter are rejected; ties go to the first language in alphabetical order; repeated rows are predicted alike; a null
doc_id is neither learnt from nor held out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import steps
from pairloom.llm.spans import distinct, words
from pairloom.session import write_through

#: Documents that are learnt from at most.
SAMPLE = 1500
#: Characters of the sample, which the driver holds: it ends before the first document beyond them, but has one at least.
SAMPLE_CHARS = 100_000_000
#: Rows and numbers of the embedding.
ROWS, SIZE = 1 << 16, 12  # a row number fits two bytes
#: Longest snippet in words, training passes and examples of a step.
SNIPPET, EPOCHS, BATCH, RATE = 30, 3, 32, 0.5
#: Share of documents like the calibrated ones that may be rejected.
REJECTED = 0.005

#: Characters looked at together, which bounds a task's memory.
STEP_CHARS = 300_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_letters: dict[int, bool] = {}


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def probabilities(self, averages: np.ndarray) -> np.ndarray:
        return _softmax(averages @ self.weights / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def subwords(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece) of every subword of some strings, and the letters of each string."""
    lowered = [p.lower() for p in pieces]
    points = np.frombuffer((" " + " ".join(lowered) + "    ").encode("utf-32-le"), np.uint32)
    kinds, place = np.unique(points, return_inverse=True)
    for k in kinds.tolist():
        if k not in _letters:
            _letters[k] = chr(k).isalpha()
    letter = np.array([_letters[k] for k in kinds.tolist()])[place]
    points = np.where(letter, points, 32).astype(np.uint64)
    owner = np.repeat(np.arange(len(pieces)), [len(p) + 1 for p in lowered])
    n = len(owner)
    rows, owners = [], []
    value = points[:n].copy()
    for size in range(2, 5):
        value = value * _MIX + points[size - 1 : n + size - 1] * np.uint64(2 * size + 1)
        inside = letter[:n] | letter[1 : n + 1] if size == 2 else np.ones(n, bool)
        for k in range(1, size - 1):
            inside = inside & letter[k : n + k]
        at = np.flatnonzero(inside)
        rows.append(((value[at] * _MIX) >> np.uint64(48)).astype(np.int64) % ROWS)
        owners.append(owner[at])
    letters = np.bincount(owner[letter[:n]], minlength=len(pieces))
    return np.concatenate(rows), np.concatenate(owners), letters


def _sums(values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of ``values`` by owner."""
    out = np.empty((n, values.shape[1]))
    for k in range(values.shape[1]):
        out[:, k] = np.bincount(owners, values[:, k], minlength=n)
    return out


def averages(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The average embedding of each whole text, and its number of letters."""
    raw, first, last, counts = words(texts)
    if not len(first):
        return np.zeros((len(texts), SIZE)), np.zeros(len(texts), np.int64)
    codes, sample = distinct(raw, first, last)
    view = raw.tobytes()
    pieces = [view[a:b].decode() for a, b in zip(first[sample].tolist(), last[sample].tolist())]
    rows, owners, letters = subwords(pieces)
    sums = np.column_stack(
        [_sums(model.embedding[rows], owners, len(pieces)), np.bincount(owners, minlength=len(pieces)), letters]
    )
    text = np.repeat(np.arange(len(texts)), counts)
    totals = _sums(sums[codes], text, len(texts))
    return totals[:, :SIZE] / np.maximum(totals[:, SIZE:-1], 1), totals[:, -1].astype(np.int64)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model | None:
    """Learn from labelled texts; every fifth one calibrates."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    model = Model(languages, rng.normal(0, 0.1, (ROWS, SIZE)).astype(np.float32), np.zeros((SIZE, len(languages))))
    answer = {language: k for k, language in enumerate(languages)}
    snippets, targets, kept = [], [], []
    for k, (text, label) in enumerate(zip(texts, labels)):
        if k % 5 == 4:
            kept.append(k)
            continue
        parts = text.split()
        for start in range(0, len(parts), SNIPPET):
            snippets.append(" ".join(parts[start : start + SNIPPET]))
            targets.append(answer[label])
    _descend(model, snippets, np.array(targets), rng)
    _calibrate(model, [texts[k] for k in kept], np.array([answer[labels[k]] for k in kept], int))
    return model


def _descend(model: Model, snippets: list[str], targets: np.ndarray, rng) -> None:
    if not snippets:
        return
    parts, counts = [], []
    for low in range(0, len(snippets), 2000):  # only rows and counts of all snippets are held at once
        some = snippets[low : low + 2000]
        found, owners, _ = subwords(some)
        parts.append(found[np.argsort(owners, kind="stable")].astype(np.uint16))
        counts.append(np.bincount(owners, minlength=len(some)))
    rows, sizes = np.concatenate(parts), np.concatenate(counts)
    starts = np.cumsum(sizes) - sizes
    # Every language weighs the same, however many snippets it has.
    per_language = np.bincount(targets, minlength=len(model.languages))
    weight = len(targets) / (len(model.languages) * per_language[targets])
    total, done = EPOCHS * len(snippets), 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(snippets))
        for low in range(0, len(shuffled), BATCH):
            batch = shuffled[low : low + BATCH]
            batch = batch[sizes[batch] > 0]
            if not len(batch):
                continue
            rate = RATE * (1 - done / total)
            done += len(batch)
            n = sizes[batch]
            example = np.repeat(np.arange(len(batch)), n)
            used = rows[np.arange(n.sum()) + np.repeat(starts[batch] - (np.cumsum(n) - n), n)]
            hidden = _sums(model.embedding[used], example, len(batch)) / n[:, None]
            error = _softmax(hidden @ model.weights)
            error[np.arange(len(batch)), targets[batch]] -= 1
            error *= np.minimum(weight[batch], 5.0)[:, None]
            # A subword has one n-th part in its average, so it takes steps for all examples of the batch.
            back = error @ model.weights.T * (rate * 4 / n[:, None])
            model.weights -= rate * hidden.T @ error / len(batch)
            touched, place = np.unique(used, return_inverse=True)
            model.embedding[touched] -= _sums(back[example], place, len(touched)).astype(np.float32)


def _calibrate(model: Model, texts: list[str], targets: np.ndarray) -> None:
    if not texts:
        return
    hidden, letters = averages(model, texts)
    hidden, targets = hidden[letters > 0], targets[letters > 0]
    if not len(targets):
        return

    def loss(temperature: float) -> float:
        p = _softmax(hidden @ model.weights / temperature)[np.arange(len(targets)), targets]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    model.temperature = min((float(t) for t in np.geomspace(0.05, 20, 80)), key=loss)
    # At most REJECTED of exchangeable documents fall below the score of this rank.
    scores = np.sort(model.probabilities(hidden).max(axis=1))
    rank = int(REJECTED * (len(scores) + 1))
    model.least = float(scores[rank - 1]) if rank else 0.0


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    if model is None or not texts:
        no_letter = [not any(map(str.isalpha, t or "")) for t in texts]
        return ["und"] * len(texts), np.zeros(len(texts)), np.array(no_letter, bool)
    names, scores = [], []
    for low, high in steps([t or "" for t in texts], STEP_CHARS):
        hidden, letters = averages(model, [t or "" for t in texts[low:high]])
        p = model.probabilities(hidden)
        best = p.argmax(axis=1)
        names += [model.languages[k] if n else "und" for k, n in zip(best.tolist(), letters.tolist())]
        scores.append(np.where(letters > 0, p.max(axis=1), 0.0))
    score = np.clip(np.concatenate(scores), 0.0, 1.0)
    return names, score, (score < model.least) | np.array([n == "und" for n in names])


def _within(drawn: DataFrame, most: int) -> list:
    """The rows of least mark whose texts together have at most ``most`` characters, but one at least."""
    sizes = drawn.select("mark", F.xxhash64("text").alias("hash"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    sizes = sorted(tuple(r) for r in sizes.collect())
    fit = max(1, int(np.searchsorted(np.cumsum([n for *_, n in sizes]), most, side="right")))
    return drawn.orderBy("mark", F.xxhash64("text")).limit(fit).collect()


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Model | None:
    """Train on a sample of the rows for which ``learn`` holds and lang is not null.

    The sample is the rows of least mark: a hash of the id, stretched by the number of rows in the language, so
    that every language has about the same part of it.
    """
    labelled = docs.filter(learn & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    # With more languages than the sample has rows, the most frequent ones have a row each.
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample)
    sizes = {r["lang"]: r["n"] for r in sizes.collect()}
    if not sizes:
        return None
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("lang")]
    mark = (F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5) * size
    marked = labelled.withColumn("mark", mark).filter("mark IS NOT NULL")
    least = [r["mark"] for r in marked.select("mark").orderBy("mark").limit(sample).collect()]
    rows = _within(write_through(marked.filter(F.col("mark") <= max(least)).limit(sample)), SAMPLE_CHARS) if least else []
    rows.sort(key=lambda r: (r["mark"], r["doc_id"], r["text"] or ""))
    return train([r["text"] or "" for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, rejected = predict(shared.value, batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    schema = "doc_id long, lang_pred string, score double, rejected boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predicted, schema)


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, rejected = predict(shared.value, batch.column(text).to_pylist())
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(kept, docs.schema)
