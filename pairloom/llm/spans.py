"""Words and pieces of many texts at once, as places in one buffer of bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash

# The white space of words.
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Slices of more bytes are hashed and compared one by one, the others eight bytes at a time.
_LONG = 512
#: Masks of the lowest 0 to 8 bytes of a number.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _numbers(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of ``raw`` on, as one number."""
    padded = np.append(raw, np.zeros(8, np.uint8))
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every slice, the same wherever it stands."""
    lengths = last - first
    numbers = _numbers(raw)
    found = _scramble(lengths.astype(np.uint64) + _ODD)
    at = np.flatnonzero(lengths <= _LONG)
    for done in range(0, _LONG, 8):
        at = at[lengths[at] > done]
        if not len(at):
            break
        part = numbers[first[at] + done] & _MASK[np.minimum(lengths[at] - done, 8)]
        found[at] = _scramble((found[at] ^ part) * _ODD)
    for k in np.flatnonzero(lengths > _LONG).tolist():
        found[k] = xxhash.xxh3_64_intdigest(raw[first[k] : last[k]])
    return found


def _equal(raw: np.ndarray, first: np.ndarray, last: np.ndarray, others: np.ndarray) -> bool:
    """Whether every slice has the bytes of the slice number ``others``."""
    lengths = last - first
    if (lengths != lengths[others]).any():
        return False
    numbers = _numbers(raw)
    at = np.flatnonzero((lengths <= _LONG) & (others != np.arange(len(others))))
    for done in range(0, _LONG, 8):
        at = at[lengths[at] > done]
        if not len(at):
            break
        differing = numbers[first[at] + done] ^ numbers[first[others[at]] + done]
        if (differing & _MASK[np.minimum(lengths[at] - done, 8)]).any():
            return False
    return all(
        np.array_equal(raw[first[k] : last[k]], raw[first[others[k]] : last[others[k]]])
        for k in np.flatnonzero(lengths > _LONG).tolist()
    )


def _samples(codes: np.ndarray) -> np.ndarray:
    """The first slice of each class."""
    sample = np.zeros(codes.max() + 1 if len(codes) else 0, np.int64)
    sample[codes[::-1]] = np.arange(len(codes))[::-1]
    return sample


def distinct(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For slices of ``raw``: the number of each one's class of equal slices, and one slice of each class.

    Classes come from hashes, and the bytes of every slice are compared with those of its class.
    """
    codes, _ = pd.factorize(hashes(raw, first, last))
    sample = _samples(codes)
    if not _equal(raw, first, last, sample[codes]):  # two different slices share a hash
        codes, _ = pd.factorize(np.array([raw[a:b].tobytes() for a, b in zip(first, last)], object))
        sample = _samples(codes)
    return codes, sample


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts with A-Z in lower case: a buffer, the first and last place of each word, and
    the number of words of each text. Words are what white space (space, tab to carriage return) leaves."""
    parts = [t.encode() for t in texts]
    raw = np.frombuffer(b"\n".join(parts).lower() + b"\n", np.uint8)
    space = _SPACES[raw]
    before = np.append(True, space[:-1])
    first = np.flatnonzero(before & ~space)
    last = np.flatnonzero(space & ~before)
    ends = np.cumsum([len(p) + 1 for p in parts])
    counts = np.diff(np.append(0, np.searchsorted(first, ends))) if parts else np.zeros(0, np.int64)
    return raw, first, last, counts
