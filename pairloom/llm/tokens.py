"""Token ids of whole texts with a vocabulary file of the ``tokenizers`` library.

The library's byte-level pattern always breaks a text between a non-space and a space, between an ASCII letter and
punctuation, and after a lone line break. A text is therefore cut there; each distinct piece is encoded by the library
once and remembered, and the ids of a text are those of its pieces in order. Equal pieces of a step are found by
``spans.distinct``. Texts whose white space would be cut wrongly that way (a space between other white space), and texts
that hold the content of one of the vocabulary's added tokens, go through the library whole. Results are those of
``encode`` of the library as it is loaded, without special tokens added.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

from pairloom.llm.common import Recent
from pairloom.llm.spans import distinct

#: A space inside a run of white space that does not end it, or one that ends the text in a run.
_ODD = re.compile(r"\s (?!\S)")
#: Pieces that the pattern leaves whole for certain: Latin letters, with a space before them or not.
_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: Pieces that the library is given as one text.
_TOGETHER = 256

#: What a byte is: a letter, punctuation, a space, a line end, or any visible ASCII character.
_LETTER, _PUNCTUATION, _SPACE, _LINE, _PLAIN = (np.uint8(1 << k) for k in range(5))
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _PLAIN
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] |= _LETTER
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] |= _PUNCTUATION
_KIND[[0x20, 0x0A]] = _SPACE, _LINE

_encoders: dict[str, "Encoder"] = {}


def encode_by_pieces(
    texts: list[str], whole: Callable[[list[str]], list[bytes]], pieces: Recent, added: re.Pattern | None = None
) -> list[bytes]:
    """Ids of texts that are cut into pieces: ``pieces`` knows the ids of a piece (as UTF-8), ``whole`` encodes
    texts that must not be cut, among them those that hold what ``added`` finds."""
    odd = [k for k, t in enumerate(texts) if _ODD.search(t) or (added and added.search(t))]
    parts = [t.encode() for t in texts]
    for k in odd:
        parts[k] = b""
    view = b"".join(parts)
    raw = np.frombuffer(view, np.uint8)
    stops = np.cumsum([0, *map(len, parts)])
    kind = _KIND[raw]
    begins = kind & _SPACE
    begins[1:] |= kind[:-1] & _LETTER & (kind[1:] >> np.uint8(1))
    begins[2:] |= (kind[:-2] & _PLAIN) & (kind[1:-1] << np.uint8(1)) & kind[2:]
    begins[stops[:-1][stops[:-1] < len(raw)]] = _SPACE
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(raw))[: len(first)]
    made: list[bytes] = [b""] * len(texts)
    if len(first):
        codes, sample = distinct(raw, first, last)
        keys = [view[a:b] for a, b in zip(first[sample].tolist(), last[sample].tolist())]
        pool = pieces.values(keys)
        ids = np.frombuffer(b"".join(pool), "<u4")
        sizes = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        lengths = sizes[codes]
        ends = np.append(0, np.cumsum(lengths))
        at = np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], lengths)
        at += np.arange(len(at))
        found = ids[at].tobytes()
        cuts = (4 * ends[np.searchsorted(first, stops)]).tolist()
        made = [found[a:b] for a, b in zip(cuts, cuts[1:])]
    for k, ids in zip(odd, whole([texts[k] for k in odd]) if odd else ()):
        made[k] = ids
    return made


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task per core
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        contents = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, contents))) if contents else None
        # The same model behind a pattern that breaks at line ends alone, for pieces that are words already.
        self.of_words = Tokenizer.from_file(path)
        self.of_words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        size = self.library.get_vocab_size()
        # In a byte-level vocabulary every character of a token stands for one byte.
        self.width = np.array([len(self.library.id_to_token(i) or "") for i in range(size)], np.int64)
        self.character = _byte_characters()
        self.pieces = Recent(self._encode_pieces)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        made: dict[bytes, bytes] = {}
        texts = [p.decode() for p in pieces]
        plain = [p for p, text in zip(pieces, texts) if _WORD.fullmatch(text)]
        groups = [plain[i : i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
        spelt = lambda g: self.character[np.frombuffer(b"\n".join(g), np.uint8)].tobytes().decode("utf-32-le")
        lines = [spelt(g) for g in groups]
        for group, found in zip(groups, self.of_words.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            stops = np.cumsum([*map(len, group)])
            cuts = [0, *(4 * (np.searchsorted(np.cumsum(self.width[ids]), stops) + 1)).tolist()]
            raw = ids.tobytes()
            made.update(zip(group, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        rest = [(p, text) for p, text in zip(pieces, texts) if p not in made]
        made.update(zip([p for p, _ in rest], self.whole([text for _, text in rest])))
        return [made[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        return encode_by_pieces(texts, self.whole, self.pieces, self.added)


def _byte_characters() -> np.ndarray:
    """The code point that stands for each byte in a byte-level vocabulary: printable Latin-1 characters stand for
    themselves and the others, in order, follow from U+0100. Line ends are left as they are."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    found = np.arange(256, dtype="<u4")
    found[others] = 0x100 + np.arange(len(others))
    found[0x0A] = 0x0A
    return found


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
