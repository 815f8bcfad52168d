"""Encoding with the tokenizers library, each distinct piece of text once per worker."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import filled, ragged, stage_cache, word_array

#: Distinct pieces that a worker keeps between batches; beyond it, pieces seen in only one batch are forgotten.
KEPT_PIECES = 150_000
#: Bytes of text that are encoded at once: some 25 bytes of memory for each.
SLICE = 4 << 20
#: Pieces that are encoded in one call.
BATCH = 4096

# A piece may begin at a space only before a character that is surely not white space, control or the lead
# byte of a character that may be (U+0085, U+00A0, U+1680, U+2000..., U+3000).
_BEGINS = np.ones(256, bool)
_BEGINS[:0x21] = False
_BEGINS[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
# It may also begin at one of these marks after a letter (below); ' may begin a contraction, < | > a special token.
_MARKS = np.zeros(256, bool)
_MARKS[list(b'!"#$%&()*+,-./:;=?@[]^_`{}~')] = True
# ASCII letters, and the second bytes of U+00C0 to U+00FF, but for the two signs among them.
_ASCII, _LATIN = np.zeros(256, bool), np.zeros(256, bool)
_ASCII[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: Pieces of such letters alone (after one space at most) are one token of every pattern: the model takes them as they are.
_LETTERS = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
# The characters that stand for bytes of such pieces in a byte-level vocabulary; the line ends between them stay.
_CHARS = np.arange(256, dtype="<u4")
_CHARS[[*range(0x21), *range(0x7F, 0xA1), 0xAD]] = 256 + np.arange(0x21 + 0x22 + 1)
_CHARS[0x0A] = 0x0A
_PROBES = [f"{s}{w}" for s in ("", " ") for w in "a A The house \u00c9t\u00e9 \u00dcber stra\u00dfe \u00e0 \u00c0\u00ed\u00ef\u00f1 garantiza Xq".split(" ")]


def _letter_marks(data: np.ndarray) -> np.ndarray:
    """Whether each byte is a mark right after a letter."""
    out = np.zeros(len(data), bool)
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & _LATIN[data[1:]]
    out[1:] = _MARKS[data[1:]] & (_ASCII[data[:-1]] | latin[:-1])
    return out


class PieceEncoder:
    """ids of whole texts, as ``Tokenizer.encode_batch(texts, add_special_tokens=False)`` gives them.

    ``pieces`` says where a text may be cut without a change of its ids:
    ``words`` for tokenizers that drop white space (cut at blanks), ``spaced`` for byte-level ones whose
    pattern takes a single space into the token after it (cut before such a space), ``whole`` for others. The
    first two are cut between a letter and a mark too. Strings of special tokens in a text give those tokens,
    as the library does: no such string is cut.
    """

    def __init__(self, path: str, pieces: str = "whole"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces = pieces
        # "words" stands for a lower-casing byte-level tokenizer, "spaced" for one that isn't; others are found out here
        probes = [x for x in _PROBES if pieces == "spaced" or x[0] != " "]
        self.direct = pieces != "whole" and all(a == b for a, b in zip(self._words(probes), self._ids(probes)))
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.length = np.empty(0, np.int64)
        self.start = np.empty(0, np.int64)
        self.seen = np.empty(0, np.int32)

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts and where each text's pieces start."""
        first = np.arange(len(texts) + 1)
        if self.pieces == "words":
            texts, first = word_array(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        if self.pieces == "whole" or offsets[-1] == offsets[0]:
            return texts, first
        low = offsets[0]
        offsets = offsets - low
        data = np.frombuffer(texts.buffers()[2], np.uint8)[low : low + offsets[-1]]
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = _letter_marks(data)
        if self.pieces == "spaced":
            space = (data[:-1] == 0x20) & _BEGINS[data[1:]]
            # a last space of a text has no partner there: the byte after it is another text's
            last = offsets[1:-1] - 1
            space[last[(last >= 0) & (last < len(space))]] = False
            cut[: len(space)] |= space
        cut[offsets] = True
        cuts = np.flatnonzero(cut)
        pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer((cuts + low).astype(np.int32)), texts.buffers()[2])
        return pieces, np.searchsorted(cuts, offsets[first])

    def _words(self, pieces: list[str]) -> list[list[int]]:
        """ids of pieces of letters, straight from the model."""
        joined = "\n".join(pieces)
        joined = _CHARS[np.frombuffer((joined.lower() if self.pieces == "words" else joined).encode(), np.uint8)].tobytes().decode("utf-32-le")
        return [[t.id for t in self.model.tokenize(w)] for w in joined.split("\n")] if pieces else []

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        """ids of any pieces; the library's results hold far more than ids, so few of them live at a time."""
        return [e.ids for i in range(0, len(pieces), BATCH) for e in self.tokenizer.encode_batch_fast(pieces[i : i + BATCH], add_special_tokens=False)]

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of pieces one after another, and how many each has."""
        plain = np.zeros(len(pieces), bool)
        if self.direct:
            plain = pc.match_substring_regex(pa.array(pieces, pa.string()), _LETTERS).to_numpy(zero_copy_only=False)
        got: list[list[int]] = [[]] * len(pieces)
        for at, encode in ((np.flatnonzero(plain), self._words), (np.flatnonzero(~plain), self._ids)):
            for k, ids in zip(at.tolist(), encode([pieces[k] for k in at])):
                got[k] = ids
        length = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int32, int(length.sum())), length

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts (null: none) one after another, and where each text's start (one more at the end)."""
        texts = filled(texts)
        pieces, first = self._cut(texts)
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary.to_pylist()
        get = self.slot.get
        slots = np.fromiter((get(x, -1) for x in distinct), np.int64, len(distinct))
        missing = np.flatnonzero(slots < 0)
        self.seen[slots[slots >= 0]] += 1
        if len(missing):
            new = [distinct[i] for i in missing]
            flat, length = self._new(new)
            slots[missing] = np.arange(len(self.length), len(self.length) + len(new))
            self.slot.update(zip(new, slots[missing].tolist()))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
            self.flat = np.concatenate([self.flat, flat])
            self.length = np.concatenate([self.length, length])
            self.seen = np.concatenate([self.seen, np.ones(len(new), np.int32)])
        each = slots[which] if len(which) else np.empty(0, np.int64)
        length = self.length[each]
        ends = np.concatenate([[0], np.cumsum(length)])
        # which entry of flat each id is: 4 bytes do, as flat and a batch are far smaller than 2^31
        ids = self.flat[np.arange(ends[-1], dtype=np.int32) + np.repeat((self.start[each] - ends[:-1]).astype(np.int32), length)]
        if len(self.slot) > KEPT_PIECES:
            self._keep_common()
        return ids, ends[first]

    def _keep_common(self) -> None:
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > KEPT_PIECES // 2:
            keep = np.sort(keep[np.argsort(-self.seen[keep], kind="stable")[: KEPT_PIECES // 2]])
        names = list(self.slot)  # in the order of their numbers
        start, length, seen = self.start[keep], self.length[keep], self.seen[keep]
        flat = self.flat[ragged(start, length)]
        self.slot = {names[i]: n for n, i in enumerate(keep.tolist())}
        self.flat, self.length, self.seen = flat, length, np.maximum(seen // 2, 1)
        self.start = np.cumsum(length) - length


def encoder(path: str, pieces: str) -> PieceEncoder:
    """One encoder for each worker process, kept between tasks of a stage."""
    cache, key = stage_cache(), ("encoder", path, pieces)
    if key not in cache:
        cache[key] = PieceEncoder(path, pieces)
    return cache[key]
