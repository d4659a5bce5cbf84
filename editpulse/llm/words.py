"""Words of whole text batches as numpy arrays.

A batch of texts is one run of UTF-8 bytes. Words are maximal runs of bytes of a class inside one
text, so every rule whose separators are ASCII works on bytes: bytes of a multi-byte character
count as word characters. Texts go through in pieces cut between words, which bounds the memory by
the piece and by the longest word, not by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = bytes([0x20, *range(0x09, 0x0E)])
SLICE_BYTES = 4 << 20
PIECE_BYTES = 1 << 18
_SEED = 0x9E3779B97F4A7C15
_BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mix((codes + np.uint64(1)) * np.uint64(_SEED))


NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(SPACES)] = False
LETTERS_DIGITS = np.zeros(256, dtype=bool)  # digits, ASCII letters and every byte of other characters
LETTERS_DIGITS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_VALUES = {lower: _byte_values(lower) for lower in (False, True)}


class Words(NamedTuple):
    """Start and end byte in the slice, number of the text, and hash of every word."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray


class Texts(NamedTuple):
    """Consecutive texts: bytes, and offsets with one more entry than there are texts."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def text_bytes(column: pa.Array) -> Texts:
    """The bytes of a text column without a copy; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return Texts(np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return Texts(flat, bounds - bounds[0])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most about ``limit`` bytes of text; one long text is a part of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offsets = text_bytes(batch.column(column)).offsets
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def _power(name: str, base: np.uint64, size: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < size:
        steps = np.full(max(size, PIECE_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = known = np.multiply.accumulate(steps)
    return known


def _cuts(data: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about PIECE_BYTES that end between words or texts."""
    first, total = 0, len(data)
    while first < total:
        last = min(first + PIECE_BYTES, total)
        while last < total and inside[data[last]] and inside[data[last - 1]]:
            ahead = np.flatnonzero(~inside[data[last : last + PIECE_BYTES]])
            bound = offsets[np.searchsorted(offsets, last)]
            last = min(int(bound), last + int(ahead[0]) if len(ahead) else min(last + PIECE_BYTES, total))
            if last == bound:
                break
        yield first, last
        first = last


def words(texts: Texts, inside: np.ndarray, lower: bool = False) -> Words:
    """All words of the texts in order; equal words have equal hashes."""
    data, offsets = texts
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    values = _VALUES[lower]
    for first, last in _cuts(data, inside, offsets):
        part = data[first:last]
        member = inside[part]
        breaks = offsets[np.searchsorted(offsets, first) : np.searchsorted(offsets, last)] - first
        opens = member.copy()
        opens[1:] &= ~member[:-1]
        opens[breaks] = member[breaks]
        closes = member.copy()
        closes[:-1] &= ~member[1:]
        inner = breaks[breaks > 0]
        closes[inner - 1] = member[inner - 1]
        start, stop = np.flatnonzero(opens), np.flatnonzero(closes)
        if not len(start):
            continue
        sums = np.cumsum(values[part] * _power("up", _BASE, len(part))[: len(part)])
        raw = sums[stop] - np.where(start > 0, sums[start - 1], np.uint64(0))
        raw *= _power("down", _INVERSE, len(part))[start]
        found.append((start + first, stop + first + 1, mix(raw + (stop - start).astype(np.uint64))))
    if not found:
        none = np.empty(0, np.int64)
        return Words(none, none, none, np.empty(0, np.uint64))
    start, end, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    return Words(start, end, np.searchsorted(offsets[1:], start, side="right"), hashes)


def rows(found: Words, n_texts: int) -> np.ndarray:
    """Bounds of every text's words: words of text i are rows[i] to rows[i + 1]."""
    return np.searchsorted(found.text, np.arange(n_texts + 1))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words, whatever text they are from."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.full(size, n, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(0xF1357AEA2E62A9C5)
        out += hashes[k : k + size]
    return mix(out)


def within(found: Words, n: int) -> np.ndarray:
    """Which runs of ``n`` consecutive words lie inside one text."""
    size = len(found.text) - n + 1
    return found.text[:size] == found.text[n - 1 :] if size > 0 else np.empty(0, bool)


def code_points(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a character."""
    return (data & 0xC0) != 0x80
