"""Token ids of a column of texts, gathered from those of their pieces.

A column is cut at safe places in its bytes, Arrow finds the distinct pieces, only pieces that aren't remembered go to
the encoder, and NumPy gathers the ids: work that grows with the text stays out of Python's loops.

What is safe depends on the vocabulary. No pre-token of the byte-level pattern, nor of one that drops white space,
crosses the start of a run of white space or the place between an ASCII letter and one of MARKS, and neither looks
further back than such a place; special strings hold no such place.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Marks before which a piece may end, after an ASCII letter. None of them occurs in a special string after a letter.
MARKS = b",.;:!?"
#: Pieces of either generation that a worker remembers, and the longest remembered, in characters.
CACHE_PIECES, CACHE_CHARS = 120_000, 64

#: Bytes of text whose rows are taken together.
SLICE_BYTES = 5 << 20

try:
    _LIBC = ctypes.CDLL(None)
    # arrays of over 1 MB get pages of their own, which go back to the system as soon as they are freed
    _LIBC.mallopt(-3, 1 << 20)
except (OSError, AttributeError):
    _LIBC = None

_SPACE = np.zeros(256, bool)
_SPACE[[0x09, 0x0A, 0x0D, 0x20]] = True
#: Bytes after which white space may start a piece: neither white space nor a control character (whatever a library
#: takes these for).
_SOLID = np.ones(256, bool)
_SOLID[: 0x21] = _SOLID[0x7F] = False
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True
_ALNUM = _LETTER.copy()
_ALNUM[0x30:0x3A] = True


def tidy() -> None:
    """Gives freed memory back to the system: a worker lives through many stages, and all of an executor's share its
    memory."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def by_bytes(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most `most` bytes in a string or binary column, but for single longer values; any number of rows."""
    x = batch.column(column)
    x = x.cast(pa.large_binary() if pa.types.is_binary(x.type) else pa.large_string())
    offsets = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
    start = 0
    while start < len(x):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end
    tidy()


def _after_wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place may be white space beyond ASCII: U+0080 to U+00BF, U+1680 to U+16BF,
    U+1800 to U+183F, U+2000 to U+207F or U+3000 to U+303F; their blocks hold all there is."""
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    lead = (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE1) & ((two == 0x9A) | (two == 0xA0)) | (three == 0xE3) & (two == 0x80)
    return (data[at - 1] >= 0x80) & ((two == 0xC2) | lead)


def cut_pretokens(data: np.ndarray) -> np.ndarray:
    """Places (past the first byte) where a piece may begin, for patterns that part words, marks and white space."""
    before, here = data[:-1], data[1:]
    at = np.flatnonzero(_SPACE[here] & _SOLID[before] | _MARK[here] & _LETTER[before]) + 1
    return at[~_after_wide_space(data, at)]


def cut_spaces(data: np.ndarray) -> np.ndarray:
    """Places where a piece may begin, for patterns that part words and marks and drop all white space."""
    return np.flatnonzero(_SPACE[data] | np.concatenate([[False], _MARK[data[1:]] & _LETTER[data[:-1]]])) if len(data) else np.zeros(0, np.int64)


def plain(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces without ASCII white space, and in lower case if they are ASCII and can't hold a special string: what a
    normalizer that lowers and drops would make of them anyway. (Beyond ASCII, lowering and composing don't commute.)"""
    if len(at) < 2:
        return data, at
    odd = np.logical_or.reduceat((data >= 0x80) | (data == 0x3C), at[:-1])
    upper = (data >= 0x41) & (data <= 0x5A) & ~np.repeat(odd, np.diff(at))
    held = ~_SPACE[data]
    place = np.zeros(len(data) + 1, np.int32)
    np.cumsum(held, out=place[1:], dtype=np.int32)
    return (data + (upper.view(np.uint8) << 5))[held], place[at]


def cut_words(data: np.ndarray) -> np.ndarray:
    """Places before a single space between two ASCII letters or digits."""
    return np.flatnonzero((data[1:-1] == 0x20) & _ALNUM[data[:-2]] & _ALNUM[data[2:]]) + 1 if len(data) > 2 else np.zeros(0, np.int64)


def cut_nowhere(data: np.ndarray) -> np.ndarray:
    return np.zeros(0, np.int64)


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and the offsets of its values."""
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of every range, one after another."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - ends + sizes, sizes)
    at += np.arange(len(at))
    return values[at]


class Pieces:
    """Ids of texts. cut: where pieces may begin in bytes; encode: packed little-endian unsigned 32-bit ids of pieces;
    form: bytes and offsets of pieces as they may be written with the same ids."""

    def __init__(self, cut: Callable[[np.ndarray], np.ndarray], encode: Callable[[list[str]], list[bytes]], form: Callable | None = None):
        self.cut, self.encode, self.form = cut, encode, form
        self.fresh: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _values(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of distinct pieces. Two generations are remembered: what isn't asked for in the time that one
        takes to fill is forgotten."""
        fresh, old = self.fresh, self.old
        out = list(map(fresh.get, pieces))
        missing = []
        for i, x in enumerate(out):
            if x is None:
                piece = pieces[i]
                x = out[i] = old.get(piece)
                if x is None:
                    missing.append(i)
                else:
                    fresh[piece] = x
        for i, x in zip(missing, self.encode([pieces[i] for i in missing]) if missing else (), strict=True):
            out[i] = x
            if len(pieces[i]) <= CACHE_CHARS:
                fresh[pieces[i]] = x
        if len(fresh) > CACHE_PIECES:
            self.fresh, self.old = {}, fresh
        return out

    def _parts(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """For each piece the number of its distinct form, the forms' packed ids, and where each text's pieces begin."""
        data, offsets = column_bytes(texts)
        begins = np.zeros(len(data) + 1, bool)
        begins[self.cut(data)] = True
        begins[offsets] = True
        begins[len(data)] = True
        at = np.flatnonzero(begins)
        first = np.searchsorted(at, offsets)
        if self.form:
            data, at = self.form(data, at)
        pieces = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        return coded.indices.to_numpy(), self._values(coded.dictionary.to_pylist()), first

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        form, values, first = self._parts(texts)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        return np.diff(np.concatenate([[0], np.cumsum(sizes[form])])[first])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the number of each text's."""
        form, values, first = self._parts(texts)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        starts, own = np.cumsum(sizes) - sizes, sizes[form]
        flat = gathered(np.frombuffer(b"".join(values), "<u4"), starts[form], own)
        return flat, np.diff(np.concatenate([[0], np.cumsum(own)])[first])


def binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose rows are the next `sizes` items of flat each."""
    width = flat.dtype.itemsize
    offsets = (np.concatenate([[0], np.cumsum(sizes)]) * width).astype(np.int32 if len(flat) * width < 1 << 31 else np.int64)
    kind = pa.BinaryArray if offsets.dtype == np.int32 else pa.LargeBinaryArray
    return kind.from_buffers(pa.binary() if kind is pa.BinaryArray else pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
