"""Vectorised views of Arrow text columns: bytes, code points, words, lines and their hashes.

All helpers work on a slice of a column at a time (``slices``), so that temporary arrays stay
small however many rows an Arrow batch holds. A single text longer than a slice is taken alone.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

SLICE_BYTES = 1 << 21


def give_back() -> None:
    """Returns a worker's unused memory to the system at the end of a task: idle workers stand beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0xD6E8FEB86659FD93)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def members(pattern: str) -> np.ndarray:
    """Which code points a character class of the regex module holds; in parts, as all of them as one text would fill a worker's memory."""
    out, part = np.zeros(0x110000, bool), 1 << 12
    for base in range(0, len(out), part):
        for m in regex.finditer(f"{pattern}+", "".join(map(chr, range(base, base + part)))):
            out[base + m.start() : base + m.end()] = True
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of unsigned 64-bit integers."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4095, _P, np.uint64)]), dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, _P, np.uint64)]), dtype=np.uint64)
    return _powers


class Texts:
    """Consecutive texts as one byte array; a null text is empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.size = np.diff(offsets)

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
        if not len(column):
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        return cls(data, offsets - offsets[0])

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def first(self) -> np.ndarray:
        """True at the first byte of each text that has one."""
        out = np.zeros(len(self.data), bool)
        at = self.offsets[:-1]
        out[at[at < len(self.data)]] = True
        return out

    def words(self) -> Words:
        return Words(self)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text: first byte, end, text number, 64-bit hash."""

    def __init__(self, texts: Texts, fold: np.ndarray | None = None):
        self.texts = texts
        data = texts.data if fold is None else fold[texts.data]
        self.inside = ~_WHITE[data]
        first = texts.first()
        begins = self.inside.copy()
        begins[1:] &= ~self.inside[:-1] | first[1:]
        ends = self.inside.copy()
        ends[:-1] &= ~self.inside[1:] | first[1:]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.n = len(self.start)
        self.doc = np.searchsorted(texts.offsets, self.start, side="right") - 1
        self.per_doc = np.bincount(self.doc, minlength=texts.n)
        self._data = data

    def hashes(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint64)
        return spans_hash(self._data, self.start, self.end)

    def shingles(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k consecutive words of a text, and the number of each one's first word."""
        return windows(hashes, self.doc, k)


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint, ordered, non-empty byte spans."""
    size = end - start
    ids = np.repeat(np.arange(len(start)), size)
    at = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
    body = data[at + start[ids]] if len(ids) != len(data) else data
    value = _BYTE[body] * powers(int(size.max()))[at]
    return mix(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64) * _ODD)


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = np.flatnonzero(doc[:m] == doc[k - 1 :])
    h = np.zeros(len(ok), np.uint64)
    for j in range(k):
        h = h * _P + hashes[ok + j]
    return mix(h), ok


def repeated(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys within their own text: is it found twice or more; is it equal to an earlier one."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    own = keys ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    s = own[order]
    same = s[1:] == s[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each ``\\n``-split line, empty ones left out."""
    if not len(texts.data):
        z = np.zeros(0, np.int64)
        return z, z, z
    body = texts.data != 0x0A
    first = texts.first()
    begins, ends = body.copy(), body.copy()
    begins[1:] &= ~body[:-1] | first[1:]
    ends[:-1] &= ~body[1:] | first[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(texts.offsets, start, side="right") - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) of slices of about ``limit`` bytes and at most ``rows`` rows."""
    whole = Texts.of(column)
    at = 0
    while at < whole.n:
        end = max(at + 1, int(np.searchsorted(whole.offsets, whole.offsets[at] + limit, side="right")) - 1)
        end = min(end, at + rows)
        off = whole.offsets[at : end + 1]
        yield at, end, Texts(whole.data[off[0] : off[-1]], off - off[0])
        at = end


def code_points(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (valid UTF-8), and the offsets of the texts among them."""
    lead = (texts.data & 0xC0) != 0x80
    cum = np.concatenate([[0], np.cumsum(lead)])
    points = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, cum[texts.offsets]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets; empty spans sum to 0."""
    cum = np.concatenate([[0], np.cumsum(values, dtype=np.int64 if values.dtype.kind in "bui" else np.float64)])
    return cum[offsets[1:]] - cum[offsets[:-1]]
