"""Words of a whole Arrow batch as numpy arrays, without a Python loop per word.

Works on the UTF-8 bytes of the column: a word is a run of bytes other than
space and 9 to 13, which is the same as ``[^\\x20\\x09-\\x0D]+`` on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of text whose arrays are held at once; a longer text is its own slice.
SLICE_BYTES = 1_000_000


class Words(NamedTuple):
    data: np.ndarray  # bytes of the slice
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    doc: np.ndarray  # row of each word, within the slice
    first: np.ndarray  # index of the first word of each row; one more than rows
    hash: np.ndarray  # uint64 of each word's bytes


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    if len(_POWERS.get("p", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("p", _BASE), ("q", _INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
        if n > 4 * SLICE_BYTES:  # not kept for one very long text
            return _POWERS.pop("p"), _POWERS.pop("q")
    return _POWERS["p"], _POWERS["q"]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), vectorised."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of h[i:i+width] for each i, by prefix sums."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    p, q = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=total[1:])
    return mix((total[width:] - total[:-width]) * q[:n])


def spans_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of h[lo:hi] for each pair."""
    p, q = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h, salt) * p[: len(h)], out=total[1:])
    return mix((total[hi] - total[lo]) * q[lo] + (hi - lo).astype(np.uint64), salt)


def bytes_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[starts:ends] for each pair."""
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * p[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of about SLICE_BYTES each."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(off, off[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi
        lo = hi


def words_of(column: pa.Array, hashed: bool = True) -> Words:
    """Words of a slice of a string column; a null has none."""
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    off = off - off[0]
    if column.null_count:  # a null's bytes, if it has any, are no text
        lengths = np.diff(off)
        if lengths[~column.is_valid().to_numpy(zero_copy_only=False)].any():
            return words_of(column.fill_null(""), hashed)
    sep = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.ones(len(data), bool)
    after = np.ones(len(data), bool)
    before[1:] = sep[:-1]
    after[:-1] = sep[1:]
    inner = off[(off > 0) & (off < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~sep & before)
    ends = np.flatnonzero(~sep & after) + 1
    first = np.searchsorted(starts, off)
    doc = np.repeat(np.arange(n), np.diff(first))
    if not hashed:
        return Words(data, starts, ends, doc, first, np.empty(0, np.uint64))
    return Words(data, starts, ends, doc, first, bytes_hash(data, starts, ends))
