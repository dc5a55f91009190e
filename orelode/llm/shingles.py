"""Words and shingles of whole texts as 64-bit hashes, by vector operations on UTF-8 bytes.

A word is a run of bytes other than blank and 0x09 to 0x0D; A-Z count as a-z.
A shingle is ``size`` words in a row, whatever stands between them. A text of
fewer words has its whole sequence as its only shingle; without words it has
none. Two different shingles share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import left_behind, text_buffer

WORDS = 5
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = left_behind({}, "shingles")


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept up to 8 million."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 18, 1 << (n - 1).bit_length()) if n <= 8 << 20 else n
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        if size <= 8 << 20:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(raw: np.ndarray, at: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of each word of the rows raw[at[i]:at[i + 1]]; ``blank`` marks the bytes between words."""
    n = len(raw)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    inside = ~blank[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[1:-1]
    edges = edges[edges < n]
    first[edges] |= inside[edges]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = edges[edges > 0] - 1
    last[before] |= inside[before]
    ends = np.flatnonzero(last) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * powers(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64) * np.uint64(_ODD))
    return starts, ends, np.searchsorted(at, starts, side="right") - 1, hashes


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` in a row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = total * np.uint64(_BASE) + hashes[k : k + n]
    return mix(total)


def shingles(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of a string column, by row; repeats stay."""
    raw, at = text_buffer(column)
    _, _, row, hashes = words(raw, at)
    found = runs(hashes, size)
    whole = row[: len(found)] == row[size - 1 :] if len(found) else np.empty(0, bool)
    rows, out = row[: len(found)][whole], found[whole]
    count = np.bincount(row, minlength=len(column))
    first = np.concatenate([[0], np.cumsum(count)])
    for r in np.flatnonzero((count > 0) & (count < size)):
        total = np.full(1, int(count[r]), np.uint64)
        for h in hashes[first[r] : first[r + 1]]:
            total = total * np.uint64(_BASE) + h
        rows, out = np.append(rows, r), np.append(out, mix(total))
    if len(rows) and (np.diff(rows) < 0).any():
        order = np.argsort(rows, kind="stable")
        rows, out = rows[order], out[order]
    return rows, out


def shingle_sets(column: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, ascending."""
    rows, hashes = shingles(column, size)
    at = np.searchsorted(rows, np.arange(len(column) + 1))
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
