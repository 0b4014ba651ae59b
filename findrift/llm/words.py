"""Words and word shingles of UTF-8 texts as numpy arrays, read from Arrow buffers.

A word is a run of bytes outside space and 0x09-0x0D. Hashes lower-case A-Z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
SLAB = 1 << 20  # bytes hashed at once

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240501))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=U)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = int(_rng.integers(0, 1 << 61)) * 8 + 3  # 3 mod 8: differences of powers keep high order
_STEP = _rng.integers(0, 1 << 63, 16, dtype=U) * U(2) + U(1)
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits (finaliser of MurmurHash3)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLAB + 1)
        for i, base in enumerate((_BASE % (1 << 64), pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, U(base))
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 positions of the texts' first words."""
    inside = ~_SPACE[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    some = offs[:-1] < offs[1:]
    first, last = offs[:-1][some], offs[1:][some] - 1
    start[first] = inside[first]
    end[last] = inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word."""
    out = np.empty(len(starts), U)
    k = 0
    while k < len(starts):
        base = starts[k]
        j = max(k + 1, int(np.searchsorted(starts, base + SLAB - 4096)))
        if j > k + 1 and ends[j - 1] - base > SLAB:
            j -= 1
        seg = data[base : ends[j - 1]]
        up, down = _powers_to(len(seg) + 1)
        acc = np.zeros(len(seg) + 1, U)
        np.cumsum(_BYTE[seg] * up[:-1], out=acc[1:])
        s, e = starts[k:j] - base, ends[k:j] - base
        out[k:j] = mix((acc[e] - acc[s]) * down[s] + (e - s).astype(U))
        k = j
    return out


def hashed(col) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the n + 1 positions of the texts' first words."""
    data, offs = text_bytes(col)
    starts, ends, first = word_spans(data, offs)
    return word_hashes(data, starts, ends), first


def shingles(col, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within a text, and the n + 1 bounds.

    A text with fewer words than `width` has its whole sequence as one shingle;
    a text without words has none.
    """
    h, first = hashed(col)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    g, d = [], []
    if len(h) >= width:
        m = len(h) - width + 1
        whole = np.flatnonzero(doc[:m] == doc[width - 1 :])
        acc = np.zeros(len(whole), U)
        for j in range(width):
            acc += h[whole + j] * _STEP[j]
        g.append(mix(acc))
        d.append(doc[whole])
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        acc = np.full(len(short), U(k))
        for j in range(k):
            acc += h[first[short] + j] * _STEP[j]
        g.append(mix(acc))
        d.append(short)
    g, d = np.concatenate(g), np.concatenate(d)
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[keep], d[keep]
    return g, np.searchsorted(d, np.arange(len(n) + 1))
