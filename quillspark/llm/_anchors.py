"""Content-defined anchors over arrays of symbols (bytes or words).

An anchor of a window of ``k + w - 1`` symbols is the k-gram of least hash in it
(the leftmost of equal ones). The choice depends on nothing but the window, so
two equal windows anywhere in the corpus have the same anchor at the same
offset: text that repeats can be found by meeting on anchors, and text whose
anchors are all unique cannot repeat.
"""

from __future__ import annotations

import numpy as np

#: Symbols handled at once: bounds the memory of a Python worker whatever the length of a text.
PIECE = 1 << 19
#: An odd base and its inverse modulo 2**64, for sums of symbols times powers.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_MASK = np.uint64(0xFFFFFFFF)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, PIECE + 4096), base, dtype=np.uint64)
        known[0] = 1
        _powers[base] = known = np.multiply.accumulate(known)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit sums; a bijection."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def range_hash(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each symbols[start:end] that depends on nothing else."""
    n = len(symbols)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, n + 1)[starts])


def gram_hash(symbols: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k-gram; one for each start."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(symbols)), out=sums[1:])
    out = sums[k:] - sums[:-k]
    out *= powers(BASE_INVERSE, n)
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i, by doubling."""
    step = 1
    while 2 * step <= w:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (w - step)], x[w - step :]) if w > step else x


def _piece(symbols: np.ndarray, valid: np.ndarray | None, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    grams = gram_hash(symbols, k)
    keys = (grams & ~_MASK) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(keys, w)
    if valid is not None:
        least = least[valid[: len(least)]]
    if not len(least):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = (least & _MASK).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, grams[at]


def anchors(symbols: np.ndarray, bounds: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all anchors; document i is symbols[bounds[i]:bounds[i+1]].

    Positions ascend and count from the start of ``symbols``. Documents of fewer
    than k + w - 1 symbols have none. Windows never cross documents.
    """
    span, total = k + w - 1, len(symbols)
    out_at, out_hash = [], []
    lengths = np.diff(bounds)
    usable = np.maximum(lengths - span + 1, 0)
    first, doc = int(bounds[0]), 0
    while doc < len(lengths):
        if lengths[doc] > PIECE:  # a long text, by overlapping pieces
            lo, hi = int(bounds[doc]), int(bounds[doc + 1])
            for s in range(lo, hi - span + 1, PIECE):
                at, h = _piece(symbols[s : min(hi, s + PIECE + span - 1)], None, k, w)
                out_at.append(at + s)
                out_hash.append(h)
            doc += 1
            continue
        end = int(np.searchsorted(bounds, bounds[doc] + PIECE, side="right")) - 1
        end = min(max(end, doc + 1), len(lengths))
        while end > doc + 1 and lengths[end - 1] > PIECE:
            end -= 1
        lo, hi = int(bounds[doc]), int(bounds[end])
        if hi - lo >= span:
            edge = np.zeros(hi - lo + 1, dtype=np.int32)
            use = usable[doc:end]
            starts = bounds[doc:end] - lo
            np.add.at(edge, starts[use > 0], 1)
            np.add.at(edge, (starts + use)[use > 0], -1)
            valid = np.cumsum(edge[:-1]) > 0
            at, h = _piece(symbols[lo:hi], valid[: hi - lo - span + 1], k, w)
            out_at.append(at + lo)
            out_hash.append(h)
        doc = end
    if not out_at:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at, h = np.concatenate(out_at), np.concatenate(out_hash)
    keep = np.concatenate([[True], at[1:] != at[:-1]])  # neighbouring pieces of a text may share an anchor
    return at[keep], h[keep]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in ``data``, and for each document the number of the first word; bounds count from 0."""
    ink = ~_SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = ink[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    starts_mask = ink & ~before
    starts_mask[inner] = ink[inner]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = ink[1:]
    ends_mask = ink & ~after
    ends_mask[inner - 1] = ink[inner - 1]
    starts = np.flatnonzero(starts_mask)
    return starts, np.flatnonzero(ends_mask) + 1, np.searchsorted(starts, bounds)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and bounds of an Arrow string or binary array without nulls, without copying."""
    wide = column.type in _wide()
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    if not len(raw):
        raw = np.zeros(1, dtype=np.int64)
    return data[raw[0] : raw[-1]], raw - raw[0]


def _wide() -> tuple:
    import pyarrow as pa

    return (pa.large_string(), pa.large_binary())


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, piece by piece."""
    out = np.zeros(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        out[i:j] = range_hash(data[lo:hi], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out
