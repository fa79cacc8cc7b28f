"""Column-wise construction over many strings: a symbol of every string enters in each round.

Strings are contexts of anchors, aligned at the anchor and grouped by it: only
suffixes that start in the same column of the same group can begin equal
windows of different places, so the Burrows-Wheeler transform of the collection
is kept by columns (its positional form), each column a segment of its own.
The strings lie in an external file, column by column. Rounds go from the last
column to the first. A round reads a column, puts its symbols into the order of
the suffixes so far (that is the column's part of the transform), sorts them
stably into the order of the longer suffixes, and updates the longest common
prefixes of neighbours by range minima; both are appended to external files.

Repeats are then read off these two files in one sequential pass. The pass walks
the transform: sorting a segment's symbols stably leads from the order of one
column's suffixes to that of the next, so which string a place belongs to needs
no file of its own. Memory holds two columns of the strings, however wide.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np


def write_strings(contexts: list[bytes], lefts: np.ndarray, reach: int, width: int, folder: str) -> None:
    """The strings as a file of (width, strings) numbers, byte + 1 and 0 outside; a context of ``left`` symbols before its anchor starts at column reach - left."""
    out = np.memmap(os.path.join(folder, "strings"), dtype=np.uint16, mode="w+", shape=(width, len(contexts)))
    for first in range(0, len(contexts), 2048):  # places of all bytes at once would outweigh the strings
        some = contexts[first : first + 2048]
        lengths = np.fromiter(map(len, some), dtype=np.int32, count=len(some))
        data = np.frombuffer(b"".join(some), dtype=np.uint8)
        before = np.cumsum(lengths, dtype=np.int32) - lengths
        column = np.arange(len(data), dtype=np.int32) + np.repeat((reach - lefts[first : first + 2048]).astype(np.int32) - before, lengths)
        part = np.zeros((width, len(some)), dtype=np.uint16)
        part[column, np.repeat(np.arange(len(some), dtype=np.int32), lengths)] = data.astype(np.uint16) + 1
        out[:, first : first + len(some)] = part


def _longer(symbols: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """From the order of suffixes to that of the suffixes one symbol longer, within groups, which keep their places."""
    by_symbol = np.argsort(symbols, kind="stable")
    return by_symbol[np.argsort(ranks[by_symbol], kind="stable")]


def _ranks(groups: np.ndarray) -> np.ndarray:
    return groups.astype(np.uint16) if not len(groups) or groups[-1] < 1 << 16 else groups


def write_transform(groups: np.ndarray, width: int, folder: str) -> None:
    """Runs the rounds over the file of strings; ``groups`` holds each string's group number, ascending."""
    m = len(groups)
    order, ranks = np.arange(m), _ranks(groups)
    lcp = np.zeros(m + 1, dtype=np.uint16)
    same_group = groups[1:] == groups[:-1]
    with open(os.path.join(folder, "bwt"), "wb") as f_bwt, open(os.path.join(folder, "lcp"), "wb") as f_lcp:
        for c in range(width - 1, -1, -1):
            symbols = np.fromfile(os.path.join(folder, "strings"), dtype=np.uint16, count=m, offset=2 * m * c)[order]
            symbols.tofile(f_bwt)
            moved = _longer(symbols, ranks)
            sorted_symbols = symbols[moved]
            meets = np.flatnonzero(same_group & (sorted_symbols[1:] == sorted_symbols[:-1]) & (sorted_symbols[1:] > 0)) + 1
            after = np.zeros(m + 1, dtype=np.uint16)
            if len(meets):
                low, high = moved[meets - 1] + 1, moved[meets] + 1
                near = high - low == 1
                least = lcp[low]
                if not near.all():
                    bounds = np.stack([low[~near], high[~near]], axis=1).ravel()
                    least[~near] = np.minimum.reduceat(lcp, bounds)[::2]
                after[meets] = least + 1
            order, lcp = order[moved], after
            lcp[:m].tofile(f_lcp)


def repeated_starts(groups: np.ndarray, width: int, length: int, folder: str) -> np.ndarray:
    """Reads transform and common prefixes in sequence: (strings, width), whether a window of ``length`` starts there that another string of the group has there too."""
    m = len(groups)
    out = np.zeros((m, width), dtype=bool)
    order, ranks = np.arange(m), _ranks(groups)
    with open(os.path.join(folder, "bwt"), "rb") as f_bwt, open(os.path.join(folder, "lcp"), "rb") as f_lcp:
        for c in range(width - 1, -1, -1):
            order = order[_longer(np.fromfile(f_bwt, dtype=np.uint16, count=m), ranks)]
            long = np.fromfile(f_lcp, dtype=np.uint16, count=m) >= length
            either = long.copy()
            either[:-1] |= long[1:]
            out[order[either], c] = True
    return out


def scratch() -> str | None:
    """The folder that Spark gives a task for its files; what lies there is lost with the executor and made again with the task."""
    named = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return named if named and os.path.isdir(named) else None


def spans_of(starts: np.ndarray, length: int, origin: int) -> list[list[int]]:
    """For each string, the columns that windows starting at ``starts`` cover, as [a, b, a, b, ...] counted from column ``origin``."""
    m, width = starts.shape
    padded = np.zeros((m, width + 2), dtype=np.int8)
    padded[:, 1:-1] = starts
    change = np.diff(padded, axis=1)
    rows, first = np.nonzero(change == 1)
    _, past = np.nonzero(change == -1)
    out: list[list[int]] = [[] for _ in range(m)]
    for r, a, b in zip(rows.tolist(), (first - origin).tolist(), (past - 1 + length - origin).tolist()):
        out[r] += (a, b)
    return out


def decide(groups: np.ndarray, lefts: np.ndarray, contexts: list[bytes], weights: np.ndarray, k: int, length: int) -> list[list[int]]:
    """For each context the symbols, relative to its anchor, that windows found elsewhere cover.

    ``weights``: 2 where the very same context stands at two places or more; it enters the collection twice. A context that is the
    only string of its anchor shares windows with no other and doesn't enter.
    """
    reach = length - k
    width = 2 * reach + k
    starts = np.zeros((len(contexts), width), dtype=bool)
    entered = np.repeat(np.arange(len(contexts)), weights)
    entered = entered[np.bincount(groups[entered])[groups[entered]] > 1] if len(entered) else entered
    if len(entered):
        with tempfile.TemporaryDirectory(dir=scratch()) as folder:
            write_strings([contexts[i] for i in entered.tolist()], lefts[entered], reach, width, folder)
            write_transform(groups[entered], width, folder)
            starts[entered] = repeated_starts(groups[entered], width, length, folder)
    return spans_of(starts, length, reach)
