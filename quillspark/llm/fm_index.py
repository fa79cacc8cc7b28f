"""A compressed FM-index with backward search over a wavelet tree, and matching statistics of many documents at once.

The Burrows-Wheeler transform of the shard's strings is kept as its runs: equal
passages make long ones. The symbols of the runs lie bit by bit in a wavelet
tree (in matrix form: one packed bit vector for each bit of a symbol, with
running counts), and the running lengths of each symbol's runs turn a count of
runs into a rank. The longest common prefixes of suffixes and their nearest
smaller ones stay plain arrays, and so does one bit a suffix. Documents are streamed from their last symbol to the first, all
of a block in step; each keeps the interval of its longest match. Where the
match can't be extended, it is cut to the parent interval, found on the longest
common prefixes by the nearest smaller ones on both sides.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np

#: The symbol that stands before the anchor of each context: a window can only match one of the same alignment, so never itself through another context.
MARK = 1


class WaveletTree:
    """rank over a sequence of symbols 0..2**bits-1."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        current, n = symbols, len(symbols)
        for level in range(bits - 1, -1, -1):
            bit = ((current >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(n // 64 + 2, dtype=np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.zeros(len(words) + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            zeros = n - int(bit.sum())
            self.levels.append((level, words, counts.astype(np.int32), np.int32(zeros)))
            current = np.concatenate([current[~bit], current[bit]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` ends up, following the bits of ``symbols``; the difference of two such is a count of the symbol."""
        for level, words, counts, zeros in self.levels:
            word = at >> 6
            ones = counts[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at


def _smaller(lcp: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it that holds less; 0 without one. Pointers skip what is known to be no less, so a few rounds do."""
    at = np.arange(-1, len(lcp) - 1, dtype=np.int32)
    at[0] = 0
    open_ = np.flatnonzero((lcp[at] >= lcp) & (at > 0))
    while len(open_):
        at[open_] = at[at[open_]]
        open_ = open_[(lcp[at[open_]] >= lcp[open_]) & (at[open_] > 0)]
    return at


class FmIndex:
    """Over strings of symbols from 1 on, given as one array in which 0 ends each; ``weights``: how often each string stands for a place."""

    def __init__(self, text: np.ndarray, weights: np.ndarray):
        n = len(text)
        ends = text == 0
        owner = np.cumsum(ends) - ends
        strings = int(ends.sum())
        single = text.astype(np.int64) + strings
        single[ends] = np.arange(strings)  # ends are told apart, so the order of suffixes is total
        width = int(single.max()).bit_length() if n else 1
        step = max(1, min(3, 63 // width))
        key = single.copy()
        for i in range(1, step):  # the first symbols of each suffix at once
            key <<= width
            key[: n - i] |= single[i:]
        ranks: list[tuple[int, np.ndarray]] = []
        while True:  # then prefix doubling
            suffixes = np.argsort(key)
            ordered = key[suffixes]
            rank = np.empty(n, dtype=np.int32)
            rank[suffixes] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]), dtype=np.int32)
            if n < 2 or rank[suffixes[-1]] == n - 1:
                break
            ranks.append((step, rank))
            key = rank.astype(np.int64) * (n + 1)
            key[: n - step] += rank[step:] + 1
            step *= 2
        self.n = n
        self.lcp = np.zeros(n + 1, dtype=np.int16)
        if n > 1:
            a, b = suffixes[:-1].astype(np.int32), suffixes[1:].astype(np.int32)
            common = np.zeros(n - 1, dtype=np.int32)
            for span, by in [*reversed(ranks), (1, single), (1, single)]:
                jump = (by[a] == by[b]) * np.int32(span)  # never past an end, which equals none
                a, b, common = a + jump, b + jump, common + jump
            self.lcp[1:n] = common
        self.left, self.right = _smaller(self.lcp), n - _smaller(self.lcp[::-1])[::-1]
        alphabet = int(text.max()) + 1 if n else 1
        bwt = text[suffixes - 1]
        first = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]])) if n else np.zeros(0, dtype=np.int64)
        heads, lengths = bwt[first], np.diff(np.append(first, n))
        self.runs = np.append(first, n).astype(np.int32)
        self.heads = np.append(heads, -1).astype(np.int32)
        self.tree = WaveletTree(heads, max(1, int(alphabet - 1).bit_length()))
        every = np.arange(alphabet, dtype=np.int32)
        runs_before = np.concatenate([[0], np.cumsum(np.bincount(heads, minlength=alphabet))])[:-1]
        self.before = runs_before.astype(np.int32) - self.tree.descend(every, np.zeros(alphabet, dtype=np.int32))
        self.places = np.concatenate([[0], np.cumsum(lengths[np.argsort(heads, kind="stable")])]).astype(np.int32)
        self.heavy = np.packbits(weights[owner[suffixes]] > 1, bitorder="little") if n else np.zeros(1, dtype=np.uint8)

    def extend(self, symbols: np.ndarray, sp: np.ndarray, ep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search by one symbol: the intervals of ``symbols`` before the matches."""
        at, symbols = np.concatenate([sp, ep]), np.concatenate([symbols, symbols])
        run = (np.searchsorted(self.runs, at, side="right") - 1).astype(np.int32)  # at the end: one past the last run
        inside = np.where(self.heads[run] == symbols, at - self.runs[run], 0)
        out = self.places[self.before[symbols] + self.tree.descend(symbols, run)] + inside
        return out[: len(sp)], out[len(sp) :]

    def repeats(self, sp: np.ndarray, ep: np.ndarray) -> np.ndarray:
        """Whether an interval stands for two places or more: two suffixes, or one of a string that weighs two."""
        one = np.minimum(sp, max(self.n - 1, 0))
        return (ep - sp > 1) | ((ep - sp == 1) & (self.heavy[one >> 3] >> (one & 7).astype(np.uint8) & 1 > 0))

    def parent(self, sp: np.ndarray, ep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least interval that holds more than [sp, ep), and the length that its suffixes have in common."""
        edge = np.where(self.lcp[sp] >= self.lcp[ep], sp, ep)
        length = self.lcp[edge].astype(np.int32)
        sp, ep = self.left[edge], self.right[edge]
        root = length == 0
        sp[root], ep[root] = 0, self.n
        return sp, ep, length

    def matching_statistics(self, columns: np.ndarray) -> np.ndarray:
        """columns: (width, documents), 0 outside. For each place the length of the longest match that starts there and stands at two places or more.

        What is found at a place depends on the symbols from there on alone, so documents that end alike share one search until
        they part: near copies, however many, are searched for about once.
        """
        width, m = columns.shape
        out = np.zeros((width, m), dtype=np.int16)
        mine = np.zeros(m, dtype=np.int64)  # the state of each document
        sp, ep, length = (np.array([x], dtype=np.int32) for x in (0, self.n, 0))
        for c in range(width - 1, -1, -1):
            keys, mine = np.unique((mine << 32) | columns[c], return_inverse=True)
            before, symbols = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32)
            sp, ep, length = sp[before], ep[before], length[before]
            outside = symbols == 0
            sp[outside], ep[outside], length[outside] = 0, self.n, 0
            todo = np.flatnonzero(~outside)
            while len(todo):
                a, b = self.extend(symbols[todo], sp[todo], ep[todo])
                ok = self.repeats(a, b)
                done = todo[ok]
                sp[done], ep[done] = a[ok], b[ok]
                length[done] += 1
                todo = todo[~ok]
                todo = todo[length[todo] > 0]
                if len(todo):
                    sp[todo], ep[todo], length[todo] = self.parent(sp[todo], ep[todo])
            out[c] = length[mine]
        return out


def _whole_windows(lefts: np.ndarray, sizes: np.ndarray, weights: np.ndarray, reach: int, width: int, length: int) -> np.ndarray:
    """(strings, width): the starts of all windows of contexts that stand at two places or more."""
    begin = (reach - lefts)[:, None]
    at = np.arange(width)
    return (weights > 1)[:, None] & (at >= begin) & (at + length <= begin + sizes[:, None])


def decide(lefts: np.ndarray, contexts: list[bytes], groups: np.ndarray, weights: np.ndarray, k: int, length: int) -> list[list[int]]:
    """For each context, words joined by one space, the words, relative to its anchor, that windows found elsewhere cover.

    ``weights``: 2 where the very same context stands at two places or more: all its windows repeat, so it is indexed but need
    not be searched for. A context that is the only one of its anchor shares windows with no other and isn't indexed.
    """
    from quillspark.llm.column_bwt import spans_of

    reach = length - k
    width = 2 * reach + k + 1
    shared = np.bincount(groups)[groups] > 1
    numbers: defaultdict[bytes, int] = defaultdict(count(2).__next__)
    columns = np.zeros((width, len(contexts)), dtype=np.int32)
    for i in np.flatnonzero(shared).tolist():
        left = int(lefts[i])
        ids = list(map(numbers.__getitem__, contexts[i].split(b" ")))
        ids.insert(left, MARK)
        columns[reach - left : reach - left + len(ids), i] = ids
    starts = np.zeros((len(contexts), width), dtype=bool)
    if shared.any():
        rows = np.concatenate([columns[:, shared].T, np.zeros((int(shared.sum()), 1), dtype=np.int32)], axis=1)
        inside = rows > 0
        inside[:, -1] = True
        index = FmIndex(rows[inside], weights[shared])
        streamed = np.flatnonzero(shared & (weights == 1))
        starts[streamed] = (index.matching_statistics(np.ascontiguousarray(columns[:, streamed])) >= length + 1).T
    sizes = np.fromiter((c.count(b" ") + 2 for c in contexts), dtype=np.int64, count=len(contexts))
    return spans_of(starts | _whole_windows(lefts, sizes, weights, reach, width, length + 1), length, reach)
