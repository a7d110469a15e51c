"""A run-length compressed Burrows-Wheeler index of a block of short strings, and matching statistics from its sampled run ends.

Strings are sequences of 64-bit symbols, each closed by a terminator of its own, so that no match runs over an end. In the suffix
order, the rows of one run of equal preceding symbols keep their order when one symbol is put in front of all of them; so the longest
match of a suffix with the row before it (its matching statistic) is one less than that of the suffix one place further left,
unless a run begins there. Only the statistics at run heads are therefore compared symbol by symbol; all others are streamed from
them through the text. The more repetitive the block, the fewer runs.
"""

from __future__ import annotations

import numpy as np

from hushframe.llm.common import U64


class RunIndex:
    """Of the concatenation of strings: symbols (64-bit) and the length of each string."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        ends = np.cumsum(lengths + 1) - 1
        size = len(symbols) + len(lengths)
        inside = np.ones(size, bool)
        inside[ends] = False
        _, code = np.unique(symbols, return_inverse=True)
        rank = np.empty(size, np.int64)
        rank[inside] = code
        rank[ends] = (code.max() + 1 if len(code) else 0) + np.arange(len(lengths))
        self.size, self.inside = size, inside
        self.code = rank
        # prefix doubling: ranks by the first 1, 2, 4, ... symbols, until strings can't agree any further
        self.levels, reach = [rank], 1
        while reach <= (int(lengths.max()) if len(lengths) else 0):
            behind = np.zeros(size, np.int64)
            behind[: size - reach] = rank[reach:] + 1
            _, rank = np.unique(rank * (size + 2) + behind, return_inverse=True)
            self.levels.append(rank)
            reach *= 2
        self.order = np.argsort(rank, kind="stable")
        before = self.code[self.order - 1]  # the transform: the symbol in front of each row's suffix (cyclic)
        self.heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))  # rows at which a run begins
        self.sampled = self._samples()
        # what is kept: the run heads' samples, and the suffix order to hand out classes by; the symbols and levels are done with
        del self.levels, self.code

    def _extent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and at b."""
        a, b, length = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero((a < self.size) & (b < self.size))
            same = fits[self.levels[k][a[fits]] == self.levels[k][b[fits]]]
            for x in (a, b, length):
                x[same] += 1 << k
        return length

    def _samples(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, statistic): of the suffixes at run heads, and of the first and the least suffix."""
        heads = self.heads[self.heads > 0]
        position, value = self.order[heads], self._extent(self.order[heads], self.order[heads - 1])
        if self.size:
            row = int(np.flatnonzero(self.order == 0)[0])
            start = self._extent(np.zeros(1, np.int64), self.order[row - 1 : row]) if row else np.zeros(1, np.int64)
            position, value = np.concatenate([position, [0, self.order[0]]]), np.concatenate([value, start, [0]])
        return position, value

    def statistics(self) -> np.ndarray:
        """For each text position, how many symbols its suffix shares with the one before it in suffix order (0 for the first)."""
        position, sample = self.sampled
        value = np.zeros(self.size, np.int64)
        known = np.zeros(self.size, bool)
        value[position], known[position] = sample, True
        source = np.maximum.accumulate(np.where(known, np.arange(self.size), 0))
        return np.maximum(0, value[source] - (np.arange(self.size) - source))

    def classes(self, depth: int) -> np.ndarray:
        """For each position of the strings' symbols the number of its depth-symbol prefix, equal for equal ones; -1 for a single one.

        A prefix that would run over its string's end is single.
        """
        shared = self.statistics()[self.order] >= depth
        number = np.cumsum(~shared)
        many = shared | np.concatenate([shared[1:], [False]])
        out = np.full(self.size, -1)
        out[self.order] = np.where(many, number, -1)
        return out[self.inside]
