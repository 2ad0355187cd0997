"""Enhanced suffix arrays of a few megabytes of text, and the maximal repeats that their common-prefix intervals are."""

from __future__ import annotations

import numpy as np

#: Bytes that the first ranks tell apart; each further level doubles them.
FIRST = 7
#: Before a suffix lies the edge of its text, or different bytes: it cannot be extended to the left.
DIVERSE = -1


class SuffixArray:
    """The suffixes of some texts that are ``least`` bytes long or more, in order.

    A suffix ends with its text. ``order``: their places in the joined texts; ``common``:
    how many bytes each shares with the one before it, 0 if fewer than ``least``.
    """

    def __init__(self, texts: list[bytes], least: int) -> None:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.starts = np.cumsum(lengths) - lengths
        self.owner = np.repeat(np.arange(len(texts)), lengths)
        self.left = np.repeat(self.starts + lengths, lengths) - np.arange(len(self.data))
        self.levels: list[tuple[int, np.ndarray]] = []
        longest = int(lengths.max(initial=0))
        width = min(FIRST, least)
        self.levels.append((width, _ranks(self._packed(width))))
        while 2 * width <= least:
            self.levels.append((2 * width, _ranks(self._paired(width, self.levels[-1][1]))))
            width *= 2
        self.order = np.flatnonzero(self.left >= least)
        keys = [self._after(at, self.order, self.levels[-1][1]) for at in range(0, longest, width)]
        self.order = self.order[np.lexsort(keys[::-1])] if keys else self.order
        self.common = self._neighbours(least, longest)

    def _packed(self, width: int) -> np.ndarray:
        """The first bytes of each suffix, and how many of them its text has."""
        n = len(self.data)
        padded = np.concatenate([self.data, np.zeros(width, np.uint8)])
        key = np.zeros(n, np.uint64)
        for i in range(width):
            key = (key << np.uint64(8)) | np.where(self.left > i, padded[i : n + i], 0).astype(np.uint64)
        return (key << np.uint64(8)) | np.minimum(self.left, width).astype(np.uint64)

    def _after(self, width: int, places: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Ranks of what follows ``width`` bytes on, one up; 0 where the text has ended."""
        inside = self.left[places] > width
        return np.where(inside, ranks[np.where(inside, places + width, 0)] + 1, 0)

    def _paired(self, width: int, ranks: np.ndarray) -> np.ndarray:
        n = len(self.data)
        return ranks * (n + 2) + self._after(width, np.arange(n), ranks)

    def _neighbours(self, least: int, longest: int) -> np.ndarray:
        common = np.zeros(len(self.order), np.int64)
        if len(self.order) < 2:
            return common
        width, ranks = self.levels[-1]
        near = np.flatnonzero(ranks[self.order[1:]] == ranks[self.order[:-1]]) + 1
        a, b = self.order[near - 1], self.order[near]
        both = np.minimum(self.left[a], self.left[b])
        same = np.zeros(len(near), np.int64)
        steps = [self.levels[-1]] * (longest // width + 1) + self.levels[-2::-1]
        for width, ranks in steps:
            inside = same < both
            at = np.where(inside, same, 0)
            equal = inside & (ranks[a + at] == ranks[b + at])
            same += np.where(equal, np.minimum(width, both - same), 0)
        for _ in range(self.levels[0][0] - 1):
            inside = same < both
            at = np.where(inside, same, 0)
            same += inside & (self.data[a + at] == self.data[b + at])
        common[near] = np.where(same >= least, same, 0)
        return common

    def before(self, places: np.ndarray) -> np.ndarray:
        """The byte before each suffix; DIVERSE at the edge of its text."""
        at_edge = places == self.starts[self.owner[places]]
        return np.where(at_edge, DIVERSE, self.data[np.maximum(places - 1, 0)].astype(np.int64))


def _ranks(key: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the order of the keys, the same for equal ones."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]) if len(key) else np.zeros(0, np.int64)
    ranks = np.empty(len(key), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def maximal_repeats(suffixes: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """(groups, covered): groups has (first rank, last rank, length) of each maximal repeat; its occurrences are all suffixes of these ranks.

    covered has for each rank the length of the longest of them that the suffix begins with, 0 if none.
    One scan with a stack builds the tree of common-prefix intervals from its leaves.
    An interval cannot be extended to the right; it is maximal if the bytes before its
    suffixes differ, or if one lies at the edge of its text.
    """
    common, before = suffixes.common, suffixes.before(suffixes.order)
    covered = np.zeros(len(suffixes.order), np.int64)
    joined = np.flatnonzero(common > 0)
    if not len(joined):
        return np.zeros((0, 3), np.int64), covered
    ends = np.flatnonzero(np.diff(joined, append=joined[-1] + 2) > 1)
    begins = np.concatenate([[0], ends[:-1] + 1])
    firsts, lasts = joined[begins] - 1, joined[ends]
    # What all of a run extends to the left alike has no maximal interval.
    turns = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (before[1:] == DIVERSE))])
    open_ = (turns[lasts] > turns[firsts]) | (before[firsts] == DIVERSE)
    firsts, lasts = firsts[open_], lasts[open_]
    pairs = lasts == firsts + 1
    groups = [np.column_stack([firsts[pairs], lasts[pairs], common[lasts[pairs]]])]
    covered[firsts[pairs]] = covered[lasts[pairs]] = common[lasts[pairs]]
    found: list[tuple[int, int, int]] = []
    for first, last in zip(firsts[~pairs].tolist(), lasts[~pairs].tolist(), strict=True):
        _scan(first, common[first + 1 : last + 1].tolist(), before[first : last + 1].tolist(), found, covered)
    groups.append(np.array(found, np.int64).reshape(-1, 3))
    return np.concatenate(groups), covered


def _scan(start: int, common: list[int], before: list[int], found: list, covered: np.ndarray) -> None:
    """The maximal intervals of a run of suffixes, the inner ones first."""
    stack: list[list] = []  # depth, first, byte before, ranks that no maximal interval has yet
    common.append(0)
    for i, depth in enumerate(common):
        first, byte, waiting = i, before[i], [i]
        while stack and stack[-1][0] > depth:
            deep, first, other, more = stack.pop()
            byte = byte if byte == other else DIVERSE
            if len(more) < len(waiting):
                more, waiting = waiting, more
            more += waiting
            waiting = more
            if byte == DIVERSE:
                found.append((start + first, start + i, deep))
                covered[[start + x for x in waiting]] = deep
                waiting = []
        if stack and stack[-1][0] == depth:
            top = stack[-1]
            top[2] = top[2] if top[2] == byte else DIVERSE
            top[3] += waiting
        elif depth:
            stack.append([depth, first, byte, waiting])
