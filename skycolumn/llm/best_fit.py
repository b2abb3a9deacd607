"""Best-fit-decreasing packing with a segment tree over free capacities."""

from __future__ import annotations

import numpy as np


class FreeSpace:
    """Bins by free capacity; finds the bin with the least capacity that still fits (a segment tree of counts)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, bin_: int) -> None:
        self.bins[free].append(bin_)
        self._change(free, 1)

    def _change(self, free: int, by: int) -> None:
        i = free + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, bin) of the tightest bin with at least ``need`` free, removed; None if there is none."""
        i, count = need + self.leaves, self.count
        while not count[i]:
            while i & 1:  # the right end of a subtree: go up
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        free = i - self.leaves
        self._change(free, -1)
        return free, self.bins[free].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the load of each bin. Lengths are 1..capacity; equal lengths keep their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    space, loads = FreeSpace(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = space.take(need)
        if found is None:
            found = capacity, len(loads)
            loads.append(0)
        free, bin_ = found
        bins[i], offsets[i] = bin_, loads[bin_]
        loads[bin_] += need
        if free > need:
            space.add(free - need, bin_)
    return bins, offsets, np.array(loads, dtype=np.int64)


def lower_bound(counts: np.ndarray, capacity: int, most: int = 30) -> int:
    """A proven least number of bins for ``counts[length]`` items of each length 0..capacity, from dual feasible functions.

    Two families: one rounds small items to nothing and large ones to a whole bin, the other rounds every item down
    to multiples of 1/k. The sum of the values of any packing is at most one per bin.
    """
    counts = counts.astype(object) if counts.sum() > 1 << 40 else counts.astype(np.int64)
    length = np.arange(capacity + 1)
    best = 0
    tail = np.cumsum(counts[::-1])[::-1]  # items of at least this length
    mass = np.concatenate(([0], np.cumsum(counts * length)))
    for e in range(capacity // 2 + 1):
        large = int(tail[capacity - e + 1]) if e else 0
        middle = int(mass[capacity - e + 1] - mass[e])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, most + 1):
        whole = (k + 1) * length % capacity == 0
        value = np.where(whole, length * k, (k + 1) * length // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best
