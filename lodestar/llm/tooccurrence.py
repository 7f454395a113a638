"""T-occurrence search by DivideSkip over an in-memory inverted index.

A query's inverted lists are divided: the longest L are set aside, the short ones are merged on a
heap that skips records which cannot reach the count still needed (MergeSkip), and what survives is
looked up in the long lists by binary search, until the required overlap is reached or out of reach.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from math import log2

MU = 0.0085  # how dear a probe of a long list is against a step of the merge


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(record, count) of the records in at least ``least`` of the sorted lists."""
    out: list[tuple[int, int]] = []
    at = [0] * len(lists)
    heap = [(x[0], k) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while len(heap) >= least:
        top = heap[0][0]
        taken = []
        while heap and heap[0][0] == top:
            taken.append(pop(heap)[1])
        if len(taken) >= least:
            out.append((top, len(taken)))
            for k in taken:
                at[k] += 1
                if at[k] < len(lists[k]):
                    push(heap, (lists[k][at[k]], k))
            continue
        while heap and len(taken) < least - 1:  # these cannot hold a match before the next one's record
            taken.append(pop(heap)[1])
        if not heap:
            break
        frontier = heap[0][0]
        for k in taken:
            at[k] = bisect_left(lists[k], frontier, at[k])
            if at[k] < len(lists[k]):
                push(heap, (lists[k][at[k]], k))
    return out


def divide_skip(lists: list[list[int]], least: int, needed, skip) -> list[int]:
    """Records whose count over all lists reaches needed(record), which is never under ``least``.
    skip(record): the record is of no interest (asked before it is looked up)."""
    if least < 1 or len(lists) < least:
        return []
    lists = sorted(lists, key=len)
    longest = len(lists[-1])
    n_long = min(least - 1, int(least / (MU * log2(longest + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    out = []
    for record, count in merge_skip(short, least - n_long):
        if skip(record):
            continue
        wanted = needed(record)
        for k, x in enumerate(long):
            if count >= wanted or count + len(long) - k < wanted:
                break
            i = bisect_left(x, record)
            count += i < len(x) and x[i] == record
        if count >= wanted:
            out.append(record)
    return out


class Forest:
    """Union-find with sizes."""

    def __init__(self, n: int):
        self.up, self.size = list(range(n)), [1] * n

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if self.size[x] < self.size[y]:
            x, y = y, x
        self.up[y] = x
        self.size[x] += self.size[y]
        return True


def connect(sizes: list[int], tokens: list[list[int]], labels: list[int], share: tuple[int, int], split: int | None = None) -> list[tuple[int, int]]:
    """Links that connect records whose sets have share[0]/share[1] of their union in common.

    tokens: of each record, without those that no other record of the corpus has. labels: records
    of one label are connected already. split: only links between records before and from this
    place matter. Not every link is returned, but with the labels the result connects all that
    all links would: a query leaves out records connected to it, and records of what is the largest
    component at the end need no query of their own, as any link out of it has another end.
    """
    num, den = share
    index: dict[int, list[int]] = {}
    n = len(sizes)
    held = range(n) if split is None else range(split, n)
    for r in held:
        for t in tokens[r]:
            index.setdefault(t, []).append(r)
    forest, links = Forest(n), []
    seen: dict[int, int] = {}
    for r, label in enumerate(labels):
        if label in seen:
            forest.join(seen[label], r)
        seen.setdefault(label, r)

    def query(x: int) -> None:
        own = [v for t in tokens[x] if (v := index.get(t)) is not None and (len(v) > 1 or v[0] != x)]
        nx = sizes[x]

        def skip(y: int) -> bool:
            ny = sizes[y]
            return den * min(nx, ny) < num * max(nx, ny) or forest.find(y) == forest.find(x)

        for y in divide_skip(own, -(-num * nx // den), lambda y: -(-num * (nx + sizes[y]) // (num + den)), skip):
            if forest.join(x, y):
                links.append((x, y))

    if split is not None:
        for x in range(split):
            query(x)
        return links
    asked = [False] * n
    best = max(range(n), key=lambda r: forest.size[forest.find(r)], default=0)
    while True:
        waiting = [r for r in range(n) if not asked[r] and forest.find(r) != forest.find(best)]
        if not waiting:
            return links
        for x in waiting:
            if forest.find(x) == forest.find(best):
                continue  # asked in a later round if another component outgrows this one
            asked[x] = True
            query(x)
            if forest.size[forest.find(x)] > forest.size[forest.find(best)]:
                best = x
