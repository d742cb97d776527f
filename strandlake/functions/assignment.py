"""One-to-one assignment of the greatest total gain over the pairs that have any, for use inside a bounded group."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np


def matching(pairs: Iterable[tuple[int, int, int]]) -> set[tuple[int, int]]:
    """(left, right) pairs of the greatest total gain, nobody twice; pairs: (left, right, whole gain), of repeated ones the last counts.

    Only pairs with a gain are kept in memory. Everybody has a worth, and the worths of two
    that could pair cover their gain: so no matching gains more than all worths, and one
    whose partners' worths are just their gain, all others worth nothing, gains the most.
    Left ones come in one by one, worth the best they could add; a search by slack (least
    first) finds the cheapest way to lower that to what the others' worths allow, ending at
    a right one that is free or at a left one that is worth no more than being left out.
    Which of several best matchings is found depends on nothing but the sorted pairs.
    """
    near: dict[int, dict[int, int]] = {}
    for left, right, gain in sorted(pairs):
        if gain > 0:
            near.setdefault(left, {})[right] = gain
    worth_left: dict[int, int] = {}
    worth_right: dict[int, int] = {}
    partner: dict[int, int] = {}  # of right ones
    taken: dict[int, int] = {}  # of left ones
    for start, options in near.items():
        worth_left[start] = max(gain - worth_right.get(right, 0) for right, gain in options.items())
        if worth_left[start] <= 0:
            worth_left[start] = 0
            continue
        lefts, rights, came = {start: 0}, {}, {}
        heap: list[tuple[int, bool, int, int]] = []  # slack, whether the right one is taken, it, who leads there
        at, paid = start, 0
        out_cost, out_left = worth_left[start], start  # leaving start out
        while True:
            for right, gain in near[at].items():
                if right not in rights:
                    heapq.heappush(heap, (paid + worth_left[at] + worth_right.get(right, 0) - gain, right in partner, right, at))
            while heap and heap[0][2] in rights:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= out_cost:
                end, cost = None, out_cost
                break
            paid, _, right, came_from = heapq.heappop(heap)
            rights[right], came[right] = paid, came_from
            if right not in partner:
                end, cost = right, paid
                break
            at = partner[right]
            lefts[at] = paid
            if paid + worth_left[at] < out_cost:
                out_cost, out_left = paid + worth_left[at], at
        for left, reached in lefts.items():
            worth_left[left] -= cost - min(reached, cost)
        for right, reached in rights.items():
            worth_right[right] = worth_right.get(right, 0) + cost - min(reached, cost)
        if end is None:
            if out_left == start:
                continue
            end = taken.pop(out_left)  # whoever is left out frees its partner
        while end is not None:  # partners move up along the way back to start
            left = came[end]
            partner[end] = left
            taken[left], end = end, taken.get(left)
    return set(taken.items())


def best_pairs(gain: np.ndarray) -> list[tuple[int, int]]:
    """matching() of a table of whole gains, in order."""
    rows, columns = np.nonzero(np.asarray(gain) > 0)
    return sorted(matching(zip(rows.tolist(), columns.tolist(), (int(gain[r, c]) for r, c in zip(rows, columns)))))
