"""Suffix arrays of shards by induced sorting, from anchors outwards.

A shard is a list of contexts: the bytes around an anchor, which is the least gram of every string that the context
holds. Its suffixes are classified into those that begin at an anchor and those that begin to the left of one. The first
are sorted as what follows them, and permuted common prefixes with their neighbours are taken. The order of the others is
induced, one distance from the anchor after the other: suffixes at distance i are in the order of their first byte and,
within it, of the suffixes at distance i - 1, so each distance is one stable counting pass over the last one's order.
Equal strings stand at equal distances from equal anchors; suffixes of different distances need no comparison.
"""

from __future__ import annotations

import numpy as np


class RangeLeast:
    """The least of any run of numbers, from the least of all runs whose length is a power of two."""

    def __init__(self, x: np.ndarray):
        rows = [x]
        size = 1
        while 2 * size <= len(x):
            last = rows[-1]
            rows.append(np.concatenate([np.minimum(last[:-size], last[size:]), last[-size:]]))
            size *= 2
        self.rows = np.array(rows)
        self.log = np.zeros(len(x) + 1, np.int64)
        for k in range(1, len(rows)):
            self.log[1 << k :] = k

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        k = self.log[end - first]
        return np.minimum(self.rows[k, first], self.rows[k, end - (1 << k)])


def right_parts(flat: np.ndarray, anchor: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at anchors by group and bytes (size: how many each has), and of each place in it how many bytes it shares with the place before (none with another group)."""
    width = int(size.max())
    column = np.arange(width)
    inside = column < size[:, None]
    part = np.zeros((len(anchor), width), np.uint8)
    part[inside] = flat[(anchor[:, None] + column)[inside]]
    # numpy's byte strings end at trailing zeros, so of suffixes that differ in these alone the size decides: the shorter is first
    named = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), part, size.astype(">u4").view(np.uint8).reshape(-1, 4)], 1)
    order = np.argsort(named.view(f"S{width + 8}").ravel(), kind="stable")
    one, two = order[:-1], order[1:]
    differ = part[one] != part[two]
    shared = np.where(differ.any(1), differ.argmax(1), width)
    shared = np.minimum(shared, np.minimum(size[one], size[two]))
    shared[group[one] != group[two]] = 0
    return order, np.concatenate([[0], shared])


def repeats(flat: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray, group: np.ndarray, length: int, needed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each context the least and the greatest distance from its anchor at which a string of `length` bytes begins that another context of its group has too (-1: none).

    flat: bytes of all contexts; start, size, left: where each begins, its bytes, and its bytes before the anchor. needed
    (contexts x distances): becomes False where a string repeats that of another context before it in the order.
    """
    anchor = start + left
    who, shared = right_parts(flat, anchor, size - left, group)
    common = RangeLeast(shared)
    place = np.arange(len(who))
    same = group[who]
    least, most = np.full(len(start), -1), np.full(len(start), -1)
    for i in range(int(left.max(initial=0)) + 1):
        if i:
            stay = left[who] >= i
            who, place, same = who[stay], place[stay], same[stay]
            key = same * 256 + flat[anchor[who] - i]
            order = np.argsort(key, kind="stable")
            who, place, same = who[order], place[order], key[order]
        if len(who) < 2:
            break
        new = same[1:] != same[:-1]
        begins, ends = np.concatenate([[True], new]), np.concatenate([new, [True]])
        stay = ~(begins & ends)  # alone with its left part: no string further left repeats
        who, place, same = who[stay], place[stay], np.cumsum(begins)[stay]
        if not len(who):
            break
        pair = np.flatnonzero(same[1:] == same[:-1])
        equal = np.zeros(len(who) - 1, bool)
        equal[pair] = common(place[pair] + 1, place[pair + 1] + 1) >= length - i
        again = np.zeros(len(who), bool)
        again[1:] |= equal
        again[:-1] |= equal
        hit = who[again]
        most[hit] = i
        least[hit[least[hit] < 0]] = i
        if needed is not None:
            needed[who[1:][equal], i] = False
    return least, most
