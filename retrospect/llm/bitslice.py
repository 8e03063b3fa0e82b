"""Bit-sliced Hamming comparison of 64-bit fingerprints.

Fingerprints are kept as bit planes: plane b holds bit b of 64 fingerprints a word. XOR with a
query's bit gives, for 64 distances at once, whether that bit differs; a carry-save chain of
vertical counters adds it up. Counters saturate: a lane whose count exceeds the radius is out for
good, and a block is abandoned once all its lanes are out."""

from __future__ import annotations

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
BITS = 64
#: Planes between two looks at whether a block can be abandoned.
STRIDE = 8


def planes(prints: np.ndarray) -> np.ndarray:
    """(64, ceil(n / 64)) bit planes of n fingerprints; lane k of word w is fingerprint 64 w + k."""
    n = -(-len(prints) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64).reshape(BITS, n // 64)


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the lanes set in a vector of words."""
    return np.flatnonzero(np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little")[:n])


def within(differ, out: np.ndarray, radius: int) -> np.ndarray:
    """Lanes with at most ``radius`` differing bits. ``differ(b, at)`` gives plane b of the
    differences for the words ``at``; ``out`` has the lanes that are out from the start. Words with
    all lanes out are abandoned: later planes are not looked at for them."""
    depth = max(1, int(radius).bit_length())
    at = np.flatnonzero(out != ALL)
    dead = out[at].copy()
    count = [np.zeros(len(at), np.uint64) for _ in range(depth)]
    for b in range(BITS):
        if not len(at):
            break
        carry = differ(b, at)
        for d in range(depth):  # carry-save: a half adder for each level of the counter
            count[d], carry = count[d] ^ carry, count[d] & carry
        dead |= carry  # the counter ran over: over 2**depth - 1 bits differ
        if b % STRIDE == STRIDE - 1 or b == BITS - 1:
            dead |= _over(count, radius)
            live = np.flatnonzero(dead != ALL)
            if len(live) < len(at):
                at, dead, count = at[live], dead[live], [c[live] for c in count]
    alive = np.zeros(len(out), np.uint64)
    alive[at] = ~dead
    return alive


def _over(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter is above ``radius``: compare from the highest level down."""
    over, same = np.zeros_like(count[0]), np.full_like(count[0], ALL)
    for d in range(len(count) - 1, -1, -1):
        if radius >> d & 1:
            same &= count[d]
        else:
            over |= same & count[d]
            same &= ~count[d]
    return over


def shifted_pairs(prints: np.ndarray, last: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j), i < j <= last[i], within the radius: row i is compared with row i + d for
    d = 1, 2, ..., many rows at once. For rows sorted by groups, last[i] is the end of i's group."""
    n, ahead = len(prints), last - np.arange(len(prints))
    found_i, found_j = [], []
    for d in range(1, int(ahead.max(initial=0)) + 1):
        rows = np.flatnonzero(ahead >= d)
        a, b = planes(prints[rows]), planes(prints[rows + d])
        out = np.zeros(a.shape[1], np.uint64)
        if len(rows) % 64:
            out[-1] = ALL << np.uint64(len(rows) % 64)
        hit = lanes(within(lambda p, at, a=a, b=b: a[p, at] ^ b[p, at], out, radius), len(rows))
        found_i.append(rows[hit])
        found_j.append(rows[hit] + d)
    none = np.empty(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def spanning_links(prints: np.ndarray, radius: int, queries: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph "within the radius" over one large group: a search from
    seed to seed in which each fingerprint is held once against those not reached yet. Those
    reached leave the planes, so a dense cluster of n costs near n comparisons and gives n - 1
    links, never its pairs."""
    n = len(prints)
    left, tree_i, tree_j = np.arange(n), [], []
    frontier: list[int] = []
    while len(left) or frontier:
        if not frontier:
            frontier, left = [int(left[0])], left[1:]
        if not len(left):
            break
        now, frontier = frontier[:queries], frontier[queries:]
        sliced = planes(prints[left])
        blank = np.zeros(sliced.shape[1], np.uint64)
        if len(left) % 64:
            blank[-1] = ALL << np.uint64(len(left) % 64)
        asked = np.repeat(prints[now], sliced.shape[1])  # one word for each query and 64 lanes
        word = np.tile(np.arange(sliced.shape[1]), len(now))

        def differ(b, at, sliced=sliced, asked=asked, word=word):
            return sliced[b, word[at]] ^ (np.uint64(0) - (asked[at] >> np.uint64(b) & np.uint64(1)))

        alive = within(differ, np.tile(blank, len(now)), radius).reshape(len(now), -1)
        gone = np.zeros(len(left), bool)
        for q, words in zip(now, alive, strict=True):
            hit = lanes(words, len(left))
            hit = hit[~gone[hit]]
            gone[hit] = True
            tree_i.append(np.full(len(hit), q))
            tree_j.append(left[hit])
            frontier += left[hit].tolist()
        left = left[~gone]
    none = np.empty(0, np.int64)
    return (np.concatenate(tree_i), np.concatenate(tree_j)) if tree_i else (none, none)


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node reachable by the links (i, j)."""
    label = np.arange(n)
    while True:
        was = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == was).all():
            return label
