"""Burrows-Wheeler transforms of string collections, and their merge by interleave refinement.

Sorts are those of single 64-bit integers whose low bits hold the row, several times faster than index sorts.
"""

from __future__ import annotations

import numpy as np


def _ranked(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys): ``key`` has to leave ``bits`` bits for the rows."""
    packed = np.sort(key << bits | np.arange(len(key)))
    return packed & ((1 << bits) - 1), packed >> bits


def shard(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transform, string, offset) of all suffixes in sorted order, end marks included.

    Symbols: 0 is the end mark, a byte is its value + 1. Equal suffixes are in the order of
    their whole strings, so that the k-th end mark of the transform belongs to the k-th row.
    """
    order = sorted(range(len(strings)), key=strings.__getitem__)
    lengths = np.array([len(strings[k]) + 1 for k in order], np.int64)
    n, m = int(lengths.sum()), len(order)
    starts = np.cumsum(lengths) - lengths
    marks = starts + lengths - 1
    symbols = np.frombuffer(b"\0".join([strings[k] for k in order] + [b""]), np.uint8).astype(np.uint16) + 1
    symbols[marks] = 0
    at, bits = np.arange(n), n.bit_length()
    left = np.repeat(marks, lengths) - at  # symbols before the end mark
    width = max(1, (62 - bits) // 9)
    key = np.zeros(n, np.int64)
    for k in range(width):  # zeros beyond the end mark
        key = key << 9 | np.where(k < left, symbols[np.minimum(at + k, n - 1)], 0)
    while True:
        suffix, sorted_key = _ranked(key, bits)
        rank = np.empty(n, np.int64)
        rank[suffix] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        if width >= int(lengths.max()):
            break
        after = np.where(width <= left, rank[np.minimum(at + width, n - 1)] + 1, 0)
        if 3 * bits < 62:
            key = rank << (bits + 1) | after
        else:  # too many rows for three numbers in one: rank the pairs by an index sort
            pair = np.lexsort((after, rank))
            new = np.concatenate(([False], (rank[pair][1:] != rank[pair][:-1]) | (after[pair][1:] != after[pair][:-1])))
            key = np.empty(n, np.int64)
            key[pair] = np.cumsum(new)
        width *= 2
    # Suffixes of equal rank: rows are in the order of their strings already, as positions are.
    owner = np.repeat(np.arange(m), lengths)[suffix]
    before = np.where(suffix == starts[owner], marks[owner], suffix - 1)
    return symbols[before], np.array(order)[owner], suffix - starts[owner]


def merge(transforms: list[np.ndarray], depth: int, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, interval, common) after the interleave of several transforms is refined to ``depth`` symbols.

    ``row``: index into the joined shards of every suffix that shares ``depth`` symbols with another, in merged
    order; ``interval``: its repeated interval; ``common``: for each joined row the longest prefix, up to
    ``depth``, that it shares with any other (known at each ``step`` symbols only).

    The interleave starts as the shards one after the other and is refined by ``step`` symbols a round: rows are dealt,
    in their present order, to the symbols before them. No suffix is compared or sorted again. A row alone in its
    interval has its place, and so have the rows that would be dealt from it: they take no part any more.
    """
    joined = np.concatenate(transforms)
    present = np.zeros(257, bool)
    present[joined] = True
    present[0] = True
    joined = (np.cumsum(present) - 1)[joined]  # dense symbols, 0 stays the end mark
    n, wide = len(joined), int(present.sum()).bit_length()
    bits = n.bit_length()
    home, at = np.empty(n, np.int64), 0  # where a shard deals each of its rows
    for t in transforms:
        home[at + np.argsort(joined[at : at + len(t)].astype(np.uint16), kind="stable")] = np.arange(at, at + len(t))
        at += len(t)
    both = home << wide | joined  # one look-up gives the place and the symbol
    row, interval = np.arange(n), np.zeros(n, np.int64)
    common = np.zeros(n, np.int64)
    length, most = 0, max(1, (62 - bits) // wide)
    while length < depth and len(row):
        k = min(step, most, depth - length)
        key = open_ = None
        for j in range(k):
            found = both[row]
            symbol, row = found & ((1 << wide) - 1), found >> wide
            open_ = symbol > 0 if open_ is None else open_ & (symbol > 0)  # nothing goes on beyond an end mark
            key = symbol if key is None else symbol << (j * wide) | key
        alive = np.flatnonzero(open_)
        row, interval = row[alive], interval[alive]
        dealt, key = _ranked(key[alive], bits)
        block = interval[dealt]
        new = np.ones(len(dealt) + 1, bool)
        new[1:-1] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
        stays = np.flatnonzero(~(new[:-1] & new[1:]))
        row, interval = row[dealt[stays]], np.cumsum(new[stays])
        length += k
        common[row] = length
    return row, interval, common
