"""Suffix order of byte strings by two-stage sorting, as far as a given depth."""

from __future__ import annotations

import numpy as np

WORD = 8


def loads(data: np.ndarray, pad: int) -> np.ndarray:
    """The eight bytes from each place of data on, as big-endian numbers; pad zeros follow the end."""
    padded = np.concatenate([data, np.zeros(pad + WORD, np.uint8)])
    return np.ndarray((len(data) + pad,), ">u8", padded, strides=(1,)).astype(np.uint64)


def rising(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one, before the end, is not."""
    n = len(data)
    change = np.flatnonzero(data[1:] != data[:-1])
    run_end = np.append(change, n - 1)[np.searchsorted(change, np.arange(n))]
    return (run_end < n - 1) & (data[np.minimum(run_end + 1, n - 1)] > data)


def sorted_directly(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """places, by the depth bytes from each on; eight bytes at a time, and only where all before were equal."""
    order = places[np.argsort(words[places], kind="stable")]
    first = words[order]
    start = np.concatenate([[True], first[1:] != first[:-1]])
    for at in range(WORD, depth, WORD):
        group = np.cumsum(start)
        tied = ~start
        tied[:-1] |= ~start[1:]
        ix = np.flatnonzero(tied)
        if not len(ix):
            break
        key = words[order[ix] + at]
        if not ((key[1:] != key[:-1]) & (group[ix[1:]] == group[ix[:-1]])).any():
            continue
        again = np.lexsort((key, group[ix]))
        order[ix] = order[ix][again]
        key, same = key[again], group[ix]
        start[ix[1:]] |= (key[1:] != key[:-1]) & (same[1:] == same[:-1])
    return order


def suffix_order(data: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """All places of data, sorted by the depth bytes (or more) from each on.

    Suffixes smaller than their successors are sorted directly. The others are induced: buckets of a first byte are
    scanned in order, and each suffix met puts the one before it, if that is a larger one, at the end of what its own
    bucket has of larger ones so far. Equal prefixes stand in any order: of a run of one byte, what lies more than depth
    before its end is put down at once.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    small = rising(data)
    direct = sorted_directly(words, np.flatnonzero(small), depth)
    bounds = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[n - 1]].append(np.array([n - 1]))
    out = []

    def scan(found: np.ndarray, byte: int) -> np.ndarray:
        """Deal out the predecessors of a part of bucket byte; those of the same bucket are returned."""
        before = found[found > 0] - 1
        before = before[~small[before]]
        bytes_ = data[before]
        by = np.argsort(bytes_, kind="stable")
        before, bytes_ = before[by], bytes_[by]
        ends = np.flatnonzero(np.concatenate([bytes_[1:] != bytes_[:-1], [True]])) + 1 if len(bytes_) else []
        own, first = before[:0], 0
        for end in ends:
            b = bytes_[first]
            if b == byte:
                own = before[first:end]
            else:
                waiting[b].append(before[first:end])
            first = end
        return own

    run_starts = np.concatenate([[0], np.flatnonzero(data[1:] != data[:-1]) + 1])
    for byte in range(256):
        part = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        for _ in range(depth):
            if not len(part):
                break
            out.append(part)
            part = scan(part, byte)
        if len(part):
            number = part - run_starts[np.searchsorted(run_starts, part, "right") - 1] + 1
            part = np.repeat(part, number) - (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number))
            out.append(part)
            scan(part, byte)
        part = direct[bounds[byte] : bounds[byte + 1]]
        if len(part):
            out.append(part)
            scan(part, byte)
    return np.concatenate(out)


def common_prefixes(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each place of order shares with the one before it, to depth at most; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    ix = np.arange(1, len(order))
    for at in range(0, depth, WORD):
        if not len(ix):
            break
        differ = words[order[ix] + at] ^ words[order[ix - 1] + at]
        out[ix] = at + WORD
        apart = differ != 0
        if apart.any():
            top = differ[apart].astype(">u8").view(np.uint8).reshape(-1, WORD)
            out[ix[apart]] = at + (top != 0).argmax(1)
        ix = ix[~apart]
    return np.minimum(out, depth)
