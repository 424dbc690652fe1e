"""Suffix arrays of byte strings by two-stage sorting, in whole-array steps.

A suffix is small if it is less than the one that follows it, else large. Only small suffixes are sorted directly.
A large suffix begins with a byte not below its successor's, so a scan of the buckets of first bytes, in rising
order, meets each successor before it and puts the large one behind those that came into its bucket before;
equal bytes in a row go round within their bucket. Where only some suffixes are wanted, the others are left
out, but for those from a wanted one up to the next small one, whose order hangs on each other.

Order and common prefixes are those of the first `depth` bytes; suffixes that are equal so far stand next to each
other. The bytes must end with `END`, so that some small suffix follows every wanted one.
"""

from __future__ import annotations

import numpy as np

END = b"\x00\xff"
_AT_ONCE = 5  # bytes that a direct sort compares in one pass, below a group number of 24 bits
_WORD = 8


def words(data: np.ndarray) -> np.ndarray:
    """The next 8 bytes at every place, the first one highest; zeros stand beyond the end."""
    ahead, out = np.concatenate([data, np.zeros(_WORD, np.uint8)]).astype(np.uint64), np.zeros(len(data), np.uint64)
    for k in range(_WORD):
        out = out << np.uint64(8) | ahead[k : k + len(data)]
    return out


def is_small(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than its successor; the last one isn't."""
    differs = np.concatenate([data[1:] != data[:-1], [True]])
    rises = np.concatenate([data[:-1] < data[1:], [False]])
    decides = np.minimum.accumulate(np.where(differs, np.arange(len(data)), len(data))[::-1])[::-1]
    return rises[decides]  # a run of equal bytes goes the way it ends


def with_chains(wanted: np.ndarray, small: np.ndarray) -> np.ndarray:
    """`wanted` places and what follows each, up to the next small one."""
    at = np.arange(len(small))
    upto = np.minimum.accumulate(np.where(small, at, len(small))[::-1])[::-1]
    last = np.maximum.accumulate(np.where(wanted, upto, -1))
    return at <= last


def sort_small(places: np.ndarray, ahead: np.ndarray, depth: int) -> np.ndarray:
    """`places` in the order of their first `depth` bytes, some bytes at a time, while any are equal."""
    order, group, open_ = places.copy(), np.zeros(len(places), np.uint64), np.arange(len(places))
    for at in range(0, depth, _AT_ONCE):
        if not len(open_):
            break
        next_ = ahead[np.minimum(order[open_] + at, len(ahead) - 1)] >> np.uint64(8 * (_WORD - _AT_ONCE))
        key = group[open_] << np.uint64(8 * _AT_ONCE) | next_
        by = np.argsort(key)
        key, order[open_] = key[by], order[open_][by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        tied = ~new
        tied[:-1] |= ~new[1:]
        open_ = open_[tied]
    return order


def suffix_array(data: np.ndarray, wanted: np.ndarray, ahead: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places of `data` (16 M bytes at most) in the order of their suffixes."""
    small = is_small(data)
    needed = with_chains(wanted, small)
    direct = sort_small(np.flatnonzero(small & needed), ahead, depth)
    large = needed & ~small
    edges = np.searchsorted(data[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        parts, wave = [], np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(wave):
            parts.append(wave)
            before = wave[wave > 0] - 1
            wave = before[large[before] & (data[before] == c)]
        parts.append(direct[edges[c] : edges[c + 1]])
        bucket = np.concatenate(parts)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[large[before] & (data[before] > c)]
        heads = data[before]
        by = np.argsort(heads, kind="stable")
        before, heads = before[by], heads[by]
        for part in np.split(before, np.flatnonzero(heads[1:] != heads[:-1]) + 1) if len(before) else []:
            induced[int(data[part[0]])].append(part)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(order: np.ndarray, ahead: np.ndarray, depth: int) -> np.ndarray:
    """Bytes, `depth` at most, that each suffix shares with the one before it in order; 0 for the first."""
    a, b = order[:-1], order[1:]
    out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    for at in range(0, depth, _WORD):
        end = len(ahead) - 1
        differ = ahead[np.minimum(a[open_] + at, end)] ^ ahead[np.minimum(b[open_] + at, end)]
        same = differ == 0
        part = open_[~same]
        out[part] = at + sum((differ[~same] < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, _WORD))
        open_ = open_[same]
        out[open_] = at + _WORD
        if not len(open_):
            break
    return np.concatenate([[0], np.minimum(out, depth)])
