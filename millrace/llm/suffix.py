"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes in text order."""

from __future__ import annotations

import numpy as np

from .common import U64


def _order(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Stable order by (group, key); both are below 2**31."""
    n = len(group)
    bits = max(1, int(n - 1).bit_length())
    gbits, kbits = int(group.max()).bit_length(), int(key.max()).bit_length()
    if gbits + kbits + bits <= 64:  # values sort several times as fast as indices
        packed = (group.astype(U64) << U64(kbits + bits)) | (key.astype(U64) << U64(bits)) | np.arange(n, dtype=np.int64).astype(U64)
        packed.sort()
        return (packed & U64((1 << bits) - 1)).astype(np.int64)
    return np.argsort((group.astype(U64) << U64(32)) | key.astype(U64), kind="stable")


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of every suffix).

    Suffixes are first sorted by as many leading bytes as fit beside a position in 64 bits.  Every round then sorts the
    members of groups that are still tied at depth h by the rank of the suffix h further on, which settles depth 2h;
    singletons are never touched again.  A rank is the place of its group's last member, as ranks must not move when a
    group ahead of them is split.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    alphabet = np.flatnonzero(np.bincount(text, minlength=256))
    code = np.zeros(256, np.uint8)
    code[alphabet] = np.arange(1, len(alphabet) + 1)
    bits, place = int(len(alphabet)).bit_length(), max(1, int(n - 1).bit_length())
    depth = max(1, (64 - place) // bits)
    coded = np.zeros(n + depth, np.uint8)
    coded[:n] = code[text]
    key = np.zeros(n, U64)
    for j in range(depth):
        key = (key << U64(bits)) | coded[j : j + n].astype(U64)
    if bits * depth + place <= 64:
        key = np.sort((key << U64(place)) | np.arange(n, dtype=np.int64).astype(U64))
        sa = (key & U64((1 << place) - 1)).astype(np.int64)
        key = key >> U64(place)
    else:
        sa = np.argsort(key, kind="stable")
        key = key[sa]
    last = np.ones(n, bool)
    last[:-1] = key[1:] != key[:-1]
    del key
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    ends = np.flatnonzero(last)
    sizes = np.diff(np.concatenate([[-1], ends]))
    rank[sa] = np.repeat(ends, sizes)
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in sa
    h = depth
    while len(tied):
        at = sa[tied]
        group = rank[at]
        further = rank[np.minimum(at + h, n)] + 1
        # dense group numbers keep the packed key short
        new_group = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
        order = _order(new_group, further)
        at, further, new_group = at[order], further[order], new_group[order]
        sa[tied] = at
        split = np.ones(len(tied), bool)
        split[:-1] = (new_group[1:] != new_group[:-1]) | (further[1:] != further[:-1])
        ends = np.flatnonzero(split)
        sizes = np.diff(np.concatenate([[-1], ends]))
        rank[at] = np.repeat(tied[ends], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        h *= 2
    return sa, rank[:n]


def common_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray, least: int) -> np.ndarray:
    """Length of the common prefix of every suffix and its predecessor in the array, in array order; below `least` it may
    be any number below `least`.

    Kasai's observation: where the bytes before a suffix and before its predecessor agree, the common prefix is one less
    than that of the suffix before it in the text.  Only where they differ are bytes compared, eight at a time.
    """
    n = len(sa)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)  # predecessor of every suffix, in text order
    before[sa[1:]] = sa[:-1]
    has = before >= 0
    i = np.flatnonzero(has)
    phi = before[i]
    fresh = np.ones(len(i), bool)
    inner = (i > 0) & (phi > 0)
    fresh[inner] = text[i[inner] - 1] != text[phi[inner] - 1]
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    words = np.lib.stride_tricks.as_strided(padded, (n + 1, 8), (1, 1))
    a, b = i[fresh], phi[fresh]
    size = np.zeros(len(a), np.int64)
    # most neighbours differ within the first or the last bytes of `least`; they need no exact length
    on = np.flatnonzero(_near(padded, a, b, 0, n) & _near(padded, a, b, least - 8, n)) if least >= 8 else np.arange(len(a))
    x, y = a[on], b[on]
    while len(on):
        same = _word(padded, x) == _word(padded, y)
        inside = same & (np.maximum(x, y) + 8 <= n)
        stop = ~inside
        if stop.any():  # find the first differing byte of these
            xs, ys = x[stop], y[stop]
            room = n - np.maximum(xs, ys)
            differ = words[np.minimum(xs, n)] != words[np.minimum(ys, n)]
            first = np.where(differ.any(1), differ.argmax(1), 8)
            size[on[stop]] += np.minimum(first, np.maximum(room, 0))
        size[on[inside]] += 8
        on, x, y = on[inside], x[inside] + 8, y[inside] + 8
    plcp = np.zeros(n, np.int64)
    # a reducible suffix takes its value from the last fresh one before it, less the distance
    source = np.full(n, -1, np.int64)
    source[a] = a
    source = np.maximum.accumulate(source)
    plcp[a] = size
    reducible = i[~fresh]
    plcp[reducible] = plcp[source[reducible]] - (reducible - source[reducible])
    out[rank[i]] = plcp[i]
    return out


def _near(padded: np.ndarray, a: np.ndarray, b: np.ndarray, skip: int, n: int) -> np.ndarray:
    ok = np.maximum(a, b) + skip + 8 <= n
    ok[ok] = _word(padded, a[ok] + skip) == _word(padded, b[ok] + skip)
    return ok


def _word(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    view = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    return np.ascontiguousarray(view[at]).view(U64)[:, 0]


def repeated_windows(text: np.ndarray, valid: np.ndarray, size: int) -> np.ndarray:
    """Which of the sorted positions `valid` start a window of `size` bytes that another valid position starts earlier."""
    sa, rank = suffix_array(text)
    lcp = common_prefixes(text, sa, rank, size)
    klass = np.cumsum(lcp < size)
    of = klass[rank[valid]]
    first = np.full(int(klass[-1]) + 1 if len(klass) else 1, len(text), np.int64)
    np.minimum.at(first, of, valid)
    return valid != first[of]
