"""Suffix array and common prefixes of one shard of byte segments, by induced sorting in numpy.

Segments are joined with separators that count as different letters, smaller than any byte, in order of position.
Suffixes are classified, leftmost-smaller substrings are sorted by a first induction and named, suffixes of the
string of names are ranked by doubling where names repeat, and a second induction orders all suffixes. An
induction goes through the letters' buckets in order and handles a whole bucket at a time, so each step is linear.
"""

from __future__ import annotations

import numpy as np

from .textbatch import BASE, mixed, powers


def _spread(lists: list[list[np.ndarray]], letters: np.ndarray, positions: np.ndarray) -> None:
    """Append positions to their letters' lists, in the order given."""
    if len(positions):
        order = np.argsort(letters, kind="stable")
        letters, positions = letters[order], positions[order]
        cut = np.flatnonzero(letters[1:] != letters[:-1]) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(letters)]):
            lists[int(letters[a])].append(positions[a:b])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: list[np.ndarray], letters: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets of larger and of smaller suffixes, in order, from leftmost-smaller suffixes in order (``seeds``, by letter)."""
    more: list[list[np.ndarray]] = [[] for _ in range(letters)]
    large: list[np.ndarray] = []
    for c in range(letters):
        done, now = [], _joined(more[c])
        while len(now):
            done.append(now)
            before = now[now > 0] - 1
            before = before[~smaller[before]]
            kind = text[before]
            same = kind == c
            _spread(more, kind[~same], before[~same])
            now = before[same]
        large.append(_joined(done))
        before = seeds[c][seeds[c] > 0] - 1
        _spread(more, text[before], before)
    less: list[list[np.ndarray]] = [[] for _ in range(letters)]
    small: list[np.ndarray] = [np.zeros(0, np.int32)] * letters
    for c in range(letters - 1, -1, -1):
        done, now = [], _joined(less[c])
        while len(now):
            done.append(now)
            before = now[now > 0] - 1
            before = before[smaller[before]]
            kind = text[before]
            same = kind == c
            _spread(less, kind[~same], before[~same])
            now = before[same]
        small[c] = _joined(done)[::-1]
        before = large[c][::-1]
        before = before[before > 0] - 1
        before = before[smaller[before]]
        _spread(less, text[before], before)
    return large, small


def _ranks(names: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of a string of names; the last name occurs once and is the smallest or largest of its kind."""
    rank, step, n = names.astype(np.int64), 1, len(names)
    while n and int(rank.max()) < n - 1:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)  # equal keys get equal ranks, in whatever order they are
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        step *= 2
    return rank


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text``: letters 1 to 256 for bytes, 0 for separators, of which one is last."""
    n, letters = len(text), 257
    change = np.flatnonzero(text[1:] != text[:-1])
    runs = np.diff(np.concatenate(([-1], change, [n - 1])))
    up = np.append(text[change] < text[change + 1], True)
    smaller = np.repeat(up, runs)
    smaller[text == 0] = True
    is_left = text == 0
    is_left[1:] |= smaller[1:] & ~smaller[:-1]
    left = np.flatnonzero(is_left).astype(np.int32)
    ordered = left[np.argsort(text[left], kind="stable")]
    cut = np.searchsorted(text[ordered], np.arange(letters + 1))
    seeds = [ordered[a:b] for a, b in zip(cut[:-1], cut[1:])]
    _, small = _induce(text, smaller, seeds, letters)
    rest = np.concatenate(small[1:])
    rest = rest[is_left[rest]]
    first = np.concatenate((seeds[0], rest)).astype(np.int64)
    place = np.empty(n, np.int32)
    place[left] = np.arange(len(left))
    at = place[first]
    end = np.append(left[1:], n - 1)[at].astype(np.int64)
    up_to, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up_to[:-1], out=sums[1:])
    content = mixed((sums[end + 1] - sums[first]) * down[first]) ^ ((end - first).astype(np.uint64) * BASE)
    own = (text[first] == 0) | (text[end] == 0)
    new = np.concatenate(([False], (content[1:] != content[:-1]) | own[1:] | own[:-1]))
    names = np.empty(len(left), np.int64)
    names[at] = np.cumsum(new)
    ranks = _ranks(names)
    ordered = np.empty(len(left), np.int32)
    ordered[ranks] = left
    cut = np.searchsorted(text[ordered], np.arange(letters + 1))
    seeds = [ordered[a:b] for a, b in zip(cut[:-1], cut[1:])]
    large, small = _induce(text, smaller, seeds, letters)
    small[0] = seeds[0]
    return np.concatenate([x for c in range(letters) for x in (large[c], small[c])])


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By text position, letters in common with the suffix before it in order: compared where the letters in front of
    both differ, one less than at the position before where they are equal."""
    n = len(text)
    before = np.empty(n, np.int32)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    here = np.arange(n, dtype=np.int32)
    free = (before <= 0) | (here == 0)
    p = np.flatnonzero(~free)
    free[p] = (text[p - 1] != text[before[p] - 1]) | (text[p - 1] == 0)
    at = np.flatnonzero(free & (before >= 0) & (text != 0))
    length = np.zeros(n, np.int32)
    a, b, k = at, before[at], 0
    while len(a):
        ok = (text[a + k] == text[b + k]) & (text[a + k] != 0)
        length[a[~ok]] = k
        a, b = a[ok], b[ok]
        k += 1
    total = np.where(free, length + here, 0)
    return np.maximum.accumulate(total) - here


def repeated(segments: list[bytes], owner: np.ndarray, width: int) -> list[list[tuple[int, int]]]:
    """For each segment the ranges covered by ``width``-byte strings that also start in a segment of a smaller owner."""
    data = b"\0".join(segments) + b"\0"
    size = np.array([len(s) for s in segments])
    start = np.cumsum(size + 1) - size - 1
    text = np.frombuffer(data, np.uint8).astype(np.int16) + 1
    text[start + size] = 0
    order = suffix_array(text)
    shared = common_prefixes(text, order)[order] >= width
    group = np.flatnonzero(~shared)
    of = np.repeat(np.arange(len(segments)), size + 1)[order]
    owners = owner[of]
    least = np.repeat(np.minimum.reduceat(owners, group), np.diff(np.append(group, len(order))))
    hit = np.sort(order[least < owners])
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    if len(hit):
        cut = np.flatnonzero(np.diff(hit) != 1) + 1
        for a, b in zip(hit[np.concatenate(([0], cut))].tolist(), hit[np.concatenate((cut - 1, [len(hit) - 1]))].tolist()):
            s = int(np.searchsorted(start, a, "right")) - 1
            out[s].append((a - int(start[s]), b - int(start[s]) + width))
    return out
