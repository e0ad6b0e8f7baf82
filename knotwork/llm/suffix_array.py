"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

Suffixes are of type S if smaller than the next one, else of type L; an S suffix after an L one is leftmost-smaller (LMS).
The substrings between LMS places are sorted by inducing once from any order of them; their ranks make a shorter text,
whose suffixes are sorted in turn; that order of the LMS suffixes induces the whole array. Inducing goes bucket by bucket,
with the suffixes of a bucket handled together. The shorter text has as many letters as different substrings, too many
for buckets, so its suffixes are sorted by doubling their ranks.
"""

from __future__ import annotations

import numpy as np


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """The array that follows from the LMS suffixes, given in order within each bucket."""
    n = len(text)
    count = np.bincount(text, minlength=letters)
    end = np.cumsum(count)
    start = end - count
    sa = np.full(n, -1, np.int32)
    first = text[lms]
    order = np.argsort(first, kind="stable")
    lms_count = np.bincount(first, minlength=letters)
    own = end - lms_count
    sa[np.repeat(own - (np.cumsum(lms_count) - lms_count), lms_count) + np.arange(len(lms))] = lms[order]
    used = np.flatnonzero(count)
    head = start.copy()

    def push_large(batch: np.ndarray) -> None:
        before = batch[batch > 0] - 1
        before = before[~small[before]]
        if len(before):
            letter = text[before]
            order = np.argsort(letter, kind="stable")
            n_letter = np.bincount(letter, minlength=letters)
            sa[np.repeat(head - (np.cumsum(n_letter) - n_letter), n_letter) + np.arange(len(before))] = before[order]
            np.add(head, n_letter, out=head)

    for c in used.tolist():
        done = int(start[c])
        while done < head[c]:
            upto = int(head[c])
            push_large(sa[done:upto])
            done = upto
        if lms_count[c]:
            push_large(sa[own[c] : end[c]])
    tail = end.copy()

    def push_small(batch: np.ndarray) -> None:
        before = batch[batch > 0] - 1
        before = before[small[before]]
        if len(before):
            letter = text[before]
            order = np.argsort(letter, kind="stable")
            n_letter = np.bincount(letter, minlength=letters)
            sa[np.repeat(tail - 1 + (np.cumsum(n_letter) - n_letter), n_letter) - np.arange(len(before))] = before[order]
            np.subtract(tail, n_letter, out=tail)

    for c in used[::-1].tolist():
        done = int(end[c])
        while done > tail[c]:
            downto = int(tail[c])
            push_small(sa[downto:done][::-1])
            done = downto
        push_small(sa[start[c] : head[c]][::-1])
    sa[0] = n - 1
    return sa


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """The suffix array of a text of ranks."""
    n, rank, step = len(names), names.astype(np.int64) + 1, 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:-step] = rank[step:] if step < n else 0
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.cumsum(np.append(True, sorted_key[1:] != sorted_key[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n:
            return order
        step *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of letters from 1; the array leaves out the end mark that is added here."""
    text = np.append(text, 0).astype(np.int16 if len(text) == 0 or text.max() < 1 << 15 else np.int32)
    n, letters = len(text), int(text.max()) + 1
    # the type of a place is that of the next place where the letter changes
    change = np.append(text[:-1] != text[1:], True)
    rises = np.append(text[:-1] < text[1:], True)
    at = np.where(change, np.arange(n), n - 1)
    small = rises[np.minimum.accumulate(at[::-1])[::-1]]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = _induce(text, small, lms, letters)
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ranked = sa[is_lms[sa]]
        length = np.zeros(n, np.int32)
        length[lms[:-1]] = np.diff(lms) + 1
        length[n - 1] = 1
        a, b = ranked[:-1], ranked[1:]
        differ = length[a] != length[b]
        active, d = np.flatnonzero(~differ), 0
        while len(active):
            unlike = text[a[active] + d] != text[b[active] + d]
            differ[active[unlike]] = True
            d += 1
            active = active[~unlike]
            active = active[length[a[active]] > d]
        name = np.zeros(n, np.int64)
        name[ranked] = np.append(0, np.cumsum(differ))
        lms = lms[_by_doubling(name[lms])]
        sa = _induce(text, small, lms, letters)
    return sa[1:]


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """phi and plcp, both by place in the text: the suffix before in the array (-1: none) and the length shared with it.

    Lengths are compared, eight letters at once, only at places whose letters before differ; at any other the length is
    one less than at the place before it.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    place = np.arange(n)
    before = np.where((place > 0) & (phi > 0), text[place - 1] == text[np.maximum(phi - 1, 0)], False)
    own = np.flatnonzero(~before & (phi >= 0))
    word = np.concatenate([text, np.zeros(24, text.dtype)]).astype(np.uint64)
    for shift in (1, 2, 4):
        word = word[:-shift] << np.uint64(8 * shift) | word[shift:]  # letters fit a byte
    length = np.zeros(n, np.int64)
    active, d = own, 0
    while len(active):  # ends: behind the text are only zeros, which no letter equals
        alike = word[active + d] == word[phi[active] + d]
        length[active[alike]] += 8
        rest = active[~alike]
        if len(rest):
            apart = word[rest + d] ^ word[phi[rest] + d]
            alone = np.zeros(len(rest), np.int64)
            for bits in (8, 16, 24, 32, 40, 48, 56):
                alone += apart < np.uint64(1 << bits)
            length[rest] += alone
        active, d = active[alike], d + 8
    plcp = np.zeros(n, np.int64)
    base = np.full(n, -1, np.int64)
    base[~before] = place[~before]
    base = np.maximum.accumulate(base)
    good = base >= 0
    plcp[good] = np.maximum(0, length[base[good]] - (place[good] - base[good]))
    plcp[phi < 0] = 0
    return phi, plcp


def repeated_places(text: np.ndarray, least: int) -> np.ndarray:
    """Whether the least letters from each place also start at another place."""
    if len(text) == 0:
        return np.zeros(0, bool)
    sa = suffix_array(text).astype(np.int64)
    phi, plcp = common_prefixes(text, sa)
    found = plcp >= least
    found[phi[found]] = True
    return found
