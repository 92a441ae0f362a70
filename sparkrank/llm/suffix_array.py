"""Suffix array by induced sorting and its permuted common prefixes, vectorised over buckets.

Suffixes are classified as S (smaller than the next one) or L (larger). The leftmost S suffixes of each run
(LMS) are sorted; all others follow from them by induction: scanning the array from left to right puts each
L suffix at the head of its first value's bucket, scanning from right to left each S suffix at its tail.
Induction from unsorted LMS suffixes sorts the LMS *substrings*; equal ones, compared value by value, get one
name, and the names spell a reduced text of at most half the length. Its suffixes are sorted by the same
procedure, level by level, until all names differ; names that already do are left out but for the first after
one that doesn't.

A scan goes through batches of neighbouring buckets. A batch ends before the first bucket that a suffix of the
batch itself would induce into, so what it holds is complete when its turn comes and induces at once. A text
of ``k`` values needs about the square root of ``k`` batches, so the large alphabets of reduced texts are no
slower than bytes. A bucket that induces into itself (repeated values) is scanned in waves.

Arrays are of 32 bits: about 35 bytes a byte of text at most, with what the common prefixes take.
"""

from __future__ import annotations

import numpy as np

#: Values compared at a time.
BLOCK = 1 << 18
_COUNT = np.arange(1 << 14)


def prefix_hashes(values: np.ndarray, multiplier: int) -> tuple[np.ndarray, np.ndarray]:
    """(P, R): the hash of values[a:b] is (P[b] - P[a]) * R[a] modulo 2**64."""
    n = len(values)
    powers = np.full(n + 1, np.uint64(multiplier))
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.empty(n + 1, np.uint64)
    sums[0], sums[1:] = 0, values
    sums[1:] += np.uint64(1)
    sums[1:] *= powers[:n]
    np.cumsum(sums, out=sums)
    powers.fill(pow(multiplier, -1, 1 << 64))
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    return sums, powers


def _smaller(s: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last value is the unique smallest one."""
    ends = np.append(np.flatnonzero(s[1:] != s[:-1]), len(s) - 1)
    kind = np.append(s[ends[:-1]] < s[ends[:-1] + 1], True)
    return np.repeat(kind, np.diff(ends, prepend=-1))


def _batches(limit: np.ndarray, sigma: int) -> np.ndarray:
    """Ends of the batches from bucket 0 on. ``limit[c]``: the largest bucket below or at ``c`` that induces into it."""
    ends, begin = [], 0
    for c, least in enumerate(limit.tolist()):
        if least >= begin and c > begin:  # c waits for a bucket of this batch
            ends.append(c)
            begin = c
        if least == c:  # it waits for itself: alone, and scanned in waves
            ends.append(c + 1)
            begin = c + 1
    if begin < sigma:
        ends.append(sigma)
    return np.array(ends)


def _nearest(at: np.ndarray, by: np.ndarray, sigma: int) -> np.ndarray:
    """Of each bucket, the largest of those that induce into it (``at[k]`` is induced by ``by[k]``); -1 for none."""
    if sigma <= 512:
        seen = np.zeros((sigma, sigma), bool)
        seen[at, by] = True
        return np.where(seen.any(axis=1), sigma - 1 - np.argmax(seen[:, ::-1], axis=1), -1)
    nearest = np.full(sigma, -1, np.int64)
    np.maximum.at(nearest, at, by)
    return nearest


def _order(values: np.ndarray) -> np.ndarray:
    """Stable order of small whole numbers."""
    if values.dtype.itemsize <= 2:
        return np.argsort(values, kind="stable")
    keys = values.astype(np.int64) << 32
    keys |= np.arange(len(values))
    keys.sort()
    keys &= 0xFFFFFFFF
    return keys


class _Text:
    def __init__(self, s: np.ndarray, sigma: int):
        self.s, self.n, self.sigma = s, len(s), sigma
        is_s = _smaller(s)
        is_lms = np.zeros(self.n, bool)
        is_lms[1:] = is_s[1:] & ~is_s[:-1]
        self.is_lms, self.lms = is_lms, np.flatnonzero(is_lms).astype(np.int32)
        # What precedes suffix i: twice its value, plus one if it is S. Nothing precedes suffix 0, as which empty places (-1) are read.
        self.before = np.empty(self.n, s.dtype)
        self.before[1:] = 2 * s[:-1] + is_s[:-1]
        counts = np.bincount(s, minlength=sigma)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        left, right = np.flatnonzero(~is_s), np.flatnonzero(is_s[:-1])
        self.left = _batches(_nearest(s[left], s[left + 1], sigma), sigma)
        self.right = _batches(_nearest(sigma - 1 - s[right], sigma - 1 - s[right + 1], sigma), sigma)

    def induce(self, seeds: np.ndarray) -> np.ndarray:
        """The suffix array that follows from the LMS suffixes in the order of ``seeds``."""
        s, sa = self.s, np.full(self.n, -1, np.int32)
        value = s[seeds]
        order = _order(value)
        value = value[order]
        # The seeds at the tails of their buckets, in their order.
        many = np.bincount(value, minlength=self.sigma)
        at = (self.ends - np.cumsum(many)).take(value) + np.arange(len(value))
        sa[at] = seeds[order]
        head, begin = self.starts.copy(), 0
        self.before[0] = -1
        for end in self.left.tolist():
            lo, hi = int(self.starts[begin]), int(self.ends[end - 1])
            if end == begin + 1 and hi > lo:
                reached = lo
                while reached < head[begin]:  # waves: what a wave adds to its own bucket is the next one
                    wave, reached = sa[reached : head[begin]], int(head[begin])
                    self._put(sa, head, wave, 1)
                lo = max(reached, hi - int(many[begin]))
            if hi > lo:
                self._put(sa, head, sa[lo:hi], 1)
            begin = end
        sa[at] = -1
        tail, begin = self.ends.copy(), 0
        last = self.n - 1  # the sentinel, which nothing induces
        tail[s[last]] -= 1
        sa[tail[s[last]]] = last
        self.before[0] = -2
        for end in self.right.tolist():
            low, high = self.sigma - end, self.sigma - 1 - begin
            lo, hi = int(self.starts[low]), int(self.ends[high])
            if end == begin + 1 and hi > lo:
                reached = hi
                while reached > tail[low]:
                    wave, reached = sa[tail[low] : reached][::-1], int(tail[low])
                    self._put(sa, tail, wave, -1)
                hi = min(reached, int(head[low]))
            if hi > lo:
                self._put(sa, tail, sa[lo:hi][::-1], -1)
            begin = end
        return sa

    def _put(self, sa: np.ndarray, edge: np.ndarray, wave: np.ndarray, way: int) -> None:
        """Puts what stands before the suffixes of a wave at the edges of its buckets: L suffixes (way 1) from the
        heads on, S suffixes (way -1) from the tails back."""
        code = self.before.take(wave, mode="clip")
        odd = (code & 1).astype(bool)
        keep = (odd if way < 0 else ~odd).nonzero()[0]
        n = len(keep)
        if not n:
            return
        value = code.take(keep) >> 1
        order = _order(value)
        value, place = value.take(order), wave.take(keep.take(order))
        place -= 1
        edges = np.empty(n + 1, bool)
        edges[0] = edges[n] = True
        np.not_equal(value[1:], value[:-1], out=edges[1:n])
        edges = edges.nonzero()[0]
        first = edges[:-1]
        counts = edges[1:] - first
        buckets = value.take(first)
        at = edge.take(buckets)
        if way > 0:
            edge[buckets] = at + counts
            to = (at - first).repeat(counts)
            to += _COUNT[:n] if n <= len(_COUNT) else np.arange(n)
        else:
            edge[buckets] = at - counts
            to = (at - 1 + first).repeat(counts)
            to -= _COUNT[:n] if n <= len(_COUNT) else np.arange(n)
        sa[to] = place

    def rank(self, order: np.ndarray) -> np.ndarray:
        """The numbers of LMS suffixes from the left on."""
        number = np.empty(self.n, np.int32)
        number[self.lms] = np.arange(len(self.lms), dtype=np.int32)
        return number.take(order)

    def names(self, order: np.ndarray) -> np.ndarray:
        """Of the LMS substrings in their order: numbers that are equal for equal ones. A substring reaches to the
        next LMS suffix, included; equal values up to there are of equal types."""
        until = np.empty(len(self.lms), np.int32)
        until[:-1], until[-1] = self.lms[1:] + 1, self.n
        length = until[self.rank(order)] - order
        fresh = np.append(True, length[1:] != length[:-1])
        same = np.flatnonzero(~fresh)
        ends = np.cumsum(length[same], dtype=np.int64)
        lo = 0
        while lo < len(same):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, "right")))
            own, sizes = same[lo:hi], length[same[lo:hi]]
            offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            equal = self.s.take(np.repeat(order[own - 1], sizes) + offset) == self.s.take(np.repeat(order[own], sizes) + offset)
            fresh[own] = ~np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)
            lo = hi
        return np.cumsum(fresh, dtype=np.int32) - 1


def _induced(s: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of a text whose last value is its unique smallest one."""
    text = _Text(s, sigma)
    seeds = text.lms
    if len(seeds) > 1:
        by_substring = text.induce(seeds)
        by_substring = by_substring.compress(text.is_lms.take(by_substring))
        names = text.names(by_substring)
        tied = np.bincount(names).take(names) > 1
        if tied.any():
            # A name that occurs once ends every comparison, so what follows it up to the next tied one is left out.
            number = text.rank(by_substring)
            reduced, again = np.empty(len(seeds), np.int32), np.empty(len(seeds), bool)
            reduced[number], again[number] = names, tied
            keep = again.copy()
            keep[1:] |= again[:-1]
            keep[-1] = True  # the sentinel
            kept = np.flatnonzero(keep)
            reduced = reduced.take(kept)
            dense = np.zeros(int(names[-1]) + 1, np.int32)
            dense[reduced] = 1
            np.cumsum(dense, out=dense)
            del names, number, keep
            order = kept.take(_induced(dense.take(reduced) - 1, int(dense[-1])))
            by_substring[tied] = seeds.take(order.compress(again.take(order)))
        seeds = by_substring
    return text.induce(seeds)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``data`` (uint8, shorter than 2**31) in their order."""
    if len(data) < 2:
        return np.arange(len(data), dtype=np.int32)
    s = np.empty(len(data) + 1, np.int16)
    s[:-1] = data
    s[:-1] += 1
    s[-1] = 0
    return _induced(s, 257)[1:]


def permuted_prefixes(data: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(PLCP, PHI): of each suffix, the one before it in the array (-1: none) and their common prefix.

    Where the bytes before both are equal the prefix is one shorter than its neighbour's (reducible); only the
    others are compared, eight bytes at a time.
    """
    n = len(data)
    phi = np.empty(n, np.int32)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    direct = phi <= 0
    direct[0] = True
    direct[1:] |= data[:-1] != data.take(phi[1:] - 1, mode="clip")
    todo = np.flatnonzero(direct & (phi >= 0)).astype(np.int32)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    eight = np.ndarray(n + 1, "<u8", padded.data, strides=(1,))
    reach = np.zeros(n, np.int32)
    a, b = todo, phi[todo]
    while len(todo):
        differ = eight.take(a, mode="clip") ^ eight.take(b, mode="clip")
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        reach[todo] += same.astype(np.int32)
        on = (differ == 0) & (np.maximum(a, b) + 8 <= n)
        todo, a, b = todo[on], a[on] + 8, b[on] + 8
    here = np.arange(n, dtype=np.int32)
    np.minimum(reach, n - np.maximum(here, phi), out=reach)
    reach[phi < 0] = 0
    reach += here
    reach[~direct] = 0
    np.maximum.accumulate(reach, out=reach)
    reach -= here
    return np.maximum(reach, 0, out=reach), phi
