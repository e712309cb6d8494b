"""Suffix arrays by induced sorting, over whole numpy arrays, and the common prefixes they give.

Suffixes are classified as S (smaller than the next) or L; leftmost S ones (LMS) cut the text into substrings. Those are
sorted by inducing, named, and the shorter string of names is sorted in turn; LMS suffixes in order induce all others, L
ones left to right and S ones right to left. A bucket's suffixes induce as one array operation, once more for each
repeat of its letter, so the work is a few passes over the text. The string of names has too many letters for buckets:
there, suffixes are compared up to the next LMS one, and where they are equal so far, the order of those LMS suffixes
decides, found in the same way from the names of their substrings. Each level halves the string at least. Order is needed to
`depth` letters only; past it equal prefixes may stand in any order.
"""

from __future__ import annotations

import numpy as np

#: One random odd word for each letter and power base of the substring hashes.
_RANDOM = np.random.default_rng(20240607).integers(0, 2**63, 65_536, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


#: Letters worked on at once where only a running sum is kept of them.
_CHUNK = 1 << 20


def _power(base: int, bits: int) -> np.ndarray:
    """base ** 0, base ** 1 and so on, 2 ** bits of them."""
    power = np.full(1 << bits, base, dtype=np.uint64)
    power[0] = 1
    return np.multiply.accumulate(power)


_LOW, _HIGH = ((_power(b, 16), _power(pow(b, 1 << 16, 2**64), 16)) for b in (_BASE, _INVERSE))


def _powers(tables: tuple[np.ndarray, np.ndarray], k: np.ndarray) -> np.ndarray:
    """base ** k for k below 2 ** 32."""
    return tables[0][k & 0xFFFF] * tables[1][k >> 16]


class Substrings:
    """64-bit hashes of any substrings of an array of letters, the same for equal substrings of other arrays."""

    def __init__(self, text: np.ndarray):
        self.total = np.zeros(len(text) + 1, dtype=np.uint64)
        low, high = _LOW
        for at in range(0, len(text), len(low)):
            end = min(len(text), at + len(low))
            part = _RANDOM[text[at:end]] * low[: end - at]
            part *= high[at >> 16]
            part[:1] += self.total[at : at + 1]  # arrays wrap without a warning
            np.cumsum(part, out=self.total[at + 1 : end + 1])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal text[start:end]; mixed with the length."""
        h = (self.total[end] - self.total[start]) * _powers(_HIGH, start)
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93) + (end - start).astype(np.uint64)


def is_s_type(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last, the end mark, is."""
    s = np.ones(len(text), dtype=bool)
    step = np.sign(text[1:].astype(np.int32) - text[:-1])
    at = np.where(step != 0, np.arange(len(step)), len(step))
    at = np.minimum.accumulate(at[::-1])[::-1]
    s[:-1] = np.r_[step > 0, True][at]
    return s


def _induce(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """All suffixes in the order that LMS suffixes, given in order, induce."""
    n = len(text)
    sizes = np.bincount(text, minlength=letters)
    end = np.cumsum(sizes)
    start = end - sizes
    used = np.flatnonzero(sizes).tolist()
    n_l = np.bincount(text[~s_type], minlength=letters)
    sa = np.full(n, -1, dtype=np.int32)
    first = text[lms]
    order = np.argsort(first, kind="stable")
    lms, cut = lms[order], np.searchsorted(first[order], np.arange(letters + 1))

    def spread(items: np.ndarray, wanted: bool, fill: np.ndarray, down: bool) -> None:
        """Put the predecessors of items that are of the wanted type at their buckets' fill marks, in turn."""
        before = items[items > 0] - 1
        before = before[s_type[before] == wanted]
        if not len(before):
            return
        c = text[before]
        by = np.argsort(c, kind="stable")
        before, c = before[by], c[by]
        cuts = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = int(c[a])
            if down:
                sa[fill[at] - (b - a) : fill[at]] = before[a:b][::-1]
                fill[at] -= b - a
            else:
                sa[fill[at] : fill[at] + b - a] = before[a:b]
                fill[at] += b - a

    fill = start.copy()
    for c in used:
        done = start[c]
        while done < fill[c]:
            here = sa[done : fill[c]].copy()
            done = fill[c]
            spread(here, False, fill, False)
        if cut[c] < cut[c + 1]:
            spread(lms[cut[c] : cut[c + 1]], False, fill, False)
    fill = end.copy()
    sa[0] = n - 1  # nothing induces the end mark
    for c in reversed(used):
        done = end[c]
        low = start[c] + n_l[c]
        while fill[c] < done:
            here = sa[fill[c] : done][::-1].copy()
            done = fill[c]
            spread(here, True, fill, True)
        if low > start[c]:
            spread(sa[start[c] : low][::-1].copy(), True, fill, True)
    return sa


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text (unsigned 16-bit letters, the last one the only 0) in order of their first `depth` letters at least."""
    n = len(text)
    letters = int(text.max()) + 1
    s_type = is_s_type(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(lms) > 1:
        number = np.full(n, -1, dtype=np.int32)
        number[lms] = np.arange(len(lms))
        in_order = number[_induce(text, s_type, lms, letters)]
        in_order = in_order[in_order >= 0]
        ends = np.minimum(np.r_[lms[1:], n - 1] + 1, n)
        h = Substrings(text)(lms[in_order], ends[in_order])
        name = np.empty(len(lms), dtype=np.int64)
        name[in_order] = np.cumsum(np.r_[True, h[1:] != h[:-1]])
        del number, in_order, ends, h
        lms = lms[order_of_names(name, depth // 2 + 1)]
    return _induce(text, s_type, lms, letters)


def order_of_names(name: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a string of names (1 and up) in order of their first `depth` names at least."""
    n = len(name)
    text = np.r_[name, 0]
    s_type = is_s_type(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1  # the last one is the end mark
    end = lms[np.searchsorted(lms, np.arange(n), side="right")]
    group = _groups(text * 2 + s_type, end, depth)
    if depth <= 1 or len(lms) < 2 or len(np.unique(group)) == n:
        return np.argsort(group, kind="stable")
    inner, rank = lms[:-1], np.zeros(n + 1, dtype=np.int64)
    _, names = np.unique(group[inner], return_inverse=True)
    rank[inner[order_of_names(names + 1, depth // 2 + 1)]] = np.arange(1, len(lms))
    return np.lexsort((rank[end], group))


def _groups(letter: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """For each place k, how many places have a smaller letter[k : end[k] + 1]; letters tell the types, so that equal ones end together."""
    n = len(end)
    group = np.empty(n, dtype=np.int64)
    open_, of, at = np.arange(n), np.zeros(n, dtype=np.int64), 0
    while len(open_):
        c = letter[open_ + at]
        order = np.lexsort((c, of))
        open_, of, c = open_[order], of[order], c[order]
        old = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        first = np.repeat(old, np.diff(np.r_[old, len(of)]))
        new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (c[1:] != c[:-1])])
        size = np.diff(np.r_[new, len(of)])
        of = of + np.repeat(new, size) - first
        group[open_] = of
        at += 1
        more = (np.repeat(size, size) > 1) & (open_ + at <= end[open_]) & (at < depth)
        open_, of = open_[more], of[more]
    return group


def permuted_common_prefixes(raw: np.ndarray, place: np.ndarray, in_order: np.ndarray, most: int) -> np.ndarray:
    """How many bytes, `most` at most, each of some places of raw has in common with the one before it in suffix order.

    in_order: numbers of the places in suffix order. Computed by place, not by order: each place has one before it, whose
    bytes are compared with its own, eight at a time while they are equal.
    """
    before = np.empty(len(in_order), dtype=np.int64)
    before[in_order] = np.r_[in_order[:1], in_order[:-1]]
    padded = np.concatenate([raw, np.zeros(most + 8, dtype=np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[: len(padded) - 7].view(), (len(padded) - 7, 8), (1, 1))
    common = np.zeros(len(place), dtype=np.int64)
    for at in range(0, len(place), _CHUNK):
        open_, k = np.arange(at, min(len(place), at + _CHUNK)), 0
        while k < most and len(open_):
            a, b = (np.ascontiguousarray(eight[x + k]).view(np.uint64).ravel() for x in (place[open_], place[before[open_]]))
            differs = a ^ b
            equal = differs == 0
            low = differs[~equal] & (~differs[~equal] + np.uint64(1))  # the lowest bit that differs is in the first such byte
            common[open_[~equal]] = k + np.bitwise_count(low - np.uint64(1)) // 8
            common[open_[equal]] = k + 8
            open_, k = open_[equal], k + 8
    common = np.minimum(common, most)
    common[in_order[:1]] = 0
    return common
