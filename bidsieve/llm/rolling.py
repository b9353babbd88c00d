"""Rolling hashes over symbol sequences (bytes or words) and the parsing that their triggers induce."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_LENGTH = 0xD6E8FEB86659FD93
_random = np.random.default_rng(20260101)
_TABLE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
#: Places that a window's smallest hash is looked for among, on average.
_TRIED = 14
#: Places that are hashed at once.
_BLOCK = 1 << 14
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hash of any stretch of a sequence in constant time."""

    def __init__(self, values: np.ndarray, base: int = 0) -> None:
        n = len(values)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.multiply(values, _power(_BASES[base], n), out=self.prefix[1:])
        np.cumsum(self.prefix, out=self.prefix)
        self.back = _power(_INVERSES[base], n + 1)

    def of(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(_LENGTH) + np.uint64(salt))


    def each(self, length: int, salt: int = 0) -> np.ndarray:
        """The upper 32 bits of the hash of the stretch of `length` symbols at each place, block by block."""
        upper = np.empty(len(self.prefix) - length, np.uint32)
        more = np.uint64((length * _LENGTH + salt) & ((1 << 64) - 1))
        for a in range(0, len(upper), _BLOCK):
            b = min(a + _BLOCK, len(upper))
            upper[a:b] = mix((self.prefix[a + length : b + length] - self.prefix[a:b]) * self.back[a:b] + more) >> np.uint64(32)
        return upper


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _TABLE[raw]


def others(values: np.ndarray) -> np.ndarray:
    """Values of symbols for a second hash that tells nothing of the first."""
    return mix(values + np.uint64(0x9E3779B97F4A7C15))


_OTHERS = others(_TABLE)


def other_byte_values(raw: np.ndarray) -> np.ndarray:
    return _OTHERS[raw]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each document's offsets in the list of words."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][np.diff(offsets) > 0]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut[1:] - 1] = inside[cut[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_values(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value of each word, and each document's offsets in them."""
    starts, ends, docs = word_spans(raw, offsets)
    return Hashes(byte_values(raw)).of(starts, ends, 7), docs


@dataclass(frozen=True)
class Parsing:
    """How sequences are cut into phrases and which windows a phrase end owns.

    A phrase ends at a trigger: a place where the hash of the last `grain` symbols is the smallest of all places between
    `grain` and `reach` behind the start of some window of `window` symbols (the first of equals). That place owns the
    window. Equal windows thus have their phrase end at the same distance, and no phrase is longer than `reach`.
    """

    window: int
    grain: int
    reach: int
    band: int

    @property
    def bands(self) -> range:
        return range(self.grain, self.reach + 1, self.band)


def _tried(h: np.ndarray, span: int) -> np.ndarray:
    """Places, in rising order, among which every `span` places in a row have their smallest hash, the first of equals: the
    small ones, and where `span` in a row have none, as in a repeated character, their smallest."""
    small = np.flatnonzero(h < np.uint32(min(_TRIED / span, 0.5) * (1 << 32)))
    edges = np.concatenate(([-1], small, [len(h)]))
    gaps = np.flatnonzero(np.diff(edges) > span)
    if not len(gaps):
        return small
    each = edges[gaps + 1] - edges[gaps] - 1
    between = np.repeat(edges[gaps] + 1 - np.cumsum(each) + each, each) + np.arange(each.sum())
    best, have = h[between].astype(np.uint64) << np.uint64(32) | np.arange(len(between), dtype=np.uint64), 1
    while have < span:  # minimum over `have` places, doubled
        step = min(have, span - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    least = np.zeros(len(between), bool)
    least[(best & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    return np.sort(np.concatenate((small, between[least])), kind="stable")


def _nearest(at: np.ndarray, other: np.ndarray, key: np.ndarray, span: int, none: int) -> np.ndarray:
    """For each key the place `other` of the next smaller one, if that is less than `span` ahead of its own place `at`."""
    found = np.full(len(at), none, np.int64)
    open_, k = np.arange(len(at)), 0
    while len(open_):
        k += 1
        open_ = open_[: np.searchsorted(open_, len(at) - k)]
        open_ = open_[other[open_ + k] - at[open_] < span]
        smaller = key[open_ + k] < key[open_]
        found[open_[smaller]] = other[open_[smaller] + k]
        open_ = open_[~smaller]
    return found


def phrase_ends(hashes: Hashes, docs: np.ndarray, p: Parsing) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrase ends in rising order: position, document, first and last start of the windows that each owns."""
    n = int(docs[-1])
    none = (np.zeros(0, np.int64),) * 4
    if n < p.window or np.diff(docs).max() < p.window:
        return none
    h, span = hashes.each(p.grain, 3), p.reach - p.grain + 1
    place = _tried(h, span)
    # equals in a row, as in a repeated character, share the next smaller one; before each stands an equal, and the first wins
    fresh = np.concatenate(([True], np.diff(h[place]) != 0))
    run, first, last = np.cumsum(fresh) - 1, place[fresh], place[np.concatenate((fresh[1:], [True]))]
    key = h[first].astype(np.uint64) << np.uint64(32) | np.arange(len(first), dtype=np.uint64)
    behind = _nearest(last, first, key, span, n + p.window)[run]
    ahead = -_nearest(-first[::-1], -last[::-1], key[::-1], span, n + p.window)[::-1][run]
    ahead[~fresh] = place[np.flatnonzero(~fresh) - 1]
    ends = place + p.grain
    doc = np.searchsorted(docs, ends - 1, side="right") - 1
    low = np.maximum(np.maximum(place + p.grain - p.reach, ahead + 1), docs[doc])
    high = np.minimum(np.minimum(place, behind + p.grain - p.reach - 1), docs[doc + 1] - p.window)
    own = np.flatnonzero(low <= high)
    return ends[own], doc[own], low[own], high[own]


def classes_within(docs_of: np.ndarray, k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each phrase end among those of its document with the same keys, and the first end of each class."""
    order = np.lexsort((np.arange(len(k)), c, k, docs_of))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(docs_of[order]) != 0) | (k[order][1:] != k[order][:-1]) | (c[order][1:] != c[order][:-1])
    same = np.zeros(len(order), np.int64)
    same[order] = np.cumsum(fresh) - 1
    return same, order[fresh]
