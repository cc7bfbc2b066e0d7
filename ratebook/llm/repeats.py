"""Numpy core of the repeated-string operator: names of grams by doubling, anchors, strips, windows.

All functions work on a run of whole documents laid end to end; nothing here
knows Spark.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20)
U64 = np.uint64
#: Strips handled together: their names take some 600 bytes each while they are made.
ROWS_AT_ONCE = 8_192


def _odd(n: int) -> np.ndarray:
    return _RNG.integers(0, 1 << 63, n).astype(U64) * U64(2) + U64(1)


#: Two independent namings: a value per byte and a multiplier each.
BYTE_NAMES = (_odd(256), _odd(256))
STEP_FACTORS = (int(_odd(1)[0]), int(_odd(1)[0]))


def _power(which: int, n: int) -> np.uint64:
    return U64(pow(STEP_FACTORS[which], n, 1 << 64))


def names(values: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Names of all grams of ``length`` bytes (along the last axis), by prefix doubling.

    The name of 2L bytes is made of the pair of names of L bytes at a place
    and L further on; other lengths join the names of their powers of two.
    """
    level = BYTE_NAMES[which][values]
    out, used, size = None, 0, 1
    while True:
        if length & size:
            if out is None:
                out, used = level, size
            else:  # the shorter part first, the longer behind it
                n = out.shape[-1] - size
                out = out[..., :n] * _power(which, size) + level[..., used:used + n]
                used += size
        if 2 * size > length:
            return out
        level = level[..., :-size] * _power(which, size) + level[..., size:]
        size *= 2


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads names over all bits."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(29))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its first smallest one (by doubling)."""
    at = np.arange(len(values), dtype=np.int32)
    size = 1
    while size < width:
        step = min(size, width - size)
        left = values[:-step] <= values[step:]
        at = np.where(left, at[:-step], at[step:])
        values = np.minimum(values[:-step], values[step:])
        size += step
    return at


class Run:
    """Documents laid end to end with their windows' anchors.

    A window is a string of ``least`` bytes within a document. Its anchor is
    the first of its grams (``gram`` bytes) with the smallest name, so equal
    windows have equal anchors at equal offsets.
    """

    def __init__(self, raws: list[bytes], least: int, gram: int):
        self.least = least
        self.raw = np.frombuffer(b"".join(raws), dtype=np.uint8)
        sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        n = len(self.raw)
        if n < least:
            self.windows = self.anchor = np.zeros(0, dtype=np.int64)
            self.key = np.zeros(0, dtype=U64)
            return
        name = mixed(names(self.raw, gram))
        whole = np.ones(n + 1, dtype=bool)
        for end in self.starts[1:]:
            whole[max(0, end - least + 1):end] = False
        anchor = first_least((name >> U64(32)).astype(np.uint32), least - gram + 1)
        self.windows = np.flatnonzero(whole[:len(anchor)])
        self.anchor = anchor[self.windows]
        # The high half of an anchor's name is small by choice: the low half goes first in the key.
        self.key = (name << U64(32)) | (name >> U64(32))

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and documents of the anchors, in text order."""
        at = self.anchor[np.flatnonzero(np.diff(self.anchor, prepend=-1))]
        return self.key[at], self.document(at)

    def units(self, shared: np.ndarray):
        """Runs of windows with one anchor whose key is in ``shared`` (sorted).

        Returns places of the first windows, window counts, anchor offsets, keys.
        """
        if not len(self.windows) or not len(shared):
            return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=U64),)
        first = np.flatnonzero((np.diff(self.anchor, prepend=-1) != 0) | (np.diff(self.windows, prepend=-2) != 1))
        count = np.diff(np.append(first, len(self.anchor)))
        anchor, place = self.anchor[first], self.windows[first]
        key = self.key[anchor]
        at = np.searchsorted(shared, key)
        known = shared[np.minimum(at, len(shared) - 1)] == key
        return place[known], count[known], (anchor - place)[known], key[known]

    def strips(self, place: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
        """The bytes that units span, padded with zeros to ``width``."""
        out = np.zeros((len(place), width), dtype=np.uint8)
        step = np.arange(width)
        for a in range(0, len(place), ROWS_AT_ONCE):
            at = place[a:a + ROWS_AT_ONCE, None] + step
            held = step < (count[a:a + ROWS_AT_ONCE, None] + self.least - 1)
            out[a:a + ROWS_AT_ONCE] = np.where(held, self.raw[np.minimum(at, len(self.raw) - 1)], 0)
        return out


def strip_names(strips: np.ndarray, count: np.ndarray, offset: np.ndarray, kinds=(0, 1)) -> list[np.ndarray]:
    """Names per padded strip, of its bytes, window count and anchor offset."""
    tail = (count.astype(U64) << U64(32)) | offset.astype(U64)
    out = [np.empty(len(strips), dtype=U64) for _ in kinds]
    for a in range(0, len(strips), ROWS_AT_ONCE):
        part = slice(a, a + ROWS_AT_ONCE)
        for h, which in zip(out, kinds):
            h[part] = mixed(names(strips[part], strips.shape[1], which)[:, 0] + mixed(tail[part] + U64(which)))
    return out


def same_as_before(*columns: np.ndarray) -> np.ndarray:
    """For sorted rows: whether a row equals the one before."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[:1] = False
    for c in columns:
        out[1:] &= c[1:] == c[:-1]
    return out


def shared_keys(keys: np.ndarray, several: np.ndarray) -> np.ndarray:
    """Mask of the entries whose key comes more than once or is marked as held by several documents."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(~same_as_before(keys[order]))
    count = np.diff(np.append(first, len(keys)))
    good = (count > 1) | np.logical_or.reduceat(several[order], first) if len(keys) else np.zeros(0, dtype=bool)
    out = np.zeros(len(keys), dtype=bool)
    out[order] = np.repeat(good, count)
    return out


def window_names(strips: np.ndarray, count: np.ndarray, least: int):
    """Both names of each window of each padded strip, by pairs of names of their halves; and their strips and places in them."""
    half = least // 2
    found = [[], [], [], []]
    for a in range(0, len(strips), ROWS_AT_ONCE):
        part, here = strips[a:a + ROWS_AT_ONCE], count[a:a + ROWS_AT_ONCE].astype(np.int64)
        own = np.repeat(np.arange(len(part)), here)
        w = np.arange(len(own)) - np.repeat(np.cumsum(here) - here, here)
        for which in (0, 1):
            rest = names(part, least - half, which)
            if half:
                found[which].append(mixed(names(part, half, which)[own, w] * _power(which, least - half) + rest[own, w + half]))
            else:
                found[which].append(mixed(rest[own, w]))
        found[2].append(own + a)
        found[3].append(w)
    return tuple(np.concatenate(f) for f in found)


def least_documents(key, strips, count, offset, doc, least: int):
    """For each strip the smallest document of each of its windows.

    Strips that are the only variant of their key have one answer for all
    windows. Where a key has several variants, their windows are named by the
    pair of names of their halves and compared one by one.

    Returns (answer per strip, mask of strips answered window by window,
    answers of those strips' windows in order).
    """
    h1, h2 = strip_names(strips, count, offset)
    order = np.lexsort((h2, h1, key))
    new_strip = ~same_as_before(key[order], h1[order], h2[order])
    strip = np.cumsum(new_strip) - 1
    first = np.flatnonzero(new_strip)
    best = np.minimum.reduceat(doc[order], first)
    strip_of = np.empty(len(key), dtype=np.int64)
    strip_of[order] = strip
    keys = key[order][first]
    new_key = ~same_as_before(keys)
    variants = np.diff(np.append(np.flatnonzero(new_key), len(keys)))
    several = np.repeat(variants > 1, variants)
    answer = best[strip_of]
    by_window = several[strip_of]
    wanted = np.flatnonzero(several)
    if not len(wanted):
        return answer, by_window, np.zeros(0, dtype=np.int64)
    one = order[first][wanted]
    n_windows = count[one].astype(np.int64)
    half = least // 2
    found = [[], [], [], [], []]
    for a in range(0, len(one), ROWS_AT_ONCE):
        part = one[a:a + ROWS_AT_ONCE]
        here = n_windows[a:a + ROWS_AT_ONCE]
        own = np.repeat(np.arange(len(part)), here)
        w = np.arange(len(own)) - np.repeat(np.cumsum(here) - here, here)
        for which in (0, 1):
            gram = names(strips[part], half, which)
            rest = names(strips[part], least - half, which)
            found[which].append(gram[own, w] * _power(which, least - half) + rest[own, w + half])
        found[2].append(key[part][own])
        found[3].append(offset[part][own].astype(np.int64) - w)
        found[4].append(best[wanted[a:a + ROWS_AT_ONCE]][own])
    w1, w2, k, o, d = (np.concatenate(f) for f in found)
    order = np.lexsort((o, w2, w1, k))
    new = ~same_as_before(k[order], w1[order], w2[order], o[order])
    at = np.flatnonzero(new)
    result = np.empty(len(k), dtype=np.int64)
    result[order] = np.repeat(np.minimum.reduceat(d[order], at), np.diff(np.append(at, len(k))))
    # from the distinct strips back to all strips that are answered window by window
    begin = np.full(len(first), -1, dtype=np.int64)
    begin[wanted] = np.cumsum(n_windows) - n_windows
    rows = np.flatnonzero(by_window)
    each = count[rows].astype(np.int64)
    inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return answer, by_window, result[np.repeat(begin[strip_of[rows]], each) + inside]
