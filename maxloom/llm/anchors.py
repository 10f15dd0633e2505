"""Content-chosen anchors: every string of SPAN bytes is assigned the least-hashed GRAM-byte gram in it, the leftmost if equal.

Equal strings have equal anchors at equal places, so strings can only be equal under one anchor hash and one place. A run
is all starts in a row with one anchor; its window is the text from the first start to the end of the last one's string.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .common import _LETTER, _powers, mix64

GRAM = 32
#: Starts handled at once; a longer text is cut into overlapping parts, whose runs are runs too.
PART = 1 << 20
_FACTOR = 0x100000001B3


class Runs(NamedTuple):
    row: np.ndarray
    start: np.ndarray  # of the first string, in its text
    count: np.ndarray  # of starts
    place: np.ndarray  # of the anchor, from `start`
    anchor: np.ndarray  # hash
    content: np.ndarray  # hash of the window


def _rolled(values: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of all windows of `length`, by doubling."""
    h, width = values, 1
    done = None  # hash of the windows of length `taken`
    taken = 0
    while True:
        if length & width:
            done = h if done is None else done[: len(done) - width] * np.uint64(pow(_FACTOR, width, 1 << 64)) + h[taken : taken + len(done) - width]
            taken += width
        if taken == length:
            return done
        h = h[:-width] * np.uint64(pow(_FACTOR, width, 1 << 64)) + h[width:]
        width *= 2


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of `width`."""
    have = 1
    while 2 * have <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    rest = width - have
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def runs(flat: np.ndarray, offsets: np.ndarray, span: int) -> Runs:
    """Runs of all rows; `flat` holds the rows' bytes end to end."""
    parts = []
    base = 0
    rows = len(offsets) - 1
    while base < rows:
        stop = max(base + 1, int(np.searchsorted(offsets, offsets[base] + PART, "right")) - 1)
        if stop == base + 1 and offsets[stop] - offsets[base] > PART + span:
            for cut in range(0, int(offsets[stop] - offsets[base]) - span + 1, PART):
                text = flat[offsets[base] + cut : min(offsets[base] + cut + PART + span - 1, offsets[stop])]
                found = _runs(text, np.array([0, len(text)]), span)
                parts.append(found._replace(row=found.row + base, start=found.start + cut))
        else:
            found = _runs(flat[offsets[base] : offsets[stop]], offsets[base : stop + 1] - offsets[base], span)
            parts.append(found._replace(row=found.row + base))
        base = stop
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else Runs(*[np.empty(0, np.int64)] * 4, *[np.empty(0, np.uint64)] * 2)


def _runs(flat: np.ndarray, offsets: np.ndarray, span: int) -> Runs:
    none = np.empty(0, np.int64)
    if len(flat) < span:
        return Runs(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    letters = _LETTER[flat]
    grams = mix64(_rolled(letters, GRAM))
    index = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64(0xFFFFFF)
    at = (_least((grams & ~low) | index, span - GRAM + 1) & low).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    good = np.arange(len(at)) + span <= offsets[row + 1]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    new[1:] |= ~good[:-1]
    start = np.flatnonzero(new & good)
    if not len(start):
        return Runs(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    total = np.concatenate([[0], np.cumsum(good)])
    ends = np.append(np.flatnonzero(new), len(at))
    stop = ends[np.searchsorted(ends, start, "right")]
    count = total[stop] - total[start]
    # Content: a sum of letters times falling powers, taken from prefix sums (exact modulo 2^64, powers of an odd number have inverses).
    inverse = pow(_FACTOR, -1, 1 << 64)
    powers = _powers(inverse, len(flat) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers[:-1], dtype=np.uint64)])
    forward = _powers(_FACTOR, len(flat) + 1)
    content = mix64((prefix[start + count + span - 1] - prefix[start]) * forward[start])
    r = row[start]
    return Runs(r, start - offsets[r], count, at[start] - start, grams[at[start]], content)
