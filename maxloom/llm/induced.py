"""External induced suffix sorting with common-prefix values, in vector steps.

Suffixes are L (greater than the next one) or S; S suffixes after an L are seeds (S*). Substrings between seeds are sorted and
named; seed suffixes are sorted over their names by doubling, as deep as the wanted prefix; all other suffixes are then induced: a
queue per first character hands out suffixes in order, and each puts the suffix one to its left into that one's queue, L
ascending, then S descending. With every suffix its common prefix with the one before goes along: one more than the least
common prefix between the two that induced them. Queues are priority queues of runs whose contents go to disk beyond `memory` bytes, so a
text may be far larger than what is held of it at once beyond its flat arrays.

Texts are separated by a mark that equals nothing, not even itself. Prefixes are compared up to `cap` bytes.
"""

from __future__ import annotations

import tempfile

import numpy as np

MARK = 0


class DiskQueues:
    """One first-in-first-out queue of (position, common prefix) per character; the fullest go to disk beyond `memory` bytes."""

    def __init__(self, characters: int, memory: int):
        self.held: list[list[np.ndarray]] = [[] for _ in range(characters)]
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(characters)]
        self.size = np.zeros(characters, np.int64)
        self.memory = memory
        self.file = None

    def put(self, character: int, items: np.ndarray) -> None:
        self.held[character].append(items)
        self.size[character] += items.nbytes
        while self.size.sum() > self.memory:
            fullest = int(self.size.argmax())
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            data = np.concatenate(self.held[fullest], 1)
            at = self.file.seek(0, 2)
            self.file.write(np.ascontiguousarray(data.T).tobytes())
            self.spilled[fullest].append((at, data.shape[1]))
            self.held[fullest], self.size[fullest] = [], 0

    def take(self, character: int) -> np.ndarray:
        parts = []
        for at, n in self.spilled[character]:
            self.file.seek(at)
            parts.append(np.frombuffer(self.file.read(8 * n), np.int32).reshape(n, 2).T)
        parts += self.held[character]
        self.held[character], self.spilled[character], self.size[character] = [], [], 0
        return np.concatenate(parts, 1) if parts else np.empty((2, 0), np.int32)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Minima:
    """Least common prefix of any stretch of a batch, by a table of minima over powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def over(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), np.int16)
        for k in np.unique(level):
            own = level == k
            row = self.rows[k]
            out[own] = np.minimum(row[first[own]], row[last[own] - (1 << int(k)) + 1])
        return out


class _Router:
    """Sends left neighbours to their characters' queues with their common prefixes."""

    def __init__(self, queues: DiskQueues, characters: int, cap: int):
        self.queues, self.cap = queues, cap
        # Least common prefix handed out since the last suffix that went to each character.
        self.since = np.zeros(characters, np.int16)

    def send(self, prefix: np.ndarray, index: np.ndarray, targets: np.ndarray, positions: np.ndarray, stay: int) -> np.ndarray:
        """prefix: of all of the batch; index: of those whose neighbour goes somewhere. Returns what stays in the batch's own bucket."""
        since, cap = self.since, self.cap
        if not len(index):
            np.minimum(since, prefix.min(), out=since)
            return np.empty((2, 0), np.int32)
        order = np.argsort(targets, kind="stable")
        index, targets, positions = index[order], targets[order], positions[order]
        first = np.ones(len(index), bool)
        first[1:] = targets[1:] != targets[:-1]
        heads = np.flatnonzero(first)
        value = np.empty(len(index), np.int16)
        value[first] = np.minimum(since[targets[first]], np.minimum.accumulate(prefix)[index[first]])
        rest = np.flatnonzero(~first)
        if len(rest):
            value[rest] = _Minima(prefix).over(index[rest - 1] + 1, index[rest])
        after = np.minimum.accumulate(prefix[::-1])[::-1]
        tails = np.append(heads[1:], len(index)) - 1
        np.minimum(since, prefix.min(), out=since)
        since[targets[tails]] = np.where(index[tails] + 1 < len(prefix), after[np.minimum(index[tails] + 1, len(prefix) - 1)], cap)
        items = np.stack([positions.astype(np.int32), np.minimum(value + 1, cap).astype(np.int32)])
        own = np.empty((2, 0), np.int32)
        for head, tail in zip(heads, tails + 1, strict=True):
            if targets[head] == stay:
                own = items[:, head:tail]
            else:
                self.queues.put(int(targets[head]), items[:, head:tail])
        return own


def _seed_names(text: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Names, in order, of the substrings from each seed to the next one (inclusive); marks have names of their own, by place."""
    length = np.diff(np.append(seeds, len(text) - 1)) + 1
    pad = np.int64(300)

    def column(rows: np.ndarray, at: int) -> np.ndarray:
        key = np.zeros(len(rows), np.int64)
        for k in range(at, at + 7):
            inside = k < length[rows]
            key = key << 9 | np.where(inside, text[np.minimum(seeds[rows] + k, len(text) - 1)], pad)
        return key

    everything = np.arange(len(seeds))
    key = column(everything, 0)
    mark = text[seeds] == MARK
    key[mark] = np.arange(mark.sum()) - mark.sum()
    _, name = np.unique(key, return_inverse=True)
    at = 7
    while True:
        rows = everything[(length > at) & ~mark]
        tied = np.bincount(name)[name] > 1
        rows = rows[tied[rows]]
        if not len(rows):
            return name
        # Substrings of a name that end here sort after those that go on, as their pad is the greatest.
        whole = np.flatnonzero(np.isin(name, name[rows]))
        more = column(whole, at)
        order = np.lexsort((more, name[whole]))
        n, m = name[whole][order], more[order]
        new = np.concatenate([[False], (n[1:] == n[:-1]) & (m[1:] != m[:-1])])
        # Each new name within an old one pushes all later names up.
        wide = name.astype(np.int64) << 32
        extra = np.cumsum(new)
        base = np.maximum.accumulate(np.where(np.concatenate([[True], n[1:] != n[:-1]]), extra, 0))
        wide[whole[order]] += extra - base
        _, name = np.unique(wide, return_inverse=True)
        at += 7


def sort_suffixes(text: np.ndarray, cap: int, memory: int = 64 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Positions of `text` (values 1 to 256, MARK after each part) in suffix order, and each one's common prefix with the one before, up to `cap`."""
    n = len(text)
    text = text.astype(np.int16)
    characters = 257
    index = np.arange(n, dtype=np.int32)
    # The next position of another character; marks differ from all.
    change = np.ones(n, bool)
    change[:-1] = (text[1:] != text[:-1]) | (text[:-1] == MARK)
    ahead = np.minimum.accumulate(np.where(change, index, n)[::-1])[::-1]
    run = ahead - index + 1
    following = text[np.minimum(ahead + 1, n - 1)]
    is_s = (following > text) | (text == MARK)
    is_s[n - 1] = True
    seed = is_s.copy()
    seed[0] = False
    seed[1:] &= ~is_s[:-1]
    seeds = np.flatnonzero(seed).astype(np.int32)

    # Seeds' order and common prefixes.
    ranks = [_seed_names(text, seeds)]
    reach = 1
    m = len(seeds)
    while reach < cap and ranks[-1].max(initial=-1) + 1 < m:
        rank = ranks[-1].astype(np.int64)
        then = np.full(m, 0, np.int64)
        then[:-reach] = rank[reach:] + 1
        key = rank << 32 | then
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[False], key[order][1:] != key[order][:-1]])
        out = np.empty(m, np.int64)
        out[order] = np.cumsum(new)
        ranks.append(out)
        reach *= 2
    order = np.argsort(ranks[-1], kind="stable")
    sorted_seeds = seeds[order]
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        inside = np.maximum(a, b) < m
        same = inside.copy()
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        a[same] += 1 << level
        b[same] += 1 << level
    # Past the equal names, characters.
    ends = np.append(seeds, n)
    common = ends[np.minimum(a, m)] - sorted_seeds[:-1]
    x, y = sorted_seeds[:-1] + common, sorted_seeds[1:] + common
    live = np.flatnonzero((common < cap) & (np.maximum(x, y) < n))
    while len(live):
        equal = (text[x[live]] == text[y[live]]) & (text[x[live]] != MARK)
        live = live[equal]
        common[live] += 1
        x[live] += 1
        y[live] += 1
        live = live[(common[live] < cap) & (np.maximum(x[live], y[live]) < n)]
    seed_prefix = np.concatenate([[0], np.minimum(common, cap)]).astype(np.int16)
    seed_bounds = np.searchsorted(text[sorted_seeds], np.arange(characters + 1))

    # L ascending.
    queues = DiskQueues(characters, memory)
    router = _Router(queues, characters, cap)
    l_parts: list[np.ndarray] = []

    def neighbours(items: np.ndarray, wanted: bool) -> tuple[np.ndarray, np.ndarray]:
        left = items - 1
        ok = np.flatnonzero((left >= 0) & (is_s[np.maximum(left, 0)] == wanted))
        return ok, left[ok]

    for c in range(characters):
        found = []
        batch = queues.take(c)
        if batch.shape[1]:
            batch[1, 0] = 0
        while batch.shape[1]:
            found.append(batch)
            ok, left = neighbours(batch[0], False)
            batch = router.send(batch[1].astype(np.int16), ok, text[left], left, c)
        l_parts.append(np.concatenate(found, 1) if found else np.empty((2, 0), np.int32))
        start, stop = seed_bounds[c], seed_bounds[c + 1]
        if stop > start:
            items, prefix = sorted_seeds[start:stop], seed_prefix[start:stop].copy()
            prefix[0] = min(int(run[l_parts[c][0, -1]]), int(run[items[0]]), cap) if l_parts[c].shape[1] and c != MARK else 0
            ok, left = neighbours(items, False)
            router.send(prefix, ok, text[left], left, -1)
    queues.close()

    # S descending; a batch's prefixes are with the one handed out before, which is the next greater.
    queues = DiskQueues(characters, memory)
    router = _Router(queues, characters, cap)
    order_parts, prefix_parts = [], []
    for c in range(characters - 1, -1, -1):
        found = []
        batch = queues.take(c)
        if batch.shape[1]:
            batch[1, 0] = 0
        while batch.shape[1]:
            found.append(batch)
            ok, left = neighbours(batch[0], True)
            batch = router.send(batch[1].astype(np.int16), ok, text[left], left, c)
        s_part = np.concatenate(found, 1) if found else np.empty((2, 0), np.int32)
        l_part = l_parts[c]
        seam = min(int(run[l_part[0, -1]]), int(run[s_part[0, -1]]), cap) if l_part.shape[1] and s_part.shape[1] and c != MARK else 0
        if l_part.shape[1]:
            items = l_part[0, ::-1]
            prefix = np.concatenate([[seam], l_part[1, :0:-1]]).astype(np.int16)
            ok, left = neighbours(items, True)
            router.send(prefix, ok, text[left], left, -1)
        # Ascending, with prefixes to the one before.
        order_parts.append(np.concatenate([l_part[0], s_part[0, ::-1]]))
        s_prefix = np.concatenate([[seam], s_part[1, :0:-1]]) if s_part.shape[1] else np.empty(0, np.int32)
        prefix_parts.append(np.concatenate([l_part[1], s_prefix]))
    queues.close()
    return np.concatenate(order_parts[::-1]), np.concatenate(prefix_parts[::-1])


def repeated_starts(parts: list[bytes], span: int, memory: int = 64 << 20) -> list[np.ndarray]:
    """For each part: which starts of strings of `span` bytes have an equal string at another start, in any part."""
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + 1
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = MARK
    order, prefix = sort_suffixes(text, span, memory)
    hit = np.zeros(len(text), bool)
    same = np.flatnonzero(prefix >= span)
    hit[order[same]] = True
    hit[order[same - 1]] = True
    return [hit[e - s : max(e - s, e - span + 1)] for s, e in zip(sizes, ends, strict=True)]
