"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (byte classes, words, lines, repetition) come from numpy passes over Arrow batches; a text of over
PASS_BYTES is read piece by piece to the same statistics. Trees are grown on quantile bins, to a fixed depth, and flattened into arrays, so a batch walks all trees with vector steps.

Labels are read only from rows that `held_out` excludes, at most TRAIN_ROWS of them, those of least hash of the id; only their
statistics reach the driver. Scoring covers every text in full. Null text is empty; an empty text has all-zero statistics and is
scored like any other; without labels of both kinds every score is the share of good labels (1 if there are no labels at all,
so nothing is rejected unlearned). Null ids are scored too; extra columns, repeated rows and ties change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, mix64, row_sets, shingle_hashes, shingles_of, text_bytes, tidied, tidy, word_spans

TRAIN_ROWS = 20_000
TREES = 120
DEPTH = 4
RATE = 0.12
BINS = 64
THRESHOLD = 0.3
#: Text bytes per numpy pass; working arrays are over a hundred times as large.
PASS_BYTES = 512 << 10

# Byte classes: 0 other, 1 a-z, 2 A-Z, 3 digit, 4 space, 5 line end, 6 full stop, 7 comma, 8 ! or ?, 9 | or /, 10 other ASCII mark, 11 first byte of a character beyond ASCII, 12 later byte of one.
CLASSES = 13
_CLASS = np.zeros(256, np.int64)
_CLASS[0x21:0x7F] = 10
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 1, 2, 3
_CLASS[[0x20, 0x09]], _CLASS[[0x0A, 0x0D]] = 4, 5
_CLASS[0x2E], _CLASS[0x2C], _CLASS[[0x21, 0x3F]], _CLASS[[0x7C, 0x2F]] = 6, 7, 8, 9
_CLASS[0xC0:0x100], _CLASS[0x80:0xC0] = 11, 12
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def _cuts(flat: np.ndarray, most: int) -> list[int]:
    """Ends of pieces of about `most` bytes, each after a byte that is in no word (or wherever, in a word of that length)."""
    out, start = [], 0
    while len(flat) - start > most:
        gaps = np.flatnonzero((_CLASS[flat[start : start + most]] >= 4) & (_CLASS[flat[start : start + most]] <= 10))
        start += int(gaps[-1]) + 1 if len(gaps) else most
        out.append(start)
    return [*out, len(flat)]


def long_statistics(flat: np.ndarray, most: int) -> np.ndarray:
    """The statistics of one text, a piece at a time: sums are added up, lines go on from piece to piece, and of words and 3-grams only distinct hashes are held."""
    counts = np.zeros(CLASSES)
    marks = twins = words = short = far = capitals = trailed = total = square = grams = 0.0
    word_sets, gram_sets, line_keys = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    tail = np.empty(0, np.uint64)
    # Of the line that goes on: bytes, marks, capitals, bars, key. Of all ended ones: how many, worst shares, bytes in bad ones.
    held, held_key = np.zeros(4), np.uint64(0)
    lines, worst, bad = 0, np.zeros(3), np.zeros(2)

    def ended(parts: np.ndarray, keys: np.ndarray) -> None:
        nonlocal lines
        if len(keys):
            share = parts[:, 1:] / parts[:, :1]
            lines += len(keys)
            np.maximum(worst, share.max(0), out=worst)
            bad[0] += parts[share[:, 0] > 0.12, 0].sum()
            bad[1] += parts[share[:, 1] > 0.3, 0].sum()
            line_keys.append(np.unique(keys))

    start = 0
    for stop in _cuts(flat, most):
        part = flat[start:stop]
        kind = _CLASS[part]
        counts += np.bincount(kind, minlength=CLASSES)
        mark = (kind >= 6) & (kind <= 10)
        marks += mark.sum()
        twins += (part[1:] == part[:-1]).sum() + (start > 0 and flat[start - 1] == part[0])
        h, at, length, _ = word_spans(_LOWER[part], np.array([0, len(part)]))
        if len(h):
            words += len(h)
            total += length.sum()
            square += (length.astype(float) ** 2).sum()
            short += (length <= 3).sum()
            far += (length >= 12).sum()
            capitals += ((part[at] >= 0x41) & (part[at] <= 0x5A)).sum()
            after = np.minimum(start + at + length, len(flat) - 1)
            trailed += ((_CLASS[flat[after]] >= 6) & (_CLASS[flat[after]] <= 10) & (flat[after] != 0x2E) & (flat[after] != 0x2C)).sum()
            word_sets.append(np.unique(h))
            run = np.concatenate([tail, h])
            if len(run) >= 3:
                new, _ = shingles_of(run, np.array([0, len(run)]), 3)
                grams += len(new)
                gram_sets.append(np.unique(new))
            tail = run[-2:]
        head = np.concatenate([[0], np.flatnonzero(kind[:-1] == 5) + 1])
        size = np.diff(np.append(head, len(part)))
        place = np.arange(len(part)) - np.repeat(head, size)
        place[: size[0]] += int(held[0])
        keys = np.add.reduceat(mix64((place.astype(np.uint64) << np.uint64(8)) | part), head)
        parts = np.stack([size, *[np.add.reduceat(x.astype(np.int64), head) for x in (mark, kind == 2, kind == 9)]], 1).astype(float)
        parts[0] += held
        keys[:1] += held_key
        held, held_key = np.zeros(4), np.uint64(0)
        if kind[-1] != 5:
            held, held_key = parts[-1], keys[-1]
            parts, keys = parts[:-1], keys[:-1]
        ended(parts, keys)
        start = stop
    if held[0]:
        ended(held[None, :], np.array([held_key], np.uint64))
    size, some = float(len(flat)), max(words, 1)
    if 0 < words < 3:
        grams, gram_sets = 1.0, [shingles_of(tail, np.array([0, len(tail)]), 3)[0]]
    distinct = [len(np.unique(np.concatenate(x))) for x in (word_sets, gram_sets, line_keys)]
    mean = total / some
    out = [np.log1p(size), np.log1p(words), *(counts / max(size, 1)), marks / max(size, 1), twins / max(size, 1), mean, np.sqrt(max(square / some - mean**2, 0))]
    out += [short / some, far / some, capitals / some, trailed / some, distinct[0] / some, distinct[1] / max(grams, 1)]
    per = max(lines, 1)
    return np.nan_to_num(np.array([*out, np.log1p(lines), *worst, *(bad / max(size, 1)), distinct[2] / per, size / per]))[None, :]


def statistics(texts: pa.Array, most: int = PASS_BYTES) -> np.ndarray:
    """One row of statistics per text; a text of over `most` bytes that stands alone is read in pieces."""
    flat, at = text_bytes(texts)
    n = len(at) - 1
    if n == 1 and len(flat) > most:
        return long_statistics(flat, most)
    size = np.diff(at).astype(float)
    row = np.repeat(np.arange(n), np.diff(at))
    kind = _CLASS[flat]
    counts = np.bincount(row * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    share = counts / np.maximum(size, 1)[:, None]
    mark = (kind >= 6) & (kind <= 10)
    twin = np.zeros(len(flat), bool)
    twin[1:] = (flat[1:] == flat[:-1]) & (row[1:] == row[:-1])
    # Words.
    h, start, length, w_at = word_spans(_LOWER[flat], at)
    words = np.diff(w_at).astype(float)
    some = np.maximum(words, 1)
    mean = _per_row(length, w_at) / some
    spread = np.sqrt(np.maximum(_per_row(length.astype(float) ** 2, w_at) / some - mean**2, 0))
    capital = (flat[start] >= 0x41) & (flat[start] <= 0x5A) if len(start) else np.empty(0, bool)
    after = np.minimum(start + length, len(flat) - 1) if len(start) else start
    trailed = mark[after] & (flat[after] != 0x2E) & (flat[after] != 0x2C) if len(start) else np.empty(0, bool)
    distinct, d_at = row_sets(h, w_at)
    grams, g_at = shingle_hashes(_LOWER[flat], at, 3)
    _, gd_at = row_sets(grams, g_at)
    # Lines: shares of capitals and marks in the worst and the average line, and repeated lines.
    line_no = np.cumsum(np.concatenate([[0], (kind[:-1] == 5) | (np.diff(row) > 0)])) if len(flat) else np.empty(0, np.int64)
    out = [np.log1p(size), np.log1p(words), *share.T, _per_row(mark, at) / np.maximum(size, 1), _per_row(twin, at) / np.maximum(size, 1), mean, spread]
    out += [_per_row(length <= 3, w_at) / some, _per_row(length >= 12, w_at) / some, _per_row(capital, w_at) / some, _per_row(trailed, w_at) / some]
    out += [np.diff(d_at) / some, np.diff(gd_at) / np.maximum(np.diff(g_at), 1)]
    extra = np.zeros((8, n))
    if len(flat):
        lines = int(line_no[-1]) + 1
        head = np.flatnonzero(np.diff(line_no, prepend=-1))
        line_row = row[head]
        l_size = np.bincount(line_no, minlength=lines).astype(float)
        l_mark = np.bincount(line_no, weights=mark, minlength=lines) / l_size
        l_cap = np.bincount(line_no, weights=kind == 2, minlength=lines) / l_size
        l_bar = np.bincount(line_no, weights=kind == 9, minlength=lines) / l_size
        group = np.flatnonzero(np.diff(line_row, prepend=-1))
        rows = line_row[group]
        per = np.maximum(np.bincount(line_row, minlength=n), 1)
        extra[0] = np.log1p(np.bincount(line_row, minlength=n))
        for k, v in enumerate((l_mark, l_cap, l_bar)):
            extra[1 + k, rows] = np.maximum.reduceat(v, group)
        extra[4] = np.bincount(line_row, weights=(l_mark > 0.12) * l_size, minlength=n) / np.maximum(size, 1)
        extra[5] = np.bincount(line_row, weights=(l_cap > 0.3) * l_size, minlength=n) / np.maximum(size, 1)
        # A line's key: the sum of its mixed (byte, place) pairs.
        place = np.arange(len(flat)) - np.repeat(head, np.diff(np.append(head, len(flat))))
        key = np.add.reduceat(mix64((place.astype(np.uint64) << np.uint64(8)) | flat), head)
        l_at = np.searchsorted(line_row, np.arange(n + 1))
        _, ld_at = row_sets(key, l_at)
        extra[6] = np.diff(ld_at) / per
        extra[7] = size / per
    return np.nan_to_num(np.stack([*out, *extra], 1))


@dataclass
class Trees:
    """Complete binary trees, level order: node i of tree t sends a row to child 2i+1, or to 2i+2 if its value is over the cut."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node[0] < inner if len(node) else False:  # all rows are at the same level
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _constant(rate: float) -> Trees:
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), float(np.log(rate / (1 - rate))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, least: float = 4.0, penalty: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss on binned columns; splits by gain over all columns of a level at once."""
    if not len(y) or y.min() == y.max():
        return _constant(float(y.mean()) if len(y) else 1.0)
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    slots = np.arange(m) * bins
    model = _constant(float(y.mean()))
    margin = np.full(n, model.base)
    features, thresholds, leaves = [], [], []
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (m * bins) + slots + code).ravel()
            gs = np.bincount(place, weights=np.repeat(g, m), minlength=width * m * bins).reshape(width, m, bins)
            hs = np.bincount(place, weights=np.repeat(h, m), minlength=width * m * bins).reshape(width, m, bins)
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gr, hr = gt - gl, ht - hl
            gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - gt**2 / (ht + penalty)
            gain[(hl < least) | (hr < least)] = 0
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6:
                    feature[first + k], cut[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - inner
        leaf = -rate * np.bincount(at, weights=g, minlength=inner + 1) / (np.bincount(at, weights=h, minlength=inner + 1) + penalty)
        margin += leaf[at]
        features.append(feature)
        thresholds.append(cut)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), model.base)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _measure(batches):
    for batch in batches:
        for part in byte_slices(batch, 1, PASS_BYTES):
            rows = statistics(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(rows), pa.list_(pa.float64())), part.column(2)], ["h", "x", "quality"])


def train(docs: DataFrame, labels: DataFrame) -> Trees:
    pool = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("h", F.xxhash64("doc_id"))
    chosen = pool.orderBy("h", "doc_id").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("h", "text", "quality").mapInArrow(tidied(_measure), "h long, x array<double>, quality int").toArrow().sort_by("h")
    y = rows.column("quality").to_numpy().astype(float)
    return fit(np.array(rows.column("x").to_pylist()), y)


def _score(model: Trees):
    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 1, PASS_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(statistics(part.column(1))))], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text) by `labels` (doc_id, quality)."""
    model = train(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(_score(model)), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier does not reject: one pass, no join; only texts go to Python."""
    model = train(docs, labels)

    @F.arrow_udf("boolean")
    def good(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            yield pa.array(np.concatenate([model.score(statistics(part.column(0))) >= threshold for part in byte_slices(batch, 0, PASS_BYTES)] or [np.empty(0, bool)]))
        tidy()

    return docs.where(good("text"))
