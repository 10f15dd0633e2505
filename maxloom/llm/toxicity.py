"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text: one of ordinary text's commonest words, one with the same words and,
nearest its end, the words that toxic text brings. Every text is cut into windows of three words; each window is compressed
with both, between a lead-in and a lead-out that both dictionaries hold (without them so short an input is stored raw, and its
end is never matched). The bytes that the toxic dictionary saves are the window's evidence; windows that save any are
compressed again word by word. A text's largest savings and counts of windows over several savings go through a threshold
calibration (logistic, fitted on labelled rows that the dictionaries did not see).

Labels are read only from rows that `held_out` excludes, and of those at most TRAIN_TOXIC toxic and TRAIN_ORDINARY ordinary
ones of at most TRAIN_BYTES each, by least hash of the id: the sample is bounded, scoring covers every text in full. A word's weight in training is the
number of different neighbourhoods it stands in, so copied documents count once. Null and empty texts score as a text without
windows; without labels of both kinds every score is the share of toxic labels (0 if none); null ids are scored too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, text_bytes, tidied, word_spans

TRAIN_TOXIC = 4000
TRAIN_ORDINARY = 6000
TRAIN_BYTES = 16384
TRAIN_PASS_BYTES = 2 << 20
ORDINARY_WORDS = 12_000
#: A toxic word's rate of neighbourhoods against its rate in ordinary text.
RATIO = 90.0
#: Compression of windows and of single words. The first has match tables large enough that dictionary words do not displace one another.
LEVELS = ((3, {"hash_log": 20, "chain_log": 20}), (16, {}))
WINDOW_WORDS = 3
#: Bytes of the lead-out: a match cannot start in the last eight bytes of an input.
TAIL = 12
#: Windows that save so many bytes are compressed again word by word.
LOOK_AGAIN = 1
SAVINGS = (3, 5, 7, 9)
FEATURES = 3 + len(SAVINGS)
THRESHOLD = 0.7


def _neighbourhoods(texts: pa.Array) -> dict[bytes, int]:
    """In how many different neighbourhoods (word before, word after) each word stands; words with fewer than 3 are left out."""
    flat, at = text_bytes(texts)
    parts, row = [], 0
    while row < len(at) - 1:  # some texts at a time: working arrays are many times as large
        stop = max(row + 1, int(np.searchsorted(at, at[row] + TRAIN_PASS_BYTES, "right")) - 1)
        h, starts, lengths, _ = word_spans(flat[at[row] : at[stop]], at[row : stop + 1] - at[row])
        if len(h):
            parts.append((h, starts + at[row], lengths, np.concatenate([[0], h[:-1]]).astype(np.uint64) * np.uint64(3) + np.append(h[1:], np.uint64(0))))
        row = stop
    if not parts:
        return {}
    h, starts, lengths, around = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((around, h))
    w, a = h[order], around[order]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w[1:] != w[:-1]) | (a[1:] != a[:-1])
    head = np.flatnonzero(np.diff(w, prepend=~w[:1]))
    counts = np.add.reduceat(fresh.astype(np.int64), head)
    raw = flat.tobytes()
    return {raw[starts[i] : starts[i] + lengths[i]]: int(c) for i, c in zip(order[head[counts >= 3]], counts[counts >= 3], strict=True)}


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    lead: bytes
    weights: np.ndarray
    rate: float


def _dictionaries(texts: pa.Array, labels: np.ndarray) -> tuple[bytes, bytes, bytes]:
    t, o = _neighbourhoods(texts.filter(pa.array(labels == 1))), _neighbourhoods(texts.filter(pa.array(labels == 0)))
    all_t, all_o = max(sum(t.values()), 1), max(sum(o.values()), 1)
    least = max(3, round(0.003 * int(labels.sum())))
    own = [w for w, n in t.items() if n >= least and len(w) >= 4 and n / all_t > RATIO * (o.get(w, 0) + 0.5) / all_o]
    own.sort(key=lambda w: (t[w], w))
    common = sorted(o, key=lambda w: (o[w], w))[-ORDINARY_WORDS:]
    base = b" " + b" ".join(common) + b" "
    return base, base + b" ".join(own) + b" ", base[:48]


class Scorer:
    """Savings of every window of texts, and from them each text's features."""

    def __init__(self, ordinary: bytes, toxic: bytes, lead: bytes):
        self.lead = np.frombuffer(lead, np.uint8)
        self.compressors = []
        for level, sizes in LEVELS:
            how = zstandard.ZstdCompressionParameters.from_level(level, window_log=19, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0, **sizes)
            for content in (ordinary, toxic):
                made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                made.precompute_compress(compression_params=how)
                self.compressors.append(zstandard.ZstdCompressor(dict_data=made, compression_params=how))

    def _lengths(self, compressor, data: bytes, segments: np.ndarray) -> np.ndarray:
        out = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments.tobytes()), threads=1)
        return np.fromiter(map(len, out), np.int64, len(segments))

    def savings(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, level: int) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window: lead-in, one space, flat[begin : begin + size], one space, lead-out."""
        lead = len(self.lead)
        tail = self.lead[:TAIL]
        whole = size + lead + 2 + len(tail)
        to = np.cumsum(whole) - whole
        data = np.full(int(whole.sum()), 32, np.uint8)
        data[(to[:, None] + np.arange(lead)).ravel()] = np.tile(self.lead, len(to))
        data[(to[:, None] + (whole - len(tail))[:, None] + np.arange(len(tail))).ravel()] = np.tile(tail, len(to))
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        data[np.repeat(to + lead + 1, size) + inner] = flat[np.repeat(begin, size) + inner]
        raw, segments = data.tobytes(), np.stack([to, whole], 1).astype(np.uint64)
        ordinary, toxic = self.compressors[2 * level : 2 * level + 2]
        return self._lengths(ordinary, raw, segments) - self._lengths(toxic, raw, segments)

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: FEATURES of its windows, then of the single words of the windows that saved bytes."""
        flat, at = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
        n = len(at) - 1
        space = flat <= 32
        first = ~space
        first[1:] &= space[:-1]
        cuts = at[(at > 0) & (at < len(flat))]
        first[cuts] = ~space[cuts]
        starts = np.flatnonzero(first)
        out = np.zeros((n, 2 * FEATURES))
        if not len(starts):
            return out
        word_row = np.searchsorted(at, starts, "right") - 1
        word_end = np.minimum(np.append(starts[1:], len(flat)), at[word_row + 1])
        nth = np.arange(len(starts)) - np.searchsorted(starts, at)[word_row]
        head = np.flatnonzero(nth % WINDOW_WORDS == 0)
        begin, row = starts[head], word_row[head]
        end = np.minimum(np.append(begin[1:], len(flat)), at[row + 1])
        saved = self.savings(flat, begin, end - begin, 0)
        out[:, :FEATURES] = _summed(saved, row, n)
        again = np.repeat(saved >= LOOK_AGAIN, np.diff(np.append(head, len(starts))))
        if again.any():
            out[:, FEATURES:] = _summed(self.savings(flat, starts[again], (word_end - starts)[again], 1), word_row[again], n)
        return np.clip(out, -12, 20)


def _summed(saved: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The largest and second largest saving of each row, logs of how many reach each of SAVINGS, log of how many there are."""
    out = np.zeros((n, FEATURES))
    group = np.flatnonzero(np.diff(row, prepend=-1))
    rows, last = row[group], np.append(group[1:], len(saved)) - 1
    out[rows, 0] = np.maximum.reduceat(saved, group)
    order = np.lexsort((saved, row))
    out[rows, 1] = np.where(last > group, saved[order[np.maximum(last - 1, 0)]], 0)
    for k, least in enumerate(SAVINGS):
        out[rows, 2 + k] = np.log1p(np.add.reduceat((saved >= least).astype(np.int64), group))
    out[rows, -1] = np.log1p(last - group + 1)
    return out


def _expand(x: np.ndarray) -> np.ndarray:
    """Features with hinges on the largest savings, so the calibration can place thresholds."""
    parts = [np.ones((len(x), 1)), x]
    for base in (0, FEATURES):
        parts += [np.clip(x[:, [base + j]] - t, 0, 3) for j in (0, 1) for t in (2, 4, 6, 8, 10)]
        parts.append(x[:, base + 2 : base + 2 + len(SAVINGS)] - x[:, [FEATURES - 1]])
    return np.hstack(parts)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], penalty)
    keep[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: pa.Array, labels: np.ndarray) -> Model:
    """Dictionaries from all rows; the calibration sees each third of the rows through dictionaries of the other two."""
    rate = float(labels.mean()) if len(labels) else 0.0
    if labels.sum() < 3 or (labels == 0).sum() < 3:
        return Model(b"", b"", b"", np.empty(0), rate)
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    part = np.arange(len(labels)) % 3
    x = np.zeros((len(labels), 2 * FEATURES))
    for fold in range(3):
        scorer = Scorer(*_dictionaries(lower.filter(pa.array(part != fold)), labels[part != fold]))
        own = np.flatnonzero(part == fold)
        for some in np.array_split(own, max(1, len(own) // 500)):
            x[some] = scorer.features(texts.take(pa.array(some)))
    return Model(*_dictionaries(lower, labels), _logistic(_expand(x), labels), rate)


def _score(model: Model):
    def run(batches):
        scorer = Scorer(model.ordinary, model.toxic, model.lead) if len(model.weights) else None
        for batch in batches:
            for part in byte_slices(batch, 1, 4 << 20):
                if scorer:
                    value = 1 / (1 + np.exp(-np.clip(_expand(scorer.features(part.column(1))) @ model.weights, -30, 30)))
                else:
                    value = np.full(len(part), model.rate)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value)], ["doc_id", "score"])

    return run


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """Labelled rows of texts up to TRAIN_BYTES: at most TRAIN_TOXIC and TRAIN_ORDINARY, those of least hash of the id."""
    pool = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    chosen = pool.where("toxic = 1").orderBy("h", "doc_id").limit(TRAIN_TOXIC).unionByName(pool.where("toxic = 0").orderBy("h", "doc_id").limit(TRAIN_ORDINARY))
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(chosen), "doc_id").select("h", "text", "toxic").toArrow().sort_by("h")
    return rows.column("text").combine_chunks(), rows.column("toxic").to_numpy().astype(np.int64)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text) by `labels` (doc_id, toxic)."""
    model = train(*training_rows(docs, labels))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(_score(model)), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
