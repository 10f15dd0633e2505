"""Packing by Karmarkar-Karp multiway differencing.

Documents are encoded once; full windows of a document are sequences of their own. The remainders, in pieces of at most PIECE
ids and in blocks of about a million tokens inside each partition, are dealt over k windows: the two partial partitions with the
largest spread are merged with opposing imbalances (largest part on smallest) until one is left, so the k windows are near
equal. k starts at the least count that could hold the block and rises whenever a window exceeds its capacity.

Narrow: no shuffle, and a lost executor's partition is packed again the same way. Null text is empty: one id, the end mark.
Repeated rows, null ids and clashing extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, tidied

WINDOW = 4096
#: Remainders are cut to this many ids, so that windows come out equal enough to be full.
PIECE = 1024
END_ID = 2
BLOCK_TOKENS = 1 << 20
BLOCK_PIECES = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of `sizes` dealt into k sets of near-equal sums by largest differencing (ties by position)."""
    if k == 1:
        return [list(range(len(sizes)))]
    # A partial partition: its part sums, descending, less the least one; and the pieces of each part as nested pairs.
    heap = [(-s, i, np.array([s], np.int64), [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, pa_ = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        # Parts not listed are empty sums of 0: the larger parts of a meet the smaller (mostly empty) parts of b.
        n, m = len(a), len(b)
        if n + m <= k:
            sums, parts = np.concatenate([a, b]), pa_ + pb
        else:
            both = n + m - k  # so many parts hold pieces of a and of b
            sums = np.concatenate([a[: n - both], a[n - both :] + b[::-1][:both], b[: m - both]])
            parts = pa_[: n - both] + list(zip(pa_[n - both :], pb[::-1][:both], strict=True)) + pb[: m - both]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        parts = [parts[i] for i in order]
        if len(sums) == k and sums[-1]:
            sums = sums - sums[-1]
            # Parts at 0 stay listed, as they hold pieces.
        heapq.heappush(heap, (-int(sums[0]) + (int(sums[-1]) if len(sums) == k else 0), tie, sums, parts))
        tie += 1
    out: list[list[int]] = []
    for part in heap[0][3] if heap else []:
        flat, stack = [], [part]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                flat.append(x)
        out.append(flat)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices dealt into as few near-equal windows as differencing finds; no window is over capacity."""
    if not sizes:
        return []
    k = max(-(-sum(sizes) // capacity), sum(s > capacity // 2 for s in sizes), 1)
    while True:
        dealt = differencing(sizes, k)
        over = max(sum(sizes[i] for i in x) for x in dealt)
        if over <= capacity:
            return dealt
        k += max(1, k // 200)


def pack_pieces(tokenizer_path: str, capacity: int = WINDOW, end_id: int = END_ID, piece: int = PIECE):
    """mapInArrow function: (doc_id, text) to one row per piece."""

    def run(batches):
        from .wordpiece import BATCH_BYTES, encoder as held_encoder

        encoder = held_encoder(tokenizer_path)
        number = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        tokens = 0
        full: list[tuple] = []

        def flush():
            nonlocal number, held, tokens, full
            rows = []
            for piece in full:
                rows.append((*piece, number, 0))
                number += 1
            # Longest first, so ties fall by document order; each window then lists its pieces in that order.
            for window in windows([p[2] for p in held], capacity):
                offset = 0
                for i in sorted(window):
                    rows.append((*held[i], number, offset))
                    offset += held[i][2]
                number += 1
            held, full, tokens = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], NAMES) if rows else None

        for batch in batches:
            for part in byte_slices(batch, 1, BATCH_BYTES):
                for doc, ids in zip(part.column(0).to_pylist(), encoder.ids(part.column(1)), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    whole = len(ids) // capacity * capacity
                    for start in (*range(0, whole, capacity), *range(whole, len(ids), piece)):
                        own = ids[start : start + (capacity if start < whole else piece)]
                        (full if start < whole else held).append((doc, start, len(own), zlib.crc32(own.tobytes()), len(ids)))
                        tokens += len(own)
                    if tokens >= BLOCK_TOKENS or len(held) >= BLOCK_PIECES:
                        yield flush()
        if (rest := flush()) is not None:
            yield rest

    return run


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(pack_pieces(tokenizer_path, capacity, end_id)), SCHEMA)
