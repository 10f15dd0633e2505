"""Removal of long repeated byte strings, by suffix arrays made with external induced sorting.

A byte goes if a string of SPAN bytes that covers it also starts anywhere else. Every such string is assigned a content-chosen
anchor (see `anchors`), so equal strings meet under one anchor; starts in a row with one anchor make a window of text.

1. Runs of all texts are listed.
2. Windows of equal content are counted. Those that occur again are repeated as a whole; one that is alone under its anchor is done.
3. Windows that occur once under an anchor with other windows go, with their texts, to shards by anchor. Each shard's suffix
   array tells which of their starts have an equal string elsewhere. Sorting queues go to disk beyond a bound.
4. Under an anchor with more than HOT different windows nothing is gathered: windows are cut into slices of a few starts, slices
   are told apart by the bytes that all their strings share, and starts of slices that are still tied are counted string by string.

Strings are compared as bytes within shards, and by 128-bit fingerprints (64 of them with the anchor, or with the bytes that a
slice shares) between equal windows, slices and single strings. Null text is empty. Rows with a null id are numbered inside, so that their
strings count like any other; their doc_id is null. Rows of a repeated id are told apart by their text's hash, and strings of a
row that is repeated as a whole occur more than once; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import _rolled, runs
from .common import byte_slices, identified, _LETTER, materialize, mix64, own_id, row_hash, text_bytes, tidied, whole_groups
from .induced import repeated_starts

SPAN = 400
SHARD_BYTES = 2 << 20
HOT = 1024
SLICE = 16
QUEUE_BYTES = 64 << 20

_RUNS = "doc_id long, h long, start int, count int, place int, anchor long, content long"


_CUT = "doc_id long, h long, start int, count int, place int, anchor long, once boolean, hot boolean, bytes binary"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _list_runs(span: int):
    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 2, 1 << 20):
                flat, at = text_bytes(part.column(2))
                r = runs(flat, at, span)
                content = mix64(r.content + mix64((r.place.astype(np.uint64) << np.uint64(32)) | r.count.astype(np.uint64)))
                rows = part.select([0, 1]).take(pa.array(r.row))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(r.start, pa.int32()), pa.array(r.count, pa.int32()), pa.array(r.place, pa.int32()), _as_long(r.anchor), _as_long(content)], _names(_RUNS))

    return run


def _cut(span: int):
    """(doc_id, h, text, windows) to a row per window, with its bytes."""

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 2):
                flat, at = text_bytes(part.column(2))
                lists = part.column(3)
                owner = np.repeat(np.arange(len(part)), lists.value_lengths().fill_null(0).to_numpy())
                windows = lists.flatten()
                start, count = windows.field("start").to_numpy(), windows.field("count").to_numpy()
                raw = flat.tobytes()
                begin = at[owner] + start
                for cut in range(0, len(owner), 4000):
                    own = slice(cut, cut + 4000)
                    texts = [raw[b : b + c + span - 1] for b, c in zip(begin[own], count[own], strict=True)]
                    some = windows.slice(cut, 4000)
                    rows = part.select([0, 1]).take(pa.array(owner[own]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, *[some.field(c) for c in _names(_CUT)[2:-1]], pa.array(texts, pa.binary())], _names(_CUT))

    return run


def _stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _sort_shards(span: int, shard_bytes: int, queue_bytes: int):
    """Windows sorted by anchor to stretches of repeated starts of those that occur once."""

    def shard(tables):
        table = pa.concat_tables(tables)
        once = table.column("once").to_numpy()
        start = table.column("start").to_numpy()
        at, first, length = [], [], []
        for i, hit in enumerate(repeated_starts(table.column("bytes").to_pylist(), span, queue_bytes)):
            if once[i] and hit.any():
                a, b = _stretches(hit)
                at += [i] * len(a)
                first += list(start[i] + a)
                length += list(b - a)
        rows = table.select(["doc_id", "h"]).take(pa.array(at, pa.int64())).combine_chunks()
        columns = [rows.column(c).chunk(0) if rows.num_rows else pa.array([], pa.int64()) for c in ("doc_id", "h")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(first, pa.int32()), pa.array(length, pa.int32())], ["doc_id", "h", "start", "count"])

    def run(batches):
        held, size = [], 0
        for table, at in whole_groups(batches, ["anchor"]):
            sizes = np.concatenate([[0], np.cumsum(table.column("count").to_numpy() + span)])
            begin = 0
            for stop in at[1:]:
                if size + sizes[stop] - sizes[begin] > shard_bytes:
                    # Whole groups only: what is gathered so far makes a shard.
                    held.append(table.slice(begin, int(stop) - begin))
                    yield shard(held)
                    held, size, begin = [], 0, int(stop)
            if begin < table.num_rows:
                held.append(table.slice(begin))
                size += sizes[-1] - sizes[begin]
        if held:
            yield shard(held)

    return run


def _slices(span: int, width: int):
    """Windows to slices of `width` starts, aligned to the anchor: key of anchor, slice and shared bytes, and content."""

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, batch.schema.get_field_index("bytes")):
                flat, at = text_bytes(part.column("bytes").cast(pa.binary()))
                count, place, start = (part.column(c).to_numpy() for c in ("count", "place", "start"))
                anchor = part.column("anchor").to_numpy().view(np.uint64)
                out: list[list] = [[], [], [], [], []]
                for i in range(len(part)):
                    # A start's place before the anchor is place - offset; slices are cut at multiples of `width` of it.
                    text = _LETTER[flat[at[i] : at[i + 1]]]
                    top = int(place[i]) // width
                    low = (int(place[i]) - int(count[i]) + 1) // width
                    for piece in range(low, top + 1):
                        a, b = max(0, int(place[i]) - (piece + 1) * width + 1), min(int(count[i]) - 1, int(place[i]) - piece * width)
                        if a > b:
                            continue
                        # Bytes that every string of the whole slice shares, whether or not all its starts are in this window.
                        core_a, core_b = int(place[i]) - piece * width, int(place[i]) - (piece + 1) * width + span
                        core = _hash(text[core_a:core_b])
                        key = mix64(np.array([int(anchor[i]) ^ (piece * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], np.uint64) + np.uint64(core))[0]
                        whole = mix64(np.array([_hash(text[a : b + span])], np.uint64) + np.uint64(a - core_a & 0xFFFF))[0]
                        for column, v in zip(out, (i, start[i] + a, b - a + 1, key, whole), strict=True):
                            column.append(v)
                rows = part.select(["doc_id", "h", "once"]).take(pa.array(out[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), _as_long(np.array(out[3], np.uint64)), _as_long(np.array(out[4], np.uint64))], ["doc_id", "h", "once", "start", "count", "key", "content"])

    return run


def _hash(letters: np.ndarray) -> int:
    return int(mix64(_rolled(letters, len(letters)))[0]) if len(letters) else 0


def _singles(span: int):
    """(doc_id, h, text, windows) to a row per start, with its slice's key and the fingerprint of its string."""

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 2):
                flat, at = text_bytes(part.column(2))
                lists = part.column(3)
                owner = np.repeat(np.arange(len(part)), lists.value_lengths().fill_null(0).to_numpy())
                windows = lists.flatten()
                start, count, key = (windows.field(c).to_numpy() for c in ("start", "count", "key"))
                rows, starts, prints = [], [], []
                for o, s, c in zip(owner, start, count, strict=True):
                    letters = _LETTER[flat[at[o] + s : at[o] + s + c + span - 1]]
                    rows += [o] * int(c)
                    starts += range(int(s), int(s + c))
                    prints.append(mix64(_rolled(letters, span)))
                own = part.select([0, 1]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(starts, pa.int32()), pa.array(np.repeat(key, count), pa.int64()), _as_long(np.concatenate(prints) if prints else np.empty(0, np.uint64))], ["doc_id", "h", "start", "key", "print"])

    return run


def _finish(span: int):
    """(doc_id, text, stretches of repeated starts) to what is left of each text."""

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 1):
                flat, at = text_bytes(part.column(1))
                lists = part.column(2)
                sizes = lists.value_lengths().fill_null(0).to_numpy()
                ends = np.cumsum(sizes)
                items = lists.flatten()
                first, count = items.field("start").to_numpy(), items.field("count").to_numpy()
                removed, spans, digests = [], [], []
                for i in range(len(part)):
                    text = flat[at[i] : at[i + 1]]
                    if not sizes[i]:
                        removed.append(0)
                        spans.append(0)
                        digests.append(hashlib.sha256(text).hexdigest())
                        continue
                    own = slice(ends[i] - sizes[i], ends[i])
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, first[own], 1)
                    np.add.at(edge, first[own] + count[own] + span - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(len(_stretches(gone)[0]))
                    digests.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _listed(windows: DataFrame, columns: list[str]) -> DataFrame:
    """A text's windows in one row; a text has no more of them than bytes."""
    return windows.groupBy("doc_id", "h").agg(F.collect_list(F.struct(*columns)).alias("windows"))


def _hot_stretches(texts: DataFrame, windows: DataFrame, span: int) -> DataFrame:
    cut = materialize(windows.mapInArrow(tidied(_slices(span, SLICE)), "doc_id long, h long, once boolean, start int, count int, key long, content long"), "repeat-slices")
    same = materialize(cut.groupBy("key", "content").agg(F.count("*").alias("n"), F.max(~F.col("once")).alias("again")), "repeat-slice-texts")
    tied = materialize(same.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1"), "repeat-slice-ties")
    whole = cut.join(same.where("n > 1 OR again"), ["key", "content"]).where("once").select("doc_id", "h", "start", "count")
    # One row of each text that is tied: all rows of once-windows, and a row of the others, which stand for strings that occur elsewhere.
    rest = materialize(cut.join(tied.select("key"), "key").select("doc_id", "h", "start", "count", "key"), "repeat-tied")
    single = materialize(texts.join(_listed(rest, ["start", "count", "key"]), ["doc_id", "h"]).mapInArrow(tidied(_singles(span)), "doc_id long, h long, start int, key long, print long"), "repeat-singles")
    # Equal strings are in slices of one key (of their anchor, place and shared bytes): key and print are 128 bits.
    again = materialize(single.groupBy("key", "print").agg(F.count("*").alias("n")).where("n > 1").select("key", "print"), "repeat-prints")
    return whole.unionByName(single.join(again, ["key", "print"]).select("doc_id", "h", "start", F.lit(1).alias("count")))


def suffix_dedup(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, shard_bytes: int = SHARD_BYTES, queue_bytes: int = QUEUE_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts = identified(docs, id_col, F.col(text_col).alias("text"))
    texts = texts.select("doc_id", row_hash(F.xxhash64("text"), F.col("unnamed")).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    listed = materialize(texts.where(F.octet_length("text") >= span).mapInArrow(tidied(_list_runs(span)), _RUNS), "repeat-runs")
    first = F.min(F.struct("doc_id", "h", "start", "count", "place")).alias("first")
    windows = materialize(listed.groupBy("anchor", "content").agg(F.count("*").alias("n"), first), "repeat-windows")
    shared = materialize(windows.groupBy("anchor").agg(F.count("*").alias("texts")).where("texts > 1"), "repeat-shared")
    # From the runs as texts gave them: a window that is everywhere comes from all of their files, so the runtime can split it.
    whole = listed.join(windows.where("n > 1").select("anchor", "content").hint("merge"), ["anchor", "content"]).select("doc_id", "h", "start", "count")
    todo = windows.join(shared.hint("merge"), "anchor").select("anchor", (F.col("n") == 1).alias("once"), "first.*", (F.col("texts") > hot).alias("hot"))
    todo = materialize(todo, "repeat-todo")
    wanted = _listed(todo, _names(_CUT)[2:-1])
    cut = texts.join(wanted.hint("merge"), ["doc_id", "h"]).select("doc_id", "h", "text", "windows").mapInArrow(tidied(_cut(span)), _CUT)
    cut = materialize(cut, "repeat-cut")
    dealt = cut.where("NOT hot").select("doc_id", "h", "start", "count", "anchor", "once", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    repeated = whole.unionByName(dealt.mapInArrow(tidied(_sort_shards(span, shard_bytes, queue_bytes)), "doc_id long, h long, start int, count int"))
    if not todo.where("hot").isEmpty():
        repeated = repeated.unionByName(_hot_stretches(texts, cut.where("hot"), span))
    stretches = _listed(repeated, ["start", "count"])
    out = texts.join(stretches.hint("merge"), ["doc_id", "h"], "left").select(own_id(F.col("doc_id"), F.col("h")).alias("doc_id"), "text", "windows")
    return out.mapInArrow(tidied(_finish(span)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
