"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is its bytes read as a polynomial modulo two primes. Chunks are hashed on their own and combined by
length-shifted arithmetic: chunks of a text over HUGE bytes are dealt out over tasks, hashed there and put together from
their fingerprints alone. Rows of equal fingerprint and length are then compared with their group's first row, chunk by chunk; a
row that differs (a collision) is grouped by its SHA-256 instead.

Texts are compared after each run of ASCII white space becomes one space. Null text is empty, and empty texts are equal. Rows
with a null id are numbered inside and count like others: their doc_id is null, a row with an id stays before them, and of a group without
any id one stays, with a null keep_id. Repeated ids count as rows of their own, told apart by their text (where
text and id are equal, the rows have the same result); extra columns are ignored; an empty table gives an empty result.
Hot groups: sizes are pre-aggregated, and members meet their group's row in joins that the runtime splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, identified, materialize, own_id, row_hash, text_bytes, tidied

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1566083941)
CHUNK = 1 << 15
COMPARE_CHARS = 1 << 18
#: Texts of more bytes are hashed in chunks of COMPARE_CHARS characters, on any task.
HUGE = 4 << 20


class Polynomial:
    """Fingerprints under each prime; `combine` appends a chunk's to what stands before it."""

    def __init__(self, chunk: int = CHUNK):
        self.chunk = chunk
        self.powers = []
        for p, b in zip(PRIMES, BASES, strict=True):
            table = [1] * chunk
            for i in range(1, chunk):
                table[i] = table[i - 1] * b % p
            self.powers.append(np.array(table[::-1], np.uint64))

    def of_chunk(self, data: np.ndarray) -> tuple[int, int]:
        wide = data.astype(np.uint64) + np.uint64(1)  # a zero byte counts too
        return tuple(int(np.dot(wide, t[self.chunk - len(data) :])) % p for t, p in zip(self.powers, PRIMES, strict=True))

    @staticmethod
    def combine(left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
        return tuple((x * pow(b, right_length, p) + y) % p for x, y, b, p in zip(left, right, BASES, PRIMES, strict=True))

    def of(self, data: np.ndarray) -> int:
        total = (0, 0)
        for start in range(0, len(data), self.chunk):
            part = data[start : start + self.chunk]
            total = self.combine(total, self.of_chunk(part), len(part)) if start else self.of_chunk(part)
        return total[0] << 31 | total[1]


def _fingerprints(batches):
    poly = Polynomial()
    for batch in batches:
        for part in byte_slices(batch, 2):
            flat, at = text_bytes(part.column(2))
            prints = [poly.of(flat[at[i] : at[i + 1]]) for i in range(len(part))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(prints, pa.int64()), pa.array(np.diff(at), pa.int64()), part.column(3)], ["doc_id", "sha", "print", "n_bytes", "unnamed"])


def _combined(batches):
    """(doc_id, sha, pieces of (chunk, print, n_bytes), unnamed) to the fingerprint of the whole text."""
    for batch in batches:
        prints, sizes = [], []
        for pieces in batch.column(2).to_pylist():
            total, size = (0, 0), 0
            for p in sorted(pieces, key=lambda p: p["chunk"]):
                total = Polynomial.combine(total, (p["print"] >> 31, p["print"] & (1 << 31) - 1), p["n_bytes"])
                size += p["n_bytes"]
            prints.append(total[0] << 31 | total[1])
            sizes.append(size)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), batch.column(3)], ["doc_id", "sha", "print", "n_bytes", "unnamed"])


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _chunks(docs: DataFrame, keys: list[str]) -> DataFrame:
    last = F.greatest(F.lit(0), F.floor((F.length("norm") - 1) / COMPARE_CHARS)).cast("int")
    piece = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("norm", i * COMPARE_CHARS + 1, F.lit(COMPARE_CHARS)))
    return docs.select(*keys, F.posexplode(piece).alias("chunk", "part"))


PRINTS = "doc_id long, sha binary, print long, n_bytes long, unnamed boolean"


def _printed(texts: DataFrame, huge: int) -> DataFrame:
    """A fingerprint per row. Chunks of texts over `huge` bytes are dealt out, hashed apart and combined."""
    sha = F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha")
    small = texts.where(F.col("raw_bytes") <= huge).select("doc_id", sha, "norm", "unnamed").mapInArrow(tidied(_fingerprints), PRINTS)
    row = ["doc_id", "sha", "unnamed"]
    dealt = _chunks(texts.where(F.col("raw_bytes") > huge).select("doc_id", sha, "unnamed", "norm"), row).repartition(*row, "chunk")
    # A row that is repeated as a whole has each of its chunks as often.
    apart = dealt.withColumn("key", F.struct(*row, "chunk")).select("key", F.lit(None).cast("binary").alias("sha"), "part")
    hashed = apart.mapInArrow(tidied(_fingerprints_of_chunks), "doc_id long, sha binary, unnamed boolean, chunk int, print long, n_bytes long")
    chunks = hashed.groupBy(*row, "chunk").agg(F.first("print").alias("print"), F.first("n_bytes").alias("n_bytes"), F.count("*").alias("copies"))
    whole = chunks.groupBy(*row).agg(F.collect_list(F.struct("chunk", "print", "n_bytes")).alias("pieces"), F.max("copies").alias("copies"))
    whole = whole.select(*row, "pieces", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return small.unionByName(whole.select("doc_id", "sha", "pieces", "unnamed").mapInArrow(_combined, PRINTS))


def _fingerprints_of_chunks(batches):
    poly = Polynomial()
    for batch in batches:
        for part in byte_slices(batch, 2):
            flat, at = text_bytes(part.column(2))
            key = part.column(0)
            prints = [poly.of(flat[at[i] : at[i + 1]]) for i in range(len(part))]
            yield pa.RecordBatch.from_arrays([*key.flatten(), pa.array(prints, pa.int64()), pa.array(np.diff(at), pa.int64())], ["doc_id", "sha", "unnamed", "chunk", "print", "n_bytes"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.col(text_col)
    texts = identified(docs, id_col, F.octet_length(F.coalesce(text, F.lit(""))).alias("raw_bytes"), normalised(text).alias("norm"))
    prints = materialize(_printed(texts, huge), "dedup-prints").withColumn("h", row_hash(F.xxhash64("sha"), F.col("unnamed")))
    row = ["doc_id", "h"]  # rows of a repeated id are told apart by their text
    groups = prints.groupBy("print", "n_bytes").agg(F.count("*").alias("size"), F.min(F.struct(*row)).alias("rep"))
    groups = materialize(groups.where("size > 1").select("print", "n_bytes", F.col("rep.doc_id").alias("rep"), F.col("rep.h").alias("rep_h")), "dedup-groups")
    members = materialize(prints.join(groups, ["print", "n_bytes"]).select(*row, "sha", "rep", "rep_h"), "dedup-members")
    # Chunkwise comparison with the group's first row. Texts meet ids by merging, at any size: their tables grow with the input.
    pairs = members.where("doc_id <> rep OR h <> rep_h").select(*row, "rep", "rep_h").distinct()
    near = texts.select("doc_id", "unnamed", "norm").join(members.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    near = materialize(near.select("doc_id", row_hash(F.xxhash64(F.unhex(F.sha2(F.col("norm").cast("binary"), 256))), F.col("unnamed")).alias("h"), "norm"), "dedup-texts")
    theirs = _chunks(near.join(pairs.hint("merge"), row), [*row, "rep", "rep_h"])
    reps = groups.select(F.col("rep").alias("doc_id"), F.col("rep_h").alias("h")).distinct()
    firsts = _chunks(near.join(reps.hint("merge"), row, "left_semi").select(F.col("doc_id").alias("rep"), F.col("h").alias("rep_h"), "norm"), ["rep", "rep_h"])
    firsts = firsts.groupBy("rep", "rep_h", "chunk").agg(F.first("part").alias("first"))
    same = theirs.join(firsts.hint("merge"), ["rep", "rep_h", "chunk"]).groupBy(*row).agg(F.min(F.col("part") == F.col("first")).alias("same"))
    same = materialize(same, "dedup-same")
    nothing = F.lit(b"")
    judged = members.join(same, row, "left").select(*row, "rep", "rep_h", F.when(F.coalesce("same", F.lit(True)), nothing).otherwise(F.col("sha")).alias("other"))
    judged = materialize(judged, "dedup-judged")
    final = materialize(judged.groupBy("rep", "rep_h", "other").agg(F.count("*").alias("group_size"), F.min(own_id(F.col("doc_id"), F.col("h"))).alias("keep_id"), F.min(F.struct(*row)).alias("head")), "dedup-final")
    own = own_id(F.col("doc_id"), F.col("h"))
    stays = F.when(F.col("keep_id").isNotNull(), own.eqNullSafe(F.col("keep_id"))).otherwise(F.struct(*row) == F.col("head"))
    grouped = materialize(judged.join(final, ["rep", "rep_h", "other"]).select(*row, "keep_id", "group_size", stays.alias("kept")).distinct(), "dedup-grouped")
    out = prints.join(grouped, row, "left")
    return out.select(own.alias("doc_id"), F.coalesce("keep_id", own).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce("kept", F.lit(True)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
