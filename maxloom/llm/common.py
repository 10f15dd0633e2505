"""What several operators share: shared-folder tables, byte-bounded batches, word hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass holds; working arrays are some ten times as large.
PASS_BYTES = 2 << 20
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a fresh local one if all runs in one process; else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        where = tempfile.mkdtemp(prefix="maxloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """How many tables this session's operators have written and not dropped."""
    return len(_written)


def drop_tables(spark: SparkSession, since: int = 0, but_last: bool = False) -> int:
    """Delete the tables that this session's operators have written (from the `since`-th on), once their results are stored; how many there were."""
    gone = _written[since : -1 if but_last else None]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written[since:] = _written[since + len(gone) :]
    return len(gone)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identified(rows: DataFrame, id_col: str, *columns: Column) -> DataFrame:
    """(doc_id, unnamed, columns) of all rows. Rows without an id are numbered, in a table of their own, so that each is a row like any other."""
    of = lambda some, key, unnamed: some.select(key.alias("doc_id"), F.lit(unnamed).alias("unnamed"), *columns)
    has = F.col(id_col).isNotNull()
    named = of(rows.where(has), F.col(id_col).cast("long"), False)
    without = rows.where(~has)
    if without.isEmpty():
        return named
    return named.unionByName(materialize(of(without, F.monotonically_increasing_id(), True), "unnamed"))


def row_hash(h: Column, unnamed: Column) -> Column:
    """A hash whose lowest bit tells whether the row has no id: numbers and ids are never taken for one another."""
    return h.bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(unnamed.cast("long"))


def own_id(doc_id: Column, h: Column) -> Column:
    """A row's id as it was given: null where it had none."""
    return F.when(h.bitwiseAND(F.lit(1).cast("long")) == 0, doc_id)


def tidy() -> None:
    """Give freed memory back to the system: workers are kept between tasks, and what they hold counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """A mapInArrow function that tidies up when its task ends."""

    def tidying(batches):
        yield from run(batches)
        tidy()

    return tidying


def byte_slices(batch: pa.RecordBatch, column: int, most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into zero-copy slices whose text is at most `most` bytes (or one row, if that alone is longer)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        pa.default_memory_pool().release_unused()  # what a pass took does not pile up
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column laid end to end, and the row offsets in them (nulls are empty)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset:]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
_BASE = 0x100000001B3


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def word_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and length of each word (run of a-z, 0-9 and non-ASCII bytes) of lower-cased rows, and each row's word offsets."""
    none = np.empty(0, np.int64)
    n = len(flat)
    if not n:
        return np.empty(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    inside = _WORD_BYTE[flat]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    place = np.flatnonzero(inside)
    index = np.searchsorted(place, starts)
    lengths = np.diff(np.append(index, len(place)))
    within = np.arange(len(place)) - np.repeat(index, lengths)
    terms = _LETTER[flat[place]] * _powers(_BASE, int(lengths.max()))[within]
    return mix64(np.add.reduceat(terms, index) + lengths.astype(np.uint64)), starts, lengths, np.searchsorted(starts, offsets)


def shingle_hashes(flat: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each row's word n-grams and the row offsets in them; a row of fewer words has one shingle of all its words."""
    h, _, _, at = word_spans(flat, offsets)
    return shingles_of(h, at, words)


def shingles_of(h: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from the hashes of the rows' words."""
    counts = np.diff(at)
    grams = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    out_at = np.concatenate([[0], np.cumsum(grams)])
    if not out_at[-1]:
        return np.empty(0, np.uint64), out_at
    begin = np.repeat(at[:-1], grams) + np.arange(out_at[-1]) - np.repeat(out_at[:-1], grams)
    last = np.repeat(at[1:], grams)
    total = np.zeros(len(begin), np.uint64)
    for k in range(words):
        here = begin + k
        ok = here < last
        total += np.where(ok, h[np.minimum(here, len(h) - 1)], np.uint64(0)) * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1)
    return mix64(total), out_at


def row_sets(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values made distinct and sorted, and the new row offsets."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], np.concatenate([[0], np.cumsum(np.bincount(r[keep], minlength=len(at) - 1))]).astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in `edges` (a, b): root is the smallest id of its connected component.

    Rounds of large-star and small-star, each ending in a table in the shared folder. Every step is a
    partially aggregated minimum and an equi-join that the runtime can split on a hot key; no task ever holds one id's neighbours.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc-edges")
    while True:  # each round at least halves the longest chain, so it ends
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-low")
        # Large-star: every larger neighbour of a moves to the least id near a.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "cc-large")
        # Small-star: a and its smaller neighbours move to the least of them.
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "cc-edges")
        # Stars: no id is both a leaf and a centre, and every leaf has one centre.
        tangled = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a").unionByName(after.select("a").join(after.select(F.col("b").alias("a")), "a", "left_semi"))
        e = after
        if tangled.isEmpty():
            break
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def whole_groups(batches, keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by `keys`: tables of whole groups, and the row offsets of the groups in each."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        starts = _group_starts(table, keys)
        if starts[-1]:
            yield table.slice(0, int(starts[-1])).combine_chunks(), starts
        held = table.slice(int(starts[-1]))
    if held is not None:
        yield held.combine_chunks(), np.append(_group_starts(held, keys), held.num_rows)


def _group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index reachable from each of n items over links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def block_pairs(df: DataFrame, size, rows: int, key: str) -> DataFrame:
    """Deal the members of groups of `size` rows into blocks of about `rows`, and send each to every pair of blocks (i <= j) it is in.

    Any two members meet in exactly one pair of blocks, as `side` 0 (of block i) and 1 (of block j), or both 0 where i = j.
    """
    blocks = F.greatest(F.lit(1), F.ceil(size / rows)).cast("int")
    own = F.pmod(F.xxhash64(key), F.col("__blocks")).cast("int")
    df = df.withColumn("__blocks", blocks).withColumn("__own", own)
    df = df.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return df.select(*[c for c in df.columns if not c.startswith("__")], F.least("__own", "__other").alias("i"), F.greatest("__own", "__other").alias("j"), (F.col("__own") > F.col("__other")).cast("int").alias("side"))
