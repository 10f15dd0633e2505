"""N-gram Jaccard join by a MinHash LSH forest, then exact verification.

Documents whose sets of word 5-grams are equal are one text with so many copies. Each text has a label of MAX_DEPTH MinHash values
in each of TREES trees; a tree is the prefix trie of its labels, kept as a sorted table of the labels that share at least the shortest
prefix that can be needed. Texts first meet under their whole labels. The matched prefixes are then shortened by one value at
a time, and each time only pairs that share no longer prefix in any tree are new. After each step, the similarities of the pairs found
(by whole signatures) tell how many pairs like them the tries miss at this depth; shortening stops once the recall on what is
there reaches the target, or at the depth where a single pair at the threshold would be met with that probability.

Pairs whose signatures agree enough make connected candidates; in these, pairs that share a prefix are verified exactly, by
intersecting shingle sets. Counts of links and classes come out without a row per pair. Groups of any size are dealt into
blocks of bounded rows and bytes that meet block by block, so no task holds a whole group; only a group's true size, squared over the block size, sets the work.

Words are runs of a-z, 0-9 and non-ASCII characters of the lower-cased text. A text of one to four words has one shingle, all its words; a text
without words (null, empty) links with nothing. Rows with a null id are left out; repeated ids keep a row each; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, byte_slices, components, forest, materialize, mix64, row_sets, shingle_hashes, text_bytes, tidied, whole_groups

WORDS = 5
SIMILARITY = 0.8
TREES = 20
MAX_DEPTH = 8
TARGET_RECALL = 0.9999
BLOCK_ROWS = 256
#: Rows of a block of a trie's node, where signatures alone are compared.
NODE_ROWS = 1024
#: Shingles that a block is dealt, on average, at most.
BLOCK_SHINGLES = 1 << 20


def met_with(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that a pair of this similarity shares a prefix of `depth` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(similarity: float, recall: float, trees: int = TREES) -> int:
    """The longest prefix at which a pair of this similarity shares one in some trie with probability `recall`."""
    depth = MAX_DEPTH
    while depth > 1 and met_with(similarity, depth, trees) < recall:
        depth -= 1
    return depth


def missed_share(found: Mapping[int, int], similarity: float, depth: int, values: int = TREES * MAX_DEPTH) -> float:
    """Pairs missed at this depth over links found, told from the pairs found (by agreeing values) and one more at the threshold."""
    links, missed = 1.0, 1 / met_with(similarity, depth) - 1
    for agreeing, n in found.items():
        s = agreeing / values
        links += n * (s >= similarity)
        missed += n * (1 / met_with(max(s, similarity), depth) - 1)
    return missed / links


def _least_agreeing(similarity: float, values: int) -> int:
    """Signature values that a pair at the threshold agrees in, less four standard deviations."""
    return int(values * similarity - 4 * (values * similarity * (1 - similarity)) ** 0.5)


def _numbers(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def text_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit keys of the rows' shingle sets; equal sets have equal keys."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values * np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)])
    return mix64(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))


def _signatures(words: int):
    """doc_id, hash of the text, key and size of the shingle set, and the signature: all trees' labels, a byte a value."""
    n = TREES * MAX_DEPTH
    factors, adds = _numbers(n, 1), _numbers(n, 2)

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 1):
                flat, offsets = text_bytes(part.column(1))
                values, at = row_sets(*shingle_hashes(flat, offsets, words))
                rows = np.flatnonzero(np.diff(at))
                low = np.zeros((len(part), n), np.uint64)
                if len(rows):
                    for i, (f, a) in enumerate(zip(factors, adds, strict=True)):
                        low[rows, i] = np.minimum.reduceat(values * f + a, at[rows])
                sig = (mix64(low) >> np.uint64(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), _as_long(text_keys(values, at)), pa.array(np.diff(at), pa.int32()), pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), len(part), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())], ["doc_id", "h", "k", "n", "sig"])

    return run


def _pairs(start: int, stop: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that a group of block_pairs compares."""
    s = side[start:stop]
    if s.any():
        a, b = np.flatnonzero(s == 0), np.flatnonzero(s == 1)
        return start + np.repeat(a, len(b)), start + np.tile(b, len(a))
    a, b = np.triu_indices(stop - start, 1)
    return start + a, start + b


def _labels(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and their labels as numbers whose order is that of the trie."""
    sig = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, TREES * MAX_DEPTH)
    return sig, sig.view(">u8").astype(np.uint64)


def _share(x: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
    """Whether labels share a prefix of `depth` values, element by element."""
    return (x ^ y) >> np.uint64(64 - 8 * depth) == 0


ALIKE = "a long, b long, agreeing int, n long"


def _alike(similarity: float, depth: int):
    """Of nodes of the tries at `depth`: links between texts whose signatures agree enough, as each text's least reachable one (a, b); pairs met here first, by agreeing values."""

    def run(batches):
        for table, at in whole_groups(batches, ["tree", "prefix", "i", "j"]):
            k, side, tree = (table.column(c).to_numpy() for c in ("k", "side", "tree"))
            sig, labels = _labels(table.column("sig"))
            least = _least_agreeing(similarity, sig.shape[1])
            left, right, counts = [], [], np.zeros(sig.shape[1] + 1, np.int64)
            for start, stop in zip(at[:-1], at[1:], strict=True):
                x, y = _pairs(int(start), int(stop), side)
                t = int(tree[start])
                for cut in range(0, len(x), 50_000):
                    a, b = x[cut : cut + 50_000], y[cut : cut + 50_000]
                    if depth < MAX_DEPTH:
                        new = ~_share(labels[a, t], labels[b, t], depth + 1)
                        a, b = a[new], b[new]
                        new = ~_share(labels[a], labels[b], depth + 1).any(1)
                        a, b = a[new], b[new]
                    new = ~_share(labels[a, :t], labels[b, :t], depth).any(1)
                    a, b = a[new], b[new]
                    agreeing = (sig[a] == sig[b]).sum(1)
                    ok = agreeing >= least
                    left.append(a[ok])
                    right.append(b[ok])
                    counts += np.bincount(agreeing[ok], minlength=len(counts))
            left, right = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (left, right))
            root = forest(left, right, len(k))
            linked = np.flatnonzero(root != np.arange(len(k)))
            some = np.flatnonzero(counts)
            none = [None]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*k[linked].tolist(), *none * len(some)], pa.int64()),
                    pa.array([*k[root[linked]].tolist(), *none * len(some)], pa.int64()),
                    pa.array([*none * len(linked), *some.tolist()], pa.int32()),
                    pa.array([*none * len(linked), *counts[some].tolist()], pa.int64()),
                ],
                ["a", "b", "agreeing", "n"],
            )

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 0):
                values, at = row_sets(*shingle_hashes(*text_bytes(part.column(0)), words))
                raw = values.tobytes()
                yield pa.RecordBatch.from_arrays([_as_long(text_keys(values, at)), pa.array([raw[8 * s : 8 * e] for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["k", "shingles"])

    return run


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: shingles that two sets or more hold become columns of 0 and 1, multiplied in slices."""
    n = len(sets)
    values = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], np.cumsum(np.concatenate([[True], column[shared][1:] != column[shared][:-1]])) - 1 if shared.any() else column[shared]
    out = np.zeros((n, n), np.int64)
    width = 4096
    bounds = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + 1 + width, width))
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        if e > s:
            block = np.zeros((n, width), np.float32)
            block[row[s:e], column[s:e] % width] = 1
            out += (block @ block.T).astype(np.int64)  # sums of at most 4096 ones are exact
    return out


def _verify(similarity: float, depth: int):
    """Of candidate groups: each text's links (other documents) in this pair of blocks, and its least reachable text."""
    ratio = Fraction(similarity).limit_denominator(10**6)
    over, under = ratio.numerator, ratio.denominator

    def run(batches):
        for table, at in whole_groups(batches, ["root", "i", "j"]):
            k, side, copies = (table.column(c).to_numpy() for c in ("k", "side", "copies"))
            _, labels = _labels(table.column("sig"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
            size = np.array([len(s) for s in sets], np.int64)
            links, low = np.zeros(len(k), np.int64), k.copy()
            for start, stop in zip(at[:-1], at[1:], strict=True):
                if stop - start < 2:
                    continue
                x, y = _pairs(int(start), int(stop), side)
                met = np.concatenate([_share(labels[x[c : c + 50_000]], labels[y[c : c + 50_000]], depth).any(1) for c in range(0, len(x), 50_000)]) if len(x) else np.empty(0, bool)
                x, y = x[met], y[met]
                if not len(x):
                    continue
                if 20 * len(x) < (stop - start) ** 2:  # few pairs: one by one
                    both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x, y, strict=True)])
                else:
                    both = _intersections(sets[start:stop])[x - start, y - start]
                alike = under * both >= over * (size[x] + size[y] - both)
                x, y = x[alike] - start, y[alike] - start
                own = slice(start, stop)
                links[own] += np.bincount(x, copies[own][y], stop - start).astype(np.int64) + np.bincount(y, copies[own][x], stop - start).astype(np.int64)
                low[own] = k[own][forest(x, y, stop - start)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(links), pa.array(low)], ["k", "links", "low"])

    return run


def _node(depth: int):
    return F.substring("label", 1, depth).alias("prefix")


def _tries(one: DataFrame, least: int) -> DataFrame:
    """(tree, label, k), sorted, of the labels that share a prefix of `least` values with another of their tree."""
    label = lambda t: F.substr(F.col("sig"), t * MAX_DEPTH + 1, F.lit(MAX_DEPTH))
    places = one.select("k", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), label)).alias("tree", "label"))
    places = places.select("k", "tree", "label", F.xxhash64("tree", _node(least)).alias("node"))
    shared = places.groupBy("node").agg(F.count("*").alias("size")).where("size > 1").select("node")
    return places.join(shared.hint("merge"), "node").select("tree", "label", "k").sortWithinPartitions("tree", "label")


def candidates(one: DataFrame, similarity: float, recall: float) -> tuple[DataFrame, int]:
    """Links (a, b) between texts (k, sig) that connect all candidates, and the depth at which the target recall was reached."""
    least = depth_for(similarity, recall)
    tries = materialize(_tries(one, least), "join-tries")
    levels, found = [], dict[int, int]()
    for depth in range(MAX_DEPTH, least - 1, -1):
        places = tries.select("tree", _node(depth), F.xxhash64(F.substring("label", 1, depth + 1)).alias("child"), "k")
        nodes = places.groupBy("tree", "prefix").agg(F.count("*").alias("size"), F.min("child").alias("first"), F.max("child").alias("last")).where("size > 1")
        if depth < MAX_DEPTH:  # a node with one child holds no new pair
            nodes = nodes.where("first <> last")
        met = places.join(nodes.select("tree", "prefix", "size"), ["tree", "prefix"]).select("tree", "prefix", "k", "size").join(one, "k")
        dealt = block_pairs(met, F.col("size"), NODE_ROWS, "k").repartition("tree", "prefix", "i", "j").sortWithinPartitions("tree", "prefix", "i", "j")
        levels.append(materialize(dealt.select("tree", "prefix", "i", "j", "side", "k", "sig").mapInArrow(tidied(_alike(similarity, depth)), ALIKE), "join-level"))
        for r in levels[-1].where("a IS NULL").groupBy("agreeing").agg(F.sum("n").alias("n")).collect():
            found[r["agreeing"]] = found.get(r["agreeing"], 0) + r["n"]
        if missed_share(found, similarity, depth) <= 1 - recall:
            break
    return functools.reduce(DataFrame.unionByName, levels).where("a IS NOT NULL").select("a", "b"), depth


def _lower(text):
    return F.lower(F.coalesce(text, F.lit("")))


def _classed(docs: DataFrame, id_col: str, text_col: str, similarity: float, recall: float, words: int) -> DataFrame:
    """One row per document: doc_id, h (hash of the lower-cased text), class_id, n_links, n_shingles."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), _lower(F.col(text_col)).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    signed = materialize(texts.mapInArrow(tidied(_signatures(words)), "doc_id long, h long, k long, n int, sig binary"), "join-signed")
    reps = materialize(signed.where("n > 0").groupBy("k").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "join-reps")
    # One signature per text: copies of a rep's id and key are equal in all else.
    one = materialize(signed.join(reps.select("k", "doc_id"), ["k", "doc_id"]).select("k", "sig").dropDuplicates(["k"]), "join-texts")
    edges, depth = candidates(one, similarity, recall)
    found = materialize(components(edges).withColumnRenamed("id", "k"), "join-candidates")
    found = materialize(found.join(reps, "k"), "join-found")
    # Blocks of at most so many rows and, on average, so many shingles.
    blocks = F.greatest(F.count("*"), F.sum("n") * BLOCK_ROWS / BLOCK_SHINGLES).alias("size")
    sizes = materialize(found.groupBy("root").agg(blocks), "join-sizes")
    found = materialize(found.join(sizes, "root"), "join-sized")
    wanted = texts.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    sets = materialize(wanted.mapInArrow(tidied(_sets(words)), "k long, shingles binary").dropDuplicates(["k"]).join(found, "k").join(one, "k"), "join-sets")
    dealt = block_pairs(sets, F.col("size"), BLOCK_ROWS, "k").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    checked = materialize(dealt.select("root", "i", "j", "side", "k", "copies", "sig", "shingles").mapInArrow(tidied(_verify(similarity, depth)), "k long, links long, low long"), "join-checked")
    links = checked.groupBy("k").agg(F.sum("links").alias("links"))
    classes = components(checked.select(F.col("k").alias("a"), F.col("low").alias("b")).where("a <> b")).withColumnRenamed("id", "k")
    labelled = materialize(reps.join(classes, "k", "left").join(links, "k", "left").select("k", "doc_id", "copies", F.coalesce("root", "k").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "join-labelled")
    ids = materialize(labelled.groupBy("root").agg(F.min("doc_id").alias("class_id")), "join-classes")
    labelled = materialize(labelled.join(ids, "root").select("k", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "join-result")
    out = signed.select("doc_id", "h", "k", "n").join(labelled, "k", "left")
    return out.select("doc_id", "h", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("n") > 0, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.col("n").cast("long").alias("n_shingles"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = TARGET_RECALL, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id linked, over any number of links), n_links (other documents linked directly), n_shingles."""
    return _classed(docs, id_col, text_col, similarity, recall, words).drop("h")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, recall: float = TARGET_RECALL, words: int = WORDS) -> DataFrame:
    """`docs` less every document that is not the least of its class, judged by id and text; rows with a null id stay."""
    gone = _classed(docs.select("doc_id", "text"), "doc_id", "text", similarity, recall, words).where("doc_id <> class_id").select(F.col("doc_id").alias("gone_id"), "h").distinct()
    gone = materialize(gone, "join-gone")
    return docs.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.xxhash64(_lower(F.col("text"))) == F.col("h")), "left_anti")
