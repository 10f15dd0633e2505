"""Embedding near-dedup by a random-projection tree forest.

Trees are fitted on a bounded sample (SAMPLE vectors, those of least hash): all nodes of a level of a tree split by one random
projection, each at its own median of it. Every vector then goes down every tree, to both sides where it is within SPILL times
the node's spread (its standard deviation, which shrinks as the number of components grows) of the cut, and vectors of one label are
compared inside leaves, by cosine in double precision. Leaves hold numbers; vectors are joined to them only where leaves are
compared. A pair is counted in the first leaf that it shares, so links are counted without a row per pair, and links join into
components.

Recall is a matter of trees and spill: a pair is missed only if every tree parts it by more than the spill; the defaults are
measured against brute force in the tests. Equal vectors of a label are one vector with copies. Leaves of any size are dealt into
blocks that meet pair by pair, so a hot label or leaf is spread over tasks and nothing is capped. Trees are as deep as leaves of
LEAF_ROWS need, MAX_DEPTH at most; beyond it leaves grow.

Vectors that are null, empty, zero or hold null or non-finite components, and rows of null label, link with nothing; vectors of
different length are not compared. Vectors with a null id link like others; a component without any id has a null component_id, and its
vectors are kept. Repeated ids keep a row each; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import block_pairs, components, forest, materialize, tidied, whole_groups

COSINE = 0.93
TREES = 6
#: Half the width of the overlap at a cut, in standard deviations of the node's projections.
SPILL = 0.1
SAMPLE = 100_000
LEAF_ROWS = 256
MAX_DEPTH = 16
#: Fewer sample vectors than this tell no spread of a node; it takes its parent's.
LEAST_SAMPLE = 8
BLOCK_ROWS = 512
SEED = 3


@dataclass
class Forest:
    """Trees in level order; leaves are numbered from 0 over all trees."""

    directions: np.ndarray  # trees, levels, components
    cuts: np.ndarray  # trees, nodes
    spread: np.ndarray  # trees, nodes
    depth: int

    def leaves(self, x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their leaves, a row once for each leaf it reaches."""
        wide = min(x.shape[1], self.directions.shape[2])
        rows, found = [], []
        for tree in range(len(self.cuts)):
            along = x[:, :wide] @ self.directions[tree, :, :wide].T
            at, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.depth):
                over, near = along[at, level] - self.cuts[tree, node], spill * self.spread[tree, node]
                left, right = over <= near, over >= -near
                at, node = np.concatenate([at[left], at[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            rows.append(at)
            found.append(node - (2**self.depth - 1) + tree * 2**self.depth)
        return np.concatenate(rows), np.concatenate(found)


def grow(sample: np.ndarray, largest: int, trees: int = TREES, seed: int = SEED) -> Forest:
    """Trees deep enough that the largest label's leaves hold about LEAF_ROWS; nodes that no sample vector reaches cut like their parents."""
    depth = min(MAX_DEPTH, math.ceil(math.log2(max(1, largest / LEAF_ROWS))))
    nodes = max(1, 2**depth - 1)
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((trees, max(1, depth), sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    cuts, spread = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for tree in range(trees):
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            along = sample @ directions[tree, level]
            order = np.lexsort((along, node))
            sorted_ = along[order]
            ones = np.arange(2**level - 1, 2 ** (level + 1) - 1)
            at = np.searchsorted(node[order], [*ones, ones[-1] + 1])
            size = np.diff(at)
            some = size > 0
            middle = np.full(len(ones), np.median(along) if len(along) else 0.0)
            middle[some] = sorted_[(at[:-1] + at[1:])[some] // 2]
            total, square = np.concatenate([[0], np.cumsum(sorted_)]), np.concatenate([[0], np.cumsum(sorted_**2)])
            n = np.maximum(size, 1)
            own = np.sqrt(np.maximum((square[at[1:]] - square[at[:-1]]) / n - ((total[at[1:]] - total[at[:-1]]) / n) ** 2, 0))
            parent = spread[tree, (ones - 1) // 2] if level else np.full(1, along.std() if len(along) else 0.0)
            cuts[tree, ones], spread[tree, ones] = middle, np.where(size >= LEAST_SAMPLE, own, parent)
            node = 2 * node + 1 + (along > cuts[tree, node])
    return Forest(directions, cuts, spread, depth)


def _unit(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """By vector length: rows and their unit vectors in double precision."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy().astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        x = flat[starts[rows][:, None] + np.arange(size)]
        out.append((rows, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def _place(trees: Forest, spill: float):
    """(k, g, vector) to a row per leaf, each with all leaves of the vector."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                for rows, x in _unit(part.column(2)):
                    at, leaf = trees.leaves(x, spill)
                    order = np.lexsort((leaf, at))
                    at, leaf = at[order], leaf[order]
                    counts = np.bincount(at, minlength=len(rows))
                    ends = np.cumsum(counts)
                    own = part.select([0, 1]).take(pa.array(rows[at]))
                    lists = [leaf[e - c : e].astype("<i4").tobytes() for e, c in zip(ends, counts, strict=True)]
                    every = pa.array(lists, pa.binary()).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(leaf, pa.int32()), every], ["k", "g", "leaf", "leaves"])

    return run


PLACED = "k long, g long, leaf int, leaves binary"


def _compare(cosine: float):
    def run(batches):
        for table, at in whole_groups(batches, ["g", "leaf", "i", "j"]):
            k, side, copies, leaf = (table.column(c).to_numpy() for c in ("k", "side", "copies", "leaf"))
            lists = [np.frombuffer(x.as_buffer(), "<i4") for x in table.column("leaves")]
            wide = max(map(len, lists))
            leaves = np.stack([np.pad(x, (0, wide - len(x)), constant_values=-1) for x in lists])
            vectors = table.column("v").combine_chunks()
            links, low = np.zeros(len(k), np.int64), k.copy()
            for start, stop in zip(at[:-1], at[1:], strict=True):
                if stop - start < 2:
                    continue
                ((_, x),) = _unit(vectors.slice(start, stop - start))  # a group has one vector length
                s = side[start:stop]
                near = x @ x.T >= cosine
                near &= s[:, None] != s if s.any() else ~np.eye(len(s), dtype=bool)
                a, b = np.nonzero(np.triu(near))
                if not len(a):
                    continue
                # Counted here only if no earlier leaf holds both.
                mine, theirs = leaves[start + a], leaves[start + b]
                both = (mine[:, :, None] == theirs[:, None, :]).any(2) & (mine >= 0)
                first = mine[np.arange(len(a)), both.argmax(1)] == leaf[start]
                a, b = a[first], b[first]
                links[start:stop] += np.bincount(a, copies[start + b], stop - start).astype(np.int64) + np.bincount(b, copies[start + a], stop - start).astype(np.int64)
                low[start:stop] = k[start:stop][forest(a, b, stop - start)]
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(k[some]), pa.array(links[some]), pa.array(low[some])], ["k", "links", "low"])

    return run


def embed_dedup(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, spill: float = SPILL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    element = vectors.schema[vector_col].dataType.elementType
    kind = "array<float>" if isinstance(element, T.FloatType) else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(kind).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    rows = rows.select("vec_id", F.when(valid, F.xxhash64("label", "v")).alias("k"), "label", "v")
    one = rows.where("k IS NOT NULL").groupBy("k", "label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"))
    one = materialize(one.select("k", F.xxhash64("label", F.size("v")).alias("g"), "v", "copies", "vec_id"), "embed-vectors")
    largest = one.groupBy("g").count().agg(F.max("count")).first()[0]
    if largest is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = [x for _, x in _unit(one.select("k", "v").orderBy(F.xxhash64("k", F.lit(SEED))).limit(SAMPLE).toArrow().column("v").combine_chunks())]
    widest = max(x.shape[1] for x in sample)
    fitted = grow(np.concatenate([np.pad(x, ((0, 0), (0, widest - x.shape[1]))) for x in sample]), largest, trees)
    placed = materialize(one.select("k", "g", "v").mapInArrow(tidied(_place(fitted, spill)), PLACED), "embed-placed")
    sizes = materialize(placed.groupBy("g", "leaf").agg(F.count("*").alias("size")).where("size > 1"), "embed-leaves")
    met = placed.join(sizes, ["g", "leaf"]).join(one.select("k", "copies", "v"), "k")
    dealt = block_pairs(met, F.col("size"), BLOCK_ROWS, "k").repartition("g", "leaf", "i", "j").sortWithinPartitions("g", "leaf", "i", "j")
    found = materialize(dealt.select("g", "leaf", "i", "j", "side", "k", "copies", "leaves", "v").mapInArrow(tidied(_compare(cosine)), "k long, links long, low long"), "embed-links")
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("k").alias("a"), F.col("low").alias("b"))).withColumnRenamed("id", "k")
    labelled = materialize(one.join(classes, "k", "left").join(links, "k", "left").select("k", "vec_id", "copies", F.coalesce("root", "k").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "embed-labelled")
    ids = materialize(labelled.groupBy("root").agg(F.min("vec_id").alias("component_id")), "embed-components")
    labelled = materialize(labelled.join(ids, "root").select("k", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "embed-result")
    out = rows.select("vec_id", "k").join(labelled, "k", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"))
