"""Late-interaction retrieval: token scores, MaxSim, partial k-nearest-token runs, two-stage and clustered search.

Pages are token rows (doc_id, page_idx, token_idx, emb), queries token rows (qid, q_idx, emb). The query side is what a
request brings; it is collected in blocks of at most QUERY_TOKENS rows, each block multiplied with page batches as matrices, so
corpus vectors are read once per block and never shuffled. Where `wanted` names the pages of each query, a page's vectors meet the
tokens of its own queries alone, and other pages none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ranked

QUERY_TOKENS = 65_536
OUT_ROWS = 65_536
PRODUCTS = 4_000_000
PAGE = ["doc_id", "page_idx"]


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _query_blocks(queries: DataFrame, columns: list[str]) -> Iterator[pa.Table]:
    """The query tokens in blocks; more than a block's worth is dealt by hash of qid, a scan of the pages for each."""
    n = queries.count()
    blocks = max(1, -(-n // QUERY_TOKENS))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        yield part.select(*columns, "emb").orderBy("qid", "q_idx").toArrow().combine_chunks()


def _schema(df: DataFrame, columns: list[str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [f"`{c}` {kinds[c]}" for c in columns]


def _wanted(pages: DataFrame, columns: list[str], wanted: DataFrame | None) -> DataFrame:
    """The page tokens, or those of wanted pages (qid, doc_id, page_idx) alone, with the queries that want them last."""
    if wanted is None:
        return pages.select(*columns, "emb")
    return pages.join(wanted.groupBy(*PAGE).agg(F.collect_set("qid").alias("qids")), PAGE).select(*columns, "emb", "qids")


def _places(block: pa.Table) -> dict:
    """Where a query's tokens stand in a block."""
    qids = block.column("qid").to_pylist()
    cuts = [i for i, q in enumerate(qids) if not i or q != qids[i - 1]]
    return {qids[i]: np.arange(i, j) for i, j in pairwise([*cuts, len(qids)])}


def _by_page(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The order of a batch's rows (doc_id, page_idx, …) by page, and where pages begin in it."""
    codes = [pc.dictionary_encode(batch.column(i), null_encoding="encode").indices.to_numpy() for i in (0, 1)]
    order = np.lexsort(codes)
    d, p = (c[order] for c in codes)
    return order, np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1])])) if len(order) else order


def _meetings(batch: pa.RecordBatch, at: int, vectors: np.ndarray, places: dict | None, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, query tokens, their products) of a batch with vectors in column `at`: all with all, or each page with its own queries."""
    x = _matrix(batch.column(at))
    if places is None:
        step = max(1, most // max(1, len(vectors)))
        for low in range(0, len(x), step):
            yield np.arange(low, min(low + step, len(x))), np.arange(len(vectors)), x[low : low + step] @ vectors.T
        return
    order, head = _by_page(batch)
    for low, high in pairwise([*head, len(order)]):
        rows = order[low:high]
        own = [places[q] for q in batch.column(at + 1)[int(rows[0])].as_py() if q in places]
        tokens = np.concatenate(own) if own else np.empty(0, int)
        step = max(1, most // len(rows))
        for cut in range(0, len(tokens), step):
            some = tokens[cut : cut + step]
            yield rows, some, x[rows] @ vectors[some].T


def token_scores(pages: DataFrame, queries: DataFrame, page_columns: list[str] = (), query_columns: list[str] = (), wanted: DataFrame | None = None) -> DataFrame:
    """The score table: a row per query token and page token, with s = their dot product and the carried columns."""
    own = [*PAGE, "token_idx", *page_columns]
    theirs = ["qid", "q_idx", *query_columns]
    schema = ", ".join([*_schema(queries, theirs), *_schema(pages, own), "s double"])

    def kernel(block: pa.Table):
        held = [block.column(c).combine_chunks() for c in theirs]
        vectors = _matrix(block.column("emb").combine_chunks())
        places = None if wanted is None else _places(block)

        def run(batches):
            for batch in batches:
                for rows, tokens, s in _meetings(batch, len(own), vectors, places, OUT_ROWS):
                    left, right = pa.array(np.tile(tokens, len(rows))), pa.array(np.repeat(rows, len(tokens)))
                    yield pa.RecordBatch.from_arrays([*(h.take(left) for h in held), *(batch.column(i).take(right) for i in range(len(own))), pa.array(s.ravel())], [*theirs, *own, "s"])

        return run

    some = _wanted(pages, own, wanted)
    parts = [some.mapInArrow(kernel(b), schema) for b in _query_blocks(queries, theirs) if b.num_rows]
    return reduce(DataFrame.unionByName, parts) if parts else pages.sparkSession.createDataFrame([], schema)


def token_maxima(pages: DataFrame, queries: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Best score of each query token on each page (qid, q_idx, doc_id, page_idx, best); batches are reduced before they are shuffled."""
    schema = ", ".join([*_schema(queries, ["qid", "q_idx"]), *_schema(pages, PAGE), "best double"])

    def kernel(block: pa.Table):
        ids = [block.column(c).combine_chunks() for c in ("qid", "q_idx")]
        vectors = _matrix(block.column("emb").combine_chunks())
        places = None if wanted is None else _places(block)

        def run(batches):
            for batch in batches:
                for rows, tokens, s in _meetings(batch, 2, vectors, places, PRODUCTS):
                    order, head = _by_page(batch.select([0, 1]).take(pa.array(rows)))
                    best = np.maximum.reduceat(s[order], head, axis=0)
                    left, right = pa.array(np.tile(tokens, len(head))), pa.array(np.repeat(rows[order[head]], len(tokens)))
                    yield pa.RecordBatch.from_arrays([*(c.take(left) for c in ids), batch.column(0).take(right), batch.column(1).take(right), pa.array(best.ravel())], ["qid", "q_idx", *PAGE, "best"])

        return run

    some = _wanted(pages, PAGE, wanted)
    parts = [some.mapInArrow(kernel(b), schema) for b in _query_blocks(queries, ["qid", "q_idx"]) if b.num_rows]
    best = reduce(DataFrame.unionByName, parts) if parts else pages.sparkSession.createDataFrame([], schema)
    return best.groupBy("qid", "q_idx", *PAGE).agg(F.max("best").alias("best"))


def maxsim(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact page scores (qid, doc_id, page_idx, score): per query token the best page token, summed."""
    return token_maxima(pages, queries).groupBy("qid", *PAGE).agg(F.sum("best").alias("score"))


def maxsim_of(scores: DataFrame) -> DataFrame:
    """The same over a (filtered) score table."""
    return scores.groupBy("qid", "q_idx", *PAGE).agg(F.max("s").alias("best")).groupBy("qid", *PAGE).agg(F.sum("best").alias("score"))


def rank_pages(scored: DataFrame, *more) -> DataFrame:
    return scored.withColumn("rank", ranked(["qid"], F.desc("score"), *more, "doc_id", "page_idx"))


def top_pages(scored: DataFrame, k: int) -> DataFrame:
    """The k best pages of each query over all documents."""
    return rank_pages(scored).where(F.col("rank") <= k)


def top_page_per_doc(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Each document's best page (the first if equal), then the k best of them."""
    best = scored.groupBy("qid", "doc_id").agg(F.max(F.struct("score", (-F.col("page_idx")).alias("p"))).alias("b"))
    out = rank_pages(best.select("qid", "doc_id", (-F.col("b.p")).alias("page_idx"), "b.score"))
    return out if k is None else out.where(F.col("rank") <= k)


def nearest_tokens(scores: DataFrame, k: int) -> DataFrame:
    """Each query token's k nearest page tokens, with their place `near`."""
    return scores.withColumn("near", ranked(["qid", "q_idx"], F.desc("s"), *PAGE, "token_idx")).where(F.col("near") <= k)


def search_tokens(pages: DataFrame, queries: DataFrame, k: int, query_columns: list[str] = ()) -> DataFrame:
    """Each query token's k nearest page tokens straight from the vectors, with `near`: a batch hands on its own k best (and ties with the last) alone."""
    own, theirs = [*PAGE, "token_idx"], ["qid", "q_idx", *query_columns]
    schema = ", ".join([*_schema(queries, theirs), *_schema(pages, own), "s double"])

    def kernel(block: pa.Table):
        held = [block.column(c).combine_chunks() for c in theirs]
        vectors = _matrix(block.column("emb").combine_chunks())

        def run(batches):
            for batch in batches:
                step = max(k, 4_000_000 // max(1, len(vectors)))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    s = _matrix(part.column(len(own))) @ vectors.T
                    keep = s >= np.partition(s, len(s) - k, axis=0)[len(s) - k] if len(s) > k else np.ones_like(s, bool)
                    rows, tokens = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([*(h.take(pa.array(tokens)) for h in held), *(part.column(i).take(pa.array(rows)) for i in range(len(own))), pa.array(s[rows, tokens])], [*theirs, *own, "s"])

        return run

    parts = [pages.select(*own, "emb").mapInArrow(kernel(b), schema) for b in _query_blocks(queries, theirs) if b.num_rows]
    some = reduce(DataFrame.unionByName, parts) if parts else pages.sparkSession.createDataFrame([], schema)
    return nearest_tokens(some, k)


def knn_pages(near: DataFrame, k_page: int | None = None) -> DataFrame:
    """Page scores from nearest tokens alone; inactive tokens search but add nothing."""
    out = maxsim_of(near.where("active"))
    return out if k_page is None else top_pages(out, k_page).drop("rank")


def rescored(pages: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Exact scores of each query's own candidate pages (qid, doc_id, page_idx); no other page or query is multiplied."""
    return token_maxima(pages, queries, candidates).groupBy("qid", *PAGE).agg(F.sum("best").alias("score"))


def two_stage(pages: DataFrame, queries: DataFrame, k_token: int, candidates: int, k: int) -> DataFrame:
    """Candidates from the nearest tokens of all query tokens, rescored exactly over the active ones."""
    if candidates < k:
        raise ValueError("fewer candidates than results")
    first = top_pages(maxsim_of(search_tokens(pages, queries, k_token)), candidates)
    return top_pages(rescored(pages, queries.where("active"), first), k)


def require_active(queries: DataFrame) -> DataFrame:
    """Fails on a query without an active token, else returns the queries."""
    empty = queries.groupBy("qid").agg(F.max(F.col("active").cast("int")).alias("any")).where("any = 0").select("qid").limit(20).collect()
    if empty:
        raise ValueError(f"queries without active tokens: {[r[0] for r in empty]}")
    return queries


def contributions(scores: DataFrame) -> DataFrame:
    """Per page and active query token: the winning page token (least index if equal) and its score."""
    best = scores.where("active").groupBy("qid", "q_idx", *PAGE).agg(F.max(F.struct("s", (-F.col("token_idx")).alias("t"))).alias("b"))
    return best.select("qid", "q_idx", *PAGE, (-F.col("b.t")).alias("token_idx"), F.col("b.s").alias("s"))


def mean_vectors(tokens: DataFrame, keys: list[str], weight=None) -> DataFrame:
    """Elementwise (weighted) mean of `emb` per key; the denominator is at least 1e-6."""
    w = F.lit(1.0) if weight is None else weight
    parts = tokens.select(*keys, w.alias("w"), F.posexplode("emb").alias("at", "x")).groupBy(*keys, "at")
    parts = parts.agg((F.sum(F.col("x") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("emb"))


def cluster_tokens(pages: DataFrame, centroids: int, sample: int = 20_000, rounds: int = 8, seed: int = 11) -> tuple[DataFrame, np.ndarray]:
    """An inverted-file index: centroids fitted by dot on a bounded sample, and every token with its `centroid`."""
    drawn = pages.select("emb").orderBy(F.xxhash64("doc_id", "page_idx", "token_idx", F.lit(seed))).limit(sample).toArrow()
    x = _matrix(drawn.column("emb").combine_chunks())
    c = x[np.linspace(0, len(x) - 1, min(centroids, len(x))).astype(int)].copy()
    for _ in range(rounds):
        nearest = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        for i in range(len(c)):
            if (nearest == i).any():
                c[i] = x[nearest == i].mean(0)
    place = pages.columns.index("emb")

    def assign(batches):
        for batch in batches:
            near = (_matrix(batch.column(place)) @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
            yield batch.append_column("centroid", pa.array(near.astype(np.int32)))

    kinds = ", ".join(_schema(pages, pages.columns))
    return pages.mapInArrow(assign, f"{kinds}, centroid int"), c


def probe(index: DataFrame, centroids: np.ndarray, queries: DataFrame, nprobe: int, page_columns: list[str] = (), query_columns: list[str] = ("active",)) -> DataFrame:
    """Score rows of the page tokens in each query token's `nprobe` best clusters; with all clusters it is the full score table.

    A cluster's tokens are multiplied with the query tokens that probe it alone, and clusters that none probes are not read
    (a folder each in a written index).
    """
    own, theirs = [*PAGE, "token_idx", *page_columns, "centroid"], ["qid", "q_idx", *query_columns]
    schema = ", ".join([*_schema(queries, theirs), *_schema(index, own), "s double"])

    def kernel(block: pa.Table, probing: dict[int, np.ndarray]):
        held = [block.column(c).combine_chunks() for c in theirs]
        vectors = _matrix(block.column("emb").combine_chunks())

        def run(batches):
            for batch in batches:
                cluster = batch.column(len(own) - 1).to_numpy()
                for c in np.unique(cluster):
                    tokens, rows = probing.get(int(c), ()), np.flatnonzero(cluster == c)
                    for at in range(0, len(rows), step := max(1, OUT_ROWS // max(1, len(tokens)))):
                        if not len(tokens):
                            break
                        some = rows[at : at + step]
                        s = _matrix(batch.column(len(own)).take(pa.array(some))) @ vectors[tokens].T
                        left, right = pa.array(np.tile(tokens, len(some))), pa.array(np.repeat(some, len(tokens)))
                        yield pa.RecordBatch.from_arrays([*(h.take(left) for h in held), *(batch.column(i).take(right) for i in range(len(own))), pa.array(s.ravel())], [*theirs, *own, "s"])

        return run

    parts = []
    for block in _query_blocks(queries, theirs):
        if block.num_rows:
            near = np.argsort(-(_matrix(block.column("emb").combine_chunks()) @ centroids.T), axis=1, kind="stable")[:, :nprobe]
            probing = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
            parts.append(index.where(F.col("centroid").isin(*probing)).select(*own, "emb").mapInArrow(kernel(block, probing), schema))
    return reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], schema)
