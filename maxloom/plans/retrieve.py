"""One call for retrieval and one for reranking: configurations to plans over the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import page_uid, query_keep, token_label
from ..operators import channels, pruning, ranking, retrieval
from ..sources.shared import stored


@dataclass(frozen=True)
class RetrievalConfig:
    """`mode`: ann (partial, by nearest tokens), two_stage, or exact; k_token is the nearest tokens per query token."""

    mode: str = "exact"
    k: int = 4
    k_token: int | None = None
    candidates: int | None = None
    token_filter: str = "full"
    one_page_per_doc: bool = False
    nprobe: int | None = None


def retrieve(pages: DataFrame, queries: DataFrame, config: RetrievalConfig, centroids=None) -> DataFrame:
    """qid, rank, doc_id, page_idx, score. With `nprobe`, `pages` are clustered and `centroids` are theirs."""
    if config.mode not in ("ann", "two_stage", "exact"):
        raise ValueError(f"no retrieval mode {config.mode!r}")
    kept = queries.where(query_keep("raw_token", "active" if config.token_filter == "full" else F.lit(True), config.token_filter))
    if config.mode == "exact":
        scored = retrieval.maxsim(pages, kept)
    else:
        k_token = config.k_token or config.k
        near = retrieval.search_tokens(pages, queries, k_token, ["active"]) if config.nprobe is None else retrieval.nearest_tokens(retrieval.probe(pages, centroids, queries, config.nprobe), k_token)
        if config.mode == "ann":
            scored = retrieval.knn_pages(near)
        else:
            candidates = config.candidates or config.k
            if candidates < config.k:
                raise ValueError("fewer candidates than results")
            scored = retrieval.rescored(pages, queries.where("active"), retrieval.top_pages(retrieval.maxsim_of(near), candidates))
    out = retrieval.top_page_per_doc(scored, config.k) if config.one_page_per_doc else retrieval.top_pages(scored, config.k)
    return out.select("qid", "rank", "doc_id", "page_idx", "score")


@dataclass(frozen=True)
class RerankConfig:
    """How candidate pages are scored and reordered: a token selector first, then channels, fusion and an exact refresh."""

    selector: str | None = "global_topk"
    selector_k: int = 256
    selector_options: dict = field(default_factory=dict)
    weights: ranking.Weights = ranking.Weights()
    gate_docs: int | None = None
    scale_by_base: bool = False
    refresh_pages: int | None = None
    second_page_weight: float = 0.25
    radius: int = 1
    balance: str = "min_avg"


def rerank(pages: DataFrame, queries: DataFrame, config: RerankConfig, pool: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Reranked pages (base, fused, rank) and documents (doc_score, rank), of a candidate pool (qid, doc_id, page_idx) if given."""
    if pool is not None:
        pages = pages.join(pool.select("doc_id", "page_idx").distinct(), ["doc_id", "page_idx"], "left_semi")
    scores = retrieval.token_scores(pages, queries, [c for c in ("patch_idx", "side", "n", "pclass") if c in pages.columns], ["qclass", "active"], pool)
    scores = stored(scores, "rerank-scores")
    features = channels.page_features(scores, config.radius, balance=config.balance)
    if config.selector is not None:
        kept = pruning.select_tokens(config.selector, config.selector_k, pruning.coarse_token_max(scores), scores, pages, **config.selector_options)
        approx = pruning.approx_scores(kept, scores).select("qid", "doc_id", "page_idx", "score")
        if config.refresh_pages is not None:
            exact = lambda leads: retrieval.maxsim_of(scores.where("active").join(leads, ["qid", "doc_id", "page_idx"], "left_semi"))
            approx = ranking.refreshed(approx, exact, top_pages=config.refresh_pages).select("qid", "doc_id", "page_idx", F.col("final").alias("score"))
        features = features.drop("base").join(approx.withColumnRenamed("score", "base"), ["qid", "doc_id", "page_idx"])
    ranked_pages = ranking.fused_pages(features, config.weights, config.gate_docs, config.scale_by_base)
    return ranked_pages, ranking.fused_docs(ranked_pages, config.second_page_weight)


def explanations(scores: DataFrame, run: DataFrame, pages: int = 4) -> DataFrame:
    """Why a page ranks where it does: uid, rank, and as JSON the winning page token of each query token, best first."""
    won = retrieval.contributions(scores).join(run.where(F.col("rank") <= pages).select("qid", "doc_id", "page_idx", "rank"), ["qid", "doc_id", "page_idx"])
    labels = scores.select("qid", "q_idx", "raw_token").distinct() if "raw_token" in scores.columns else None
    won = won if labels is None else won.join(labels, ["qid", "q_idx"]).withColumn("label", token_label("raw_token"))
    fields = [F.round("s", 6).alias("score"), "q_idx", "token_idx", *(["label"] if labels is not None else [])]
    items = F.sort_array(F.collect_list(F.struct(*fields)), asc=False)
    return won.groupBy("qid", "doc_id", "page_idx", "rank").agg(F.to_json(items).alias("tokens")).withColumn("uid", page_uid()).select("qid", "rank", "uid", "tokens")


def inspect_pages(features: DataFrame, uids: list[str], modes: list[str]) -> DataFrame:
    """Where given pages rank under several prefilter modes."""
    out = None
    for mode in modes:
        one = channels.prefilter(features, mode).withColumns({"uid": page_uid(), "mode": F.lit(mode)}).where(F.col("uid").isin(uids)).select("qid", "uid", "mode", "prefilter_rank", "primary")
        out = one if out is None else out.unionByName(one)
    return out


def closest_grid(width: int, height: int, most: int = 6, tile: int = 448) -> tuple[int, int]:
    """Columns and rows of at most `most` tiles, nearest an image's aspect ratio; of equally near ones the largest that the image fills half of, else the smallest."""
    grids = [(i, j) for i in range(1, most + 1) for j in range(1, most // i + 1)]
    gap = {g: abs(width / height - g[0] / g[1]) for g in grids}
    nearest = sorted((g for g in grids if gap[g] == min(gap.values())), key=lambda g: g[0] * g[1])
    filled = [g for g in nearest if width * height > tile * tile * g[0] * g[1] / 2]
    return filled[-1] if filled else nearest[0]


def closest_grid_of(width: Column, height: Column, most: int = 6, tile: int = 448) -> Column:
    """`closest_grid` of columns: a struct of area, i (columns) and j (rows)."""
    grids = F.array(*[F.struct(F.lit(i * j).alias("area"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(1, most + 1) for j in range(1, most // i + 1)])
    gap = lambda g: F.abs(width / height - g["i"] / g["j"])
    least = F.array_min(F.transform(grids, gap))
    nearest = F.filter(grids, lambda g: gap(g) == least)
    filled = F.filter(nearest, lambda g: width * height > g["area"] * (tile * tile) / 2)
    return F.when(F.size(filled) > 0, F.array_max(filled)).otherwise(F.array_min(nearest))
