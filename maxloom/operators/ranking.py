"""Fusion, document aggregation, staged reranking, learned scores and weight search over page features.

`features` hold a row per (qid, doc_id, page_idx) with base, visual, non_visual, balance, …; `pos` (input order) breaks ties
where given, else document and page do.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ranked, standardised
from ..sources.shared import stored

KEY = ["qid", "doc_id", "page_idx"]
#: Where a missing rank must order last.
NO_RANK = 1e12


@dataclass(frozen=True)
class Weights:
    base: float = 1.0
    visual: float = 0.0
    non_visual: float = 0.0
    balance: float = 0.0

    @property
    def base_only(self) -> bool:
        """Whether no channel but the base score counts."""
        return self.visual == self.non_visual == self.balance == 0


def _tie(df: DataFrame) -> list:
    return ["pos"] if "pos" in df.columns else ["doc_id", "page_idx"]


def doc_ranks(run: DataFrame) -> DataFrame:
    """First-seen unique-document ranks of a page run (qid, rank, doc_id)."""
    first = run.groupBy("qid", "doc_id").agg(F.min("rank").alias("first_row"))
    return first.withColumn("doc_rank", ranked(["qid"], "first_row"))


def fused_pages(features: DataFrame, weights: Weights, gate_docs: int | None = None, scale_by_base: bool = False) -> DataFrame:
    """Pages with aux_scale, fused and rank. With `gate_docs`, channels count only in the documents that lead by base score."""
    scale = F.lit(1.0)
    if scale_by_base:
        top = F.max("base").over(Window.partitionBy("qid"))
        scale = F.when(top > 0, F.least(F.greatest(F.col("base") / top, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    out = features
    if gate_docs is not None:
        lead = stage1_doc_ranks(features).select("qid", "doc_id", "stage1_rank")
        out = out.join(lead, ["qid", "doc_id"])
        scale = F.when(F.col("stage1_rank") <= gate_docs, scale).otherwise(0.0)
    bonus = weights.visual * F.col("visual") + weights.non_visual * F.col("non_visual") + weights.balance * F.col("balance")
    out = out.withColumns({"aux_scale": scale, "aux": bonus}).withColumn("fused", weights.base * F.col("base") + F.col("aux_scale") * F.col("aux"))
    return out.withColumn("rank", ranked(["qid"], F.desc("fused"), F.desc("base"), F.desc("visual"), F.desc("non_visual"), *_tie(features)))


def fused_docs(pages: DataFrame, second_weight: float = 0.25, top2: bool = True) -> DataFrame:
    """Documents by their best page's fused score, with `top2` plus a share of the second's."""
    at = pages.withColumn("at", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("rank")))
    pick = lambda c, i: F.max(F.when(F.col("at") == i, F.col(c)))
    docs = at.groupBy("qid", "doc_id").agg(pick("fused", 1).alias("best"), pick("base", 1).alias("best_base"), pick("fused", 2).alias("second"), pick("page_idx", 1).alias("best_page"), F.count("*").alias("pages"), F.min("rank").alias("first"))
    score = F.col("best") + (F.coalesce(F.col("second") * second_weight, F.lit(0.0)) if top2 else F.lit(0.0))
    docs = docs.withColumn("doc_score", score)
    return docs.withColumn("rank", ranked(["qid"], F.desc("doc_score"), F.desc("best_base"), F.desc(F.coalesce("second", F.lit(0.0))), "first")).drop("first")


def stage1_doc_ranks(features: DataFrame) -> DataFrame:
    """Document ranks by base score alone."""
    best = features.groupBy("qid", "doc_id").agg(F.max("base").alias("best_base"))
    return best.withColumn("stage1_rank", ranked(["qid"], F.desc("best_base"), "doc_id"))


def scalar_ranking(features: DataFrame, attribute: str) -> DataFrame:
    """Pages by one attribute (null last), then base, then page uid, all descending."""
    from ..functions.columns import page_uid

    out = features.withColumn("uid", page_uid())
    return out.withColumn("rank", ranked(["qid"], F.desc_nulls_last(attribute), F.desc("base"), F.desc("uid"))).drop("uid")


def refreshed(approx: DataFrame, exact: Callable[[DataFrame], DataFrame], top_pages: int | None = None, top_docs: int | None = None) -> DataFrame:
    """A cascade: approximate scores, replaced by those that `exact` makes of the leading pages, or of all pages of the leading documents."""
    run = stored(approx.select(*KEY, "score"), "approximate").withColumn("stage_rank", ranked(["qid"], F.desc("score"), "doc_id", "page_idx"))
    if top_docs is not None:
        docs = doc_ranks(run.withColumnRenamed("stage_rank", "rank")).where(F.col("doc_rank") <= top_docs).select("qid", "doc_id", F.lit(True).alias("lead"))
        run = run.join(docs, ["qid", "doc_id"], "left").withColumn("lead", F.coalesce("lead", F.lit(False)))
    else:
        run = run.withColumn("lead", F.col("stage_rank") <= top_pages)
    best = exact(run.where("lead").select(*KEY)).select(*KEY, F.col("score").alias("exact_score"))
    out = run.join(best, KEY, "left").withColumn("final", F.coalesce("exact_score", "score"))
    return out.withColumn("rank", ranked(["qid"], F.desc("final"), "stage_rank"))


def prefilter_cascade(pages: DataFrame, queries: DataFrame, base: DataFrame, base_top: int, prefilter_top: int, mode: str = "balance_then_visual") -> DataFrame:
    """The best pages of a run `base` (qid, doc_id, page_idx, score), of them the best by a prefilter, in the order of their exact scores.

    Vectors, features and exact scores of the run's best pages alone are read and made.
    """
    from .channels import page_features, prefilter
    from .retrieval import token_scores
    from .retrieval import top_pages as best_of

    lead = stored(best_of(base, base_top).select(*KEY, F.col("score").alias("base")), "cascade-lead")
    scores = token_scores(pages, queries.where("active"), ["patch_idx", "side", "pclass"], ["qclass", "active"], lead)
    features = page_features(scores).withColumnRenamed("base", "exact_score").join(lead, KEY)
    kept = prefilter(features, mode).where(F.col("prefilter_rank") <= prefilter_top)
    return kept.withColumn("rank", ranked(["qid"], F.desc("exact_score"), "prefilter_rank"))


def reciprocal_rank_fusion(runs: DataFrame, k: int = 60) -> DataFrame:
    """Pages of several runs (sub, rank, score) by sum of 1 / (k + rank), then best rank, then best score."""
    out = runs.groupBy(*KEY).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.min("rank").alias("best_rank"), F.max("score").alias("best_score"), F.count("*").alias("runs"))
    return out.withColumn("rank", ranked(["qid"], F.desc("rrf"), "best_rank", F.desc("best_score"), "doc_id", "page_idx"))


def best_rank_fusion(runs: DataFrame) -> DataFrame:
    """The same pages by best rank, then best score."""
    out = runs.groupBy(*KEY).agg(F.min("rank").alias("best_rank"), F.max("score").alias("best_score"), F.count("*").alias("runs"))
    return out.withColumn("rank", ranked(["qid"], "best_rank", F.desc("best_score"), "doc_id", "page_idx"))


DOC_FEATURES = ["stage1_rank", "baseline_rank", "pages", "max_base", "mean_base", "top2_gap", "max_visual", "mean_visual", "max_non_visual", "mean_non_visual", "max_grounded", "mean_grounded", "max_balance", "mean_balance", "best_visual_alignment", "best_non_visual_alignment", "best_visual_patches", "best_non_visual_patches", "best_grounded_patches", "best_anchor_patches", "best_visual_queries", "best_non_visual_queries"]


def doc_features(features: DataFrame, baseline: DataFrame) -> DataFrame:
    """22 features per (query, document); `baseline`: qid, doc_id, doc_rank. A missing rank is one past the last."""
    at = features.withColumn("at", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy(F.desc("base"), "page_idx")))
    first = lambda c: F.max(F.when(F.col("at") == 1, F.col(c))).cast("double")
    second = F.max(F.when(F.col("at") == 2, F.col("base")))
    both = lambda c: [F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"mean_{c}")]
    best = ["visual_alignment", "non_visual_alignment", "visual_patches", "non_visual_patches", "grounded_patches", "anchor_patches", "visual_queries", "non_visual_queries"]
    docs = at.groupBy("qid", "doc_id").agg(F.count("*").cast("double").alias("pages"), *both("base"), (F.max("base") - F.coalesce(second, F.lit(0.0))).alias("top2_gap"), *both("visual"), *both("non_visual"), *both("grounded"), *both("balance"), *[first(c).alias(f"best_{c}") for c in best])
    docs = docs.join(stage1_doc_ranks(features).select("qid", "doc_id", "stage1_rank"), ["qid", "doc_id"])
    missing = F.count("*").over(Window.partitionBy("qid")) + 1
    docs = docs.join(baseline.select("qid", "doc_id", F.col("doc_rank").alias("baseline_rank")), ["qid", "doc_id"], "left").withColumn("baseline_rank", F.coalesce(F.col("baseline_rank"), missing).cast("double"))
    return docs.withColumn("stage1_rank", F.col("stage1_rank").cast("double")).select("qid", "doc_id", *DOC_FEATURES)


def learned_docs(docs: DataFrame, model: Mapping, top_docs: int) -> DataFrame:
    """The leading documents reordered by max base plus a linear model; all others keep their place behind them."""
    names = model["feature_names"]
    score = F.col("max_base") + standardised({n: F.col(n) for n in names}, dict(zip(names, model["feature_means"], strict=True)), dict(zip(names, model["feature_stds"], strict=True)), dict(zip(names, model["weights"], strict=True)), model["bias"])
    out = docs.withColumns({"learned": score, "in_top": F.col("stage1_rank") <= top_docs})
    return out.withColumn("rank", ranked(["qid"], F.desc("in_top"), F.desc(F.when(F.col("in_top"), F.col("learned"))), "stage1_rank"))


def weight_grid(features: DataFrame, gold: DataFrame, grid: Mapping[str, Sequence[float]], top: int = 20) -> DataFrame:
    """All weight combinations of a grid, per query, by (first gold rank over 4, rank, hits@4, hits@10); the `top` best.

    The grid is a parameter of a few values each; every page meets every combination, and documents are ranked within each.
    """
    names = ["combo", "w_base", "w_visual", "w_non_visual", "w_balance"]
    combos = [F.struct(F.lit(i).cast("long").alias("combo"), *[F.lit(float(x)).alias(n) for n, x in zip(names[1:], c, strict=True)]) for i, c in enumerate(product(*(grid[n] for n in ("base", "visual", "non_visual", "balance"))))]
    score = F.col("w_base") * F.col("base") + F.col("w_visual") * F.col("visual") + F.col("w_non_visual") * F.col("non_visual") + F.col("w_balance") * F.col("balance")
    pages = features.select(*KEY, "base", "visual", "non_visual", "balance", F.explode(F.array(*combos)).alias("c")).select("*", "c.*").withColumn("fused", score)
    docs = pages.groupBy("qid", *names, "doc_id").agg(F.max(F.struct("fused", "base")).alias("b"))
    docs = docs.withColumn("rank", ranked(["qid", "combo"], F.desc("b.fused"), F.desc("b.base"), "doc_id")).join(gold.withColumn("g", F.lit(1)), ["qid", "doc_id"], "left")
    is_gold = F.col("g").isNotNull()
    out = docs.groupBy("qid", *names).agg(F.min(F.when(is_gold, F.col("rank"))).alias("first_gold"), F.count_if(is_gold & (F.col("rank") <= 4)).alias("hits4"), F.count_if(is_gold & (F.col("rank") <= 10)).alias("hits10"))
    last = F.coalesce(F.col("first_gold").cast("double"), F.lit(NO_RANK))
    return out.withColumn("place", ranked(["qid"], (last > 4).cast("int"), last, F.desc("hits4"), F.desc("hits10"), "combo")).where(F.col("place") <= top)


def evidence_reranked(docs: DataFrame, evidence: DataFrame, bonus: float, top_docs: int) -> DataFrame:
    """Leading documents with `bonus` times their best page's evidence added to the stage score; others score minus their rank."""
    best = evidence.groupBy("qid", "doc_id").agg(F.max("evidence").alias("evidence"))
    out = docs.join(best, ["qid", "doc_id"], "left").withColumn("lead", F.col("rank") <= top_docs)
    out = out.withColumn("final", F.when(F.col("lead"), F.col("doc_score") + bonus * F.coalesce("evidence", F.lit(0.0))).otherwise(-F.col("rank").cast("double")))
    return out.withColumn("final_rank", ranked(["qid"], F.desc("lead"), F.desc("final"), "rank"))


def replace_pool_tail(pool: DataFrame, new: DataFrame) -> DataFrame:
    """Each new page not in the pool takes the place of the pool's last one (qid, pos, uid): the first n - m stay, m are appended."""
    size = pool.groupBy("qid").agg(F.count("*").alias("n"))
    fresh = new.join(pool.select("qid", "uid"), ["qid", "uid"], "left_anti")
    fresh = fresh.groupBy("qid", "uid").agg(F.min("pos").alias("pos"))
    fresh = fresh.withColumn("i", ranked(["qid"], "pos"))
    added = fresh.groupBy("qid").agg(F.count("*").alias("m"))
    kept = pool.join(size, "qid").join(added, "qid", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    old = kept.withColumn("p", ranked(["qid"], "pos")).where("p <= n - m").select("qid", "p", "uid")
    tail = fresh.join(size, "qid").join(added, "qid").where("m - i < n").select("qid", (F.greatest(F.col("n") - F.col("m"), F.lit(0)) + F.col("i") - F.greatest(F.col("m") - F.col("n"), F.lit(0))).alias("p"), "uid")
    return old.unionByName(tail)
