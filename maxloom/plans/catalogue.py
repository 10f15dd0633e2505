"""Registered queries of the retrieval engine: each a plan over the fixture views, with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import analysis, channels, corpus, evaluation, pruning, ranking, retrieval, routing
from ..operators.taxonomy import taxonomy
from ..sources.fixtures import Fixture
from ..sources.shared import stored
from .prelude import oracle
from .retrieve import RerankConfig, RetrievalConfig, explanations as explain, inspect_pages as inspect, rerank, retrieve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PAGE = ["qid", "doc_id", "page_idx"]
TOKEN = [*PAGE, "token_idx"]


def query(select: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
        if select:
            ORACLE_SQL[f.__name__] = oracle(select)
        return f

    return register


def r(c: str | Column, name: str | None = None) -> Column:
    """A score as it is shown: six decimals, and no negative zero."""
    return (F.round(C.col(c), 6) + 0.0).alias(name or c)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + 0.0 for n in names})


# Retrieval


@query("SELECT qid, doc_id, page_idx, round(score, 6) AS score FROM ex")
def maxsim_exact_pages(f):
    return f.exact.select(*PAGE, r("score"))


@query("SELECT qid, rank, doc_id, page_idx, round(score, 6) AS score FROM run_e WHERE rank <= 4")
def maxsim_exact_top4(f):
    return retrieval.top_pages(f.exact, 4).select("qid", "rank", "doc_id", "page_idx", r("score"))


@query("SELECT qid, doc_id, page_idx, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, page_idx) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, page_idx) AS i FROM ex) WHERE i = 1 QUALIFY rank <= 4")
def top1_page_per_doc(f):
    return retrieval.top_page_per_doc(f.exact, 4).select(*PAGE, r("score"), "rank")


@query("SELECT qid, rank, doc_id, page_idx, round(score, 6) AS score FROM run_b")
def knn_partial_pages(f):
    return f.run_baseline.select("qid", "rank", "doc_id", "page_idx", r("score"))


@query("SELECT qid, doc_id, page_idx, round(sum(m), 6) AS score FROM (SELECT qid, q_idx, doc_id, page_idx, max(s) AS m FROM kn GROUP BY ALL) GROUP BY ALL")
def knn_partial_with_pad(f):
    return retrieval.maxsim_of(retrieval.search_tokens(f.pages, f.queries, 10)).select(*PAGE, r("score"))


@query("SELECT qid, doc_id, page_idx, round(sum(m), 6) AS score FROM (SELECT qid, q_idx, doc_id, page_idx, max(s) AS m FROM sc WHERE raw_token NOT IN ('<pad>', '<bos>', '<eos>', 'Question', ':') GROUP BY ALL) GROUP BY ALL")
def token_filter_semantic_only(f):
    return retrieval.maxsim(f.pages, f.queries.where(C.query_keep("raw_token", F.lit(True), "semantic_only"))).select(*PAGE, r("score"))


@query("SELECT qid, q_idx, raw_token FROM qt WHERE raw_token NOT IN ('<pad>', '<bos>', '<eos>')")
def token_filter_drop_pad_like(f):
    return f.queries.where(C.query_keep("raw_token", F.lit(True), "drop_pad_like")).select("qid", "q_idx", "raw_token")


@query("SELECT qid, doc_id, page_idx, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, page_idx) AS rank FROM ex SEMI JOIN (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id, page_idx) AS i FROM (SELECT qid, doc_id, page_idx, sum(m) AS s FROM (SELECT qid, q_idx, doc_id, page_idx, max(s) AS m FROM kn GROUP BY ALL) GROUP BY ALL)) c ON ex.qid = c.qid AND ex.doc_id = c.doc_id AND ex.page_idx = c.page_idx AND c.i <= 12 QUALIFY rank <= 4")
def two_stage_rerank(f):
    return retrieval.two_stage(f.pages, f.queries, 10, 12, 4).select(*PAGE, r("score"), "rank")


@query("SELECT qid, q_idx, doc_id, page_idx, arg_max(token_idx, (s, -token_idx)) AS token_idx, round(max(s), 6) AS s FROM sc WHERE active GROUP BY ALL")
def token_provenance(f):
    return retrieval.contributions(f.scores).select("qid", "q_idx", "doc_id", "page_idx", "token_idx", r("s"))


@query("SELECT doc_id, page_idx, i - 1 AS at, round(avg(v[i]), 6) AS x FROM pt, range(1, 65) t(i) GROUP BY ALL")
def mean_pool_page(f):
    return retrieval.mean_vectors(f.pages, ["doc_id", "page_idx"]).select("doc_id", "page_idx", F.posexplode("emb").alias("at", "x")).select("doc_id", "page_idx", F.col("at").cast("long").alias("at"), r("x"))


@query("SELECT doc_id, token_idx, i - 1 AS at, round(avg(v[i]), 6) AS x FROM pt, range(1, 65) t(i) GROUP BY ALL")
def mean_pool_token(f):
    return retrieval.mean_vectors(f.pages, ["doc_id", "token_idx"]).select("doc_id", "token_idx", F.posexplode("emb").alias("at", "x")).select("doc_id", "token_idx", F.col("at").cast("long").alias("at"), r("x"))


@query("SELECT doc_id, i - 1 AS at, round(avg(v[i]), 6) AS x FROM pt, range(1, 65) t(i) GROUP BY ALL")
def mean_pool_page_token(f):
    return retrieval.mean_vectors(f.pages, ["doc_id"]).select("doc_id", F.posexplode("emb").alias("at", "x")).select("doc_id", F.col("at").cast("long").alias("at"), r("x"))


@query()
def ivf_nprobe_search(f):
    index, centroids = retrieval.cluster_tokens(f.pages, 8)
    return retrieval.rank_pages(retrieval.maxsim_of(retrieval.probe(index, centroids, f.queries, 2).where("active"))).select("qid", "rank", "doc_id", "page_idx", r("score"))


@query("SELECT qid, doc_id, page_idx, round(score, 6) AS score FROM ex")
def ivf_all_lists(f):
    index, centroids = retrieval.cluster_tokens(f.pages, 8)
    return retrieval.maxsim_of(retrieval.probe(index, centroids, f.queries, 8).where("active")).select(*PAGE, r("score"))


@query()
def query_prototypes(f):
    return pruning.query_prototypes(f.queries).select("qid", F.col("q_idx").alias("prototype"), F.posexplode("emb").alias("at", "x")).select("qid", "prototype", F.col("at").cast("long").alias("at"), r("x"))


@query("SELECT qid, round(sum(score), 6) AS total, count(*) AS pages, (SELECT doc_id FROM run_e b WHERE b.qid = a.qid AND rank = 1) AS best_doc FROM run_e a GROUP BY qid")
def batch_score_matrix(f):
    return f.run_exact.groupBy("qid").agg(r(F.sum("score"), "total"), F.count("*").alias("pages"), F.max(F.when(F.col("rank") == 1, F.col("doc_id"))).alias("best_doc"))


# Pruning


def _coarse(f):
    return pruning.coarse_token_max(f.scores)


@query("SELECT qid, doc_id, page_idx, token_idx, round(coarse, 6) AS coarse FROM co")
def coarse_token_max(f):
    return _coarse(f).select(*TOKEN, r("coarse"))


@query("SELECT qid, doc_id, page_idx, token_idx, round(list_dot_product(pt.v, m.v), 6) AS coarse FROM pt, (SELECT qid, list(x ORDER BY i) AS v FROM (SELECT qid, i, avg(v[i]) AS x FROM qt, range(1, 65) t(i) WHERE active GROUP BY ALL) GROUP BY qid) m")
def coarse_query_mean(f):
    return pruning.coarse_query_mean(f.pages, f.queries).select(*TOKEN, r("coarse"))


@query("SELECT qid, doc_id, page_idx, token_idx, round(list_dot_product(pt.v, m.v), 6) AS coarse FROM pt, (SELECT qid, list(x ORDER BY i) AS v FROM (SELECT qid, i, sum(v[i] * w) / sum(w) AS x FROM (SELECT *, CASE qclass WHEN 'visual' THEN 3.0 WHEN 'non_visual' THEN 0.5 ELSE 1.0 END AS w FROM qt), range(1, 65) t(i) WHERE active GROUP BY ALL) GROUP BY qid) m")
def coarse_weighted_mean(f):
    w = F.when(F.col("qclass") == "visual", 3.0).when(F.col("qclass") == "non_visual", 0.5).otherwise(1.0)
    return pruning.coarse_query_mean(f.pages, f.queries, w).select(*TOKEN, r("coarse"))


@query("SELECT qid, doc_id, page_idx, token_idx FROM cr WHERE place <= 4")
def prune_global_topk(f):
    return pruning.global_topk(_coarse(f), 4).select(*TOKEN)


@query("SELECT qid, doc_id, page_idx, round(score, 6) AS score, round(coarse_sum, 6) AS coarse_sum, kept FROM ap JOIN (SELECT qid, doc_id, page_idx, sum(coarse) AS coarse_sum, count(*) AS kept FROM sel GROUP BY ALL) USING (qid, doc_id, page_idx)")
def approx_page_scores(f):
    return pruning.approx_scores(pruning.global_topk(_coarse(f), 4), f.scores).select(*PAGE, r("score"), r("coarse_sum"), "kept")


@query("SELECT qid, doc_id, page_idx, token_idx FROM co WHERE patch_idx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid, doc_id, page_idx ORDER BY coarse DESC, token_idx) <= 4")
def prune_nonspatial_drop(f):
    return pruning.nonspatial(_coarse(f), 4, "drop_all").select(*TOKEN)


@query("SELECT qid, doc_id, page_idx, token_idx FROM co QUALIFY patch_idx IS NULL OR row_number() OVER (PARTITION BY qid, doc_id, page_idx, patch_idx IS NULL ORDER BY coarse DESC, token_idx) <= 4")
def prune_nonspatial_force(f):
    return pruning.nonspatial(_coarse(f), 4, "force_include_all").select(*TOKEN)


@query("SELECT qid, doc_id, page_idx, token_idx FROM (SELECT *, place <= 2 OR (quad IS NOT NULL AND row_number() OVER (PARTITION BY qid, doc_id, page_idx, quad ORDER BY coarse DESC, token_idx) <= CASE WHEN quad < 3 THEN 1 ELSE 0 END) AS chosen FROM (SELECT *, CASE WHEN side >= 2 AND patch_idx IS NOT NULL THEN 2 * (patch_idx // side >= side // 2)::INT + (patch_idx % side >= side // 2)::INT END AS quad FROM cr)) QUALIFY row_number() OVER (PARTITION BY qid, doc_id, page_idx ORDER BY chosen::INT DESC, coarse DESC, token_idx) <= 5")
def prune_quadrant_mix(f):
    return pruning.quadrant_mix(_coarse(f), 5, 3).select(*TOKEN)


@query("SELECT qid, doc_id, page_idx, token_idx FROM (SELECT *, place <= 3 OR row_number() OVER (PARTITION BY qid, doc_id, page_idx ORDER BY vq DESC, token_idx) <= 2 AS chosen FROM cr JOIN vq USING (qid, doc_id, page_idx, token_idx)) QUALIFY row_number() OVER (PARTITION BY qid, doc_id, page_idx ORDER BY chosen::INT DESC, coarse DESC, token_idx) <= 5")
def prune_label_mix(f):
    return pruning.label_mix(_coarse(f), pruning.visual_query_scores(f.scores), 5, 2).select(*TOKEN)


@query("SELECT qid, doc_id, page_idx, token_idx FROM co JOIN vq USING (qid, doc_id, page_idx, token_idx) QUALIFY row_number() OVER (PARTITION BY qid, doc_id, page_idx ORDER BY coarse + (0.5 * vq + CASE WHEN pclass = 'visual' THEN 0.2 ELSE 0 END) DESC, token_idx) <= 4")
def prune_soft_label(f):
    return pruning.soft_label_prior(_coarse(f), pruning.visual_query_scores(f.scores), 4).select(*TOKEN)


@query("SELECT qid, doc_id, page_idx, token_idx FROM co JOIN vq USING (qid, doc_id, page_idx, token_idx) QUALIFY row_number() OVER (PARTITION BY qid, doc_id, page_idx ORDER BY coarse + CASE WHEN pclass = 'visual' THEN 0.5 * vq + 0.2 ELSE 0 END DESC, token_idx) <= 4")
def prune_patch_prior(f):
    return pruning.soft_label_prior(_coarse(f), pruning.visual_query_scores(f.scores), 4, patches_only=True).select(*TOKEN)


@query("SELECT qid, doc_id, page_idx, CAST(least(greatest(round_even(lo + least(greatest(h / greatest(ln(n), 1e-6), 0), 1) * (hi - lo), 0), lo), hi) AS BIGINT) AS k FROM (SELECT qid, doc_id, page_idx, n, least(2, n) AS lo, least(8, n) AS hi, -sum(p * ln(greatest(p, 1e-12))) AS h FROM (SELECT *, exp(coarse) / sum(exp(coarse)) OVER (PARTITION BY qid, doc_id, page_idx) AS p FROM co) GROUP BY ALL)")
def prune_adaptive_entropy(f):
    return pruning.adaptive_k(_coarse(f), "entropy", 2, 8)


@query("SELECT qid, doc_id, page_idx, CAST(least(greatest(round_even(lo + (before / greatest(pool - 1, 1)) * (hi - lo), 0), lo), hi) AS BIGINT) AS k FROM (SELECT qid, doc_id, page_idx, least(2, n) AS lo, least(8, n) AS hi, count(*) FILTER (mass < 0.5) AS before, count(*) AS pool FROM (SELECT *, sum(p) OVER (PARTITION BY qid, doc_id, page_idx ORDER BY place ROWS UNBOUNDED PRECEDING) AS mass FROM (SELECT *, exp(coarse) / sum(exp(coarse)) OVER (PARTITION BY qid, doc_id, page_idx) AS p FROM cr WHERE place <= 64)) GROUP BY ALL)")
def prune_adaptive_concentration(f):
    return pruning.adaptive_k(_coarse(f), "concentration", 2, 8)


@query("SELECT qid, doc_id, page_idx, full_tokens, selected_tokens, round(full_score, 6) AS full_score, round(pruned_score, 6) AS pruned_score, round(loss, 6) AS loss, round(preservation, 6) AS preservation, retained, round(retention, 6) AS retention FROM dg")
def pruning_diagnostics(f):
    return rounded(pruning.diagnostics(pruning.global_topk(_coarse(f), 4), f.scores), "full_score", "pruned_score", "loss", "preservation", "retention")


@query("SELECT count(*) AS queries, CAST(sum(pages) AS BIGINT) AS pages, round(sum(mean_loss * pages) / sum(pages), 6) AS mean_loss, round(sum(mean_preservation * pages) / sum(pages), 6) AS mean_preservation, round(sum(mean_retention * pages) / sum(pages), 6) AS mean_retention, round(sum(mean_selected * pages) / sum(pages), 6) AS mean_selected, round(median(median_loss), 6) AS median_of_medians FROM dgq")
def pruning_diagnostics_summary(f):
    out = pruning.diagnostics_total(pruning.diagnostics_summary(pruning.diagnostics(pruning.global_topk(_coarse(f), 4), f.scores)))
    return rounded(out, "mean_loss", "mean_preservation", "mean_retention", "mean_selected", "median_of_medians")


@query("SELECT qid, CAST(sum(selected_tokens) FILTER (rank = 1) AS BIGINT) AS top1, round(avg(selected_tokens) FILTER (rank <= 10), 6) AS top10, round(avg(selected_tokens) FILTER (rank <= 25), 6) AS top25 FROM dg JOIN run_p USING (qid, doc_id, page_idx) GROUP BY qid")
def pruning_focus(f):
    chosen = pruning.global_topk(_coarse(f), 4)
    run = retrieval.rank_pages(pruning.approx_scores(chosen, f.scores)).select(*PAGE, "rank")
    both = pruning.diagnostics(chosen, f.scores).join(run, PAGE)
    upto = lambda k: F.avg(F.when(F.col("rank") <= k, F.col("selected_tokens")))
    return both.groupBy("qid").agg(F.sum(F.when(F.col("rank") == 1, F.col("selected_tokens"))).alias("top1"), r(upto(10), "top10"), r(upto(25), "top25"))


@query("SELECT t.qid, t.doc_id, t.page_idx, t.token_idx, count(b.q_idx) AS wins FROM (SELECT DISTINCT qid, doc_id, page_idx, token_idx FROM sc) t LEFT JOIN (SELECT qid, doc_id, page_idx, q_idx, arg_max(token_idx, (s, -token_idx)) AS w FROM sc WHERE active GROUP BY ALL) b ON t.qid = b.qid AND t.doc_id = b.doc_id AND t.page_idx = b.page_idx AND t.token_idx = b.w GROUP BY ALL")
def token_winner_counts(f):
    return pruning.winner_counts(f.scores)


@query()
def prune_mmr(f):
    return rounded(pruning.mmr(_coarse(f), f.pages, 4), "coarse")


@query()
def prune_greedy(f):
    return rounded(pruning.greedy_maxsim(_coarse(f), f.scores, 4, candidates=8), "coarse")


@query()
def prune_coverage_mix(f):
    return rounded(pruning.coverage_mix(_coarse(f), f.scores, 5, 2), "coarse")


@query()
def coarse_prototype_max(f):
    return pruning.coarse_prototypes(f.pages, f.queries).select(*TOKEN, r("coarse"))


@query("SELECT qid, doc_id, page_idx, token_idx, round(coarse, 6) AS coarse_max, round(sqrt(list_dot_product(p.v, p.v)), 6) AS norm, (p.patch_idx IS NULL)::INT::DOUBLE AS off_grid, (p.pclass = 'visual')::INT::DOUBLE AS is_visual, round(coalesce((p.patch_idx // p.side) / greatest(p.side - 1, 1), 0), 6) AS row, round(coalesce((p.patch_idx % p.side) / greatest(p.side - 1, 1), 0), 6) AS \"column\" FROM co JOIN pt p USING (doc_id, page_idx, token_idx)")
def token_selector_features(f):
    return pruning.token_features(f.pages, f.queries, f.scores).select(*TOKEN, r("coarse_max"), r("norm"), "off_grid", "is_visual", r("row"), r("column"))


TOKEN_MODEL = {"feature_names": ["coarse_max", "norm", "is_visual", "row"], "feature_means": [0.1, 1.0, 0.3, 0.4], "feature_stds": [0.2, 0.0, 0.5, 0.3], "weights": [1.0, 0.2, 0.3, -0.1], "bias": 0.05}


@query("SELECT qid, doc_id, page_idx, token_idx, round(0.05 + (coarse - 0.1) / 0.2 + 0.2 * (sqrt(list_dot_product(p.v, p.v)) - 1) + 0.3 * ((p.pclass = 'visual')::INT - 0.3) / 0.5 - 0.1 * (coalesce((p.patch_idx // p.side) / greatest(p.side - 1, 1), 0) - 0.4) / 0.3, 6) AS score FROM co JOIN pt p USING (doc_id, page_idx, token_idx)")
def learned_token_scores(f):
    names = TOKEN_MODEL["feature_names"]
    by = lambda k: dict(zip(names, TOKEN_MODEL[k], strict=True))
    score = C.standardised({n: F.col(n) for n in names}, by("feature_means"), by("feature_stds"), by("weights"), TOKEN_MODEL["bias"])
    return pruning.token_features(f.pages, f.queries, f.scores).select(*TOKEN, r(score, "score"))


# Labels and channels


def _labels(f):
    """Label rows of every spatial patch, an older row of another class first."""
    grid = f.pages.where("patch_idx IS NOT NULL").select("doc_id", "page_idx", "patch_idx", "pclass", "vec_id")
    return grid.withColumn("pos", F.lit(1)).unionByName(grid.withColumns({"pclass": F.lit("unknown"), "pos": F.lit(0)}))


@query("SELECT doc_id, page_idx, count(*) AS tokens, max(side) AS side, count(*) - max(side) * max(side) AS extra, doc_id || '_page' || page_idx AS uid FROM pt GROUP BY doc_id, page_idx")
def page_geometry(f):
    side = C.grid_side("tokens")
    out = f.pages.groupBy("doc_id", "page_idx").agg(F.count("*").alias("tokens"))
    return out.select("doc_id", "page_idx", "tokens", side.alias("side"), (F.col("tokens") - side * side).alias("extra"), C.page_uid().alias("uid"))


@query("SELECT doc_id, page_idx, side, patch_idx, pclass FROM pt WHERE patch_idx IS NOT NULL")
def patch_class_grid(f):
    return channels.patch_grid(f.pages, _labels(f)).select("doc_id", "page_idx", "side", "patch_idx", "pclass")


@query("SELECT a.doc_id, a.page_idx, a.patch_idx, CASE WHEN a.pclass = 'unknown' AND bool_or(b.pclass = 'visual') THEN 'visual' ELSE a.pclass END AS pclass FROM pt a JOIN pt b ON a.doc_id = b.doc_id AND a.page_idx = b.page_idx AND abs(a.patch_idx // a.side - b.patch_idx // a.side) <= 1 AND abs(a.patch_idx % a.side - b.patch_idx % a.side) <= 1 GROUP BY a.doc_id, a.page_idx, a.patch_idx, a.pclass")
def patch_dilation(f):
    return channels.dilated(channels.patch_grid(f.pages, _labels(f)), 1).select("doc_id", "page_idx", "patch_idx", "pclass")


@query("SELECT doc_id, page_idx, count(*) FILTER (pclass = 'visual') AS visual, count(*) FILTER (pclass = 'non_visual') AS non_visual, count(*) FILTER (pclass = 'unknown') AS unknown FROM pt GROUP BY ALL")
def axis_class_counts(f):
    return f.pages.groupBy("doc_id", "page_idx").agg(*[F.count_if(F.col("pclass") == c).alias(c) for c in ("visual", "non_visual", "unknown")])


@query("SELECT qid, doc_id, page_idx, round(base, 6) AS base, round(visual, 6) AS visual, round(non_visual, 6) AS non_visual, round(grounded, 6) AS grounded, round(context, 6) AS context, round(balance, 6) AS balance, round(confirmed, 6) AS confirmed, round(multi_anchor, 6) AS multi_anchor, anchor_patches, grounded_patches, context_patches, round(anchor_coverage, 6) AS anchor_coverage, round(anchor_gap, 6) AS anchor_gap, round(anchor_bbox, 6) AS anchor_bbox, round(visual_alignment, 6) AS visual_alignment, round(non_visual_alignment, 6) AS non_visual_alignment FROM ft")
def channel_scores(f):
    shown = ["base", "visual", "non_visual", "grounded", "context", "balance", "confirmed", "multi_anchor"]
    out = channels.page_features(f.scores)
    return out.select(*PAGE, *map(r, shown), "anchor_patches", "grounded_patches", "context_patches", *map(r, ["anchor_coverage", "anchor_gap", "anchor_bbox", "visual_alignment", "non_visual_alignment"]))


@query("SELECT qid, doc_id, page_idx, anchor, round(anchor_score, 6) AS anchor_score FROM an")
def visual_anchors(f):
    return channels.anchors(f.scores).select(*PAGE, "anchor", r("anchor_score"))


@query("SELECT qid, doc_id, page_idx, round(visual * non_visual_avg, 6) AS by_non_visual, round(visual * grounded_avg, 6) AS by_grounded FROM ft")
def balance_modes(f):
    one = lambda mode, name: channels.page_features(f.scores, balance=mode).select(*PAGE, r("balance", name))
    return one("visual_x_nonvisual_avg", "by_non_visual").join(one("visual_x_grounded_nonvisual_avg", "by_grounded"), PAGE)


@query("SELECT qid, doc_id, page_idx, round(CASE WHEN confirmed >= 0.1 THEN non_visual ELSE 0 END, 6) AS primary, row_number() OVER (PARTITION BY qid ORDER BY (confirmed >= 0.1)::INT DESC, CASE WHEN confirmed >= 0.1 THEN non_visual ELSE 0 END DESC, multi_anchor DESC, confirmed DESC, visual DESC, grounded DESC, base DESC, doc_id || '_page' || page_idx DESC) AS prefilter_rank FROM ft")
def prefilter_order(f):
    return channels.prefilter(channels.page_features(f.scores), "non_visual_with_confirmed_visual_gate").select(*PAGE, r("primary"), "prefilter_rank")


@query("SELECT CASE WHEN gold.qid IS NOT NULL THEN true ELSE false END AS is_gold, count(*) AS pages, round(avg(base), 6) AS base, round(avg(visual), 6) AS visual, round(avg(balance), 6) AS balance FROM ft LEFT JOIN gold USING (qid, doc_id) GROUP BY 1")
def channel_means_by_gold(f):
    return rounded(analysis.channel_means(channels.page_features(f.scores), f.gold, ["base", "visual", "balance"]), "base", "visual", "balance")


# Ranking

WEIGHTS = ranking.Weights(1, 1, 0, 8)


@query("SELECT qid, doc_id, page_idx, round(fused, 6) AS fused, rank FROM fu")
def fused_pages(f):
    return ranking.fused_pages(channels.page_features(f.scores), WEIGHTS).select(*PAGE, r("fused"), "rank")


@query("SELECT qid, doc_id, round(doc_score, 6) AS doc_score, row_number() OVER (PARTITION BY qid ORDER BY doc_score DESC, best_base DESC, coalesce(second, 0) DESC, first) AS rank FROM (SELECT qid, doc_id, max(fused) FILTER (nth = 1) + coalesce(0.25 * max(fused) FILTER (nth = 2), 0) AS doc_score, max(base) FILTER (nth = 1) AS best_base, max(fused) FILTER (nth = 2) AS second, min(rank) AS first FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY rank) AS nth FROM fu) GROUP BY ALL)")
def fused_docs_top2(f):
    return ranking.fused_docs(ranking.fused_pages(channels.page_features(f.scores), WEIGHTS)).select("qid", "doc_id", r("doc_score"), "rank")


@query("SELECT qid, doc_id, page_idx, round(base + scale * (visual + 8 * balance), 6) AS fused, row_number() OVER (PARTITION BY qid ORDER BY base + scale * (visual + 8 * balance) DESC, base DESC, visual DESC, non_visual DESC, doc_id, page_idx) AS rank FROM (SELECT *, CASE WHEN stage1_rank > 5 OR top <= 0 THEN 0 ELSE least(greatest(base / top, 0), 1) END AS scale FROM (SELECT *, max(base) OVER (PARTITION BY qid) AS top FROM ft JOIN st USING (qid, doc_id)))")
def gated_fusion(f):
    return ranking.fused_pages(channels.page_features(f.scores), WEIGHTS, gate_docs=5, scale_by_base=True).select(*PAGE, r("fused"), "rank")


@query("SELECT qid, doc_id, page_idx, row_number() OVER (PARTITION BY qid ORDER BY confirmed DESC NULLS LAST, base DESC, doc_id || '_page' || page_idx DESC) AS rank FROM ft")
def scalar_ranking(f):
    return ranking.scalar_ranking(channels.page_features(f.scores), "confirmed").select(*PAGE, "rank")


@query("SELECT qid, doc_id, page_idx, round(CASE WHEN p.rank <= 10 THEN ex.score ELSE p.score END, 6) AS final, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN p.rank <= 10 THEN ex.score ELSE p.score END DESC, p.rank) AS rank FROM run_p p JOIN ex USING (qid, doc_id, page_idx)")
def two_stage_top_pages(f):
    approx = pruning.approx_scores(pruning.global_topk(_coarse(f), 4), f.scores)
    return ranking.refreshed(approx, f.rescored, top_pages=10).select(*PAGE, r("final"), "rank")


@query("SELECT qid, doc_id, page_idx, round(CASE WHEN doc_rank <= 3 THEN ex.score ELSE p.score END, 6) AS final, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN doc_rank <= 3 THEN ex.score ELSE p.score END DESC, p.rank) AS rank FROM run_p p JOIN ex USING (qid, doc_id, page_idx) JOIN doc_p USING (qid, doc_id)")
def two_stage_top_docs(f):
    approx = pruning.approx_scores(pruning.global_topk(_coarse(f), 4), f.scores)
    return ranking.refreshed(approx, f.rescored, top_docs=3).select(*PAGE, r("final"), "rank")


@query("SELECT qid, doc_id, page_idx, round(base, 6) AS exact_score, row_number() OVER (PARTITION BY qid ORDER BY base DESC, prefilter_rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN balance > 0 THEN balance ELSE visual END DESC, multi_anchor DESC, confirmed DESC, visual DESC, grounded DESC, base DESC, doc_id || '_page' || page_idx DESC) AS prefilter_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY base DESC, doc_id, page_idx) AS b FROM ft) WHERE b <= 30) WHERE prefilter_rank <= 8")
def visual_prefilter_exact(f):
    return ranking.prefilter_cascade(f.pages, f.queries, f.exact, 30, 8).select(*PAGE, r("exact_score"), "rank")


@query("SELECT qid, combo, w_visual, w_balance, first_gold, hits4, hits10, row_number() OVER (PARTITION BY qid ORDER BY (coalesce(first_gold, 1e12) > 4)::INT, coalesce(first_gold, 1e12), hits4 DESC, hits10 DESC, combo) AS place FROM (SELECT qid, combo, w_visual, w_balance, min(rank) FILTER (g) AS first_gold, count(*) FILTER (g AND rank <= 4) AS hits4, count(*) FILTER (g AND rank <= 10) AS hits10 FROM (SELECT *, row_number() OVER (PARTITION BY qid, combo ORDER BY b.f DESC, b.base DESC, doc_id) AS rank, EXISTS (SELECT 1 FROM gold WHERE gold.qid = d.qid AND gold.doc_id = d.doc_id) AS g FROM (SELECT qid, combo, w_visual, w_balance, doc_id, max({'f': base + w_visual * visual + w_balance * balance, 'base': base}) AS b FROM ft, (VALUES (0::BIGINT, 0::DOUBLE, 0::DOUBLE), (1, 0, 8), (2, 1, 0), (3, 1, 8)) c(combo, w_visual, w_balance) GROUP BY ALL) d) GROUP BY ALL) QUALIFY place <= 3")
def weight_grid_search(f):
    out = ranking.weight_grid(channels.page_features(f.scores), f.gold, {"base": [1], "visual": [0, 1], "non_visual": [0], "balance": [0, 8]}, top=3)
    return out.select("qid", "combo", "w_visual", "w_balance", "first_gold", "hits4", "hits10", "place")


@query("SELECT qid, doc_id, page_idx, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf, min(rank) AS best_rank, count(*) AS runs, row_number() OVER (PARTITION BY qid ORDER BY sum(1.0::DOUBLE / (60 + rank)) DESC, min(rank), max(score) DESC, doc_id, page_idx) AS rank FROM (SELECT * FROM run_e UNION ALL SELECT * FROM run_b) GROUP BY qid, doc_id, page_idx")
def rrf_fusion(f):
    return ranking.reciprocal_rank_fusion(f.run_exact.unionByName(f.run_baseline)).select(*PAGE, r("rrf"), "best_rank", "runs", "rank")


@query("SELECT qid, doc_id, page_idx, min(rank) AS best_rank, row_number() OVER (PARTITION BY qid ORDER BY min(rank), max(score) DESC, doc_id, page_idx) AS rank FROM (SELECT * FROM run_e UNION ALL SELECT * FROM run_b) GROUP BY qid, doc_id, page_idx")
def best_rank_fusion(f):
    return ranking.best_rank_fusion(f.run_exact.unionByName(f.run_baseline)).select(*PAGE, "best_rank", "rank")


_DF = "SELECT qid, doc_id, st.stage1_rank::DOUBLE AS stage1_rank, coalesce(max(doc_rank), (SELECT count(*) FROM st s WHERE s.qid = a.qid) + 1)::DOUBLE AS baseline_rank, count(*)::DOUBLE AS pages, max(base) AS max_base, avg(base) AS mean_base, max(base) - coalesce(max(base) FILTER (nth = 2), 0) AS top2_gap, max(visual) AS max_visual, avg(balance) AS mean_balance, max(visual_alignment) FILTER (nth = 1) AS best_visual_alignment FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY base DESC, page_idx) AS nth FROM ft) a JOIN st USING (qid, doc_id) LEFT JOIN doc_b USING (qid, doc_id) GROUP BY qid, doc_id, st.stage1_rank"


@query(f"SELECT qid, doc_id, stage1_rank, baseline_rank, pages, round(max_base, 6) AS max_base, round(mean_base, 6) AS mean_base, round(top2_gap, 6) AS top2_gap, round(max_visual, 6) AS max_visual, round(mean_balance, 6) AS mean_balance, round(best_visual_alignment, 6) AS best_visual_alignment FROM ({_DF})")
def doc_features(f):
    out = ranking.doc_features(channels.page_features(f.scores), ranking.doc_ranks(f.run_baseline))
    return out.select("qid", "doc_id", "stage1_rank", "baseline_rank", "pages", *map(r, ["max_base", "mean_base", "top2_gap", "max_visual", "mean_balance", "best_visual_alignment"]))


DOC_MODEL = {"feature_names": ["stage1_rank", "top2_gap", "max_visual"], "feature_means": [5.0, 0.2, 1.0], "feature_stds": [2.0, 0.5, 0.0], "weights": [-0.2, 0.1, 0.3], "bias": 0.1}


@query(f"SELECT qid, doc_id, round(learned, 6) AS learned, row_number() OVER (PARTITION BY qid ORDER BY (stage1_rank <= 5)::INT DESC, CASE WHEN stage1_rank <= 5 THEN learned END DESC NULLS LAST, stage1_rank) AS rank FROM (SELECT *, max_base + 0.1 - 0.2 * (stage1_rank - 5) / 2 + 0.1 * (top2_gap - 0.2) / 0.5 + 0.3 * (max_visual - 1) AS learned FROM ({_DF}))")
def learned_doc_scores(f):
    docs = ranking.doc_features(channels.page_features(f.scores), ranking.doc_ranks(f.run_baseline))
    return ranking.learned_docs(docs, DOC_MODEL, 5).select("qid", "doc_id", r("learned"), "rank")


@query("SELECT qid, doc_id, round(CASE WHEN rank <= 3 THEN score + 2 * ((rank % 2) * 0.75) ELSE -rank END, 6) AS final, row_number() OVER (PARTITION BY qid ORDER BY (rank <= 3)::INT DESC, CASE WHEN rank <= 3 THEN score + 2 * ((rank % 2) * 0.75) ELSE -rank END DESC, rank) AS final_rank FROM (SELECT qid, doc_id, max(score) AS score, row_number() OVER (PARTITION BY qid ORDER BY max(score) DESC, doc_id) AS rank FROM ex GROUP BY qid, doc_id)")
def evidence_rerank(f):
    docs = f.exact.groupBy("qid", "doc_id").agg(F.max("score").alias("doc_score")).withColumn("rank", C.ranked(["qid"], F.desc("doc_score"), "doc_id"))
    answers = docs.select("qid", "doc_id", C.evidence_score(F.when(F.col("rank") % 2 == 1, "I say yes").otherwise("")).alias("evidence"))
    return ranking.evidence_reranked(docs, answers, 2.0, 3).select("qid", "doc_id", r("final"), "final_rank")


# Evaluation


def _recall_sql(docs: str, rank: str, rows: str) -> str:
    return f"SELECT k, round(avg(r), 6) AS recall, count(*) AS queries FROM (SELECT g.qid, k, count(DISTINCT CASE WHEN {rank} <= k THEN d.doc_id END) / count(DISTINCT g.doc_id) AS r FROM gold g CROSS JOIN (VALUES (1), (2), (4), (10)) t(k) LEFT JOIN {rows} d ON d.qid = g.qid AND d.doc_id = g.doc_id GROUP BY ALL) GROUP BY k"


@query(f"SELECT k::BIGINT AS k, recall, queries FROM ({_recall_sql('', 'rank', 'run_e')})")
def recall_at_k(f):
    return rounded(evaluation.mean_recall(evaluation.recall_at(f.run_exact, f.gold, [1, 2, 4, 10])), "recall")


@query(f"SELECT k::BIGINT AS k, recall, queries FROM ({_recall_sql('', 'doc_rank', 'doc_e')})")
def recall_at_k_dedup(f):
    return rounded(evaluation.mean_recall(evaluation.recall_at(f.run_exact, f.gold, [1, 2, 4, 10], dedupe_first=True)), "recall")


@query("SELECT qid, min(doc_rank) AS first_gold, count(*) FILTER (doc_rank <= 4) AS hits4, count(*) FILTER (doc_rank <= 10) AS hits10, string_agg(doc_id || ':' || doc_rank, ',' ORDER BY doc_rank) AS ranks FROM doc_e JOIN gold USING (qid, doc_id) GROUP BY qid")
def gold_rank_summary(f):
    return evaluation.gold_summary(f.run_exact, f.gold)


@query("SELECT * FROM fg_b")
def first_gold_ranks(f):
    return evaluation.first_gold_ranks(f.run_baseline, f.gold)


@query("SELECT qid, rank, doc_id, page_idx FROM run_e SEMI JOIN gold USING (qid, doc_id) WHERE rank <= 20")
def gold_page_hits(f):
    return f.run_exact.where("rank <= 20").join(f.gold, ["qid", "doc_id"], "left_semi").select("qid", "rank", "doc_id", "page_idx")


@query("SELECT count(*) AS queries, count(first_doc) AS found, count(*) FILTER (first_doc <= 4) AS top4, avg(first_doc) AS mean_rank, median(first_doc) AS median_rank FROM fg_e")
def run_kpis(f):
    return evaluation.run_kpis(evaluation.first_gold_ranks(f.run_exact, f.gold))


def _both(f):
    """Both runs' gold ranks, each computed once."""
    return tuple(stored(evaluation.first_gold_ranks(run, f.gold), "ranks") for run in (f.run_baseline, f.run_exact))


_CMP = "SELECT qid, b.first_doc AS before, e.first_doc AS after, CASE WHEN b.first_doc IS NULL AND e.first_doc IS NULL THEN 'missing_in_both' WHEN b.first_doc IS NULL THEN 'newly_found' WHEN e.first_doc IS NULL THEN 'newly_lost' WHEN e.first_doc < b.first_doc THEN 'improved' WHEN e.first_doc > b.first_doc THEN 'worsened' ELSE 'unchanged' END AS movement, b.first_doc - e.first_doc AS gain FROM fg_b b JOIN fg_e e USING (qid)"


@query(_CMP)
def run_comparison(f):
    return evaluation.compare_runs(*_both(f))


@query(f"SELECT movement, count(*) AS queries, avg(gain) AS mean_gain FROM ({_CMP}) GROUP BY movement")
def movement_counts(f):
    return evaluation.movement_counts(evaluation.compare_runs(*_both(f)))


@query("SELECT qid, b.first_doc AS a, e.first_doc AS b, CASE WHEN b.first_doc < e.first_doc THEN 'a' WHEN e.first_doc < b.first_doc THEN 'b' ELSE 'tie' END AS winner FROM fg_b b JOIN fg_e e USING (qid)")
def run_winners(f):
    return evaluation.winners(*_both(f))


@query(f"SELECT * FROM ({_CMP}) WHERE (after IS NULL OR after > 4) AND movement IN ('worsened', 'unchanged', 'improved') AND before BETWEEN 1 AND 8")
def subset_filter(f):
    return analysis.subset(evaluation.compare_runs(*_both(f)), 1, 8, ["worsened", "unchanged", "improved"])


@query("SELECT qid, e.first_doc AS exact, p.first_doc AS pruned, CASE WHEN e.first_doc IS NULL THEN 'retrieval_missing' WHEN e.first_doc <= 4 THEN 'pruning_damage_exact_recovers_topk' WHEN p.first_doc - e.first_doc >= 5 THEN 'pruning_damage_exact_improves_but_still_fails' WHEN e.first_doc <= 10 THEN 'boundary_exact_still_fails' ELSE 'hard_fail_even_exact' END AS bucket FROM fg_e e JOIN fg_p p USING (qid) WHERE p.first_doc IS NULL OR p.first_doc > 1")
def failure_buckets(f):
    approx = retrieval.rank_pages(pruning.approx_scores(pruning.global_topk(_coarse(f), 4), f.scores))
    exact, pruned = (evaluation.first_gold_ranks(x, f.gold) for x in (f.run_exact, approx))
    both = exact.select("qid", F.col("first_doc").alias("exact")).join(pruned.select("qid", F.col("first_doc").alias("pruned")), "qid")
    return both.where("pruned IS NULL OR pruned > 1").withColumn("bucket", C.failure_bucket("exact", "pruned"))


@query("SELECT CASE WHEN q LIKE '% logo%' OR q LIKE '%logo %' OR q LIKE '%symbol%' OR q LIKE '%jersey%' OR q LIKE '%sponsor%' OR q LIKE '%crest%' THEN 'logo_symbol' WHEN q LIKE '%building%' OR q LIKE '%airport%' OR q LIKE '%venue%' OR q LIKE '%city%' OR q LIKE '%location%' OR q LIKE '%lawn%' OR q LIKE '%entrance%' OR q LIKE '%pier%' OR q LIKE '%inlet%' OR q LIKE '%seat%' OR q LIKE '%arch%' OR q LIKE '%stadium%' OR q LIKE '%ground%' THEN 'scene_building_location' ELSE 'other' END AS cue, count(*) AS questions FROM (SELECT lower(regexp_replace(question, '[ \\t\\n]+', ' ', 'g')) AS q FROM qs) GROUP BY 1")
def cue_types(f):
    return analysis.cue_counts(f.questions)


@query("SELECT count(*) AS queries, round(avg(b), 6) AS before_mean, round(avg(a), 6) AS after_mean, count(*) FILTER (a >= 1) AS after_full, count(*) FILTER (a > b) AS improved, count(*) FILTER (a < b) AS worsened, count(*) FILTER (a = b) AS unchanged, count(*) FILTER (b = 0 AND a > 0) AS rescued FROM (SELECT g.qid, count(DISTINCT b.doc_id) / count(DISTINCT g.doc_id) AS b, count(DISTINCT e.doc_id) / count(DISTINCT g.doc_id) AS a FROM gold g LEFT JOIN run_b b ON b.qid = g.qid AND b.doc_id = g.doc_id AND b.rank <= 10 LEFT JOIN run_e e ON e.qid = g.qid AND e.doc_id = g.doc_id AND e.rank <= 10 GROUP BY g.qid)")
def coverage_summary(f):
    out = evaluation.coverage_summary(evaluation.coverage(f.run_baseline, f.gold, 10), evaluation.coverage(f.run_exact, f.gold, 10))
    return out.select("queries", r("before_mean"), r("after_mean"), "after_full", "improved", "worsened", "unchanged", "rescued")


@query("SELECT qid, count(DISTINCT g.doc_id) AS n_gold, count(DISTINCT d.doc_id) AS hits, CASE WHEN count(DISTINCT d.doc_id) = 0 THEN 'none' WHEN count(DISTINCT d.doc_id) < count(DISTINCT g.doc_id) THEN 'partial' ELSE 'full' END AS outcome FROM gold g LEFT JOIN (SELECT * FROM doc_e WHERE doc_rank <= 4) d USING (qid, doc_id) GROUP BY qid")
def multigold_hits(f):
    return analysis.multigold(f.run_exact, f.gold, 4)


_HITS = "SELECT qid, doc_id, 'exact' AS label, doc_rank FROM doc_e JOIN gold USING (qid, doc_id) UNION ALL SELECT qid, doc_id, 'baseline', doc_rank FROM doc_b JOIN gold USING (qid, doc_id) UNION ALL SELECT qid, doc_id, 'pruned', doc_rank FROM doc_p JOIN gold USING (qid, doc_id)"


def _runs(f):
    return {"exact": f.run_exact, "baseline": f.run_baseline, "pruned": retrieval.rank_pages(pruning.approx_scores(pruning.global_topk(_coarse(f), 4), f.scores))}


@query(f"SELECT qid, n_gold, rh AS reference_hits, uh AS union_hits, uh = n_gold AND rh < n_gold AS recovered FROM (SELECT g.qid, count(DISTINCT g.doc_id) AS n_gold, count(DISTINCT CASE WHEN label = 'baseline' THEN h.doc_id END) AS rh, count(DISTINCT h.doc_id) AS uh FROM gold g LEFT JOIN (SELECT * FROM ({_HITS}) WHERE doc_rank <= 4) h ON g.qid = h.qid AND g.doc_id = h.doc_id GROUP BY g.qid)")
def union_hits(f):
    return analysis.union_hits(_runs(f), f.gold, 4, "baseline")


@query(f"SELECT combo, \"full\", hits, row_number() OVER (ORDER BY \"full\" DESC, hits DESC, combo) AS place FROM (SELECT combo, count(*) FILTER (h = n) AS \"full\", coalesce(sum(h), 0)::BIGINT AS hits FROM (SELECT combo, g.qid, count(DISTINCT g.doc_id) AS n, count(DISTINCT h.doc_id) AS h FROM (VALUES ('baseline+exact'), ('baseline+pruned'), ('exact+pruned')) c(combo) CROSS JOIN gold g LEFT JOIN (SELECT * FROM ({_HITS}) WHERE doc_rank <= 4) h ON g.qid = h.qid AND g.doc_id = h.doc_id AND list_contains(string_split(combo, '+'), h.label) GROUP BY ALL) GROUP BY combo)")
def budget_matched_unions(f):
    return analysis.budget_unions(_runs(f), f.gold, 8, 2)


@query("SELECT qid, count(*) FILTER (a = 'visual' AND b <> 'visual') AS only_a, count(*) FILTER (b = 'visual' AND a <> 'visual') AS only_b, count(*) FILTER (a <> b) AS changed FROM (SELECT qid, qclass AS a, CASE q_idx WHEN 4 THEN 'unknown' WHEN 5 THEN 'visual' ELSE qclass END AS b FROM qt) GROUP BY qid")
def label_version_diff(f):
    a = f.queries.select("qid", "q_idx", "qclass")
    b = a.withColumn("qclass", F.when(F.col("q_idx") == 4, "unknown").when(F.col("q_idx") == 5, "visual").otherwise(F.col("qclass")))
    return analysis.label_diff(a, b)


# Answers


def _answers(f):
    words = F.split("question", " ")
    gold = f.questions.select("qid", "qtype", F.slice(words, 1, 3).alias("g"))
    return gold.withColumn("p", F.when(F.col("qid") % 2 == 1, F.slice("g", 1, 2)).otherwise(F.col("g")))


@query("SELECT qid, round(CASE WHEN 2 * c / (np + ng) > 0 THEN 2 * c / (np + ng) ELSE 0 END, 6) AS f1 FROM (SELECT qid, len(list_intersect(p, g)) AS c, len(list_distinct(p)) AS np, len(list_distinct(g)) AS ng FROM (SELECT qid, g, CASE WHEN qid % 2 = 1 THEN g[1:2] ELSE g END AS p FROM (SELECT qid, string_split(question, ' ')[1:3] AS g FROM qs)))")
def answer_token_f1(f):
    return _answers(f).select("qid", r(evaluation.token_f1(F.col("p"), F.col("g")), "f1"))


@query()
def answer_em_f1(f):
    a = _answers(f)
    return evaluation.answer_scores(a.select("qid", F.array(F.array_join("g", " ")).alias("answers")), a.where("qid % 5 <> 0").select("qid", F.array(F.array_join("p", " ")).alias("answers")))


@query("SELECT qtype, hop, first_modality, second_modality, count(*) AS questions FROM qs JOIN dim USING (qtype) GROUP BY ALL")
def taxonomy_hops(f):
    return f.questions.join(F.broadcast(taxonomy(f.spark)), "qtype").groupBy("qtype", "hop", "first_modality", "second_modality").agg(F.count("*").alias("questions"))


# Routing


def _features(f):
    return routing.route_features(f.queries, f.questions)


@query("SELECT qid, visual_tokens, non_visual_tokens, unknown_tokens, tokens, informative_visual, round(CASE WHEN visual_tokens > 0 THEN informative_visual / visual_tokens ELSE 0 END, 6) AS share_of_visual, round(informative_visual / tokens, 6) AS share_of_all, qtype FROM rf JOIN qs USING (qid)")
def route_features(f):
    return _features(f).select("qid", *routing.NUMERIC[:5], r("share_of_visual"), r("share_of_all"), "qtype")


RULES = {"router_type": "rule_or", "default_route": "base", "visual_rules": [{"question_types": ["TextQ"], "min_informative_visual_count": 1}, {"any_informative_visual_tokens": ["tok11", "tok20"]}]}
LINEAR = {"router_type": "learned_linear", "feature_names": ["visual_tokens", "share_of_all"], "feature_means": [1.0, 0.1], "feature_stds": [1.0, 0.5], "weights": [0.7, -1.5], "bias": -0.2, "probability_threshold": 0.5, "default_route": "base", "candidate_route": "visual"}


@query("SELECT qid, CASE WHEN qtype = 'TextQ' OR qid IN (1, 2) THEN 'visual' ELSE 'base' END AS route, CASE WHEN qtype = 'TextQ' THEN 0 WHEN qid IN (1, 2) THEN 1 END::BIGINT AS rule FROM rf JOIN qs USING (qid)")
def route_rules(f):
    return routing.route(_features(f), RULES).select("qid", "route", "rule")


@query("SELECT qid, CASE WHEN p >= 0.5 THEN 'visual' ELSE 'base' END AS route, round(p, 6) AS probability FROM (SELECT qid, 1 / (1 + exp(-(-0.2 + 0.7 * (visual_tokens - 1) - 1.5 * (informative_visual / tokens - 0.1) / 0.5))) AS p FROM rf)")
def route_logistic(f):
    return routing.route(_features(f), LINEAR).select("qid", "route", r("probability"))


@query("SELECT rule, count(*) AS support, count(*) FILTER (winner = 'b') AS hits, round(count(*) FILTER (winner = 'b') / count(*), 6) AS precision, round(CASE WHEN t > 0 THEN count(*) FILTER (winner = 'b') / t ELSE 0 END, 6) AS recall FROM (SELECT DISTINCT rule, qid FROM (SELECT 'type=' || qtype AS rule, qid FROM rf JOIN qs USING (qid) UNION ALL SELECT 'word=' || replace(raw_token, '▁', ''), qid FROM qt WHERE qclass = 'visual' UNION ALL SELECT 'type=' || qtype || ' word=' || replace(raw_token, '▁', ''), qid FROM qt JOIN qs USING (qid) WHERE qclass = 'visual' UNION ALL SELECT 'informative_visual>=' || i, qid FROM rf, (VALUES (1), (2)) n(i) WHERE informative_visual >= i UNION ALL SELECT 'visual_tokens>=' || i, qid FROM rf, (VALUES (1), (2)) n(i) WHERE visual_tokens >= i)) JOIN (SELECT qid, CASE WHEN b.first_doc < e.first_doc THEN 'a' WHEN e.first_doc < b.first_doc THEN 'b' ELSE 'tie' END AS winner, count(*) FILTER (e.first_doc < b.first_doc) OVER () AS t FROM fg_b b JOIN fg_e e USING (qid)) USING (qid) GROUP BY rule, t")
def rule_mining(f):
    mined = routing.mine_rules(routing.candidate_rules(_features(f)), evaluation.winners(*_both(f)), "b")
    return rounded(mined, "precision", "recall")


@query("SELECT count(*) FILTER (coalesce(r, 1e12) <= 4) AS top4, count(*) FILTER (coalesce(r, 1e12) < coalesce(b, 1e12)) AS improved, count(*) FILTER (coalesce(r, 1e12) > coalesce(b, 1e12)) AS worsened, count(*) FILTER (route) AS routed, count(*) FILTER (coalesce(b, 1e12) <= 4) AS base_top4, count(*) FILTER (least(coalesce(b, 1e12), coalesce(e, 1e12)) <= 4) AS oracle_top4 FROM (SELECT qid, b.first_doc AS b, e.first_doc AS e, qtype = 'TextQ' OR qid IN (1, 2) AS route, CASE WHEN qtype = 'TextQ' OR qid IN (1, 2) THEN e.first_doc ELSE b.first_doc END AS r FROM fg_b b JOIN fg_e e USING (qid) JOIN qs USING (qid))")
def oracle_routing(f):
    return routing.objective(routing.routed(*_both(f), routing.route(_features(f), RULES)))


@query()
def greedy_rule_selection(f):
    rules = routing.candidate_rules(_features(f))
    chosen = routing.greedy_rules(rules, *_both(f))
    return f.spark.createDataFrame(list(enumerate(chosen, 1)), "step long, rule string")


@query()
def train_router(f):
    return routing.model_frame(f.spark, routing.train_router(_features(f), *_both(f)))


@query()
def train_doc_reranker(f):
    docs = ranking.doc_features(channels.page_features(f.scores), ranking.doc_ranks(f.run_baseline)).join(f.gold.withColumn("gold", F.lit(1.0)), ["qid", "doc_id"], "left").fillna(0.0, ["gold"])
    return routing.model_frame(f.spark, routing.train_pairs(docs, ["qid"], ["stage1_rank", "max_base", "top2_gap", "max_visual"], "gold", hard="stage1_rank"))


@query()
def train_token_selector(f):
    rows = pruning.token_features(f.pages, f.queries, f.scores).join(pruning.winner_counts(f.scores), TOKEN)
    return routing.model_frame(f.spark, routing.train_pairs(rows, PAGE, ["coarse_mean", "coarse_max", "norm", "is_visual"], "wins"))


# Corpus


@query("SELECT id, arg_max(url, (priority, pos)) AS url FROM (SELECT page_id AS id, url || '#text' AS url, 0 AS priority, page_id AS pos FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, url || '#image', 1, page_id FROM pages WHERE page_id % 5 < 3 UNION ALL SELECT page_id, url || '#table', 2, page_id FROM pages WHERE page_id % 7 < 2) WHERE url IS NOT NULL GROUP BY id")
def id_url_merge(f):
    pages = f.table("pages")
    part = lambda where, tag: pages.where(where).select(F.col("page_id").alias("id"), F.concat("url", F.lit(tag)).alias("url"), F.col("page_id").alias("pos"))
    return corpus.merge_mappings([part("page_id % 3 <> 0", "#text"), part("page_id % 5 < 3", "#image"), part("page_id % 7 < 2", "#table")])


@query("SELECT doc_id, count(*) AS questions FROM gold GROUP BY doc_id")
def split_doc_ids(f):
    return corpus.supporting_docs(f.gold)


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 3 AS shard FROM (SELECT DISTINCT doc_id FROM pt)")
def shard_assignment(f):
    return corpus.shard(f.pages.select("doc_id").distinct(), 3, "doc_id")


@query("SELECT DISTINCT qid, doc_id, page_idx FROM run_b JOIN doc_b USING (qid, doc_id) WHERE rank <= 5 OR doc_rank <= 2")
def candidate_pool(f):
    return corpus.candidate_pool(f.run_baseline, 5, 2)


@query("SELECT doc_id, page_idx, patch_idx, round_even((patch_idx % side) * 640 / side, 0)::BIGINT AS x0, round_even((patch_idx // side) * 480 / side, 0)::BIGINT AS y0, round_even((patch_idx % side + 1) * 640 / side, 0)::BIGINT AS x1, round_even((patch_idx // side + 1) * 480 / side, 0)::BIGINT AS y1 FROM pt WHERE patch_idx IS NOT NULL")
def patch_boxes(f):
    return corpus.page_boxes(f.pages, 640, 480)


@query("SELECT qid, q_idx, CASE raw_token WHEN '<bos>' THEN '[BOS]' WHEN '<pad>' THEN '[PAD]' ELSE replace(raw_token, '▁', ' ') END AS label, raw_token LIKE '▁tok%' OR raw_token = 'Question' AS informative FROM qt")
def token_labels(f):
    return f.queries.select("qid", "q_idx", C.token_label("raw_token").alias("label"), C.informative(C.token_label("raw_token")).alias("informative"))


@query("SELECT qid, rank, uid, regexp_extract(uid, '^(.*)_page(\\d+)$', 1) AS doc_id, regexp_extract(uid, '^(.*)_page(\\d+)$', 2)::INT AS page_idx FROM (SELECT qid, rank, doc_id || '_page' || page_idx AS uid FROM run_e) WHERE rank BETWEEN 3 AND 7")
def rank_window(f):
    uids = f.run_exact.where(F.col("rank").between(3, 7)).select("qid", "rank", C.page_uid().alias("uid"))
    return uids.select("*", C.uid_doc("uid").alias("doc_id"), C.uid_page("uid").alias("page_idx"))


# Whole plans and what is left


@query("SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, page_idx) AS rank, doc_id, page_idx, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, page_idx) AS i FROM (SELECT qid, doc_id, page_idx, sum(m) AS score FROM (SELECT qid, q_idx, doc_id, page_idx, max(s) AS m FROM sc WHERE raw_token NOT IN ('<pad>', '<bos>', '<eos>') GROUP BY ALL) GROUP BY ALL)) WHERE i = 1 QUALIFY rank <= 3")
def retrieve_one_page_per_doc(f):
    config = RetrievalConfig(mode="exact", k=3, token_filter="drop_pad_like", one_page_per_doc=True)
    return retrieve(f.pages, f.queries, config).select("qid", "rank", "doc_id", "page_idx", r("score"))


@query("SELECT qid, doc_id, page_idx, round(base, 6) AS base, round(base + visual + 8 * balance, 6) AS fused, row_number() OVER (PARTITION BY qid ORDER BY base + visual + 8 * balance DESC, base DESC, visual DESC, non_visual DESC, doc_id, page_idx) AS rank FROM (SELECT ft.* EXCLUDE (base), CASE WHEN p.rank <= 10 THEN ex.score ELSE p.score END AS base FROM ft JOIN run_p p USING (qid, doc_id, page_idx) JOIN ex USING (qid, doc_id, page_idx))")
def rerank_pipeline(f):
    pages, _ = rerank(f.pages, f.queries, RerankConfig(selector_k=4, weights=WEIGHTS, refresh_pages=10))
    return pages.select(*PAGE, r("base"), r("fused"), "rank")


@query()
def page_explanations(f):
    return explain(f.scores, f.run_exact)


@query("SELECT qid, doc_id || '_page' || page_idx AS uid, mode, rank AS prefilter_rank, round(p, 6) AS primary FROM (SELECT *, row_number() OVER (PARTITION BY qid, mode ORDER BY p DESC, multi_anchor DESC, confirmed DESC, visual DESC, grounded DESC, base DESC, doc_id || '_page' || page_idx DESC) AS rank FROM (SELECT *, 'visual_only' AS mode, visual AS p FROM ft UNION ALL SELECT *, 'non_visual_only', non_visual FROM ft)) WHERE doc_id || '_page' || page_idx IN ('d0_page0', 'd3_page2')")
def inspect_pages(f):
    return inspect(channels.page_features(f.scores), ["d0_page0", "d3_page2"], ["visual_only", "non_visual_only"]).withColumn("primary", r("primary"))


@query("SELECT qid, doc_id, page_idx, round(sum(CASE WHEN place <= 4 THEN wins ELSE 0 END) / sum(wins), 6) AS recall FROM cr JOIN (SELECT qid, doc_id, page_idx, w AS token_idx, count(*) AS wins FROM (SELECT qid, doc_id, page_idx, q_idx, arg_max(token_idx, (s, -token_idx)) AS w FROM sc WHERE active GROUP BY ALL) GROUP BY ALL) USING (qid, doc_id, page_idx, token_idx) GROUP BY qid, doc_id, page_idx")
def selector_recall(f):
    return rounded(pruning.selector_recall(pruning.best_first(_coarse(f)), pruning.winner_counts(f.scores), 4), "recall")


@query("SELECT unnest(['base', 'visual']) AS feature, unnest([round(avg(base), 6), round(avg(visual), 6)]) AS mean, unnest([round(sqrt(greatest(var_pop(base), 1e-6)), 6), round(sqrt(greatest(var_pop(visual), 1e-6)), 6)]) AS std FROM ft")
def feature_moments(f):
    return rounded(pruning.moments(channels.page_features(f.scores), ["base", "visual"]), "mean", "std")


@query("SELECT word, count(DISTINCT qid) AS queries FROM (SELECT qid, replace(raw_token, '▁', '') AS word FROM qt WHERE qclass = 'visual' AND raw_token LIKE '▁%') GROUP BY word")
def router_vocabulary(f):
    return routing.vocabulary(_features(f))


@query("SELECT qid, gain, CASE WHEN first_doc <= 2 THEN 'strong' WHEN first_doc <= 4 AND anchored THEN 'borderline' WHEN gain >= 100 THEN 'useful_but_not_reliable' ELSE 'weak' END AS verdict FROM (SELECT e.qid, e.first_doc, b.first_doc - e.first_doc AS gain, EXISTS (SELECT 1 FROM an WHERE an.qid = e.qid) AS anchored FROM fg_e e JOIN fg_b b USING (qid))")
def reliability_audit(f):
    base, exact = _both(f)
    anchored = channels.anchors(f.scores).select("qid").distinct().withColumn("grounded", F.lit(True))
    both = exact.select("qid", F.col("first_doc").alias("rank")).join(base.select("qid", F.col("first_doc").alias("b")), "qid").join(anchored, "qid", "left").fillna(False, ["grounded"])
    return routing.audit(both.withColumn("gain", F.col("b") - F.col("rank")), 2).select("qid", "gain", "verdict")
