"""Label-aware page features: visual, non-visual, grounded and context scores, anchors, balance and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

KEY = ["qid", "doc_id", "page_idx"]


def patch_grid(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Every patch of every page with its class: the last label row (`pos`) of a patch counts, off-grid ones are dropped, none is `unknown`."""
    grid = pages.groupBy("doc_id", "page_idx").agg(F.max("side").alias("side")).where("side > 0")
    grid = grid.select("doc_id", "page_idx", "side", F.explode(F.expr("sequence(0, side * side - 1)")).alias("patch_idx"))
    last = labels.groupBy("doc_id", "page_idx", "patch_idx").agg(F.max_by("pclass", "pos").alias("pclass"))
    return grid.join(last, ["doc_id", "page_idx", "patch_idx"], "left").withColumn("pclass", F.coalesce("pclass", F.lit("unknown")))


def within(a: str, b: str, side: str, radius: int) -> Column:
    """Whether two patches of a grid are at most `radius` rows and columns apart; a radius of 0 or less reaches nothing."""
    if radius <= 0:
        return F.lit(False)
    row = lambda p: F.floor(F.col(p) / F.col(side))
    column = lambda p: F.col(p) % F.col(side)
    return (F.abs(row(a) - row(b)) <= radius) & (F.abs(column(a) - column(b)) <= radius)


def dilated(grid: DataFrame, radius: int, include_non_visual: bool = False) -> DataFrame:
    """Patches near an original visual patch become visual; non-visual ones only if asked. Growth does not feed itself."""
    page = ["doc_id", "page_idx"]
    seeds = grid.where("pclass = 'visual'").select(*page, F.col("patch_idx").alias("seed"))
    near = grid.join(seeds, page).where(within("patch_idx", "seed", "side", radius)).select(*page, "patch_idx").distinct().withColumn("near", F.lit(True))
    grows = F.col("near") & ((F.col("pclass") == "unknown") | F.lit(include_non_visual))
    return grid.join(near, [*page, "patch_idx"], "left").withColumn("pclass", F.when(grows, "visual").otherwise(F.col("pclass"))).drop("near")


def anchors(scores: DataFrame) -> DataFrame:
    """Visual query tokens' best visual patches: KEY, anchor, score (summed over the query tokens that chose it)."""
    picks = scores.where("active AND qclass = 'visual' AND pclass = 'visual'").groupBy(*KEY, "q_idx").agg(F.max(F.struct("s", (-F.col("token_idx")).alias("t"), "patch_idx")).alias("b"))
    return picks.where("b.patch_idx IS NOT NULL").groupBy(*KEY, F.col("b.patch_idx").alias("anchor")).agg(F.sum("b.s").alias("anchor_score"))


def page_features(scores: DataFrame, radius: int = 1, fallback_weight: float = 0.0, all_query: bool = False, all_non_visual: bool = False, balance: str = "min_avg") -> DataFrame:
    """All channel features of each (query, page), from the token score table."""
    # Many aggregates read the score table: it is computed once.
    live = stored(scores.where("active").select(*KEY, "q_idx", "qclass", "active", "token_idx", "patch_idx", "side", "pclass", "s"), "scores")
    non_visual_patch = (F.col("pclass") != "visual") & F.col("patch_idx").isNotNull() if all_non_visual else F.col("pclass") == "non_visual"
    visual_query = F.lit(True) if all_query else F.col("qclass") == "visual"
    peak = lambda c: F.max(F.when(c, F.col("s")))
    token = live.groupBy(*KEY, "q_idx", "qclass").agg(
        F.max("s").alias("base"), peak((F.col("pclass") == "visual") & visual_query).alias("vis"), peak(visual_query).alias("fall"), peak(non_visual_patch & (F.col("qclass") == "non_visual")).alias("nonv"),
        F.max(F.struct("s", (-F.col("token_idx")).alias("t"), "pclass")).alias("top"),
        F.count_if(F.col("pclass") == "visual").alias("vp"), F.count_if(non_visual_patch).alias("np"), F.max("side").alias("side"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    is_v, is_n = F.col("qclass") == "visual", F.col("qclass") == "non_visual"
    page = token.groupBy(*KEY).agg(
        total("base").alias("base"), total("vis").alias("visual_labeled"), total("fall").alias("visual_fallback"), total("nonv").alias("non_visual"),
        F.count_if(is_v).alias("visual_queries"), F.count_if(is_n).alias("non_visual_queries"), F.count("*").alias("queries"),
        F.max("vp").alias("visual_patches"), F.max("np").alias("non_visual_patches"), F.max("side").alias("side"),
        F.count_if(is_v & (F.col("top.pclass") == "visual")).alias("visual_aligned"), F.count_if(is_n & (F.col("top.pclass") == "non_visual")).alias("non_visual_aligned"),
    )
    anchor = stored(anchors(live), "anchors")
    # Context: tokens near an anchor; per anchor, then over any of them.
    near = live.where("patch_idx IS NOT NULL").join(anchor, KEY).where(within("patch_idx", "anchor", "side", radius))
    around = near.groupBy(*KEY, "anchor", "anchor_score", "q_idx").agg(F.max("s").alias("m")).groupBy(*KEY, "anchor", "anchor_score").agg(F.sum("m").alias("context"))
    grounded = near.groupBy(*KEY, "q_idx").agg(F.max("s").alias("m"), peak(non_visual_patch & is_n).alias("g")).groupBy(*KEY).agg(F.sum("m").alias("context"), total("g").alias("grounded"))
    tokens = near.select(*KEY, "token_idx", non_visual_patch.alias("nv")).distinct().groupBy(*KEY).agg(F.count("*").alias("context_patches"), F.count_if("nv").alias("grounded_patches"))
    row, column = F.floor(F.col("anchor") / F.col("side")), F.col("anchor") % F.col("side")
    spread = anchor.join(page.select(*KEY, "side"), KEY).groupBy(*KEY).agg(
        F.count("*").alias("anchor_patches"), F.sort_array(F.collect_list("anchor_score"), False).alias("tops"),
        ((F.max(row) - F.min(row) + 1) * (F.max(column) - F.min(column) + 1)).alias("bbox"),
    )
    local = around.join(page.select(*KEY, "queries"), KEY).groupBy(*KEY).agg(F.sum(F.when((F.col("anchor_score") > 0) & (F.col("context") > 0), F.col("anchor_score") * F.col("context") / F.col("queries"))).alias("multi"))
    out = page
    for part in (grounded, tokens, spread, local):
        out = out.join(part, KEY, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = out.withColumns({"visual": F.greatest(F.col("visual_labeled"), fallback_weight * F.col("visual_fallback")), "grounded": zero("grounded"), "context": zero("context"), "anchor_patches": none("anchor_patches"), "score_queries": F.col("queries") if all_query else F.col("visual_queries")})
    out = out.withColumns({"visual_avg": ratio("visual", "score_queries"), "non_visual_avg": ratio("non_visual", "non_visual_queries"), "grounded_avg": ratio("grounded", "non_visual_queries"), "context_avg": ratio("context", "queries")})
    balances = {"min_avg": F.least("visual_avg", "non_visual_avg"), "visual_x_nonvisual_avg": F.col("visual") * F.col("non_visual_avg"), "visual_x_grounded_nonvisual_avg": F.col("visual") * F.col("grounded_avg")}
    top = lambda i: F.coalesce(F.get("tops", F.lit(i)), F.lit(0.0))
    return out.select(
        *KEY, "base", "visual", "visual_labeled", "visual_fallback", "non_visual", "grounded", "context", "visual_avg", "non_visual_avg", "grounded_avg", "context_avg",
        F.when((F.col("visual_queries") > 0) & (F.col("non_visual_queries") > 0), balances[balance]).otherwise(0.0).alias("balance"),
        F.when((F.col("visual") > 0) & (F.col("context_avg") > 0), F.col("visual") * F.col("context_avg")).otherwise(0.0).alias("confirmed"),
        zero("multi").alias("multi_anchor"), "visual_queries", "non_visual_queries", "visual_patches", "non_visual_patches", none("grounded_patches").alias("grounded_patches"), none("context_patches").alias("context_patches"), "anchor_patches",
        ratio("anchor_patches", "visual_queries").alias("anchor_coverage"), (top(0) - top(1)).alias("anchor_gap"), F.coalesce(F.col("bbox") / F.greatest(F.col("side") * F.col("side"), F.lit(1)), F.lit(0.0)).alias("anchor_bbox"),
        "visual_aligned", ratio("visual_aligned", "visual_queries").alias("visual_alignment"), "non_visual_aligned", ratio("non_visual_aligned", "non_visual_queries").alias("non_visual_alignment"),
    )


PREFILTERS = {
    "balance_then_visual": lambda t: F.when(F.col("balance") > 0, F.col("balance")).otherwise(F.col("visual")),
    "balance_only": lambda t: F.col("balance"),
    "visual_only": lambda t: F.col("visual"),
    "non_visual_only": lambda t: F.col("non_visual"),
    "grounded_non_visual_only": lambda t: F.col("grounded"),
    "confirmed_visual_only": lambda t: F.col("confirmed"),
    "multi_anchor_confirmed_visual_only": lambda t: F.col("multi_anchor"),
    "non_visual_with_confirmed_visual_gate": lambda t: F.when(F.col("confirmed") >= t, F.col("non_visual")).otherwise(0.0),
    "non_visual_with_multi_anchor_confirmed_visual_gate": lambda t: F.when(F.col("multi_anchor") >= t, F.col("non_visual")).otherwise(0.0),
}


def prefilter(features: DataFrame, mode: str = "balance_then_visual", threshold: float = 0.1) -> DataFrame:
    """`features` with gate, primary and prefilter_rank by a mode's eight descending keys."""
    from ..functions.columns import page_uid, ranked

    gated = {"non_visual_with_confirmed_visual_gate": "confirmed", "non_visual_with_multi_anchor_confirmed_visual_gate": "multi_anchor"}.get(mode)
    out = features.withColumns({"gate": (F.col(gated) >= threshold).cast("double") if gated else F.lit(1.0), "primary": PREFILTERS[mode](threshold).cast("double"), "uid": page_uid()})
    keys = ["gate", "primary", "multi_anchor", "confirmed", "visual", "grounded", "base", "uid"]
    return out.withColumn("prefilter_rank", ranked(["qid"], *map(F.desc, keys))).drop("uid")
