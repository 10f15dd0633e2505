"""Token pruning: coarse scores, selectors of a page's best tokens, and what pruning costs.

Selectors take `coarse`: a row per query and page token (qid, doc_id, page_idx, token_idx, coarse, …) and return the rows that
stay. Windows are per (query, page), and pages are of bounded size. Three selectors are sequential by nature (each choice
depends on those before) and run as one Arrow pass over a page's tokens.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import norm, quadrant, ranked
from .retrieval import mean_vectors, token_scores

KEY = ["qid", "doc_id", "page_idx"]
TOKEN = [*KEY, "token_idx"]


def coarse_token_max(scores: DataFrame) -> DataFrame:
    """Best score over the active query tokens."""
    kept = [c for c in ("patch_idx", "side", "n", "pclass") if c in scores.columns]
    return scores.where("active").groupBy(*TOKEN, *kept).agg(F.max("s").alias("coarse"))


def coarse_query_mean(pages: DataFrame, queries: DataFrame, weight: Column | None = None) -> DataFrame:
    """Dot product with the (weighted) mean of the active query tokens."""
    mean = mean_vectors(queries.where("active"), ["qid"], weight).withColumn("q_idx", F.lit(0).cast("long"))
    kept = [c for c in ("patch_idx", "side", "n", "pclass") if c in pages.columns]
    return token_scores(pages, mean, kept).withColumnRenamed("s", "coarse").drop("q_idx")


def coarse_prototypes(pages: DataFrame, queries: DataFrame, count: int = 4) -> DataFrame:
    """Best score over the prototypes of each query's active tokens."""
    kept = [c for c in ("patch_idx", "side", "n", "pclass") if c in pages.columns]
    return token_scores(pages, query_prototypes(queries, count), kept).groupBy(*TOKEN, *kept).agg(F.max("s").alias("coarse"))


def query_prototypes(queries: DataFrame, count: int = 4, rounds: int = 4) -> DataFrame:
    """Per query: farthest-first seeds (largest norm, then the token least like any seed), then rounds of means by dot assignment."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame.sort_values("q_idx").emb.to_numpy()).astype(float)
        seeds = [int(np.linalg.norm(x, axis=1).argmax())]
        while len(seeds) < min(count, len(x)):
            like = (x @ x[seeds].T).max(1)
            like[seeds] = np.inf
            seeds.append(int(like.argmin()))
        c = x[seeds].copy()
        for _ in range(rounds):
            near = (x @ c.T).argmax(1)
            for i in range(len(c)):
                if (near == i).any():
                    c[i] = x[near == i].mean(0)
        return pd.DataFrame({"qid": key[0], "q_idx": range(len(c)), "emb": list(c)})

    kind = dict(queries.dtypes)["qid"]
    return queries.where("active").groupBy("qid").applyInPandas(run, f"qid {kind}, q_idx long, emb array<double>")


def best_first(coarse: DataFrame, score: str = "coarse", name: str = "place") -> DataFrame:
    return coarse.withColumn(name, ranked(KEY, F.desc(score), "token_idx"))


def global_topk(coarse: DataFrame, k: int | str, score: str = "coarse") -> DataFrame:
    """A page's k best tokens; k may name a column."""
    return best_first(coarse, score).where(F.col("place") <= (F.col(k) if isinstance(k, str) else k)).drop("place")


def _fill(flagged: DataFrame, k: int) -> DataFrame:
    """`chosen` tokens, then the coarse-best others up to k; of more than k, the coarse-best."""
    order = flagged.withColumn("place", ranked(KEY, F.desc(F.col("chosen").cast("int")), F.desc("coarse"), "token_idx"))
    return order.where(F.col("place") <= k).drop("place", "chosen")


def nonspatial(coarse: DataFrame, k: int, policy: str = "keep") -> DataFrame:
    """global_topk with a policy for tokens off the patch grid: keep, drop_all, or force_include_all (beside k spatial ones)."""
    spatial = F.col("patch_idx").isNotNull()
    if policy == "keep":
        return global_topk(coarse, k)
    if policy == "drop_all":
        return global_topk(coarse.where(spatial), k)
    if policy == "force_include_all":
        return global_topk(coarse.where(spatial), k).unionByName(coarse.where(~spatial))
    raise ValueError(f"no non-spatial policy {policy!r}")


def quadrant_mix(coarse: DataFrame, k: int, reserve: int) -> DataFrame:
    """k - reserve tokens by coarse score, `reserve` shared out over the grid's quadrants (first ones get the rest), filled by coarse score."""
    reserve = min(reserve, k)
    q = coarse.withColumn("quad", quadrant("patch_idx", "side"))
    q = best_first(q).withColumn("in_quad", F.row_number().over(Window.partitionBy(*KEY, "quad").orderBy(F.desc("coarse"), "token_idx")))
    quota = reserve // 4 + F.when(F.col("quad") < reserve % 4, 1).otherwise(0)
    chosen = (F.col("place") <= k - reserve) | F.coalesce(F.col("in_quad") <= quota, F.lit(False)) & F.col("quad").isNotNull()
    return _fill(q.withColumn("chosen", chosen).drop("place", "in_quad", "quad"), k)


def label_mix(coarse: DataFrame, visual: DataFrame, k: int, reserve: int) -> DataFrame:
    """k - reserve tokens by coarse score and `reserve` by their best visual query token (`visual`: TOKEN, vq), filled by coarse score."""
    reserve = min(reserve, k)
    both = coarse.join(visual, TOKEN, "left")
    both = best_first(best_first(both), "vq", "by_label") if reserve else best_first(both).withColumn("by_label", F.lit(1))
    chosen = (F.col("place") <= k - reserve) | (F.col("vq").isNotNull() & (F.col("by_label") <= reserve))
    return _fill(both.withColumn("chosen", chosen).drop("place", "by_label", "vq"), k)


def visual_query_scores(scores: DataFrame) -> DataFrame:
    """TOKEN, vq: best score over the query's visual tokens."""
    return scores.where("qclass = 'visual'").groupBy(*TOKEN).agg(F.max("s").alias("vq"))


def soft_label_prior(coarse: DataFrame, visual: DataFrame, k: int, weight: float = 0.5, bonus: float = 0.2, patches_only: bool = False) -> DataFrame:
    """Top k of coarse + weight * visual-query score + bonus on visual patches; `patches_only` adds either on visual patches alone."""
    on_patch = F.col("pclass") == "visual"
    vq = weight * F.coalesce("vq", F.lit(0.0))
    added = F.when(on_patch, vq + bonus).otherwise(0.0) if patches_only else vq + F.when(on_patch, bonus).otherwise(0.0)
    return global_topk(coarse.join(visual, TOKEN, "left").withColumn("prior", F.col("coarse") + added), k, "prior").drop("vq", "prior")


def _softmaxed(coarse: DataFrame, keys: list[str] = KEY) -> DataFrame:
    w = Window.partitionBy(*keys)
    e = F.exp(F.col("coarse") - F.max("coarse").over(w))
    return coarse.withColumn("e", e).withColumn("prob", F.col("e") / F.sum("e").over(w))


def adaptive_k(coarse: DataFrame, mode: str, kmin: int, kmax: int) -> DataFrame:
    """KEY, k: how many tokens a page needs, from the entropy or the concentration of its coarse scores."""
    sized = coarse.withColumn("tokens", F.count("*").over(Window.partitionBy(*KEY)))
    low = F.least(F.greatest(F.lit(kmin), F.lit(1)), F.col("tokens"))
    high = F.least(F.greatest(F.lit(kmax), low), F.col("tokens"))
    if mode == "entropy":
        p = F.col("prob")
        parts = _softmaxed(sized).groupBy(*KEY, "tokens").agg((-F.sum(p * F.ln(F.greatest(p, F.lit(1e-12))))).alias("h"))
        share = F.col("h") / F.greatest(F.ln(F.col("tokens").cast("double")), F.lit(1e-6))
    elif mode == "concentration":
        pool = F.least(F.greatest(high, F.lit(64)), F.col("tokens"))
        top = best_first(sized).where(F.col("place") <= pool)
        mass = F.sum("prob").over(Window.partitionBy(*KEY).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        parts = _softmaxed(top).withColumn("mass", mass).groupBy(*KEY, "tokens").agg(F.count_if(F.col("mass") < 0.5).alias("before"), F.count("*").alias("pool"))
        share = F.col("before") / F.greatest(F.col("pool") - 1, F.lit(1))
    else:
        raise ValueError(f"no adaptive mode {mode!r}")
    share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    return parts.select(*KEY, F.least(F.greatest(F.bround(low + share * (high - low)), low), high).cast("long").alias("k"))


def adaptive_topk(coarse: DataFrame, mode: str, kmin: int, kmax: int) -> DataFrame:
    return global_topk(coarse.join(adaptive_k(coarse, mode, kmin, kmax), KEY), "k").drop("k")


def _by_page(df: DataFrame, choose) -> DataFrame:
    """Apply `choose` (frame ordered by token -> chosen positions) to the tokens of each (query, page)."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in TOKEN) + ", coarse double, pick long"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("token_idx").reset_index(drop=True)
        picks = choose(frame)
        out = frame.iloc[picks][[*TOKEN, "coarse"]].copy()
        out["pick"] = range(1, len(picks) + 1)
        return out

    return df.groupBy(*KEY).applyInPandas(run, schema)


def mmr(coarse: DataFrame, pages: DataFrame, k: int, penalty: float = 0.1) -> DataFrame:
    """Greedy relevance less `penalty` times the largest positive cosine to what is chosen."""

    def choose(frame):
        x = np.stack(frame.emb.to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        score = frame.coarse.to_numpy()
        like, free, picks = np.zeros(len(x)), np.ones(len(x), bool), []
        while len(picks) < min(k, len(x)):
            best = int(np.where(free, score - penalty * like, -np.inf).argmax())
            picks.append(best)
            free[best] = False
            like = np.maximum(like, x @ x[best])
        return picks

    return _by_page(coarse.select(*TOKEN, "coarse").join(pages.select("doc_id", "page_idx", "token_idx", "emb"), ["doc_id", "page_idx", "token_idx"]), choose)


def _token_matrices(coarse: DataFrame, scores: DataFrame) -> DataFrame:
    """Coarse rows with their scores against the active query tokens, in order of q_idx."""
    rows = scores.where("active").groupBy(*TOKEN).agg(F.array_sort(F.collect_list(F.struct("q_idx", "s"))).alias("qs"))
    return coarse.select(*TOKEN, "coarse").join(rows, TOKEN).select(*TOKEN, "coarse", F.transform("qs", lambda x: x["s"]).alias("row"))


def greedy_maxsim(coarse: DataFrame, scores: DataFrame, k: int, candidates: int = 0, target: float = 0.0) -> DataFrame:
    """Lazy greedy cover of the query tokens' shifted scores by at most k of the coarse-best `candidates`; stops at `target` of the full score."""
    pool = global_topk(coarse, candidates) if candidates else coarse

    def choose(frame):
        m = np.stack(frame.row.to_numpy()).astype(float)
        m = m + np.maximum(0, -m.min(0))
        score, full = frame.coarse.to_numpy(), m.max(0).sum()
        best, picks = np.zeros(m.shape[1]), []
        heap = [(-g, i, 0) for i, g in enumerate(m.sum(1))]
        heapq.heapify(heap)
        while heap and len(picks) < min(k, len(m)):
            if target and full > 0 and best.sum() / full >= target:
                break
            gain, i, seen = heapq.heappop(heap)
            if seen < len(picks):
                heapq.heappush(heap, (-np.maximum(m[i] - best, 0).sum(), i, len(picks)))
                continue
            if -gain <= 0:
                break
            picks.append(i)
            best = np.maximum(best, m[i])
        if not target:
            rest = [i for i in np.argsort(-score, kind="stable") if i not in set(picks)]
            picks += rest[: k - len(picks)]
        return [int(i) for i in picks]

    return _by_page(_token_matrices(pool, scores), choose)


def coverage_mix(coarse: DataFrame, scores: DataFrame, k: int, reserve: int) -> DataFrame:
    """k - reserve tokens by coarse score, then `reserve` in turns: each informative query token's next best one; filled by coarse score."""
    reserve = min(reserve, k)

    def choose(frame):
        m, score = np.stack(frame.row.to_numpy()).astype(float), frame.coarse.to_numpy()
        order = [int(i) for i in np.argsort(-score, kind="stable")]
        picks = order[: k - reserve]
        taken = set(picks)
        priority = np.argsort(-m.max(0), kind="stable")
        lists = [list(np.argsort(-m[:, j], kind="stable")) for j in priority]
        while len(picks) < k and any(lists):
            for own in lists:
                while own and int(own[0]) in taken:
                    own.pop(0)
                if own and len(picks) < k:
                    taken.add(int(own[0]))
                    picks.append(int(own.pop(0)))
        return picks + [i for i in order if i not in taken][: max(0, k - len(picks))]

    return _by_page(_token_matrices(coarse, scores), choose)


def approx_scores(selected: DataFrame, scores: DataFrame) -> DataFrame:
    """Exact MaxSim over the surviving tokens, with the sum of their coarse scores."""
    best = scores.where("active").join(selected.select(*TOKEN, "coarse"), TOKEN).groupBy(*KEY, "q_idx").agg(F.max("s").alias("best"))
    coarse = selected.groupBy(*KEY).agg(F.sum("coarse").alias("coarse_sum"), F.count("*").alias("kept"))
    return best.groupBy(*KEY).agg(F.sum("best").alias("score")).join(coarse, KEY)


def diagnostics(selected: DataFrame, scores: DataFrame) -> DataFrame:
    """Per (query, page): full and pruned scores, loss, shifted preservation and how many winners survive."""
    marked = scores.where("active").join(selected.select(*TOKEN, F.lit(True).alias("kept")), TOKEN, "left")
    per = marked.groupBy(*KEY, "q_idx").agg(
        F.max("s").alias("full"), F.max(F.when(F.col("kept"), F.col("s"))).alias("pruned"), F.greatest(-F.min("s"), F.lit(0.0)).alias("shift"),
        F.max(F.struct("s", (-F.col("token_idx")).alias("t"), "kept")).alias("winner"), F.count("*").alias("tokens"), F.count("kept").alias("selected"),
    )
    shifted = lambda c: F.sum(F.col(c) + F.col("shift"))
    return per.groupBy(*KEY).agg(
        F.max("tokens").alias("full_tokens"), F.max("selected").alias("selected_tokens"), F.sum("full").alias("full_score"), F.sum("pruned").alias("pruned_score"),
        F.sum(F.col("full") - F.col("pruned")).alias("loss"), F.when(shifted("full") > 1e-8, shifted("pruned") / shifted("full")).alias("preservation"),
        F.count_if(F.col("winner.kept")).alias("retained"), (F.count_if(F.col("winner.kept")) / F.count("*")).alias("retention"),
    )


def diagnostics_summary(pages: DataFrame) -> DataFrame:
    """Per query: means over its pages; `diagnostics_total` weighs queries by their page counts."""
    return pages.groupBy("qid").agg(F.count("*").alias("pages"), F.avg("loss").alias("mean_loss"), F.median("loss").alias("median_loss"), F.avg("preservation").alias("mean_preservation"), F.avg("retention").alias("mean_retention"), F.avg("selected_tokens").alias("mean_selected"))


def diagnostics_total(per_query: DataFrame) -> DataFrame:
    weighed = lambda c: (F.sum(F.col(c) * F.col("pages")) / F.sum(F.when(F.col(c).isNotNull(), F.col("pages")))).alias(c)
    return per_query.agg(F.count("*").alias("queries"), F.sum("pages").alias("pages"), *[weighed(c) for c in ("mean_loss", "mean_preservation", "mean_retention", "mean_selected")], F.median("median_loss").alias("median_of_medians"))


def token_features(pages: DataFrame, queries: DataFrame, scores: DataFrame) -> DataFrame:
    """Ten features of each (query, page token) for a learned selector."""
    both = coarse_query_mean(pages, queries).withColumnRenamed("coarse", "coarse_mean").join(coarse_token_max(scores).select(*TOKEN, F.col("coarse").alias("coarse_max")), TOKEN)
    both = both.join(pages.select("doc_id", "page_idx", "token_idx", norm("emb").alias("norm")), ["doc_id", "page_idx", "token_idx"])
    span = F.greatest(F.col("side") - 1, F.lit(1))
    row, column = F.floor(F.col("patch_idx") / F.col("side")) / span, (F.col("patch_idx") % F.col("side")) / span
    is_class = lambda c: (F.col("pclass") == c).cast("double")
    return both.select(
        *TOKEN, "coarse_mean", "coarse_max", "norm", F.col("patch_idx").isNull().cast("double").alias("off_grid"), is_class("visual").alias("is_visual"), is_class("non_visual").alias("is_non_visual"), is_class("unknown").alias("is_unknown"),
        F.coalesce(row, F.lit(0.0)).alias("row"), F.coalesce(column, F.lit(0.0)).alias("column"), F.coalesce(F.sqrt((row - 0.5) ** 2 + (column - 0.5) ** 2), F.lit(0.0)).alias("center"),
    )


def winner_counts(scores: DataFrame) -> DataFrame:
    """How many active query tokens each page token wins, zeros included."""
    wins = scores.where("active").groupBy(*KEY, "q_idx").agg(F.max(F.struct("s", (-F.col("token_idx")).alias("t"))).alias("b"))
    wins = wins.groupBy(*KEY, (-F.col("b.t")).alias("token_idx")).agg(F.count("*").alias("wins"))
    return scores.select(*TOKEN).distinct().join(wins, TOKEN, "left").select(*TOKEN, F.coalesce("wins", F.lit(0)).cast("long").alias("wins"))


# selectors' other names.
ALIASES = {"query_coverage_topk": "query_coverage_mix", "learned_exact_winner_topk": "learned_token_topk"}


def select_tokens(selector: str, k: int, coarse: DataFrame, scores: DataFrame, pages: DataFrame | None = None, **options) -> DataFrame:
    """Any selector by name: TOKEN, coarse of the tokens that stay."""
    name = ALIASES.get(selector, selector)
    visual = lambda: visual_query_scores(scores)
    makers = {
        "global_topk": lambda: nonspatial(coarse, k, **options),
        "spatial_quadrant_mix": lambda: quadrant_mix(coarse, k, **options),
        "query_label_mix": lambda: label_mix(coarse, visual(), k, **options),
        "soft_label_prior": lambda: soft_label_prior(coarse, visual(), k, **options),
        "visual_patch_query_prior": lambda: soft_label_prior(coarse, visual(), k, patches_only=True, **options),
        "query_coverage_mix": lambda: coverage_mix(coarse, scores, k, **options),
        "redundancy_aware_topk": lambda: mmr(coarse, pages, k, **options),
        "maxsim_greedy": lambda: greedy_maxsim(coarse, scores, k, **options),
        "learned_token_topk": lambda: global_topk(coarse, k, options["score"]),
        "adaptive": lambda: adaptive_topk(coarse, **options),
    }
    if name not in makers:
        raise ValueError(f"no token selector {selector!r}")
    return makers[name]().select(*TOKEN, "coarse")


def selector_recall(ranked_tokens: DataFrame, wins: DataFrame, k: int) -> DataFrame:
    """Per page: the share of winning query tokens whose winner is among the first k of `place`."""
    both = ranked_tokens.select(*TOKEN, "place").join(wins, TOKEN)
    return both.groupBy(*KEY).agg((F.sum(F.when(F.col("place") <= k, F.col("wins")).otherwise(0)) / F.sum("wins")).alias("recall"))


def moments(features: DataFrame, names: list[str]) -> DataFrame:
    """Mean and population deviation (at least 1e-3, as the root of a variance of 1e-6) of feature columns, a row per feature."""
    one = features.agg(*[F.struct(F.avg(n).alias("mean"), F.sqrt(F.greatest(F.var_pop(n), F.lit(1e-6))).alias("std")).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n)["mean"].alias("mean"), F.col(n)["std"].alias("std")) for n in names])).alias("m")).select("m.*")


def selector_movement(baseline: DataFrame, learned: DataFrame) -> DataFrame:
    """Pages whose winner recall a learned selector improves, worsens or leaves, with both mean recalls."""
    both = baseline.select(*KEY, F.col("recall").alias("b")).join(learned.select(*KEY, F.col("recall").alias("l")), KEY)
    movement = F.when(F.col("l") > F.col("b"), "improved").when(F.col("l") < F.col("b"), "worsened").otherwise("tied")
    return both.groupBy(movement.alias("movement")).agg(F.count("*").alias("pages"), F.avg("b").alias("baseline"), F.avg("l").alias("learned"))
