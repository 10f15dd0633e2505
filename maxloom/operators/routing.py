"""Query routing: features, rules, linear routers, rule mining, oracle routing, and the router's and learned models' trainers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import informative, normalised_label, sigmoid, standardised, token_label
from .ranking import NO_RANK

NUMERIC = ["visual_tokens", "non_visual_tokens", "unknown_tokens", "tokens", "informative_visual", "has_informative", "share_of_visual", "share_of_all"]


def route_features(queries: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Per query: token class counts, informative visual tokens (their number and the distinct words in order) and the question type."""
    words = F.when((F.col("qclass") == "visual") & informative(token_label("raw_token")), normalised_label(token_label("raw_token")))
    q = queries.withColumn("word", words)
    out = q.groupBy("qid").agg(
        *[F.count_if(F.col("qclass") == c).alias(f"{c}_tokens") for c in ("visual", "non_visual", "unknown")], F.count("*").alias("tokens"), F.count("word").alias("informative_visual"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("q_idx", "word")))), lambda x: x["word"])).alias("words"),
    )
    some = F.col("informative_visual")
    out = out.withColumns({"has_informative": (some > 0).cast("double"), "share_of_visual": F.when(F.col("visual_tokens") > 0, some / F.col("visual_tokens")).otherwise(0.0), "share_of_all": F.when(F.col("tokens") > 0, some / F.col("tokens")).otherwise(0.0)})
    return out if types is None else out.join(types.select("qid", "qtype"), "qid", "left").withColumn("qtype", F.coalesce("qtype", F.lit("UNKNOWN")))


def rule_holds(rule: Mapping) -> Column:
    """All conditions of a rule; one that is not given holds."""
    out = F.lit(True)
    if rule.get("question_types"):
        out = out & F.col("qtype").isin(*rule["question_types"])
    if rule.get("min_informative_visual_count") is not None:
        out = out & (F.col("informative_visual") >= rule["min_informative_visual_count"])
    if rule.get("min_visual_query_token_count") is not None:
        out = out & (F.col("visual_tokens") >= rule["min_visual_query_token_count"])
    if rule.get("any_informative_visual_tokens"):
        out = out & F.arrays_overlap("words", F.array(*[F.lit(" ".join(w.lower().split())) for w in rule["any_informative_visual_tokens"]]))
    return out


def check_config(config: Mapping) -> Mapping:
    """Fails on a router of an unknown kind, or on weights that do not fit its features."""
    kind = config.get("router_type", "rule_or")
    if kind not in ("rule_or", "learned_linear"):
        raise ValueError(f"no router type {kind!r}")
    if kind == "learned_linear" and not len(config["feature_names"]) == len(config["weights"]) == len(config["feature_means"]) == len(config["feature_stds"]):
        raise ValueError("weights, means and stds must match the features")
    return config


def route(features: DataFrame, config: Mapping | None) -> DataFrame:
    """qid, route, rule (index of the first that holds) and probability (of a linear router)."""
    none, nothing = F.lit(None).cast("long"), F.lit(None).cast("double")
    if config is None:
        return features.select("qid", F.lit("visual").alias("route"), none.alias("rule"), nothing.alias("probability"))
    check_config(config)
    default = config.get("default_route", "base")
    if config.get("router_type", "rule_or") == "rule_or":
        index = F.coalesce(*[F.when(rule_holds(r), F.lit(i)) for i, r in enumerate(config.get("visual_rules", []))], F.lit(None)).cast("long")
        return features.select("qid", F.when(index.isNotNull(), "visual").otherwise(default).alias("route"), index.alias("rule"), nothing.alias("probability"))
    names = config["feature_names"]
    p = sigmoid(standardised({n: F.col(n) for n in names}, dict(zip(names, config["feature_means"], strict=True)), dict(zip(names, config["feature_stds"], strict=True)), dict(zip(names, config["weights"], strict=True)), config.get("bias", 0.0)))
    chosen = F.when(p >= config.get("probability_threshold", 0.5), config.get("candidate_route", "visual")).otherwise(default)
    return features.select("qid", chosen.alias("route"), none.alias("rule"), p.alias("probability"))


def candidate_rules(features: DataFrame) -> DataFrame:
    """rule, qid of every candidate predicate that holds: by type, by least counts, by word, and by type with word."""
    f = features
    by_type = f.select(F.concat(F.lit("type="), "qtype").alias("rule"), "qid")
    steps = lambda c: f.where(F.col(c) > 0).select("qid", F.explode(F.sequence(F.lit(1), F.col(c).cast("int"))).alias("n"))
    counts = [steps(c).select(F.concat(F.lit(f"{c}>="), F.col("n").cast("string")).alias("rule"), "qid") for c in ("informative_visual", "visual_tokens")]
    words = f.select("qid", "qtype", F.explode("words").alias("word"))
    by_word = words.select(F.concat(F.lit("word="), "word").alias("rule"), "qid")
    pairs = words.select(F.concat(F.lit("type="), "qtype", F.lit(" word="), "word").alias("rule"), "qid")
    return by_type.unionByName(counts[0]).unionByName(counts[1]).unionByName(by_word).unionByName(pairs).distinct()


def mine_rules(rules: DataFrame, labels: DataFrame, target: str, min_support: int = 1, min_precision: float = 0.0) -> DataFrame:
    """Support, precision and recall of each rule for the queries whose `winner` is the target."""
    total = labels.agg(F.count_if(F.col("winner") == target).alias("total"))
    by = rules.join(labels, "qid").groupBy("rule").agg(F.count("*").alias("support"), F.count_if(F.col("winner") == target).alias("hits"))
    out = by.join(F.broadcast(total)).withColumns({"precision": F.col("hits") / F.col("support"), "recall": F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0)})
    return out.where((F.col("support") >= min_support) & (F.col("precision") >= min_precision)).drop("total")


def routed(base: DataFrame, candidate: DataFrame, routes: DataFrame, rank: str = "first_doc") -> DataFrame:
    """Per query the chosen run's rank, and the better of both (an oracle's)."""
    both = base.select("qid", F.col(rank).alias("base_rank")).join(candidate.select("qid", F.col(rank).alias("candidate_rank")), "qid").join(routes.select("qid", "route"), "qid")
    return both.withColumns({"rank": F.when(F.col("route") == "visual", F.col("candidate_rank")).otherwise(F.col("base_rank")), "oracle": F.least("base_rank", "candidate_rank")})


def objective(chosen: DataFrame) -> DataFrame:
    """A router's goals, best first: top-4 count, improved, worsened, routed; with the base's and the oracle's top-4."""
    far = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(NO_RANK))
    return chosen.agg(F.count_if(far("rank") <= 4).alias("top4"), F.count_if(far("rank") < far("base_rank")).alias("improved"), F.count_if(far("rank") > far("base_rank")).alias("worsened"), F.count_if(F.col("route") == "visual").alias("routed"), F.count_if(far("base_rank") <= 4).alias("base_top4"), F.count_if(far("oracle") <= 4).alias("oracle_top4"))


def greedy_rules(rules: DataFrame, base: DataFrame, candidate: DataFrame, most: int = 3, rank: str = "first_doc") -> list[str]:
    """Forward selection: add the rule that betters the objective most, until none does. A few scalars per rule reach the driver."""
    ranks = base.select("qid", F.col(rank).alias("b")).join(candidate.select("qid", F.col(rank).alias("c")), "qid").select("qid", *[F.coalesce(F.col(c).cast("double"), F.lit(NO_RANK)).alias(c) for c in "bc"])
    goals = [(F.count_if(F.col("c") <= 4) - F.count_if(F.col("b") <= 4)).alias("d4"), F.count_if(F.col("c") < F.col("b")).alias("up"), (-F.count_if(F.col("c") > F.col("b"))).alias("down"), (-F.count("*")).alias("n")]
    chosen: list[str] = []
    goal = (0, 0, 0, 0)
    while len(chosen) < most:
        # What a rule adds: the queries that no chosen rule holds for.
        new = rules.where(~F.col("rule").isin(chosen)).distinct()
        new = new.join(rules.where(F.col("rule").isin(chosen)).select("qid").distinct(), "qid", "left_anti") if chosen else new
        best = new.join(ranks, "qid").groupBy("rule").agg(*goals).orderBy(F.desc("d4"), F.desc("up"), F.desc("down"), F.desc("n"), "rule").first()
        if best is None or (total := tuple(goal[i] + best[i + 1] for i in range(4))) <= goal:
            break
        goal = total
        chosen.append(best["rule"])
    return chosen


def _adam(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def train_router(features: DataFrame, base: DataFrame, candidate: DataFrame, names: Sequence[str] = tuple(NUMERIC), steps: int = 300, rate: float = 0.05, rows: int = 50_000) -> dict:
    """Weighted logistic router over standardised features; label: the candidate ranks better. Fitted on at most `rows` queries, by hash."""
    far = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(NO_RANK))
    table = features.select("qid", *names).join(base.select("qid", far("first_doc").alias("b")), "qid").join(candidate.select("qid", far("first_doc").alias("c")), "qid")
    data = table.orderBy(F.xxhash64("qid"), "qid").limit(rows).toPandas()
    x, y = data[list(names)].to_numpy(float), (data.c < data.b).to_numpy(float)
    mean, std = x.mean(0), x.std(0)
    std = np.where(std > 1e-8, std, 1.0)
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    weight = np.where(y > 0, max(1.0, (y == 0).sum() / max(1, (y > 0).sum())), 1.0) * np.where((data.b > 4) & (data.c <= 4), 2.0, 1.0)
    w = _adam(lambda w: z.T @ (weight * (1 / (1 + np.exp(-z @ w)) - y)) / max(weight.sum(), 1) + 1e-3 * w, z.shape[1], steps, rate)
    p = 1 / (1 + np.exp(-z @ w))
    best = max(((int((np.where(p >= t, data.c, data.b) <= 4).sum()), int((np.where(p >= t, data.c, data.b) < data.b).sum()), -int((np.where(p >= t, data.c, data.b) > data.b).sum()), -int((p >= t).sum())), float(t)) for t in np.unique(np.append(p, 0.5)))
    return {"router_type": "learned_linear", "feature_names": list(names), "feature_means": mean.tolist(), "feature_stds": std.tolist(), "weights": w[:-1].tolist(), "bias": float(w[-1]), "probability_threshold": best[1], "default_route": "base", "candidate_route": "visual"}


def _pair_trainer(x: np.ndarray, better: np.ndarray, worse: np.ndarray, weight: np.ndarray, steps: int, rate: float) -> np.ndarray:
    d = x[better] - x[worse]
    return _adam(lambda w: -(d.T @ (weight / (1 + np.exp(d @ w)))) / max(weight.sum(), 1e-9) + 1e-4 * w, x.shape[1], steps, rate)


def train_pairs(rows: DataFrame, group: Sequence[str], names: Sequence[str], weight: str, hard: str | None = None, negatives: int = 20, steps: int = 200, rate: float = 0.05, limit: int = 50_000) -> dict:
    """Pairwise linear model: rows of positive `weight` over the others of their group, the lowest by `hard` (else by hash) first.

    Fitted on at most `limit` rows of whole groups, by hash of the group.
    """
    ordered = rows.select(*group, *names, F.col(weight).cast("double").alias("__w"), F.xxhash64(*group).alias("__g"), (F.col(hard) if hard else F.xxhash64(*names)).alias("__h"))
    data = ordered.orderBy("__g", "__h").limit(limit).toPandas()
    x = data[list(names)].to_numpy(float)
    mean, std = x.mean(0), x.std(0)
    std = np.where(std > 1e-6, std, 1.0)
    better, worse, share = [], [], []
    for _, own in data.groupby("__g", sort=False):
        up, down = own.index[own["__w"] > 0], own.index[own["__w"] <= 0][:negatives]
        for i in up:
            better += [i] * len(down)
            worse += list(down)
            share += [own.loc[i, "__w"] / own["__w"].sum()] * len(down)
    w = _pair_trainer((x - mean) / std, np.array(better, int), np.array(worse, int), np.array(share), steps, rate) if better else np.zeros(len(names))
    return {"model_type": "linear", "feature_names": list(names), "feature_means": mean.tolist(), "feature_stds": std.tolist(), "weights": w.tolist(), "bias": 0.0}


def model_frame(spark, model: Mapping) -> DataFrame:
    """A linear model as rows: feature, mean, std, weight."""
    frame = pd.DataFrame({"feature": model["feature_names"], "mean": model["feature_means"], "std": model["feature_stds"], "weight": model["weights"]})
    return spark.createDataFrame(frame, "feature string, mean double, std double, weight double")


def vocabulary(features: DataFrame, min_queries: int = 1) -> DataFrame:
    """Informative visual words and in how many queries they stand."""
    return features.select("qid", F.explode("words").alias("word")).groupBy("word").agg(F.count_distinct("qid").alias("queries")).where(F.col("queries") >= min_queries)


def audit(ranks: DataFrame, n: int = 50, rank: str = "rank", grounded: str = "grounded", gain: str = "gain") -> DataFrame:
    """A verdict on how far the visual evidence of each query can be relied on."""
    r = F.col(rank)
    verdict = F.when(r <= n, "strong").when((r <= 2 * n) & F.col(grounded), "borderline").when(F.col(gain) >= 100, "useful_but_not_reliable").otherwise("weak")
    return ranks.withColumn("verdict", verdict)
