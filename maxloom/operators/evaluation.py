"""Recall, gold ranks, run KPIs and comparisons, answer EM and F1.

A run is (qid, rank, doc_id, page_idx, score); gold is (qid, doc_id).
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import movement
from .ranking import doc_ranks


def recall_at(run: DataFrame, gold: DataFrame, ks: list[int], dedupe_first: bool = False) -> DataFrame:
    """qid, k, recall: gold documents among the first k rows (or first k documents) over gold documents; queries without hits count 0."""
    if dedupe_first:
        run = doc_ranks(run).withColumnRenamed("doc_rank", "rank")
    hits = run.join(gold.distinct(), ["qid", "doc_id"]).groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"))
    n = gold.distinct().groupBy("qid").agg(F.count("*").alias("n"))
    found = n.join(hits.groupBy("qid").agg(*[F.count_if(F.col("rank") <= k).alias(f"k{k}") for k in ks]), "qid", "left")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), (F.coalesce(f"k{k}", F.lit(0)) / F.col("n")).alias("recall")) for k in ks]))
    return found.select("qid", pairs.alias("r")).select("qid", "r.k", "r.recall")


def mean_recall(per_query: DataFrame) -> DataFrame:
    return per_query.groupBy("k").agg(F.avg("recall").alias("recall"), F.count("*").alias("queries"))


def first_gold_ranks(run: DataFrame, gold: DataFrame) -> DataFrame:
    """First gold document rank (over unique documents) and first gold page rank; null where none is found."""
    docs = doc_ranks(run).join(gold.distinct(), ["qid", "doc_id"]).groupBy("qid").agg(F.min("doc_rank").alias("first_doc"))
    pages = run.join(gold.distinct(), ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first_page"))
    return gold.select("qid").distinct().join(docs, "qid", "left").join(pages, "qid", "left")


def gold_summary(run: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query: first gold rank, gold documents in the top 4 and 10, and all gold ranks as `doc:rank` in rank order."""
    at = doc_ranks(run).join(gold.distinct(), ["qid", "doc_id"]).groupBy("qid").agg(
        F.min("doc_rank").alias("first_gold"), F.count_if(F.col("doc_rank") <= 4).alias("hits4"), F.count_if(F.col("doc_rank") <= 10).alias("hits10"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_rank", "doc_id"))), lambda x: F.concat_ws(":", x["doc_id"], x["doc_rank"].cast("string"))), ",").alias("ranks"),
    )
    out = gold.select("qid").distinct().join(at, "qid", "left")
    return out.select("qid", "first_gold", F.coalesce("hits4", F.lit(0)).cast("long").alias("hits4"), F.coalesce("hits10", F.lit(0)).cast("long").alias("hits10"), F.coalesce("ranks", F.lit("")).alias("ranks"))


def run_kpis(ranks: DataFrame, rank: str = "first_doc") -> DataFrame:
    """One row: queries, found, top-4 count, mean and exact median rank of those found."""
    return ranks.agg(F.count("*").alias("queries"), F.count(rank).alias("found"), F.count_if(F.col(rank) <= 4).alias("top4"), F.avg(rank).alias("mean_rank"), F.median(rank).alias("median_rank"))


def ith_gold_pages(run: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold documents of each query by place (in order of id), each with its best page in a run, if it has one: qid, place, doc_id, page_idx."""
    best = run.groupBy("qid", "doc_id").agg(F.min_by("page_idx", "rank").alias("page_idx"))
    listed = gold.select("qid", "doc_id").distinct().withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id")))
    return listed.join(best, ["qid", "doc_id"], "left")


def compare_runs(before: DataFrame, after: DataFrame, rank: str = "first_doc") -> DataFrame:
    """qid, before, after, movement, gain; queries of both runs."""
    both = before.select("qid", F.col(rank).alias("before")).join(after.select("qid", F.col(rank).alias("after")), "qid")
    return both.select("*", movement("before", "after").alias("movement"), (F.col("before") - F.col("after")).alias("gain"))


def movement_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("movement").agg(F.count("*").alias("queries"), F.avg("gain").alias("mean_gain"))


def winners(a: DataFrame, b: DataFrame, rank: str = "first_doc") -> DataFrame:
    """Which of two runs ranks a query's gold better; a missing or equal rank is a tie."""
    both = a.select("qid", F.col(rank).alias("a")).join(b.select("qid", F.col(rank).alias("b")), "qid")
    return both.withColumn("winner", F.when(F.col("a") < F.col("b"), "a").when(F.col("b") < F.col("a"), "b").otherwise("tie"))


def coverage(run: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query: gold pages' documents in the first k rows, as a ratio of gold documents."""
    return recall_at(run, gold, [k]).select("qid", F.col("recall").alias("coverage"))


def coverage_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row over both coverages: means, medians, full, any and none counts, and what changed."""
    both = before.select("qid", F.col("coverage").alias("b")).join(after.select("qid", F.col("coverage").alias("a")), "qid")
    one = lambda c, p: [F.avg(c).alias(f"{p}_mean"), F.median(c).alias(f"{p}_median"), F.count_if(F.col(c) >= 1).alias(f"{p}_full"), F.count_if(F.col(c) > 0).alias(f"{p}_any"), F.count_if(F.col(c) == 0).alias(f"{p}_none")]
    return both.agg(F.count("*").alias("queries"), *one("b", "before"), *one("a", "after"), F.count_if(F.col("a") > F.col("b")).alias("improved"), F.count_if(F.col("a") < F.col("b")).alias("worsened"), F.count_if(F.col("a") == F.col("b")).alias("unchanged"), F.count_if((F.col("b") == 0) & (F.col("a") > 0)).alias("rescued"))


# Answers: normalisation, bags, exact match and aligned F1.

# Fixed values.
_UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_SCALES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def word_number(text: str) -> float | None:
    """The value of a single English number word, null for anything else."""
    value = {**_UNITS, **_TENS, **_SCALES}.get(text.strip().lower())
    return None if value is None else float(value)


def normalise_answer(text: str) -> str:
    """Words between spaces and hyphens: lower case, no punctuation (unless a number), numbers as floats, no articles."""
    parts = []
    for token in text.lower().replace("-", " ").split(" "):
        token = token if is_number(token) else "".join(c for c in token if c not in _PUNCTUATION)
        number = float(token) if is_number(token) else word_number(token)
        token = str(number) if number is not None else token
        token = " ".join(w for w in token.split() if w not in ("a", "an", "the"))
        if token:
            parts.append(token)
    return " ".join(parts)


def bag_f1(predicted: set[str], gold: set[str]) -> float:
    """F1 of two word sets; a set without words is precise (or complete) by itself."""
    common = len(predicted & gold)
    precision = common / len(predicted) if predicted else 1.0
    recall = common / len(gold) if gold else 1.0
    return 0.0 if precision == recall == 0 else 2 * precision * recall / (precision + recall)


def best_assignment(scores: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of rows and columns with the largest sum (shortest augmenting paths with potentials)."""
    flipped = scores.shape[0] > scores.shape[1]
    cost = -(scores.T if flipped else scores)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, back, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            seen[at] = True
            slack = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = ~seen[1:] & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], at
            step_to = int(np.where(seen[1:], np.inf, least[1:]).argmin()) + 1
            delta = least[step_to]
            u[owner[seen]] += delta
            v[seen] -= delta
            least[~seen] -= delta
            at = step_to
            if owner[at] == 0:
                break
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(j, i) for i, j in pairs] if flipped else pairs


def exact_match(predicted: list[str], gold: list[str]) -> float:
    p, g = [normalise_answer(x) for x in predicted], [normalise_answer(x) for x in gold]
    return float(set(p) == set(g) and len(p) == len(g))


def list_f1(predicted: list[str], gold: list[str]) -> float:
    """Mean F1 of the best alignment over the longer list, to two decimals; spans whose gold numbers are all missed score 0."""
    p, g = ([set(normalise_answer(x).split()) for x in side] for side in (predicted, gold))
    scores = np.zeros((len(g), len(p)))
    for i, j in itertools.product(range(len(g)), range(len(p))):
        numbers = {w for w in g[i] if is_number(w)}
        if not numbers or numbers & p[j]:
            scores[i, j] = bag_f1(p[j], g[i])
    total = sum(scores[i, j] for i, j in best_assignment(scores)) if scores.size else 0.0
    return float(np.round(total / max(len(g), len(p), 1), 2))


def answer_scores(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """qid, em, f1: `gold` and `predictions` hold qid and an array of spans; a missing prediction scores 0, an extra one is ignored."""
    both = gold.select("qid", F.col("answers").alias("g")).join(predictions.select("qid", F.col("answers").alias("p")), "qid", "left")

    @F.pandas_udf("em double, f1 double")
    def score(g: pd.Series, p: pd.Series) -> pd.DataFrame:
        rows = [(0.0, 0.0) if y is None else (exact_match(list(y), list(x)), list_f1(list(y), list(x))) for x, y in zip(g, p, strict=True)]
        return pd.DataFrame(rows, columns=["em", "f1"])

    return both.withColumn("s", score("g", "p")).select("qid", "s.em", "s.f1")


def token_f1(predicted, gold):
    """F1 of two columns' distinct word arrays, as `bag_f1`."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    common = F.size(F.array_intersect(p, g))
    precision = F.when(F.size(p) > 0, common / F.size(p)).otherwise(1.0)
    recall = F.when(F.size(g) > 0, common / F.size(g)).otherwise(1.0)
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def scores_by_group(scores: DataFrame, groups: list[str]) -> DataFrame:
    """Overall and by each group alone, in one pass: grouping, value, queries, em, f1."""

    view = scores.groupingSets([[], *[[F.col(g)] for g in groups]], *[F.col(g) for g in groups])
    out = view.agg(F.count("*").alias("queries"), F.avg("em").alias("em"), F.avg("f1").alias("f1"), F.grouping_id().alias("gid"))
    bits = {g: 1 << (len(groups) - 1 - i) for i, g in enumerate(groups)}
    name = F.lit("all")
    value = F.lit("")
    for g in groups:
        own = F.col("gid") == (1 << len(groups)) - 1 - bits[g]
        name, value = F.when(own, g).otherwise(name), F.when(own, F.col(g)).otherwise(value)

    return out.select(name.alias("grouping"), value.alias("value"), "queries", "em", "f1")


def require_predictions(gold: DataFrame, predictions: DataFrame) -> None:
    """Fails, naming some, if predictions lack questions."""
    missing = gold.select("qid").distinct().join(predictions.select("qid"), "qid", "left_anti").limit(20).collect()
    if missing:
        raise ValueError(f"questions without prediction: {[r[0] for r in missing]}")


def last_per_query(rows: DataFrame) -> DataFrame:
    """Of several rows of a query the one read last (`pos`)."""
    return rows.withColumn("__last", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("pos")))).where("__last = 1").drop("__last")
