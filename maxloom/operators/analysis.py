"""Analyses over runs: failure buckets, cues, multi-gold hits, unions under budgets, label versions, subsets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cue_type, failure_bucket, ranked
from .ranking import doc_ranks


def failure_buckets(exact: DataFrame, pruned: DataFrame, rank: str = "first_doc", topk: int = 4, near: int = 10, gain: int = 5) -> DataFrame:
    """Queries whose pruned run misses the top, with the reason."""
    both = exact.select("qid", F.col(rank).alias("exact")).join(pruned.select("qid", F.col(rank).alias("pruned")), "qid")
    return both.where(F.col("pruned").isNull() | (F.col("pruned") > topk)).withColumn("bucket", failure_bucket("exact", "pruned", topk, near, gain))


def bucket_examples(rows: DataFrame, group: str, count: int, *order) -> DataFrame:
    """The first few rows of each group in an order."""
    return rows.withColumn("example", ranked([group], *order)).where(F.col("example") <= count)


def bucket_summary(rows: DataFrame, bucket: str, rank: str) -> DataFrame:
    """Per bucket: queries, and mean and median of their ranks (queries without a rank count, but not in these)."""
    return rows.groupBy(bucket).agg(F.count("*").alias("queries"), F.avg(rank).alias("mean_rank"), F.median(rank).alias("median_rank"))


def bucket_frequencies(rows: DataFrame, bucket: str, values: str, most: int) -> DataFrame:
    """The commonest values (an array column) of each bucket: bucket, value, n, place."""
    counts = rows.select(bucket, F.explode(values).alias("value")).groupBy(bucket, "value").agg(F.count("*").alias("n"))
    return counts.withColumn("place", ranked([bucket], F.desc("n"), "value")).where(F.col("place") <= most)


def cue_counts(questions: DataFrame) -> DataFrame:
    return questions.groupBy(cue_type("question").alias("cue")).agg(F.count("*").alias("questions"))


def gold_hits(run: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Gold documents ranked within k: qid, doc_id."""
    return doc_ranks(run).where(F.col("doc_rank") <= k).join(gold.distinct(), ["qid", "doc_id"]).select("qid", "doc_id")


def multigold(run: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query: gold documents, hits within k, and none, partial or full."""
    n = gold.distinct().groupBy("qid").agg(F.count("*").alias("n_gold"))
    hits = gold_hits(run, gold, k).groupBy("qid").agg(F.count("*").alias("hits"))
    out = n.join(hits, "qid", "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    return out.withColumn("outcome", F.when(F.col("hits") == 0, "none").when(F.col("hits") < F.col("n_gold"), "partial").otherwise("full"))


def union_hits(runs: dict[str, DataFrame], gold: DataFrame, k: int, reference: str) -> DataFrame:
    """Per query: hits of the reference run and of all runs together, and whether the union completes what the reference lacks."""
    label = [gold_hits(run, gold, k).withColumn("label", F.lit(name)) for name, run in runs.items()]
    every = label[0]
    for more in label[1:]:
        every = every.unionByName(more)
    n = gold.distinct().groupBy("qid").agg(F.count("*").alias("n_gold"))
    found = every.groupBy("qid").agg(F.count_distinct("doc_id").alias("union_hits"), F.count_distinct(F.when(F.col("label") == reference, F.col("doc_id"))).alias("reference_hits"))
    out = n.join(found, "qid", "left").select("qid", "n_gold", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("reference_hits", "union_hits")])
    return out.withColumn("recovered", (F.col("union_hits") == F.col("n_gold")) & (F.col("reference_hits") < F.col("n_gold")))


def budget_unions(runs: dict[str, DataFrame], gold: DataFrame, k: int, size: int) -> DataFrame:
    """Every union of `size` runs at k // size documents each: label (joined), full queries, hits, place (ties by label)."""
    budget = max(1, k // size)
    every = None
    for name, run in runs.items():
        own = gold_hits(run, gold, budget).withColumn("label", F.lit(name))
        every = own if every is None else every.unionByName(own)
    spark = gold.sparkSession
    combos = spark.createDataFrame([("+".join(c), name) for c in combinations(sorted(runs), size) for name in c], "combo string, label string")
    n = gold.distinct().groupBy("qid").agg(F.count("*").alias("n_gold"))
    hits = every.join(F.broadcast(combos), "label").groupBy("combo", "qid").agg(F.count_distinct("doc_id").alias("hits")).join(n, "qid")
    totals = hits.groupBy("combo").agg(F.count_if(F.col("hits") == F.col("n_gold")).alias("full"), F.sum("hits").alias("hits"))
    totals = combos.select("combo").distinct().join(totals, "combo", "left").select("combo", F.coalesce("full", F.lit(0)).cast("long").alias("full"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
    return totals.withColumn("place", F.row_number().over(Window.orderBy(F.desc("full"), F.desc("hits"), "combo")).cast("long"))


def label_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per query: tokens that are visual in one label version (qid, q_idx, qclass) alone, and how many classes differ."""
    both = a.select("qid", "q_idx", F.col("qclass").alias("a")).join(b.select("qid", "q_idx", F.col("qclass").alias("b")), ["qid", "q_idx"], "full")
    visual = lambda c: F.coalesce(F.col(c) == "visual", F.lit(False))
    return both.groupBy("qid").agg(F.count_if(visual("a") & ~visual("b")).alias("only_a"), F.count_if(visual("b") & ~visual("a")).alias("only_b"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


def subset(compared: DataFrame, low: int, high: int, movements: list[str]) -> DataFrame:
    """Queries outside the top 4 after, moved as asked, with a rank before within [low, high]; a missing rank is never in a range."""
    return compared.where((F.col("after").isNull() | (F.col("after") > 4)) & F.col("movement").isin(movements) & F.col("before").between(low, high))


def channel_means(features: DataFrame, gold: DataFrame, columns: list[str]) -> DataFrame:
    """Means of page features for gold and other pages."""
    flagged = features.join(gold.distinct().withColumn("g", F.lit(True)), ["qid", "doc_id"], "left").withColumn("is_gold", F.coalesce("g", F.lit(False)))
    return flagged.groupBy("is_gold").agg(F.count("*").alias("pages"), *[F.avg(c).alias(c) for c in columns])
