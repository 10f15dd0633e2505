"""Retrieval tables derived from the driver's `embeddings`, `benchmark`, `pages` and `events` tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import grid_side, patch_index, ranked
from ..operators import retrieval
from ..operators.taxonomy import QUESTION_TYPES

QUERIES, WIDTH, DOC_PAGES, CLASSES = 6, 8, 5, ["visual", "non_visual", "unknown"]


class Fixture:
    """Views over one scale directory; each is a plan, nothing is read before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def pages(self) -> DataFrame:
        """Tokens of pages: doc_id, page_idx, token_idx, emb, n, side, patch_idx, pclass."""
        e = self.table("embeddings").where(f"vec_id >= {QUERIES * WIDTH}")
        page = F.col("vec_id") % DOC_PAGES
        w = Window.partitionBy("doc_id", "page_idx")
        e = e.select("vec_id", F.concat(F.lit("d"), "label").alias("doc_id"), page.alias("page_idx"), F.col("embedding").cast("array<double>").alias("emb"))
        e = e.withColumns({"token_idx": ranked(["doc_id", "page_idx"], "vec_id") - 1, "n": F.count("*").over(w)})
        kind = F.element_at(F.array(*map(F.lit, CLASSES)), ((F.col("vec_id") + F.col("page_idx")) % 3 + 1).cast("int"))
        e = e.withColumns({"side": grid_side("n"), "patch_idx": patch_index("token_idx", "n")})
        return e.withColumn("pclass", F.when(F.col("patch_idx").isNotNull(), kind).otherwise("unknown"))

    @cached_property
    def queries(self) -> DataFrame:
        """Tokens of queries: qid, q_idx, raw_token, qclass, active, emb, label."""
        i = F.col("vec_id") % WIDTH
        raw = F.when(i == 0, "<bos>").when(i == 1, "Question").when(i == 2, ":").when(i == 7, "<pad>").otherwise(F.concat(F.lit("▁tok"), F.col("vec_id").cast("string")))
        kind = F.when(i.isin(3, 4), "visual").when(i.isin(5, 6), "non_visual").otherwise("unknown")
        e = self.table("embeddings").where(f"vec_id < {QUERIES * WIDTH}")
        return e.select(F.expr(f"vec_id div {WIDTH}").alias("qid"), i.alias("q_idx"), raw.alias("raw_token"), kind.alias("qclass"), (i != 7).alias("active"), F.col("embedding").cast("array<double>").alias("emb"), "label")

    @cached_property
    def gold(self) -> DataFrame:
        return self.queries.where("q_idx IN (3, 4)").select("qid", F.concat(F.lit("d"), "label").alias("doc_id")).distinct()

    @cached_property
    def scores(self) -> DataFrame:
        """The token score table with classes and geometry."""
        return retrieval.token_scores(self.pages, self.queries, ["patch_idx", "side", "n", "pclass"], ["qclass", "active"])

    @cached_property
    def exact(self) -> DataFrame:
        return retrieval.maxsim(self.pages, self.queries.where("active"))

    def rescored(self, candidates: DataFrame) -> DataFrame:
        return retrieval.rescored(self.pages, self.queries.where("active"), candidates)

    @cached_property
    def run_exact(self) -> DataFrame:
        return retrieval.rank_pages(self.exact)

    @cached_property
    def run_baseline(self) -> DataFrame:
        return retrieval.rank_pages(retrieval.knn_pages(retrieval.search_tokens(self.pages, self.queries, 10, ["active"])))

    @cached_property
    def questions(self) -> DataFrame:
        """qid, question, qtype: benchmark item `qid` as text, types in turn."""
        types = F.array(*map(F.lit, QUESTION_TYPES))
        return self.table("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.element_at(types, (F.col("item_id") % len(QUESTION_TYPES) + 1).cast("int")).alias("qtype"))
