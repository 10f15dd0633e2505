"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

quality   drops what the classifier rejects
exact     drops all but the first of equal texts
near      drops all but the first document of each class of near copies
mix       orders all rows by slots in which every source has its share of the rows all along; none is left out
pack      one row per piece of a document in a sequence

Rows go by id and text, so a unique text stays where its id is repeated; of rows equal in both one stays. Rows with a null id are
not compared and stay. Null and empty texts are scored, deduplicated, mixed and packed like any other. Stages return the columns of
`documents` (COLUMNS) and leave out any others; an empty table gives an empty result. Tables that a stage's operator has written
are dropped once the stage's own table is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maxloom.llm.common import drop_tables, materialize, read_table, tables_written
from maxloom.llm.exact_dedup import exact_dedup, normalised
from maxloom.llm.mixing import mix as mix_rows
from maxloom.llm.ngram_join import keep_one
from maxloom.llm.packing import pack
from maxloom.llm.quality import keep_good
from maxloom.llm.queries import word_vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = exact_dedup(docs.select("doc_id", "text").where("doc_id IS NOT NULL"))
    marked = judged.groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    marked = materialize(marked.where("NOT kept OR rows > 1"), "exact-marked")
    # Ids meet; digests are compared only where they do.
    by_row = (F.col("doc_id") == F.col("id")) & ~(F.sha2(normalised(F.col("text")).cast("binary"), 256) != F.col("sha"))
    docs = docs.select(*COLUMNS)
    single = docs.join(marked.hint("merge"), by_row, "left_anti")
    again = marked.where("kept")
    if again.isEmpty():
        return single
    # Rows repeated whole: one of them.
    first = Window.partitionBy("doc_id", normalised(F.col("text"))).orderBy("lang", "source", "n_chars", "text")
    repeated = docs.join(again, by_row, "left_semi").withColumn("place", F.row_number().over(first)).where("place = 1")
    return single.unionByName(repeated.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = mix_rows(docs.select(*COLUMNS)).where("in_mix")
    return placed.repartitionByRange("slot").sortWithinPartitions("slot", "place").select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, word_vocabulary())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", sequences)]

#: The classifier's trees and the vocabulary are no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    start = tables_written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_tables(spark, start, but_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)
