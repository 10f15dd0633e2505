"""Readers and sinks of questions, predictions, runs, labels, vectors and id lists. Every reader fails on ids that are not there.

`pos` is the place of a row in its file: rows that override each other do so by it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import page_uid

GOLD = "qid STRING, question STRING, answers ARRAY<STRUCT<answer: STRING, modality: STRING>>, metadata STRUCT<type: STRING>, supporting_context ARRAY<STRUCT<doc_id: STRING, doc_part: STRING>>"
RUN_ROW = "qid STRING, question STRING, question_type STRING, gold_doc_ids ARRAY<STRING>, baseline_first_gold_doc_rank INT, reranked_first_gold_doc_rank INT, reranked_gold_doc_ranks ARRAY<STRUCT<doc_id: STRING, rank: INT>>, route_decision STRING"
PREDICTION = "MAP<STRING, STRUCT<page_retrieval_results: ARRAY<ARRAY<STRING>>, pred_answer: STRING, time_retrieval: DOUBLE, time_qa: DOUBLE>>"
PATCH_LABEL = "page_id STRING, patch_index INT, patch_class STRING, top_concepts ARRAY<STRUCT<concept: STRING>>"


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, bad ones fail."""
    reader = spark.read.option("mode", "FAILFAST")
    rows = (reader.schema(schema) if schema else reader).json(path)
    return rows.withColumn("pos", F.monotonically_increasing_id())


def require(rows: DataFrame, wanted: DataFrame, key: str = "qid") -> DataFrame:
    """The rows of the wanted keys; fails, naming some, if any has none."""
    missing = wanted.select(key).distinct().join(rows.select(key), key, "left_anti").limit(20).collect()
    if missing:
        raise ValueError(f"missing {key}: {[m[0] for m in missing]}")
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def qids(spark: SparkSession, path: str, field: str = "qid", most: int | None = None) -> DataFrame:
    """One id column of JSON lines, blanks left out; fails if none is left."""
    rows = jsonl(spark, path).select(F.trim(F.col(field)).alias("qid"), "pos").where("qid <> ''").orderBy("pos")
    rows = (rows if most is None else rows.limit(most)).drop("pos")
    if rows.isEmpty():
        raise ValueError(f"no ids in {path}")
    return rows


def gold_questions(spark: SparkSession, path: str, wanted: DataFrame | None = None, types: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    rows = jsonl(spark, path, GOLD)
    rows = rows if wanted is None else require(rows, wanted)
    rows = rows if types is None else rows.where(F.col("metadata.type").isin(*types))
    return rows if most is None else rows.orderBy("pos").limit(most)


def check_modalities(gold: DataFrame) -> DataFrame:
    """Fails on a question whose answers are of several modalities."""
    mixed = gold.where(F.size(F.array_distinct("answers.modality")) > 1).select("qid").limit(20).collect()
    if mixed:
        raise ValueError(f"mixed answer modalities: {[m[0] for m in mixed]}")
    return gold


def supporting(gold: DataFrame) -> DataFrame:
    return gold.select("qid", F.explode("supporting_context").alias("c")).select("qid", "c.doc_id").distinct()


def predictions(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A JSON object by question id: the page run (qid, rank, doc_id, page_idx, score), and the answers with timings."""
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json("value", PREDICTION)).alias("qid", "p"))
    rows = rows if wanted is None else require(rows, wanted)
    run = rows.select("qid", F.posexplode("p.page_retrieval_results").alias("i", "x"))
    run = run.select("qid", (F.col("i") + 1).cast("long").alias("rank"), F.get("x", F.lit(0)).alias("doc_id"), F.get("x", F.lit(1)).cast("long").alias("page_idx"), F.get("x", F.lit(2)).cast("double").alias("score"))
    return run, rows.select("qid", "p.pred_answer", "p.time_retrieval", "p.time_qa")


def run_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rerank rows, the last of each question."""
    from ..operators.evaluation import last_per_query

    return last_per_query(jsonl(spark, path, RUN_ROW))


def labelled_runs(spark: SparkSession, specs: Sequence[str]) -> DataFrame:
    """Several runs as `label=path`, told apart by `label`; a label given twice fails."""
    pairs = [s.split("=", 1) for s in specs]
    if any(len(p) != 2 for p in pairs) or len({p[0] for p in pairs}) < len(pairs):
        raise ValueError("runs are label=path, with labels of their own")
    out = None
    for label, path in pairs:
        rows = run_rows(spark, path).withColumn("label", F.lit(label))
        out = rows if out is None else out.unionByName(rows)
    return out


def audits(spark: SparkSession, path: str, schema: str = "qid STRING, question STRING, reliability_checklist STRUCT<gold_visual_rank: INT, verdict: STRING>") -> DataFrame:
    text = spark.read.option("wholetext", True).text(path)
    listed = T.StructType([T.StructField("audits", T.ArrayType(T.StructType.fromDDL(schema)))])
    return text.select(F.explode(F.from_json("value", listed)["audits"]).alias("a")).select("a.*")


def id_list(spark: SparkSession, path: str, key: str = "doc_ids") -> DataFrame:
    """Ids from a JSON list, a JSON object's key, or lines of text."""
    text = spark.read.option("wholetext", True).text(path)
    body = F.trim("value")
    listed = F.when(body.startswith("["), F.from_json(body, "ARRAY<STRING>")).when(body.startswith("{"), F.from_json(body, f"{key} ARRAY<STRING>")[key]).otherwise(F.split(body, r"\s*\n\s*"))
    return text.select(F.explode(listed).alias("id")).select(F.trim("id").alias("id")).where("id <> ''")


def id_urls(spark: SparkSession, path: str) -> DataFrame:
    """id, url rows; those lacking either are dropped, the last of an id counts."""
    from ..operators.corpus import merge_mappings

    return merge_mappings([jsonl(spark, path, "id STRING, url STRING")])


def patch_labels(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, page_idx, patch_idx, pclass, pos from label rows: the class named, else told by the concepts."""
    rows = jsonl(spark, path, PATCH_LABEL)
    named = F.lower(F.trim(F.coalesce("patch_class", F.lit(""))))
    concepts = F.coalesce(F.transform("top_concepts.concept", lambda c: F.trim(c)), F.array().cast("array<string>"))
    told = F.when(F.array_contains(concepts, "visual_region"), "visual").when(F.arrays_overlap(concepts, F.array(*map(F.lit, ["ocr_text", "table_text", "table_structure"]))), "non_visual").otherwise("unknown")
    kind = F.when(named.isin("visual", "non_visual", "unknown"), named).when(named == "neutral", "unknown").otherwise(told)
    return rows.select(F.regexp_extract("page_id", r"^(.*):(\d+)$", 1).alias("doc_id"), F.regexp_extract("page_id", r"^(.*):(\d+)$", 2).try_cast("long").alias("page_idx"), F.col("patch_index").cast("long").alias("patch_idx"), kind.alias("pclass"), "pos")


def page_tokens(spark: SparkSession, path: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """Token vectors (doc_id, page_idx, token_idx, emb) of a Parquet table; with `doc_ids`, theirs alone, all of which must be there."""
    rows = spark.read.parquet(path)
    return rows if doc_ids is None else require(rows, doc_ids, "doc_id")


def ragged_tokens(docs: DataFrame) -> DataFrame:
    """Token rows from documents that hold all tokens flat and the token counts of their pages (doc_id, tokens, lengths)."""
    pages = docs.select("doc_id", "tokens", F.posexplode("lengths").alias("page_idx", "length"), "lengths")
    start = F.aggregate(F.slice("lengths", F.lit(1), F.col("page_idx")), F.lit(0), lambda a, x: a + x)
    rows = pages.select("doc_id", "page_idx", F.posexplode(F.slice("tokens", start + 1, F.col("length"))).alias("token_idx", "emb"))
    return rows.select("doc_id", F.col("page_idx").cast("long").alias("page_idx"), F.col("token_idx").cast("long").alias("token_idx"), "emb")


def write_index(index: DataFrame, path: str) -> None:
    """Clustered token rows, a folder per centroid, so a probe reads its clusters alone."""
    index.repartition("centroid").write.mode("overwrite").partitionBy("centroid").parquet(path)


def write_jsonl(rows: DataFrame, path: str, bucket: str | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(bucket) if bucket else writer).json(path)


def prediction_payload(run: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One JSON object per question id with its ranked pages; a custom query has no id."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "page_idx", "score")))
    pages = run.groupBy("qid").agg(F.transform(rows, lambda x: F.array(x["doc_id"], x["page_idx"].cast("string"), x["score"].cast("string"))).alias("page_retrieval_results"))
    pages = pages if answers is None else pages.join(answers, "qid", "left")
    return pages.select(F.to_json(F.create_map(F.coalesce(F.col("qid").cast("string"), F.lit("__custom_query__")), F.struct(*[c for c in pages.columns if c != "qid"]))).alias("value"))


def resume(todo: DataFrame, spark: SparkSession, path: str, key: str = "qid") -> DataFrame:
    """What is not in the output yet; all of it if there is no output."""
    from pyspark.errors import AnalysisException

    try:
        done = spark.read.json(path).select(key)
    except AnalysisException:
        return todo
    return todo.join(done.distinct(), key, "left_anti")


def model(path: str, kind: str, names: Sequence[str] | None = None) -> Mapping:
    """A linear model's JSON file, checked for kind, names and lengths."""
    with open(path, encoding="utf-8") as f:
        out = json.load(f)
    sizes = {len(out[c]) for c in ("feature_names", "feature_means", "feature_stds", "weights")}
    if out.get("model_type", out.get("router_type")) != kind or len(sizes) != 1 or (names is not None and list(names) != out["feature_names"]):
        raise ValueError(f"{path} is no {kind} model of these features")
    return out


def page_specs(specs: DataFrame) -> DataFrame:
    """doc_id, page_idx, uid from `doc:idx` strings (`spec`), split at the last colon."""
    doc, idx = F.regexp_extract("spec", r"^(.*):(\d+)$", 1), F.regexp_extract("spec", r"^(.*):(\d+)$", 2).try_cast("long")
    return specs.select(doc.alias("doc_id"), idx.alias("page_idx")).withColumn("uid", page_uid())


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and whether a file starts like a PDF and holds its end mark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    text = F.decode("content", "ISO-8859-1")
    return files.select("path", "length", (text.startswith("%PDF-") & text.contains("%%EOF")).alias("clean"))
