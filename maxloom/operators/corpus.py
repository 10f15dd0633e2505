"""Corpus building: keyed merges, supporting documents, shards, subsets, candidate pools, artifact checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .ranking import doc_ranks


def merge_mappings(sources: list[DataFrame]) -> DataFrame:
    """id, url of all sources; of an id the last source's last row (`pos`) counts, rows lacking either are dropped."""
    every = None
    for priority, source in enumerate(sources):
        own = source.select("id", "url", F.col("pos").cast("long").alias("pos"), F.lit(priority).alias("priority")).dropna(subset=["id", "url"])
        every = own if every is None else every.unionByName(own)
    return every.groupBy("id").agg(F.max_by("url", F.struct("priority", "pos")).alias("url"))


def supporting_docs(gold: DataFrame) -> DataFrame:
    """Distinct supporting documents and how many questions each supports."""
    return gold.distinct().groupBy("doc_id").agg(F.count("*").alias("questions"))


def numbered(items: DataFrame, *order) -> DataFrame:
    """`items` with `number`, from 0 in a total order: range partitions, numbered inside and shifted by the rows before them.

    The ranges are cut from a sample, so they are checkpointed; sizes of partitions are all that meets in one task.
    """
    context = items.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(items.sparkSession))
    dealt = items.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return dealt.withColumn("__i", own).join(F.broadcast(before), "__p").withColumn("number", F.col("__i") + F.col("__before")).drop("__p", "__i", "__before")


def shard(items: DataFrame, shards: int, *order) -> DataFrame:
    """Round-robin shards over an order: the i-th item goes to shard i mod `shards`."""
    return numbered(items, *order).withColumn("shard", F.col("number") % shards).drop("number")


def subset_by_ids(rows: DataFrame, ids: DataFrame, key: str = "qid") -> DataFrame:
    """The rows of listed ids; fails, naming some, if a listed id has none."""
    missing = ids.select(key).distinct().join(rows.select(key), key, "left_anti").limit(20).collect()
    if missing:
        raise ValueError(f"no rows for {[r[0] for r in missing]}")
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def candidate_pool(run: DataFrame, top_pages: int, top_docs: int, explicit: DataFrame | None = None) -> DataFrame:
    """Pages of a run's first rows, all its pages of its first unique documents, and explicit ones (qid, doc_id, page_idx)."""
    key = ["qid", "doc_id", "page_idx"]
    docs = doc_ranks(run).where(F.col("doc_rank") <= top_docs).select("qid", "doc_id")
    pool = run.where(F.col("rank") <= top_pages).select(*key).unionByName(run.join(docs, ["qid", "doc_id"], "left_semi").select(*key))
    return (pool if explicit is None else pool.unionByName(explicit.select(*key))).distinct()


def to_download(metadata: DataFrame, wanted: DataFrame, have: DataFrame, first_n: int | None = None) -> DataFrame:
    """Wanted documents that are not there yet, at most the `first_n` of them by `pos`."""
    left = metadata.join(wanted.select("id").distinct(), "id", "left_semi").join(have.select("id").distinct(), "id", "left_anti")
    return left if first_n is None else left.orderBy("pos").limit(first_n)


def artifacts(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Per artifact: files (artifact, path, length) found against expected, bytes and readiness."""
    found = files.groupBy("artifact").agg(F.count("*").alias("found"), F.sum("length").alias("bytes"))
    out = expected.join(found, "artifact", "left").select("artifact", "expected", F.coalesce("found", F.lit(0)).cast("long").alias("found"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    return out.withColumn("ready", F.col("found") >= F.col("expected"))


def page_boxes(pages: DataFrame, width: int, height: int) -> DataFrame:
    """Each patch's pixel box on a page image; edges are rounded half to even."""
    edge = lambda i, size: F.bround(i * size / F.col("side")).cast("long")
    row, column = F.floor(F.col("patch_idx") / F.col("side")), F.col("patch_idx") % F.col("side")
    return pages.where("patch_idx IS NOT NULL").select("doc_id", "page_idx", "patch_idx", edge(column, width).alias("x0"), edge(row, height).alias("y0"), edge(column + 1, width).alias("x1"), edge(row + 1, height).alias("y1"))


def window_starts(length: int, window: int, stride: int) -> list[int]:
    """Starts of sliding windows, the last one moved back to the end."""
    last = max(0, length - window)
    return sorted({*range(0, last + 1, max(1, stride)), last})


def crops(sizes: DataFrame, fractions: tuple[float, ...] = (0.5, 0.33, 0.25), stride: float = 0.5) -> DataFrame:
    """Sliding crops of images (id, width, height) for several window fractions, without repeats."""
    out = None
    for f in fractions:
        w, h = (F.greatest(F.bround(F.col(c) * f).cast("int"), F.lit(1)) for c in ("width", "height"))
        starts = lambda size, window: F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(size - window, F.lit(0)), F.greatest(F.bround(window * stride).cast("int"), F.lit(1))), F.array(F.greatest(size - window, F.lit(0)))))
        one = sizes.withColumns({"w": w, "h": h}).withColumn("x", F.explode(starts(F.col("width"), F.col("w")))).withColumn("y", F.explode(starts(F.col("height"), F.col("h")))).select("id", "x", "y", "w", "h")
        out = one if out is None else out.unionByName(one)
    return out.distinct()
