"""Token counts through a digest cache.

A text's key is the SHA-256 of the tokenizer file's digest and the text: normalised, that is with each run of ASCII white space
made one space, only for vocabularies of whole words, which drop white space and so can't count it; as it is for all others.
Keys are joined to stored counts; only distinct keys without one are encoded, and their counts are appended to the cache, a
Parquet table in the shared folder. A cache that is there but can't be read raises.

Null text counts as empty (0 tokens); rows with a null id, repeated rows and extra columns are kept as rows of their own;
an empty table gives an empty result. A document of a few hot texts costs one encoding: keys are made distinct map-side first.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, materialize, shared_dir, tidied
from .wordpiece import BATCH_BYTES

LIMIT = 2048


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def drops_white_space(path: str) -> bool:
    """Whether the vocabulary is of whole words with end marks, for which white space only parts words."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        return bool(json.load(f)["model"].get("end_of_word_suffix"))


def encoder_for(path: str):
    """counts(pa.Array of strings) by the library that the file belongs to."""
    if path.endswith(".json"):
        from .wordpiece import encoder, load

        if drops_white_space(path):
            return encoder(path).counts
        library = load(path)
        return lambda texts: [len(e.ids) for e in library.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode([t or "" for t in texts.to_pylist()], num_threads=1)]


def content_digest(text, version: str, collapse: bool):
    """Key of a text under a tokenizer version."""
    plain = F.coalesce(text, F.lit(""))
    if collapse:
        plain = F.regexp_replace(plain, r"[\x09-\x0D ]+", " ")
    return F.unhex(F.sha2(F.concat(F.lit(version), plain), 256))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _encode(path: str):
    def run(batches):
        counts = encoder_for(path)
        for batch in batches:
            for part in byte_slices(batch, 1, BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts(part.column(1)), pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", cache_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. `cache_path`: a cache that outlives this call; else a fresh one."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    cache_path = cache_path or f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    text, digest = F.coalesce(F.col(text_col), F.lit("")), content_digest(F.col(text_col), version, drops_white_space(tokenizer_path)).alias("digest")
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest)
    misses = docs.select(digest, text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    if _exists(spark, cache_path):
        misses = misses.join(spark.read.parquet(cache_path).select("digest"), "digest", "left_anti")
    misses.mapInArrow(tidied(_encode(tokenizer_path)), "digest binary, n_tokens long").write.mode("append").parquet(cache_path)
    # Two writers may have stored a key twice; both have the same count. As a table of its own it lets the join split a hot key.
    stored = spark.read.schema("digest binary, n_tokens long").parquet(cache_path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    stored = materialize(stored, "token-counts")
    return keyed.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
