"""Model surface: encoders and answerers as plain callables that run in batches, once loaded per worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], list[tuple[list[str], np.ndarray]]]
Answerer = Callable[[list[tuple[str, list[str]]]], list[str]]

# Model kinds by what their names hold.
MODEL_KINDS = {"florence": "florence2", "idefics2": "idefics2", "idefics3": "idefics3", "internvl2": "internvl2", "qwen2": "qwen2"}


def hash_encoder(dim: int = 128) -> Encoder:
    """A deterministic stand-in for a text encoder: a unit vector per word from its hash."""

    def vector(word: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "little")
        x = np.random.default_rng(seed).standard_normal(dim)
        return x / np.linalg.norm(x)

    def encode(texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        out = []
        for text in texts:
            words = ["<bos>", *[f"▁{w}" for w in text.split()]]
            out.append((words, np.stack([vector(w) for w in words])))
        return out

    return encode


def encode_queries(questions: DataFrame, load: Callable[[], Encoder], text: str = "question") -> DataFrame:
    """Token rows (qid, q_idx, raw_token, active, emb) of questions; `load` runs once per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for frame in frames:
            rows = [(q, i, w, True, list(map(float, v))) for q, (words, x) in zip(frame.qid, encode([t or "" for t in frame[text]]), strict=True) for i, (w, v) in enumerate(zip(words, x, strict=True))]
            yield pd.DataFrame(rows, columns=["qid", "q_idx", "raw_token", "active", "emb"])

    kind = dict(questions.dtypes)["qid"]
    return questions.select("qid", text).mapInPandas(run, f"qid {kind}, q_idx long, raw_token string, active boolean, emb array<double>")


def prompt(template: str, question: Column, documents: Column | None = None) -> Column:
    """A template with $question and $documents filled in."""
    out = F.replace(F.lit(template), F.lit("$question"), question)
    return out if documents is None else F.replace(out, F.lit("$documents"), documents)


def answer(prompts: DataFrame, load: Callable[[], Answerer]) -> DataFrame:
    """qid, answer for rows of qid, prompt and pages (uids in rank order)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = load()
        for frame in frames:
            texts = generate([(p, list(u)) for p, u in zip(frame.prompt, frame.pages, strict=True)])
            yield pd.DataFrame({"qid": frame.qid, "answer": texts})

    kind = dict(prompts.dtypes)["qid"]
    return prompts.select("qid", "prompt", "pages").mapInPandas(run, f"qid {kind}, answer string")


def retrieve_and_answer(questions: DataFrame, run: DataFrame, load: Callable[[], Answerer], template: str = "$question", pages: int = 4) -> DataFrame:
    """Each question with its best pages, prompted and answered."""
    from ..functions.columns import page_uid

    top = run.where(F.col("rank") <= pages).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", page_uid().alias("uid")))), lambda x: x["uid"]).alias("pages"))
    return answer(questions.join(top, "qid").withColumn("prompt", prompt(template, F.col("question"))), load)


def model_kind(name: Column) -> Column:
    text = F.lower(name)
    out = F.lit(None).cast("string")
    for part, kind in reversed(MODEL_KINDS.items()):
        out = F.when(text.contains(part), kind).otherwise(out)
    return out
