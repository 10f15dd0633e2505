"""Question types, their hops and modalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
QUESTION_TYPES = ["TextQ", "TableQ", "ImageQ", "ImageListQ", "Compose(TableQ,ImageListQ)", "Compose(TextQ,ImageListQ)", "Compose(ImageQ,TableQ)", "Compose(ImageQ,TextQ)", "Compose(TextQ,TableQ)", "Compose(TableQ,TextQ)", "Intersect(TableQ,TextQ)", "Intersect(ImageListQ,TableQ)", "Intersect(ImageListQ,TextQ)", "Compare(Compose(TableQ,ImageQ),TableQ)", "Compare(Compose(TableQ,ImageQ),Compose(TableQ,TextQ))", "Compare(TableQ,Compose(TableQ,TextQ))"]
SINGLE_HOP = {"TextQ": "text", "TableQ": "table", "ImageQ": "image", "ImageListQ": "image"}
FIRST_HOP = {
    "text": ["Compare(TableQ,Compose(TableQ,TextQ))", "Compose(ImageQ,TextQ)", "Compose(TableQ,TextQ)", "Intersect(TableQ,TextQ)", "Intersect(ImageListQ,TextQ)"],
    "table": ["Compose(ImageQ,TableQ)", "Compose(TextQ,TableQ)"],
    "image": ["Compare(Compose(TableQ,ImageQ),Compose(TableQ,TextQ))", "Compare(Compose(TableQ,ImageQ),TableQ)", "Compose(TableQ,ImageListQ)", "Compose(TextQ,ImageListQ)", "Intersect(ImageListQ,TableQ)"],
}
SECOND_HOP = {
    "text": ["Compare(Compose(TableQ,ImageQ),Compose(TableQ,TextQ))", "Compose(TextQ,ImageListQ)", "Compose(TextQ,TableQ)"],
    "table": ["Compare(Compose(TableQ,ImageQ),TableQ)", "Compare(TableQ,Compose(TableQ,TextQ))", "Compose(TableQ,ImageListQ)", "Compose(TableQ,TextQ)", "Intersect(ImageListQ,TableQ)", "Intersect(TableQ,TextQ)"],
    "image": ["Compose(ImageQ,TableQ)", "Compose(ImageQ,TextQ)", "Intersect(ImageListQ,TextQ)"],
}


def rows() -> list[tuple[str, str, str, str]]:
    """(qtype, hop, first modality, second modality or '')."""
    second = {q: m for m, qs in SECOND_HOP.items() for q in qs}
    first = {q: m for m, qs in FIRST_HOP.items() for q in qs}
    return [(q, "single", SINGLE_HOP[q], "") if q in SINGLE_HOP else (q, "multi", first[q], second[q]) for q in QUESTION_TYPES]


def taxonomy(spark: SparkSession) -> DataFrame:
    """A dimension of 16 rows, one per type."""
    return spark.createDataFrame(rows(), "qtype string, hop string, first_modality string, second_modality string")


def decomposed(question: str, qtype: str, hop: int = 0, bridge: str | list[str] = "", separator: str = "[SEP]") -> str:
    """The prompt that names a hop and its bridge entities before the question."""
    bridge = bridge if isinstance(bridge, str) else "; ".join(bridge)
    return f" {separator} ".join([qtype, f"HOP={hop}", bridge, question])


def hop_prompt(question: Column, qtype: Column, hop: Column, bridge: Column, separator: str = "[SEP]") -> Column:
    """`decomposed` of columns; `bridge` is an array of entities."""
    return F.concat_ws(f" {separator} ", qtype, F.concat(F.lit("HOP="), hop.cast("string")), F.array_join(bridge, "; "), question)
