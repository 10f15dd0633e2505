import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tests_llm_data import CLASHING, prose  # noqa: E402


@pytest.fixture(scope="session")
def awkward_rows():
    """(doc_id, text): nulls, empty and blank texts, a very long one, ties, repeated rows, copies and near copies."""
    rng = random.Random(7)
    base = prose(rng, 300)
    words = base.split(" ")
    near = " ".join([*words[:150], "changed", *words[151:]])
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, base), (5, base.replace(" ", "  \n")), (6, near), (7, prose(rng, 60_000)), (8, "one two three"), (9, "one two three"), (9, "one two three"), (10, "é😀 ß\x00 x"), (None, base), (11, base[:700] + prose(rng, 50))]
    return rows + [(20 + i, prose(rng, rng.randrange(1, 200))) for i in range(30)]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, t, "en", "web" if (i or 0) % 3 else None) for i, t in awkward_rows], "doc_id long, text string, lang string, source string")
    return docs.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(c) for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
