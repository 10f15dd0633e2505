"""Operators that give a row per text: 2, 5, 7, 9, 10."""

import os
import random
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tests_llm_data import prose
from pyspark.sql import functions as F

from maxloom.llm import license_scan, packing, quality, token_counts, toxicity
from maxloom.llm.queries import word_vocabulary
from maxloom.llm.wordpiece import WordEncoder

VOCABULARY = word_vocabulary()


def library_counts(texts):
    library = WordEncoder(VOCABULARY).library
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_word_encoder_equals_library_on_random_text():
    rng = random.Random(5)
    letters = list("aAbBzZ09 '\t\n\x0b\x0c\r\x1c\x1f\x85\xa0!?_éÉßİıǅ<|>endoftxsvrlmσΣ—中́​.Ɐ²½ªº\xad")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["<|endoftext|> hi <|startoftext|>", "", None, "it's we'll I'D '''s"]
    encoder = WordEncoder(VOCABULARY)
    want = [encoder.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.ids(pa.array(texts, pa.string()))] == want
    assert encoder.counts(pa.array(texts, pa.string())).tolist() == [len(x) for x in want]


def test_word_encoder_keeps_common_words_when_its_cache_is_full(monkeypatch):
    from maxloom.llm import wordpiece

    monkeypatch.setattr(wordpiece, "CACHE_WORDS", 50)
    encoder = WordEncoder(VOCABULARY)
    rng = random.Random(1)
    for _ in range(8):
        texts = [prose(rng, 40) for _ in range(5)]
        assert encoder.counts(pa.array(texts)).tolist() == library_counts(texts)


def test_token_counts_equal_the_library(awkward, awkward_rows):
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(awkward, VOCABULARY).collect())
    counts = library_counts([t for _, t in awkward_rows])
    assert got == sorted((i or -1, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(awkward_rows, counts, strict=True))


def test_token_counts_encode_only_what_the_cache_lacks(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c")], "doc_id long, text string")
    token_counts.token_counts(docs, VOCABULARY, cache_path=cache).collect()
    assert spark.read.parquet(cache).count() == 2
    more = docs.union(spark.createDataFrame([(4, "d"), (5, "c")], "doc_id long, text string"))
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(more, VOCABULARY, cache_path=cache).collect()} == {1: 2, 2: 2, 3: 1, 4: 1, 5: 1}
    assert spark.read.parquet(cache).count() == 3


def test_token_counts_of_a_sentencepiece_model(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([(1, "Hello, world"), (2, None), (3, "é 😀")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, path).collect()} == {1: len(model.encode("Hello, world")), 2: 0, 3: len(model.encode("é 😀"))}


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_texts_that_differ_in_white_space_have_their_own_counts(spark, file):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path(file)
    texts = ["a\n\nb", "a b", "a\tb", "a     b", " a b", "a b ", "a\x0bb", "\n", "", None]
    if file.endswith(".json"):
        want = [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in texts]
    else:
        want = [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t or "")) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = token_counts.token_counts(docs, path).collect()
    assert [r["n_tokens"] for r in sorted(got, key=lambda r: r["doc_id"])] == want


def test_token_counts_need_no_encoder_when_the_cache_has_all(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "a b"), (2, "c d e")], "doc_id long, text string")
    token_counts.token_counts(docs, VOCABULARY, cache_path=cache).collect()

    def fails(path):
        def run(batches):
            for batch in batches:
                raise AssertionError(f"encodes {batch.num_rows} texts")
            yield from ()

        return run

    monkeypatch.setattr(token_counts, "_encode", fails)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, VOCABULARY, cache_path=cache).collect()} == {1: 2, 2: 3}


def test_packing_round_trip(awkward, awkward_rows):
    pieces = [r.asDict() for r in packing.pack(awkward, VOCABULARY).collect()]
    library = WordEncoder(VOCABULARY).library
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for i, text in awkward_rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[i], key=lambda p: (p["start"], p["sequence_id"]))
        if sum(r[0] == i for r in awkward_rows) == 1:
            at = 0
            for p in own:
                assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
                at += p["length"]
            assert at == len(ids)
        else:
            assert sum(p["length"] for p in own) == len(ids) * sum(r[0] == i for r in awkward_rows)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096


def test_differencing_is_near_equal_and_whole():
    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.randrange(1, 1500) for _ in range(rng.randrange(1, 300))]
        k = rng.randrange(1, 12)
        dealt = packing.differencing(sizes, k)
        assert sorted(i for x in dealt for i in x) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in x) for x in dealt] + [0] * (k - len(dealt))
        assert len(dealt) <= k and (len(sizes) < 20 * k or max(sums) - min(sums) <= 1500 / 10)
        windows = packing.windows(sizes, 4096)
        assert max(sum(sizes[i] for i in x) for x in windows) <= 4096
    assert packing.windows([], 4096) == []


def test_packing_pads_little():
    rng = random.Random(3)
    sizes = [rng.randrange(1, packing.PIECE + 1) for _ in range(2000)]
    assert sum(sizes) / (4096 * len(packing.windows(sizes, 4096))) > 0.98


def test_license_scan_equals_brute_force(spark, awkward):
    notices = [(100 + i, f"Some words here. {text}\nand more, der mit die") for i, (_, text) in enumerate(license_scan.TEMPLATES)]
    extra = spark.createDataFrame([*notices, (200, "CC-BY all rights RESERVED cc by"), (201, "released under mit license the"), (202, "All\nrights reserved")], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").where("doc_id <> 9").union(extra)
    got = license_scan.license_scan(docs.withColumn("words", F.lit(1))).toPandas().sort_values("doc_id").reset_index(drop=True)
    connection = duckdb.connect()
    documents = docs.toPandas()
    connection.register("documents", documents)
    want = connection.execute(license_scan.oracle()).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
    for c in got.columns:
        assert (got[c].fillna(-1) == want[c].fillna(-1)).all(), c
    assert set(got[got.doc_id == 102].labels) == {"mit"} and set(got[got.doc_id == 200].base_labels) == {"cc-by,reserved"}


def block_labels(text):
    """Every stretch of words against every template, in plain Python."""
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    found = set()
    for label, template in license_scan.TEMPLATES:
        wanted = set(license_scan.tokens(template))
        width = -(-len(license_scan.tokens(template)) * 5 // 4)
        if any(10 * len(wanted.intersection(words[i : i + width])) >= 9 * len(wanted) for i in range(len(words))):
            found.add(label)
    return found


def test_license_notices_are_found_verbatim_wrapped_and_in_comments(spark):
    rng = random.Random(12)
    texts = []
    for _, template in license_scan.TEMPLATES:
        lines = textwrap.wrap(template, 40)
        texts += [template, "\n".join(lines), "\n".join("# " + x for x in lines), "/*\n" + "\n".join(" * " + x for x in lines) + "\n */", template.upper(), prose(rng, 50) + " " + template.replace(" ", "\n\n") + " " + prose(rng, 50)]
    whole = len(texts)
    # Words left out, put in between and shuffled: some still match.
    for _, template in license_scan.TEMPLATES * 6:
        words = template.split(" ")
        for _ in range(rng.randrange(4)):
            if rng.random() < 0.5:
                words.pop(rng.randrange(len(words)))
            else:
                words.insert(rng.randrange(len(words)), prose(rng, rng.randrange(1, 4)))
        texts.append(prose(rng, rng.randrange(20)) + " " + " ".join(words) + " " + prose(rng, rng.randrange(20)))
    texts += ["mit license the under, released " * 3, "License License License mit", "the of in and", None, ""]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        base = set(filter(None, got[i]["base_labels"].split(",")))
        assert set(filter(None, got[i]["labels"].split(","))) == base | block_labels(text), text
    per = whole // len(license_scan.TEMPLATES)
    assert all(license_scan.TEMPLATES[i // per][0] in got[i]["labels"].split(",") for i in range(whole))


def test_license_scan_keeps_null_and_repeated_ids(awkward, awkward_rows, nothing):
    assert license_scan.license_scan(awkward).count() == len(awkward_rows)
    assert license_scan.license_scan(nothing).count() == 0


@pytest.fixture(scope="module")
def learnable(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randrange(30, 120)).split(" ")
        good, toxic = i % 4 != 0, i % 3 == 0
        if not good:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["wretched", "vermin", "fools"])
        docs.append((i, " ".join(words)))
        if i % 10 != 9:
            labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("operator", "label", "fold", "rest", "threshold", "bar"), [(quality.quality, "quality", 5, 0, 0.3, 0.95), (toxicity.toxicity, "toxic", 3, 1, 0.7, 0.85)])
def test_classifiers_on_held_out_rows(learnable, awkward, awkward_rows, nothing, operator, label, fold, rest, threshold, bar):
    docs, labels = learnable
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    rows = operator(docs, labels).collect()
    assert len(rows) == 900
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold == rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > bar
    assert operator(awkward, labels).count() == len(awkward_rows)
    assert operator(nothing, labels).count() == 0
    assert operator(docs, labels.limit(0)).count() == 900


def test_classifiers_do_not_read_held_out_labels(learnable):
    docs, labels = learnable
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    for operator in (quality.quality, toxicity.toxicity):
        assert sorted(map(tuple, operator(docs, labels).collect())) == sorted(map(tuple, operator(docs, flipped).collect()))


def plain_statistics(text):
    """The statistics of one text in plain Python, by name."""
    data = text.encode()
    words = re.findall(rb"[a-z0-9\x80-\xff]+", data.lower())
    starts = [m.start() for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+", data)]
    lines = re.findall(rb"[^\n\r]*[\n\r]|[^\n\r]+$", data)
    grams = [tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    n, w = max(len(data), 1), max(len(words), 1)
    mark = lambda b: 33 <= b < 127 and not chr(b).isalnum()
    share = lambda f: max(sum(map(f, x)) / len(x) for x in lines) if lines else 0.0
    lengths = np.array([len(x) for x in words] or [0])
    return {
        0: np.log1p(len(data)), 1: np.log1p(len(words)), 2 + 1: sum(97 <= b < 123 for b in data) / n, 2 + 2: sum(65 <= b < 91 for b in data) / n,
        15: sum(map(mark, data)) / n, 16: sum(a == b for a, b in zip(data, data[1:])) / n, 17: lengths.mean(), 18: lengths.std(),
        19: sum(len(x) <= 3 for x in words) / w, 21: sum(65 <= data[i] < 91 for i in starts) / w, 23: len(set(words)) / w, 24: len(set(grams)) / max(len(grams), 1),
        25: np.log1p(len(lines)), 26: share(mark), 27: share(lambda b: 65 <= b < 91), 31: len(set(lines)) / max(len(lines), 1), 32: len(data) / max(len(lines), 1),
    }


def test_statistics_equal_plain_python_whole_and_in_pieces():
    rng = random.Random(15)
    texts = ["", "a", "one two", "\n\n\n", "ab\r\ncd\n", "x" * 500, "!!! ??", "é ß\nÉ É"]
    for _ in range(60):
        lines = [prose(rng, rng.randrange(0, 30)) for _ in range(rng.randrange(1, 12))]
        text = rng.choice(["\n", " ", "\n\n"]).join(rng.choice(lines) for _ in range(rng.randrange(1, 25)))
        texts.append("".join(c.upper() if rng.random() < 0.1 else c for c in text) + rng.choice(["", "!", "\n", " "]))
    together = quality.statistics(pa.array(texts))
    for text, row in zip(texts, together, strict=True):
        for k, v in plain_statistics(text).items():
            assert abs(row[k] - v) < 1e-9, (text, k)
        for most in (64, 300):
            pieces = quality.statistics(pa.array([text]), most)[0]
            if max(map(len, re.findall(rb"[A-Za-z0-9\x80-\xff]+", text.encode())), default=0) < most:  # longer words are cut
                assert np.allclose(pieces, row, atol=1e-9), (text, np.flatnonzero(abs(pieces - row) > 1e-9))


def test_statistics_of_a_very_long_text_take_bounded_memory():
    import resource

    words = prose(random.Random(1), 200_000)
    text = pa.array([" \n".join([words] * 30)])  # some 50 MB
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    row = quality.statistics(text)
    taken = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert taken < 12 * text.nbytes / (1 << 20) and np.isfinite(row).all()


def test_trees_equal_a_walk_of_each_row():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x, y, trees=20, depth=3)
    for row, margin in zip(x[:50], model.margin(x[:50]), strict=True):
        total = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        assert abs(total - margin) < 1e-9
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_vocabulary_is_not_copied_here():
    assert not os.path.exists(os.path.join(os.path.dirname(token_counts.__file__), os.path.basename(VOCABULARY)))
