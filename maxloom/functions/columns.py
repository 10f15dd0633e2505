"""Column expressions: vectors, page geometry, labels, ranks. Built-in functions only, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Words that carry no retrieval signal.
SOFT_STOPWORDS = ["a", "an", "and", "are", "as", "at", "for", "in", "is", "it", "its", "of", "on", "or", "that", "the", "their", "there", "these", "this", "those", "to", "was", "were", "which", "who", "with"]
STOPWORDS = [*SOFT_STOPWORDS, "be", "been", "being", "did", "do", "does", "had", "has", "have", "how", "what", "when", "where", "why", "whom", "whose"]
SPECIAL_LABELS = ["[bos]", "[eos]", "[pad]", "[ws]"]
# Raw tokens with a label of their own.
TOKEN_LABELS = {"<bos>": "[BOS]", "<eos>": "[EOS]", "<pad>": "[PAD]"}


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def ranked(partition: list[str], *order) -> Column:
    """1-based BIGINT row number."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long")


def page_uid(doc_id="doc_id", page_idx="page_idx") -> Column:
    return F.concat(col(doc_id), F.lit("_page"), col(page_idx).cast("string"))


def uid_doc(uid) -> Column:
    """The document of a page uid; ids may hold `_page` themselves, so the last one counts."""
    return F.regexp_extract(col(uid), r"^(.*)_page(\d+)$", 1)


def uid_page(uid) -> Column:
    return F.regexp_extract(col(uid), r"^(.*)_page(\d+)$", 2).try_cast("int")


def grid_side(tokens) -> Column:
    """Side of the largest square of patches; what is over is not spatial."""
    return F.floor(F.sqrt(col(tokens).cast("double"))).cast("long")


def patch_index(token_idx, tokens, position: str = "suffix") -> Column:
    """Patch of a token, null where it is not spatial; the extra tokens come last (`suffix`) or first (`prefix`)."""
    spatial = grid_side(tokens) * grid_side(tokens)
    at = col(token_idx) - (F.lit(0) if position == "suffix" else col(tokens) - spatial)
    return F.when((at >= 0) & (at < spatial), at).cast("long")


def quadrant(patch, side) -> Column:
    mid = F.floor(col(side) / 2)
    row, column = F.floor(col(patch) / col(side)), col(patch) % col(side)
    return F.when(col(side) >= 2, (row >= mid).cast("long") * 2 + (column >= mid).cast("long"))


def token_label(raw) -> Column:
    named = reduce(lambda acc, kv: acc.when(col(raw) == kv[0], kv[1]), list(TOKEN_LABELS.items())[1:], F.when(col(raw) == next(iter(TOKEN_LABELS)), TOKEN_LABELS[next(iter(TOKEN_LABELS))]))
    spaced = F.regexp_replace(col(raw), "▁", " ")
    return named.otherwise(F.when(F.trim(spaced) == "", F.lit("[WS]")).otherwise(spaced))


def normalised_label(label) -> Column:
    return F.lower(F.trim(F.regexp_replace(col(label), r"\s+", " ")))


def informative(label) -> Column:
    """Whether a token label says something: not blank, special or a stopword, and with a letter or digit."""
    text = normalised_label(label)
    return (text != "") & ~text.isin(*SPECIAL_LABELS, *STOPWORDS) & text.rlike(r"[\p{L}\p{N}]")


def query_keep(raw, attention, mode: str = "full") -> Column:
    """Query tokens that a filter keeps: full, drop_pad_like or semantic_only; masked tokens never."""
    attention = F.coalesce(col(attention), F.lit(True))
    if mode == "full":
        return attention
    pad_like = col(raw).isin("<pad>", "<bos>", "<eos>")
    if mode == "drop_pad_like":
        return attention & ~pad_like
    if mode == "semantic_only":
        return attention & ~pad_like & ~F.trim(F.regexp_replace(col(raw), "▁", " ")).isin("Question", ":", "")
    raise ValueError(f"no query token filter {mode!r}")


def movement(before, after) -> Column:
    """What a rank did between two runs; a missing rank is not an infinite one."""
    before, after = col(before), col(after)
    return (
        F.when(before.isNull() & after.isNull(), "missing_in_both")
        .when(before.isNull(), "newly_found")
        .when(after.isNull(), "newly_lost")
        .when(after < before, "improved")
        .when(after > before, "worsened")
        .otherwise("unchanged")
    )


def failure_bucket(exact, pruned, topk: int = 4, near: int = 10, gain: int = 5) -> Column:
    """Why a pruned run misses the top, from the exact and the pruned rank of its first gold document."""
    exact, pruned = col(exact), col(pruned)
    return (
        F.when(exact.isNull(), "retrieval_missing")
        .when(exact <= topk, "pruning_damage_exact_recovers_topk")
        .when(F.coalesce(pruned - exact >= gain, F.lit(False)), "pruning_damage_exact_improves_but_still_fails")
        .when(exact <= near, "boundary_exact_still_fails")
        .otherwise("hard_fail_even_exact")
    )


def evidence_score(response) -> Column:
    """A yes/no answer's evidence: 1 yes, 0 no or nothing, between for hedges."""
    text = F.lower(F.trim(F.regexp_replace(F.coalesce(col(response), F.lit("")), r"\s+", " ")))
    yes, no = text.contains("yes"), text.contains("no")
    return (
        F.when(text == "", 0.0)
        .when(text.startswith("yes"), 1.0)
        .when(text.startswith("no"), 0.0)
        .when(reduce(lambda a, w: a | text.contains(w), ["unclear", "partially", "possibly", "unsure"], text.contains("maybe")), 0.5)
        .when(yes & ~no, 0.75)
        .when(no & ~yes, 0.25)
        .otherwise(0.5)
    )


# What a question's words say about the kind of visual cue, tried in this order.
CUES = {
    "logo_symbol": [" logo", "logo ", "logo?", "logo.", "logo,", "symbol", "jersey", "sponsored by", "sponsor", "crest"],
    "scene_building_location": ["building", "airport", "venue", "city", "location", "lawn", "entrance", "pier", "inlet", "seat", "seats", "arch", "stadium", "ground"],
    "face_hair_body_attribute": [" hair", "beard", "beards", "bald", "helmet", "glasses", "wearing", "descent", "african american", "african heritage", "red-haired", "blonde", "short dark hair"],
    "cover": ["poster", "cover", "title screen", "title poster", "film cover"],
    "cover_object": ["penguin", "gorilla", "dolphin", "motorcycle", "train", "torch", "books", "stethoscope", "guitar", "face", "woman", "man", "old man", "gymnast", "fire explosion", "shirtless", "boxing gloves", "single old man", "one woman", "four people"],
}


def cue_type(question) -> Column:
    text = F.lower(F.trim(F.regexp_replace(F.coalesce(col(question), F.lit("")), r"\s+", " ")))
    has = {k: reduce(lambda a, w: a | text.contains(w), v[1:], text.contains(v[0])) for k, v in CUES.items()}
    return (
        F.when(has["logo_symbol"], "logo_symbol")
        .when(has["scene_building_location"], "scene_building_location")
        .when(has["cover"] & has["cover_object"], "animal_or_object_on_cover")
        .when(has["face_hair_body_attribute"], "face_hair_body_attribute")
        .when(has["cover"], "poster_or_cover_object")
        .otherwise("other")
    )


def standardised(values: dict[str, Column], means: dict[str, float], stds: dict[str, float], weights: dict[str, float], bias: float = 0.0) -> Column:
    """bias + sum of weight * (value - mean) / std; a std of 0 or less does not scale."""
    total = F.lit(float(bias))
    for name, value in values.items():
        scale = stds[name] if stds[name] > 0 else 1.0
        total = total + (value.cast("double") - means[name]) / scale * weights[name]
    return total


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def numbers_in(text) -> Column:
    """Numbers among a text's words, thousands commas allowed in whole ones; zeros are left out."""
    words = F.filter(F.split(col(text), r"\s+"), lambda w: w != "")
    whole = lambda w: F.when(F.replace(w, F.lit(","), F.lit("")).rlike(r"^[+-]?\d+$"), F.replace(w, F.lit(","), F.lit("")))
    value = lambda w: F.coalesce(whole(w), F.when(w.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), w)).try_cast("double")
    return F.filter(F.transform(words, value), lambda x: x.isNotNull() & (x != 0))


def safe_name(text) -> Column:
    """A text made fit for a file name."""
    return F.regexp_replace(F.trim(col(text)), r"[^A-Za-z0-9._-]+", "_")


def run_mode(name) -> Column:
    """The retrieval mode that a run's folder name tells."""
    text = F.lower(col(name))
    return F.when(text.contains("two_stage"), "two_stage").when(text.contains("exact"), "exact").otherwise("ann")


def run_token_filter(name) -> Column:
    text = F.lower(col(name))
    return F.when(text.contains("semantic_only"), "semantic_only").when(text.contains("drop_pad"), "drop_pad_like").otherwise("full")


def run_qid(name) -> Column:
    return F.regexp_extract(col(name), r"(?:^|[_/])qid[_=]?([A-Za-z0-9]+)", 1)


def float_list(text: str) -> list[float]:
    """Numbers between commas, blanks left out; fails if there is none."""
    out = [float(x) for x in text.split(",") if x.strip()]
    if not out:
        raise ValueError(f"no numbers in {text!r}")
    return out
