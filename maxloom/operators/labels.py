"""Query token classes from label records of several schemas.

A record names visual and non-visual tokens by index, mask, text or phrase, and each schema says where it keeps them and what
an unnamed token is. All schemas are read into the same marks, and marks into classes: visual wins over non-visual over the default.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Where values of a record keep their text or index, by precedence.
TEXT_KEYS = ("token", "text", "value", "phrase", "label", "content", "surface_form", "matched_text", "norm", "norm_phrase", "token_text", "raw_text")
INDEX_KEYS = ("index", "token_index", "query_token_idx", "idx")
# Fields of the visual-needed schema.
NEEDED = {
    "masks": ("visual_needed_mask", "visual_needed_token_mask", "visual_token_mask"),
    "indices": ("visual_needed_token_indices", "visual_needed_indices", "visual_token_indices"),
    "texts": ("visual_needed_tokens", "visual_needed_token_texts", "visual_needed_words", "visual_needed_terms", "visual_needed", "visual_tokens"),
    "phrases": ("visual_needed_phrases",),
}
BINARY = ("token_labels", "phrase_labels", "visual_token_count", "non_visual_token_count")
_LABELS = {"<bos>": "[BOS]", "<eos>": "[EOS]", "<pad>": "[PAD]"}


def plain(value) -> str:
    text = str(value if value is not None else "")
    return " ".join(_LABELS.get(text, text.replace("▁", " ")).lower().split())


def leaves(value, keys: tuple[str, ...]):
    """Scalars in nested JSON; of an object the first of `keys` that it has."""
    if isinstance(value, dict):
        value = next(([value[k]] for k in keys if k in value), [])
    if isinstance(value, list):
        for item in value:
            yield from leaves(item, keys)
    elif value is not None and not isinstance(value, bool):
        yield value


def texts_of(*values) -> set[str]:
    return {plain(v) for value in values for v in leaves(value, TEXT_KEYS) if isinstance(v, str) and plain(v)}


def indices_of(*values) -> set[int]:
    found = (v for value in values for v in leaves(value, INDEX_KEYS))
    return {int(v) for v in found if isinstance(v, int) or (isinstance(v, str) and v.strip().lstrip("-").isdigit())}


class Tokens:
    """A query's tokens, with the text that they make and where each starts and ends in it."""

    def __init__(self, labels: list[str], raws: list[str] | None):
        self.labels = labels
        raws = raws if raws is not None and len(raws) == len(labels) else None
        self.text, self.starts, self.ends = "", {}, {}
        for i, source in enumerate(raws or labels):
            word = plain(source)
            if not word:
                continue
            if self.text and (raws is None or source.startswith("▁")):
                self.text += " "
            self.starts[len(self.text)] = i
            self.text += word
            self.ends[len(self.text)] = i

    def spanned(self, phrases: set[str]) -> set[int]:
        """Tokens of every run whose text is a phrase."""
        out: set[int] = set()
        for phrase in phrases:
            at = self.text.find(phrase)
            while at >= 0:
                if at in self.starts and at + len(phrase) in self.ends:
                    out.update(range(self.starts[at], self.ends[at + len(phrase)] + 1))
                at = self.text.find(phrase, at + 1)
        return out

    def named(self, texts: set[str]) -> set[int]:
        return {i for i, label in enumerate(self.labels) if plain(label) in texts}


def _kind(value) -> str:
    text = str(value or "").strip().lower().replace("-", "_")
    return "visual" if text.startswith("visual") else "non_visual" if text.startswith("non_visual") else "unknown"


def _class(value) -> str:
    text = str(value).strip().lower()
    return text if text in ("visual", "non_visual") else "unknown"


def classes(record: dict | None, labels: list[str], raws: list[str] | None = None, needed: bool = False) -> list[str]:
    """The class of each token. `needed`: the file says that its schema is visual-needed."""
    n, tokens = len(labels), Tokens(labels, raws)
    record = record or {}
    visual: set[int] = set()
    other: set[int] = set()
    default = "unknown"
    if needed or any("visual_needed" in k.lower() for k in record):
        default = "non_visual"
        get = lambda part: [record.get(f) for f in NEEDED[part]]
        for mask in get("masks"):
            if isinstance(mask, list) and len(mask) == n:
                visual |= {i for i, v in enumerate(mask) if isinstance(v, (bool, int, float)) and v}
        words = texts_of(*get("texts"))
        visual |= indices_of(*get("indices")) | tokens.named(words) | tokens.spanned(words | texts_of(*get("phrases")))
    elif any(k in record for k in BINARY):
        default = "non_visual"
        items = record.get("token_labels") or []
        pick = lambda rows, *fields: texts_of(*[[x.get(f) for f in fields] for x in rows if isinstance(x, dict) and _kind(x.get("label")) == "visual"])
        words = pick(items, "norm", "token", "token_text")
        if len(items) == n:
            visual |= {i for i, x in enumerate(items) if isinstance(x, dict) and _kind(x.get("label")) == "visual"} | indices_of(record.get("visual_token_indices"))
        visual |= tokens.named(words) | tokens.spanned(words | pick(record.get("phrase_labels") or [], "norm_phrase", "raw_examples", "norm_tokens", "phrase"))
    else:
        listed = record.get("query_token_classes") or []
        if listed and all(isinstance(x, dict) for x in listed):
            own = {int(x.get("index", -1)): _class(x.get("class", "")) for x in listed}
            if any(v != "unknown" for i, v in own.items() if 0 <= i < n):
                return [own.get(i, "unknown") for i in range(n)]
        elif len(listed) == n and listed:
            return [_class(x) for x in listed]
        for into, prefix in ((visual, "visual"), (other, "non_visual")):
            words = {str(x).strip().lower() for x in record.get(f"{prefix}_tokens") or []}
            into |= indices_of(record.get(f"{prefix}_token_indices")) | {i for i, label in enumerate(labels) if label.strip().lower() in words} | tokens.spanned({plain(w) for w in words} - {""})
    return ["visual" if i in visual else "non_visual" if i in other else default for i in range(n)]


def record_id() -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in ("qid", "query_id", "question_id")])


@F.pandas_udf(ArrayType(StringType()))
def token_classes(record: pd.Series, labels: pd.Series, raws: pd.Series, needed: pd.Series) -> pd.Series:
    """Classes from a record's JSON, the tokens' labels and raw forms, and whether the file is a visual-needed one."""
    rows = zip(record, labels, raws, needed, strict=True)
    return pd.Series([classes(json.loads(r) if r else None, list(a), None if b is None else list(b), bool(n)) for r, a, b, n in rows])
