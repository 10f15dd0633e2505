"""Exact, fast token ids for word-level BPE vocabularies: a text's distinct words are encoded once, in Arrow.

The vocabulary's pre-tokenizer cuts a normalised text into words that BPE then treats one by one, so ids of a text are
its words' ids laid end to end. Texts on which Arrow's lower-casing or character classes could differ from the
library's (anything beyond Latin letters, or a special string) go to the library itself.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = r"\x09-\x0D \x{85}\x{A0}"
_PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^{_SPACE}\pL\pN]+"
_ODD = r"[^\x00-\x{24F}]|\x{130}|<\|"
#: Words kept between batches; beyond it only the commonest stay, so memory is bounded.
CACHE_WORDS = 120_000
#: Text bytes per batch that suit it.
BATCH_BYTES = 2 << 20


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_END = "</w>"


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process: loading it costs as much as a second of texts."""
    return WordEncoder(path)


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import normalizers, pre_tokenizers

        self.path = path
        # The same model for words that are cut and normalised already: many in a call, told apart by their end marks.
        self.model = load(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.model.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for token, i in self.model.get_vocab().items() if token.endswith(_END)]] = True
        # Row 0 is the empty word, of no ids; it stays.
        self.known: dict[str, int] = {"": 0}
        self.flat = np.empty(0, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.sizes = np.zeros(1, np.int64)
        self.used = np.full(1, 1 << 60, np.int64)

    @functools.cached_property
    def library(self):
        """The tokenizer as its file has it; loaded when the first odd text comes."""
        return load(self.path)

    def _shrink(self) -> None:
        """Keep the words that came in the most batches, at most half the cache."""
        least = max(2, int(np.partition(self.used, -(CACHE_WORDS // 2))[-(CACHE_WORDS // 2)]) + 1)
        keep = self.used >= least
        number = np.cumsum(keep) - 1
        self.known = {w: int(number[r]) for w, r in self.known.items() if keep[r]}
        sizes = self.sizes[keep]
        where = np.repeat(self.starts[keep] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        self.flat, self.sizes, self.starts, self.used = self.flat[where], sizes, np.cumsum(sizes) - sizes, self.used[keep]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lots = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        flat = np.concatenate([np.asarray(e.ids, np.uint32) for e in self.model.encode_batch_fast(lots, add_special_tokens=False)])
        sizes = np.diff(np.flatnonzero(self.ends[flat]), prepend=-1)
        if len(sizes) != len(words):
            raise ValueError("the vocabulary does not mark every word's end")
        return flat, sizes

    def _rows(self, words: list[str]) -> np.ndarray:
        """The cache row of each of these distinct words; words not seen before are encoded."""
        if len(self.known) > CACHE_WORDS + 1:
            self._shrink()
        rows = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(rows < 0)
        if len(new):
            fresh = [words[i] for i in new]
            flat, sizes = self._encode(fresh)
            first = len(self.sizes)
            self.known.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            rows[new] = np.arange(first, first + len(fresh))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat = np.concatenate([self.flat, flat])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])
        self.used[rows] += 1
        return rows

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Words' cache rows, the texts' word offsets, and which texts are odd."""
        odd = pc.match_substring_regex(texts, _ODD)
        plain = pc.if_else(odd, "", texts)
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), pattern=_PIECE, replacement=r"\0 "))
        # U+0085 and U+00A0 lie between pieces and stick to the next one's front.
        words, at = pc.utf8_trim(lists.values, "\x85\xa0") if _has_wide_space(plain) else lists.values, np.asarray(lists.offsets)
        coded = words.dictionary_encode()
        rows = self._rows(coded.dictionary.to_pylist())
        return rows[coded.indices.to_numpy(zero_copy_only=False)], at, odd

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        row, at, odd = self._split(texts)
        size = self.sizes[row]
        ends = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.starts[row] - ends[:-1], size) + np.arange(ends[-1])
        flat, bounds = self.flat[where], ends[at]
        out = [flat[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[i] = np.asarray(self.library.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return out

    def counts(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "")
        row, at, odd = self._split(texts)
        ends = np.concatenate([[0], np.cumsum(self.sizes[row])])
        out = np.diff(ends[at])
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[i] = len(self.library.encode(texts[int(i)].as_py(), add_special_tokens=False).ids)
        return out


def _has_wide_space(texts: pa.Array) -> bool:
    return bool(pc.any(pc.match_substring_regex(texts, r"[\x{85}\x{A0}]")).as_py())
