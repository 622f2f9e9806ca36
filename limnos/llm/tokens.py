"""Token ids of whole texts from a public tokenizer, each distinct word encoded once per worker."""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from limnos.llm.common import coded, offsets, spans, split_words

END_ID = 1
#: Letters without combining marks, with one full stop or comma at most: lower case and the cut before the mark are safe.
PLAIN_WORD = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
#: Words that a worker keeps beside those of its last block, and text that is encoded at once: both bound a worker's memory.
CACHE_WORDS = 300_000
TEXT_BYTES = 8 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts, equal to `tokenizers` on whole texts without added special tokens.

    A model with word ends drops white space before its merges, so the ids of a text are those of its words between
    ASCII blanks, one after the other. Other models encode the text as one word.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        size = self.model.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.by_word = bool(suffix)
        if suffix:
            self.ends = np.zeros(size, bool)
            self.ends[[i for piece, i in self.model.get_vocab().items() if piece.endswith(suffix)]] = True
        self.keep(pa.array([], pa.string()), np.empty(0, self.dtype), np.empty(0, np.int64))
        if suffix:
            self.marks = [self._each([mark])[0] for mark in ".,"]

    def keep(self, words: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """The known words: their ids lie one after the other."""
        self.words, self.ids, self.counts, self.starts = words, ids, counts, np.cumsum(counts) - counts

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the number per text."""
        found = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], self.dtype), np.array([len(ids) for ids in found], np.int64)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters only: a thousand at a time in one text, cut after each word end."""
        out = []
        for i in range(0, len(words), 1000):
            part = words[i:i + 1000]
            ids = np.array(self.model.encode(" ".join(part), add_special_tokens=False).ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            # another number of ends: a word in several pieces with ends
            out.append((ids, np.diff(np.r_[0, cuts])) if len(cuts) == len(part) else self._each(part))
        return _joined(out, self.dtype)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Places of words among the known ones; new ones are encoded. Beyond CACHE_WORDS only these words stay known."""
        at = pc.index_in(words, self.words)
        missing = words.filter(pc.is_null(at))
        if len(missing):
            letters = pc.match_substring_regex(missing, PLAIN_WORD)
            plain, other = missing.filter(letters), missing.filter(pc.invert(letters))
            ids, counts = _joined([(self.ids, self.counts), self._together(plain.to_pylist()), self._each(other.to_pylist())], self.dtype)
            self.keep(pa.concat_arrays([self.words, plain, other]), ids, counts)
            at = pc.index_in(words, self.words)
        at = at.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self.words) > max(CACHE_WORDS, 2 * len(words)):
            each = self.counts[at]
            self.keep(words, self.ids[spans(each, self.starts[at])], each)
            at = np.arange(len(words))
        return at

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the number of ids per text (null: none)."""
        if not self.by_word:
            return self._each([t or "" for t in texts.to_pylist()])
        words, counts = split_words(texts)
        if not len(words):
            return np.empty(0, self.dtype), counts
        codes, names = coded(words.cast(pa.string()))
        # a plain word is known by its lower case without the mark behind it
        plain = pc.match_substring_regex(names, PLAIN_WORD)
        lower = pc.utf8_lower(names)
        heads = pc.if_else(plain, pc.utf8_rtrim(lower, ".,"), names)
        head_codes, head_names = coded(heads)
        at = self._learn(head_names)[head_codes]
        size, start = self.counts[at], self.starts[at]
        mark = [pc.and_(plain, pc.and_(pc.ends_with(lower, m), pc.greater(pc.binary_length(lower), 1))).to_numpy(zero_copy_only=False) for m in ".,"]
        whole = size + sum(len(ids) * m for ids, m in zip(self.marks, mark))
        place = np.cumsum(whole) - whole
        pool = np.empty(int(whole.sum()), self.dtype)
        pool[spans(size, place)] = self.ids[spans(size, start)]
        for ids, m in zip(self.marks, mark):
            for i, value in enumerate(ids):
                pool[(place + size)[m] + i] = value
        each = whole[codes]
        return pool[spans(each, place[codes])], np.diff(offsets(each)[offsets(counts)])


def _joined(parts: list[tuple[np.ndarray, np.ndarray]], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate([np.empty(0, dtype), *[ids for ids, _ in parts]]), np.concatenate([np.empty(0, np.int64), *[counts for _, counts in parts]]))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)
