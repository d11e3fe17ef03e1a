"""Ids of a Hugging Face tokenizer file, word by word.

The tokenizer drops white space and never merges over it, so a text's ids are its words' ids in turn. Arrow
texts are taken in parts of about PART_BYTES: Arrow splits them and finds a part's distinct words, only those
are encoded, and numpy puts their ids in place. Words of plain letters, digits and signs are lower-cased and cut
by the file's own pattern all at once, and each distinct piece goes to the library's BPE model; all others
(controls, marks, letters beyond U+012F, special tokens) go through the library's encode. Nothing but the tokenizer outlives a part.

A null text is empty; an empty one has no ids. Very long texts are encoded whole, one a part if need be.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of text that are split at once (one text more at most).
PART_BYTES = 6 << 20
#: Words of these characters are cut and lower-cased alike whether alone or among others; for Arrow.
_PLAIN = "^[!-~\xa1-\xac\xae-\u012f]+$"
#: What str.split or the file's pattern may cut at, besides ASCII white space; for Python and for Arrow.
_ODD = regex.compile(r"[\x1c-\x1f\x85\xa0  -     　]")
_ODD_BYTES = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(free)) for b in range(256)}


def _spread(values: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values holds runs of the given sizes; the runs numbered at, one behind another, and the sizes of these."""
    own = size[at]
    ends = np.cumsum(own)
    place = np.repeat(((np.cumsum(size) - size)[at] - ends + own).astype(np.int32), own)
    place += np.arange(len(place), dtype=np.int32)
    return values[place], own


def _joined(words: pa.Array) -> str:
    """Line by line."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()


class WordIds:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"] + r"|\n")
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):  # each piece is asked for once, so a cache only costs
            self.model._resize_cache(0)
        self.letters = _byte_letters() | {ord("\n"): "\n"}

    def _pieces(self, pieces: pa.Array) -> tuple[list[int], list[int]]:
        """Ids in a row of lower-case pieces that the pattern leaves whole, and how many each has."""
        shown = _joined(pieces)
        if not shown.isascii():
            shown = shown.encode().decode("latin-1").translate(self.letters)
        ids, sizes, tokenize = [], [], self.model.tokenize
        for piece in shown.split("\n") if len(pieces) else []:
            found = tokenize(piece)
            sizes.append(len(found))
            ids += [t.id for t in found]
        return ids, sizes

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in a row, and how many each has. Plain words are cut into pieces together, and each piece is encoded once."""
        plain = pc.and_not(pc.match_substring_regex(words, _PLAIN), pc.match_substring(words, "<|"))
        text = _joined(pc.if_else(plain, words, ""))
        pieces = pa.array(self.pattern.findall("\n" + text.lower()), pa.string()).dictionary_encode()
        at = pieces.indices.to_numpy().copy()  # 0 is the line feed before each word
        ids, sizes = self._pieces(pieces.dictionary[1:])
        sizes = [0, *sizes]
        other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        first = np.flatnonzero(at == 0)
        at[first[other]] = len(sizes) + np.arange(len(other))  # what the line feed before such a word stands for
        for word in words.take(pa.array(other)).to_pylist():
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
            ids += found
            sizes.append(len(found))
        values, own = _spread(np.array(ids, np.uint32), np.array(sizes, np.int64), at)
        return values, np.add.reduceat(own, first)

    def parts(self, texts: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of texts in turn: how many, their ids (uint32) with the end id behind each text, and where each text's begin (one more than there are texts)."""
        texts = texts.fill_null("")
        part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // PART_BYTES
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                values, sizes = self._part_of(texts.slice(a, b - a))
                offsets = np.cumsum(sizes)
                yield b - a, np.insert(values, offsets, np.uint32(end)), np.concatenate([[0], offsets + np.arange(1, b - a + 1)])

    def _part_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row, and how many each text has."""
        odd = pc.match_substring_regex(texts, _ODD_BYTES)
        if pc.any(odd).as_py():  # those texts are cut otherwise
            lists = pa.array([_cut(t) if o else t.split() for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)], pa.list_(pa.string()))
        else:
            lists = pc.ascii_split_whitespace(texts)
        begins = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        words = lists.flatten().dictionary_encode()
        values, size = self._words(words.dictionary)
        values, own = _spread(values, size, words.indices.to_numpy())
        return values, np.diff(np.concatenate([[0], np.cumsum(own)])[begins])


def _cut(text: str) -> list[str]:
    """Cut at white space; str.split also cuts at U+001C..U+001F, U+0085 and U+00A0, where the file's pattern may not."""
    return regex.split(r"[ \t\n\r]+", text.strip(" \t\n\r")) if _ODD.search(text) else text.split()


@lru_cache(maxsize=1)
def word_ids(path: str | None = None) -> WordIds:
    """One a Python worker."""
    return WordIds(path or default_path())
