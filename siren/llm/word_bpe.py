"""Token ids of whole texts with a public ``tokenizers`` file, encoding each distinct word once per worker.

The tokenizer drops white space, splits texts into words by a fixed pattern and never merges across words, so a text's
ids are the ids of its words one after the other. Texts of plain characters are split here by the same pattern; others
only at ASCII white space, into chunks. Unknown words are joined with blanks, encoded by the library in one call and
taken apart at the tokens that end a word.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from siren.llm.rows import held

CHUNKS = re.compile(r"[^\x20\x09-\x0D]+").findall
#: Characters whose lower case, composition and kind (letter, digit, white space, other) are beyond doubt.
PLAIN_TEXT = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ‐-‧‰-⁞]*").fullmatch
#: Of a plain text in lower case, the tokenizer's words: letters, endings behind an apostrophe, a digit, other marks.
WORDS = re.compile(
    r"[a-zà-öø-ÿß]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\x20\x09-\x0D0-9a-zà-öø-ÿß]+"
).findall
SPECIAL = "<|"
#: Single words of plain texts, encoded many at a time; chunks of other texts are encoded by themselves.
PLAIN = re.compile(r"[a-zà-öø-ÿß]{1,200}|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-&(-/:-@\[-`{-~]{1,200}").fullmatch
MAX_CACHED = 600_000
JOINED = 1_000
LOT_CHARS = 4_000_000

class ChunkEncoder:
    """Little-endian unsigned 32-bit ids of texts; the cache of words is emptied when it is full."""

    def __init__(self, path: str, max_cached: int = MAX_CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._max_cached = max_cached
        self._cache: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text; NULL counts as empty."""
        lot: list[str] = []
        size = 0
        for text in texts:
            lot.append(text or "")
            size += len(lot[-1])
            if size > LOT_CHARS:
                yield from self._encode_lot(lot)
                lot, size = [], 0
        yield from self._encode_lot(lot)

    def _encode_lot(self, texts: list[str]) -> Iterator[bytes]:
        if len(self._cache) > self._max_cached:
            self._cache.clear()
        known = self._cache.get
        found, unknown = [], set()
        for text in texts:
            plain = (text.isascii() or PLAIN_TEXT(text)) and SPECIAL not in text
            words = WORDS(text.lower()) if plain else CHUNKS(text)
            ids = list(map(known, words))
            if None in ids:
                unknown.update([word for word, i in zip(words, ids, strict=True) if i is None])
                found.append((words, None))
            else:
                found.append((None, b"".join(ids)))
        self._learn(unknown)
        known = self._cache.__getitem__
        for words, ids in found:
            yield b"".join(map(known, words)) if ids is None else ids

    def _learn(self, words: set[str]) -> None:
        """Encode unknown words; of those encoded together, each ends with the only token that ends a word."""
        plain = []
        for word in words:
            if PLAIN(word):
                plain.append(word)
            else:
                ids = self._tokenizer.encode(word, add_special_tokens=False).ids
                self._cache[word] = np.array(ids, "<u4").tobytes()
        for k in range(0, len(plain), JOINED):
            part = plain[k : k + JOINED]
            (encoding,) = self._tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(encoding.ids, "<u4")
            ends = np.flatnonzero(self._ends_word[ids]) + 1
            if len(ends) != len(part):
                raise AssertionError("the tokenizer splits words differently")
            ids = ids.tobytes()
            start = 0
            for word, end in zip(part, (4 * ends).tolist(), strict=True):
                self._cache[word] = ids[start:end]
                start = end


def chunk_encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of a tokenizer file."""
    return held(("words", path), lambda: ChunkEncoder(path))
