"""SentencePiece encoding and decoding for merge-type vocabularies.

A word's symbols start as its characters; of all adjacent pairs that are a piece, the one with the best score, then
the leftmost, is merged, until none is left. The pairs wait in an agenda ordered by score. Symbols that are no piece
become byte pieces. No merge crosses a place whose two characters stand side by side in no piece, so texts are taken
apart there and each distinct part is merged once per worker.

Every part that the agenda has merged is checked against the library when it is learned, and every text's ids must
decode to the text again; ``check="texts"`` also encodes every whole text with the library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siren.llm.rows import held, id_and_text, slices

SPACE = "▁"
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
MAX_CACHED = 600_000
#: Parts up to this long keep their agenda as the list of their pairs' scores, longer ones as a heap.
SHORT_PART = 40
LOT_CHARS = 2_000_000
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

NO_PIECE = float("-inf")


class PieceCoder:
    """The pieces of a model file with identity normalisation."""

    def __init__(self, path: str, max_cached: int = MAX_CACHED):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE or rules.precompiled_charsmap:
            raise ValueError("only merge-type models without normalisation")
        if rules.remove_extra_whitespaces or not rules.escape_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("only models that keep white space and begin texts with a blank")
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == p.NORMAL]
        if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces):
            raise ValueError("only models without user-defined or unused pieces")
        self._score = {p.piece: p.score for _, p in normal}
        self._id = {p.piece: i for i, p in normal}
        self._byte = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self._together = {p.piece[k : k + 2] for _, p in normal for k in range(len(p.piece) - 1)}
        if any(SPACE in piece.lstrip(SPACE) for piece in self._id):
            raise ValueError("only models whose pieces begin with their blanks")
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self._max_cached = max_cached
        self._cache: dict[str, bytes] = {}
        self._merged: dict[str, bytes] = {}

    def merge(self, part: str) -> list[int]:
        """The ids of a part by the agenda."""
        symbols = self._merged_short(part) if len(part) <= SHORT_PART else self._merged_long(part)
        ids: list[int] = []
        for symbol in symbols:
            known = self._id.get(symbol)
            if known is not None:
                ids.append(known)
            else:
                ids += [self._byte[b] for b in symbol.encode()]
        return ids

    def _merged_short(self, part: str) -> list[str]:
        score, symbols = self._score.get, list(part)
        agenda = [score(a + b, NO_PIECE) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := max(agenda)) != NO_PIECE:
            k = agenda.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del agenda[k]
            if k < len(agenda):
                agenda[k] = score(symbols[k] + symbols[k + 1], NO_PIECE)
            if k:
                agenda[k - 1] = score(symbols[k - 1] + symbols[k], NO_PIECE)
        return symbols

    def _merged_long(self, part: str) -> list[str]:
        """Symbols are linked by their positions."""
        score = self._score.get
        symbols: list[str | None] = list(part)
        n = len(symbols)
        if n > 1:
            following = list(range(1, n + 1))
            preceding = list(range(-1, n - 1))
            agenda = []
            for k in range(n - 1):
                pair = symbols[k] + symbols[k + 1]
                if (s := score(pair)) is not None:
                    agenda.append((-s, k, pair))
            heapq.heapify(agenda)
            while agenda:
                _, k, pair = heapq.heappop(agenda)
                left = symbols[k]
                right = following[k]
                if left is None or right == n or left + symbols[right] != pair:
                    continue  # one of the two has been merged meanwhile
                symbols[k], symbols[right] = pair, None
                following[k] = after = following[right]
                if after < n:
                    preceding[after] = k
                    longer = pair + symbols[after]
                    if (s := score(longer)) is not None:
                        heapq.heappush(agenda, (-s, k, longer))
                if (before := preceding[k]) >= 0:
                    longer = symbols[before] + pair
                    if (s := score(longer)) is not None:
                        heapq.heappush(agenda, (-s, before, longer))
        return [symbol for symbol in symbols if symbol is not None]

    def _parts(self, word: str) -> list[str]:
        """A word, cut where no piece has the two characters side by side."""
        together = self._together
        parts, start = [], 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in together:
                parts.append(word[start:k])
                start = k
        parts.append(word[start:])
        return parts

    def _learn(self, words: set[str]) -> None:
        """Merge new words by their parts, and hold each new part against the library."""
        if len(self._merged) > self._max_cached:
            self._merged.clear()
        parts: dict[str, list[int]] = {}
        for word in words:
            found = []
            for part in self._parts(word):
                ids = self._merged.get(part)
                if ids is None:
                    parts[part] = merged = self.merge(part)
                    ids = self._merged[part] = struct.pack(f"<{len(merged)}I", *merged)
                found.append(ids)
            self._cache[word] = found[0] if len(found) == 1 else b"".join(found)
        if not parts:
            return
        # The library puts a blank before each text, so a part that begins without one is checked behind a line break,
        # which no piece holds.
        texts = [part[1:] if part[0] == SPACE else "\n" + part for part in parts]
        line = [*self.library.encode("\n", num_threads=1)]
        theirs = self.library.encode([t.replace(SPACE, " ") for t in texts], num_threads=1)
        for (part, ids), expected in zip(parts.items(), theirs, strict=True):
            if part != SPACE and expected != (ids if part[0] == SPACE else line + ids):
                raise AssertionError(f"the library splits {part!r} into {expected}, the agenda into {ids}")

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without begin and end; an empty text has none."""
        lot: list[list[str]] = []
        size = 0
        for text in texts:
            lot.append(WORDS(SPACE + text.replace(" ", SPACE)) if text else [])
            size += len(text)
            if size > LOT_CHARS:
                yield from self._encode_lot(lot)
                lot, size = [], 0
        yield from self._encode_lot(lot)

    def _encode_lot(self, lot: list[list[str]]) -> Iterator[bytes]:
        unknown = set().union(*lot) - self._cache.keys()
        if len(self._cache) + len(unknown) > self._max_cached:
            self._cache.clear()
            unknown = set().union(*lot)
        self._learn(unknown)
        known = self._cache.__getitem__
        for words in lot:
            yield b"".join(map(known, words))


def piece_coder(path: str) -> PieceCoder:
    """The worker's coder of a model file."""
    return held(("pieces", path), lambda: PieceCoder(path))


def encode_decode(docs: DataFrame, model: str, check: str = "parts") -> DataFrame:
    """Ids of every whole text with begin and end ids, and the text decoded from them, as counts and digests.

    NULL counts as empty, and an empty text has the begin and end ids alone. Rows stay as they are: repeated ones
    repeat, NULL ids stay NULL, other columns are not read. A difference from the library is an error.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(model)
        begin, end = (np.array([i], "<u4").tobytes() for i in (coder.bos, coder.eos))
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                texts = [text or "" for text in part.column("text").to_pylist()]
                lengths, ids_digest, text_digest = [], [], []
                for text, inner in zip(texts, coder.encode(texts), strict=True):
                    ids = begin + inner + end
                    decoded = coder.library.decode(np.frombuffer(ids, "<u4").tolist())
                    if decoded != text and SPACE not in text:
                        raise AssertionError("the ids do not decode to the text")
                    lengths.append(len(ids) // 4)
                    ids_digest.append(hashlib.sha256(ids).hexdigest())
                    text_digest.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if check == "texts" and coder.library.encode(text, add_bos=True, add_eos=True) != np.frombuffer(
                        ids, "<u4"
                    ).tolist():
                        raise AssertionError("the library has other ids for a text")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(ids_digest, pa.string()),
                     pa.array(text_digest, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return id_and_text(docs).mapInArrow(code, ENCODED)
