"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word's hash is a polynomial over random 64-bit values of its bytes, mixed at the end; sums and products wrap around.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_STATE = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _STATE.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_STATE.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IN_WORD = np.ones(256, bool)
IN_WORD[list(SPACES)] = False
#: Letters only: ASCII letters and every byte of a character beyond ASCII.
IN_LETTERS = np.zeros(256, bool)
IN_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the next call."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.full(size, _BASE, np.uint64)
        _inverses = np.full(size, _INVERSE, np.uint64)
        _powers[0] = _inverses[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
        np.multiply.accumulate(_inverses, out=_inverses)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """Bytes of texts one after the other, each followed by a line break; text k is data[starts[k]:ends[k]]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(column: pa.Array, lower: bool = False) -> Texts:
        """From a string column; NULL counts as empty. ``lower``: A-Z only."""
        values = [v or b"" for v in column.cast(pa.binary()).to_pylist()]
        data = np.frombuffer(b"\n".join([*values, b""]), np.uint8)
        lengths = np.array([len(v) for v in values], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        return Texts(_LOWER[data] if lower else data, ends - lengths, ends)


@dataclass
class Words:
    """Words of texts: where each begins and ends in the bytes, its hash, and how many each text has."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(texts: Texts, in_word: np.ndarray = IN_WORD) -> Words:
        inside = in_word[texts.data]
        if len(inside):
            inside[texts.ends] = False
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        first = np.searchsorted(starts, texts.starts)
        counts = np.diff(np.append(first, len(starts)))
        return Words(starts, ends, prefix_hashes(texts.data, starts, ends), counts)

    def text_of(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each range of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * inverses[starts] + lengths)


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words within a text, and where each window's first word is."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(_BASE) + hashes[k : n - size + 1 + k]
    text_end = np.repeat(np.cumsum(counts), counts)
    first = np.flatnonzero(np.arange(n - size + 1) + size <= text_end[: n - size + 1])
    return mix(total[first]), first


def padded(texts: list[str | None], gap: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, each behind ``gap`` line breaks; where each begins and ends. ``lower``: A-Z in lower case."""
    values = [(t or "").encode().lower() if lower else (t or "").encode() for t in texts]
    data = np.frombuffer((b"\n" * gap).join([b"", *values]), np.uint8)
    lengths = np.array([len(v) for v in values], np.int64)
    ends = np.cumsum(lengths + gap)
    return data, ends - lengths, ends


def inside(size: int, starts: np.ndarray, gap: int) -> np.ndarray:
    """The positions of ``padded`` bytes that belong to a text."""
    at = np.ones(size, bool)
    for back in range(1, gap + 1):
        at[starts - back] = False
    return np.flatnonzero(at)
