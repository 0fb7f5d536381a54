"""Token ids, packing and token files against the tokenizers library and plain Python."""

import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siren.llm.packing import pack, plan
from siren.llm.token_files import WaveletFile, build, token_files, write_token_files
from siren.llm.word_bpe import ChunkEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\n", "<|endoftext|>x <|startoftext|>", "<|x", "İstanbul ΣΑΣ café é x", "a b c\x1cd\x85e", "日本語 12345",
    "don't we'll 's'S \"'s ''s .'t 'x", "x'S I'M ", "́a ̀b", "ſt ŉ", "“quoted” – dash… 10€", "½ ² ª µ", "ﬁ", "a" * 5000,
    "!?.," * 400, " x y　z", "ÀÉ ×÷ ÿ ß", "\x00\x01 \x7f",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def packed(values):
    return np.array(values, "<u4").tobytes()


def test_encoder_equals_library(library):
    encoder = ChunkEncoder(PATH, max_cached=50)
    assert list(encoder.encode(ODD)) == [packed(ids(library, t)) for t in ODD]


@cache
def either():
    return Tokenizer.from_file(PATH), ChunkEncoder(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aBc'sStT .,!<|>\n\t0éÉß– ́½x", max_size=60))
def test_encoder_equals_library_on_any_text(text):
    library, encoder = either()
    assert next(encoder.encode([text])) == packed(ids(library, text))


def one_by_one(lengths, window):
    """Best fit, longest first: room left in each window."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits)[1]] -= length
        else:
            rooms.append(window - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(60))
def test_plan_equals_placing_one_by_one(seed):
    rng = random.Random(seed)
    window = rng.choice([8, 16, 64, 100])
    lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 200))] + [rng.randint(1, window)] * rng.choice([0, 50])
    counts = Counter(lengths)
    steps = plan(counts, window)
    rooms = defaultdict(lambda: window)
    for k, (length, rank, first, offset, each) in enumerate(steps):
        last = steps[k + 1][1] if k + 1 < len(steps) and steps[k + 1][0] == length else counts[length]
        for piece in range(last - rank):
            sequence, place = first + piece // each, offset + piece % each * length
            assert window - rooms[sequence] == place
            rooms[sequence] -= length
    assert sorted(rooms.values()) == one_by_one(lengths, window)


def test_plan_does_not_grow_with_the_counts():
    assert len(plan({k: 10**12 + k for k in range(1, 4097)})) < 150_000


def table(spark, rows):
    extra = "doc_id long, text string, length long, start string, sequence_id int"
    return spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], extra)


DOCS = [(k, t) for k, t in enumerate(ODD)] + [
    (50, "word " * 9000), (51, "word " * 4095), (52, "word " * 4094), (7, "again"), (7, "again"), (None, "no id"),
]


def test_pack(spark, library):
    rows = pack(table(spark, DOCS).repartition(3), PATH, end_id=2).collect()
    expected = Counter()
    for doc_id, text in DOCS:
        full = [*ids(library, text), 2]
        for start in range(0, len(full), 4096):
            piece = full[start : start + 4096]
            expected[doc_id, start, len(piece), zlib.crc32(packed(piece)), len(full)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expected
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096
    assert sorted(4096 - sum(n for _, n in p) for p in windows.values()) == one_by_one([r.length for r in rows], 4096)
    assert pack(table(spark, []), PATH, end_id=2).count() == 0


def test_token_files(spark, library, tmp_path):
    docs = table(spark, DOCS)
    rows = token_files(docs.repartition(3), PATH, end_id=1).collect()
    start = 0
    found = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((d for d, _ in DOCS), key=lambda d: (d is not None, d or 0))
    left = Counter((d, packed([*ids(library, t), 1])) for d, t in DOCS)
    by_digest = {(d, len(b) // 4, zlib.crc32(b)): (d, b) for d, b in left}
    for r in found:
        assert r.start == start
        start += r.n_tokens
        left[by_digest[r.doc_id, r.n_tokens, r.ids_crc32]] -= 1
    assert set(left.values()) == {0}
    write_token_files(docs, str(tmp_path / "small"), PATH, 1, shard_tokens=3000)
    files = [WaveletFile(p.read_bytes()) for p in (tmp_path / "small").glob("part-*")]
    assert len(files) > 2 and sum(f.n for f in files) == start
    assert token_files(table(spark, []), PATH, end_id=1).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=1500), st.integers(1, 1200))
def test_wavelet_file(tokens, factor):
    tokens = np.array(tokens, np.uint32) * np.uint32(factor)
    file = WaveletFile(build(tokens, [5, None], [len(tokens), 0], 3, 9) + b"\n")
    assert (file.doc_ids, file.part, file.start) == ([5, None], 3, 9)
    assert file.tokens().tolist() == tokens.tolist()
    for k in range(0, len(tokens), 97):
        assert file.access(k) == tokens[k]
    for token in {*tokens[:3].tolist(), 1, 10**6}:
        places = np.flatnonzero(tokens == token)
        assert file.count(token) == len(places)
        assert file.count(token, 10, 600) == ((places >= 10) & (places < 600)).sum()
        assert [file.occurrence(token, k) for k in range(min(4, len(places)))] == places[:4].tolist()
    with pytest.raises(IndexError):
        file.access(len(tokens))


def test_broken_token_file():
    whole = build(np.arange(100, dtype=np.uint32), [1], [100], 0, 0)
    for broken in (whole[1:], whole[:-1]):
        with pytest.raises(ValueError):
            WaveletFile(broken)
