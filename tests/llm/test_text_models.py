"""Piece ids, language, toxicity and quality against the library, brute force and held-out labels."""

import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siren.llm import perplexity, ppm, rows, toxicity
from siren.llm.perplexity import BITS, ORDER, kneser_ney, log_probabilities, quality, sorted_arrays
from siren.llm.piece_bpe import PieceCoder, encode_decode, piece_coder
from siren.llm.rows import smallest, up_to_limit

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   ", "\n", "a  b   c", " lead", "trail ", "▁", "▁▁a ▁", "x▁y", "日本語テスト", "😀 ok", "\x00\x01", "<s> </s> <unk> <0x41>",
    "12345 67", "aaaa" * 900, " " * 3000, "Ünïcödé ſ ǆ", "tab\tnew\r\n", "  \xa0", "é",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def table(spark, rows, columns="doc_id long, text string, lang string, score string, n_words int, predicted string"):
    return spark.createDataFrame([(d, t, g, "x", 1, "y") for d, t, g in rows], columns)


def test_pieces_equal_library(spark, library):
    docs = [(k, t, None) for k, t in enumerate(ODD)] + [(3, "again", None), (3, "again", None), (None, "no id", None)]
    rows = encode_decode(table(spark, docs), MODEL, check="texts").collect()
    expected = Counter()
    for doc_id, text, _ in docs:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        decoded = sha256(library.decode(ids).encode()).hexdigest()
        expected[doc_id, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), decoded] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == expected
    assert encode_decode(table(spark, []), MODEL).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" ▁thehinga\n.é😀<s>0", max_size=50))
def test_pieces_of_any_text(text):
    coder = piece_coder(MODEL)
    assert np.frombuffer(next(coder.encode([text])), "<u4").tolist() == coder.library.encode(text)


def test_small_cache_gives_the_same_ids(library):
    texts = [t for t in ODD if t]
    coder = PieceCoder(MODEL, max_cached=3)
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts)] == [library.encode(t) for t in texts]


def test_agenda_takes_the_best_score_then_the_leftmost():
    coder = piece_coder(MODEL)
    for text in ("aaaaa", "theret", "ininin", "▁▁▁"):
        assert coder.merge(text) == [i for i in coder.library.encode("\n" + text.replace("▁", " "))[2:]]


# Language


def grams(texts):
    counts = defaultdict(Counter)
    for text in texts:
        data = b"\n" * ppm.ORDER + text.encode().lower()
        for at in range(ppm.ORDER, len(data)):
            for size in range(ppm.ORDER + 1):
                counts[data[at - size : at]][data[at]] += 1
    return counts


def code_length(counts, text):
    data = b"\n" * ppm.ORDER + text.encode().lower()
    bits = 0.0
    for at in range(ppm.ORDER, len(data)):
        for size in range(ppm.ORDER, -1, -1):
            followed = counts.get(data[at - size : at])
            if not followed:
                continue
            total, different = sum(followed.values()), len(followed)
            if data[at] in followed:
                bits += math.log2((total + different) / followed[data[at]])
                break
            bits += math.log2((total + different) / different)
        else:
            bits += 8
    return bits


SENTENCES = {
    "en": ["the cat sat on the mat", "hello there, the dog", "the the the"],
    "de": ["die katze über der straße", "und so weiter der hund", "der der der"],
    "fr": ["le chat a été là", "où est le chien"],
}


@pytest.mark.parametrize("slice_bytes", [1_000_000, 7])
def test_code_lengths(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(ppm, "SLICE", slice_bytes)
    monkeypatch.setattr(ppm, "MIN_CONTEXT", 1)
    rows = [(k, t, lang) for lang, texts in SENTENCES.items() for k, t in enumerate(texts)]
    model = ppm.train(table(spark, [*rows, (1, None, "en"), (1, "zzz", None), (1, "", "es")]))
    assert model["languages"] == ["de", "en", "fr"]
    scorer = ppm.Scorer(model)
    texts = ["the dog sat", "", None, "über été", "ZZZ 99", "x" * 50]
    for text, found in zip(texts, scorer.bits(texts), strict=True):
        for lang, bits in zip(model["languages"], found, strict=True):
            assert bits == pytest.approx(code_length(grams(SENTENCES[lang]), text or ""), abs=1e-2)


def test_identify(spark):
    docs = [(k, SENTENCES[lang][k % 2], lang) for k, lang in enumerate(["en", "de", "fr"] * 20)]
    docs += [(100, None, "en"), (101, "", "en"), (102, "123 !? ½", "en"), (103, "über der katze " * 5000, None), (None, "the cat", None)]
    docs += [(0, "the cat", "en"), (0, "the cat", "en")]
    rows = ppm.identify(table(spark, docs)).collect()
    assert Counter((r.doc_id) for r in rows) == Counter(d for d, _, _ in docs)
    found = {r.doc_id: r for r in rows}
    assert all(found[k].lang_pred == docs[k][2] for k in range(60))
    assert [found[k].lang_pred for k in (100, 101, 102, 103, None)] == ["und", "und", "und", "de", "en"]
    assert all(0 <= r.score <= 1 for r in rows) and found[100].score == 0
    assert all(found[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(60)) and found[None].held_out
    assert ppm.identify(table(spark, [])).count() == 0
    assert [r.lang_pred for r in ppm.identify(table(spark, [(1, "abc", None)])).collect()] == ["und"]


def test_copies_count_as_one_training_text(spark):
    texts = [f"text number {k} of the sample {'abc'[k % 3] * (k + 1)}" for k in range(10)]
    single = table(spark, [(k, t, lang) for k, t in enumerate(texts) for lang in ("en", "de")])
    model = ppm.train(single, sample=5)
    for copies in (20, 7):
        found = ppm.train(spark.range(copies).crossJoin(single).drop("id"), sample=5)
        assert found["languages"] == model["languages"]
        assert all(np.array_equal(found[k], model[k]) for k in ("lang", "size", "gram", "n"))


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = ppm.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


# Toxicity


def labelled(n=480, group="muslims"):
    """Some insults are common, most too rare to learn; the group is named beside most insults, and in a few other texts."""
    docs, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        words = ["the", f"word{chr(97 + k % 17)}", "and", f"more{chr(97 + k % 11)}"]
        if toxic:
            words += [["idiot", "moron", f"{chr(97 + k % 23)}{chr(97 + k % 19)}{chr(97 + k % 7)}x"][min(2, k // 5 % 6)], group]
        elif k % 29 == 1:
            words.append(group)
        elif k % 2:
            words.append("people")
        docs.append((k, " ".join(words), "en"))
        labels.append((k, int(toxic), "x"))
    return docs, labels


def test_swapped_terms_keep_neutral_mentions_apart(spark):
    docs, labels = labelled()
    texts, marks = table(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    neutral, insult = ["the muslims and more4 met", "christians met"], ["what an idiot", "these moron people"]
    plain = toxicity.Scorer(toxicity.train(texts, marks, swap_weight=0.0)).scores(neutral + insult)
    fair = toxicity.Scorer(toxicity.train(texts, marks, swap_weight=20.0)).scores(neutral + insult)
    assert plain[0] > 0.3 > fair[0]  # the false positive goes
    assert abs(fair[0] - fair[1]) < abs(plain[0] - plain[1])
    assert min(fair[2:]) > 0.3


def test_swapped():
    assert toxicity.swapped("Muslims, women and Frauen; womenfolk") == [
        "jews, men and männer; womenfolk", "people, people and leute; womenfolk",
    ]
    assert toxicity.swapped("no one") == []


def test_score_documents(spark):
    docs, labels = labelled(1920, group="people")
    docs += [(900, None, None), (901, "", None), (902, "people, an idiot", None), (902, "people, an idiot", None), (None, "idiot people " * 50_000, None)]
    labels += [(None, 1, "x"), (5, None, "x"), (5000, 1, "x"), (7, 0, "x")]
    rows = toxicity.score_documents(table(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int, text string")).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _, _ in docs)
    found = {r.doc_id: r for r in rows}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert found[902].predicted == found[None].predicted == 1 and found[900].score == found[901].score
    assert all(found[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(480))
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(table(spark, []), empty).count() == 0
    assert {r.predicted for r in toxicity.score_documents(table(spark, docs), empty).collect()} == {0}


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hits = sum(r.toxic and r.predicted for r in rows)
    assert hits / sum(r.toxic for r in rows) > 0.85
    assert hits / sum(r.predicted for r in rows) > 0.85


def test_only_about_the_limit_is_ranked(spark):
    given = spark.range(200_000).withColumns({"label": (F.col("id") % 10 == 0).cast("int"), "key": F.xxhash64("id")})
    limit = F.when(F.col("label") == 1, 500).otherwise(1500)
    found = Counter((r.label, r.id) for r in smallest(given, "label", "key", limit, "id").collect())
    every = sorted((r.key, r.id, r.label) for r in given.collect())
    expected = [[(x, k) for _, k, x in every if x == label][:n] for label, n in ((0, 1500), (1, 500))]
    assert found == Counter(expected[0] + expected[1])
    assert up_to_limit(given, "label", "key", limit).count() < 2_100
    assert smallest(given, "label", "key", 300_000).count() == 200_000


@pytest.mark.parametrize("train", ["language", "toxicity"])
def test_training_ranks_no_whole_group(spark, monkeypatch, train):
    docs = [(k, f"some text {k}", "en") for k in range(3000)]
    ranked = []
    monkeypatch.setattr(rows, "up_to_limit", lambda *given: ranked.append((found := up_to_limit(*given)).count()) or found)
    if train == "language":
        ppm.train(table(spark, docs), sample=100)
    else:
        labels = spark.createDataFrame([(k, k % 2) for k in range(3000)], "doc_id long, toxic int")
        toxicity.train(table(spark, docs), labels, sample={0: 100, 1: 50})
    assert len(ranked) == 1 and ranked[0] < 200


# Quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rules(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        lines += line in seen and bool(WORDS.search(line))
        seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, lines, len(covered)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é😀\n\t#|\x1c\x85", max_size=40)), max_size=8))
def test_plain_counts(texts):
    found = perplexity.text_rules(texts)
    assert list(zip(*(found[r].tolist() for r in perplexity.RULES), strict=True)) == [rules(t) for t in texts]


def test_kneser_ney_sums_to_one_and_equals_the_formula(spark):
    rng = np.random.default_rng(4)
    symbols = rng.integers(60, 65, 4000)
    symbols[:40] = rng.integers(200, 256, 40)  # codes of which the highest bit is set
    codes = sum(symbols[ORDER - 1 - k : len(symbols) - k].astype(np.int64) << (BITS * k) for k in range(ORDER))
    found, n = (x.tolist() for x in np.unique(codes, return_counts=True))
    counts = spark.createDataFrame(list(zip(["0=x"] * len(found), found, n, strict=True)), "model string, gram long, n long")
    model = sorted_arrays(kneser_ney(counts).toArrow())["0=x"]
    for context in (found[0] >> BITS, found[-1] >> BITS, 0x3FFFF):
        every = (context << BITS) + np.arange(1 << BITS)
        for log_p in log_probabilities(model, every):
            assert np.exp(log_p).sum() == pytest.approx(1, abs=1e-4)
    # By hand, from counts kept in dictionaries.
    tables = [dict(zip(found, n, strict=True))]
    for order in range(ORDER - 1, 0, -1):
        tables.append(Counter(code & ((1 << BITS * order) - 1) for code in tables[-1]))

    def probability(code, order):
        if order == 0:
            return 1 / (1 << BITS)
        counts = tables[ORDER - order]
        taken = [0, *perplexity.discounts(*(list(counts.values()).count(k) for k in (1, 2, 3, 4)))]
        context = code >> BITS
        followed = [v for k, v in counts.items() if k >> BITS == context]
        below = probability(code & ((1 << BITS * (order - 1)) - 1), order - 1)
        if not followed:
            return below
        weight = sum(taken[min(v, 3)] for v in followed) / sum(followed)
        mine = counts.get(code, 0)
        return max(mine - taken[min(mine, 3)], 0) / sum(followed) + weight * below

    for code in [*found[:40], *found[-40:], 0, (5 << 6) + 2, (9 << 32) + found[3] % (1 << 32)]:
        full, alone = log_probabilities(model, np.array([code]))
        assert full[0] == pytest.approx(math.log(probability(code, ORDER)), abs=1e-4)
        assert alone[0] == pytest.approx(math.log(probability(code & 0xFF, 1)), abs=1e-4)


def test_a_joined_model_scores_as_a_broadcast_one(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, None, None), (-2, "", "en"), (-3, "none has this language\nat all", "zz"), (-4, "a\n\nb" * 50_000, "en"), (None, "same", None)]
    docs = docs.unionByName(spark.createDataFrame(odd * 2, "doc_id long, text string, lang string"))
    monkeypatch.setattr(perplexity, "BLOCK_BYTES", 20_000)
    one, other = (
        sorted(quality(docs, max_model_rows=n).collect(), key=lambda r: (r.doc_id or 0, r.n_words, r.log_alone or 0))
        for n in (perplexity.MAX_MODEL_ROWS, 10)
    )
    assert len(one) == docs.count() and [r[:8] for r in one] == [r[:8] for r in other]
    for r, x in zip(one, other, strict=True):
        assert r[8:] == x[8:] or r[8:] == pytest.approx(x[8:], abs=1e-9)
    empty = docs.limit(0)
    assert quality(empty, max_model_rows=0).count() == 0


def test_no_line_vouches_for_itself(spark):
    """However often the corpus repeats a strange line, it is as strange as a line seen once."""
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 7))) for _ in range(200)]
    plain = [(k, " ".join(rng.choice(vocabulary, 120)), "en") for k in range(100)]
    strange = " ".join("".join(rng.choice(list("qxzjkvw"), 6)) for _ in range(80))
    for copies in (1, 60):
        docs = table(spark, plain + [(1000 + k, strange, "en") for k in range(copies)])
        rows = quality(docs).collect()
        assert not any(r.kept for r in rows if r.doc_id >= 1000)
        assert np.mean([r.kept for r in rows if r.doc_id < 1000]) > 0.97


def test_quality(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 7))) for _ in range(400)]
    docs = [(k, " ".join(rng.choice(vocabulary, 120)), "en") for k in range(150)]
    docs += [(200, " ".join("".join(rng.choice(list("qxzjkvw#"), 6)) for _ in range(80)), "en")]
    docs += [(201, "zq " * 30, "en"), (202, None, "en"), (203, "", None), (204, docs[0][1], None), (205, docs[3][1] * 400, "en")]
    docs += [(5, docs[5][1], "en"), (None, docs[6][1], "en"), (206, "", "xx"), (207, "few words", "yy")]
    rows = quality(table(spark, docs)).collect()
    assert Counter((r.doc_id, *(r[k] for k in perplexity.RULES)) for r in rows) == Counter((d, *rules(t)) for d, t, _ in docs)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    kept = {r.doc_id: r.kept for r in rows}
    assert all(kept[k] for k in range(150)) and kept[None] and kept[204]
    assert not any(kept[k] for k in (200, 201, 202, 203, 205, 206, 207))
    assert quality(table(spark, [])).count() == 0


def test_quality_keeps_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.97
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.1


def test_band_rejects_bad_documents_of_the_held_out_half(spark):
    """The limits were set on the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    rows = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 2 == 0]
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.98
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.05


def test_lines_count_once_however_rows_are_dealt_out(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 7))) for _ in range(200)]
    shared = " ".join(rng.choice(vocabulary, 60))
    docs = table(spark, [(k, shared + "\n" + " ".join(rng.choice(vocabulary, 60)), "en") for k in range(60)])
    docs = docs.unionAll(docs.limit(20))
    one, many = (perplexity.count_grams(docs.repartition(n)).toPandas().sort_values(["model", "gram"]) for n in (1, 40))
    assert one["n"].tolist() == many["n"].tolist()
    lines = {line for r in docs.collect() for line in r.text.split("\n")}
    assert one["n"].sum() == sum(map(len, lines))
    found = [{r.doc_id: r for r in quality(docs.repartition(n)).collect()} for n in (1, 40)]
    for k, r in found[0].items():
        assert r.kept == found[1][k].kept and r.log_perplexity == pytest.approx(found[1][k].log_perplexity, abs=1e-9)


def test_only_lines_of_several_texts_are_moved(spark, monkeypatch):
    """Other lines are counted where they are; chance marks move more lines and change no count."""
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 7))) for _ in range(200)]
    shared, *own = (" ".join(rng.choice(vocabulary, 60)) for _ in range(41))
    docs = table(spark, [(k, f"{line}\n{shared}", ("en", None)[k % 2]) for k, line in enumerate(own)])
    marks = np.flatnonzero(np.unpackbits(perplexity.shared_marks(docs.select("lang", "text")), bitorder="little"))
    wanted = perplexity._line_hashes([("en", shared), (None, shared)]) & ((1 << perplexity.LINE_BITS) - 1)
    assert marks.tolist() == sorted(wanted.tolist())

    def counts():
        return sorted(map(tuple, perplexity.count_grams(docs).collect()))

    found = counts()
    assert sum(n for _, _, n in found) == sum(map(len, own)) + 2 * len(shared)
    monkeypatch.setattr(perplexity, "LINE_BITS", 5)
    monkeypatch.setattr(perplexity, "PART_BITS", 3)
    assert counts() == found


def test_both_forms_of_the_agenda_agree():
    coder = piece_coder(MODEL)
    rng = np.random.default_rng(9)
    for _ in range(300):
        part = "".join(rng.choice(list("▁theinrsaé"), rng.integers(1, 30)))
        assert coder._merged_long(part) == coder._merged_short(part)
